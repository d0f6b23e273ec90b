"""The reference queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import articles as A
from ..operators import cohorts as C
from ..operators import graph as G
from ..operators import pagerank as R
from ..operators import reports as X
from ..operators import similarity as S
from ..session import checkpointed
from ..sources.files import changed
from . import markup, roundtrips
from .adapter import CATEGORIES, adapted

#: Parameters of the queries. Sums in another order round alike at these digits.
GROUP_SIZE, PERMUTATIONS, SEED, ITERATIONS, DIGITS = 50, 16, 4022, 20, 12


class Workspace:
    """The tables that queries share, made when first asked for. What several queries read is checkpointed once, as a
    staged run would write it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _adapted(self, name: str) -> DataFrame:
        return adapted(self.spark, self.sf_dir, name)

    @cached_property
    def pages(self) -> DataFrame:
        return G.clean_pages(self._adapted("f_page"))

    @cached_property
    def edges(self) -> DataFrame:
        return G.edges(self._adapted("f_pagelinks"), self._adapted("f_linktarget"), self.pages)

    @cached_property
    def kept_edges(self) -> DataFrame:
        return checkpointed(self.edges)

    @cached_property
    def degrees(self) -> DataFrame:
        return G.degrees(self.pages, self.kept_edges)

    @cached_property
    def ranks(self) -> DataFrame:
        return R.pagerank(self.pages, self.kept_edges, tolerance=0.0, max_iterations=ITERATIONS).ranks

    @cached_property
    def ranking(self) -> DataFrame:
        return checkpointed(R.ranked_pages(self.ranks, self.pages, self.degrees, DIGITS))

    @cached_property
    def documents(self) -> DataFrame:
        """Documents as articles."""
        docs = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
        return docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("clean_text"), text.word_count(F.col("text")).alias("word_count"))

    @cached_property
    def articles(self) -> DataFrame:
        return A.articles_clean(self.pages, self.documents)

    @cached_property
    def base(self) -> DataFrame:
        return C.base_pages(self.ranking, self.articles)

    @cached_property
    def members(self) -> DataFrame:
        return C.category_members(self._adapted("f_categorylinks"), self._adapted("f_linktarget"), CATEGORIES)

    @cached_property
    def groups(self) -> DataFrame:
        return checkpointed(C.experiment_groups(self.ranking, self.articles, GROUP_SIZE, SEED, self._adapted("f_categorylinks"), self._adapted("f_linktarget"), CATEGORIES))

    @cached_property
    def shingled(self) -> DataFrame:
        return checkpointed(S.group_shingles(self.groups, self.articles))

    @cached_property
    def signed(self) -> DataFrame:
        return checkpointed(S.signatures(self.shingled, PERMUTATIONS))

    @cached_property
    def pairs(self) -> DataFrame:
        return checkpointed(S.pairwise_similarity(self.groups, self.shingled, self.signed))

    @cached_property
    def summary(self) -> DataFrame:
        return S.similarity_summary(self.pairs, self.groups)

    @cached_property
    def bins(self) -> DataFrame:
        return S.percentile_similarity(self.groups, self.shingled)


_spaces: dict[tuple[str, str, int], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = spark.sparkContext.applicationId, sf_dir, changed(spark, sf_dir)
    if key not in _spaces:
        _spaces[key] = Workspace(spark, sf_dir)
    return _spaces[key]


def forget() -> None:
    """The next query makes its tables anew."""
    _spaces.clear()


def rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _shingle_rows(w: Workspace) -> DataFrame:
    return S.page_shingles(w.articles)


QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {
    "clean_pages": lambda w: w.pages,
    "edges": lambda w: w.edges,
    "degrees": lambda w: w.degrees,
    "graph_stats": lambda w: rounded(G.graph_stats(w.degrees, w.kept_edges), 6),
    "degree_describe": lambda w: rounded(G.describe(w.degrees, "page_id", "in_degree", "out_degree"), 6),
    "pagerank_20": lambda w: w.ranks.select("page_id", F.round("pagerank", DIGITS).alias("pagerank")),
    "pagerank_ranked": lambda w: rounded(w.ranking, DIGITS),
    "top_100_pagerank": lambda w: rounded(R.top(w.ranking, 100), DIGITS),
    "token_counts": lambda w: w.documents.select("page_id", "word_count"),
    "articles_clean": lambda w: w.articles,
    "shingle_counts": lambda w: _shingle_rows(w).select("page_id", F.size("shingles").cast("long").alias("num_shingles")),
    "shingle_lists": lambda w: _shingle_rows(w).select("page_id", F.md5(F.array_join("shingles", "|")).alias("shingles_md5")),
    "shingles_exploded": lambda w: _shingle_rows(w).select("page_id", F.explode("shingles").alias("shingle")),
    "sample_md5": lambda w: C.sample(w.pages, GROUP_SIZE, SEED).select("page_id", "title"),
    "groups_top": lambda w: rounded(C.top_pages(w.base, GROUP_SIZE), DIGITS),
    "groups_bottom": lambda w: rounded(C.bottom_pages(w.base, GROUP_SIZE), DIGITS),
    "groups_median": lambda w: rounded(C.median_pages(w.base, GROUP_SIZE, SEED), DIGITS),
    "groups_random": lambda w: rounded(C.random_pages(w.base, GROUP_SIZE, SEED), DIGITS),
    "groups_category": lambda w: rounded(C.category_pages(w.base, w.members, GROUP_SIZE, SEED), DIGITS),
    "experiment_groups": lambda w: rounded(w.groups, DIGITS),
    "group_sizes": lambda w: C.group_sizes(w.groups),
    "minhash_md5_16": lambda w: w.signed.select("page_id", "group_name", F.array_join("signature", ",").alias("signature")),
    "minhash_blake2_16": lambda w: S.signatures(w.shingled, PERMUTATIONS, blake2=True).select("page_id", "group_name", F.array_join("signature", ",").alias("signature")),
    "pairwise_jaccard": lambda w: rounded(w.pairs.drop("jaccard_minhash")),
    "minhash_jaccard_pairs": lambda w: rounded(w.pairs.select("group_name", "page_id_a", "page_id_b", "jaccard_minhash")),
    "minhash_mae": lambda w: rounded(X.minhash_error(w.pairs)),
    "similarity_summary": lambda w: rounded(w.summary),
    "percentile_bins": lambda w: S.percentile_bins(w.groups).select("page_id", "group_name", "bin_idx", "percentile_bin"),
    "percentile_similarity": lambda w: rounded(w.bins),
    "research_questions": lambda w: rounded(X.research_questions(w.summary, w.pairs)),
    "hist_pagerank": lambda w: rounded(X.histogram(w.ranking, "pagerank"), DIGITS + 2),
    "top20_bar": lambda w: rounded(X.top_bar(w.ranking), DIGITS),
    "mean_bar": lambda w: rounded(X.mean_bar(w.summary)),
    "box_jaccard": lambda w: rounded(X.box(w.pairs)),
    "percentile_line": lambda w: rounded(X.percentile_line(w.bins)),
    "scatter_jaccard": lambda w: rounded(X.scatter(w.pairs)),
}


def _bind(make: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(workspace(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(make) for name, make in QUERIES.items()} | markup.QUERIES | roundtrips.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages rank highest: the link graph, PageRank to convergence, the best hundred."""
    w = Workspace(spark, sf_dir)
    result = R.pagerank(w.pages, w.kept_edges)
    return R.top(R.ranked_pages(result.ranks, w.pages, w.degrees), 100)
