"""The staged run over dumps: each stage's table is written once, marked complete, and read by the next ones.

A stage whose table is complete is skipped unless it is forced; all stages share one session. Inputs that aren't
there or aren't complete stop the run.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession

from ..config import Layout, Params
from ..operators import articles as A
from ..operators import cohorts as C
from ..operators import graph as G
from ..operators import pagerank as R
from ..operators import reports as X
from ..operators import similarity as S
from ..sources import files, sqldump, xmldump
from ..streaming import ingest
from . import figures

PAGES_XML = "pages-articles.xml.bz2"


class Run:
    """One run's settings, and its stages by name."""

    def __init__(self, spark: SparkSession, layout: Layout, params: Params | None = None, *, force: bool = False, exact_text: bool = False, strict_xml: bool = False, limit: int | None = None, min_articles: int = xmldump.MIN_ARTICLES, resume: bool = False, compression: str = "snappy", rows_per_file: int = 0, prefix: str = ""):
        self.spark, self.layout, self.params = spark, layout, params or Params()
        self.force, self.exact_text, self.strict_xml, self.limit, self.min_articles = force, exact_text, strict_xml, limit, min_articles
        self.options = {"compression": compression, "rows_per_file": rows_per_file}
        self.prefix, self.resume = prefix, resume

    def table(self, name: str) -> DataFrame:
        """A table that another stage must have completed."""
        path = files.table_path(self.spark, self.layout.table(name))
        return self.spark.read.parquet(files.require_complete(self.spark, path))

    def optional(self, name: str) -> DataFrame | None:
        path = self.layout.table(name)
        return self.spark.read.parquet(path) if files.is_complete(self.spark, path) else None

    def _stage(self, name: str, build: Callable[[], DataFrame], **facts) -> DataFrame:
        return files.stage(self.spark, self.layout.table(name), build, self.force, allow_empty=False, **self.options, **facts)

    # --- stages, in order ---

    def ingest(self, only: str | None = None) -> None:
        for name, dump in sqldump.DUMPS.items():
            if only in (None, name) and self.resume:
                self._ingest_files(name, dump)
            elif only in (None, name):
                path = files.raw_path(self.spark, self.layout.raw_file(self.prefix + dump.file), required=not dump.optional)
                if path:
                    self._stage(name, lambda p=path, n=name: sqldump.read_dump(self.spark, p, n, strict=self.params.strict_escape))

    def _ingest_files(self, name: str, dump: sqldump.Dump) -> None:
        """A dump in several files (table.1.sql.gz, ...): those that an interrupted run has done are not parsed again."""
        spark, target = self.spark, self.layout.table(name)
        pattern = self.layout.raw_file(f"{self.prefix}{name}.*sql.gz")
        if not files.matches(spark, pattern):
            files.raw_path(spark, self.layout.raw_file(self.prefix + dump.file), required=not dump.optional)
            return
        columns = sqldump.create_columns(sqldump.lines(spark, pattern), name)
        if ingest.ingest_new(spark, pattern, name, columns, target, f"{target}.done", self.params.strict_escape) or not files.is_complete(spark, target):
            files.adopt(spark, target)

    def pages(self) -> None:
        self._stage("pages_clean", lambda: G.clean_pages(self.table("page"), self.params.min_page_len))

    def edges(self) -> None:
        self._stage("edges", lambda: G.edges(self.table("pagelinks"), self.table("linktarget"), self.table("pages_clean")))

    def extract(self) -> None:
        seen = Observation()

        def build() -> DataFrame:
            path = files.raw_path(self.spark, self.layout.raw_file(self.prefix + PAGES_XML))
            pages = xmldump.malformed(xmldump.read_pages(self.spark, path, self.strict_xml), seen)
            return A.articles_raw(xmldump.article_pages(pages, self.limit), self.exact_text)

        # the check comes before the marker, so a rejected extraction is never taken as complete
        check = lambda rows: xmldump.extraction_facts(rows, 0 if self.limit else seen.get["malformed"], self.min_articles)
        self._stage("articles_raw", build, check=check, **({"limited": True} if self.limit else {}))

    def articles(self) -> None:
        self._stage("articles_clean", lambda: A.articles_clean(self.table("pages_clean"), self.table("articles_raw"), self.params.min_words))

    def graph_stats(self) -> None:
        links = self.table("edges")
        degrees = G.degrees(self.table("pages_clean"), links).persist()
        files.write_document(G.graph_stats(degrees, links), self.layout.result("graph_stats.json"))
        files.write_csv(G.describe(degrees, "page_id", "in_degree", "out_degree"), self.layout.result("degree_summary.csv"))
        degrees.unpersist()

    def pagerank(self) -> None:
        p, began = self.params, time.time()

        def build() -> DataFrame:
            pages = self.table("pages_clean")
            links = R.inner_edges(pages, self.table("edges"))
            result = R.pagerank(pages, links, p.damping, p.tolerance, p.max_iterations)
            files.write_json(self.spark, self.layout.result("pagerank_run_stats.json"), R.run_stats(result, time.time() - began))
            return R.ranked_pages(result.ranks, pages, G.degrees(pages, links))

        ranking = self._stage("pagerank", build)
        files.write_csv(R.top(ranking, 100), self.layout.result("top_100_pagerank.csv"), "rank")

    def groups(self) -> None:
        p = self.params
        self._stage("experiment_groups", lambda: C.experiment_groups(self.table("pagerank"), self.table("articles_clean"), p.group_size, p.seed, self.optional("categorylinks"), self.optional("linktarget"), p.categories, p.median_low, p.median_high))

    def shingles(self) -> None:
        p = self.params
        made = self._stage("shingles", lambda: S.group_shingles(self.table("experiment_groups"), self.table("articles_clean"), p.shingle_size))
        self._stage("minhash_signatures", lambda: S.signatures(made, p.permutations))

    def similarity(self) -> None:
        groups = self.table("experiment_groups")
        pairs = files.stage(self.spark, self.layout.table("pairwise_similarity"), lambda: S.pairwise_similarity(groups, self.table("shingles"), self.table("minhash_signatures")), self.force, **self.options)
        files.stage(self.spark, self.layout.table("similarity_summary"), lambda: S.similarity_summary(pairs, groups), self.force, **self.options)
        files.write_csv(self.table("similarity_summary"), self.layout.result("similarity_summary.csv"), "group_name")

    def analysis(self) -> None:
        summary, pairs = self.table("similarity_summary"), self.table("pairwise_similarity")
        files.write_csv(X.research_questions(summary, pairs), self.layout.result("research_question_results.csv"))
        files.write_csv(S.percentile_similarity(self.table("experiment_groups"), self.table("shingles")), self.layout.result("pagerank_percentile_similarity.csv"), "bin_idx")

    def figures(self) -> None:
        ranking, pairs, summary = self.table("pagerank"), self.table("pairwise_similarity"), self.table("similarity_summary")
        bins = S.percentile_similarity(self.table("experiment_groups"), self.table("shingles"))
        for name, data in {
            "pagerank_histogram": X.histogram(ranking, "pagerank"), "top20_pagerank": X.top_bar(ranking), "mean_similarity": X.mean_bar(summary),
            "similarity_box": X.box(pairs), "percentile_similarity": X.percentile_line(bins), "exact_vs_minhash": X.scatter(pairs),
        }.items():
            files.write_csv(data, self.layout.result(f"figures/{name}.csv"))
            if figures.available():
                drawn = X.binned_scatter(data) if name == "exact_vs_minhash" else data
                figures.draw(name, [r.asDict() for r in drawn.toLocalIterator()], self.layout.result(f"figures/{name}.png"))

    STAGES = ("ingest", "pages", "edges", "extract", "articles", "graph_stats", "pagerank", "groups", "shingles", "similarity", "analysis", "figures")

    def run(self, *stages: str) -> dict[str, float]:
        """Runs the stages (all by default) in order; the first that fails ends the run. Seconds by stage."""
        took = {}
        for name in self.STAGES:
            if not stages or name in stages:
                began = time.time()
                getattr(self, name)()
                took[name] = time.time() - began
        return took

