"""Graph, ranking, cohorts and reports, against hand-made graphs and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrank.operators import cohorts, graph, reports, similarity
from linkrank.operators import pagerank as ranking


def frames(spark, nodes, edges):
    pages = spark.createDataFrame([(n, f"t{n}", 200) for n in nodes], "page_id long, title string, page_len long")
    return pages, spark.createDataFrame(edges, "source_page_id long, target_page_id long")


def dense(nodes, edges, d=0.85, tolerance=1e-8, most=100):
    at = {x: i for i, x in enumerate(nodes)}
    src = np.array([at[a] for a, b in edges if a in at and b in at], int)
    dst = np.array([at[b] for a, b in edges if a in at and b in at], int)
    n, out = len(nodes), np.bincount(src, minlength=len(nodes)).astype(float)
    r = np.full(n, 1 / n)
    for i in range(1, most + 1):
        new = np.full(n, (1 - d) / n) + d * r[out == 0].sum() / n
        np.add.at(new, dst, d * r[src] / out[src])
        error, r = np.abs(new - r).sum(), new
        if error < tolerance:
            break
    return dict(zip(nodes, r)), i


@pytest.mark.parametrize("nodes,edges", [
    ([1, 2, 3], [(1, 2), (2, 3), (3, 1)]),
    ([1, 2, 3, 4], [(2, 1), (3, 1), (4, 1)]),
    ([1, 2, 3, 9], [(1, 2), (2, 3), (3, 77)]),
    ([5], []),
])
def test_pagerank(spark, nodes, edges):
    pages, links = frames(spark, nodes, edges)
    result = ranking.pagerank(pages, links)
    want, steps = dense(nodes, edges)
    got = {r["page_id"]: r["pagerank"] for r in result.ranks.collect()}
    assert got == pytest.approx(want, abs=1e-12) and result.iterations == steps
    assert sum(got.values()) == pytest.approx(1.0)


def test_pagerank_without_nodes(spark):
    pages, links = frames(spark, [], [])
    assert ranking.pagerank(pages, links).ranks.count() == 0


def test_clean_pages_and_edges(spark):
    page = spark.createDataFrame(
        [(1, 0, "A", 0, 101), (1, 0, "Z", 0, 300), (2, 0, "B", 0, 100), (3, 1, "C", 0, 500), (4, 0, "D", 1, 500), (5, 0, "E", 0, 500), (6, 0, "F", 0, None)],
        "page_id long, page_namespace long, page_title string, page_is_redirect long, page_len long")
    pages = graph.clean_pages(page)
    assert sorted(map(tuple, pages.collect())) == [(1, "A", 101), (5, "E", 500)]
    target = spark.createDataFrame([(10, 0, "A"), (11, 0, "E"), (12, 14, "E"), (13, 0, "D"), (14, 0, "gone")], "lt_id long, lt_namespace long, lt_title string")
    links = spark.createDataFrame([(1, 0, 11), (1, 0, 11), (1, 0, 10), (5, 0, 10), (5, 1, 11), (5, 0, 12), (1, 0, 13), (1, 0, 14), (9, 0, 10)], "pl_from long, pl_from_namespace long, pl_target_id long")
    assert sorted(map(tuple, graph.edges(links, target, pages).collect())) == [(1, 5), (5, 1)]


def test_stats(spark):
    pages, links = frames(spark, [1, 2, 3, 4], [(1, 2), (1, 3), (2, 3), (9, 1)])
    degrees = graph.degrees(pages, links)
    assert sorted(map(tuple, degrees.collect())) == [(1, 1, 2), (2, 1, 1), (3, 2, 0), (4, 0, 0)]
    stats = graph.graph_stats(degrees, links).first().asDict()
    assert stats["number_of_edges"] == 4 and stats["number_of_nodes"] == 4
    assert (stats["dangling_nodes"], stats["percent_dangling"], stats["isolated_nodes"], stats["median_in_degree"]) == (2, 50.0, 1, 1.0)
    got = {r["statistic"]: r["in_degree"] for r in graph.describe(degrees, "in_degree").collect()}
    x = np.array([1, 1, 2, 0])
    assert got["std"] == pytest.approx(x.std(ddof=1)) and got["25%"] == np.percentile(x, 25) and got["max"] == 2 and got["count"] == 4


def test_ranks(spark):
    pages, links = frames(spark, list(range(50)), [(i, i // 2) for i in range(1, 50)])
    degrees = graph.degrees(pages, links)
    ranks = pages.selectExpr("page_id", "round(1.0 / (page_id % 7 + 1), 3) AS pagerank").selectExpr("page_id", "cast(pagerank as double) AS pagerank")
    rows = ranking.ranked_pages(ranks, pages, degrees).collect()
    order = sorted(rows, key=lambda r: (-r["pagerank"], r["page_id"]))
    assert [r["rank"] for r in order] == list(range(1, 51))
    assert order[0]["percentile"] == 1.0 and order[-1]["percentile"] == 0.0 and order[1]["percentile"] == pytest.approx(1 - 1 / 49)


def test_bins(spark):
    values = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "page_id long, percentile double")
    got = {r["percentile"]: r["bin_idx"] for r in similarity.percentile_bins(df).collect()}
    edges = np.linspace(0, 1, 11)
    assert got == {v: max(int(np.searchsorted(edges, v, side="left")) - 1, 0) for v in values}


def test_pairs_and_summary(spark):
    groups = spark.createDataFrame([(1, "g", "a"), (2, "g", "b"), (3, "g", "c"), (1, "h", "a"), (2, "h", "b"), (7, "solo", "s")], "page_id long, group_name string, title string")
    sets = {1: ["x", "y"], 2: ["y", "z"], 3: [], 7: ["q"]}
    rows = [(p, g, sets[p], len(sets[p])) for p, g, _ in map(tuple, groups.collect())]
    shingled = spark.createDataFrame(rows, "page_id long, group_name string, shingles array<string>, num_shingles long")
    signed = similarity.signatures(shingled, 8)
    pairs = similarity.pairwise_similarity(groups, shingled, signed)
    got = {(r["group_name"], r["page_id_a"], r["page_id_b"]): r["jaccard_exact"] for r in pairs.collect()}
    assert got == {("g", 1, 2): 1 / 3, ("g", 1, 3): 0.0, ("g", 2, 3): 0.0, ("h", 1, 2): 1 / 3}
    summary = {r["group_name"]: r for r in similarity.similarity_summary(pairs, groups).collect()}
    assert set(summary) == {"g", "h"}
    assert summary["g"]["n_pairs"] == 3 and summary["g"]["n_pages"] == 3 and summary["h"]["std_similarity"] is None
    questions = reports.research_questions(similarity.similarity_summary(pairs, groups), pairs).collect()
    assert [q["value"] for q in questions][:2] == [None, None] and questions[2]["value"] >= 0
    none = similarity.pairwise_similarity(groups.where("false"), shingled, signed)
    assert none.count() == 0 and similarity.similarity_summary(none, groups).count() == 0


def test_percentile_pairs_keep_repeated_pages(spark):
    groups = spark.createDataFrame([(1, "g", 0.05), (1, "h", 0.05), (2, "g", 0.5)], "page_id long, group_name string, percentile double")
    shingled = groups.selectExpr("page_id", "group_name", "array('s') AS shingles", "1L AS num_shingles")
    rows = similarity.percentile_similarity(groups, shingled).collect()
    assert [(r["bin_idx"], r["n_pages"], r["n_pairs"], r["mean_similarity"], r["std_similarity"]) for r in rows] == [(0, 2, 1, 1.0, 0.0)]


def test_cohorts(spark):
    rank = spark.range(1, 101).selectExpr("id AS page_id", "concat('t', id) AS title", "1.0D / id AS pagerank", "id AS rank", "1 - (id - 1) / 99 AS percentile", "0L AS in_degree", "0L AS out_degree")
    articles = spark.range(1, 101).where("id % 2 = 0").selectExpr("id AS page_id", "150L AS word_count")
    links = spark.createDataFrame([(i, 20 + i % 2) for i in range(1, 101)] + [(2, 20)], "cl_from long, cl_target_id long")
    targets = spark.createDataFrame([(20, 14, "Even"), (21, 14, "Odd"), (22, 0, "Even")], "lt_id long, lt_namespace long, lt_title string")
    out = cohorts.experiment_groups(rank, articles, 10, 4022, links, targets, {"category_even": "Even", "category_odd": "Odd"})
    by = {}
    for r in out.collect():
        by.setdefault(r["group_name"], []).append(r["page_id"])
    assert sorted(by["top_pagerank"]) == list(range(2, 21, 2)) and sorted(by["bottom_pagerank"]) == list(range(82, 101, 2))
    assert {g: len(x) for g, x in by.items()} == {"top_pagerank": 10, "bottom_pagerank": 10, "median_pagerank": len(by["median_pagerank"]), "random": 10, "category_even": 10}
    assert all(len(x) == len(set(x)) for x in by.values())
    again = cohorts.sample(rank.repartition(7), 10, 1).select("page_id").collect()
    assert sorted(again) == sorted(cohorts.sample(rank, 10, 1).select("page_id").collect())
    assert cohorts.sample(rank.where("false"), 10, 1).count() == 0


def test_figures(spark):
    df = spark.range(11).selectExpr("cast(id AS double) AS v", "'g' AS group_name")
    h = {r["bin"]: r["n"] for r in reports.histogram(df, "v", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert reports.histogram(df.where("v = 1"), "v").collect()[0]["n"] == 1
    b = reports.box(df.unionByName(spark.sql("SELECT 100.0D AS v, 'g' AS group_name")), "v").first()
    assert (b["median"], b["whisker_low"], b["whisker_high"]) == (5.5, 0.0, 10.0)


def test_pagerank_is_dealt_by_edges(spark, monkeypatch):
    """Partitions follow the number of edges, so a step's partial sums don't split into as many as the shuffle's default; a
    source's edges are one row."""
    monkeypatch.setattr(ranking, "PART_EDGES", 10)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        pages = spark.range(100).select(F.col("id").alias("page_id"))
        links = spark.range(400).select((F.col("id") % 80).alias("source_page_id"), ((F.col("id") * 7 + F.col("id") % 5) % 100).alias("target_page_id"))
        ranks = ranking.pagerank(pages, links, max_iterations=2).ranks
        assert ranks.rdd.getNumPartitions() == max(40, spark.sparkContext.defaultParallelism)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        assert ranks.count() == 100 and abs(ranks.agg(F.sum("pagerank")).first()[0] - 1) < 1e-9
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
