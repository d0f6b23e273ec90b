"""The whole staged run over tiny dumps, and the queries against their SQL."""

import bz2
import gzip
import os

import pytest

from linkrank.config import Layout, Params
from linkrank.plans import cli, pipeline
from linkrank.sources import files, xmldump


def dump(path, table, columns, rows):
    body = f"CREATE TABLE `{table}` (\n" + "".join(f"  `{c}` x,\n" for c in columns) + ") x;\n"
    values = ",".join("(" + ",".join(repr(v) for v in r) + ")" for r in rows)
    path.write_bytes(gzip.compress(f"{body}INSERT INTO `{table}` VALUES {values};\n".encode()))


@pytest.fixture()
def layout(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    n = 12
    dump(raw / "page.sql.gz", "page", ["page_id", "page_namespace", "page_title", "page_is_redirect", "page_len"], [(i, 0, f"T_{i}", 0, 500) for i in range(1, n)])
    dump(raw / "linktarget.sql.gz", "linktarget", ["lt_id", "lt_namespace", "lt_title"], [(100 + i, 0, f"T_{i}") for i in range(1, n)] + [(200, 14, "Physics")])
    dump(raw / "pagelinks.sql.gz", "pagelinks", ["pl_from", "pl_from_namespace", "pl_target_id"], [(i, 0, 100 + j) for i in range(1, n) for j in range(1, n) if (i * j) % 3 == 1])
    dump(raw / "categorylinks.sql.gz", "categorylinks", ["cl_from", "cl_target_id"], [(i, 200) for i in range(1, 6)])
    page = lambda i: f"<page><title>T {i}</title><ns>0</ns><id>{i}</id><revision><text>{' '.join(f'word{k % (5 + i)} more{k}' for k in range(80))}</text></revision></page>"
    (raw / "pages-articles.xml.bz2").write_bytes(bz2.compress(("<mediawiki>" + "".join(map(page, range(1, n))) + "</mediawiki>").encode()))
    return Layout(str(raw), str(tmp_path / "processed"), str(tmp_path / "results"))


def test_run(spark, layout):
    run = pipeline.Run(spark, layout, Params(group_size=4, permutations=8))
    with pytest.raises(files.Incomplete):
        run.pages()
    took = run.run()
    assert list(took) == list(run.STAGES)
    ranking = run.table("pagerank")
    assert ranking.count() == 11 and ranking.agg({"pagerank": "sum"}).first()[0] == pytest.approx(1.0)
    summary = {r["group_name"]: r for r in run.table("similarity_summary").collect()}
    assert summary["top_pagerank"]["n_pairs"] == 6 and "category_physics" in summary
    for name in ("graph_stats.json", "degree_summary.csv", "top_100_pagerank.csv", "pagerank_run_stats.json", "similarity_summary.csv", "research_question_results.csv", "pagerank_percentile_similarity.csv", "figures/pagerank_histogram.csv"):
        assert os.path.exists(layout.result(name)), name
    before = os.path.getmtime(layout.table("edges"))
    run.edges()
    assert os.path.getmtime(layout.table("edges")) == before  # complete, so not built again


def test_limited_extraction_is_not_final(spark, layout):
    pipeline.Run(spark, layout, limit=3).extract()
    assert files.read_json(spark, files.marker(layout.table("articles_raw")))["limited"]
    pipeline.Run(spark, layout).extract()
    assert spark.read.parquet(layout.table("articles_raw")).count() == 11


def test_cli_arguments():
    args = cli.parser().parse_args(["run", "--raw", "r", "--processed", "p", "--results", "s", "--stage", "pages", "--group-size", "7"])
    assert args.stage == ["pages"] and args.group_size == 7
    args = cli.parser().parse_args(["ingest", "--raw", "r", "--processed", "p", "--results", "s", "--table", "page"])
    assert args.table == "page"


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_sql(spark):
    import duckdb

    from linkrank.plans import oracles, queries

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    made, wanted = queries.queries(), oracles.oracle_sql()
    assert set(wanted) <= set(made) and set(made) - set(wanted) == {"minhash_blake2_16"}
    for name, sql in wanted.items():
        df = made[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
        found = con.execute(sql)
        place = [[d[0] for d in found.description].index(c) for c in columns]
        assert got == sorted(tuple(repr(r[i]) for i in place) for r in found.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["page_id", "title", "pagerank", "rank", "percentile", "in_degree", "out_degree"]
    assert [r["rank"] for r in out.orderBy("rank").collect()] == list(range(1, 101))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rejected_extraction_is_not_complete(spark, layout):
    with open(f"{layout.raw}/pages-articles.xml.bz2", "rb") as f:
        whole = bz2.decompress(f.read())
    bad = b"<page><title>x</title><ns>0</ns><id>no number</id><revision><text>t</text></revision></page>"
    with open(f"{layout.raw}/pages-articles.xml.bz2", "wb") as f:
        f.write(bz2.compress(whole.replace(b"</mediawiki>", b"<page><id>7</id><title>broken</ti></page>" + bad + b"</mediawiki>")))
    run = pipeline.Run(spark, layout)
    found = run.spark.read.format("xml").option("rowTag", "page").schema("id BIGINT, title STRING").load(f"{layout.raw}/pages-articles.xml.bz2")
    if not found.where("id IS NULL AND title IS NULL").count():
        pytest.skip("the parser mends these pages")
    with pytest.raises(xmldump.TooFewPages):
        run.extract()
    assert not files.is_complete(spark, layout.table("articles_raw"))
    with pytest.raises(files.Incomplete):
        run.table("articles_raw")
    pipeline.Run(spark, layout, min_articles=5).extract()
    assert files.read_json(spark, files.marker(layout.table("articles_raw")))["status"] == "complete_with_warnings"
    os.remove(f"{layout.raw}/pages-articles.xml.bz2")
    run.extract()  # a finished extraction doesn't read the dump again


def test_resumed_ingestion(spark, layout):
    with open(f"{layout.raw}/page.sql.gz", "rb") as f:
        whole = f.read()
    for name in ("linktarget", "pagelinks", "categorylinks"):
        os.rename(f"{layout.raw}/{name}.sql.gz", f"{layout.raw}/{name}.1.sql.gz")
    os.rename(f"{layout.raw}/page.sql.gz", f"{layout.raw}/page.1.sql.gz")
    run = pipeline.Run(spark, layout, resume=True)
    run.ingest()
    assert run.table("page").count() == 11
    with open(f"{layout.raw}/page.2.sql.gz", "wb") as f:
        f.write(gzip.compress(gzip.decompress(whole).replace(b"'T_", b"'U_")))
    run.ingest()
    assert run.table("page").count() == 22 and run.table("pagelinks").count() > 0
    assert files.read_json(spark, files.marker(layout.table("page")))["rows"] == 22


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_cleaners_agree(spark):
    from linkrank.plans import markup

    a, b = markup.clean_wikitext(spark, SF), markup.clean_wikitext_exact(spark, SF)
    assert a.exceptAll(b).count() == 0 and b.count() == a.count()


def test_quantiles(spark):
    import statistics

    from linkrank.operators.graph import describe, quantiles

    for values in ([5], [1, 2], [3, 1, 2, 2, 9, 9, 9, -4], list(range(1000))):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
        got = quantiles(df, "v", (0.0, 0.25, 0.5, 0.75, 1.0))
        want = statistics.quantiles(values, n=4, method="inclusive") if len(values) > 1 else [5.0] * 3
        assert got == pytest.approx([min(values), *want, max(values)])
    assert quantiles(spark.createDataFrame([], "v long"), "v", (0.5,)) == [None]
    assert [r["v"] for r in describe(df, "v").collect()][4:7] == pytest.approx(want)
