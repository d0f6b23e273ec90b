"""The registered queries: contracts of their results, and SQL where there is some."""

import os

import numpy as np
import pytest

import corpus_pipeline
from linkrank.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
P = pytest.importorskip("public_tokenizers")

CONTRACTS = {
    "op1": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7": "doc_id fingerprint component_id",
    "op8": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9": "doc_id held_out score predicted",
    "op10": "doc_id size text_crc32 law shard slot grown_shard",
}


def test_ten_queries():
    names = [q for q in queries.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_rows(spark, name):
    df = queries.queries()[name](spark, SF)
    want = CONTRACTS.get(name.split("_")[0], "").split()
    assert set(want) <= set(df.columns)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if "doc_id" in df.columns:
        assert df.count() == n == df.select("doc_id").distinct().count()


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        columns = sorted(df.columns)
        found = con.execute(sql)
        place = [[d[0] for d in found.description].index(c) for c in columns]
        assert sorted(tuple(map(repr, r)) for r in df.select(*columns).collect()) == sorted(tuple(repr(r[i]) for i in place) for r in found.fetchall()), name


def test_held_out_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = queries.op9_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in scored)
    assert right >= 0.95 * len(scored)


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, text, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "source_mixing", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "tokens" or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.count() == len(seen[name])
    assert seen["quality_rules"] >= seen["quality_classifier"] >= seen["near_dedup"] == seen["source_mixing"] == seen["tokens"]
    kept, gone = seen["near_dedup"], seen["quality_classifier"] - seen["near_dedup"]
    pairs = {(a, b) for a in kept for b in kept if a < b and jaccard(text[a], text[b]) >= 0.8}
    assert not pairs and gone
    assert all(any(jaccard(text[g], text[k]) >= 0.5 for k in kept) for g in gone)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    long_enough = {i for i in good if len(text[i].split()) >= 50}
    assert len(long_enough & seen["quality_classifier"]) >= 0.97 * len(long_enough)
    run = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in run.select("doc_id").collect()} == seen["tokens"]
    import tiktoken

    from linkrank.llm import bpe

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f), special_tokens={})
    assert all(r["ids"] == library.encode_ordinary(text[r["doc_id"]]) for r in docs.collect())


def test_sharded_sizes(spark):
    loads = [r["b"] for r in queries.op10_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(loads) == 8 and max(loads) < 1.05 * np.mean(loads)
