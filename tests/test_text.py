"""Markup, words, shingles and signatures, against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from linkrank.functions import sketches, text


def depth_counter(s, start, end):
    out, depth, i = [], 0, 0
    while i < len(s):
        if s[i : i + 2] == start:
            depth, i = depth + 1, i + 2
        elif depth and s[i : i + 2] == end:
            depth, i = depth - 1, i + 2
        else:
            if not depth:
                out.append(s[i])
            i += 1
    return "".join(out)


@pytest.mark.parametrize("start,end", [("{{", "}}"), ("{|", "|}")])
def test_balanced(spark, start, end):
    rng = random.Random(5)
    cases = ["", "a{{b}}c", "{{a{{b}}c", "a}}b", "{{{a}}}", "{|x|}", "{{|}}|}"] + ["".join(rng.choice("{}|a b") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    want = [depth_counter(c, start, end) for c in cases]
    assert [text.outside(c, start, end) for c in cases] == want
    df = spark.createDataFrame(list(enumerate(cases)), "i int, s string")
    got = df.select("i", text.without_balanced(F.col("s"), start, end)).orderBy("i").collect()
    assert [r[1] for r in got] == want


MARKUP = {
    "a<!-- x\ny -->b": "a b",
    'a<ref name="q">note</ref>b<references />c': "a b c",
    "a{| t |}b {{x|{{y}}}} c": "a b c",
    "[[File:a.png|thumb|x]] z": "z",
    "[[a|b]] [[a#s]] [[a#s|c]] [[bare]]": "b a c bare",
    "[[fr:mot]] [[W:x|y]] [[wikipedia:z]]": "y wikipedia:z",
    "[http://x.y/z label] [https://x]": "label",
    "== Head ==\ntext": "Head text",
    "==a b==": "a b",
    "* one\n#; two": "one two",
    "a<br/>b &nbsp; c &AMP; d": "a b c d",
    "'''bold''' __TOC__ x": "bold x",
    "a b\u001cc　d": "a b c d",
    "": "",
}


def test_markup(spark):
    df = spark.createDataFrame(list(MARKUP.items()), "s string, want string")
    for clean in (text.clean_wikitext, text.clean_wikitext_exact):
        for r in df.select("s", "want", clean(F.col("s")).alias("got")).collect():
            assert r["got"] == r["want"], (clean.__name__, r["s"])
    assert df.select(text.clean_wikitext_exact(F.lit(None).cast("string"))).first()[0] is None


def plain_shingles(s, k):
    w = [x.lower() for x in re.findall("[A-Za-z0-9]{2,}", s)]
    return set(w) if len(w) < k else {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_words_and_shingles(spark):
    cases = ["", "a b c", "One", "one two", "Two words2 THREE four", "café naïve x1", "aa bb cc aa bb cc dd"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    for k in (1, 3):
        out = df.select("s", text.word_count(F.col("s")).alias("n"), text.shingles(text.words(F.col("s")), k).alias("x")).collect()
        for r in out:
            assert r["n"] == len(re.findall("[A-Za-z0-9]{2,}", r["s"]))
            assert len(r["x"]) == len(set(r["x"])) and set(r["x"]) == plain_shingles(r["s"], k)
    assert df.select(text.normal_title(F.lit("a b c"))).first()[0] == "a_b_c"


def test_signatures(spark):
    sets = [[], ["x"], ["x", "y z"]]
    df = spark.createDataFrame([(s,) for s in sets], "s array<string>")
    md5 = lambda k, v: hashlib.md5(f"{k}:{v}".encode()).hexdigest()[:16]
    blake = lambda k, v: hashlib.blake2b(f"{k}:{v}".encode(), digest_size=8).hexdigest()
    for make, h in ((sketches.minhash, md5), (sketches.minhash_blake2, blake)):
        for r in df.select("s", make(F.col("s"), 8).alias("m")).collect():
            assert list(r["m"]) == [min((h(k, v) for v in r["s"]), default="f" * 16) for k in range(8)]


def test_similarity(spark):
    row = spark.sql("SELECT array('a','b') AS x, array('b','c') AS y, cast(array() AS array<string>) AS e")
    got = row.select(
        sketches.jaccard_of_sets(F.col("x"), F.col("y")), sketches.jaccard_of_sets(F.col("e"), F.col("e")), sketches.jaccard_of_sets(F.col("e"), F.col("e"), 0.0),
        sketches.minhash_jaccard(F.col("x"), F.col("y")), sketches.minhash_jaccard(F.col("x"), F.col("x")), sketches.minhash_jaccard(F.col("x"), F.col("e"))).first()
    assert list(got) == [1 / 3, 1.0, 0.0, 0.0, 1.0, 0.0]


def test_json_lists(spark):
    import json

    for values in ([], ["a", 'q"uote', "back\\slash", "é\n"]):
        row = spark.createDataFrame([(values,)], "v array<string>").select(text.json_list(F.col("v")).alias("j"))
        assert row.first()["j"] == json.dumps(values, ensure_ascii=False)
        assert row.select(text.from_json_list(F.col("j"))).first()[0] == values
