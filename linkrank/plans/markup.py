"""Queries of the markup cleaner: documents with markup before their text, cleaned by each step and by all; and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: What goes before a document's text, by doc_id modulo their number.
MARKUP = (
    "{{box|{{inner}}}} == Head ==\n* '''bold''' [[Target|label]] [[bare]] <ref>note</ref> {| cell |}\n",
    "a<!-- x\ny -->b <!-- open",
    'a<ref name="q">no\nte</ref>b<references />c<REF/>d',
    "{| t\n|- |}x{| a {| b |} c |}y",
    "a {{x|{{y}}|z}} b }} c { d } e {{{f}}} g\n",
    "[[File:a.png|thumb|x]] [[image:B]] z [[CATEGORY:c]]",
    "[[a|b]] [[a#s]] [[a#s|c d]] [[bare]] [[]] [[x|]] [[a|[[b]] c]]",
    "[[fr:mot]] [[W:x|y]] [[wikipedia:z]] [[:c:d|e]] [[w:fr:g]] [[fr:h|i#j]]",
    "[http://x.y/z label] [https://x] [ftp://q r] [http://a b c]",
    "== Head ==\ntext\n===Sub===\n=no=\n== open\nx ==",
    "* one\n#; two\n:three * four\n;\n",
    "a<br/>b &nbsp; c &AMP; d <b>e</b> &lt;f&gt; < g",
    "'''bold''' ''it'' don't __TOC__ __no toc__ x\t\ty  z",
    "{{open {{and}} never closed ",
)


def _literal(text: str) -> str:
    """An expression for ``text`` that Spark and DuckDB read alike."""
    out = text.replace("'", "', chr(39), '").replace("\n", "', chr(10), '").replace("\t", "', chr(9), '").replace("\\", "', chr(92), '")
    return f"concat('{out}', '')"


RAW = "concat(CASE doc_id % {n} {cases} END, coalesce(text, ''))".format(n=len(MARKUP), cases=" ".join(f"WHEN {i} THEN {_literal(m)}" for i, m in enumerate(MARKUP)))


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with markup before their texts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page_id"), F.expr(RAW).alias("raw_wikitext"))


def clean_wikitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_up(spark, sf_dir).select("page_id", T.clean_wikitext(F.col("raw_wikitext")).alias("clean_text"))


def clean_wikitext_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_up(spark, sf_dir).select("page_id", T.clean_wikitext_exact(F.col("raw_wikitext")).alias("clean_text"))


def strip_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_up(spark, sf_dir).select("page_id", T.without_balanced(F.col("raw_wikitext"), "{{", "}}").alias("stripped"))


LINK_STEPS = ("links", "foreign_links", "link_labels", "link_targets")
#: The cleaner's steps, those of links as one.
STEPS = tuple(dict.fromkeys("links" if name in LINK_STEPS else name for name, *_ in T.STEPS))


def _step(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = F.col("raw_wikitext")
        for step in LINK_STEPS if name == "links" else (name,):
            out = T.cleaning_step(out, step)
        return marked_up(spark, sf_dir).select("page_id", out.alias("cleaned"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"clean_{name}": _step(name) for name in STEPS} | {f.__name__: f for f in (clean_wikitext, clean_wikitext_exact, strip_balanced)}


def _replaced(x: str, pattern: str, into: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{quoted}', '{into}', 'g')"


def _balanced(x: str, start: str, end: str) -> str:
    """Text outside of balanced pairs: tokens are folded with the depth, and what stays is put together."""
    inside = "".join("\\" + c for c in sorted(set(start + end)))
    escape = lambda t: "".join("\\" + c for c in t)
    tokens = f"regexp_extract_all({x}, '{escape(start)}|{escape(end)}|[^{inside}]+|[{inside}]')"
    begin = "{'d': 0, 's': ''}"
    states = f"list_transform({tokens}, lambda t: {{'d': 0, 's': t}})"
    step = (f"lambda a, b: CASE WHEN b.s = '{start}' THEN {{'d': a.d + 1, 's': a.s}} WHEN b.s = '{end}' AND a.d > 0 THEN {{'d': a.d - 1, 's': a.s}} "
            f"WHEN a.d = 0 THEN {{'d': 0, 's': concat(a.s, b.s)}} ELSE a END")  # fmt: skip
    return f"list_reduce(list_prepend({begin}, {states}), {step}).s"


#: White space of Unicode, with the separators that count as such.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _links(x: str) -> str:
    """Links in one pass. Own prefixes' colons are hidden meanwhile, as these patterns know no look-ahead."""
    x = _replaced(x, r"\[\[([wW]|(?i:wikipedia)):", "[[\\1\x05")
    x = _replaced(x, r"\[\[(?:([^\]|#:\x05]*:[^\]|#]*)|([^\]|#]+))(?:#[^\]|]*)?(?:\|([^\]]+))?\]\]", "\x01\\1\x02\\2\x03\\3\x04")
    x = _replaced(_replaced(x, "\x01[^\x02]+\x02[^\x04]*\x04", " "), "\x01\x02[^\x03]*\x03([^\x04]+)\x04", "\\1")
    return f"replace({_replaced(x, '\x01\x02([^\x03]*)\x03\x04', '\\1')}, chr(5), ':')"


_SQL: dict[str, Callable[[str], str]] = {
    "comments": lambda x: _replaced(x, "(?s)<!--.*?-->", " "),
    "footnotes": lambda x: _replaced(x, "(?is)<ref[^>/]*>.*?</ref>|<ref[^/]*/>", " "),
    "tables": lambda x: _replaced(x, r"(?s)\{\|.*?\|\}", " "),
    "templates": lambda x: _balanced(x, "{{", "}}"),
    "nested_tables": lambda x: _balanced(x, "{|", "|}"),
    "media_links": lambda x: _replaced(x, r"(?i)\[\[(?:File|Image|Category):[^\]]*\]\]", " "),
    "links": _links,
    "web_links": lambda x: _replaced(x, rf"\[https?://[^{_SPACE}\]]+[{_SPACE}]*([^\]]*)\]", r"\1"),
    "headings": lambda x: _replaced(x, rf"={{2,}}[{_SPACE}]*(.*?)[{_SPACE}]*={{2,}}", r"\1"),
    "list_marks": lambda x: _replaced(x, "(?m)^[*#;:]+", " "),
    "tags": lambda x: _replaced(x, "<[^>]+>", " "),
    "entities": lambda x: _replaced(x, "(?i)&(?:nbsp|amp|lt|gt|quot|apos);", " "),
    "emphasis": lambda x: _replaced(x, r"'{2,}|__[\p{L}\p{M}\p{N}_]+__", " "),
    "blanks": lambda x: _replaced(x, f"[{_SPACE}]+", " "),
}


def oracle_sql() -> dict[str, str]:
    # each step is a query of its own, so that what it reads is written once
    wrap = lambda sql, step: f"SELECT page_id, {step('x')} AS x FROM ({sql})"
    raw = f"SELECT doc_id AS page_id, {RAW} AS x FROM documents"
    out = {f"clean_{name}": f"SELECT page_id, x AS cleaned FROM ({wrap(raw, step)})" for name, step in _SQL.items()}
    whole = raw
    for step in _SQL.values():
        whole = wrap(whole, step)
    out["clean_wikitext"] = out["clean_wikitext_exact"] = f"SELECT page_id, trim(x) AS clean_text FROM ({whole})"
    out["strip_balanced"] = f"SELECT page_id, x AS stripped FROM ({wrap(raw, _SQL['templates'])})"
    return out
