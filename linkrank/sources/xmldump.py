"""Page dumps in XML, also bzip2 in many streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id BIGINT, title STRING, ns STRING, redirect STRING, revision ARRAY<STRUCT<text: STRING>>"


#: Articles that make a dump with malformed pages, or a table that is adopted, whole enough.
MIN_ARTICLES = 1_000_000


class TooFewPages(ValueError):
    pass


def read_pages(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """All page elements. A page that is cut off or malformed gives a row of nulls, or with ``strict`` an error."""
    reader = spark.read.format("xml").option("rowTag", "page").option("mode", "FAILFAST" if strict else "PERMISSIVE").option("ignoreSurroundingSpaces", "false")
    return reader.schema(SCHEMA).load(path)


def article_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """page_id, title and raw_wikitext of pages in namespace 0 that are no redirects and have text.

    Of several revisions the first counts. Titles have underscores for blanks. With a limit, the smallest ids stay.
    """
    text = F.get("revision", F.lit(0))["text"]
    keep = F.col("id").isNotNull() & (F.col("id") != 0) & (F.col("title") != "") & (F.col("ns") == "0") & F.col("redirect").isNull() & (text != "")
    out = pages.where(keep).select(F.col("id").alias("page_id"), F.replace("title", F.lit(" "), F.lit("_")).alias("title"), text.alias("raw_wikitext"))
    return out.orderBy("page_id").limit(limit) if limit else out


def malformed(pages: DataFrame, seen: Observation) -> DataFrame:
    """``pages``; ``seen`` gets the number of malformed ones on the way, as ``malformed``."""
    return pages.observe(seen, F.count_if(F.col("id").isNull() & F.col("title").isNull()).alias("malformed"))


def extraction_facts(rows: int, bad: int, min_articles: int) -> dict:
    """The status of an extraction: complete, with warnings if pages were malformed but enough articles came out; else an error."""
    if not bad:
        return {}
    if rows < min_articles:
        raise TooFewPages(f"{bad} malformed pages, and {rows} articles, under {min_articles}")
    return {"status": "complete_with_warnings", "malformed": bad}
