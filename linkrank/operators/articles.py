"""Articles: cleaned text with its length in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def articles_raw(pages: DataFrame, exact: bool = False) -> DataFrame:
    """page_id, title, raw_wikitext, clean_text, word_count of pages with wiki markup."""
    clean = T.clean_wikitext_exact(F.col("raw_wikitext")) if exact else T.clean_wikitext(F.col("raw_wikitext"))
    return pages.select("page_id", "title", "raw_wikitext", clean.alias("clean_text")).withColumn("word_count", T.word_count(F.col("clean_text")))


def articles_clean(pages: DataFrame, raw: DataFrame, min_words: int = 100) -> DataFrame:
    """page_id, title (that of the page table), clean_text, word_count, page_len of articles with enough words."""
    kept = raw.where((F.col("word_count") >= min_words) & F.col("clean_text").isNotNull() & (F.length("clean_text") > 0))
    return pages.join(kept.select("page_id", "clean_text", "word_count"), "page_id").select("page_id", "title", "clean_text", "word_count", "page_len")
