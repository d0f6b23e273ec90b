"""Wiki markup, words and shingles."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a link while it is rewritten. Such characters can't be in XML.
TARGET, NAME, LABEL, LINK_END = "\x01", "\x02", "\x03", "\x04"

# Markup patterns. Java syntax; (?d): only \n ends a line, (?U) and (?u): classes and case of Unicode.
COMMENT = r"(?s)<!--.*?-->"
FOOTNOTE = r"(?isu)<ref[^>/]*>.*?</ref>|<ref[^/]*/>"
WIKI_TABLE = r"(?s)\{\|.*?\|\}"
MEDIA_LINK = r"(?iu)\[\[(?:File|Image|Category):[^\]]*\]\]"
LINK = r"\[\[(?:((?!(?i:w|wikipedia):)[^\]|#:]*:[^\]|#]*)|([^\]|#]+))(?:#[^\]|]*)?(?:\|([^\]]+))?\]\]"
WEB_LINK = r"(?U)\[https?://[^\s\]\x1c-\x1f]+[\s\x1c-\x1f]*([^\]]*)\]"
HEADING = r"(?dU)={2,}[\s\x1c-\x1f]*(.*?)[\s\x1c-\x1f]*={2,}"
LIST_MARK = r"(?md)^[*#;:]+"
TAG = r"<[^>]+>"
ENTITY = r"(?iu)&(?:nbsp|amp|lt|gt|quot|apos);"
EMPHASIS = r"(?iU)'{2,}|__\w+__"
BLANKS = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[A-Za-z0-9]{2,}"

#: The cleaner's steps in their order: name, pattern and replacement, or name and the two ends of what goes.
STEPS: tuple[tuple[str, ...], ...] = (
    ("comments", COMMENT, " "), ("footnotes", FOOTNOTE, " "), ("tables", WIKI_TABLE, " "), ("templates", "{{", "}}"), ("nested_tables", "{|", "|}"), ("media_links", MEDIA_LINK, " "),
    # a link becomes a mark, its foreign or own target, and its label; then foreign ones go, and the label or the target stays
    ("links", LINK, f"{TARGET}$1{NAME}$2{LABEL}$3{LINK_END}"), ("foreign_links", rf"{TARGET}[^{NAME}]+{NAME}[^{LINK_END}]*{LINK_END}", " "),
    ("link_labels", rf"{TARGET}{NAME}[^{LABEL}]*{LABEL}([^{LINK_END}]+){LINK_END}", "$1"), ("link_targets", rf"{TARGET}{NAME}([^{LABEL}]*){LABEL}{LINK_END}", "$1"),
    ("web_links", WEB_LINK, "$1"), ("headings", HEADING, "$1"), ("list_marks", LIST_MARK, " "), ("tags", TAG, " "), ("entities", ENTITY, " "), ("emphasis", EMPHASIS, " "), ("blanks", BLANKS, " "),
)
BALANCED = ("templates", "nested_tables")

#: Pieces that a fold keeps apart before it puts them together.
PIECES = 64


def without_balanced(text: Column, start: str, end: str) -> Column:
    """Text outside of balanced pairs. A stray end stays; an unclosed start takes the rest with it.

    The tokens are folded with a depth counter. What stays is put together after each PIECES tokens, so that a step
    copies few references, and time is in proportion to the number of tokens for articles of any length.
    """
    a, b = re.escape(start), re.escape(end)
    chars = "".join(sorted(set(start + end)))
    inside = "".join("\\" + c for c in chars)
    tokens = F.regexp_extract_all(text, F.lit(rf"{a}|{b}|[^{inside}]++|[{inside}]"), F.lit(0))
    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(0).alias("depth"), none.alias("done"), none.alias("kept"))

    def step(state: Column, token: Column) -> Column:
        depth, done, kept = state["depth"], state["done"], state["kept"]
        opens, closes = token == start, (token == end) & (depth > 0)
        stays, many = ~opens & ~closes & (depth == 0), F.size(kept) >= PIECES
        return F.struct(
            F.when(opens, depth + 1).when(closes, depth - 1).otherwise(depth).alias("depth"),
            F.when(stays & many, F.array_append(done, F.array_join(kept, ""))).otherwise(done).alias("done"),
            F.when(stays & many, F.array(token)).when(stays, F.array_append(kept, token)).otherwise(kept).alias("kept"),
        )

    folded = F.aggregate(tokens, begin, step, lambda s: F.array_join(F.concat(s["done"], s["kept"]), ""))
    # most texts have no pair at all
    return F.when(F.contains(text, F.lit(start)), folded).otherwise(text)


def cleaning_step(text: Column, name: str) -> Column:
    """One of STEPS."""
    _, pattern, into = next(s for s in STEPS if s[0] == name)
    return without_balanced(text, pattern, into) if name in BALANCED else F.regexp_replace(text, pattern, into)


def clean_wikitext(text: Column) -> Column:
    """Plain text of wiki markup, with built-in functions only."""
    for name, *_ in STEPS:
        text = cleaning_step(text, name)
    return F.trim(text)


def outside(text: str, start: str, end: str) -> str:
    """``without_balanced`` of a Python string."""
    depth, kept = 0, []
    for token in re.split(f"({re.escape(start)}|{re.escape(end)})", text):
        if token == start:
            depth += 1
        elif token == end and depth:
            depth -= 1
        elif not depth:
            kept.append(token)
    return "".join(kept)


def _python_step(name: str, pattern: str, into: str) -> Callable[[str], str]:
    """A step on Python strings. Python's classes and case are those of Unicode, and only \\n ends a line, without flags."""
    if name in BALANCED:
        return lambda text: outside(text, pattern, into)
    compiled = re.compile(re.sub(r"^\(\?([a-zA-Z]+)\)", lambda m: f"(?{kept})" if (kept := re.sub("[dUu]", "", m[1])) else "", pattern))
    template = re.sub(r"\$(\d)", r"\\g<\1>", into)
    return lambda text: compiled.sub(template, text)


_PYTHON_STEPS = [_python_step(*s) for s in STEPS]


def clean_one(text: str) -> str:
    for step in _PYTHON_STEPS:
        text = step(text)
    return text.strip(" ")


def clean_wikitext_exact(text: Column) -> Column:
    """``clean_wikitext`` by a Pandas UDF, with Python's regular expressions."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else clean_one(x)), "string")(text)


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits of two or more, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def shingles(tokens: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` words, sorted; of fewer words, the distinct words."""

    def runs(words: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
        return F.array_sort(F.array_distinct(F.when(F.size(words) < size, words).otherwise(joined)))

    # bound to a variable, the words are made once and not for each run
    return F.get(F.transform(F.array(tokens), runs), F.lit(0))


def normal_title(title: Column) -> Column:
    return F.replace(title, F.lit(" "), F.lit("_"))


def json_list(values: Column) -> Column:
    """An array of strings as JSON text with a blank after each comma, other than ``to_json`` writes it."""
    item = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.concat(F.lit("["), F.array_join(F.transform(values, item), ", "), F.lit("]"))


def from_json_list(text: Column) -> Column:
    """The array of strings in JSON text."""
    return F.from_json(text, "array<string>")
