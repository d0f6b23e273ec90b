"""MySQL dumps: gzip text with CREATE TABLE and multi-row INSERT lines.

All parsing is JVM-side regular expressions over a line scan. A gzip file is one task, so lines are dealt out before
they are parsed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row of an INSERT, and one field within its parentheses. Possessive, so that long lines need no backtracking.
ROW = r"\((?:[^'()]++|'(?:[^'\\]++|\\.)*+')*+\)"
FIELD = r"(?:^|,)((?:[^',]++|'(?:[^'\\]++|\\.)*+')*+)"

# Escapes and what they stand for, in the order in which they are replaced.
ESCAPES = (("\\'", "'"), ('\\"', '"'), ("\\\\", "\\"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\0"))


#: Lines of a dump's head that are read for its schema, and characters of each.
HEAD_LINES, HEAD_CHARS = 1000, 256


@dataclass(frozen=True)
class Dump:
    """A table of a dump: its file's ending and the columns to keep."""

    table: str
    schema: T.StructType
    optional: bool = False

    @property
    def file(self) -> str:
        return f"{self.table}.sql.gz"


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


DUMPS = {
    d.table: d
    for d in (
        Dump("page", T.StructType([*_longs("page_id", "page_namespace"), T.StructField("page_title", T.StringType()), *_longs("page_is_redirect", "page_len")])),
        Dump("linktarget", T.StructType([*_longs("lt_id", "lt_namespace"), T.StructField("lt_title", T.StringType())])),
        Dump("pagelinks", T.StructType(_longs("pl_from", "pl_from_namespace", "pl_target_id"))),
        Dump("categorylinks", T.StructType(_longs("cl_from", "cl_target_id")), optional=True),
    )
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a dump; rows with a carriage return inside stay whole, invalid UTF-8 becomes U+FFFD."""
    return spark.read.option("lineSep", "\n").text(path).select(F.make_valid_utf8("value").alias("value"))


def create_columns(text: DataFrame, table: str) -> list[str]:
    """Column names in the order of the dump's CREATE TABLE, wherever in the dump that is.

    Only beginnings of lines reach the driver: of the first HEAD_LINES, in which the statement mostly is, or else of all
    lines that may belong to such a statement, which INSERT lines never do.
    """
    begins = text.select(F.substring(F.ltrim("value"), 1, HEAD_CHARS).alias("value"))
    schema_line = F.col("value").startswith("CREATE TABLE ") | F.col("value").startswith("`") | F.col("value").startswith(")")
    # taken and not limited, the first lines are read from one file after another, not from each
    for some in (begins.take(HEAD_LINES), begins.where(schema_line).toLocalIterator()):
        names, inside = [], False
        for row in some:
            line = row["value"]
            if line.startswith(f"CREATE TABLE `{table}`"):
                inside = True
            elif inside and line.startswith(")"):
                return names
            elif inside and line.startswith("`") and "`" in line[1:]:
                names.append(line[1:].split("`", 1)[0])
    raise ValueError(f"no CREATE TABLE `{table}` in the dump")


def insert_payloads(text: DataFrame, table: str) -> DataFrame:
    """What follows VALUES on each INSERT line of the table, without the closing semicolon."""
    prefix = f"INSERT INTO `{table}` VALUES "
    return text.where(F.col("value").startswith(prefix)).select(F.regexp_replace(F.substring(F.col("value"), F.lit(len(prefix) + 1), F.length("value")), r";\s*$", "").alias("payload"))


def unescaped(quoted: Column, strict: bool = False) -> Column:
    """The string of a quoted field. By default escapes are replaced one kind after another, so that an escaped
    backslash before an n reads as a newline; ``strict`` reads them in one pass."""
    out = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    if not strict:
        for escape, char in ESCAPES:
            out = F.replace(out, F.lit(escape), F.lit(char))
        return out
    # pairs of backslashes part the text; within the parts a backslash begins an escape
    def single(part: Column) -> Column:
        for escape, char in ESCAPES:
            if escape != "\\\\":
                part = F.replace(part, F.lit(escape), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(out, r"\\\\", -1), single), "\\")


def coerced(raw: Column, kind: T.DataType, strict: bool = False) -> Column:
    """A field's value under its declared type: NULL in any case is null, what doesn't fit the type too."""
    trimmed = F.trim(raw)
    text = F.when(trimmed.startswith("'") & trimmed.endswith("'") & (F.length(trimmed) >= 2), unescaped(trimmed, strict)).otherwise(trimmed)
    value = text if isinstance(kind, T.StringType) else text.try_cast(kind)
    return F.when(F.upper(trimmed) == "NULL", None).otherwise(value)


def tuples(payloads: DataFrame) -> DataFrame:
    """``fields``: the raw fields of each row."""
    rows = payloads.select(F.explode(F.regexp_extract_all("payload", F.lit(ROW), F.lit(0))).alias("row"))
    inner = F.substring(F.col("row"), F.lit(2), F.length("row") - 2)
    return rows.select(F.regexp_extract_all(inner, F.lit(FIELD), F.lit(1)).alias("fields"))


def selected(rows: DataFrame, columns: list[str], schema: T.StructType, strict: bool = False) -> DataFrame:
    """The columns of ``schema`` by name; a field missing at a row's end is null."""
    absent = [f.name for f in schema if f.name not in columns]
    if absent:
        raise ValueError(f"the dump has no column {', '.join(absent)}")
    return rows.select(*(coerced(F.get("fields", F.lit(columns.index(f.name))), f.dataType, strict).alias(f.name) for f in schema))


def read_dump(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None, strict: bool = False, parts: int | None = None) -> DataFrame:
    """A dump's table with the columns of ``schema``."""
    text = lines(spark, path)
    columns = create_columns(text, table)
    payloads = insert_payloads(text, table)
    # without a number, lines are dealt out by their size, not to as many tasks as there are cores
    payloads = payloads.repartition(parts) if parts else payloads.repartition(F.xxhash64("payload"))
    return selected(tuples(payloads), columns, schema or DUMPS[table].schema, strict)
