"""Queries through the readers and writers: the driver's tables are written as dumps, pages, tables and documents, and read back.

What is written goes to a folder of its own in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Layout
from ..functions import text as T
from ..session import scratch
from ..sources import files, sqldump, xmldump
from ..streaming import ingest
from . import pipeline
from .adapter import adapted

#: Rows of an INSERT line, lines of a dump's file, and pages of an XML file.
LINE_ROWS, FILE_LINES, FILE_PAGES = 100, 2000, 2000

COLUMNS = {
    "page": ("page_id", "page_namespace", "page_title", "page_is_redirect", "page_len"),
    "linktarget": ("lt_id", "lt_namespace", "lt_title"),
    "pagelinks": ("pl_from", "pl_from_namespace", "pl_target_id"),
    "categorylinks": ("cl_from", "cl_target_id"),
}


def quoted(text: Column) -> Column:
    """A dump's string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, escape in (("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    return F.concat(F.lit("'"), out, F.lit("'"))


def write_dump(rows: DataFrame, table: str, path: str, ignored: str = "x_extra") -> None:
    """A gzip dump of ``rows``: another table's statements, CREATE TABLE with a column more, and INSERT lines.

    It is a folder of files of about FILE_LINES lines, each with the statements at its head, so no task writes or reads it all.
    """
    value = lambda c, kind: F.coalesce(quoted(F.col(c)) if kind == "string" else F.col(c).cast("string"), F.lit("NULL"))
    fields = [value(c, kind) for c, kind in rows.dtypes]
    one = F.concat(F.lit("("), F.concat_ws(",", fields[0], F.lit("0.5"), *fields[1:]), F.lit(")"))
    count = max(1, rows.count() // LINE_ROWS)
    parts = math.ceil(count / FILE_LINES)
    # lines by the whole row, as thousands of rows may have one first column
    line = F.pmod(F.xxhash64(*rows.columns), F.lit(count))
    inserts = rows.groupBy(line.alias("line")).agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("v"))
    inserts = inserts.select((F.col("line") % parts).cast("int").alias("part"), (F.lit(100) + F.col("line")).alias("o"), F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), "v", F.lit(";")).alias("value"))
    names = [rows.columns[0], ignored, *rows.columns[1:]]
    head = ["-- dump", "CREATE TABLE `before` (", "  `x` int", ");", "INSERT INTO `before` VALUES (1);", f"CREATE TABLE `{table}` (", *(f"  `{c}` int," for c in names), "  PRIMARY KEY (`x`)", ") ENGINE=x;"]
    spark = rows.sparkSession
    first = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.posexplode(F.array(*map(F.lit, head))).alias("at", "value")).select("part", F.col("at").cast("long").alias("o"), "value")
    first.unionByName(inserts).repartitionById(parts, F.col("part")).sortWithinPartitions("o").select("value").write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _odd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose titles hold quotes, commas, brackets, line feeds and tabs; some lengths are null."""
    title = F.concat("page_title", F.when(F.col("page_id") % 3 == 0, F.lit("_'s_(a),(b)\n\t\"q\"")).otherwise(F.lit("")))
    rows = adapted(spark, sf_dir, "f_page").withColumn("page_title", title).withColumn("page_len", F.when(F.col("page_id") % 7 != 0, F.col("page_len")))
    return rows.select(*COLUMNS["page"])


def _dumped(spark: SparkSession, rows: DataFrame, table: str, folder: str | None = None) -> str:
    path = f"{folder or scratch(spark)}/{sqldump.DUMPS[table].file}"
    write_dump(rows, table, path)
    return path


def dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqldump.read_dump(spark, _dumped(spark, _odd_pages(spark, sf_dir), "page"), "page")


def dump_strict_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backslashes before letters, which only the strict reading of escapes keeps."""
    rows = _odd_pages(spark, sf_dir).withColumn("page_title", F.concat("page_title", F.lit("\\n\\t\\'")))
    return sqldump.read_dump(spark, _dumped(spark, rows, "page"), "page", strict=True).select("page_id", "page_title")


def dump_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _dumped(spark, _odd_pages(spark, sf_dir).limit(10), "page")
    names = sqldump.create_columns(sqldump.lines(spark, path), "page")
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


def dump_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump in three files, ingested in two runs, and a third that finds nothing new."""
    folder = scratch(spark)
    rows = adapted(spark, sf_dir, "f_categorylinks")
    for i in range(3):
        write_dump(rows.where(F.col("cl_from") % 3 == i), "categorylinks", f"{folder}/in/categorylinks.{i}.sql.gz")
        if i:
            columns = sqldump.create_columns(sqldump.lines(spark, f"{folder}/in/categorylinks.0.sql.gz"), "categorylinks")
            ingest.ingest_new(spark, f"{folder}/in/*", "categorylinks", columns, f"{folder}/out", f"{folder}/done")
    if ingest.ingest_new(spark, f"{folder}/in/*", "categorylinks", columns, f"{folder}/out", f"{folder}/done"):
        raise ValueError("a file was ingested twice")
    return spark.read.parquet(f"{folder}/out")


def write_pages(docs: DataFrame, path: str) -> None:
    """Documents as a bzip2 dump of page elements, some of them redirects, some in another namespace.

    It is a folder of files of about FILE_PAGES pages, each a document, as the XML reader gives a file to one task.
    """
    escaped = F.col("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    odd = lambda n, at: F.col("doc_id") % n == at
    page = F.concat(
        F.lit("<page><title>Doc "), F.col("doc_id").cast("string"), F.lit("</title><ns>"), F.when(odd(7, 3), "1").otherwise("0"), F.lit("</ns><id>"), F.col("doc_id").cast("string"), F.lit("</id>"),
        F.when(odd(11, 5), '<redirect title="x"/>').otherwise(""), F.lit("<revision><id>1</id><text bytes='1'>"), escaped, F.lit("</text></revision><revision><text>later</text></revision></page>"))
    parts = math.ceil(max(1, docs.count()) / FILE_PAGES)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    pages = docs.where(F.col("text").isNotNull()).select(part.alias("part"), F.lit(1).alias("o"), page.alias("value"))
    ends = F.inline(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(tag).alias("value")) for o, tag in ((0, "<mediawiki>"), (2, "</mediawiki>")))))
    ends = docs.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), ends)
    pages.unionByName(ends).repartitionById(parts, F.col("part")).sortWithinPartitions("o").select("value").write.option("compression", "bzip2").text(path)


def xml_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return xmldump.article_pages(xmldump.read_pages(spark, path)).select("page_id", "title", F.md5("raw_wikitext").alias("text_md5"))


def xml_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return xmldump.article_pages(xmldump.read_pages(spark, path), limit=50).select("page_id", "title")


def table_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a bound on rows of a file, read where its marker says that it is complete."""
    path = scratch(spark)
    files.write_table(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey"), path, "zstd", rows_per_file=100)
    return spark.read.parquet(files.require_complete(spark, files.table_path(spark, path)))


def table_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table by its manifest and by its marker, and whether every file keeps to its bound."""
    path = scratch(spark)
    files.write_table(spark.read.parquet(f"{sf_dir}/customer.parquet"), path, rows_per_file=100)
    marked = files.read_json(spark, files.marker(path))
    return files.manifest(spark, path).agg(F.sum("rows").alias("n_rows"), F.lit(marked["rows"]).cast("long").alias("marked"), (F.max("rows") <= 100).alias("bounded"), F.lit(marked["status"]).alias("status"))


def table_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that another program wrote: refused while it has too few rows, then marked."""
    path = scratch(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{path}.parts")
    found = files.table_path(spark, path)
    try:
        files.adopt(spark, found, min_rows=1000)
        refused = False
    except files.Empty:
        refused = True
    rows = files.adopt(spark, found)
    return spark.createDataFrame([(refused, files.is_complete(spark, found), rows)], "refused boolean, complete boolean, n_rows long")


def table_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage is built once, again when forced, and again after a limited run."""
    path, built = scratch(spark), []

    def build() -> DataFrame:
        built.append(1)
        return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")

    counts = []
    for options in ({"limited": True}, {}, {}, {"force": True}):
        files.stage(spark, path, build, **options)
        counts.append(len(built))
    return files.stage(spark, path, build).agg(F.count(F.lit(1)).alias("n_rows"), *(F.lit(n).alias(f"built_{i}") for i, n in enumerate(counts)))


def csv_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_csv(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal"), path, "s_suppkey")
    return files.read_csv(spark, path, "s_suppkey LONG, s_name STRING, s_acctbal DOUBLE")


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/d.json"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    files.write_document(orders.agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("greatest"), F.min("o_orderstatus").alias("status")), path)
    read = files.read_json(spark, path)
    return spark.createDataFrame([(read["n_orders"], read["greatest"], read["status"])], "n_orders long, greatest long, status string")


def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of documents as JSON text, and how many come back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = T.json_list(F.slice(T.words(F.coalesce("text", F.lit(""))), 1, 20))
    return docs.select("doc_id", made.alias("json")).withColumn("n", F.size(T.from_json_list(F.col("json"))))


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are as their manifest says, that are not, and that it doesn't name."""
    folder = scratch(spark)
    for name in ("a", "b", "c"):
        files.write_json(spark, f"{folder}/files/{name}.json", {"name": name})
    right = hashlib.sha1(b'{\n  "name": "a"\n}\n').hexdigest()
    spark.createDataFrame([(f"{right.upper()}  a.json",), (f"{right} *b.json",)], "value string").write.text(f"{folder}/sums")
    return files.verified(spark, f"{folder}/files/*.json", files.read_manifest(spark, f"{folder}/sums"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.normal_title(F.col("p_name")).alias("title"))


def _run(spark: SparkSession, sf_dir: str, *stages: str) -> pipeline.Run:
    """Stages of a run over dumps of the adapted tables."""
    folder = scratch(spark)
    layout = Layout(f"{folder}/raw", f"{folder}/tables", f"{folder}/results")
    for table, columns in COLUMNS.items():
        _dumped(spark, adapted(spark, sf_dir, f"f_{table}").select(*columns), table, layout.raw)
    write_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{layout.raw}/{pipeline.PAGES_XML}")
    made = pipeline.Run(spark, layout)
    made.run(*stages)
    return made


def run_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a staged run over dumps."""
    return _run(spark, sf_dir, "ingest", "pages", "edges").table("edges")


def run_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that a staged run over dumps writes as a document."""
    made = _run(spark, sf_dir, "ingest", "pages", "edges", "graph_stats")
    read = files.read_json(spark, made.layout.result("graph_stats.json"))
    return spark.createDataFrame([(read["number_of_nodes"], read["number_of_edges"], read["dangling_nodes"], read["max_in_degree"])], "number_of_nodes long, number_of_edges long, dangling_nodes long, max_in_degree long")


def run_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a staged run whose pages have no markup in their texts: ids and titles."""
    made = _run(spark, sf_dir, "ingest", "pages", "extract", "articles")
    return made.table("articles_raw").select("page_id", "title")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (dump_pages, dump_strict_escapes, dump_columns, dump_files, xml_articles, xml_limited, table_written, table_manifest, table_adopted, table_stages, csv_written, json_document, json_lists, checksums, titles, run_edges, run_degrees, run_articles)
}

_PAGE = "page_id, page_namespace, concat(page_title, CASE WHEN page_id % 3 = 0 THEN concat('_''s_(a),(b)', chr(10), chr(9), '\"q\"') ELSE '' END{more}) AS page_title, page_is_redirect, CASE WHEN page_id % 7 <> 0 THEN page_len END AS page_len"
_ARTICLE = "text IS NOT NULL AND text <> '' AND doc_id <> 0 AND doc_id % 7 <> 3 AND doc_id % 11 <> 5"
_TITLED = "doc_id AS page_id, concat('Doc_', CAST(doc_id AS VARCHAR)) AS title"
_LONGS = "CAST(page_id AS BIGINT) AS page_id, CAST(page_namespace AS BIGINT) AS page_namespace, page_title, CAST(page_is_redirect AS BIGINT) AS page_is_redirect, CAST(page_len AS BIGINT) AS page_len"

#: DuckDB SQL, and the adapted tables that it needs.
ORACLES: dict[str, tuple[str, ...]] = {
    "dump_pages": (f"SELECT {_LONGS} FROM (SELECT {_PAGE.format(more='')} FROM f_page)", "f_page"),
    "dump_strict_escapes": (f"SELECT page_id, page_title FROM (SELECT {_LONGS} FROM (SELECT {_PAGE.format(more=chr(44) + chr(39) + chr(92) + 'n' + chr(92) + 't' + chr(92) + chr(39) * 3)} FROM f_page))", "f_page"),
    "dump_columns": ("SELECT * FROM (VALUES (0, 'page_id'), (1, 'x_extra'), (2, 'page_namespace'), (3, 'page_title'), (4, 'page_is_redirect'), (5, 'page_len')) AS t(place, name)",),
    "dump_files": ("SELECT CAST(cl_from AS BIGINT) AS cl_from, CAST(cl_target_id AS BIGINT) AS cl_target_id FROM f_categorylinks", "f_categorylinks"),
    "xml_articles": (f"SELECT {_TITLED}, md5(text) AS text_md5 FROM documents WHERE {_ARTICLE}",),
    "xml_limited": (f"SELECT {_TITLED} FROM documents WHERE {_ARTICLE} ORDER BY doc_id LIMIT 50",),
    "table_written": ("SELECT c_custkey, c_name, c_nationkey FROM customer",),
    "table_manifest": ("SELECT count(*) AS n_rows, count(*) AS marked, true AS bounded, 'complete' AS status FROM customer",),
    "table_adopted": ("SELECT true AS refused, true AS complete, count(*) AS n_rows FROM nation",),
    "table_stages": ("SELECT count(*) AS n_rows, 1 AS built_0, 2 AS built_1, 2 AS built_2, 3 AS built_3 FROM nation",),
    "csv_written": ("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal FROM supplier",),
    "json_document": ("SELECT count(*) AS n_orders, CAST(max(o_orderkey) AS BIGINT) AS greatest, min(o_orderstatus) AS status FROM orders",),
    "json_lists": ("""SELECT doc_id, concat('[', array_to_string(list_transform(words, lambda x: concat('"', x, '"')), ', '), ']') AS json, CAST(len(words) AS INTEGER) AS n FROM (SELECT doc_id, list_slice(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]{2,}'), lambda x: lower(x)), 1, 20) AS words FROM documents)""",),
    "checksums": ("SELECT * FROM (VALUES ('a.json', 'OK'), ('b.json', 'BAD'), ('c.json', 'NO ENTRY')) AS t(file, status)",),
    "titles": ("SELECT p_partkey, replace(p_name, ' ', '_') AS title FROM part",),
    "run_edges": ("SELECT CAST(s AS BIGINT) AS source_page_id, CAST(d AS BIGINT) AS target_page_id FROM e", "e"),
    "run_degrees": ("SELECT count(*) AS number_of_nodes, (SELECT count(*) FROM e) AS number_of_edges, count(*) FILTER (WHERE out_degree = 0) AS dangling_nodes, max(in_degree) AS max_in_degree FROM dg", "dg", "e"),
    "run_articles": (f"SELECT {_TITLED} FROM documents WHERE {_ARTICLE}",),
}
