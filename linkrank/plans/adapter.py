"""Tables of a link graph made from the driver's tables: parts are pages, line items of an order link to the next.

The same SQL runs in Spark and in DuckDB. The extra predicates make redirects, other namespaces, and nodes without
links on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Table, what it reads, SQL.
TABLES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("f_page", ("part",), """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 20 = 7 THEN 1 ELSE 0 END AS page_namespace,
 concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR(20))) AS page_title,
 CASE WHEN p_partkey % 25 = 11 THEN 1 ELSE 0 END AS page_is_redirect, p_size * 25 AS page_len FROM {part}"""),
    ("f_linktarget", ("part",), """SELECT 10000000 + p_partkey AS lt_id, 0 AS lt_namespace,
 concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR(20))) AS lt_title FROM {part}
 UNION ALL SELECT DISTINCT 20000000 + CAST(replace(p_brand, 'Brand#', '') AS BIGINT), 14, p_brand FROM {part}"""),
    ("f_pagelinks", ("lineitem",), """SELECT l_partkey AS pl_from, CASE WHEN l_partkey % 20 = 7 THEN 1 ELSE 0 END AS pl_from_namespace, 10000000 + nxt AS pl_target_id
 FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM {lineitem}) x
 WHERE nxt IS NOT NULL AND l_partkey % 10 <> 3 AND nxt % 50 <> 3"""),
    ("f_categorylinks", ("part",), """SELECT p_partkey AS cl_from, 20000000 + CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS cl_target_id FROM {part}"""),
)

CATEGORIES = {f"category_{i}": f"Brand#{i}" for i in range(1, 7)}


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _, needs, sql = next(t for t in TABLES if t[0] == name)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needs})


def oracle_tables() -> list[tuple[str, str]]:
    return [(name, sql.format(**{t: t for t in needs})) for name, needs, sql in TABLES]
