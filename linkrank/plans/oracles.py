"""DuckDB equivalents of the reference queries, on the driver's tables."""

from __future__ import annotations

from ..operators.reports import QUESTIONS
from ..operators.similarity import BINS, EDGES
from . import markup, roundtrips
from .adapter import CATEGORIES, oracle_tables
from .queries import DIGITS, GROUP_SIZE, ITERATIONS, PERMUTATIONS, SEED

_WORDS = "list_transform(regexp_extract_all(d.text, '[A-Za-z0-9]{2,}'), lambda x: lower(x))"
_COLUMNS = "page_id, title, group_name, pagerank, rank, percentile, word_count"
_ORDER = f"md5(concat('{SEED}', ':', CAST(page_id AS VARCHAR))), page_id"
_BIN = "CASE " + " ".join(f"WHEN percentile <= {EDGES[i]!r} THEN {i - 1}" for i in range(1, 10)) + " ELSE 9 END"
_BIN_NAME = "CASE bin_idx " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BINS)) + " END"

#: Tables that build on one another; a query takes those it needs.
_STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    **{name: ((), sql) for name, sql in oracle_tables()},
    "pc": (("f_page",), "SELECT page_id, page_title AS title, page_len FROM f_page WHERE page_namespace = 0 AND page_is_redirect = 0 AND page_len > 100"),
    "e": (("f_pagelinks", "f_linktarget", "pc"), """SELECT DISTINCT a.page_id AS s, b.page_id AS d FROM f_pagelinks l JOIN pc a ON l.pl_from = a.page_id
 JOIN f_linktarget t ON l.pl_target_id = t.lt_id JOIN pc b ON t.lt_title = b.title WHERE l.pl_from_namespace = 0 AND t.lt_namespace = 0 AND a.page_id <> b.page_id"""),
    "dg": (("pc", "e"), """SELECT pc.page_id, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree FROM pc
 LEFT JOIN (SELECT d, count(*) n FROM e GROUP BY d) i ON i.d = pc.page_id LEFT JOIN (SELECT s, count(*) n FROM e GROUP BY s) o ON o.s = pc.page_id"""),
    "od": (("e",), "SELECT s, count(*) AS od FROM e GROUP BY 1"),
    "nn": (("pc",), "SELECT CAST(count(*) AS DOUBLE) AS n FROM pc"),
    "pr(it, page_id, r)": (("pc", "e", "od", "nn"), f"""SELECT 0, page_id, CAST(1.0 AS DOUBLE) / (SELECT n FROM nn) FROM pc UNION ALL
 SELECT p.it + 1, p.page_id, 0.15 / (SELECT n FROM nn) + 0.85 * coalesce(p.c, 0) + 0.85 * p.dm / (SELECT n FROM nn)
 FROM (SELECT a.it, a.page_id, (SELECT sum(b.r / o.od) FROM e JOIN pr b ON b.page_id = e.s JOIN od o ON o.s = e.s WHERE e.d = a.page_id) c,
 coalesce((SELECT sum(b.r) FROM pr b WHERE b.page_id NOT IN (SELECT s FROM od)), 0) dm FROM pr a WHERE a.it < {ITERATIONS}) p"""),
    "rk": (("pr(it, page_id, r)", "pc", "dg", "nn"), f"""SELECT page_id, title, pagerank, rank, CAST(1.0 AS DOUBLE) - (rank - 1) / greatest((SELECT n FROM nn) - 1, 1) AS percentile, in_degree, out_degree
 FROM (SELECT pc.page_id, pc.title, round(pr.r, {DIGITS}) AS pagerank, row_number() OVER (ORDER BY round(pr.r, {DIGITS}) DESC, pc.page_id) AS rank, dg.in_degree, dg.out_degree
 FROM pr JOIN pc ON pc.page_id = pr.page_id JOIN dg ON dg.page_id = pr.page_id WHERE it = {ITERATIONS})"""),
    "dw": ((), f"SELECT d.doc_id AS page_id, d.text AS clean_text, {_WORDS} AS words, CAST(len({_WORDS}) AS BIGINT) AS word_count FROM documents d"),
    "ar": (("pc", "dw"), "SELECT pc.page_id, pc.title, dw.clean_text, dw.words, dw.word_count, pc.page_len FROM pc JOIN dw ON dw.page_id = pc.page_id WHERE dw.word_count >= 100 AND length(dw.clean_text) > 0"),
    "bs": (("rk", "ar"), "SELECT rk.page_id, rk.title, rk.pagerank, rk.rank, rk.percentile, ar.word_count FROM rk JOIN ar ON ar.page_id = rk.page_id"),
    "g_top": (("bs",), f"SELECT page_id, title, 'top_pagerank' AS group_name, pagerank, rank, percentile, word_count FROM bs ORDER BY rank LIMIT {GROUP_SIZE}"),
    "g_bottom": (("bs",), f"SELECT page_id, title, 'bottom_pagerank' AS group_name, pagerank, rank, percentile, word_count FROM bs ORDER BY rank DESC LIMIT {GROUP_SIZE}"),
    "g_median": (("bs",), f"SELECT page_id, title, 'median_pagerank' AS group_name, pagerank, rank, percentile, word_count FROM bs WHERE percentile BETWEEN 0.45 AND 0.55 ORDER BY {_ORDER} LIMIT {GROUP_SIZE}"),
    "g_random": (("bs",), f"SELECT page_id, title, 'random' AS group_name, pagerank, rank, percentile, word_count FROM bs ORDER BY {_ORDER} LIMIT {GROUP_SIZE}"),
    "cm": (("f_categorylinks", "f_linktarget"), "SELECT DISTINCT c.cl_from AS page_id, m.g AS group_name FROM f_categorylinks c JOIN f_linktarget t ON c.cl_target_id = t.lt_id JOIN (VALUES "
           + ", ".join(f"('{k}', '{v}')" for k, v in CATEGORIES.items()) + ") m(g, t) ON m.t = t.lt_title WHERE t.lt_namespace = 14"),
    "g_category": (("bs", "cm"), f"SELECT {_COLUMNS} FROM (SELECT bs.*, cm.group_name, row_number() OVER (PARTITION BY cm.group_name ORDER BY md5(concat('{SEED}', ':', CAST(bs.page_id AS VARCHAR))), bs.page_id) AS k FROM bs JOIN cm ON cm.page_id = bs.page_id) WHERE k <= {GROUP_SIZE}"),
    "g": (("g_top", "g_median", "g_bottom", "g_random", "g_category"), " UNION ALL ".join(f"SELECT {_COLUMNS} FROM g_{x}" for x in ("top", "median", "bottom", "random", "category"))),
    "sh": (("ar",), """SELECT page_id, list_distinct(CASE WHEN len(words) < 3 THEN words ELSE
 list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2])) END) AS shingles FROM ar"""),
    "gs": (("g", "sh"), "SELECT g.page_id, g.group_name, g.title, g.percentile, sh.shingles, CAST(len(sh.shingles) AS BIGINT) AS num_shingles FROM g JOIN sh ON sh.page_id = g.page_id"),
    "ix": (("gs",), "SELECT group_name, page_id, unnest(shingles) AS shingle FROM gs"),
    "cn": (("ix",), "SELECT a.group_name, a.page_id AS x, b.page_id AS y, count(*) AS c FROM ix a JOIN ix b ON a.group_name = b.group_name AND a.shingle = b.shingle AND a.page_id < b.page_id GROUP BY ALL"),
    "pj": (("gs", "cn"), """SELECT a.group_name, a.page_id AS page_id_a, b.page_id AS page_id_b, a.title AS title_a, b.title AS title_b,
 CASE WHEN a.num_shingles + b.num_shingles > 0 THEN coalesce(c, 0) / CAST(a.num_shingles + b.num_shingles - coalesce(c, 0) AS DOUBLE) ELSE 1.0 END AS jaccard_exact
 FROM gs a JOIN gs b ON a.group_name = b.group_name AND a.page_id < b.page_id LEFT JOIN cn ON cn.group_name = a.group_name AND cn.x = a.page_id AND cn.y = b.page_id"""),
    "mh": (("gs",), f"""SELECT page_id, group_name, k, coalesce(min(substr(md5(concat(CAST(k AS VARCHAR), ':', shingle)), 1, 16)), '{"f" * 16}') AS h
 FROM (SELECT page_id, group_name, unnest(CASE WHEN len(shingles) = 0 THEN [NULL] ELSE shingles END) AS shingle FROM gs), range({PERMUTATIONS}) t(k) GROUP BY ALL"""),
    "mp": (("mh",), f"SELECT a.group_name, a.page_id AS page_id_a, b.page_id AS page_id_b, sum(CASE WHEN a.h = b.h THEN 1 ELSE 0 END) / CAST({PERMUTATIONS} AS DOUBLE) AS jaccard_minhash FROM mh a JOIN mh b ON a.group_name = b.group_name AND a.k = b.k AND a.page_id < b.page_id GROUP BY ALL"),
    "pp": (("pj", "mp"), "SELECT pj.*, mp.jaccard_minhash FROM pj JOIN mp USING (group_name, page_id_a, page_id_b)"),
    "sm": (("pj", "g"), """SELECT n.group_name, n.n_pages, s.* EXCLUDE (group_name) FROM (SELECT group_name, count(DISTINCT page_id) AS n_pages FROM g GROUP BY 1) n JOIN (
 SELECT group_name, count(*) AS n_pairs, avg(jaccard_exact) AS mean_similarity, median(jaccard_exact) AS median_similarity, stddev_samp(jaccard_exact) AS std_similarity,
 min(jaccard_exact) AS min_similarity, max(jaccard_exact) AS max_similarity, quantile_cont(jaccard_exact, 0.25) AS q25_similarity, quantile_cont(jaccard_exact, 0.75) AS q75_similarity FROM pj GROUP BY 1) s ON s.group_name = n.group_name"""),
    "bn": (("gs",), f"SELECT *, {_BIN} AS bin_idx, row_number() OVER (ORDER BY page_id, group_name) AS rid FROM gs"),
    "bi": (("bn",), "SELECT bin_idx, rid, unnest(shingles) AS shingle FROM bn"),
    "bc": (("bi",), "SELECT a.bin_idx, a.rid AS x, b.rid AS y, count(*) AS c FROM bi a JOIN bi b ON a.bin_idx = b.bin_idx AND a.shingle = b.shingle AND a.rid < b.rid GROUP BY ALL"),
    "bp": (("bn", "bc"), """SELECT a.bin_idx, CASE WHEN a.num_shingles + b.num_shingles > 0 THEN coalesce(c, 0) / CAST(a.num_shingles + b.num_shingles - coalesce(c, 0) AS DOUBLE) ELSE 0.0 END AS j
 FROM bn a JOIN bn b ON a.bin_idx = b.bin_idx AND a.rid < b.rid LEFT JOIN bc ON bc.x = a.rid AND bc.y = b.rid"""),
    "bs2": (("bn", "bp"), f"""SELECT n.bin_idx, {_BIN_NAME.replace("bin_idx", "n.bin_idx")} AS percentile_bin, n_pages, n_pairs, mean_similarity, median_similarity, std_similarity FROM (SELECT bin_idx, count(*) AS n_pages FROM bn GROUP BY 1) n
 JOIN (SELECT bin_idx, count(*) AS n_pairs, avg(j) AS mean_similarity, median(j) AS median_similarity, stddev_pop(j) AS std_similarity FROM bp GROUP BY 1) s ON s.bin_idx = n.bin_idx"""),
}


def _with(query: str, *needs: str) -> str:
    """The query behind the steps it needs, each made once."""
    wanted: list[str] = []

    def add(step: str) -> None:
        for s in _STEPS[step][0]:
            add(s)
        if step not in wanted:
            wanted.append(step)

    for s in needs:
        add(s)
    # the recursive table may not be materialised under its column list
    made = (f"{s} AS {'' if '(' in s else 'MATERIALIZED '}({_STEPS[s][1]})" for s in wanted)
    return f"WITH RECURSIVE {', '.join(made)} {query}" if wanted else query


def _round(columns: str, digits: int = 10) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


_GROUP = f"page_id, title, group_name, round(pagerank, {DIGITS}) AS pagerank, rank, round(percentile, {DIGITS}) AS percentile, word_count"
_RANKED = f"page_id, title, round(pagerank, {DIGITS}) AS pagerank, rank, round(percentile, {DIGITS}) AS percentile, in_degree, out_degree"
_STAT = lambda c: (f"[CAST(count({c}) AS DOUBLE), avg({c}), stddev_samp({c}), CAST(min({c}) AS DOUBLE), quantile_cont({c}, 0.25), quantile_cont({c}, 0.5), quantile_cont({c}, 0.75), CAST(max({c}) AS DOUBLE)]")
_PR = "pr(it, page_id, r)"
_INNER = "jaccard_exact >= q1 - 1.5 * (q3 - q1) AND jaccard_exact <= q3 + 1.5 * (q3 - q1)"
_MEAN = lambda g: f"(SELECT mean_similarity FROM sm WHERE group_name = '{g}')"


def oracle_sql() -> dict[str, str]:
    values = (f"{_MEAN('top_pagerank')} - {_MEAN('random')}", f"{_MEAN('top_pagerank')} - {_MEAN('bottom_pagerank')}", "(SELECT avg(abs(jaccard_minhash - jaccard_exact)) FROM pp)")
    questions = " UNION ALL ".join(f"SELECT '{q}' AS question, '{m}' AS metric, round({v}, 10) AS value, '{i}' AS interpretation" for (q, m, i), v in zip(QUESTIONS, values))
    return {
        "clean_pages": _with("SELECT * FROM pc", "pc"),
        "edges": _with("SELECT s AS source_page_id, d AS target_page_id FROM e", "e"),
        "degrees": _with("SELECT * FROM dg", "dg"),
        "graph_stats": _with("SELECT count(*) AS number_of_nodes, round(avg(in_degree), 6) AS mean_in_degree, round(median(in_degree), 6) AS median_in_degree, max(in_degree) AS max_in_degree, round(avg(out_degree), 6) AS mean_out_degree, round(median(out_degree), 6) AS median_out_degree, max(out_degree) AS max_out_degree, "
                             "count(*) FILTER (WHERE out_degree = 0) AS dangling_nodes, round(100.0 * count(*) FILTER (WHERE out_degree = 0) / count(*), 6) AS percent_dangling, count(*) FILTER (WHERE out_degree = 0 AND in_degree = 0) AS isolated_nodes, (SELECT count(*) FROM e) AS number_of_edges FROM dg", "dg", "e"),
        "degree_describe": _with(f"SELECT statistic, {_round('page_id in_degree out_degree', 6)} FROM (SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic, unnest({_STAT('page_id')}) AS page_id, unnest({_STAT('in_degree')}) AS in_degree, unnest({_STAT('out_degree')}) AS out_degree FROM dg)", "dg"),
        "pagerank_20": _with(f"SELECT page_id, round(r, {DIGITS}) AS pagerank FROM pr WHERE it = {ITERATIONS}", _PR),
        "pagerank_ranked": _with(f"SELECT {_RANKED} FROM rk", "rk"),
        "top_100_pagerank": _with(f"SELECT {_RANKED} FROM rk ORDER BY rank LIMIT 100", "rk"),
        "token_counts": _with("SELECT page_id, word_count FROM dw", "dw"),
        "articles_clean": _with("SELECT page_id, title, clean_text, word_count, page_len FROM ar", "ar"),
        "shingle_counts": _with("SELECT page_id, CAST(len(shingles) AS BIGINT) AS num_shingles FROM sh", "sh"),
        "shingle_lists": _with("SELECT page_id, md5(array_to_string(list_sort(shingles), '|')) AS shingles_md5 FROM sh", "sh"),
        "shingles_exploded": _with("SELECT page_id, unnest(shingles) AS shingle FROM sh", "sh"),
        "sample_md5": _with(f"SELECT page_id, title FROM pc ORDER BY {_ORDER} LIMIT {GROUP_SIZE}", "pc"),
        **{f"groups_{x}": _with(f"SELECT {_GROUP} FROM g_{x}", f"g_{x}") for x in ("top", "bottom", "median", "random", "category")},
        "experiment_groups": _with(f"SELECT {_GROUP} FROM g", "g"),
        "group_sizes": _with("SELECT group_name, count(*) AS n_rows FROM g GROUP BY 1", "g"),
        "minhash_md5_16": _with("SELECT page_id, group_name, string_agg(h, ',' ORDER BY k) AS signature FROM mh GROUP BY 1, 2", "mh"),
        "pairwise_jaccard": _with("SELECT group_name, page_id_a, page_id_b, title_a, title_b, round(jaccard_exact, 10) AS jaccard_exact FROM pj", "pj"),
        "minhash_jaccard_pairs": _with("SELECT group_name, page_id_a, page_id_b, round(jaccard_minhash, 10) AS jaccard_minhash FROM mp", "mp"),
        "minhash_mae": _with("SELECT round(avg(abs(jaccard_minhash - jaccard_exact)), 10) AS mean_absolute_error FROM pp", "pp"),
        "similarity_summary": _with(f"SELECT group_name, n_pages, n_pairs, {_round('mean_similarity median_similarity std_similarity min_similarity max_similarity q25_similarity q75_similarity')} FROM sm", "sm"),
        "percentile_bins": _with(f"SELECT page_id, group_name, CAST(bin_idx AS INTEGER) AS bin_idx, {_BIN_NAME} AS percentile_bin FROM (SELECT *, {_BIN} AS bin_idx FROM g)", "g"),
        "percentile_similarity": _with(f"SELECT CAST(bin_idx AS INTEGER) AS bin_idx, percentile_bin, n_pages, n_pairs, {_round('mean_similarity median_similarity std_similarity')} FROM bs2", "bs2"),
        "research_questions": _with(questions, "sm", "pp"),
        "hist_pagerank": _with(f"SELECT bin, round(lo + bin * (hi - lo) / 100, {DIGITS + 2}) AS lower, count(*) AS n FROM (SELECT CAST(least(floor((pagerank - lo) / (hi - lo) * 100), 99) AS INTEGER) AS bin, lo, hi FROM rk, (SELECT min(pagerank) AS lo, max(pagerank) AS hi FROM rk)) GROUP BY bin, lo, hi", "rk"),
        "top20_bar": _with(f"SELECT page_id, title, round(pagerank, {DIGITS}) AS pagerank, rank FROM rk ORDER BY rk.rank LIMIT 20", "rk"),
        "mean_bar": _with("SELECT group_name, round(mean_similarity, 10) AS mean_similarity FROM sm", "sm"),
        "box_jaccard": _with(f"SELECT group_name, {_round('q1 median q3')}, round(min(jaccard_exact) FILTER (WHERE {_INNER}), 10) AS whisker_low, round(max(jaccard_exact) FILTER (WHERE {_INNER}), 10) AS whisker_high FROM pj JOIN (SELECT group_name, quantile_cont(jaccard_exact, 0.25) AS q1, quantile_cont(jaccard_exact, 0.5) AS median, quantile_cont(jaccard_exact, 0.75) AS q3 FROM pj GROUP BY 1) q USING (group_name) GROUP BY group_name, q1, median, q3", "pj"),
        "percentile_line": _with("SELECT CAST(bin_idx AS INTEGER) AS bin_idx, percentile_bin, round(mean_similarity, 10) AS mean_similarity FROM bs2", "bs2"),
        "scatter_jaccard": _with(f"SELECT group_name, {_round('jaccard_exact jaccard_minhash')} FROM pp", "pp"),
        **{name: _with(sql, *needs) for name, (sql, *needs) in roundtrips.ORACLES.items()},
        **markup.oracle_sql(),
    }
