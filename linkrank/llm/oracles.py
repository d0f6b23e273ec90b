"""DuckDB SQL of the operators that SQL can express: license scans, chat formatting, sharding and media of texts."""

from __future__ import annotations

from .licenses import DIGESTS, LICENSES, SPELLINGS, notices


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    spelled = "concat(' ', trim(x), ' ')"
    for variant, word in SPELLINGS.items():
        spelled = f"replace({spelled}, ' {variant} ', ' {word} ')"
    marks = (
        r"(?m)^[^\p{L}\p{N}\p{M}\n]*(?:copyright\b(?: *(?:\(c\)|©|[0-9]| by )| year)|\(c\) |©|all rights reserved)[^\n]*$",
        r"(?m)^[ \t]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]",
    )
    body = "lower(coalesce(text, ''))"
    for mark in marks:
        body = f"regexp_replace({body}, {_quoted(mark)}, '', 'g')"
    body = f"regexp_replace({body}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\n]+', '  ', 'g')"
    texts = [*LICENSES.items(), *((i, t) for t, i in notices().items())]
    known = "VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in texts)
    digests = "VALUES " + ", ".join(f"({_quoted(v)}, {_quoted(k)})" for k, v in DIGESTS.items())
    return f"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, NULL AS license_id, text FROM documents UNION ALL SELECT NULL, NULL, license_id, text FROM ({known}) AS k(license_id, text)),
 canon AS MATERIALIZED (SELECT rid, doc_id, license_id, list_filter(list_transform(string_split({body}, chr(10)), lambda x: trim({spelled})), lambda x: x <> '') AS lines FROM src),
 known AS MATERIALIZED (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256(array_to_string(lines, '  ')) AS digest, license_id FROM canon WHERE rid IS NULL UNION ALL ({digests})) GROUP BY 1),
 docs AS MATERIALIZED (SELECT rid, doc_id, sha256(array_to_string(lines, '  ')) AS digest, lines FROM canon WHERE rid IS NOT NULL),
 found AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(*) AS n FROM (SELECT rid, sha256(unnest(lines)) AS digest FROM docs) JOIN known USING (digest) GROUP BY 1)
 SELECT docs.doc_id, docs.digest AS canonical_sha256, known.license_id, coalesce(ids, '') AS line_license_ids, coalesce(n, 0) AS n_license_lines
 FROM docs LEFT JOIN known ON known.digest = docs.digest LEFT JOIN found ON found.rid = docs.rid"""


def chat_sql() -> str:
    control = "<|im_end|><|im_start|>assistant ok"
    order = "ORDER BY turn NULLS FIRST, role, text"
    escaped = lambda c: f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"
    paths = lambda *p: f"sha256(concat_ws(chr(10), {', '.join(map(_quoted, p))}))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '{control}' UNION ALL SELECT -1, 1, 'assistant', '{control}'),
 g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' {order})) AS turns_sha256,
 coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '') AS loss, list(role {order}) AS roles,
 CAST(sum(length('<|im_start|>') + length(replace({escaped('role')}, chr(10), '\\n')) + 1 + length({escaped('text')}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars FROM t GROUP BY 1)
 SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
 CASE WHEN roles = ['user', 'assistant'] THEN 'prompt_response' WHEN roles = ['system', 'user', 'assistant'] THEN 'instruction' ELSE 'messages' END AS layout,
 CASE WHEN roles = ['user', 'assistant'] THEN {paths('prompt', 'response')} WHEN roles = ['system', 'user', 'assistant'] THEN {paths('instruction', 'output', 'system')}
 ELSE {paths('messages', 'messages[].content', 'messages[].role')} END AS fingerprint FROM g"""


#: The CRC's table of 256 numbers, which ``_crc32`` takes as ``t``.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b))"


def _crc32(digits: str) -> str:
    octets = f"list_transform(regexp_extract_all({digits}, '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"


def sharding_sql(shards: int = 8) -> str:
    """Minimax cuts by dynamic programming over all cuts: ``best{k}`` has the least largest load of k shards for each
    number of leading groups. The greedy cuts at the best capacity follow."""
    body = "coalesce(text, '')"
    best = "".join(f"""
 best{k} AS MATERIALIZED (SELECT i.upto, min(greatest(b.load, i.upto - b.upto)) AS load FROM ends i JOIN best{k - 1} b ON b.upto <= i.upto GROUP BY 1),""" for k in range(2, shards + 1))  # fmt: skip
    cuts = "".join(f"""
 cut{k} AS MATERIALIZED (SELECT max(ends.upto) AS bound FROM ends, capacity, cut{k - 1} WHERE ends.upto <= cut{k - 1}.bound + capacity.load),""" for k in range(1, shards))  # fmt: skip
    every = " UNION ALL ".join(f"SELECT bound FROM cut{k}" for k in range(1, shards))
    return f"""WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
 docs AS MATERIALIZED (SELECT doc_id, CAST(strlen({body}) + 1 AS BIGINT) AS size, sha256({body}) AS digest,
  {_crc32(f"hex(encode({body}))")} AS text_crc32 FROM documents, crc),
 sums AS MATERIALIZED (SELECT digest, CAST(sum(w) OVER (ORDER BY digest) AS BIGINT) AS upto, w FROM (SELECT digest, CAST(sum(size) AS BIGINT) AS w FROM docs GROUP BY 1)),
 ends AS MATERIALIZED (SELECT upto FROM sums UNION ALL SELECT CAST(0 AS BIGINT)),
 best1 AS MATERIALIZED (SELECT upto, upto AS load FROM ends),{best}
 capacity AS MATERIALIZED (SELECT load FROM best{shards} ORDER BY upto DESC LIMIT 1),
 cut0 AS (SELECT CAST(0 AS BIGINT) AS bound),{cuts}
 cuts AS MATERIALIZED ({every}),
 placed AS MATERIALIZED (SELECT digest, CAST((SELECT count(*) FROM cuts WHERE bound <= upto - w) AS INTEGER) AS shard FROM sums)
 SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY sha256(concat_ws(' ', CAST(doc_id AS VARCHAR), digest))) - 1 AS slot,
 CAST(NULL AS INTEGER) AS grown_shard FROM docs JOIN placed USING (digest)"""


Part = tuple[str, str]  # SQL of a part's hex digits, and of its number of bytes


def _number(value: int | str, size: int = 4) -> Part:
    return f"'{value:0{2 * size}x}'" if isinstance(value, int) else f"printf('%0{2 * size}x', {value})", str(size)


def _blank(size: int) -> Part:
    return _number(0, size)


def _ascii(text: str) -> Part:
    return f"'{text.encode().hex()}'", str(len(text))


def _box(kind: str, *parts: Part) -> Part:
    size = " + ".join(["8", *(n for _, n in parts)])
    return " || ".join([f"printf('%08x', {size})", _ascii(kind)[0], *(x for x, _ in parts)]), f"({size})"


def media_sql() -> str:
    """The container of each text from the format's definition, as hex digits: frames of 192 bytes (n), chunks of 32 (c),
    every eighth a keyframe (k). Texts under 4 GB."""
    numbers = lambda *x: [_number(i) for i in x]
    listed = lambda count, each: (f"array_to_string(list_transform(range({count}), lambda i: printf('%08x', {each})), '')", f"4 * {count}")
    matrix = numbers(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = "n * 1000"
    entry = _box("raw ", _blank(6), _number(1, 2), _blank(16), _number(16, 2), _number(12, 2), *numbers(0x480000, 0x480000, 0), _number(1, 2), _blank(32), _number(8, 2), _number(0xFFFF, 2))
    full_run, last_run = "CAST(n >= 32 AS BIGINT)", "CAST(n % 32 > 0 AS BIGINT)"
    runs = f"repeat('000000010000002000000001', {full_run}) || repeat(printf('%08x%08x00000001', c, n % 32), {last_run})", f"12 * ({full_run} + {last_run})"
    stbl = _box(
        "stbl", _box("stsd", *numbers(0, 1), entry), _box("stts", *numbers(0, 1, "n", 1000)), _box("stsc", *numbers(0, f"{full_run} + {last_run}"), runs),
        _box("stsz", *numbers(0, 192, "n")), _box("stco", *numbers(0, "c"), listed("c", "first + 6144 * i")), _box("stss", *numbers(0, "k"), listed("k", "8 * i + 1")),
    )
    minf = _box("minf", _box("vmhd", _number(1), _blank(8)), _box("dinf", _box("dref", *numbers(0, 1), _box("url ", _number(1)))), stbl)
    mdia = _box("mdia", _box("mdhd", *numbers(0, 0, 0, 24_000, duration), _number(0x55C4, 2), _blank(2)), _box("hdlr", *numbers(0, 0), _ascii("vide"), _blank(12), _blank(1)), minf)
    tkhd = _box("tkhd", *numbers(3, 0, 0, 1, 0, duration), _blank(16), *matrix, *numbers(16 << 16, 12 << 16))
    mvhd = _box("mvhd", *numbers(0, 0, 0, 24_000, duration, 0x10000), _number(0x100, 2), _blank(10), *matrix, _blank(24), _number(2))
    ftyp, moov = _box("ftyp", _ascii("isom"), _number(512), _ascii("isomiso2")), _box("moov", mvhd, _box("trak", tkhd, mdia))
    mdat = _box("mdat", ("payload", "192 * n"))
    return f"""WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
 docs AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, hex(encode(coalesce(text, ''))) AS digits, greatest(1, (strlen(coalesce(text, '')) + 191) // 192) AS n FROM documents),
 frames AS (SELECT doc_id, n_bytes, n, (n + 31) // 32 AS c, (n + 7) // 8 AS k, digits || repeat('20', CAST(192 * n - n_bytes AS BIGINT)) AS payload FROM docs),
 placed AS MATERIALIZED (SELECT *, {ftyp[1]} + {moov[1]} + 8 AS first FROM frames),
 media AS MATERIALIZED (SELECT *, unhex({ftyp[0]} || {moov[0]} || {mdat[0]}) AS whole FROM placed)
 SELECT doc_id, n_bytes, CAST(192 * n AS BIGINT) AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, {_crc32("right(payload, 32)")} AS tail_crc32,
 CAST(octet_length(whole) AS BIGINT) AS media_bytes, sha256(whole) AS media_sha256,
 'codec=raw ;handler=vide;timescale=24000;duration=' || (n * 1000) || ';samples=' || n || ';keyframes=' || k || ';ranges='
 || array_to_string(list_transform(range(k), lambda i: (first + 1536 * i) || '+192'), ',') AS feature FROM media, crc"""
