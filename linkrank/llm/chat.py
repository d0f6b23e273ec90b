"""Chat formatting: schema fingerprints select declarative mappings to canonical turns (operator 6).

A record is JSON text. Its fingerprint is the SHA-256 of its sorted nested field paths, to any depth: a field's name
follows that of the one around it after a full stop, elements of lists count as ``[]``, and in names ``\\``, ``.`` and
``[`` have a ``\\`` before them, so that different schemas have different paths. A table of layouts maps each known
fingerprint to an SQL expression for the turns; optional fields give a layout several fingerprints. Turns are written
with ``<|im_start|>role\\n text <|im_end|>\\n``. In roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes
``<\\|`` (in roles also a newline ``\\n``), so control strings never occur inside them and the way back is exact. The
loss mask is a list of byte ranges of the training text.

Edge cases: null roles and texts count as empty; a record of an unknown layout gives null turns, never a guess; names
are taken as they are written, so one with a JSON escape is another name; an empty conversation gives an empty string;
ties on turn order by role, then text; repeated rows are turns of their own; rows with a null conv_id are one
conversation; an empty table gives an empty result. A conversation is one training text, so it must fit in one row
(2 GB) whatever the number of its turns. Columns of the names that an operator adds are replaced, all others stay. Only
built-in functions are used.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"

#: Layouts: name, required field paths, optional ones, and the turns as SQL over the JSON column ``record``.
#: ``$.x`` stands for the field x as a string.
LAYOUTS: tuple[tuple[str, tuple[str, ...], tuple[str, ...], str], ...] = (
    ("messages", ("messages", "messages[].content", "messages[].role"), (),
     "transform(from_json(record, 'messages array<struct<role:string,content:string>>').messages, m -> named_struct('role', m.role, 'text', m.content))"),
    ("conversations", ("conversations", "conversations[].from", "conversations[].value"), (),
     "transform(from_json(record, 'conversations array<struct<`from`:string,value:string>>').conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))"),
    ("instruction", ("instruction", "output"), ("system", "input"),
     "filter(array(if($.system IS NULL, NULL, named_struct('role', 'system', 'text', $.system)), named_struct('role', 'user', 'text', concat_ws('\\n\\n', $.instruction, nullif($.input, ''))), named_struct('role', 'assistant', 'text', $.output)), t -> t IS NOT NULL)"),
    ("prompt_response", ("prompt", "response"), ("system",),
     "filter(array(if($.system IS NULL, NULL, named_struct('role', 'system', 'text', $.system)), named_struct('role', 'user', 'text', $.prompt), named_struct('role', 'assistant', 'text', $.response)), t -> t IS NOT NULL)"),
    ("prompt_completion", ("completion", "prompt"), (),
     "array(named_struct('role', 'user', 'text', $.prompt), named_struct('role', 'assistant', 'text', $.completion))"),
)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def layout_fingerprints(layouts=LAYOUTS) -> dict[str, tuple[str, str]]:
    """Fingerprint to (layout, turns expression), for every choice of optional fields."""
    out = {}
    for name, required, optional, turns in layouts:
        for n in range(len(optional) + 1):
            for extra in itertools.combinations(optional, n):
                paths = required + extra
                # an absent field reads as null
                expr = turns
                for path in (*required, *optional):
                    expr = expr.replace(f"$.{path}", f"get_json_object(record, '$.{path}')" if path in paths else "CAST(NULL AS STRING)")
                out[fingerprint_of(paths)] = (name, expr)
        if any("[]" in p for p in required):  # a record whose list is empty has the list's path only
            out[fingerprint_of(p for p in required if "[]" not in p)] = (name, turns)
    return out


#: Tokens of JSON text: names with their colons, strings, brackets. Possessive, so that long strings need no backtracking.
TOKEN = r'"(?:[^"\\]++|\\.)*+"\s*+:|"(?:[^"\\]++|\\.)*+"|[\[\]{}]'


def field_paths(record: Column) -> Column:
    """Distinct nested field paths of a JSON object, sorted; null if it is no JSON.

    The names and brackets of the text are folded with a stack of the paths that are open, so any depth will do, and the
    fold carries distinct paths only.
    """
    tokens = F.filter(F.regexp_extract_all(record, F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith('"') | t.endswith(":"))
    none = F.array().cast("array<string>")
    begin = F.struct(none.alias("open"), F.lit("").alias("next"), none.alias("paths"))

    def step(state: Column, token: Column) -> Column:
        opened, after, paths = state["open"], state["next"], state["paths"]
        last = F.coalesce(F.get(opened, F.size(opened) - 1), F.lit(""))
        name = F.regexp_extract(token, r'(?s)^"(.*)"\s*:$', 1)
        for char in ("\\", ".", "["):
            name = F.replace(name, F.lit(char), F.lit(f"\\{char}"))
        path = F.concat(last, name)
        # what opens is remembered by what its members' paths begin with: objects' end with a full stop, lists' with []
        begins = F.when(token == "[", F.concat(after, F.lit("[]"))).when(F.size(opened) == 0, F.lit("")).otherwise(F.concat(after, F.lit(".")))
        closed = F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0)))
        outer = F.coalesce(F.get(closed, F.size(closed) - 1), F.lit(""))
        is_name, opens = token.endswith(":"), token.isin("[", "{")
        return F.struct(
            F.when(is_name, opened).when(opens, F.array_append(opened, begins)).otherwise(closed).alias("open"),
            F.when(is_name, path).when(opens, begins).when(outer.endswith("]"), outer).otherwise("").alias("next"),
            F.when(is_name & ~F.array_contains(paths, path), F.array_append(paths, path)).otherwise(paths).alias("paths"),
        )

    found = F.aggregate(tokens, begin, step, lambda s: s["paths"])
    return F.when(F.try_parse_json(record).isNotNull(), F.array_sort(found))


def canonical_turns(records: DataFrame, column: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns to records of JSON text, in place of columns of these names."""
    known = layout_fingerprints(layouts)
    text, mark = f"{P}record", F.col(f"{P}fingerprint")
    own = [c for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    out = records.withColumn(text, F.col(column)).withColumn(f"{P}fingerprint", F.sha2(F.array_join(field_paths(F.col(text)), "\n"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for fingerprint, (name, expr) in known.items():
        layout = F.when(mark == fingerprint, F.lit(name)).otherwise(layout)
        turns = F.when(mark == fingerprint, F.expr(expr.replace("(record,", f"({text},"))).otherwise(turns)
    return out.select(*own, mark.alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``, also in roles: pairs of backslashes split the text, single ones name a character."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def formatted(turns: DataFrame, column: str = "turns", trained: str = "assistant") -> DataFrame:
    """Adds ``formatted`` (the training text) and ``loss`` (the byte ranges of its UTF-8 that are trained on), in place of
    columns of these names.

    The mask covers exactly the texts of ``trained`` turns.
    """
    head = lambda t: F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    parts = F.transform(column, lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("text"), F.coalesce(t["role"] == trained, F.lit(False)).alias("loss")))
    own = [c for c in turns.columns if c not in ("formatted", "loss")]
    out = turns.select(*own, parts.alias(f"{P}parts"))
    text = F.array_join(F.transform(f"{P}parts", lambda p: F.concat(p["head"], p["text"], F.lit(f"{END}\n"))), "")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,bytes:int>>").alias("ranges"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.octet_length(part["head"])
        size = F.octet_length(part["text"])
        own = F.struct(start.alias("start"), size.alias("bytes"))
        return F.struct((start + size + len(END) + 1).alias("at"), F.when(part["loss"], F.array_append(state["ranges"], own)).otherwise(state["ranges"]).alias("ranges"))

    return out.select(*own, text.alias("formatted"), F.aggregate(f"{P}parts", begin, step, lambda s: s["ranges"]).alias("loss"))


def read_back(text: Column) -> Column:
    """Turns from a training text."""
    blocks = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda b: b != "")
    body = lambda b: F.substring_index(b, END, 1)  # noqa: E731  a control string ends the text, as none occurs in it
    return F.transform(blocks, lambda b: F.struct(
        unescaped(F.substring_index(body(b), "\n", 1)).alias("role"),
        unescaped(F.substring(body(b), F.length(F.substring_index(body(b), "\n", 1)) + 2, F.length(b))).alias("text")))


def loss_text(text: Column, loss: Column) -> Column:
    """All of a training text that its loss mask covers, unescaped."""
    raw = text.cast("binary")
    return F.array_join(F.transform(loss, lambda r: unescaped(F.substring(raw, r["start"] + 1, r["bytes"]).cast("string"))), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id and one JSON record per conversation, in the layout that fits its roles.

    A user and an assistant turn make a prompt and a response, a system turn before them adds a system field; all else
    is a list of messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    at = lambda i: F.col("t")[i]["content"]
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(F.struct(at(0).alias("system"), at(1).alias("instruction"), at(2).alias("output"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    text = f"{END}{START}assistant ok"
    return spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user'), (-1L, 1L, 'assistant') AS t(conv_id, turn, role)").withColumn("text", F.lit(text))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, record, fingerprint, layout, turns, the training text and its loss mask of conversations given as rows by turn."""
    return formatted(canonical_turns(conversation_records(rows.select("conv_id", "turn", "role", "text"))))


def digests(out: DataFrame) -> DataFrame:
    """What the operator's output reads back as."""
    back = read_back(F.col("formatted"))
    lines = F.array_join(F.flatten(F.transform("back", lambda t: F.array(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), "")
    out = out.withColumn("back", back).withColumn(f"{P}loss", loss_text(F.col("formatted"), F.col("loss")))
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(f"{P}loss").cast("long").alias("loss_chars"), F.sha2(F.col(f"{P}loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout", "fingerprint")
