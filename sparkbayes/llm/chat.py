"""Chat formatting by schema fingerprint (operator 6); DataFrame functions only.

A record's fingerprint is a hash of its sorted nested field paths, list levels marked ``[]``. It selects a mapping
from a declarative registry, and the mapping says where turns, roles and texts lie. Typed columns are fingerprinted
once from their schema, JSON records one by one, so a table may mix layouts. Canonical turns are (role, text) lists.

The template writes each turn as ``[INST]role[/INST]text</s>``. Inside roles and texts a backslash goes behind the
first character of each control string, behind each backslash, and behind each ``<`` or ``[`` that stands before
a backslash. Then no control string is left, and dropping one backslash behind each of those characters, from left
to right, gives the text back. The loss mask is run lengths in order: per turn (skipped, under loss, skipped).

Defined cases: null text and null role are empty; rows of a conversation that have the same turn number are ordered
by role, then text, and repeated rows are turns of their own; a conversation id of null is one more conversation; texts
and conversations of any length are formatted whole; an optional field (a system prompt, an input) that is empty gives
no turn; a record whose fingerprint no mapping knows (one with further fields than a layout lists, with an empty list,
or that is no JSON) has null turns and a null layout; an empty table gives no conversations; other columns, also ones
named like a result, are not used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: a list with role and text fields, or fixed fields in order of speaking."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    list: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()  # paths that belong to the layout and hold nothing to be said

    def paths(self) -> str:
        own = (f"{self.list}[].{self.role}", f"{self.list}[].{self.text}") if self.list else tuple(f for f, _ in self.fields)
        return ",".join(sorted((*own, *self.extra)))

    def mark(self) -> str:
        """The layout's fingerprint."""
        return hashlib.sha256(self.paths().encode()).hexdigest()

    def turns(self, get) -> Column:
        """Canonical turns; ``get(path, type)`` reads a field. An optional field that is empty gives no turn."""
        if not self.list:
            texts = [F.coalesce(get(f, "string"), F.lit("")) for f, _ in self.fields]
            said = [F.struct(F.lit(r).alias("role"), t.alias("text")) for (_, r), t in zip(self.fields, texts, strict=True)]
            spoken = [F.when(t != "", x) if f in self.optional else x for (f, _), t, x in zip(self.fields, texts, said, strict=True)]
            return F.filter(F.array(*spoken), lambda t: t.isNotNull()) if self.optional else F.array(*spoken)
        rows = get(self.list, f"array<struct<{self.role}:string,{self.text}:string>>")
        names = F.create_map(*[F.lit(x) for pair in self.roles for x in pair]) if self.roles else None

        def one(row: Column) -> Column:
            role = F.coalesce(row[self.role], F.lit(""))
            role = F.coalesce(F.try_element_at(names, role), role) if names is not None else role
            return F.struct(role.alias("role"), F.coalesce(row[self.text], F.lit("")).alias("text"))

        return F.transform(rows, one)


#: Public layouts of chat and instruction data.
LAYOUTS = [
    Layout("messages", list="messages", role="role", text="content"),
    Layout("conversations", list="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_response", fields=(("prompt", "user"), ("response", "assistant"))),
    Layout("prompt_completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("question_answer", fields=(("question", "user"), ("answer", "assistant"))),
    Layout("system_prompt_response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Layout("instruction_output", fields=(("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_input_output", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("input",)),
    Layout("messages", list="messages", role="role", text="content", extra=("messages[].name",)),
    Layout("conversations", list="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant")), extra=("id",)),
    Layout("instruction_input_output", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("input",), extra=("text",)),
]


def paths_of(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, list levels marked []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{at}[]")
    return [at]


def fingerprint_json(record: Column) -> Column:
    """The fingerprint of one JSON record; fields of an object in a list at most one level down carry its path."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    # e.g. OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>: open each list of objects into its fields' paths.
    inner = F.regexp_replace(schema, "^OBJECT<(.*)>$", "$1")
    parts = F.regexp_extract_all(inner, F.lit("(?:[^,<>]+: ARRAY<OBJECT<[^<>]*>>|[^,<>]+: [A-Z]+(?:\\([^)]*\\))?(?:<[^<>]*>)?)"), 0)

    def paths(part: Column) -> Column:
        name = F.trim(F.regexp_extract(part, "^([^:]+):", 1))
        nested = F.regexp_extract(part, "ARRAY<OBJECT<(.*)>>$", 1)
        return F.when(nested != "", F.transform(F.split(nested, ", "), lambda f: F.concat(name, F.lit("[]."), F.trim(F.split_part(f, F.lit(":"), F.lit(1)))))).otherwise(F.array(name))

    return F.sha2(F.array_join(F.sort_array(F.flatten(F.transform(parts, paths))), ",").cast("binary"), 256)


def canonical(df: DataFrame, key: str, record: str | None = None, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """(key, layout, turns) of typed columns, or with ``record`` of a column of JSON records."""
    if record is None:
        own = T.StructType([f for f in df.schema.fields if f.name != key])
        found = {x.mark(): x for x in layouts}.get(hashlib.sha256(",".join(sorted(paths_of(own))).encode()).hexdigest())
        if found is None:
            return df.select(F.col(key), F.lit(None).cast("string").alias("layout"), F.lit(None).cast(TURNS).alias("turns"))
        return df.select(F.col(key), F.lit(found.name).alias("layout"), found.turns(lambda f, kind: F.col(f)).cast(TURNS).alias("turns"))
    rows = df.withColumn("_mark", fingerprint_json(F.col(record))).withColumn("_record", F.try_parse_json(record))
    layout = turns = F.lit(None)
    for x in layouts:
        mark = F.col("_mark") == F.lit(x.mark())
        layout = F.when(mark, F.lit(x.name)).otherwise(layout)
        turns = F.when(mark, x.turns(lambda f, kind: F.try_variant_get("_record", f"$.{f}", kind))).otherwise(turns)
    return rows.select(F.col(key), layout.cast("string").alias("layout"), turns.cast(TURNS).alias("turns"))


def gather(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of turns as one record per conversation in the layout ``messages``."""
    empty = F.lit("")
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("content"))
    records = rows.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(one)).alias("messages"))
    return records.select(key, F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|<(?=/s>|\\)|\[(?=/?INST\]|\\))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def format_turns(df: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_mask``: run lengths in code points, text under loss being that of role ``learn``."""
    safe = F.transform(turns, lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == learn).alias("learn")))
    rows = df.withColumn("_safe", safe)
    formatted = F.array_join(F.transform("_safe", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")

    def runs(t: Column) -> Column:
        head, body = F.length(t["role"]) + len(OPEN) + len(MIDDLE), F.length(t["text"])
        return F.struct((head + F.when(t["learn"], 0).otherwise(body)).cast("long").alias("skip"), F.when(t["learn"], body).otherwise(0).cast("long").alias("take"), F.lit(len(CLOSE)).cast("long").alias("after"))

    return rows.withColumn("formatted", formatted).withColumn("loss_mask", F.transform("_safe", runs)).drop("_safe")


def read_back(df: DataFrame, formatted: str = "formatted", mask: str = "loss_mask") -> DataFrame:
    """``df`` with ``read_turns`` and ``read_loss`` (the unescaped texts under the mask), both from the formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def one(piece: Column) -> Column:
        at = F.instr(piece, MIDDLE)
        role = F.substr(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, at + len(MIDDLE))).alias("text"))

    loss = F.filter(F.zip_with("_pieces", mask, lambda p, m: F.when(m["take"] > 0, unescape(F.substr(p, (m["skip"] + 1).cast("int"), m["take"].cast("int"))))), lambda x: x.isNotNull())
    return df.withColumn("_pieces", pieces).withColumn("read_turns", F.transform("_pieces", one)).withColumn("read_loss", F.array_join(loss, "")).drop("_pieces")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "conversations")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(tricky).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("record"),
    )
    turns = canonical(gather(rows, "conv_id", "turn", "role", "text"), "conv_id").unionByName(canonical(extra, "conv_id", "record"))
    back = read_back(format_turns(turns))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("read_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("read_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _times(text: str, found: str) -> str:
    return f"(length({text}) - length(replace({text}, '{found}', ''))) // {len(found)}"


def _written(text: str) -> str:
    controls = ("\\", "</s>", "[INST]", "[/INST]", "<\\", "[\\")
    return f"(length({text}) + " + " + ".join(_times(text, c) for c in controls) + ")"


SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum({_written("role")} + {_written("text")} + {len(OPEN) + len(MIDDLE) + len(CLOSE)}) AS formatted_chars
    FROM rows GROUP BY conv_id
)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
    sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM said
"""
