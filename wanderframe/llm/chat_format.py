"""Chat formatting in DataFrame functions only: schema fingerprint -> declarative layout -> canonical turns -> template.

A record holds its chat in one of several layouts. The nested field paths that are present (not null) in a
record are hashed; the fingerprint selects the layout, whose declaration says where roles and texts stand.
A record with no known fingerprint keeps null layout, turns and formatted text; none is dropped.
Null texts and roles inside a known layout read as empty. Unknown fields are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What a text must not contain unescaped, the template's own marks first. Fixed values.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"

#: The union of the layouts' fields, to read JSON records with from_json.
RECORD_SCHEMA = (
    "prompt string, response string, completion string, instruction string, input string, output string, system string, "
    "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>"
)

RECORD_FIELDS = ("prompt", "response", "completion", "instruction", "input", "output", "system", "messages", "conversations")
#: Turns whose spans are gathered at a time: what is copied grows with their number and not with its square.
TURNS_AT_ONCE = 256


@dataclass(frozen=True)
class Layout:
    """turns: (role, field path) in order; or many: (array field, role field, text field, {role: canonical role})."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    many: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("prompt_response", ("prompt", "response"), ("system",),
           (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",),
           (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), many=("messages", "role", "content")),
    Layout("from_value", ("conversations[]",), ("conversations[].from", "conversations[].value"), many=("conversations", "from", "value"),
           roles=(("human", "user"), ("gpt", "assistant"), ("model", "assistant"))),
)


def _fields(df: DataFrame, layouts: tuple[Layout, ...]) -> list[str]:
    known = {p.split("[")[0] for x in layouts for p in (*x.required, *x.optional)}
    return [c for c in df.columns if c in known]


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """64-bit hash of the sorted nested field paths that a row has, among those that some layout names."""
    paths = sorted({p for x in layouts for p in (*x.required, *x.optional)})
    have = set(_fields(df, layouts))

    def present(path: str) -> Column:
        top, _, inner = path.partition("[]")
        if top not in have:
            return F.lit(None).cast("string")
        there = F.col(top).isNotNull()
        if inner:
            there = there & F.exists(F.col(top), lambda m: m[inner[1:]].isNotNull())
        return F.when(there, F.lit(path))

    return F.xxhash64(F.concat_ws(",", *[present(p) for p in paths]))


def layout_fingerprints(layout: Layout) -> Column:
    """The fingerprints of a layout with any of its optional paths, as an array of constants."""
    sets = [(*layout.required, *more) for k in range(len(layout.optional) + 1) for more in combinations(layout.optional, k)]
    return F.array(*[F.xxhash64(F.lit(",".join(sorted(s)))) for s in sets])


def _layout_turns(df: DataFrame, layout: Layout) -> Column:
    have = set(df.columns)
    if layout.many:
        top, role, text = layout.many
        if top not in have:
            return F.lit(None).cast(TURNS)

        def canonical(r: Column) -> Column:
            out = F.coalesce(r, F.lit(""))
            return reduce(lambda acc, kv: F.when(r == kv[0], F.lit(kv[1])).otherwise(acc), layout.roles, out)

        return F.transform(F.col(top), lambda m: F.struct(canonical(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    turns = []
    for role, fields in layout.turns:
        parts = [F.col(f) for f in fields if f in have]
        if parts:
            joined = F.concat_ws("\n\n", *parts)
            turns.append(F.when(reduce(lambda a, b: a | b, [p.isNotNull() for p in parts]), F.struct(F.lit(role).alias("role"), joined.alias("text"))))
    return F.filter(F.array(*turns), lambda t: t.isNotNull()) if turns else F.lit(None).cast(TURNS)


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """df with fingerprint, layout (name or null) and turns.

    Top-level columns named like a field of some layout are that field; all others are kept and mean nothing here.
    Columns that the result would hide are an error. Null and empty texts are turns with empty text; repeated rows are
    records of their own; very long texts and many turns are taken whole; an empty table gives an empty one.
    """
    if taken := {"fingerprint", "layout", "turns"} & set(df.columns):
        raise ValueError(f"there are columns named {', '.join(sorted(taken))} already: rename them")
    print_of = fingerprint(df, layouts)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        fits = F.array_contains(layout_fingerprints(x), F.col("fingerprint"))
        name, turns = F.when(fits, F.lit(x.name)).otherwise(name), F.when(fits, _layout_turns(df, x).cast(TURNS)).otherwise(turns)
    return df.withColumn("fingerprint", print_of).withColumns({"layout": name, "turns": turns})


def from_json_records(df: DataFrame, payload: str) -> DataFrame:
    """JSON strings of any layout, as the layouts' fields. Broken JSON gives a row of nulls. Columns of df named like a
    layout's field are an error."""
    if taken := set(RECORD_FIELDS) & set(df.columns):
        raise ValueError(f"there are columns named {', '.join(sorted(taken))} already: rename them")
    return df.withColumn("_record", F.from_json(F.col(payload), RECORD_SCHEMA)).select(*df.columns, "_record.*")


def escape(text: Column) -> Column:
    """Reversible: backslashes double, then each control string gets a backslash behind its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\(\\\\?)", "$1")


def formatted(turns: Column) -> Column:
    """The template over canonical turns: <|im_start|>role<|im_sep|>text<|im_end|> and a newline for each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """(start, length) in code points of each assistant text within the formatted text: what a loss is computed on."""
    none = F.array().cast("array<struct<start:int,length:int>>")

    def step(acc: Column, t: Column) -> Column:
        head, body = len(START) + len(SEP) + F.length(escape(t["role"])), F.length(escape(t["text"]))
        span = F.when(t["role"] == "assistant", F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))).otherwise(none)
        return F.struct((acc["at"] + head + body + len(END) + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    def moved(acc: Column, part: Column) -> Column:
        spans = F.transform(part["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["spans"], F.array(spans)).alias("spans"))

    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(turns) / TURNS_AT_ONCE).cast("int")), lambda k: F.aggregate(
        F.slice(turns, k * TURNS_AT_ONCE + 1, TURNS_AT_ONCE), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,length:int>>>").alias("spans"))
    return F.when(turns.isNotNull(), F.aggregate(parts, zero, moved, lambda acc: F.flatten(acc["spans"])))


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    def turn(part: Column) -> Column:
        return let(F.split(part, SEP.replace("|", "\\|")), lambda p: F.struct(
            unescape(F.substring(p[0], F.lit(len(START) + 1), F.length(p[0]))).alias("role"), unescape(p[1]).alias("text")))

    return let(F.split(text, END.replace("|", "\\|") + "\n"), lambda parts: F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn))


def format_chats(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """df with fingerprint, layout, turns, formatted and loss_spans (null where no layout fits)."""
    out = canonical_turns(df, layouts)
    return out.withColumns({"formatted": formatted(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))})


def gathered(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Records of the messages layout from a table with a row for each turn.

    Turns are ordered by number, nulls first; ties by role, then text. Repeated rows are turns of their own.
    A conversation becomes one row, since its text is hashed and trained on as one; a null key is one conversation.
    """
    turn_row = F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    return rows.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(turn_row)).alias("_turns")).select(
        key, F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: digests of the formatted conversations, read back from the formatted text and its loss spans."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = format_chats(gathered(rows.unionByName(hard), "conv_id", "turn", "role", "text"))
    said = read_back(F.col("formatted"))
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return chats.select("conv_id", "formatted", said.alias("said"), learnt.alias("learnt")).select(
        "conv_id", F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _oracle() -> str:
    def escaped(x: str) -> str:
        out = f"replace({x}, '\\', '\\\\')"
        for c in CONTROL:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    frame = len(START) + len(SEP) + len(END) + 1
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
             sum({frame} + length({escaped('role')}) + length({escaped('text')}))::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g
"""


ORACLE = _oracle()
