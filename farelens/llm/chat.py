"""Chat formatting: records of different layouts to canonical turns, then to one marked text.

A record's layout is found by its fingerprint: the hash of the nested field paths that it fills.
Each known layout declares its fields and how they become turns; the fingerprints of all its
combinations of required and optional fields select that declaration. Fields that no layout knows
play no part, so records may carry others.

The text marks turns with control strings. Where a text has such a string itself, an invisible
joiner is put into it, one more than it may already have, so reading back restores every text.
Formatting gives segments, each with its loss flag; their texts in order are the formatted text.

Defined cases: null role or text count as empty; rows are ordered by turn, then role and text;
a record without a known layout, or with nothing filled, has null layout and no turns; records
without turns give an empty text; equal records give equal results; an empty table gives none;
input columns with the names of the results are replaced, all others kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>\n"
JOINER = "⁠"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class ListLayout:
    """One list of turns, each with a role and a text field."""

    name: str
    items: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)

    def field_sets(self) -> list[dict[str, tuple[str, ...]]]:
        return [{self.items: tuple(sorted((f"{self.items}[].{self.role}", f"{self.items}[].{self.text}")))}]

    def turns(self, columns: set[str]) -> Column:
        def one(item: Column) -> Column:
            role = item[self.role].cast("string")
            for theirs, ours in self.roles.items():
                role = F.when(item[self.role] == theirs, ours).otherwise(role)
            return turn(role, item[self.text])

        return F.transform(F.col(self.items), one)


@dataclass(frozen=True)
class FieldLayout:
    """Single fields; those of one turn are joined by blank lines, empty turns left out."""

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]
    optional: frozenset[str] = frozenset()

    def field_sets(self) -> list[dict[str, tuple[str, ...]]]:
        fields = [f for _, fs in self.parts for f in fs]
        free = [f for f in fields if f in self.optional]
        left_out = [set(c) for k in range(len(free) + 1) for c in combinations(free, k)]
        return [{f: (f,) for f in fields if f not in out} for out in left_out]

    def turns(self, columns: set[str]) -> Column:
        built = []
        for role, fields in self.parts:
            here = [F.col(f).cast("string") for f in fields if f in columns]
            if here:
                present = here[0].isNotNull()
                for f in here[1:]:
                    present = present | f.isNotNull()
                text = F.array_join(F.filter(F.array(*here), lambda t: t != ""), "\n\n")
                built.append(F.when(present, turn(F.lit(role), text)))
        return F.filter(F.array(*built), lambda t: t.isNotNull())


LAYOUTS = (
    ListLayout("messages", "messages", "role", "content"),
    ListLayout("conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    FieldLayout(
        "instruction",
        (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
        frozenset(("system", "input")),
    ),
    FieldLayout("prompt_response", (("user", ("prompt",)), ("assistant", ("response",)))),
    FieldLayout("prompt_completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    FieldLayout(
        "question_answer",
        (("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))),
        frozenset(("system", "context")),
    ),
)


def turn(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.struct(
        F.coalesce(role.cast("string"), empty).alias("role"), F.coalesce(text.cast("string"), empty).alias("text")
    )


def field_paths(name: str, kind: DataType) -> list[str]:
    """All paths to leaves below a field, lists marked by []."""
    if isinstance(kind, ArrayType):
        return field_paths(f"{name}[]", kind.elementType)
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f"{name}.{f.name}", f.dataType)]
    return [name]


def fingerprint(schema: StructType, layouts=LAYOUTS) -> Column:
    """Hash of the known paths that a record fills."""
    known = {p for layout in layouts for fields in layout.field_sets() for ps in fields.values() for p in ps}
    filled = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        paths = sorted(p for p in field_paths(f.name, f.dataType) if p in known)
        if paths:
            filled.append(F.when(F.col(f.name).isNotNull(), ",".join(paths)))
    return F.xxhash64(F.concat_ws(",", *filled) if filled else F.lit(""))


def canonical_turns(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Adds layout (its name or null) and turns (role and text)."""
    records = records.drop("layout", "turns")
    columns, seen = set(records.columns), fingerprint(records.schema, layouts)
    top = {f.name: set(field_paths(f.name, f.dataType)) for f in records.schema.fields}
    name = F.lit(None).cast("string")
    turns = F.array().cast(f"array<{TURN}>")
    for layout in layouts:
        matches = []
        for fields in layout.field_sets():
            if all(f in columns and set(paths) <= top[f] for f, paths in fields.items()):
                paths = ",".join(",".join(fields[f]) for f in sorted(fields))
                matches.append(F.col("__seen") == F.xxhash64(F.lit(paths)))
        if matches:
            hit = matches[0]
            for m in matches[1:]:
                hit = hit | m
            name = F.when(hit, layout.name).otherwise(name)
            turns = F.when(hit, layout.turns(columns)).otherwise(turns)
    return records.withColumn("__seen", seen).withColumns({"layout": name, "turns": turns}).drop("__seen")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"<({JOINER}*)\\|", f"<$1{JOINER}|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"<({JOINER}*){JOINER}\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def segments_of(turns: Column, learn: str = "assistant") -> Column:
    """Marked segments; those of the role to learn carry the loss."""

    def marked(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")), F.lit(False)),
            part(escape(t["text"]), t["role"] == learn),
            part(F.lit(END), F.lit(False)),
        )

    return F.flatten(F.transform(turns, marked))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """Everything under the loss, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""

    def one(chunk: Column) -> Column:
        head = F.substring_index(chunk, "\n", 1)
        return turn(
            unescape_role(F.substring(head, len(START) + 1, F.length(head))),
            unescape(F.substring(chunk, F.length(head) + 2, F.length(chunk))),
        )

    chunks = F.filter(F.split(formatted, END.replace("|", "\\|")), lambda c: c != "")
    return F.transform(chunks, one)


def format_chat(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Adds layout, turns, segments and formatted."""
    known = canonical_turns(records, layouts).drop("segments", "formatted")
    return known.withColumn("segments", segments_of(F.col("turns"))).withColumn(
        "formatted", formatted_text(F.col("segments"))
    )


def gather(rows: DataFrame) -> DataFrame:
    """Rows of single turns (conv_id, turn, role, text) to one record per conversation."""
    items = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    plain = F.transform(F.col("items"), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy("conv_id").agg(items.alias("items")).select("conv_id", plain.alias("messages"))


def chat_report(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted conversations."""
    lines = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    back = formatted.select(
        "conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("back"),
        loss_text(F.col("segments")).alias("learnt"),
    )
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("back", lines), "")).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        sha(F.col("learnt")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
