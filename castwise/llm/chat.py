"""Chat records of different layouts as canonical turns, and turns as marked text with a loss mask.

``canonical_turns`` fingerprints the schema of every record: the nested field paths (``messages[].role``)
that any layout names are sorted and hashed, and the hash selects a declarative mapping (``LAYOUTS``).
Fields that no layout names do not count, so further metadata does not change the layout. ``formatted``
writes turns under a template that marks them and escapes the marks inside texts; ``read_back`` and
``loss_texts`` recover turns and trained text from its output alone. Columns only.

Null texts and roles count as empty. A record without text, that is not JSON, or whose fingerprint is
unknown keeps its row: ``layout`` and ``turns`` are null. A list without elements gives no turns and an
empty text. Repeated records are formatted each by itself. Rows of one turn number are ordered by role and
text; a null turn number comes first and a null conversation id is a conversation of its own. Empty tables
give empty tables; further columns are passed on by ``canonical_turns`` and ``formatted`` and ignored by
``records_of_rows``. A conversation is one training text, so it is one value in one row, however long.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLES = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"
CHUNK = 256  # lengths summed at a time in a running total


@dataclass(frozen=True)
class Said:
    """One turn from plain fields; texts of several are joined by an empty line. ``?`` marks a field that may be missing."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    """Turns from a list of objects; ``inner`` names the text field where the content is itself a list of parts."""

    path: str
    role: str
    text: str
    inner: str = ""


@dataclass(frozen=True)
class Layout:
    name: str
    turns: tuple[Said | Listed, ...]
    renames: dict[str, str] = field(default_factory=dict)


SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turns", (Listed("turns", "role", "text"),)),
    Layout("messages", (Said("system", ("system?",)), Listed("messages", "role", "content"))),
    Layout("message_parts", (Said("system", ("system?",)), Listed("messages", "role", "content", "text"))),
    Layout("conversations", (Said("system", ("system?",)), Listed("conversations", "from", "value")), SPOKEN),
    Layout("instruction", (Said("system", ("system?",)), Said("user", ("instruction", "input?")), Said("assistant", ("output",)))),
    Layout("instruction_response", (Said("system", ("system?",)), Said("user", ("instruction", "context?")), Said("assistant", ("response",)))),
    Layout("prompt_completion", (Said("system", ("system?",)), Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("prompt_response", (Said("system", ("system?",)), Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Layout("question_answer", (Said("system", ("system?",)), Said("user", ("context?", "question")), Said("assistant", ("answer",)))),
)


def forms(layout: Layout) -> list[tuple[str, ...]]:
    """Every set of field paths that the layout covers."""
    choices: list[list[tuple[str, ...]]] = []
    for part in layout.turns:
        if isinstance(part, Listed):
            inner = f"[].{part.inner}" if part.inner else ""
            full = (f"{part.path}[].{part.role}", f"{part.path}[].{part.text}{inner}")
            choices.append([full, (f"{part.path}[]",)])
        else:
            for name in part.fields:
                choices.append([(name.rstrip("?"),), ()] if name.endswith("?") else [(name,)])
    return [tuple(sorted(sum(picked, ()))) for picked in itertools.product(*choices)]


def _digest(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def known_fingerprints(layouts: Sequence[Layout]) -> dict[str, str]:
    """Fingerprint to layout name; of two layouts with one form the earlier is taken."""
    found: dict[str, str] = {}
    for layout in layouts:
        for form in forms(layout):
            found.setdefault(_digest(form), layout.name)
    return found


def field_paths(record: Column) -> Column:
    """Paths of all scalar fields of a variant: names joined by points, ``[]`` behind lists.

    The schema Spark gives for the value is read once from left to right; a stack holds the path of every open value.
    """
    word = r"`(?:[^`]|``)*`: |\w+: |OBJECT<|ARRAY<|>|\w+(?:\(\d+,\s*\d+\))?"
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(f"({word})"), F.lit(1))
    start = F.struct(F.array(F.lit("")).alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(state: Column, token: Column) -> Column:
        top, rest = F.element_at(state["open"], -1), F.slice(state["open"], 1, F.size(state["open"]) - 1)
        named = F.concat(top, F.when(top == "", "").otherwise("."), F.regexp_replace(token, ": $", ""))
        is_name, is_list = token.endswith(": "), token == "ARRAY<"
        is_end, is_object = token == ">", token == "OBJECT<"
        now_open = (
            F.when(is_name, F.concat(state["open"], F.array(named)))
            .when(is_list, F.concat(state["open"], F.array(F.concat(top, F.lit("[]")))))
            .when(is_object, state["open"])
            .otherwise(rest)
        )
        leaf = ~(is_name | is_list | is_end | is_object)
        paths = F.when(leaf, F.concat(state["paths"], F.array(top))).otherwise(state["paths"])
        return F.struct(now_open.alias("open"), paths.alias("paths"))

    return F.aggregate(tokens, start, step)["paths"]


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Digest of the sorted field paths that some layout names."""
    named = sorted({path for layout in layouts for form in forms(layout) for path in form})
    mine = F.array_sort(F.array_intersect(field_paths(record), F.array(*[F.lit(p) for p in named])))
    return F.sha2(F.array_join(mine, "\n"), 256)


def _turn_of(part: Listed, renames: dict[str, str], item: Column) -> Column:
    text = item[part.text]
    if part.inner:
        text = F.array_join(F.transform(text, lambda piece: F.coalesce(piece[part.inner], F.lit(""))), "")
    role = F.coalesce(item[part.role], F.lit(""))
    named = reduce(lambda rest, pair: F.when(role == pair[0], pair[1]).otherwise(rest), renames.items(), role)
    return F.struct(named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(record: Column, layout: Layout) -> Column:
    """The turns of a record of this layout."""
    lists = []
    for part in layout.turns:
        if isinstance(part, Said):
            texts = [F.try_variant_get(record, f"$.{name.rstrip('?')}", "string") for name in part.fields]
            given = F.filter(F.array(*texts), lambda t: t.isNotNull() & (t != ""))
            needed = F.lit(not all(name.endswith("?") for name in part.fields))
            turn = F.struct(F.lit(part.role).alias("role"), F.array_join(given, "\n\n").alias("text"))
            lists.append(F.when(needed | (F.size(given) > 0), F.array(turn)).otherwise(F.array().cast(TURNS)))
            continue
        inner = f"array<struct<`{part.inner}`:string>>" if part.inner else "string"
        items = F.try_variant_get(record, f"$.{part.path}", f"array<struct<`{part.role}`:string,`{part.text}`:{inner}>>")

        lists.append(F.coalesce(F.transform(items, partial(_turn_of, part, layout.renames)), F.array().cast(TURNS)))
    return F.concat(*lists)


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` (role, text) to records given as variants or JSON texts."""
    kind = dict(records.dtypes)[record_col]
    record = F.col(record_col) if kind == "variant" else F.try_parse_json(F.col(record_col))
    out = records.withColumn("_record", record).withColumn("fingerprint", fingerprint(F.col("_record"), layouts))
    names = F.create_map(*[F.lit(x) for pair in known_fingerprints(layouts).items() for x in pair])
    out = out.withColumn("layout", names[F.col("fingerprint")])
    turns = reduce(
        lambda rest, layout: F.when(F.col("layout") == layout.name, _mapped(F.col("_record"), layout)).otherwise(rest),
        reversed(layouts),
        F.lit(None).cast(TURNS),
    )
    return out.withColumn("turns", turns).drop("_record")


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col, record``: rows by turn gathered into one record a conversation, of layout ``turns``."""
    turn = F.struct(
        F.col(turn_col).alias("at"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    listed = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    plain = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return listed.select(id_col, F.to_variant_object(F.struct(plain.alias("turns"))).alias("record"))


def escaped(text: Column) -> Column:
    """One more backslash between every ``<`` and ``|`` that have only backslashes between them: no mark is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_line(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def _role_of(line: Column) -> Column:
    return F.replace(F.replace(unescaped(line), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside functions over lists, which compute what they mention for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column) -> Column:
    """Sums of all earlier lengths; by chunks, so that long lists do not take quadratic time."""
    zero, add = F.lit(0).cast("long"), lambda a, b: a + b

    def chunk_starts(sizes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(CHUNK))
        sums = F.transform(starts, lambda s: F.aggregate(F.slice(sizes, s, CHUNK), zero, add))
        return F.aggregate(sums, F.array(zero), lambda found, s: F.concat(found, F.array(F.element_at(found, -1) + s)))

    def totals(sizes: Column, before: Column) -> Column:
        within = lambda i: F.aggregate(F.slice(sizes, i - i % CHUNK + 1, i % CHUNK), zero, add)
        return F.transform(sizes, lambda _, i: F.get(before, F.floor(i / CHUNK).cast("int")) + within(i))

    return _let(lengths, lambda sizes: _let(chunk_starts(sizes), lambda before: totals(sizes, before)))


def formatted(turns: DataFrame, turns_col: str = "turns", loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``.

    ``loss_mask`` has a span of code points for every turn's text (``start``, ``stop`` exclusive, ``loss`` where it is trained on).
    """
    head = F.transform(F.col(turns_col), lambda t: F.concat(F.lit(START), _role_line(t["role"]), F.lit("\n")))
    out = turns.withColumn("_heads", head).withColumn("_texts", F.transform(F.col(turns_col), lambda t: escaped(t["text"])))
    pieces = F.zip_with("_heads", "_texts", lambda h, t: F.concat(h, t, F.lit(END)))
    sizes = F.zip_with("_heads", "_texts", lambda h, t: (F.length(h) + F.length(t) + len(END)).cast("long"))
    out = out.withColumn("formatted", F.array_join(pieces, "")).withColumn("_starts", running(sizes))
    texts = F.zip_with("_heads", "_texts", lambda h, t: F.struct(F.length(h).alias("skip"), F.length(t).alias("take")))
    spans = F.zip_with("_starts", texts, lambda s, t: F.struct((s + t["skip"]).alias("start"), (s + t["skip"] + t["take"]).alias("stop")))
    trained = lambda s, t: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), t["role"].isin(*loss_roles).alias("loss"))
    return out.withColumn("loss_mask", F.zip_with(spans, F.col(turns_col), trained)).drop("_heads", "_texts", "_starts")


def segments(text: Column) -> Column:
    """The turns of a formatted text with their marks, but without the closing one."""
    return _let(F.split(text, re.escape(END.rstrip("\n")) + "\n", -1), lambda parts: F.slice(parts, 1, F.size(parts) - 1))


def read_back(text: Column) -> Column:
    """Turns (role, text) parsed from a formatted text."""

    def turn(part: Column) -> Column:
        at = F.locate("\n", part)
        role = _role_of(F.substring(part, F.lit(len(START) + 1), at - len(START) - 1))
        return F.struct(role.alias("role"), unescaped(F.substring(part, at + 1, F.length(part))).alias("text"))

    return F.transform(segments(text), turn)


def loss_texts(parts: Column, mask: Column) -> Column:
    """Texts under the mask, unescaped and in order; ``parts`` are the ``segments`` of the formatted text."""
    starts = running(F.transform(parts, lambda p: (F.length(p) + len(END)).cast("long")))
    placed = F.zip_with(parts, starts, lambda p, s: F.struct(p.alias("part"), s.alias("at")))
    cut = F.zip_with(
        placed, mask, lambda p, m: F.when(m["loss"], F.substring(p["part"], (m["start"] - p["at"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int")))
    )
    return F.transform(F.filter(cut, lambda c: c.isNotNull()), unescaped)


def chat_digests(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of turns and of trained text, read from ``formatted`` and ``loss_mask``."""
    out = chats.withColumn("_turns", read_back(F.col("formatted"))).withColumn("_parts", segments(F.col("formatted")))
    out = out.withColumn("_loss", F.array_join(loss_texts(F.col("_parts"), F.col("loss_mask")), ""))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        id_col,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
