"""Near-duplicate lines by an exact set-similarity join, using column expressions only.

A line is the set of its lower-cased words. A line goes when an earlier line (smaller
document id, then smaller line number) has a Jaccard similarity of ``threshold`` or more.

1. Rarity: words are counted by hash in a table of fixed size (``RARITY`` counters). A word's
   code is (logarithm of its count, hash); sorted codes put rare words first. Any fixed order
   of words makes the filters exact, the counts only make them sharp.
2. Lines with equal sets become one set, known by its earliest line.
3. Prefix filter: two sets of enough similarity share a word among their first
   ``n - ceil(t * n) + 1``. Every set is listed under each of those words.
4. A semi-join of the lists with themselves keeps sets that have a plausible partner: one
   whose length, position and parity bitmap leave room for enough shared words. A second
   one compares long sets, which short bitmaps cannot tell apart, by wide bitmaps.
5. In the list of a word, those sets meet the first few sets of the list and the one before them.
   Most members of a group of near copies are settled here, so no group is paired with itself.
   Sets that are still unsettled meet all earlier sets in their lists.
6. Candidates are verified on their whole sets. Lines that go are taken out of the texts.

Null texts stay null and have no lines; blank lines have no words, and stay. A null id sorts
before every id. Rows with the same id and text are one document and lose the same lines. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castwise.llm.common import NO_ID, maybe, membership, written

RARITY = 1 << 17
HUBS = 3
WIDE = 3
LONG = 48  # words from which a set has a wide parity


def _words(text: Column) -> Column:
    """Lower-cased words. Splitting at one plain blank is far cheaper than at a pattern, so other white space becomes blanks first."""
    plain = F.lower(text)
    for other in "\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _fp, _text``: rows of one id but different texts differ in ``_fp``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.hash(text).alias("_fp"), text.alias("_text")
    )


def _rarity(rows: DataFrame) -> Column:
    """A literal array: for each of ``RARITY`` hash buckets, 3 times the base-2 logarithm of its count.

    The driver gets ``RARITY`` small numbers, whatever the size of the input. Only the plan that lists sets holds them.
    """
    words = rows.select(F.explode(_words(F.replace(F.col("_text"), F.lit("\n"), F.lit(" ")))).alias("_w"))
    counts = words.groupBy(F.xxhash64("_w").bitwiseAND(F.lit(RARITY - 1)).alias("_b")).agg(F.count("*").alias("_c"))
    levels = [0] * RARITY
    found = counts.select("_b", (F.log2("_c") * 3).cast("int").alias("_r")).toArrow()
    for bucket, level in zip(found.column("_b").to_pylist(), found.column("_r").to_pylist()):
        levels[bucket] = level
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<int>")


def _codes(line: Column, rarity: Column) -> Column:
    """Distinct word codes of a line, rarest first."""

    def code(word: Column) -> Column:
        h = F.xxhash64(word)
        level = F.get(rarity, h.bitwiseAND(F.lit(RARITY - 1)).cast("int"))
        return level.cast("long") * F.lit(1 << 54) + h.bitwiseAND(F.lit((1 << 54) - 1))

    return F.sort_array(F.array_distinct(F.transform(_words(line), code)))


def _hashes(line: Column) -> Column:
    """Distinct word hashes of a line, in no order: enough to compare two sets."""
    return F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))


def _lines(rows: DataFrame) -> DataFrame:
    lines = rows.select("_id", "_fp", F.posexplode(F.split("_text", "\n")).alias("_line", "_words"))
    return lines.filter(F.length(F.btrim("_words", F.lit(" \t\x0b\x0c\r"))) > 0)


def _parity(codes: Column) -> Column:
    """64 bits, each the parity of the words hashed to it: its Hamming distance never exceeds the set difference."""
    return F.aggregate(
        codes,
        F.lit(0).cast("long"),
        lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))),
    )


def _wide(codes: Column) -> Column:
    """As ``_parity``, with ``64 * WIDE`` bits: sharp for long lines too."""
    own = lambda c: F.pmod(F.shiftright(c, 6), F.lit(WIDE))
    return F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda k: _parity(F.filter(codes, lambda c: own(c) == k)))


def _need(n: Column, m: Column, threshold: float) -> Column:
    """Words that sets of these sizes must share."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9).cast("int")


def _close(a: str, b: str, threshold: float) -> Column:
    """Length, position and parity filters for two listed sets (``a`` and ``b``)."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = _need(n, m, threshold)
    apart = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))
    # the cheapest filter that fails most often comes first
    return (
        (apart <= n + m - F.lit(2) * need)
        & (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9)
        & (F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos")) >= need)
    )


def _closer(a: str, b: str, threshold: float) -> Column:
    """``_close``, and the wide parity of long sets (null for short ones, which 64 bits tell apart)."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))) for k in range(WIDE)), F.lit(0))
    return _close(a, b, threshold) & F.coalesce(apart <= n + m - F.lit(2) * _need(n, m, threshold), F.lit(True))


def _at(s: str) -> Column:
    return F.struct(f"{s}.id", f"{s}.line", f"{s}.fp")


def _verified(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (``x`` later, ``y`` earlier; structs id, line, fp) the later ones whose whole sets agree."""
    ends = pairs.select("x").union(pairs.select("y")).distinct()
    known = membership(ends.select("x.*"), F.xxhash64("id", "fp"))
    texts = _lines(rows.filter(maybe(known, F.xxhash64("_id", "_fp"))))
    named = texts.select(F.struct(F.col("_id").alias("id"), F.col("_line").alias("line"), F.col("_fp").alias("fp")).alias("x"), "_words")
    lines = membership(ends.select("x.*"), F.xxhash64("id", "line", "fp"))
    named = named.filter(maybe(lines, F.xxhash64("x.id", "x.line", "x.fp")))
    sets = named.join(ends, "x", "left_semi").distinct()
    coded = sets.select("x", _hashes(F.col("_words")).alias("_set"))
    sets = written(coded.select("x", "_set", F.size("_set").alias("n"), _wide(F.col("_set")).alias("w")), "linesets")
    # sizes and 256 bits of both first: the sets themselves move only for pairs that may well agree
    mine = sets.select("x", F.struct("n", "w").alias("a"))
    other = sets.select(F.col("x").alias("y"), F.struct("n", "w").alias("b"))
    total = F.col("a.n") + F.col("b.n")
    apart = F.aggregate(F.zip_with("a.w", "b.w", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    likely = pairs.join(mine, "x").join(other, "y").filter(apart <= total - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * total - 1e-9))
    likely = written(likely.select("x", "y"), "likely")
    both = likely.join(sets.select("x", F.col("_set").alias("_a")), "x").join(sets.select(F.col("x").alias("y"), F.col("_set").alias("_b")), "y")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.filter(shared >= F.lit(threshold) * (F.size("_a") + F.size("_b") - shared) - 1e-9).select("x").distinct()


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8
) -> DataFrame:
    """``_id, _fp, _gone``: the numbers (from 0) of the lines that go, for documents that lose any."""
    rows = _keyed(docs, id_col, text_col)
    rarity = _rarity(rows)
    codes = _lines(rows).select("_id", "_fp", "_line", _codes(F.col("_words"), rarity).alias("_codes"))
    n = F.size("_codes")
    described = codes.select(
        F.struct(F.col("_id").alias("id"), F.col("_line").alias("line"), F.col("_fp").alias("fp")).alias("_at"),
        F.xxhash64("_codes").alias("_k1"),
        F.hash("_codes").alias("_k2"),
        n.alias("_n"),
        _parity(F.col("_codes")).alias("_bits"),
        F.when(n >= LONG, _wide(F.col("_codes"))).alias("_w"),
        # words are told apart by 32 bits here; a chance meeting only adds a candidate
        F.transform(F.slice("_codes", F.lit(1), n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1), lambda c: F.hash(c)).alias("_head"),
    )
    lines = written(described, "lines")
    sets = written(
        lines.groupBy("_k1", "_k2").agg(
            F.min("_at").alias("_at"), *[F.first(c).alias(c) for c in ("_n", "_bits", "_w", "_head")]
        ).withColumn("_set", F.monotonically_increasing_id()),  # written, so the numbers stay
        "sets",
    )
    listed = sets.select("_set", F.posexplode("_head").alias("pos", "word"), F.col("_n").alias("n"), F.col("_bits").alias("bits"))
    listed = listed.select("word", "_set", "n", "pos", "bits")
    # one pass over the lists leaves the sets that have a plausible partner; both sides share one shuffle
    meet = (F.col("me.word") == F.col("it.word")) & (F.col("me._set") != F.col("it._set")) & _close("me", "it", threshold)
    near = written(listed.alias("me").join(listed.alias("it"), meet, "left_semi"), "near")
    # long sets of few shared words pass 64 bits by chance, the more the longer the list: a second pass compares wide ones
    wide = [F.get("_w", F.lit(k)).alias(f"w{k}") for k in range(WIDE)]
    near = near.join(sets.select("_set", F.col("_at.*"), *wide), "_set")
    near = written(near.select("word", F.struct("id", "line", "fp", "n", "pos", "bits", *[f"w{k}" for k in range(WIDE)]).alias("me")), "near")
    meet = (F.col("a.word") == F.col("b.word")) & (_at("a.me") != _at("b.me")) & _closer("a.me", "b.me", threshold)
    near = written(near.alias("a").join(near.alias("b"), meet, "left_semi"), "lists")

    in_list = Window.partitionBy("word").orderBy("me")
    so_far = in_list.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hubs = F.array(*[F.nth_value("me", k).over(so_far) for k in range(1, HUBS + 1)], F.lag("me").over(in_list))
    first = near.select("me", hubs.alias("hubs")).select("me", F.explode("hubs").alias("hub")).filter(F.col("hub").isNotNull())
    first = first.filter((_at("hub") < _at("me")) & _closer("hub", "me", threshold))
    first = written(first.select(_at("me").alias("x"), _at("hub").alias("y")).distinct(), "pairs")
    settled = written(_verified(first, rows, threshold), "settled")

    open_rows = near.withColumn("x", _at("me")).join(settled, "x", "left_anti")
    index = near.select("word", F.col("me").alias("it"))
    second = (
        open_rows.join(index, "word")
        .filter((_at("it") < _at("me")) & _closer("it", "me", threshold))
        .select("x", _at("it").alias("y"))
        .distinct()
        .join(first, ["x", "y"], "left_anti")
    )
    later = _verified(written(second, "pairs"), rows, threshold)
    matched = settled.union(later).distinct().select(F.col("x").alias("_at"), F.lit(True).alias("_matched"))
    verdict = sets.select("_k1", "_k2", "_at").join(matched, "_at", "left")
    verdict = verdict.select("_k1", "_k2", F.col("_at").alias("_first"), "_matched")
    gone = lines.select("_k1", "_k2", "_at").join(verdict, ["_k1", "_k2"])
    gone = gone.filter(F.col("_matched").isNotNull() | (F.col("_at") != F.col("_first")))
    return gone.groupBy(F.col("_at.id").alias("_id"), F.col("_at.fp").alias("_fp")).agg(F.collect_set("_at.line").alias("_gone"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines``, ``n_removed``.

    Documents that lose every line keep their row, with an empty text. ``n_lines`` counts all
    lines, blank ones too; a null text has none.
    """
    gone = written(repeated_lines(docs, id_col, text_col, threshold), "gone")
    rows = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    rows = rows.withColumn("_fp", F.hash(F.coalesce(F.col(text_col), F.lit(""))))
    parts = F.split(text_col, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")
    text = F.array_join(F.transform(stay, lambda i: F.get(F.col("_parts"), i)), "\n")
    # texts that surely lose nothing are passed on where they are read
    loses = maybe(membership(gone, F.xxhash64("_id", "_fp")), F.xxhash64("_id", "_fp"))
    whole = rows.filter(~loses).withColumn("_gone", F.lit(None).cast("array<int>"))
    out = whole.unionByName(rows.filter(loses).join(gone, ["_id", "_fp"], "left").select(*rows.columns, "_gone"))
    out = out.withColumn("_parts", F.when(F.col("_gone").isNotNull(), parts))
    return out.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(F.split(text_col, "\n"))), F.lit(0)).alias("n_lines"),
        F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).alias("n_removed"),
    )
