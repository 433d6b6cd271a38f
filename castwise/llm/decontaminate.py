"""Benchmark passages in documents, found by spaced seeds; column expressions only.

A mask is a fixed pattern of positions that count and positions that are ignored. Each mask laid
over a run of words gives a hash of the words that count, so a run in which an ignored word was replaced
still gives the same hash. Seeds of all benchmark items are joined with seeds of all documents (a filter of
fixed size drops nearly all document seeds before the join). A hit fixes how item and document lie side by
side; there the words are compared one by one and the best stretch is taken: a match counts 1, a replaced word
-2. An item is found if its best stretch has ``NEED`` equal words, or six tenths of its words if that is less.

Items shorter than the shortest mask (``min(SPANS)`` words) have one seed over all their words, so they are found where they
stand unchanged; documents get such seeds only for lengths that items have. Words are cut into overlapping blocks
of twice the length class of an item, so a text that repeats itself moves a bounded number of words for each way to lay an item beside it.

Words are lower-cased runs of non-space characters. Null and empty texts have no words. A null document or item id stays null in the result; rows of
one id are one document and items of one id one item (their longest stretch counts). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.llm.common import NO_ID, given_id, maybe, membership, rows_of, without, written

# The masks; 1 counts, 0 is ignored.
MASKS = ["11010111", "1110010011", "101100101001"]
SPANS = [len(m) for m in MASKS]
NEED = 10


def _words(text: Column) -> Column:
    plain = F.lower(text)
    for other in "\n\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def _seeds(rows: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """``_id, pos`` and one seed column for each mask and each short length (null where it reaches past the end)."""
    hashed = rows.select("_id", F.transform(_words(F.col("_text")), lambda w: F.xxhash64(w)).alias("_h"))
    size = F.size("_h")

    def seed(k: int, mask: str, i: Column) -> Column:
        counted = [F.get(F.col("_h"), i + o) for o, c in enumerate(mask) if c == "1"]
        return F.when(i + len(mask) <= size, F.xxhash64(F.lit(k), *counted)).alias(f"s{k}")

    masks = _masks(lengths)
    least = min(map(len, masks.values()))
    seeds = F.transform(F.sequence(F.lit(0), size - least), lambda i: F.struct(*[seed(k, m, i) for k, m in masks.items()]))
    return hashed.filter(size >= least).select("_id", F.posexplode(seeds).alias("pos", "s")).select("_id", "pos", "s.*")


def _masks(lengths: Sequence[int]) -> dict[int, str]:
    """All masks by number; a short length's mask counts every word."""
    return dict(enumerate(MASKS)) | {100 + n: "1" * n for n in lengths}


def _item_seeds(items: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Seeds of items: of all masks, or for a short item the one of its own length."""
    n = F.size(_words(F.col("_text")))
    tall = _tall(_seeds(items.filter(n >= min(SPANS)), []), MASKS_ONLY)
    for length in lengths:
        tall = tall.unionByName(_tall(_seeds(items.filter(n == length), [length]).select("_id", "pos", f"s{100 + length}"), [100 + length]))
    return tall


MASKS_ONLY = list(range(len(MASKS)))


def _tall(seeds: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """One row for each seed."""
    each = F.array(*[f"s{k}" for k in numbers])
    return seeds.select("_id", "pos", F.explode(each).alias("seed")).filter(F.col("seed").isNotNull())


BLOCK = 64  # words of the smallest length class


def _class(n: Column) -> Column:
    """Items of ``n`` words go by the next power of two."""
    return F.greatest(F.lit(BLOCK), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1)))))).cast("int")


def _blocks(rows: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``_id, _class, _block, _words``: block ``b`` of class ``c`` holds ``2 c`` words from word ``b c`` on."""
    words = rows.select("_id", _words(F.col("_text")).alias("_all"), F.explode(F.array(*[F.lit(c) for c in sizes])).alias("_class"))
    last = F.floor(F.greatest(F.size("_all") - 1, F.lit(0)) / F.col("_class")).cast("int")
    numbered = words.select("_id", "_class", "_all", F.explode(F.sequence(F.lit(0), last)).alias("_block"))
    return numbered.select("_id", "_class", "_block", F.slice("_all", F.col("_block") * F.col("_class") + 1, 2 * F.col("_class")).alias("_words"))


STRETCH = """
aggregate(_same, named_struct('i', 0, 'cur', 0, 'hits', 0, 'from', 0, 'best', 0, 'n', 0, 'lo', 0, 'hi', 0),
  (a, x) -> named_struct(
    'i', a.i + 1,
    'cur', greatest(a.cur + if(x, 1, -2), 0),
    'hits', if(a.cur + if(x, 1, -2) > 0, a.hits + if(x, 1, 0), 0),
    'from', if(a.cur + if(x, 1, -2) > 0, a.from, a.i + 1),
    'best', greatest(a.best, a.cur + if(x, 1, -2)),
    'n', if(a.cur + if(x, 1, -2) > a.best, a.hits + if(x, 1, 0), a.n),
    'lo', if(a.cur + if(x, 1, -2) > a.best, a.from, a.lo),
    'hi', if(a.cur + if(x, 1, -2) > a.best, a.i + 1, a.hi)))
"""


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document and item found in it: ``id_col, item_col, start_word, end_word, n_equal, item_words``."""
    rows, items = rows_of(docs, id_col, text_col), rows_of(benchmark, item_col, item_text)
    sizes = items.select(F.size(_words(F.col("_text"))).alias("n")).filter("n > 0").select("n", _class(F.col("n")).alias("c"))
    lengths = sorted(r.n for r in sizes.filter(F.col("n") < min(SPANS)).select("n").distinct().collect())  # fewer than the shortest mask
    classes = sorted(r.c for r in sizes.select("c").distinct().collect())  # powers of two
    wanted = written(_item_seeds(items, lengths).select("seed", F.col("_id").alias("item"), F.col("pos").alias("at")).distinct(), "seeds")
    known = membership(wanted, F.col("seed"))
    found = _seeds(rows, lengths)
    numbers = list(_masks(lengths))
    hit = F.lit(False)
    for k in numbers:
        hit = hit | F.coalesce(maybe(known, F.col(f"s{k}")), F.lit(False))
    hits = _tall(found.filter(hit), numbers).join(wanted, "seed")
    # which item of a length class is laid at which word of which document
    own = items.select(F.col("_id").alias("item"), _words(F.col("_text")).alias("_item")).filter(F.size("_item") > 0).distinct()
    shifts = hits.select("_id", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    hits = written(shifts.join(own.select("item", _class(F.size("_item")).alias("_class")).distinct(), "item"), "hits")
    holders = membership(hits, F.xxhash64("_id"))
    blocks = _blocks(rows.filter(maybe(holders, F.xxhash64("_id"))), classes or [BLOCK])
    needed = hits.withColumn("_block", F.floor(F.greatest("shift", F.lit(0)) / F.col("_class")).cast("int"))
    lines_up = needed.join(blocks, ["_id", "_class", "_block"]).join(own.withColumn("_class", _class(F.size("_item"))), ["item", "_class"])
    start, skip = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    window = F.slice("_words", start - F.col("_block") * F.col("_class") + 1, F.size("_item"))
    part = F.slice("_item", skip + 1, F.size("_item"))
    overlap = F.least(F.size("_window"), F.size("_part"))
    side = lines_up.select("_id", "item", start.alias("_start"), window.alias("_window"), part.alias("_part"), F.size("_item").alias("item_words"))
    same = F.zip_with(F.slice("_window", F.lit(1), overlap), F.slice("_part", F.lit(1), overlap), lambda a, b: a == b)
    best = side.select("_id", "item", "_start", "item_words", same.alias("_same")).withColumn("_b", F.expr(STRETCH))
    found = best.filter(F.col("_b.n") >= F.least(F.lit(NEED), F.ceil(F.col("item_words") * 0.6)))
    top = F.struct(
        F.col("_b.n").alias("n_equal"),
        (-(F.col("_start") + F.col("_b.lo"))).alias("first"),
        (F.col("_start") + F.col("_b.hi")).alias("end_word"),
        "item_words",
    )
    out = found.groupBy("_id", "item").agg(F.max(top).alias("t"))
    return out.select(
        given_id().alias(id_col),
        F.when(F.col("item") != NO_ID, F.col("item")).alias(item_col),
        (-F.col("t.first")).alias("start_word"),
        "t.end_word",
        "t.n_equal",
        "t.item_words",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in which no benchmark item was found."""
    hits = benchmark_hits(docs, benchmark, id_col, text_col)
    return without(docs, hits.select(F.col(id_col).alias("_gone")), id_col)
