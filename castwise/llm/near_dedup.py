"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

1. Words are ASCII-lower-cased runs of non-space bytes; a document's set holds the 64-bit
   hashes of its distinct shingles of ``size`` words (a shorter text is one shingle).
2. One permutation: a shingle's mixed hash names one of ``BINS`` bins and the value kept there
   if smallest. Empty bins are filled by optimal densification: bin b tries the bins
   g(b, 1), g(b, 2), ... of a fixed 2-universal hash until one was filled by a shingle.
3. ``BANDS`` bands of ``ROWS`` bins are bucket keys. Rows with equal sets are one class first,
   known by the smallest id, so copies never meet in a bucket.
4. In each bucket a star joins every class with a hub, so a bucket of n gives n - 1 pairs. Pairs
   are confirmed on full sets (``100 * shared >= percent * union``), links are closed to components,
   and buckets that still hold several components get further stars, whose hubs are the classes
   with most new links, then classes picked by a hash; ``rounds`` limits these.
5. What the stars leave is settled in one pass: in every bucket that still holds several components, each
   class outside the largest one meets every class of another component (see ``_rest``), so every pair
   that shares a bucket is compared, or known to be in one component already.

A pair of similarity 0.8 misses all buckets with probability (1 - 0.8^ROWS)^BANDS, about 3e-5.

Null and empty texts and texts without words have empty sets and stand alone. A null id sorts
before every id. Rows with one id share a component. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwise.llm.common import given_id, maybe, membership, rows_of, without, written

BANDS, ROWS = 56, 8
BINS = BANDS * ROWS
PARITY = 16  # longs of parity bits of a set
PART = 1000  # classes of a bucket that meet in one piece of the last pass
WORDS_KEPT = 200_000  # word hashes remembered by a task; beyond that they are computed again
PIECE = 8 << 20  # bytes of text handled at once


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _probes() -> np.ndarray:
    """For each bin, the order in which it looks at other bins when it is empty."""
    bins = np.arange(BINS, dtype=np.uint64)[:, None]
    tries = np.arange(1, 4 * BINS + 1, dtype=np.uint64)[None, :]
    return (_mix(bins * np.uint64(1_000_003) + tries) % np.uint64(BINS)).astype(np.int32)


PROBES = _probes()


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    if len(known) > WORDS_KEPT:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words, known)
    k = min(size, len(words))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x100000001B3) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """Band keys of a set by one-permutation hashing with optimal densification."""
    mixed = _mix(s + np.uint64(0x5DEECE66D))
    bins = (mixed % np.uint64(BINS)).astype(np.int64)
    sketch = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(sketch, bins, mixed)
    filled = np.zeros(BINS, dtype=bool)
    filled[bins] = True
    empty = np.flatnonzero(~filled)
    for t in range(PROBES.shape[1]):  # few turns unless the set is tiny
        if not len(empty):
            break
        source = PROBES[empty, t]
        hit = filled[source]
        sketch[empty[hit]] = sketch[source[hit]]
        empty = empty[~hit]
    sketch[empty] = mixed.min()  # all tries failed
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * np.uint64(0x100000001B3) + sketch[r::ROWS])
    return keys


def parity(s: np.ndarray) -> np.ndarray:
    """``PARITY`` longs: for each of 64 * PARITY bits, whether an odd number of the set's shingles fall on it."""
    odd = np.bincount((_mix(s + np.uint64(0x27D4EB2F)) >> np.uint64(20)) % np.uint64(64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch in pieces of bounded size."""
    ids, texts, used = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = t.as_py()
        ids.append(i)
        texts.append(text)
        used += len(text)
        if used >= PIECE:
            yield ids, texts
            ids, texts, used = [], [], 0
    if ids:
        yield ids, texts


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _describe(size: int):
    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            for ids, texts in _pieces(batch):
                sets = [shingles(t, size, known) for t in texts]
                keys = [xxhash.xxh3_128(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        _lists([signature(s) if len(s) else s for s in sets]),
                        _lists([parity(s) if len(s) else s for s in sets]),
                    ],
                    ["_id", "_n", "_key", "_bands", "_odd"],
                )

    return run


def _full(size: int):
    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            for ids, texts in _pieces(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), _lists([shingles(t, size, known) for t in texts])], ["_id", "_set"]
                )

    return run


def _confirmed(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a < b) those whose full sets are similar enough."""
    ends = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "_id"), "ends")
    wanted = rows.filter(maybe(membership(ends, F.xxhash64("_id")), F.xxhash64("_id")))
    sets = wanted.mapInArrow(_full(size), "_id long, _set array<long>").join(ends, "_id", "left_semi")
    # one row for each id, also where an id repeats with another text
    sets = written(sets, "sets").groupBy("_id").agg(F.max("_set").alias("_set"))
    left = sets.select(F.col("_id").alias("a"), F.col("_set").alias("_a"))
    right = sets.select(F.col("_id").alias("b"), F.col("_set").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - shared
    return pairs.join(left, "a").join(right, "b").filter(shared * 100 >= union * percent).select("a", "b")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``node, root``: the smallest node that can be reached, for every node of ``links`` (a, b).

    Large-star and small-star steps in turn (Kiveris et al., 2014): the edges never grow in number and
    the steps are about logarithmic in the longest path. Each step is written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m").alias("v")))
        after = written(small.filter("u <> v").distinct(), name)
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(members: DataFrame, roots: DataFrame | None, new: DataFrame | None, turn: int) -> DataFrame:
    """Candidate pairs (a < b): in each bucket with several components, a hub with every class of another component.

    The first hub is the smallest id. Later hubs are the classes with most links of the last turn (a copy leads to
    its original, and that to the other copies), else a class picked by a hash of the turn.
    """
    if roots is None:
        placed = members.withColumn("root", F.col("rep"))
        first = F.struct(F.col("rep"), F.col("rep").alias("hub"), F.col("root").alias("hub_root"))
    else:
        placed = members.join(roots, members.rep == roots.node, "left").select("k", "rep", F.coalesce("root", "rep").alias("root"))
        fresh = new.select(F.col("a").alias("rep")).union(new.select(F.col("b").alias("rep"))).groupBy("rep").agg((-F.count("*")).alias("fresh"))
        placed = placed.join(fresh, "rep", "left").withColumn("fresh", F.coalesce("fresh", F.lit(1)))
        first = F.struct("fresh", F.xxhash64(F.lit(turn), F.col("rep")), F.col("rep").alias("hub"), F.col("root").alias("hub_root"))
    hubs = (
        placed.groupBy("k")
        .agg(F.min(first).alias("h"), F.min("root").alias("low"), F.max("root").alias("high"))
        .filter("low <> high")
        .select("k", "h.hub", "h.hub_root")
    )
    met = placed.join(hubs, "k").filter("root <> hub_root")
    return met.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def _rest(members: DataFrame, roots: DataFrame | None, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a < b): every two classes of a bucket that are of different components.

    Two classes of the bucket's largest component need not meet, so only classes outside it are laid beside the others.
    Both sides are dealt into parts of about ``PART`` classes, so a large bucket is spread over tasks. A pair leaves the join
    only if it can be similar enough: similar sets have a difference of at most (100 - percent) / (100 + percent)
    of their summed sizes, which is not less than the difference in sizes nor than the number of unequal parity bits.
    """
    if roots is None:
        placed = members.withColumn("root", F.col("rep"))
    else:
        placed = members.join(roots, members.rep == roots.node, "left").select("k", "rep", F.coalesce("root", "rep").alias("root"))
    parts = placed.groupBy("k", "root").agg(F.count("*").alias("n")).groupBy("k")
    parts = parts.agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    pieces = F.ceil(F.col("n") / PART).cast("int")
    outer = F.ceil((F.col("n") - F.col("top.n")) / PART).cast("int")
    parts = parts.filter("low <> high").select("k", F.col("top.root").alias("main"), pieces.alias("pieces"), outer.alias("outer"))
    open_rows = written(placed.join(parts, "k").join(classes.select("rep", "_n", "_odd"), "rep"), "rest")
    own = F.xxhash64(F.lit(71), F.col("rep"))

    def side(rows: DataFrame, mine: str, other: str, at: str, beside: str, name: str) -> DataFrame:
        dealt = rows.withColumn(at, F.pmod(own, F.col(mine)).cast("int")).withColumn(beside, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        columns = [F.col(c).alias(f"{name}_{c}") for c in ("rep", "root", "_n", "_odd")]
        return dealt.select("k", "i", "j", *columns, *([F.col("main")] if name == "y" else []))

    x = side(open_rows.filter("root <> main"), "outer", "pieces", "i", "j", "x")
    y = side(open_rows, "pieces", "outer", "j", "i", "y")
    room = (F.col("x__n") + F.col("y__n")) * (100 - percent)
    unequal = sum((F.bit_count(F.col("x__odd")[w].bitwiseXOR(F.col("y__odd")[w])) for w in range(PARITY)), F.lit(0))
    once = (F.col("y_root") == F.col("main")) | (F.col("x_rep") < F.col("y_rep"))
    near = (F.abs(F.col("x__n") - F.col("y__n")) * (100 + percent) <= room) & (unequal * (100 + percent) <= room)
    met = x.join(y, ["k", "i", "j"]).filter((F.col("x_root") != F.col("y_root")) & once & near)
    return met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    rounds: int = 4,
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row; the smallest id of a component is kept.

    ``rounds``: stars per bucket, before the pass over all pairs that are left (``_rest``). Stars are cheap and join most
    copies; the result does not depend on their number. The loop ends early when they meet nothing new.
    """
    rows = rows_of(docs, id_col, text_col)
    seen = written(rows.mapInArrow(_describe(size), "_id long, _n long, _key binary, _bands array<long>, _odd array<long>"), "described")
    same = [F.first(c).alias(c) for c in ("_n", "_bands", "_odd")]
    classes = seen.filter("_key is not null").groupBy("_key").agg(F.min("_id").alias("rep"), *same)
    classes = written(classes, "classes")
    listed = classes.select("rep", F.explode("_bands").alias("k"))
    shared = listed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    members = written(listed.join(shared, "k").distinct(), "members")
    links, roots, tried, new = None, None, None, None
    for turn in range(rounds):
        pairs = _stars(members, roots, new, turn)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        new = written(_confirmed(pairs, rows, size, percent), "links")
        links = new if links is None else links.union(new)
        roots = components(links)
    pairs = _rest(members, roots, classes, percent)
    pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        new = _confirmed(pairs, rows, size, percent)
        roots = components(new if links is None else links.union(new))
    found = classes.select("_key", "rep")
    if roots is not None:
        found = found.join(roots, found.rep == roots.node, "left").select("_key", F.coalesce("root", "rep").alias("root"))
    else:
        found = found.select("_key", F.col("rep").alias("root"))
    # rows without words get a key of their own, so that they do not meet in one partition
    own = F.coalesce("_key", F.concat(F.lit("row "), F.col("_id").cast("string")).cast("binary"))
    out = seen.select("_id", "_n", own.alias("_key")).join(found, "_key", "left").withColumn("root", F.coalesce("root", "_id"))
    return out.select(
        given_id().alias(id_col), F.col("_n").alias("n_shingles"), given_id("root").alias("component_id"), (F.col("_id") == F.col("root")).alias("kept")
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """The rows that stay, one for each component, with all their columns."""
    gone = near_duplicates(docs, id_col, text_col, size, percent).filter(~F.col("kept")).select(F.col(id_col).alias("_gone"))
    return without(docs, gone, id_col)
