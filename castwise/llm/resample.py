"""Importance resampling towards a target: hashed word n-grams, gains by bucket, a draw of the highest scores.

A block of text has its own Aho-Corasick dictionary: every distinct word of the block, bounded by a delimiter on both
sides, carries its CRC, the CRC with a space before it, and its length. One scan of the block emits the payloads in
order; the CRC of a run of words is composed from adjacent payloads (a CRC moves over ``n`` more bytes by a
linear map), so no run of words is ever built as text. The CRC modulo the number of buckets is the bucket of the run.
The dictionary belongs to its block of about ``BLOCK`` bytes: memory is bounded and no word is left out, however many
words the corpus has. Blocks end at delimiters; a longer word makes a longer block.

Counting sums buckets inside every task first, so at most ``BUCKETS`` rows leave a task. Gains are a list of
``BUCKETS`` numbers. Scores add the gains over the runs of a text, and a draw from the double exponential distribution, made
from the digest of seed and id. The highest scores are found by ranks over range pieces.

Null and empty texts have no features and weight 0; they count in no rank unless they have ``LEAST`` words. Equal scores are
ordered by id (null first, its draw is that of an empty id); repeated rows get adjoining ranks. Empty tables give empty
tables (an empty target leaves every gain at what the counts say); further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwise.llm.common import sliced, written
from castwise.operators.ordering import with_rank

BUCKETS = 10_000
ORDER = 3
LEAST = 20
PERCENT = 5
SEED = 42
BLOCK = 1 << 20
POLYNOMIAL = 0xEDB88320  # of the CRC, lowest power first
IN_WORDS = [b for b in range(256) if b >= 0x80 or chr(b).isalnum()]
PLAIN = bytes(ord(chr(b).lower()) if b < 0x80 and b in IN_WORDS else b if b in IN_WORDS else 0x20 for b in range(256))


def _times_x(value: int) -> int:
    return (value >> 1) ^ (POLYNOMIAL if value & 1 else 0)


@functools.lru_cache(maxsize=512)
def shift_table(n: int) -> np.ndarray:
    """4 x 256 numbers: what ``n`` more bytes make of each byte of a CRC."""
    power, square, left = 1 << 31, 1 << 23, n  # x^0, and x^8 as the first square
    while left:
        if left & 1:
            power = _product(power, square)
        square, left = _product(square, square), left >> 1
    bits, value = [0] * 32, power  # bit 31 stands for x^0
    for bit in range(31, -1, -1):
        bits[bit], value = value, _times_x(value)
    table = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for j in range(8):
            table[k, 1 << j : 2 << j] = table[k, : 1 << j] ^ np.uint32(bits[8 * k + j])
    return table


def _product(a: int, b: int) -> int:
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = _times_x(b)
    return out


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs after ``by`` more zero bytes."""
    sizes, which = np.unique(by, return_inverse=True)
    if not len(sizes):
        return crc
    tables = np.concatenate([shift_table(int(n)).reshape(-1) for n in sizes])
    base = which * 1024
    out = tables[base + (crc & 0xFF)]
    for k in (1, 2, 3):
        out ^= tables[base + 256 * k + (crc >> np.uint32(8 * k) & 0xFF)]
    return out


def _blocks(data: bytes):
    """Start and end of blocks that end at a delimiter."""
    at = 0
    while at < len(data):
        end = len(data) if at + BLOCK >= len(data) else data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield at, end
        at = end


def scan(data: bytes):
    """For every block of ``data`` (lower-cased, other bytes spaces) its words in order: end, CRC, CRC behind a space, length with the space."""
    for lo, hi in _blocks(data):
        text = data[lo:hi].decode("latin-1")
        words = list(set(text.split(" ")) - {""})
        if not words:
            continue
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            automaton.add_word(f" {word} ", i)
        automaton.make_automaton()
        hits = np.fromiter(itertools.chain.from_iterable(automaton.iter(f" {text} ")), np.int64).reshape(-1, 2)
        raw = [word.encode("latin-1") for word in words]
        crc = np.array([zlib.crc32(w) for w in raw], np.uint32)
        spaced = np.array([zlib.crc32(b" " + w) for w in raw], np.uint32)
        size = np.array([len(w) + 1 for w in raw], np.int64)
        which = hits[:, 1]
        yield hits[:, 0] - 1 + lo, crc[which], spaced[which], size[which]


def features(texts: list[bytes]):
    """Block by block: texts (by number) of its words; texts and buckets of all runs of 1 to ``ORDER`` words that end in it."""
    data = b" ".join(texts).translate(PLAIN)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    last = [np.zeros(0, t) for t in (np.int64, np.uint32, np.uint32, np.int64)]  # the last words of earlier blocks
    for ends, *payload in scan(data):
        old = len(last[0])
        mine = np.searchsorted(starts, ends - 1, side="right") - 1
        doc, crc, spaced, size = last = [np.concatenate(pair) for pair in zip(last, (mine, *payload))]
        owners, buckets, run = [mine], [crc[old:] % BUCKETS], crc
        for n in range(1, ORDER):
            run = shifted(run[:-1], size[n:]) ^ spaced[n:]  # run k begins at word k
            new = max(0, old - n)
            same = np.flatnonzero(doc[new : len(doc) - n] == doc[new + n :]) + new
            owners.append(doc[same])
            buckets.append(run[same] % BUCKETS)
        last = [part[max(0, len(part) - ORDER + 1) :] for part in last]
        yield mine, np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def _count(batches):
    """Batch function: ``bucket, n`` summed over a task."""
    sums = np.zeros(BUCKETS, np.int64)
    for batch in sliced(batches, "_text"):
        for _, _, buckets in features(batch.column("_text").to_pylist()):
            sums += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used], pa.int64())], ["bucket", "n"])


def _texts(docs: DataFrame, text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text")


def bucket_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket, n``: features of all rows by bucket; a bucket without features has no row."""
    return docs.select(_texts(docs, text_col)).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """The gain of every bucket; both inputs are ``bucket_counts`` of at most ``BUCKETS`` rows."""
    both = source.select("bucket", F.lit(0).alias("kind"), "n").union(target.select("bucket", F.lit(1).alias("kind"), "n"))
    seen = np.zeros((2, BUCKETS), np.int64)
    for row in both.collect():  # 2 x BUCKETS rows at most
        seen[row["kind"], row["bucket"]] = row["n"]
    all_s, all_t = int(seen[0].sum()), int(seen[1].sum())
    odds = [((t + 1.0) * (all_s + BUCKETS)) / ((s + 1.0) * (all_t + BUCKETS)) for s, t in seen.T.tolist()]
    return [math.floor(1000 * math.log(x)) for x in odds]


def noise(seed: int, doc_id: int | None) -> int:
    """The draw of a row, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: list[int], seed: int):
    """Batch function: ``_id, _text`` to ``_id, n_words, n_features, weight, score``."""

    def run(batches):
        table = np.array(gain, np.int64)
        for batch in sliced(batches, "_text"):
            ids = batch.column("_id").to_pylist()
            words, weight = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for mine, owner, bucket in features(batch.column("_text").to_pylist()):
                words += np.bincount(mine, minlength=len(ids))
                np.add.at(weight, owner, table[bucket])
            n = sum(np.maximum(words - k, 0) for k in range(ORDER))
            score = weight + np.array([noise(seed, i) for i in ids], np.int64)
            columns = [batch.column("_id"), *[pa.array(x, pa.int64()) for x in (words, n, weight, score)]]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "n_features", "weight", "score"])

    return run


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``_id, n_words, n_features, weight, score`` for every row."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, "text"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), _texts(docs, text_col))
    return rows.mapInArrow(_score(gain, seed), "_id long, n_words long, n_features long, weight long, score long")


def importance_ranks(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least: int = LEAST, seed: int = SEED
) -> DataFrame:
    """``id_col, n_features, weight, score, rank``: of the rows with ``least`` words, ``percent`` of 100 are drawn and ranked from 1."""
    scores = written(importance_scores(docs, target, id_col, text_col, seed), "scores")
    able = scores.filter(F.col("n_words") >= least).withColumn("_down", -F.col("score"))
    drawn = percent * able.count() // 100
    ranked = with_rank(able, ["_down", "_id", "n_features", "weight"], (), "rank").withColumn("rank", F.col("rank") + 1)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    out = ranked.withColumn("rank", rank).drop("_down")
    rest = scores.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The drawn rows with all their columns and ``rank``. Ids must not repeat among rows of different texts."""
    ranks = importance_ranks(docs, target, id_col, text_col, percent).filter("rank is not null")
    drawn = written(ranks.groupBy(F.col(id_col).alias("_drawn")).agg(F.min("rank").alias("rank")), "drawn")
    return docs.join(drawn, F.col(id_col).cast("long").eqNullSafe(F.col("_drawn"))).drop("_drawn")
