"""Fill-in-middle: texts cut at two units into prefix, middle and suffix, written in another order.

A text is cut into fixed blocks of ``BLOCK`` bytes. Two Fenwick trees over the blocks hold how many units
end and how many code points begin in each; the place behind unit ``k`` is found by descending the unit
tree in steps of powers of two to its block, then by looking at that block's bytes alone. The code points
before the cut come from the other tree and the part of the block. Texts stay UTF-8 bytes all the way.

Units are code points, or the matches of a pattern, from left to right; what follows the last match
belongs to the last piece. The output is plain (the text itself) if the text is empty, holds a mark or is drawn
so, else prefix-suffix-middle or suffix-prefix-middle. All draws come from the digest of seed and id, so a row gives the same
output wherever and whenever it is computed; rows with one id draw alike. Null texts count as empty, a null id
as an empty id; repeated rows and further columns change nothing; an empty table gives an empty table.
Memory: a few MB of texts at a time, or one text if that is longer.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.llm.common import sliced

MARKS = ("<P>", "<S>", "<M>")
BLOCK = 4096
SEED = 1
PLAIN, SPM = 10, 20  # of 100


class BlockTree:
    """Fenwick tree over counts of blocks."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = np.arange(n + 1)
        self.tree = sums - sums[at - (at & -at)]  # node i covers the lowbit(i) blocks that end at i
        self.top = 1 << n.bit_length() >> 1

    def total(self, blocks: int) -> int:
        """Sum of the first ``blocks`` counts."""
        out = 0
        while blocks:
            out += int(self.tree[blocks])
            blocks &= blocks - 1
        return out

    def descend(self, k: int) -> tuple[int, int]:
        """The block that holds the ``k``-th unit (from 1), and how many of it are left to count there."""
        at, step = 0, self.top
        while step:
            if at + step < len(self.tree) and self.tree[at + step] < k:
                at += step
                k -= int(self.tree[at])
            step >>= 1
        return at, k


class BlockText:
    """The bytes of one text with its two trees."""

    def __init__(self, data: bytes, unit: re.Pattern[bytes] | None = None):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        begins = (raw & 0xC0) != 0x80
        if unit is None:
            self.ends = np.append(begins[1:], True) if len(raw) else begins
        else:
            self.ends = np.zeros(len(raw), bool)
            self.ends[[m.end() - 1 for m in unit.finditer(data) if m.end() > m.start()]] = True
        self.begins = begins
        starts = np.arange(0, len(raw), BLOCK)
        count = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
        self.units, self.points = BlockTree(count(self.ends)), BlockTree(count(begins))
        self.n = self.units.total(len(starts))
        self.n_chars = self.points.total(len(starts))

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the place behind unit ``k``; 0 is the start of the text."""
        if k == 0:
            return 0, 0
        block, left = self.units.descend(k)
        lo = block * BLOCK
        inside = int(np.flatnonzero(self.ends[lo : lo + BLOCK])[left - 1]) + 1
        return lo + inside, self.points.total(block) + int(np.count_nonzero(self.begins[lo : lo + inside]))


def _cut(unit: str | None, marks: tuple[str, str, str], plain: int, spm: int):
    """Batch function: ``_id, _text, _a .. _d`` to ``_id, n, form, prefix_chars, middle_chars, output``."""
    p, s, m = [mark.encode() for mark in marks]

    def run(batches):
        pattern = re.compile(unit.encode()) if unit else None
        for batch in sliced(batches, "_text"):
            rows = zip(batch.column("_text").cast(pa.large_binary()).to_pylist(), *[batch.column(c).to_pylist() for c in ("_a", "_b", "_c", "_d")])
            ns, forms, heads, middles, outputs = [], [], [], [], []
            for text, a, b, c, d in rows:
                body = BlockText(text, pattern)
                ns.append(body.n)
                if not text or p in text or s in text or m in text or c % 100 >= 100 - plain:
                    found = ("plain", None, None, text)
                else:
                    cuts = sorted((a % (body.n + 1), b % (body.n + 1)))
                    (lo, chars), (hi, more) = body.cut(cuts[0]), body.cut(cuts[1])
                    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
                    if d % 100 < spm:
                        found = ("spm", chars, more - chars, b"".join((s, suffix, p, prefix, m, middle)))
                    else:
                        found = ("psm", chars, more - chars, b"".join((p, prefix, s, suffix, m, middle)))
                for out, value in zip((forms, heads, middles, outputs), found):
                    out.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(ns, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(heads, pa.int64()),
                    pa.array(middles, pa.int64()),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                ["_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_{c}") for i, c in enumerate("abcd")]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str | None = None,
    seed: int = SEED,
    plain: int = PLAIN,
    spm: int = SPM,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output`` for every row.

    ``unit`` is a pattern over UTF-8 bytes (``None``: code points); ``plain`` and ``spm`` are shares of 100.
    ``n`` counts units, the lengths count code points. Marks must begin with a character they do not hold again.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    rows = docs.select(F.col(id_col).alias("_id"), text, *draws(id_col, seed))
    schema = f"_id {dict(docs.dtypes)[id_col]}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_cut(unit, marks, plain, spm), schema).withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, rebuilt from output and form."""
    p = F.split(output, "|".join(re.escape(mark) for mark in marks), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))


def fill_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of outputs and of the texts rebuilt from them."""
    out = fill_in_middle(docs, id_col, text_col)
    whole = restored(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256")]
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars", *digests)
