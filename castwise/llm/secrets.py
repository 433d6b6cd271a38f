"""Secrets in texts: fixed forms, and random-looking strings by character Markov models. Column expressions only.

Fixed forms are ``assign`` (a named key and its value), ``access`` (access key ids) and ``hex`` (long hex runs). Beyond them,
words of ``LEAST`` or more characters of [A-Za-z0-9+/_=-] are candidates: two first-order Markov chains over
characters, one learned from random strings and one from ordinary identifiers, give a log-likelihood ratio;
words whose mean ratio per character exceeds ``MARGIN`` become spans of kind ``random``, unless a fixed form overlaps them.

Training uses labelled samples of bounded size: ``SAMPLES`` random strings (digests in hex and base64, labelled 1) and
identifiers made of the texts' own words (labelled 0; ``SAMPLES`` at most, those with the smallest hash). They only set the
transition tables; the search covers every whole text.

Spans count code points, ends exclusive. Null and empty texts have none. Rows are judged each for itself, so repeated
rows and null ids need no rule. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.llm.common import given_id, rows_of

# The forms looked for.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
LEAST = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
MARGIN = 0.25
SAMPLES = 20_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(ALPHABET) + 1


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches as (start, end, word): places come from the lengths of the pieces between matches."""
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    named = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(words)),
        F.arrays_zip(words.alias("w"), named.alias("g")),
        lambda gap, m: F.struct(gap.alias("gap"), F.length(m["w"]).alias("size"), m["g"].alias("word")),
    )
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    placed = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, m: F.struct(
            (a["at"] + m["gap"] + m["size"]).alias("at"),
            F.concat(
                a["out"],
                F.array(F.struct((a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["size"]).alias("end"), m["word"].alias("word"))),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _pairs(words: DataFrame) -> DataFrame:
    """Counts of neighbouring characters: ``a, b`` (places in ``ALPHABET``, 0 for others), ``n``; ``words`` has ``word, label``."""
    at = _places(F.col("word"))
    both = words.select("label", F.explode(F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return both.groupBy("label", "p.a", "p.b").agg(F.count("*").alias("n"))


def _places(word: Column) -> Column:
    return F.transform(F.split(word, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def labelled_samples(rows: DataFrame) -> DataFrame:
    """``word, label``: random strings (1) and identifiers made of words of the texts (0)."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    strings = rows.sparkSession.range(SAMPLES).select(
        F.when(F.col("id") % 3 == 0, F.left(digest, F.lit(40))).when(F.col("id") % 3 == 1, coded).otherwise(F.upper(F.left(digest, F.lit(32)))).alias("word"),
        F.lit(1).alias("label"),
    )
    some = rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLES // 20)
    texts = rows.join(F.broadcast(some.distinct()), "_id", "left_semi")  # SAMPLES / 20 numbers
    words = texts.select(F.explode(F.split("_text", " ")).alias("w")).filter(F.col("w").rlike("^[A-Za-z]{2,16}$"))
    words = words.distinct().orderBy(F.xxhash64("w"), "w").limit(SAMPLES)
    w = F.col("w")
    title = F.initcap(w)
    shapes = F.array(F.concat_ws("_", F.lower(w), F.reverse(F.lower(w)), F.lower(w)), F.concat(title, title, title), F.concat_ws("-", w, w), F.concat_ws("/", F.lower(w), w, F.upper(w)))
    ordinary = words.select(F.get(shapes, F.pmod(F.xxhash64(w), F.lit(4)).cast("int")).alias("word"), F.lit(0).alias("label"))
    return strings.union(ordinary)


def log_ratios(samples: DataFrame) -> Column:
    """Literal array: log P(b | a, random) - log P(b | a, ordinary) at place a * WIDTH + b; WIDTH^2 numbers for any input."""
    counts = [[[0.5] * WIDTH for _ in range(WIDTH)] for _ in range(2)]
    for r in _pairs(samples).collect():
        counts[r["label"]][r["a"]][r["b"]] += r["n"]
    values = []
    for a in range(WIDTH):
        r, o = counts[1][a], counts[0][a]
        values += [math.log(r[b] / sum(r)) - math.log(o[b] / sum(o)) for b in range(WIDTH)]
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def randomness(word: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio per step; above 0: more like a random string than like an identifier."""
    at = _places(word)
    steps = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.get(ratios, a * WIDTH + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(at) - 1, F.lit(1))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of ``KINDS``."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    said = F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
    return F.array_join(said, ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, spans`` (array of start, kind, end) and ``base`` (those of fixed forms)."""
    rows = rows_of(docs, id_col, text_col)
    ratios = log_ratios(labelled_samples(rows))
    text = F.col("_text")

    def kind(matches: Column, k: int, least: int) -> Column:
        enough = F.filter(matches, lambda m: F.length(m["word"]) >= least)
        return F.transform(enough, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    spotted = rows.select(
        "_id",
        kind(found(text, ASSIGN, 2), 0, 8).alias("_assign"),
        kind(found(text, ACCESS), 1, 16).alias("_access"),
        kind(found(text, HEX), 2, 32).alias("_hex"),
        found(text, CANDIDATE).alias("_words"),
    )
    based = spotted.withColumn("base", F.concat("_assign", "_access", "_hex"))
    free = F.filter("_words", lambda w: ~F.exists(F.col("base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    random = F.filter(free, lambda w: randomness(w["word"], ratios) > MARGIN)
    more = F.transform(random, lambda w: F.struct(w["start"].alias("start"), F.lit(3).alias("kind"), w["end"].alias("end")))
    return based.select(given_id().alias(id_col), "_assign", "_access", "_hex", "base", F.concat("base", more).alias("spans"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the fixed forms, the digest of their spans and all spans as one string, for every row."""
    spans = find_secrets(docs, id_col, text_col)
    return spans.select(
        id_col,
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
