"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows outside the held-out fifth (crc32(id) mod 5 = 0) train everything. At most ``SAMPLE`` of them are
used, those with the smallest hash of the id; this bounds the training, not what is scored.

1. Lexicon: words that stand in toxic training texts far more often than in others (ratio and
   log-likelihood test over distinct texts), ``LEXICON`` at most.
2. Features of a text: density and spread of lexicon words, their nearness to second-person words, capitals,
   punctuation, mixed-in signs, and lexicon words found only after undoing character swaps.
3. Trees are fitted on three of the four training remainders, and an isotonic curve maps their
   probability to a calibrated one on the fourth. One thousandth of the trees' own
   probability is mixed in, so that texts on one step of the curve keep their order.

Null and empty texts have zero features and get a score like any other. Null labels are not used. A null id counts
as the empty text in crc32; repeated rows are scored each. Where the labels lack a class, all scores are the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwise.llm.common import crc_mod, written

SAMPLE = 20_000
LEXICON = 500
NEAR = 6  # words between a lexicon word and a second-person word
HELD_OUT, CALIBRATION = 0, 1
FEATURES = [
    "hits", "distinct_hits", "density", "weight_density", "strongest", "near_you", "you_rate",
    "caps_rate", "shout_rate", "bang_rate", "sign_rate", "mixed_rate", "hidden_density", "stretched_rate",
]

# Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro".split()
)
# Usual character swaps.
SWAPS = str.maketrans("013457@$!|+", "oieastasiit")
BREAKS = str.maketrans({c: " " for c in ".,;:!?\"'()[]{}<>*#$%&@/\\|+=_~^`0123456789\n\t\r\x0b\x0c-–—…¡¿«»"})
ODD = re.compile(r"[^\s]*[^\W\d_][@$!|+*0-9._-]+[^\W\d_][^\s]*")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return text.lower().translate(BREAKS).split()


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Dense features of one text, in the order of ``FEATURES``."""
    words = words_of(text)
    n = max(len(words), 1)
    hits = [(i, w) for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[w] for _, w in hits]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near, k = 0, 0
    for i, _ in hits:
        while k < len(you) and you[k] < i - NEAR:
            k += 1
        near += k < len(you) and you[k] <= i + NEAR
    upper = sum(map(str.isupper, text)) if text != text.lower() else 0
    shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) if upper else 0
    odd = ODD.findall(text)
    hidden = sum(_plain(w) in lexicon for w in odd)
    size = max(len(text), 1)
    return [
        math.log1p(len(hits)), math.log1p(len({w for _, w in hits})), len(hits) / n, sum(weights) / n, max(weights, default=0.0),
        near / n, len(you) / n, upper / size, shouted / n, text.count("!") / size,
        sum(map(text.count, "#$%&*@")) / size, len(odd) / n, hidden / n, len(STRETCHED.findall(text)) / n,
    ]


def _plain(word: str) -> str:
    """A word with swaps undone and signs inside it dropped."""
    return "".join(LETTERS.findall(word.lower().strip(".,;:!?\"'()").translate(SWAPS).replace("*", "")))


def _with_features(lexicon: dict[str, float], kept: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            rows = [features(t.as_py(), lexicon) for t in texts]
            cols = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *cols], [*kept, *FEATURES])

    return run


def featured(rows: DataFrame, lexicon: dict[str, float], kept: list[str]) -> DataFrame:
    """``kept`` columns of ``rows`` and the features of ``_text``."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"{f} double" for f in FEATURES])
    return rows.mapInArrow(_with_features(lexicon, kept), schema)


def _distinct_words(batches):
    """``word, toxic``: each word of a text once."""
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            found = pa.array(sorted(set(words_of(text.as_py()))), pa.string())
            yield pa.RecordBatch.from_arrays([found, pa.array([label] * len(found), pa.int32())], ["word", "toxic"])


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Weights (log ratios) of words that mark toxic texts; ``labelled`` has ``_text`` and ``toxic``."""
    texts = labelled.groupBy(F.xxhash64("_text").alias("_h")).agg(F.first("_text").alias("_text"), F.max("toxic").cast("int").alias("toxic"))
    texts = texts.select("_text", "toxic")
    n = texts.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    bad, good = n["bad"] or 0, n["good"] or 0
    if not bad or not good:
        return {}
    counts = texts.mapInArrow(_distinct_words, "word string, toxic int").groupBy("word")
    counts = counts.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a"), F.col("b")
    ratio = F.log(((a + 0.5) / (bad + 1)) / ((b + 0.5) / (good + 1)))
    share = (a + b) / F.lit(bad + good)
    test = 2 * (a * F.log(a / (share * bad)) + F.when(b > 0, b * F.log(b / (share * good))).otherwise(0.0))
    top = counts.filter("a >= 3").select("word", ratio.alias("weight"), test.alias("test"))
    top = top.filter("weight > 2 and test > 10").orderBy(F.desc("test"), "word").limit(LEXICON)
    return {r["word"]: float(r["weight"]) for r in top.collect()}


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``."""
    rows = docs.select(
        F.col(id_col).alias("_id"), crc_mod(id_col, 5).alias("_fold"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = known.withColumn("_fold", crc_mod("_id", 5)).filter(F.col("_fold") != HELD_OUT)
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_id", "toxic")
    # SAMPLE rows of two numbers: a bounded broadcast
    labelled = written(rows.join(F.broadcast(sample), "_id").select("_fold", "_text", "toxic"), "labelled")
    classes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    held = (F.col("_fold") == HELD_OUT).alias("held_out")
    if len(classes) < 2:
        constant = float(next(iter(classes), 0))
        return rows.select(
            F.col("_id").alias(id_col), held, F.lit(constant).alias("score"), F.lit(int(constant >= 0.5)).alias("predicted")
        )
    lexicon = learn_lexicon(labelled.filter(F.col("_fold") != CALIBRATION))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    learn = written(featured(labelled, lexicon, ["_fold", "toxic"]), "features")
    learn = vector.transform(learn.withColumn("toxic", F.col("toxic").cast("double")))
    trees = GBTClassifier(labelCol="toxic", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, seed=7)
    fit = trees.fit(learn.filter(F.col("_fold") != CALIBRATION))
    raw = vector_to_array("probability")[1]
    held_back = fit.transform(learn.filter(F.col("_fold") == CALIBRATION)).select(raw.alias("raw"), "toxic")
    seen = {r["toxic"] for r in held_back.select("toxic").distinct().collect()}
    scored = fit.transform(vector.transform(featured(rows, lexicon, ["_id", "_fold"]))).select("_id", "_fold", raw.alias("raw"))
    if len(seen) == 2:
        curve = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="calibrated").fit(held_back)
        scored = curve.transform(scored)
    else:  # nothing to calibrate on
        scored = scored.withColumn("calibrated", F.col("raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("calibrated") + 0.001 * F.col("raw")))
    out = scored.select("_id", "_fold", score.alias("score"))
    return out.select(F.col("_id").alias(id_col), held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
