"""Mixing documents to target weights of domains, with soft membership; column expressions only.

1. Classifier: from a labelled table (id, domain) at most ``SAMPLE`` rows are used, those with the smallest hash of the
   id. Their words, hashed into ``BUCKETS``, give smoothed word probabilities for each domain (naive Bayes).
2. Posteriors: prior times exp(m * mean log-likelihood of the text's words), where m is the number of words, ``EVIDENCE`` at most: words of a
   text depend on each other, so a long text is no certainty. Texts without words get the prior.
3. Rates: nonnegative r_d such that the expected totals ``sum_d r_d n_d p_dk`` match the targets ``weight_k * budget`` in
   weighted least squares. The weights are the inverse of ``M = sum_d n_d p_d p_d^T``; in the metric of the token counts the
   gradient is then Lipschitz with constant one, so steps of length one are projected gradient steps:
   ``r_d = max(0, y_d - p_d . M^-1 (A y - T))``, where y adds a growing share of the last move to r (Nesterov). Each step is one aggregation of K sums over the documents; the rate of a document follows
   from the K numbers of each step, so nothing is collected and nothing but those numbers moves. Rates are written every few steps.

``copies`` is the rate rounded up or down by a hash of the id, with the right expectation. Null texts count as empty; null labels and ids in the labelled
table are not used; ids labelled twice count for their smallest domain. Domains without target get weight 0. Without labelled rows
all posteriors are equal. Repeated rows are rated each. An empty table gives an empty table. Extra columns pass through ``mix``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.llm.common import NO_ID, given_id, written
from castwise.llm.decontaminate import _words

SAMPLE = 20_000
BUCKETS = 4096
EVIDENCE = 50
STEPS = 200  # far more than needed: the loop ends when totals meet their targets or stand still
TOLERANCE = 1e-4  # of the budget
KEPT = 8  # steps between two writes of the rates


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _numbers(values) -> Column:
    """A literal array of doubles."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def word_models(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str) -> tuple[list[float], np.ndarray]:
    """Priors, and log word probabilities (domain x bucket). ``labelled`` has ``id_col`` and ``domain``."""
    known = labelled.filter(F.col(id_col).isNotNull() & F.col("domain").isin(domains))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min("domain").alias("domain"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    mine = texts.join(F.broadcast(sample), "_id")  # SAMPLE ids and names
    words = mine.select("domain", F.explode(_words(F.col("_text"))).alias("w"))
    counts = np.full((len(domains), BUCKETS), 0.5)
    for r in words.groupBy("domain", _bucket(F.col("w")).alias("b")).agg(F.count("*").alias("c")).collect():
        counts[domains.index(r["domain"]), r["b"]] += r["c"]
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    prior = [sizes.get(d, 0) + 0.5 for d in domains]
    return [p / sum(prior) for p in prior], np.log(counts / counts.sum(axis=1, keepdims=True))


def posteriors(
    docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``_id, n_tokens, p`` (array in the order of ``domains``) for every row."""
    prior, logs = word_models(docs, labelled, domains, id_col, text_col)
    tables = [_numbers(row - logs.mean(axis=0)) for row in logs]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.transform(_words(F.coalesce(text_col, F.lit(""))), _bucket).alias("_b"))
    n = F.size("_b")
    sums = F.aggregate(
        "_b",
        F.struct(*[F.lit(0.0).alias(f"s{k}") for k in range(len(domains))]),
        lambda a, b: F.struct(*[(a[f"s{k}"] + F.get(t, b)).alias(f"s{k}") for k, t in enumerate(tables)]),
    )
    rows = rows.select("_id", n.cast("long").alias("n_tokens"), sums.alias("_s"))
    scale = F.least(F.lit(float(EVIDENCE)), F.col("n_tokens").cast("double")) / F.greatest(F.col("n_tokens"), F.lit(1))
    scores = [F.lit(math.log(prior[k])) + scale * F.col(f"_s.s{k}") for k in range(len(domains))]
    scored = rows.select("_id", "n_tokens", F.array(*scores).alias("_l"))
    top = F.array_max("_l")
    odds = scored.select("_id", "n_tokens", F.transform("_l", lambda v: F.exp(v - top)).alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    return odds.select("_id", "n_tokens", F.transform("_e", lambda v: v / total).alias("p"))


def _momentum(count: int) -> list[float]:
    """Shares of the last move that steps 1, 2, ... add (Nesterov's sequence)."""
    t, out = 1.0, []
    for _ in range(count):
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        out.append((t - 1) / after)
        t = after
    return out


def _moved(steps: list[np.ndarray], push: list[float]) -> Column:
    """Rate ``r`` and point ``y`` of the next gradient, by folding the K numbers of each step over the stored ones."""
    first = F.struct(F.col("_r").alias("r"), F.col("_y").alias("y"))
    if not steps:
        return first
    width = len(steps[0])
    flat, push = _numbers(np.concatenate(steps)), _numbers(push)

    def step(a: Column, t: Column) -> Column:
        move = F.get(F.col("p"), F.lit(0)) * F.get(flat, t * width)
        for k in range(1, width):
            move = move + F.get(F.col("p"), F.lit(k)) * F.get(flat, t * width + k)
        r = F.greatest(F.lit(0.0), a["y"] - move)
        return F.struct(r.alias("r"), (r + F.get(push, t) * (r - a["r"])).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), first, step)


def fit_rates(members: DataFrame, weights: list[float], budget: float | None = None) -> tuple[DataFrame, dict]:
    """``members`` (``n_tokens, p`` and others) with a ``rate``, and what was reached."""
    k = range(len(weights))
    p = [F.get(F.col("p"), F.lit(i)) for i in k]
    pairs = [(i, j) for i in k for j in k if i <= j]
    first = members.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.col("n_tokens") * p[i] * p[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in pairs]
    ).first()
    n = float(first["n"])
    budget = n if budget is None else float(budget)
    target = np.array(weights, dtype=float) / sum(weights) * budget
    m = np.zeros((len(weights), len(weights)))
    for i, j in pairs:
        m[i, j] = m[j, i] = first[f"m{i}_{j}"]
    inverse = np.linalg.pinv(m, rcond=1e-12, hermitian=True)
    start = budget / n if n else 1.0
    state = members.withColumns({"_r": F.lit(start), "_y": F.lit(start)})
    push, steps, done = _momentum(STEPS), [], 0
    totals = np.full(len(weights), math.inf)
    for _ in range(STEPS if n else 0):
        here = push[done - len(steps) : done]
        sums = [F.sum(F.col("n_tokens") * F.col(f"_a.{c}") * p[i]).alias(f"{c}{i}") for c in "ry" for i in k]
        row = state.select("n_tokens", "p", _moved(steps, here).alias("_a")).agg(*sums).first()
        before, totals = totals, np.array([row[f"r{i}"] for i in k])
        if np.abs(totals - target).sum() < TOLERANCE * budget or np.abs(totals - before).sum() < TOLERANCE / 10 * budget:
            break
        if len(steps) == KEPT:  # the numbers of many steps would be folded again and again
            state = state.withColumn("_a", _moved(steps, here)).withColumns({"_r": F.col("_a.r"), "_y": F.col("_a.y")}).drop("_a")
            state, steps = written(state, "rates"), []
        steps.append(inverse @ (np.array([row[f"y{i}"] for i in k]) - target))
        done += 1
    rated = state.withColumn("rate", _moved(steps, push[done - len(steps) : done])["r"]).drop("_r", "_y")
    return rated, {"targets": target, "totals": totals, "steps": done}


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", budget: float | None = None
) -> DataFrame:
    """``id_col, n_tokens, p_<domain>..., rate, copies`` for every row of ``docs``."""
    domains = list(targets)
    members = written(posteriors(docs, labelled, domains, id_col, text_col), "members")
    rated, _ = fit_rates(members, list(targets.values()), budget)
    chance = F.pmod(F.xxhash64(F.lit("copies"), "_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rated.select(
        given_id().alias(id_col),
        "n_tokens",
        *[F.get(F.col("p"), F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)],
        "rate",
        (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
    )


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``mix_rate`` and ``mix_copies``; rows with rate 0 go."""
    rates = mixing_rates(docs, labelled, targets, id_col, text_col)
    rates = rates.groupBy(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_mix_id")).agg(F.max("rate").alias("mix_rate"), F.max("copies").alias("mix_copies"))
    mine = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.join(written(rates, "rates"), mine == F.col("_mix_id")).filter("mix_rate > 0").drop("_mix_id")


# Production parameters of the registered query and the pipeline: classes of the labels table.
TARGETS = {"good": 0.94, "poor": 0.05, "toxic": 0.01}


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` from quality and toxic labels; rows where either is missing are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    return labels.filter("toxic is not null and quality is not null").select("doc_id", domain.alias("domain"))
