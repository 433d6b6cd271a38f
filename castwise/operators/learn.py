"""Learned routers: scaler, class weights, logistic router, gradient-fitted softmax routers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.functions.columns import ratio, softmax
from castwise.schemas import STABLE
from castwise.session import lookup_table, written


# --- scaler and class weights ---------------------------------------------------


def fit_scaler(df: DataFrame, cols: Sequence[str], split: str | None = "vali") -> DataFrame:
    """Mean and population std per config and column (long): one aggregation, no join.

    A zero std becomes 1.
    """
    rows = df if split is None else df.filter(F.col("split") == split)
    wide = rows.groupBy("config_name").agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols]
    )
    return wide.unpivot(["config_name"], list(cols), "feature", "_m").select(
        "config_name",
        "feature",
        F.col("_m.mean").alias("mean"),
        F.when(F.col("_m.std") > 0, F.col("_m.std")).otherwise(F.lit(1.0)).alias("std"),
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns standardised by their config's scaler.

    The scaler is pivoted to one row per config and joined; its size does not
    depend on the rows.
    """
    wide = scaler.groupBy("config_name").pivot("feature", list(cols)).agg(F.first(F.struct("mean", "std"), ignorenulls=True))
    renamed = lookup_table(wide, "scaler").select("config_name", *[F.col(c).alias(f"_s_{c}") for c in cols])
    j = df.join(renamed, "config_name")
    scaled = {c: (F.col(c) - F.col(f"_s_{c}.mean")) / F.col(f"_s_{c}.std") for c in cols}
    return j.withColumns(scaled).drop(*[f"_s_{c}" for c in cols])


def class_weights(labels: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Balanced weight ``n / (classes * count)`` per config and expert on vali; 0 when absent."""
    vali = labels.filter(F.col("split") == "vali")
    wide = vali.groupBy("config_name").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("oracle_model") == e).alias(e) for e in experts]
    )
    classes = sum(((F.col(e) > 0).cast("int") for e in experts), F.lit(0))
    long = wide.withColumn("_k", classes).unpivot(["config_name", "_n", "_k"], list(experts), "oracle_model", "label_count")
    weight = F.coalesce(ratio(F.col("_n"), F.col("_k") * F.col("label_count")), F.lit(0.0))
    return long.select("config_name", "oracle_model", "label_count", weight.alias("class_weight"))


# --- linear routers as column expressions ------------------------------------------


@dataclass
class LinearRouter:
    """Standardise, multiply, softmax; one row of coefficients per expert."""

    experts: list[str]
    features: list[str]
    center: list[float]
    scale: list[float]
    coef: list[list[float]]
    intercept: list[float]
    history: list[float] = field(default_factory=list)


def linear_weights(router: LinearRouter) -> Column:
    """Weight array of a linear router: plain arithmetic, so it stays in generated code."""
    logits = []
    for row, b in zip(router.coef, router.intercept):
        z = F.lit(float(b))
        for name, w, m, s in zip(router.features, row, router.center, router.scale):
            z = z + F.lit(float(w)) * ((F.col(name) - F.lit(float(m))) / F.lit(float(s)))
        logits.append(z)
    return softmax(F.array(*logits))


def score_router(router: LinearRouter, features: DataFrame, split: str | None = "test") -> DataFrame:
    """Stable columns and weights of the rows to route."""
    rows = features if split is None else features.filter(F.col("split") == split)
    return rows.select(*STABLE, linear_weights(router).alias("weights"))


def score_routers(routers: dict[str, LinearRouter], features: DataFrame, split: str | None = "test") -> DataFrame:
    """Per-config routers on one scan: a CASE over the few configs picks the coefficients."""
    rows = features if split is None else features.filter(F.col("split") == split)
    expr = None
    for name, router in routers.items():
        w = linear_weights(router)
        expr = F.when(F.col("config_name") == name, w) if expr is None else expr.when(F.col("config_name") == name, w)
    return rows.select(*STABLE, expr.alias("weights"))


# --- hard-label logistic router ------------------------------------------------


@dataclass
class LogisticFit:
    """Spark ML model, mean loss without penalty, largest gradient entry with it, and training rows."""

    model: object
    loss: float
    gradient_norm: float
    rows: int


def fit_logistic_router(
    features: DataFrame, labels: DataFrame, cols: Sequence[str], experts: Sequence[str], max_iter: int = 100, tol: float = 1e-6
) -> tuple[DataFrame, LogisticFit]:
    """Multinomial logistic regression of the oracle expert on the features, one config.

    Returns the routed test rows and the fit.  Penalty and class weights
    follow the usual balanced setting with unit inverse penalty.  The gradient at the end is summed once more over the
    training rows, so that convergence is told by the objective and not by the solver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.functions import array_to_vector

    weights = class_weights(labels, experts)
    seen = weights.filter("label_count > 0").agg(F.count(F.lit(1)).alias("k"), F.sum("label_count").alias("n")).first()
    if (seen["k"] or 0) < 2:
        raise ValueError("fewer than two oracle labels on vali")
    scaled = apply_scaler(features, fit_scaler(features, cols), cols)
    index = F.array_position(F.array(*[F.lit(e) for e in experts]), F.col("oracle_model")) - 1
    lab = labels.select("sample_key", "oracle_model")
    vec = array_to_vector(F.array(*[F.col(c) for c in cols])).alias("x")
    data = scaled.join(lab, "sample_key").withColumn("label", index.cast("double"))
    train = (
        data.filter(F.col("split") == "vali")
        .join(lookup_table(weights.select("config_name", "oracle_model", "class_weight"), "weights"), ["config_name", "oracle_model"])
        .select(vec, "label", "class_weight")
    )
    train = written(train, "logistic")
    penalty = 1.0 / seen["n"]
    lr = LogisticRegression(
        featuresCol="x",
        labelCol="label",
        weightCol="class_weight",
        family="multinomial",
        maxIter=max_iter,
        regParam=penalty,
        standardization=False,
        tol=tol,
    )
    model = lr.fit(train)
    # classes that vali lacks have no weight in the sums below, as in the fit
    coef = model.coefficientMatrix.toArray().T
    net = NetRouter(list(experts), np.zeros(len(cols)), np.ones(len(cols)), [coef, model.interceptVector.toArray()])
    rows = train.select(vector_to_array("x").alias("x"), F.col("label").cast("int").alias("label"), "class_weight")
    loss, g = _evaluate(rows, net, _class_batch(net.center, net.scale), _flat(net.params))
    g[: coef.size] += penalty * coef.ravel()
    fit = LogisticFit(model, loss, float(np.abs(g).max()), int(seen["n"]))
    test = data.filter(F.col("split") == "test").select(*STABLE, vec)
    out = model.transform(test)
    return out.select(*STABLE, vector_to_array("probability").alias("weights")), fit


def per_config(fn: Callable[[str], DataFrame], df: DataFrame) -> DataFrame:
    """Run ``fn`` for each config (a handful) and union the results."""
    names = [r[0] for r in df.select("config_name").distinct().orderBy("config_name").collect()]
    return reduce(lambda a, b: a.unionByName(b), [fn(n) for n in names])


# --- gradient-fitted softmax routers -------------------------------------------------


@dataclass
class NetRouter:
    """Softmax router with at most one hidden layer; ``params`` are (weight, bias) pairs."""

    experts: list[str]
    center: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]
    history: list[float] = field(default_factory=list)
    steps: int = 0
    moments: tuple[np.ndarray, np.ndarray] | None = None  # of Adam, to go on from
    gradient_norm: float = float("nan")  # largest entry, penalty included, at ``params``
    converged: bool = False


def _forward(params: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden activations (or x), their slopes, and softmax weights.

    The activation is the Gaussian error unit in its tanh form: smooth, so that a gradient can reach zero.
    """
    h, slope = x, np.ones(1)
    if len(params) == 4:
        u = x @ params[0] + params[1]
        t = np.tanh(0.7978845608028654 * (u + 0.044715 * u**3))
        h = 0.5 * u * (1 + t)
        slope = 0.5 * (1 + t) + 0.5 * u * (1 - t * t) * 0.7978845608028654 * (1 + 3 * 0.044715 * u * u)
    z = h @ params[-2] + params[-1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return h, slope, e / e.sum(axis=1, keepdims=True)


def _fusion_gradient(params, x, preds, true, q, beta: float, lam: float) -> tuple[list[np.ndarray], float]:
    """Summed loss and gradient of one batch: SmoothL1 of the fused forecast + lam * KL(q || weights)."""
    h, bend, w = _forward(params, x)
    err = np.einsum("bm,bmt->bt", w, preds) - true
    small = np.abs(err) < beta
    loss = np.where(small, 0.5 * err**2 / beta, np.abs(err) - 0.5 * beta).mean(axis=1).sum()
    slope = np.where(small, err / beta, np.sign(err)) / err.shape[1]
    gw = np.einsum("bt,bmt->bm", slope, preds)
    gz = w * (gw - (w * gw).sum(axis=1, keepdims=True))
    if lam:
        loss += lam * (q * (np.log(np.maximum(q, 1e-300)) - np.log(np.maximum(w, 1e-300)))).sum()
        gz = gz + lam * (w - q)
    return _backward(params, x, h, bend, gz), float(loss)


def _class_gradient(params, x, y, row_weight) -> tuple[list[np.ndarray], float]:
    """Summed weighted cross-entropy and gradient of one batch."""
    h, bend, w = _forward(params, x)
    rows = np.arange(len(y))
    loss = -(row_weight * np.log(np.maximum(w[rows, y], 1e-300))).sum()
    gz = w.copy()
    gz[rows, y] -= 1.0
    gz *= row_weight[:, None]
    return _backward(params, x, h, bend, gz), float(loss)


def _backward(params, x, h, bend, gz) -> list[np.ndarray]:
    out = [h.T @ gz, gz.sum(axis=0)]
    if len(params) == 4:
        gh = (gz @ params[2].T) * bend
        out = [x.T @ gh, gh.sum(axis=0), *out]
    return out


def _initial(sizes: Sequence[int], seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    params: list[np.ndarray] = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = 1.0 / np.sqrt(a)
        params += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return params


def _flat(arrays: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _distributed_sum(data: DataFrame, params: list[np.ndarray], batch_gradient) -> np.ndarray:
    """Sum over all rows of (gradient, loss, rows or row weight).

    ``data`` has rows or, from :func:`packed`, blocks of rows. Each task adds them up and emits one row per parameter; Spark sums
    the rows, so the driver receives the size of the parameters, not of the data or
    of the task count.
    """
    cast = data.sparkSession.sparkContext.broadcast(params)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches):
            grads, loss, n = batch_gradient(cast.value, block)
            v = np.concatenate([_flat(grads), [loss, n]])
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    sums = data.mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.array([r["v"] for r in sorted(sums.collect())])
    cast.destroy()
    return out


def _unflatten(flat: np.ndarray, shapes: Sequence[Sequence[int]]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def _evaluate(data: DataFrame, net: NetRouter, batch_gradient, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss and gradient at ``theta``: one pass over the data."""
    total = _distributed_sum(data, _unflatten(theta, [p.shape for p in net.params]), batch_gradient)
    if len(total) == 0:
        raise ValueError("no training rows")
    return float(total[-2] / total[-1]), total[:-2] / total[-1]


def _adam(data: DataFrame, net: NetRouter, batch_gradient, epochs: int, lr: float, decay: float = 0.0) -> NetRouter:
    """``epochs`` more full-batch Adam steps; a net that was stored goes on with its moments and step number."""
    theta, shapes = _flat(net.params), [p.shape for p in net.params]
    m, v = net.moments or (np.zeros_like(theta), np.zeros_like(theta))
    history = list(net.history)
    for t in range(net.steps + 1, net.steps + epochs + 1):
        loss, g = _evaluate(data, net, batch_gradient, theta)
        history.append(loss)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta = theta * (1 - lr * decay) - lr * step
    return replace(net, params=_unflatten(theta, shapes), history=history, steps=net.steps + epochs, moments=(m, v))


CURVATURE_PAIRS = 10


def _quasi_newton(data: DataFrame, net: NetRouter, batch_gradient, most: int, tol: float, penalty: float = 0.0) -> NetRouter:
    """Limited-memory BFGS with a line search on the same gradient sums, until no entry of the gradient exceeds ``tol``.

    The objective is the mean loss and ``penalty / 2`` times the squared parameters. Every evaluation is one pass over the data;
    the driver holds ``CURVATURE_PAIRS`` pairs of parameter size. Ending at ``most`` steps, or where no step lowers
    the objective, leaves ``converged`` false.
    """

    def at(theta: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = _evaluate(data, net, batch_gradient, theta)
        return loss + 0.5 * penalty * float(theta @ theta), g + penalty * theta

    theta = _flat(net.params)
    value, g = at(theta)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    history, steps = [*net.history, value], 0
    while np.abs(g).max() > tol and steps < most:
        direction = -_two_loop(pairs, g)
        if not pairs:
            direction /= max(1.0, float(np.linalg.norm(g)))
        found = _line_search(at, theta, value, g, direction)
        if found is None and pairs:  # the curvature misleads: begin anew along the gradient
            pairs = []
            continue
        if found is None:
            break
        new, value, new_g = found
        s, y = new - theta, new_g - g
        if float(s @ y) > 1e-12 * float(y @ y):
            pairs = [*pairs, (s, y)][-CURVATURE_PAIRS:]
        theta, g, steps = new, new_g, steps + 1
        history.append(value)
    norm = float(np.abs(g).max())
    params = _unflatten(theta, [p.shape for p in net.params])
    return replace(net, params=params, history=history, steps=net.steps + steps, gradient_norm=norm, converged=norm <= tol)


def _two_loop(pairs: list[tuple[np.ndarray, np.ndarray]], g: np.ndarray) -> np.ndarray:
    """The inverse Hessian that the pairs describe, times ``g``."""
    q, used = g.copy(), []
    for s, y in reversed(pairs):
        a = float(s @ q) / float(s @ y)
        q -= a * y
        used.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(pairs, reversed(used)):
        q += s * (a - float(y @ q) / float(s @ y))
    return q


def _line_search(at, theta: np.ndarray, value: float, g: np.ndarray, direction: np.ndarray, tries: int = 25):
    """A step that lowers the objective enough and flattens the slope (weak Wolfe), by doubling and bisection."""
    slope = float(g @ direction)
    if slope >= 0:
        return None
    low, high, step, best = 0.0, np.inf, 1.0, None
    for _ in range(tries):
        new = theta + step * direction
        new_value, new_g = at(new)
        if not np.isfinite(new_value) or new_value > value + 1e-4 * step * slope:
            high = step
        else:
            best = (new, new_value, new_g)
            if float(new_g @ direction) >= 0.9 * slope:
                return best
            low = step
        step = 2 * low if np.isinf(high) else (low + high) / 2
    return best


def _matrix(column: pa.Array) -> np.ndarray:
    """Array column of equal lengths as a matrix."""
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _cube(column: pa.Array) -> np.ndarray:
    """Array-of-arrays column as (rows, experts, horizon)."""
    inner = column.flatten()
    return np.asarray(inner.flatten(), dtype=float).reshape(len(column), len(inner) // len(column), -1)


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column, dtype=float)


READERS = {"x": _matrix, "y_preds": _cube, "y_true": _matrix, "errors": _matrix, "label": _numbers, "class_weight": _numbers}
PACK = 512  # rows of a packed block


def packed(data: DataFrame, name: str = "packed") -> DataFrame:
    """Training rows written once as blocks of ``PACK`` rows, each column of a block the bytes of one array of doubles.

    Training passes over its rows many times; blocks are read without opening a list per row. ``_shapes`` has
    the shape of each array, ``data`` columns of ``READERS``.
    """
    cols = data.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                {c: READERS[c](batch.column(c).slice(at, PACK)) for c in cols} for at in range(0, batch.num_rows, PACK)
            ]
            if found:
                shapes = [[list(block[c].shape) for c in cols] for block in found]
                columns = [pa.array([block[c].tobytes() for block in found], pa.binary()) for c in cols]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shapes, pa.list_(pa.list_(pa.int64())))], names=[*cols, "_shapes"])

    schema = ", ".join(f"{c} binary" for c in cols) + ", _shapes array<array<long>>"
    return written(data.mapInArrow(run, schema), name)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of every block of rows, packed or not."""
    for batch in batches:
        cols = [c for c in batch.schema.names if c != "_shapes"]
        if batch.num_rows == 0:
            continue
        if "_shapes" not in batch.schema.names:
            yield {c: READERS[c](batch.column(c)) for c in cols}
            continue
        for i, shapes in enumerate(batch.column("_shapes").to_pylist()):
            yield {c: np.frombuffer(batch.column(c)[i].as_buffer()).reshape(shape) for c, shape in zip(cols, shapes)}


def _moments(data: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population std of every position of ``x`` in packed rows; std 0 -> 1. Two passes: sums, then squares about the mean."""

    def sums(of: Callable[[np.ndarray], np.ndarray]) -> list:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                v = of(block["x"])
                parts = [np.arange(v.shape[1]), np.full(v.shape[1], len(v)), v.sum(axis=0), v.min(axis=0), v.max(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], names=["i", "n", "s", "low", "high"])

        per_block = data.select("x", "_shapes").mapInArrow(partial, "i long, n long, s double, low double, high double")
        return sorted(per_block.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect())

    found = sums(lambda x: x)
    if len(found) != dim:
        raise ValueError(f"expected {dim} inputs, found {len(found)}")
    # kept between the extremes, so that the mean of equal values is that value
    center = np.array([min(max(r["s"] / r["n"], r["low"]), r["high"]) for r in found])
    scale = np.array([np.sqrt(r["s"] / r["n"]) for r in sums(lambda x: (x - center) ** 2)])
    return center, np.where(scale > 0, scale, 1.0)


def _fitted(data: DataFrame, net: NetRouter, batch, epochs: int, lr: float, decay: float, tol: float | None) -> NetRouter:
    if tol is None:
        return _adam(data, net, batch, epochs, lr, decay)
    return _quasi_newton(data, net, batch, epochs, tol, decay)


def _fusion_batch(center: np.ndarray, scale: np.ndarray, beta: float, tau: float, lam: float):
    """Gradient sums of batches with ``x, y_preds, y_true, errors``."""

    def batch(params, rows):
        x = (rows["x"] - center) / scale
        q = None
        if lam:
            e = np.exp(-(rows["errors"] - rows["errors"].min(axis=1, keepdims=True)) / tau)
            q = e / e.sum(axis=1, keepdims=True)
        grads, loss = _fusion_gradient(params, x, rows["y_preds"], rows["y_true"], q, beta, lam)
        return grads, loss, len(x)

    return batch


def fit_fusion_router(
    data: DataFrame,
    experts: Sequence[str],
    dim: int,
    hidden: int = 0,
    epochs: int = 20,
    lr: float = 0.05,
    beta: float = 0.01,
    tau: float = 1.0,
    lam: float = 0.0,
    decay: float = 0.0,
    seed: int = 16,
    tol: float | None = None,
    resume: NetRouter | None = None,
) -> NetRouter:
    """Softmax router trained on the fused forecast error.

    ``data`` has ``x`` (inputs), ``y_preds``, ``y_true`` and ``errors`` (one per expert),
    and is read once; it is packed for the passes over it, unless :func:`packed` gave it.  With
    ``hidden=0`` this is the linear fusor; ``lam > 0`` adds KL to the error softmax.

    Without ``tol`` it takes ``epochs`` Adam steps; with it, quasi-Newton steps until no entry of the gradient exceeds
    ``tol``, ``epochs`` at most (``converged`` tells), and ``decay`` is a penalty on squared parameters. ``resume`` is
    a net fitted before: its inputs stay scaled as they were, and Adam goes on as if it had not stopped.
    """
    rows = data if "_shapes" in data.columns else packed(data.select("x", "y_preds", "y_true", "errors"))
    if resume:
        start = resume
    else:
        center, scale = _moments(rows, dim)
        start = NetRouter(list(experts), center, scale, _initial([dim, hidden, len(experts)] if hidden else [dim, len(experts)], seed))
    batch = _fusion_batch(start.center, start.scale, beta, tau, lam)
    return _fitted(rows, start, batch, epochs, lr, decay, tol)


def fit_class_router(
    data: DataFrame,
    experts: Sequence[str],
    dim: int,
    hidden: int = 16,
    epochs: int = 30,
    lr: float = 0.05,
    decay: float = 0.0,
    seed: int = 16,
    tol: float | None = None,
    resume: NetRouter | None = None,
) -> NetRouter:
    """Softmax router trained on the oracle label with balanced class weights.

    ``data`` has ``x``, ``label`` (expert position) and ``class_weight``; ``tol`` and ``resume`` as for :func:`fit_fusion_router`.
    """
    rows = data if "_shapes" in data.columns else packed(data.select("x", "label", "class_weight"))
    if resume:
        start = resume
    else:
        center, scale = _moments(rows, dim)
        start = NetRouter(list(experts), center, scale, _initial([dim, hidden, len(experts)] if hidden else [dim, len(experts)], seed))
    batch = _class_batch(start.center, start.scale)
    return _fitted(rows, start, batch, epochs, lr, decay, tol)


def _class_batch(center: np.ndarray, scale: np.ndarray):
    """Gradient sums of batches with ``x, label, class_weight``."""

    def batch(params, rows):
        x = (rows["x"] - center) / scale
        w = rows["class_weight"]
        grads, loss = _class_gradient(params, x, rows["label"].astype(int), w)
        return grads, loss, w.sum()

    return batch


def fusion_gradient(data: DataFrame, router: LinearRouter, beta: float = 0.01, tau: float = 1.0, lam: float = 0.0) -> DataFrame:
    """Mean loss and gradient of a linear fusor at its coefficients: ``expert, input, gradient, loss`` (input ``bias`` last).

    ``data`` as for :func:`fit_linear_fusor`. One pass; the result has the size of the coefficients.
    """
    net = linear_net_from(router)
    batch = _fusion_batch(net.center, net.scale, beta, tau, lam)
    loss, g = _evaluate(_fusor_rows(data, router.features), net, batch, _flat(net.params))
    w, b = _unflatten(g, [p.shape for p in net.params])
    rows = [(e, f, float(w[j, i]), loss) for i, e in enumerate(router.experts) for j, f in enumerate(router.features)]
    rows += [(e, "bias", float(b[i]), loss) for i, e in enumerate(router.experts)]
    return data.sparkSession.createDataFrame(rows, "expert string, input string, gradient double, loss double")


def linear_router_from(net: NetRouter, features: Sequence[str]) -> LinearRouter:
    """A fitted linear fusor as column expressions."""
    w, b = net.params
    return LinearRouter(
        net.experts, list(features), net.center.tolist(), net.scale.tolist(), w.T.tolist(), b.tolist(), net.history
    )


def linear_net_from(router: LinearRouter) -> NetRouter:
    """A linear router in the form of the fitted ones."""
    params = [np.array(router.coef).T, np.array(router.intercept)]
    return NetRouter(list(router.experts), np.array(router.center), np.array(router.scale), params, list(router.history))


def _fusor_rows(inputs: DataFrame, features: Sequence[str]) -> DataFrame:
    return inputs.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), "y_preds", "y_true", "errors")


def fit_linear_fusor(
    inputs: DataFrame,
    features: Sequence[str],
    experts: Sequence[str],
    epochs: int = 20,
    lr: float = 0.05,
    beta: float = 0.01,
    decay: float = 0.0,
    tol: float | None = None,
    resume: NetRouter | None = None,
) -> NetRouter:
    """Linear softmax fusor on the feature columns of a fusion input table (vali rows); see :func:`fit_fusion_router`."""
    data = _fusor_rows(inputs, features)
    return fit_fusion_router(data, experts, len(features), 0, epochs, lr, beta, decay=decay, tol=tol, resume=resume)


def score_net(net: NetRouter, df: DataFrame, keep: Sequence[str], x: str = "x") -> DataFrame:
    """Weights of a router with a hidden layer, over Arrow batches."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, _, w = _forward(net.params, (_matrix(batch[x]) - net.center) / net.scale)
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            weights = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], weights], names=[*keep, "weights"])

    return df.select(*keep, x).mapInArrow(run, schema)


# --- model table ------------------------------------------------------------------


def save_model(spark: SparkSession, net: NetRouter, signature: dict, path: str) -> None:
    """One-row model table with the settings it was fitted with and what training needs to go on."""
    moments = [None if net.moments is None else [float(v) for v in x] for x in (net.moments or (None, None))]
    row = (
        json.dumps(signature, sort_keys=True),
        list(net.experts),
        [float(v) for v in net.center],
        [float(v) for v in net.scale],
        [float(v) for v in _flat(net.params)],
        json.dumps([list(p.shape) for p in net.params]),
        [float(v) for v in net.history],
        net.steps,
        *moments,
        net.gradient_norm,
        net.converged,
    )
    schema = (
        "signature string, experts array<string>, center array<double>, scale array<double>, "
        "params array<double>, shapes string, history array<double>, steps long, "
        "first_moment array<double>, second_moment array<double>, gradient_norm double, converged boolean"
    )
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, signature: dict) -> NetRouter:
    """Load a model, to score with or to train on; refused when its settings differ from ``signature``."""
    row = spark.read.parquet(path).first()
    want = json.dumps(signature, sort_keys=True)
    if row["signature"] != want:
        raise ValueError(f"model settings differ: stored {row['signature']}, asked {want}")
    params = _unflatten(np.array(row["params"]), json.loads(row["shapes"]))
    moments = None if row["first_moment"] is None else (np.array(row["first_moment"]), np.array(row["second_moment"]))
    return NetRouter(
        row["experts"], np.array(row["center"]), np.array(row["scale"]), params, row["history"], row["steps"], moments,
        row["gradient_norm"], row["converged"],
    )


def label_share(labels: DataFrame) -> DataFrame:
    """Share of each oracle label per config and split."""
    g = labels.groupBy("config_name", "split", "oracle_model").agg(F.count(F.lit(1)).alias("label_count"))
    w = W.partitionBy("config_name", "split")
    return g.withColumn("label_share", ratio(F.col("label_count"), F.sum("label_count").over(w)))
