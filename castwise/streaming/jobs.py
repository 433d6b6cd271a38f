"""Streams over arriving Parquet files.

Each function builds a streaming DataFrame or starts a query with
``availableNow``: it works off what has arrived and stops, and a restart with the
same checkpoint goes on where it ended.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from castwise.functions.columns import argmin_name
from castwise.operators.learn import LinearRouter, score_router
from castwise.schemas import FORECASTS_SCHEMA, STABLE


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_ingest(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    schema: StructType = FORECASTS_SCHEMA,
    files_per_trigger: int = 8,
    event_time: str | None = None,
    delay: str = "1 day",
) -> StreamingQuery:
    """Append arriving forecasts, each (sample, expert) once.

    Without ``event_time`` the seen keys are kept for good; with it they are dropped
    once the watermark has passed, which bounds the state of an endless stream.
    """
    rows = read_stream(spark, src, schema, files_per_trigger)
    if event_time:
        rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["sample_key", "model_name"])
    else:
        rows = rows.dropDuplicates(["sample_key", "model_name"])
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(dst)
    )


def oracle_sums(labels: DataFrame, experts: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Running oracle sums, expert sums and win counts (works on streams and tables)."""
    return labels.groupBy(*group).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum("oracle_value").alias("oracle_sum"),
        *[F.sum(e).alias(f"{e}_sum") for e in experts],
        *[F.count_if(F.col("oracle_model") == e).alias(f"{e}_wins") for e in experts],
    )


def stream_oracle_summary(
    labels: DataFrame, experts: Sequence[str], group: Sequence[str], dst: str, checkpoint: str
) -> StreamingQuery:
    """Keep the running summary table in ``dst`` up to date; state is one row per group."""

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(dst)

    return (
        oracle_sums(labels, experts, group)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace)
        .trigger(availableNow=True)
        .start()
    )


def label_states(forecasts: DataFrame, experts: Sequence[str], metric: str) -> DataFrame:
    """Per sample: first value of each expert, when the set became complete, last arrival.

    A streaming aggregation whose state lives in the JVM state store.  The arrival
    time is the time of the micro-batch, so the first arrival of an expert wins.
    """
    rows = forecasts.filter(F.col("model_name").isin(list(experts))).select(
        "sample_key", "model_name", F.col(metric).alias("value"), F.current_timestamp().alias("_at")
    )
    first = [
        F.min(F.when(F.col("model_name") == e, F.struct("_at", "value"))).alias(f"_f_{e}") for e in experts
    ]
    return rows.groupBy("sample_key").agg(*first, F.max("_at").alias("_last"))


def _label_rows(states: DataFrame, experts: Sequence[str]) -> DataFrame:
    """``label`` rows of samples completed by the last batch, ``late`` rows of samples complete before."""
    complete = F.lit(True)
    for e in experts:
        complete = complete & F.col(f"_f_{e}").isNotNull()
    done_at = F.greatest(*[F.col(f"_f_{e}._at") for e in experts])
    status = F.when(done_at == F.col("_last"), F.lit("label")).otherwise(F.lit("late"))
    values = {e: F.col(f"_f_{e}.value") for e in experts}
    return states.filter(complete).select(
        "sample_key",
        status.alias("status"),
        argmin_name(list(values.values()), experts).alias("oracle_model"),
        F.least(*values.values()).alias("oracle_value"),
        *[v.alias(e) for e, v in values.items()],
    )


def stream_labels(
    forecasts: DataFrame, experts: Sequence[str], metric: str, dst: str, checkpoint: str
) -> StreamingQuery:
    """Write the oracle label of a sample once all its experts have arrived.

    Rows that come after the label are written with status ``late`` (with the label
    that stands).  Each batch owns a folder, so a repeated batch overwrites itself.
    """

    def emit(batch: DataFrame, epoch: int) -> None:
        _label_rows(batch, experts).write.mode("overwrite").parquet(f"{dst}/batch={epoch}")

    return (
        label_states(forecasts, experts, metric)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(emit)
        .trigger(availableNow=True)
        .start()
    )


# the process that starts a stateful processor on the driver does not get the files given to the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABEL_SHARDS = 64
PIECE_SAMPLES = 1 << 15  # in an entry of a shard's list state


def _piece(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


class TimedLabels(StatefulProcessor):
    """Labels of the samples of one shard, many at once.

    State: pieces of a table with one row per open or lately finished sample (first value of every expert, whether it is labelled,
    time of its last row), packed, since every entry of a state crosses from Python to the JVM by itself. A timer wakes the shard when its earliest sample has been silent for ``wait_ms`` of event time; the
    sample then leaves the state, with status ``timeout`` if it is not labelled.
    """

    def __init__(self, experts: Sequence[str], wait_ms: int):
        self.experts, self.wait_ms = list(experts), wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = ["sample_key", "done", "last_ms", *[f"v{i}" for i in range(len(self.experts))]]
        self.samples = handle.getListState("samples", "piece binary")

    def _stored(self) -> pd.DataFrame:
        kinds = {"sample_key": object, "done": bool, "last_ms": "int64", **{n: float for n in self.names[3:]}}
        pieces = [pa.ipc.open_stream(bytes(r[0])).read_all().to_pandas() for r in self.samples.get()]
        held = pd.concat(pieces, ignore_index=True) if pieces else pd.DataFrame({n: [] for n in self.names})
        return held.astype(kinds).set_index("sample_key")

    def _store(self, held: pd.DataFrame, wake: bool) -> None:
        """``wake`` sets a timer for the sample that has been silent longest; one that fires too early is set anew."""
        if held.empty:
            self.samples.clear()
            return
        rows = pa.Table.from_pandas(held.rename_axis("sample_key").reset_index()[self.names], preserve_index=False)
        self.samples.put([(_piece(rows.slice(at, PIECE_SAMPLES)),) for at in range(0, len(rows), PIECE_SAMPLES)])
        if wake:
            self.handle.registerTimer(int(held["last_ms"].min()) + self.wait_ms)

    def _rows(self, held: pd.DataFrame, status: str) -> pd.DataFrame:
        values = held[self.names[3:]].set_axis(self.experts, axis=1)
        out = pd.DataFrame({"sample_key": held.index.astype(object), "status": status}, index=held.index, dtype=object)
        known = (held["done"] if status != "timeout" else held["done"] & False).to_numpy()
        best = values.fillna(float("inf")).to_numpy().argmin(axis=1) if len(held) else []
        out["oracle_model"] = pd.Series([self.experts[i] if ok else None for i, ok in zip(best, known)], held.index, dtype=object)
        out["oracle_value"] = values.min(axis=1).where(known)
        return pd.concat([out, values], axis=1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).dropna(subset=["expert", "value"]).sort_values(["at_ms", "value"])
        if new.empty:
            return
        stored = held = self._stored()
        late = new["sample_key"].isin(held.index[held["done"]])
        again = held.loc[new.loc[late, "sample_key"]]
        first = new.drop_duplicates(["sample_key", "expert"]).pivot(index="sample_key", columns="expert", values="value")
        first = first.reindex(columns=range(len(self.experts))).set_axis(self.names[3:], axis=1)
        held = held.reindex(held.index.union(first.index))
        values = held[self.names[3:]].combine_first(first)
        was_done = held["done"].eq(True)
        done = values.notna().all(axis=1)
        last = new.groupby("sample_key")["at_ms"].max().reindex(held.index)
        held = values.assign(done=done, last_ms=pd.concat([held["last_ms"], last], axis=1).max(axis=1).astype("int64"))
        self._store(held, wake=stored.empty)
        yield self._rows(held[done & ~was_done], "label")
        yield self._rows(again, "late")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._stored()
        over = held["last_ms"] + self.wait_ms <= timerValues.getCurrentWatermarkInMs()
        self._store(held[~over], wake=True)
        yield self._rows(held[over & ~held["done"]], "timeout")


def timed_labels(
    forecasts: DataFrame, experts: Sequence[str], metric: str, event_time: str, wait_ms: int, shards: int = LABEL_SHARDS
) -> DataFrame:
    """Labels as soon as a sample is complete, with bounded state: ``sample_key, status, oracle_model, oracle_value`` and the experts.

    ``label``: all experts are there (of repeated values the earliest in the first batch that has one counts); ``late``: one more
    row of a labelled sample, with the label that stands; ``timeout``: the sample was silent for ``wait_ms`` of event time. Rows
    without value or of other experts only move the clock (a filter on them would be pushed below the watermark).
    Needs a watermarked ``event_time`` and the RocksDB state store (see ``with_rocksdb``). Rows behind the watermark
    are dropped here; ``split_late`` keeps them. Samples are dealt to ``shards`` state groups by hash, each worked off as one frame;
    a shard rewrites its open samples in every trigger that touches it, so take more shards for more open samples.
    """
    names = list(experts)
    expert = F.nullif(F.array_position(F.array(*[F.lit(e) for e in names]), F.col("model_name")), F.lit(0)).cast("int") - 1
    rows = forecasts.select(
        F.pmod(F.xxhash64("sample_key"), F.lit(shards)).alias("shard"),
        "sample_key",
        expert.alias("expert"),
        F.col(metric).alias("value"),
        event_time,
        F.unix_millis(F.col(event_time)).alias("at_ms"),
    )
    out = "sample_key string, status string, oracle_model string, oracle_value double, " + ", ".join(f"`{e}` double" for e in names)
    return rows.groupBy("shard").transformWithStateInPandas(TimedLabels(names, wait_ms), out, "Append", "EventTime")


_STORE = "spark.sql.streaming.stateStore"
_ROCKSDB = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",  # a trigger writes what it changed
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",  # of all stores of an executor together
    f"{_STORE}.compression.codec": "zstd",
    f"{_STORE}.rocksdb.compression": "zstd",
}


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own choice stands again afterwards.

    Spark's other store holds all keys in memory, and copies them in every trigger.
    """
    before = {name: spark.conf.get(name, None) for name in _ROCKSDB}
    for name, value in _ROCKSDB.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def split_late(rows: DataFrame, event_time: str, delay: str, dst: str, late_dst: str, checkpoint: str) -> StreamingQuery:
    """Append rows of a stream to ``dst``, and rows behind the watermark to ``late_dst``.

    The watermark of a batch is the largest event time of all earlier batches less ``delay``, as in Spark's own stateful
    operators, which would drop the late rows without a trace; a row without event time is late. The largest time of every
    batch is a file under the checkpoint and rows lie in a folder per batch, so a batch that is repeated after a
    failure is split and written as before.
    """
    marks = f"{checkpoint}/times"

    def split(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = batch.agg(F.max(event_time).alias("latest")).withColumn("epoch", F.lit(epoch))
        seen.write.mode("overwrite").parquet(f"{marks}/batch={epoch}")
        earlier = spark.read.schema("latest timestamp, epoch long, batch long").parquet(marks).filter(F.col("batch") < epoch)
        mark = earlier.agg((F.max("latest") - F.expr(f"interval {delay}")).alias("mark")).first()["mark"]
        on_time = F.col(event_time).isNotNull() & (F.lit(True) if mark is None else F.col(event_time) >= F.lit(mark))
        batch.filter(on_time).write.mode("overwrite").parquet(f"{dst}/batch={epoch}")
        batch.filter(~on_time).write.mode("overwrite").parquet(f"{late_dst}/batch={epoch}")

    return rows.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(split).trigger(availableNow=True).start()


def stream_route(features: DataFrame, router: LinearRouter, rules: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Weights, learned pick and rule pick for arriving feature rows (stream-static join).

    ``rules`` is a fitted rule table (config, expert) of fixed size.
    """
    names = F.array(*[F.lit(e) for e in experts])
    scored = score_router(router, features, None)
    top = F.array_position("weights", F.array_max("weights")).cast("int")
    picked = scored.withColumn("selected_model", F.element_at(names, top))
    rule = rules.select("config_name", F.col("selected_model").alias("rule_model"))
    return picked.join(rule, "config_name", "left").select(*STABLE, "weights", "selected_model", "rule_model")


def moment_sums(features: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, sum and sum of squares per config and column, in wide form."""
    return features.groupBy("config_name").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"{c}__sum") for c in cols],
        *[F.sum(F.col(c) * F.col(c)).alias(f"{c}__sq") for c in cols],
    )


def scaler_from_sums(sums: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population std (0 -> 1) per config and column from moment sums."""
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__sum").alias("s"), F.col(f"{c}__sq").alias("q")) for c in cols]
    )
    long = sums.select("config_name", "n", F.inline(rows))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return long.select("config_name", "feature", mean.alias("mean"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std"))


def to_table(stream: DataFrame, dst: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append a stream to a Parquet table, working off what has arrived."""
    return (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(dst)
    )


def snapshots_to_table(stream: DataFrame, dst: str, checkpoint: str) -> StreamingQuery:
    """Keep a complete-mode aggregate in ``dst``; its size is the number of groups."""

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(dst)

    return (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace)
        .trigger(availableNow=True)
        .start()
    )
