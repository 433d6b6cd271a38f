"""Derived tables, each written once per application to the shared folder."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.operators.features import build_features
from castwise.operators.joins import enrich
from castwise.plans import derived
from castwise.schemas import SERIES
from castwise.session import shared_dir
from castwise.sources.tables import write_bucketed, write_table

PARTITIONS = ["config_name", "split"]


class Workspace:
    """Named tables of one data directory; a table is built on first use and then read from Parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
        self.root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/derived-{tag}"
        self._schemas: dict = {}
        self._paths: set[str] = set()  # of the tables that are written
        self._fits: dict = {}
        self._lock = threading.RLock()

    def source(self, name: str) -> DataFrame:
        return derived.table(self.spark, self.sf_dir, name)

    def stored(self, name: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        with self._lock:
            if path not in self._paths:
                df = build()
                write_table(df, path, partition_by or [])
                self._schemas[name] = df.schema
                self._paths.add(path)
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def dense(self) -> tuple[DataFrame, dict[str, int]]:
        """The scaled panel with up to 1,024 steps of an item in a row, and the lengths of the axes."""
        with self._lock:
            if f"{self.root}/dense" not in self._paths:
                rows, lengths = derived.build_dense(self.spark, self.sf_dir)
                self.stored("dense", lambda: rows)
                self.fitted("axes", lambda: lengths)
        return self.stored("dense", lambda: None), self._fits["axes"]

    def panel(self) -> DataFrame:
        """Long rows, for readers of single steps; blocks, regimes and lengths come from the dense rows."""
        return self.stored("panel", lambda: derived.panel_from(*self.dense()), ["split"])

    def series(self) -> DataFrame:
        return self.stored("series", lambda: derived.series_of(*self.dense()))

    def blocks(self) -> DataFrame:
        """Blocks of the series, dealt so that a task opens about ``derived.POINTS`` values."""
        stored = self.stored("blocks", lambda: derived.blocks_of(*self.dense()))
        pieces = max(self.spark.sparkContext.defaultParallelism, -(-self.points(stored) // derived.POINTS))
        return stored.repartition(pieces, "split", *SERIES, "_b")

    def points(self, blocks: DataFrame) -> int:
        """Values in the blocks; there are about as many windows of each config."""
        return self.fitted("points", lambda: blocks.agg(F.coalesce(F.sum(F.size("_v")), F.lit(0))).first()[0])

    # Windows, forecasts and labels are many times as large as the blocks and cheap to derive from them, so
    # they are derived where they are read, in the columns that are read.

    def windows(self) -> DataFrame:
        return derived.open_windows(self.blocks())

    def samples(self) -> DataFrame:
        return self.windows().drop("x", "y_true")

    def forecasts(self) -> DataFrame:
        return derived.forecasts_from(self.windows())

    def regimes(self) -> DataFrame:
        return self.stored("regimes", lambda: derived.regimes_of(*self.dense()))

    def labels(self) -> DataFrame:
        return derived.labels_from(self.windows())

    def enriched(self) -> DataFrame:
        """Labels with regime columns."""
        return enrich(self.labels(), self.regimes())

    def features(self) -> DataFrame:
        """Derived from the windows like forecasts and labels: a reader pays for the columns it reads."""
        return build_features(self.windows())

    def kept_features(self) -> DataFrame:
        """All features, written once, for readers that pass over them many times."""
        return self.stored("features", self.features, PARTITIONS)

    def weights(self) -> DataFrame:
        """Weights of a fixed linear router for every test window."""
        return derived.weights_from(self.windows())

    def routes(self) -> DataFrame:
        """Top-1 routing of every test window by the fixed router, derived from the windows like the labels."""
        return derived.fixed_routes_from(self.windows().filter("split = 'test'"))

    def routed(self) -> DataFrame:
        """The routes, written once, for readers that pass over them several times."""
        return self.stored("routed", self.routes, PARTITIONS)

    def items(self) -> DataFrame:
        """Item-level test results per model and config."""
        return self.stored("items", lambda: derived.items_of(self.windows()))

    def choices(self) -> DataFrame:
        """Item-level oracle choices with regime columns."""
        return self.stored("choices", lambda: derived.choices_from(self.items(), self.regimes()))

    def faulty(self) -> DataFrame:
        """The forecast table with known faults in it."""
        return derived.faulty_from(self.forecasts())

    def fitted(self, name: str, fit: Callable):
        """A model, fitted on first use."""
        with self._lock:
            if name not in self._fits:
                self._fits[name] = fit()
        return self._fits[name]

    def bucketed(self, name: str) -> DataFrame:
        """The named table bucketed and sorted on the sample key, written on first use.

        All tables have the same number of buckets, which grows with the windows: a bucket is one task.
        """
        buckets = max(8, -(-self.points(self.blocks()) // derived.POINTS))
        table = f"castwise_{hashlib.sha1(f'{self.root}/{name}'.encode()).hexdigest()[:16]}"
        with self._lock:
            if table not in self._schemas:
                df = getattr(self, name)()
                write_bucketed(df, table, f"{self.root}/bucketed-{name}", ["sample_key"], buckets)
                self._schemas[table] = df.schema
        return self.spark.table(table)

    def path(self, name: str) -> str:
        """Folder of the named table, written on first use."""
        self.stored(name, getattr(self, name), PARTITIONS)
        return f"{self.root}/{name}"


_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir)
    return _open[key]
