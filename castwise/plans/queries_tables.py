"""Queries over scans, sinks, keys, integrity checks and merging."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from castwise.operators import incremental, keys, ordering, validate
from castwise.operators.forecasts import recheck_metrics
from castwise.plans import derived
from castwise.plans.derived import EXPERTS
from castwise.plans.registry import query
from castwise.plans.sqlbase import STABLE_SQL
from castwise.schemas import FORECASTS_SCHEMA, REGIME, SAMPLES_SCHEMA, STABLE
from castwise.sources import evals, shards, tables
from castwise.sources.panel import item_views, read_panel

NAMES_SQL = ", ".join(f"'{e}'" for e in EXPERTS)
SHARDS = 8


# --- sources and sinks ------------------------------------------------------------


@query("a1_read_panel", "SELECT dataset_name, item_id, channel_id, step, raw, value, split, pos FROM panel", ["raw", "value"])
def _(ws):
    return derived.build_panel(ws.spark, ws.sf_dir)


@query("a1_read_panel_by_time", "SELECT item_id, channel_id, step, raw FROM raw_panel WHERE dataset_name = 'EVENTS_2H'", ["raw"])
def _(ws):
    """Events by their own timestamps in buckets of two hours."""
    events, amounts = ws.source("events"), [F.col("value"), F.lit(1.0)]
    p = read_panel(events, "EVENTS_2H", F.col("user_id"), None, amounts, time=F.col("ts"), bucket="2 hours")
    raw = F.when(F.col("channel_id") == 0, F.round(F.col("value") * 100)).otherwise(F.col("value"))
    return p.select("item_id", "channel_id", "step", raw.alias("raw"))


@query(
    "a2_read_forecasts",
    "SELECT model_name, count(*) AS row_count, avg(mae) AS mean_mae FROM forecasts GROUP BY ALL",
    ["mean_mae"],
)
def _(ws):
    rows = tables.read_forecasts(ws.spark, ws.path("forecasts"), ["model_name", "mae"])
    return rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("row_count"), F.avg("mae").alias("mean_mae"))


@query(
    "a3_read_labels",
    "SELECT sample_key, oracle_model, oracle_value FROM labels WHERE metric = 'mse' AND split = 'test'",
    ["oracle_value"],
)
def _(ws):
    test = keys.for_split(ws.samples(), "test")
    stored = keys.for_split(tables.read_labels(ws.spark, ws.path("labels"), EXPERTS, "mse", test), "test")  # other folders are not opened
    return stored.select("sample_key", "oracle_model", "oracle_value")


@query(
    "a4_explode_eval_results",
    """SELECT model_name, config_name, item_id, count(*) AS n_samples, count(*) * 0.5 AS eval_time,
              CAST(NULL AS DOUBLE) AS MASE, CAST(NULL AS DOUBLE) AS MAPE, CAST(NULL AS DOUBLE) AS SMAPE,
              avg(mae) AS MAE, avg(mse) AS MSE FROM forecasts GROUP BY model_name, config_name, item_id, split""",
    ["MAE", "MSE", "eval_time"],
)
def _(ws):
    return evals.explode_eval_results(derived.eval_documents(ws.forecasts()), "doc")


@query("a5_read_regimes", "SELECT * FROM regimes")
def _(ws):
    twice = ws.regimes().unionByName(ws.regimes())
    return evals.read_regimes(twice, "first")


@query("a5_read_regimes_strict", "SELECT * FROM regimes")
def _(ws):
    return evals.read_regimes(ws.regimes(), "error")


GATES = ["regimes", "shard_grid", "integrity"]


@query(
    "a5_a10_l8_gates",
    f"SELECT gate, input, input = 'faulty' AS stopped FROM (SELECT unnest({GATES}) AS gate) CROSS JOIN (SELECT unnest(['clean', 'faulty']) AS input)",
)
def _(ws):
    """Each gate over whole tables: clean ones pass, ones with faults stop the job."""

    def grid(rows):
        path = F.concat(F.lit("cache/shard_"), (F.col("window_index") % SHARDS).cast("string"), F.lit("/part.parquet"))
        return shards.shard_grid(rows.select("model_name", shards.shard_of_path(path).alias("shard")), EXPERTS)

    without_one = ws.forecasts().filter(~((F.col("window_index") % SHARDS == 1) & (F.col("model_name") == EXPERTS[-1])))
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    trials = {
        ("regimes", "clean"): lambda: noop(evals.read_regimes(ws.regimes(), "error")),
        ("regimes", "faulty"): lambda: noop(evals.read_regimes(ws.regimes().unionByName(ws.regimes()), "error")),
        ("shard_grid", "clean"): lambda: shards.require_full_grid(grid(ws.forecasts())),
        ("shard_grid", "faulty"): lambda: shards.require_full_grid(grid(without_one)),
        ("integrity", "clean"): lambda: validate.require_passed(validate.integrity_report(ws.forecasts(), EXPERTS)),
        ("integrity", "faulty"): lambda: validate.require_passed(validate.integrity_report(ws.faulty(), EXPERTS)),
    }
    said = {"regimes": "repeated item", "shard_grid": "lacks experts", "integrity": "integrity check failed"}
    found = []
    for (gate, name), run in trials.items():
        try:
            run()
            stopped = False
        except Exception as exc:
            if said[gate] not in str(exc):  # a failure of another kind is no verdict
                raise
            stopped = True
        found.append((gate, name, stopped))
    return ws.spark.createDataFrame(found, "gate string, input string, stopped boolean")


@query(
    "a6_read_features",
    f"SELECT config_name, split, {SHARDS} AS shard_count, count(*) AS row_count, sum(mean) AS sum_mean FROM feat4 GROUP BY ALL",
    ["sum_mean"],
)
def _(ws):
    path = f"{ws.root}/feature-shards-{uuid.uuid4().hex}"
    tables.write_sharded(ws.features(), path, SHARDS, files=-(-ws.points(ws.blocks()) // (SHARDS * derived.POINTS)) or 1)
    rows = tables.read_features(ws.spark, path)
    g = rows.groupBy("config_name", "split").agg(
        F.countDistinct("shard").cast("int").alias("shard_count"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum("mean").alias("sum_mean"),
    )
    return g


@query(
    "a7_unpack_arrays",
    f"""SELECT sample_key, row_index, list_sum(y) AS sum_y FROM (
          SELECT sample_key, CAST(list_position([{NAMES_SQL}], model_name) - 1 AS INTEGER) AS row_index, y_pred AS y
          FROM forecasts)""",
    ["sum_y"],
)
def _(ws):
    from castwise.functions.columns import asum
    from castwise.operators.joins import stack_experts

    packed = stack_experts(ws.forecasts(), EXPERTS).select("sample_key", "y_preds")
    return evals.unpack_arrays(packed, "y_preds").select("sample_key", "row_index", asum(F.col("y")).alias("sum_y"))


@query(
    "a8_write_table",
    """SELECT config_name, split, metric, count(*) AS row_count, avg(oracle_value) AS oracle_value
       FROM labels GROUP BY ALL""",
    ["oracle_value"],
)
def _(ws):
    path = f"{ws.root}/sink-{uuid.uuid4().hex}"
    # the files of a folder grow with the windows, so that a task's rows do not
    tables.write_table(ws.labels(), path, ["config_name", "split"], files=max(4, -(-ws.points(ws.blocks()) // (10 * derived.POINTS))))
    rows = ws.spark.read.schema(ws.labels().schema).parquet(path)
    return rows.groupBy("config_name", "split", "metric").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("oracle_value").alias("oracle_value")
    )


@query(
    "a8_write_bucketed",
    "SELECT model_name, count(*) AS sample_count FROM forecasts GROUP BY ALL",
)
def _(ws):
    pairs = ws.bucketed("forecasts").groupBy("sample_key", "model_name").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("model_name").agg(F.count(F.lit(1)).alias("sample_count"))


@query(
    "a9_write_sharded",
    f"""SELECT CAST(shard AS INTEGER) AS shard, {SHARDS} AS shard_count, count(*) AS row_count
        FROM (SELECT (row_number() OVER (ORDER BY sample_key) - 1) % {SHARDS} AS shard FROM windows) GROUP BY ALL""",
)
def _(ws):
    from castwise.operators.sampling import shard_by_key_rank

    path = f"{ws.root}/shards-{uuid.uuid4().hex}"
    tables.write_table(shard_by_key_rank(ws.samples(), SHARDS), path, ["shard"], files=1)
    return tables.shard_index(ws.spark.read.parquet(path), SHARDS, path).drop("path")


@query(
    "a10_shard_grid",
    """SELECT CAST(window_index AS INTEGER) AS shard, count(*) AS row_count,
              CASE WHEN window_index = 1 THEN 'last,snaive,mean,drift' ELSE 'last,snaive,mean,drift,ses' END AS experts,
              CASE WHEN window_index = 1 THEN 'ses' ELSE '' END AS missing_experts, window_index <> 1 AS complete
       FROM faulty GROUP BY window_index""",
)
def _(ws):
    # the shard number is taken from a path text, as from file names
    path = F.concat(F.lit("cache/shard_"), F.col("window_index").cast("string"), F.lit("/part.parquet"))
    rows = ws.faulty().select("model_name", shards.shard_of_path(path).alias("shard"))
    return shards.shard_grid(rows, EXPERTS)


# --- keys, projections, predicates --------------------------------------------------


@query("b1_with_sample_key", f"SELECT {STABLE_SQL} FROM windows")
def _(ws):
    return keys.with_sample_key(ws.samples().drop("sample_key")).select(*STABLE)


@query("b2_bad_keys", "SELECT sample_key, model_name FROM faulty WHERE window_index = 2")
def _(ws):
    return keys.bad_keys(ws.faulty()).select("sample_key", "model_name")


@query("b3_for_split", "SELECT config_name, count(*) AS sample_count FROM windows WHERE split = 'test' GROUP BY ALL")
def _(ws):
    return keys.for_split(ws.samples(), "test").groupBy("config_name").agg(F.count(F.lit(1)).alias("sample_count"))


@query("b4_for_metric", "SELECT sample_key, metric, oracle_value FROM labels WHERE metric = 'mae'", ["oracle_value"])
def _(ws):
    return keys.for_metric(ws.labels(), "mae").select("sample_key", "metric", "oracle_value")


@query("b5_restrict", "SELECT * FROM items WHERE model IN ('last', 'mean', 'ses') AND config_name = '24_6_S'", ["MAE", "MSE"])
def _(ws):
    items = ws.items().withColumnRenamed("model", "model_name")
    return keys.restrict(items, ["last", "mean", "ses"], ["24_6_S"]).withColumnRenamed("model_name", "model")


@query(
    "b5_restrict_check",
    """SELECT *, row_count = expected_rows AS passed FROM (
         SELECT count(*) AS row_count, count(DISTINCT item_id) AS item_count, count(DISTINCT item_id) * 3 AS expected_rows
         FROM items WHERE model IN ('last', 'mean', 'ses') AND config_name = '24_6_S')""",
)
def _(ws):
    return keys.restrict_check(ws.items().withColumnRenamed("model", "model_name"), ["last", "mean", "ses"], ["24_6_S"])


@query("b6_windows_of", f"SELECT DISTINCT {STABLE_SQL} FROM labels")
def _(ws):
    return keys.windows_of(ws.labels())


@query("b7_required_keys", "SELECT DISTINCT sample_key FROM labels WHERE split = 'vali'")
def _(ws):
    return keys.required_keys(ws.labels(), train=True, score=False)


@query("b8_dedup_samples", f"SELECT DISTINCT {STABLE_SQL}, history_length, pred_length FROM forecasts")
def _(ws):
    return keys.dedup_samples(ws.forecasts())


@query(
    "b9_linear_index",
    """SELECT sample_key, CAST(channel_id * l + window_index AS BIGINT) AS linear_index, channel_id, window_index FROM
       (SELECT *, max(window_index) OVER (PARTITION BY config_name, split, dataset_name) + 1 AS l FROM windows)""",
)
def _(ws):
    place = ["config_name", "split", "dataset_name"]
    lengths = ws.samples().groupBy(*place).agg((F.max("window_index") + 1).alias("l"))
    s = ws.samples().join(lengths, place)
    joined = keys.join_index(s.select("sample_key", "channel_id", "window_index", "l"), "l").drop("channel_id", "window_index")
    return keys.split_index(joined, "l").drop("l")


@query(
    "b10_item_views",
    """SELECT dataset_name, item_id, count(DISTINCT channel_id) AS series_count, count(*) AS row_count, sum(raw) AS raw_sum
       FROM panel GROUP BY ALL""",
    ["raw_sum"],
)
def _(ws):
    return item_views(ws.panel())


@query("b11_shard_keys", "SELECT sample_key, count(*) AS key_rows FROM (SELECT sample_key FROM faulty WHERE model_name = 'last') GROUP BY ALL HAVING count(*) > 1")
def _(ws):
    return keys.duplicate_keys(ws.faulty().filter("model_name = 'last'"))


# --- integrity -----------------------------------------------------------------------


@query("l1_check_schema", "SELECT 0 AS missing_columns, count(DISTINCT cache_version) AS version_count, false AS passed FROM faulty")
def _(ws):
    return validate.check_schema(ws.faulty(), FORECASTS_SCHEMA.names)


@query(
    "l2_unstable_samples",
    """SELECT sample_key, CAST(a + b + c + d + e + f + g + h AS INTEGER) AS unstable_columns FROM (
         SELECT sample_key, count(DISTINCT config_name) - 1 AS a, count(DISTINCT split) - 1 AS b, count(DISTINCT dataset_name) - 1 AS c,
                count(DISTINCT item_id) - 1 AS d, count(DISTINCT channel_id) - 1 AS e, count(DISTINCT window_index) - 1 AS f,
                count(DISTINCT history_length) - 1 AS g, count(DISTINCT pred_length) - 1 AS h
         FROM faulty GROUP BY sample_key) WHERE a + b + c + d + e + f + g + h > 0""",
)
def _(ws):
    return validate.unstable_samples(ws.faulty())


@query("l3_duplicate_forecasts", "SELECT sample_key, model_name, count(*) AS row_count FROM faulty GROUP BY ALL HAVING count(*) > 1")
def _(ws):
    return validate.duplicate_forecasts(ws.faulty())


@query(
    "l4_incomplete_samples",
    f"""SELECT sample_key, CAST(count(DISTINCT model_name) AS INTEGER) AS present_experts, 0 AS unknown_experts
        FROM faulty GROUP BY sample_key HAVING count(DISTINCT model_name) < {len(EXPERTS)}""",
)
def _(ws):
    return validate.incomplete_samples(ws.faulty(), EXPERTS)


@query("l5_inconsistent_truth", "SELECT sample_key FROM faulty GROUP BY sample_key HAVING count(DISTINCT y_true) > 1")
def _(ws):
    return validate.inconsistent_truth(ws.faulty())


BAD_ARRAY_SQL = """(len(y_true) <> pred_length OR len(y_pred) <> pred_length
   OR len(list_filter(y_true, lambda v: isnan(v) OR isinf(v))) > 0 OR len(list_filter(y_pred, lambda v: isnan(v) OR isinf(v))) > 0)"""


@query("l6_bad_arrays", f"SELECT sample_key, model_name FROM faulty WHERE {BAD_ARRAY_SQL}")
def _(ws):
    return validate.bad_arrays(ws.faulty()).select("sample_key", "model_name")


@query(
    "l7_misaligned",
    """SELECT sample_key, model_name, kind FROM (
         SELECT coalesce(e.sample_key, o.sample_key) AS sample_key, coalesce(e.model_name, o.model_name) AS model_name,
                CASE WHEN e.sample_key IS NULL THEN 'not_in_reference' WHEN o.sample_key IS NULL THEN 'missing'
                     WHEN rp <> op THEN 'metadata' END AS kind
         FROM (SELECT * FROM (SELECT DISTINCT sample_key, pred_length AS rp FROM faulty WHERE model_name = 'last')
               CROSS JOIN (SELECT DISTINCT model_name FROM faulty WHERE model_name <> 'last')) e
         FULL JOIN (SELECT sample_key, model_name, pred_length AS op FROM faulty WHERE model_name <> 'last') o
           ON e.sample_key = o.sample_key AND e.model_name = o.model_name)
       WHERE kind IS NOT NULL""",
)
def _(ws):
    return validate.misaligned(ws.faulty(), "last", EXPERTS)


REPORT_SQL = """
  SELECT *, record_count > 0 AND duplicate_forecasts + incomplete_samples + unstable_samples + inconsistent_truth + bad_arrays + bad_keys = 0
         AS passed FROM (
    SELECT CAST(sum(n) AS BIGINT) AS record_count, count(*) AS sample_count, CAST(sum(n - m) AS BIGINT) AS duplicate_forecasts,
           count(*) FILTER (WHERE m < 5) AS incomplete_samples, count(*) FILTER (WHERE p > 1) AS unstable_samples,
           count(*) FILTER (WHERE t > 1) AS inconsistent_truth, CAST(sum(b) AS BIGINT) AS bad_arrays, CAST(sum(k) AS BIGINT) AS bad_keys
    FROM (SELECT sample_key, count(*) AS n, count(DISTINCT model_name) AS m, count(DISTINCT pred_length) AS p,
                 count(DISTINCT y_true) AS t, count(*) FILTER (WHERE {bad}) AS b,
                 count(*) FILTER (WHERE sample_key <> config_name || '__' || split || '__' || dataset_name || '__item' || item_id
                                  || '__ch' || channel_id || '__win' || window_index) AS k
          FROM {table} GROUP BY sample_key))"""


@query("l8_integrity_report", REPORT_SQL.format(bad=BAD_ARRAY_SQL, table="forecasts"))
def _(ws):
    return validate.integrity_report(ws.forecasts(), EXPERTS)


@query("l8_integrity_report_faulty", REPORT_SQL.format(bad=BAD_ARRAY_SQL, table="faulty"))
def _(ws):
    return validate.integrity_report(ws.faulty(), EXPERTS)


@query("l9_coverage", "SELECT config_name, split, dataset_name, model_name, count(*) AS row_count FROM faulty GROUP BY ALL")
def _(ws):
    return validate.coverage(ws.faulty())


@query(
    "l10_validate_outputs",
    """SELECT (SELECT count(*) FROM labels) AS label_rows, (SELECT count(*) FROM windows) AS enriched_rows,
              (SELECT count(DISTINCT sample_key) FROM labels) AS label_keys, (SELECT count(*) FROM windows) AS enriched_keys,
              (SELECT count(*) FROM labels WHERE metric = 'mae') AS mae_rows, (SELECT count(*) FROM labels WHERE metric = 'mse') AS mse_rows,
              CAST(0 AS BIGINT) AS label_nulls, CAST(0 AS BIGINT) AS enriched_nulls, CAST(0 AS BIGINT) AS labels_without_regime,
              CAST(0 AS BIGINT) AS regimes_without_label, true AS passed""",
)
def _(ws):
    from castwise.operators.joins import enrich

    return validate.validate_outputs(ws.labels(), enrich(ws.samples(), ws.regimes()), ws.samples().count())


@query(
    "l11_readiness",
    f"""SELECT *, found = expected AS ready FROM (
        SELECT 'feature_shards' AS "check", CAST({SHARDS} AS BIGINT) AS found, CAST({SHARDS} AS BIGINT) AS expected UNION ALL
        SELECT 'feature_rows', (SELECT count(*) FROM windows), (SELECT count(*) FROM windows) UNION ALL
        SELECT 'feature_versions', 1, 1 UNION ALL
        SELECT 'label_metrics', (SELECT count(DISTINCT metric) FROM labels), 2)""",
)
def _(ws):
    from castwise.operators.sampling import shard_by_key_hash

    return validate.readiness(shard_by_key_hash(ws.features(), SHARDS), ws.labels(), ws.samples(), SHARDS)


@query(
    "l12_profile",
    """SELECT 'metric' AS "column", metric AS value, count(*) AS row_count FROM enriched GROUP BY ALL UNION ALL
       SELECT 'oracle_model', oracle_model, count(*) FROM enriched GROUP BY ALL UNION ALL
       SELECT 'group_name', group_name, count(*) FROM enriched GROUP BY ALL""",
)
def _(ws):
    return validate.profile(ws.enriched(), ["metric", "oracle_model", "group_name"])


@query(
    "g3_recheck_metrics",
    """SELECT model_name, count(*) AS row_count, CASE WHEN model_name = 'last' THEN 0.001 ELSE 0.0 END AS max_mae_diff,
              0.0 AS max_mse_diff FROM forecasts GROUP BY ALL""",
    ["max_mae_diff", "max_mse_diff"],
)
def _(ws):
    off = (F.col("window_index") == 7) & (F.col("model_name") == "last")
    return recheck_metrics(ws.forecasts().withColumn("mae", F.col("mae") + F.when(off, 0.001).otherwise(0.0)))


# --- merge and incremental -----------------------------------------------------------


@query("m1_merge_shards", "SELECT sample_key, model_name, mae, mse FROM forecasts", ["mae", "mse"])
def _(ws):
    f = ws.forecasts()
    parts = [f.filter(F.col("model_name") == e) for e in EXPERTS]
    parts.append(parts[0].filter("window_index = 0"))  # a repeated tail
    merged = incremental.merge_shards(parts, ws.samples(), EXPERTS)
    return merged.select("sample_key", "model_name", "mae", "mse")


@query(
    "m1_merge_report",
    """SELECT *, violations = 0 AS passed FROM (
       SELECT 'duplicate_forecasts' AS "check", count(*) AS violations FROM
         (SELECT sample_key, model_name FROM faulty GROUP BY ALL HAVING count(*) > 1) UNION ALL
       SELECT 'inconsistent_truth', count(*) FROM (SELECT sample_key FROM faulty GROUP BY ALL HAVING count(DISTINCT y_true) > 1) UNION ALL
       SELECT 'misaligned', count(*) FILTER (WHERE window_index = 3) + count(*) FILTER (WHERE window_index = 1)
         FROM faulty WHERE model_name = 'mean' AND window_index IN (1, 3))""",
)
def _(ws):
    return incremental.merge_report(ws.faulty(), "last", EXPERTS)


@query(
    "m2_union_metrics",
    f"""SELECT sample_key, 'mae' AS metric, oracle_value FROM labels WHERE metric = 'mae' UNION ALL
        SELECT sample_key, 'mse', oracle_value FROM labels WHERE metric = 'mse'""",
    ["oracle_value"],
)
def _(ws):
    one = keys.for_metric(ws.labels(), "mae").select("sample_key", "metric", "oracle_value")
    return one.unionByName(keys.for_metric(ws.labels(), "mse").select("sample_key", "metric", "oracle_value"))


# half-written state: items whose events came in part (channel 0 only for odd datasets)
DONE_SQL = "(channel_id = 0 OR dataset_name = 'ITEMS_1W')"


@query(
    "m3_complete_groups",
    f"""SELECT d.* FROM (SELECT split, dataset_name, item_id, count(*) AS row_count FROM windows WHERE {DONE_SQL} GROUP BY ALL) d
        JOIN (SELECT split, dataset_name, item_id, count(*) AS want FROM windows GROUP BY ALL) w
        USING (split, dataset_name, item_id) WHERE row_count = want""",
)
def _(ws):
    return incremental.complete_groups(ws.features().filter(DONE_SQL), ws.samples())


@query("m3_pending", "SELECT sample_key FROM windows WHERE dataset_name = 'EVENTS_2H'")
def _(ws):
    done = incremental.checked_state(ws.features().filter(DONE_SQL), ws.samples(), ["mean", "std"])
    return incremental.pending(ws.samples(), done).select("sample_key")


@query("m4_append_new", "SELECT sample_key, mean FROM feat4", ["mean"])
def _(ws):
    f = ws.features().select("sample_key", "mean", "channel_id", "dataset_name")
    existing = f.filter(DONE_SQL).select("sample_key", "mean")
    # known keys come again with other values, which must not win; new keys come twice
    known = F.expr(DONE_SQL)
    batch = f.select("sample_key", (F.col("mean") + F.when(known, 1.0).otherwise(0.0)).alias("mean"))
    batch = batch.unionByName(f.filter(~known).select("sample_key", "mean"))
    return incremental.append_new(existing, batch, ws.samples())


PARTS = ["config_name", "split", "dataset_name"]


@query(
    "m4_redo_partial",
    f"""SELECT sample_key, mean + CASE WHEN dataset_name = 'ITEMS_1W' THEN 0.5 ELSE 0 END AS mean FROM feat4""",
    ["mean"],
)
def _(ws):
    """A stored table whose event groups hold one channel only: they are built again in place, complete groups keep what they hold."""
    f = ws.features().select("sample_key", "channel_id", *PARTS, "mean")
    path = f"{ws.root}/partial-{uuid.uuid4().hex}"
    tables.write_table(f.filter(DONE_SQL).withColumn("mean", F.col("mean") + 0.5), path, PARTS, files=2)
    stored = ws.spark.read.schema(f.schema).parquet(path).select(*f.columns)
    incremental.redo_partial(stored, path, ws.samples(), lambda todo: f.join(todo.select("sample_key"), "sample_key", "left_semi"), PARTS, 2)
    return ws.spark.read.schema(f.schema).parquet(path).select("sample_key", "mean")


# --- sort and limit ------------------------------------------------------------------


@query("n1_sort_samples", f"SELECT {STABLE_SQL} FROM windows ORDER BY config_name, split, dataset_name, item_id, channel_id, window_index")
def _(ws):
    return ordering.sort_samples(ws.samples().select(*STABLE))


@query("n2_sort_forecasts", f"SELECT sample_key, model_name FROM forecasts ORDER BY sample_key, list_position([{NAMES_SQL}], model_name)")
def _(ws):
    return ordering.sort_forecasts(ws.forecasts().select("sample_key", "model_name"), EXPERTS)


@query("n3_preview", "SELECT sample_key, selected_model, max_weight FROM routed ORDER BY sample_key LIMIT 50", ["max_weight"])
def _(ws):
    return ordering.preview(ws.routed(), 50).select("sample_key", "selected_model", "max_weight")
