"""Queries over windowing, sampling, window transforms and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castwise.functions.columns import asum, ratio
from castwise.functions.spectral import checksum_of
from castwise.operators import features, sampling, transforms, windows
from castwise.plans import derived
from castwise.plans.registry import query
from castwise.plans.sqlbase import STABLE_SQL
from castwise.schemas import FEATURES, SERIES, STABLE
from castwise.sources.panel import fold_channels

L, H = derived.CONFIGS["24_6_S"]
SERIES_SQL = "dataset_name, item_id, channel_id"


def checksum(arr: Column) -> Column:
    """Sum of value times position: one number that depends on every value and its place."""
    return asum(F.transform(arr, lambda v, i: v * (i + 1)))


def checksum_sql(arr: str) -> str:
    return f"list_sum(list_transform(range(1, len({arr}) + 1), lambda i: {arr}[i] * i))"


def scored_panel(ws):
    return ws.panel().filter("split <> 'train'")


# --- windowing ------------------------------------------------------------------


def every_config(fn):
    """``fn(config_name, history, future)`` of both window configs as one table."""
    parts = [fn(name, *sizes).withColumn("config_name", F.lit(name)) for name, sizes in derived.CONFIGS.items()]
    return parts[0].unionByName(parts[1])


@query(
    "c1_enumerate_windows",
    f"SELECT config_name, split, {SERIES_SQL}, CAST(unnest(range(0, t - l - h + 1)) AS INTEGER) AS window_index FROM series CROSS JOIN cfg",
)
def _(ws):
    return every_config(lambda _, l, h: windows.enumerate_windows(scored_panel(ws), l, h, block=16))  # noqa: E741


@query(
    "c2_with_history",
    f"""SELECT config_name, split, {SERIES_SQL}, window_index, {checksum_sql("v[window_index + 1 : window_index + l]")} AS x_check
        FROM (SELECT *, CAST(unnest(range(0, t - l + 1)) AS INTEGER) AS window_index FROM series CROSS JOIN cfg)""",
    ["x_check"],
)
def _(ws):
    cut = every_config(lambda _, l, h: windows.with_history(scored_panel(ws), l, block=32))  # noqa: E741
    return cut.select("config_name", "split", *SERIES, "window_index", checksum(F.col("x")).alias("x_check"))


@query(
    "c3_with_future",
    f"""SELECT config_name, split, {SERIES_SQL}, window_index, {checksum_sql("y_true")} AS y_check FROM windows""",
    ["y_check"],
)
def _(ws):
    cut = every_config(lambda _, l, h: windows.with_future(scored_panel(ws), l, h, block=32))  # noqa: E741
    return cut.select("config_name", "split", *SERIES, "window_index", checksum(F.col("y_true")).alias("y_check"))


@query(
    "c2_c3_build_windows",
    f"SELECT {STABLE_SQL}, {checksum_sql('x')} AS x_check, {checksum_sql('y_true')} AS y_check FROM windows",
    ["x_check", "y_check"],
)
def _(ws):
    return derived.windows_from(ws.panel()).select(
        *STABLE, checksum(F.col("x")).alias("x_check"), checksum(F.col("y_true")).alias("y_check")
    )


@query(
    "c4_candidate_stats",
    """SELECT config_name, split, dataset_name, count(DISTINCT item_id) AS item_count, count(*) AS series_count,
              max(t - l - h + 1) AS windows_per_series, CAST(sum(t - l - h + 1) AS BIGINT) AS window_count
       FROM series CROSS JOIN cfg GROUP BY ALL""",
)
def _(ws):
    return every_config(lambda _, l, h: windows.candidate_stats(scored_panel(ws), l, h))  # noqa: E741


CENTER = "(2 * k + 1) * n // (2 * cnt)"


def center_sql(table: str, part: str, order: str, count: str, cols: str) -> str:
    """Rows at the listed center positions of each group."""
    return f"""
      SELECT {cols} FROM (
        SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) - 1 AS rk, count(*) OVER (PARTITION BY {part}) AS n,
               {count} AS cnt FROM {table})
      WHERE list_contains(list_transform(range(0, cnt), lambda k: {CENTER}), rk)"""


@query("c5_center_spaced", center_sql("windows", "config_name, split", "sample_key", "100", "config_name, split, sample_key"))
def _(ws):
    return sampling.center_spaced(ws.samples().select("config_name", "split", "sample_key"), ["config_name", "split"], ["sample_key"], 100)


ITEMS_TABLE = {
    "item_list": "SELECT DISTINCT split, dataset_name, item_id FROM panel WHERE split <> 'train'",
    "item_cells": "SELECT i.*, r.group_name FROM item_list i JOIN regimes r USING (item_id)",
    "quotas": """
        SELECT s.split, s.dataset_name, s.group_name, s.size, coalesce(q.quota, 0) AS quota FROM
          (SELECT split, dataset_name, group_name, count(*) AS size FROM item_cells GROUP BY ALL) s
        LEFT JOIN (
          SELECT split, dataset_name, group_name, count(*) AS quota FROM (
            SELECT *, row_number() OVER (PARTITION BY split, dataset_name ORDER BY round_no, group_name) AS place FROM (
              SELECT *, row_number() OVER (PARTITION BY split, dataset_name, group_name ORDER BY item_id) AS round_no FROM item_cells))
          WHERE place <= 10 GROUP BY ALL) q USING (split, dataset_name, group_name)""",
    "balanced": center_sql(
        "(SELECT c.*, q.quota FROM item_cells c JOIN quotas q USING (split, dataset_name, group_name) WHERE quota > 0)",
        "split, dataset_name, group_name",
        "item_id",
        "quota",
        "split, dataset_name, item_id, group_name",
    ),
}


@query(
    "c6_sample_items_even",
    center_sql("item_list", "split, dataset_name", "item_id", "10", "split, dataset_name, item_id"),
    extra=ITEMS_TABLE,
)
def _(ws):
    return sampling.sample_items_even(scored_panel(ws), 10)


@query("c7_balanced_quotas", "SELECT * FROM quotas", extra=ITEMS_TABLE)
def _(ws):
    items = sampling.enrich(scored_panel(ws).select("split", "dataset_name", "item_id").distinct(), ws.regimes())
    sizes = items.groupBy("split", "dataset_name", "group_name").agg(F.count(F.lit(1)).alias("size"))
    return sampling.balanced_quotas(sizes, 10, ["split", "dataset_name"])


@query("c8_sample_items_balanced", "SELECT * FROM balanced", extra=ITEMS_TABLE)
def _(ws):
    return sampling.sample_items_balanced(scored_panel(ws), ws.regimes(), 10)


@query(
    "c9_cap_channels",
    f"""SELECT split, {SERIES_SQL}, count(*) AS row_count FROM panel WHERE split <> 'train' AND channel_id < 2 GROUP BY ALL""",
)
def _(ws):
    return sampling.cap_channels(scored_panel(ws), 2).groupBy("split", *SERIES).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "c10_head_items",
    """SELECT split, dataset_name, item_id, count(*) AS row_count FROM panel WHERE split <> 'train'
         AND item_id IN (SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY dataset_name ORDER BY item_id) AS rn
                         FROM (SELECT DISTINCT dataset_name, item_id FROM panel)) WHERE rn <= 5) GROUP BY ALL""",
)
def _(ws):
    return sampling.head_items(scored_panel(ws), 5).groupBy("split", "dataset_name", "item_id").agg(F.count(F.lit(1)).alias("row_count"))


@query("c10_head_windows", "SELECT sample_key FROM windows WHERE window_index < 3")
def _(ws):
    return sampling.head_windows(ws.samples(), 3).select("sample_key")


@query(
    "c11_limit_per_split",
    """SELECT config_name, split, sample_key FROM (SELECT *, row_number() OVER (PARTITION BY config_name, split ORDER BY sample_key) AS rn
       FROM windows) WHERE rn <= 100""",
)
def _(ws):
    return sampling.limit_per_split(ws.samples(), 100).select("config_name", "split", "sample_key")


@query(
    "c11_limit_per_split_large",
    """SELECT config_name, split, sample_key FROM (SELECT *, row_number() OVER (PARTITION BY config_name, split ORDER BY sample_key) AS rn
       FROM windows) WHERE rn <= 1500""",
)
def _(ws):
    return sampling.limit_per_split(ws.samples(), 1500).select("config_name", "split", "sample_key")


@query(
    "c12_shard_by_key_rank",
    "SELECT sample_key, CAST((row_number() OVER (ORDER BY sample_key) - 1) % 7 AS INTEGER) AS shard FROM windows",
)
def _(ws):
    return sampling.shard_by_key_rank(ws.samples().select("sample_key"), 7).select("sample_key", "shard")


@query(
    "c13_shard_round_robin",
    f"""SELECT sample_key, CAST((row_number() OVER (ORDER BY config_name, split, {SERIES_SQL}, window_index) - 1) % 7 AS INTEGER) AS shard
        FROM windows""",
)
def _(ws):
    return sampling.shard_round_robin(ws.samples(), 7, ["config_name", "split", *SERIES]).select("sample_key", "shard")


def samples_sql(items: str, strategy: str) -> str:
    return f"""
      SELECT w.config_name || '__' || w.split || '__' || w.dataset_name || '__item' || w.item_id || '__ch' || w.channel_id || '__win' || w.window_index AS sample_key,
             w.config_name, w.split, w.dataset_name, w.item_id, w.channel_id, w.window_index, w.history_length, w.pred_length,
             '{strategy}' AS selection_strategy, r.* EXCLUDE (item_id)
      FROM windows w JOIN {items} i ON i.split = w.split AND i.dataset_name = w.dataset_name AND i.item_id = w.item_id
      JOIN regimes r ON r.item_id = w.item_id
      JOIN (SELECT config_name, split, dataset_name, max(window_index) + 1 AS n FROM windows GROUP BY ALL) c
        ON c.config_name = w.config_name AND c.split = w.split AND c.dataset_name = w.dataset_name
      WHERE channel_id < 2
        AND list_contains(list_transform(range(0, 5), lambda k: (2 * k + 1) * c.n // 10), window_index)"""


def _samples(ws, strategy: str):
    def one(name: str, l: int, h: int):  # noqa: E741
        cfg = sampling.SampleConfig(name, l, h, items=10, windows=5, channels=2, strategy=strategy)
        return sampling.samples_of_series(ws.series(), ws.regimes(), cfg)

    return every_config(one)


@query("c14_build_samples_balanced", samples_sql("balanced", "tsf_balanced"), extra=ITEMS_TABLE)
def _(ws):
    return _samples(ws, "tsf_balanced")


@query(
    "c14_build_samples_even",
    samples_sql("(" + center_sql("item_list", "split, dataset_name", "item_id", "10", "split, dataset_name, item_id") + ")", "even_spaced"),
    extra=ITEMS_TABLE,
)
def _(ws):
    return _samples(ws, "even_spaced")


@query(
    "c15_estimate_cost",
    """SELECT config_name, n AS sample_count, n * 5 AS forecast_rows, n * 10.0 * b / 1048576 AS own_truth_mib,
              n * 6.0 * b / 1048576 AS shared_truth_mib, n * 768.0 * 4 / 1048576 AS embedding_float32_mib,
              n * 768.0 * 2 / 1048576 AS embedding_float16_mib
       FROM (SELECT config_name, count(*) AS n, greatest(320, any_value(pred_length) * 4 + 128) AS b FROM windows GROUP BY config_name)""",
    ["own_truth_mib", "shared_truth_mib", "embedding_float32_mib", "embedding_float16_mib"],
)
def _(ws):
    return sampling.estimate_cost(ws.samples(), 5, 768)


# --- transforms ------------------------------------------------------------------



def best_three(scored: str) -> str:
    """Three times the first period within the tie of the best one left (every window here has three)."""
    rows = f"SELECT sample_key, tie, c, CAST([] AS BIGINT[]) AS ps FROM {scored}"
    for _ in range(3):
        left = f"SELECT sample_key, tie, c, ps, list_filter(c, lambda e: NOT list_contains(ps, e.p)) AS r FROM ({rows})"
        best = f"SELECT *, list_max(list_transform(r, lambda e: e.s)) AS m FROM ({left})"
        rows = f"SELECT sample_key, tie, c, list_append(ps, list_filter(r, lambda e: e.s >= m - tie)[1].p) AS ps FROM ({best})"
    return f"SELECT sample_key, ps FROM ({rows})"


NORM = {
    "norms": """
        SELECT sample_key, x, mean AS norm_mean, greatest(std, 1e-6) AS norm_std, min AS norm_min, max AS norm_max, max - min AS norm_range,
               list_transform(x, lambda v: (v - mean) / greatest(std, 1e-6)) AS x_norm FROM feat4""",
    "pixel_rows": """
        SELECT sample_key, list_transform(x_norm, lambda v: (least(greatest(v, -2.0), 2.0) + 2.0) / 4.0) AS px,
               len(list_filter(x_norm, lambda v: v < -2.0 OR v > 2.0)) / len(x_norm) AS clip_ratio FROM norms""",
    "cand_lists": f"""
        SELECT DISTINCT l, list_filter(range(2, l + 1), lambda p: l % p = 0 OR p = l
               OR list_contains({transforms.ANCHOR_PERIODS}, p)) AS cand FROM cfg""",
    "period_scores": """
        SELECT sample_key, 1e-12 * list_sum(power) AS tie,
               list_transform(cand, lambda p: {'p': p, 's': power[least(greatest(CAST(round_even(l / p, 0) AS INTEGER), 1), len(power))]}) AS c
        FROM powers JOIN (SELECT sample_key, history_length FROM windows) USING (sample_key) JOIN cand_lists ON l = history_length""",
    "tops": best_three("period_scores"),
    "bin_periods": """
        SELECT sample_key, 1e-12 * list_sum(power) AS tie, list_transform(range(1, len(power) + 1), lambda b:
                 {'p': least(greatest(CAST(round_even(history_length / b, 0) AS INTEGER), 2), history_length), 's': power[b]}) AS c
        FROM powers JOIN (SELECT sample_key, history_length FROM windows) USING (sample_key)""",
    "dyn_tops": best_three("bin_periods"),
}


@query(
    "d1_normalize_windows",
    f"SELECT sample_key, norm_mean, norm_std, norm_min, norm_max, norm_range, {checksum_sql('x_norm')} AS x_check FROM norms",
    ["norm_mean", "norm_std", "norm_min", "norm_max", "norm_range", "x_check"],
    NORM,
)
def _(ws):
    n = transforms.normalize_windows(ws.windows().select("sample_key", "x"))
    return n.select(
        "sample_key", "norm_mean", "norm_std", "norm_min", "norm_max", "norm_range", checksum(F.col("x_norm")).alias("x_check")
    )


@query(
    "d2_fold_channels",
    "SELECT dataset_name, split, item_id, step, pos, avg(value) AS value FROM panel GROUP BY ALL",
    ["value"],
)
def _(ws):
    return fold_channels(ws.panel())


@query(
    "d3_period_candidates",
    """SELECT config_name, array_to_string(cand, ',') AS candidates, count(*) AS sample_count
       FROM windows JOIN cand_lists ON l = history_length GROUP BY ALL""",
    extra=NORM,
)
def _(ws):
    text = F.array_join(transforms.period_candidates(F.col("history_length")), ",")
    return ws.samples().groupBy("config_name", text.alias("candidates")).agg(F.count(F.lit(1)).alias("sample_count"))


@query(
    "d4_with_power",
    f"SELECT sample_key, len(power) AS bin_count, list_sum(power) AS power_sum, CASE WHEN list_sum(power) > 0 THEN {checksum_sql('power')} / list_sum(power) ELSE 0 END AS power_check FROM powers",
    ["power_sum", "power_check"],
)
def _(ws):
    return _power_checks(transforms.with_power(ws.windows().select("sample_key", "x")))


def _power_checks(p):
    return p.select(
        "sample_key",
        F.size("power").cast("long").alias("bin_count"),
        asum(F.col("power")).alias("power_sum"),
        F.coalesce(ratio(checksum(F.col("power")), asum(F.col("power"))), F.lit(0.0)).alias("power_check"),
    )


@query(
    "d4_with_power_columns",
    f"SELECT sample_key, len(power) AS bin_count, list_sum(power) AS power_sum, CASE WHEN list_sum(power) > 0 THEN {checksum_sql('power')} / list_sum(power) ELSE 0 END AS power_check FROM powers",
    ["power_sum", "power_check"],
)
def _(ws):
    return _power_checks(transforms.with_power_columns(ws.windows().select("sample_key", "x")))


@query("d5_top_periods", "SELECT sample_key, ps[1] AS p1, ps[2] AS p2, ps[3] AS p3 FROM tops", extra=NORM)
def _(ws):
    return _periods(transforms.top_periods(ws.windows().select("sample_key", "x"), 3))


@query("d6_top_periods_dynamic", "SELECT sample_key, ps[1] AS p1, ps[2] AS p2, ps[3] AS p3 FROM dyn_tops", extra=NORM)
def _(ws):
    return _periods(transforms.top_periods_dynamic(ws.windows().select("sample_key", "x"), 3))


def _periods(df):
    return df.select("sample_key", *[F.element_at("periods", i).cast("long").alias(f"p{i}") for i in (1, 2, 3)])


@query(
    "d7_to_pixels",
    f"SELECT sample_key, {checksum_sql('px')} AS pixel_check, clip_ratio FROM pixel_rows",
    ["pixel_check", "clip_ratio"],
    NORM,
)
def _(ws):
    return ws.windows().select(
        "sample_key",
        checksum_of(transforms.window_pixels("x", 2.0)).alias("pixel_check"),
        transforms.window_clip_ratio("x", 2.0).alias("clip_ratio"),
    )


@query(
    "d8_period_fold",
    """SELECT sample_key, p AS period, n AS cycles, list_sum(list_transform(range(1, n * p + 1), lambda i: x[least(i, len(x))] * i)) AS fold_check
       FROM (SELECT sample_key, x, ps[1] AS p, (len(x) + ps[1] - 1) // ps[1] AS n FROM tops JOIN (SELECT sample_key, x FROM feat4) USING (sample_key))""",
    ["fold_check"],
    NORM,
)
def _(ws):
    p = transforms.top_periods(ws.windows().select("sample_key", "x"), 1).withColumn("period", F.element_at("periods", 1))
    folded = transforms.period_fold(p, "period")
    return folded.select(
        "sample_key",
        F.col("period").cast("long").alias("period"),
        F.size("fold").cast("long").alias("cycles"),
        checksum(F.flatten("fold")).alias("fold_check"),
    )


@query(
    "d9_power_profile",
    f"""SELECT sample_key, {checksum_sql('prof')} / (len(prof) * len(prof)) AS profile_check FROM (
          SELECT sample_key, list_transform(lg, lambda v: (v - list_min(lg)) / greatest(list_max(lg) - list_min(lg), 1e-6)) AS prof
          FROM (SELECT sample_key, list_transform(power, lambda p: CASE WHEN p < 1e-5 THEN p - p * p / 2 + p * p * p / 3 ELSE ln(1 + p) END) AS lg FROM powers))""",
    ["profile_check"],
)
def _(ws):
    bins = F.floor(F.size("x") / 2)
    return transforms.power_profile(ws.windows().select("sample_key", "x")).select(
        "sample_key", (checksum_of("profile") / (bins * bins)).alias("profile_check")
    )


@query(
    "d10_imageize",
    """SELECT config_name, split, v.variant, count(*) AS image_count, count(*) * 3 * 16 * 16 AS pixel_count, CAST(0 AS BIGINT) AS outside
       FROM windows CROSS JOIN (SELECT unnest(['3view', 'top3fold']) AS variant) v GROUP BY ALL""",
)
def _(ws):
    both = transforms.imageize(ws.windows(), ["3view", "top3fold"], keep=["sample_key", "config_name", "split"])
    bad = F.size(F.filter("pixels", lambda p: ~((p >= 0) & (p <= 1))))
    return both.groupBy("config_name", "split", "variant").agg(
        F.count(F.lit(1)).alias("image_count"), F.sum(F.size("pixels")).alias("pixel_count"), F.sum(bad).alias("outside")
    )


def _part_mean(channel: int, size: int) -> Column:
    part = F.slice("pixels", channel * size * size + 1, size * size)
    return asum(F.transform(part, lambda v: v.cast("double"))) / (size * size)


EDGE = 4
_CURVE = "(least(greatest({v}, -5.0), 5.0) + 5.0) / 10.0"
_PIXELS = {
    **NORM,
    # for every axis length n: the samples left and right of each of EDGE evenly spread points, and the share of the right one
    "between": f"""
        SELECT n, e, lo, least(lo + 1, n - 1) AS hi, pos - lo AS part FROM (
          SELECT n, e, pos, greatest(least(CAST(floor(pos) AS INTEGER), n - 2), 0) AS lo FROM (
            SELECT n, e, e * (n - 1) / {EDGE - 1}.0 AS pos FROM (SELECT unnest(range(1, 49)) AS n) CROSS JOIN (SELECT unnest(range(0, {EDGE})) AS e)))""",
    "normed": """
        SELECT sample_key, x_norm AS x, len(x_norm) AS n, ps[1] AS p, (len(x_norm) + ps[1] - 1) // ps[1] AS cycles FROM norms JOIN norm_tops USING (sample_key)""",
    "raster_means": f"""
        SELECT sample_key, avg(CAST(CAST(exp(-(y - h) * (y - h) / 2) AS FLOAT) AS DOUBLE)) AS m0 FROM (
          SELECT sample_key, {EDGE - 1} * (1 - (a + part * (b - a))) AS h FROM (
            SELECT sample_key, part, {_CURVE.format(v="x[lo + 1]")} AS a, {_CURVE.format(v="x[hi + 1]")} AS b FROM normed JOIN between USING (n)))
        CROSS JOIN (SELECT unnest(range(0, {EDGE})) AS y) GROUP BY sample_key""",
    "fold_means": f"""
        SELECT sample_key, avg(CAST(CAST({_CURVE.format(v="top + lean * (bottom - top)")} AS FLOAT) AS DOUBLE)) AS m1 FROM (
          SELECT sample_key, r.part AS lean,
                 x[least(r.lo * p + c.lo, normed.n - 1) + 1] * (1 - c.part) + x[least(r.lo * p + c.hi, normed.n - 1) + 1] * c.part AS top,
                 x[least(r.hi * p + c.lo, normed.n - 1) + 1] * (1 - c.part) + x[least(r.hi * p + c.hi, normed.n - 1) + 1] * c.part AS bottom
          FROM normed JOIN between r ON r.n = cycles JOIN between c ON c.n = p) GROUP BY sample_key""",
    "norm_spectra": """
        SELECT sample_key, list(pow(list_inner_product(d, c), 2) + pow(list_inner_product(d, s), 2) ORDER BY k) AS power FROM (
          SELECT sample_key, len(x_norm) AS n, list_transform(x_norm, lambda v: v - list_sum(x_norm) / len(x_norm)) AS d FROM norms)
        JOIN twiddle ON l = n WHERE k > 0 GROUP BY sample_key""",
    "norm_scores": """
        SELECT sample_key, 1e-12 * list_sum(power) AS tie, list_transform(cand, lambda p:
                 {'p': p, 's': power[least(greatest(CAST(round_even(l / p, 0) AS INTEGER), 1), len(power))]}) AS c
        FROM norm_spectra JOIN (SELECT sample_key, history_length FROM windows) USING (sample_key) JOIN cand_lists ON l = history_length""",
    "norm_tops": best_three("norm_scores"),
    "band_means": """
        SELECT sample_key, avg(CAST(CAST(a + part * (b - a) AS FLOAT) AS DOUBLE)) AS m2 FROM (
          SELECT sample_key, part, (lg[lo + 1] - least_) / span AS a, (lg[hi + 1] - least_) / span AS b FROM (
            SELECT sample_key, lg, len(lg) AS n, list_min(lg) AS least_, greatest(list_max(lg) - list_min(lg), 1e-6) AS span
            FROM (SELECT sample_key, list_transform(power, lambda v: ln(1 + v)) AS lg FROM norm_spectra)) JOIN between USING (n)) GROUP BY sample_key""",
}


@query(
    "d10_view_means",
    """SELECT sample_key, m0 AS mean_pixel_0, m1 AS mean_pixel_1, m2 AS mean_pixel_2
       FROM raster_means JOIN fold_means USING (sample_key) JOIN band_means USING (sample_key)""",
    ["mean_pixel_0", "mean_pixel_1", "mean_pixel_2"],
    _PIXELS,
)
def _(ws):
    """Mean of every view of every window, drawn small."""
    images = transforms.imageize(ws.windows(), "3view", size=EDGE, keep=["sample_key"])
    return images.select("sample_key", *[_part_mean(c, EDGE).alias(f"mean_pixel_{c}") for c in range(3)])


@query("d10_image_values")
def _(ws):
    means = transforms.image_means(ws.windows(), "3view", keep=["config_name", "split"])
    return means.groupBy("config_name", "split").agg(*[F.avg(F.get("means", F.lit(c))).alias(f"mean_pixel_{c}") for c in range(3)])


@query(
    "d11_encoder_scale",
    f"""SELECT sample_key, {checksum_sql('half')} AS half_check, {checksum_sql('imagenet')} AS imagenet_check FROM (
          SELECT sample_key, list_transform(px, lambda v: (v - 0.5) / 0.5) AS half,
                 list_transform(px, lambda v: (v - [0.485, 0.456, 0.406][channel_id + 1]) / [0.229, 0.224, 0.225][channel_id + 1]) AS imagenet
          FROM (SELECT sample_key, px, CAST(regexp_extract(sample_key, '__ch([0-9]+)__', 1) AS INTEGER) AS channel_id FROM pixel_rows))""",
    ["half_check", "imagenet_check"],
    NORM,
)
def _(ws):
    scaled = lambda preset: checksum_of(transforms.window_encoder_pixels("x", "channel_id", 2.0, preset))
    return ws.windows().select("sample_key", scaled("hf_vit_0_5").alias("half_check"), scaled("torchvision_imagenet").alias("imagenet_check"))


@query(
    "d12_window_audit",
    """SELECT sample_key, norm_mean, norm_std, norm_range, ps[1] AS p1, ps[2] AS p2, ps[3] AS p3,
              len(list_filter(x_norm, lambda v: v < -5 OR v > 5)) / len(x_norm) AS clip_ratio
       FROM norms JOIN tops USING (sample_key)""",
    ["norm_mean", "norm_std", "norm_range", "clip_ratio"],
    NORM,
)
def _(ws):
    a = transforms.window_audit(ws.windows().select("sample_key", "x"))
    return a.select(
        "sample_key",
        "norm_mean",
        "norm_std",
        "norm_range",
        *[F.element_at("top_periods", i).cast("long").alias(f"p{i}") for i in (1, 2, 3)],
        "clip_ratio",
    )


def zero_checks(names: list[str]) -> str:
    rows = " UNION ALL ".join(f"""SELECT '{n}' AS "check", CAST(0 AS BIGINT) AS violations, true AS passed""" for n in names)
    return rows


@query(
    "d13_validate_images",
    zero_checks(
        ["wrong_shape", "non_finite", "out_of_range", "bad_clip_ratio", "duplicate_key", "extra_image", "missing_audit", "missing_split_dataset"]
    )
    + """ UNION ALL SELECT 'missing_image', count(*), false FROM windows WHERE channel_id = 0""",
)
def _(ws):
    w = ws.windows()
    images = transforms.imageize(w.filter("channel_id <> 0"), "top3fold", 8)
    return transforms.validate_images(images, transforms.window_audit(w.select("sample_key", "x")), ws.samples())


# --- features --------------------------------------------------------------------


def key_x(ws):
    return ws.windows().select("sample_key", "x")


def feature_query(name: str, cols: list[str], fn, table: str = "time_features") -> None:
    @query(name, f"SELECT sample_key, {', '.join(cols)} FROM {table}", cols)
    def _(ws):
        return fn(key_x(ws)).select("sample_key", *cols)


feature_query("e1_basic_features", ["mean", "std", "min", "max"], features.basic_features)
feature_query("e2_shape_features", ["skewness", "kurtosis"], features.shape_features)
feature_query("e3_acf1", ["autocorrelation_mean"], features.acf1)
feature_query("e4_rate_of_change", ["rate_of_change_mean", "rate_of_change_std"], features.rate_of_change)
feature_query("e5_ar1_features", ["autoreg_coef_mean", "residual_std_mean"], features.ar1_features)
feature_query(
    "e6_spectral_features",
    ["frequency_mean", "frequency_peak", "spectral_entropy", "spectral_skewness", "spectral_kurtosis"],
    features.spectral_features,
    "spectral",
)


@query("e7_stationarity")
def _(ws):
    flags = features.stationarity(ws.windows().select("config_name", "split", "dataset_name", "x"))
    return flags.groupBy("config_name", "split", "dataset_name").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("stationarity").alias("stationary_rate")
    )


_LAGS = {
    "adf_rows": """
        SELECT sample_key, list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i]) AS d, x[1 : len(x) - 1] AS level FROM windows WHERE list_min(x) <> list_max(x)""",
    "adf_zero": """
        SELECT *, len(d) AS n, list_sum(d) / len(d) AS md, list_sum(level) / len(level) AS ml FROM adf_rows""",
    "adf_lag0": """
        SELECT sample_key, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS adf_0 FROM (
          SELECT sample_key, n, list_sum(list_transform(level, lambda v: (v - ml) * (v - ml))) AS sxx, list_sum(list_transform(d, lambda v: (v - md) * (v - md))) AS syy,
                 list_sum(list_transform(range(1, n + 1), lambda i: (level[i] - ml) * (d[i] - md))) AS sxy FROM adf_zero)""",
    "adf_one": """
        SELECT *, list_sum(y) / n AS my, list_sum(a) / n AS ma, list_sum(b) / n AS mb FROM (
          SELECT sample_key, len(d) - 1 AS n, d[2 : len(d)] AS y, level[2 : len(level)] AS a, d[1 : len(d) - 1] AS b FROM adf_rows)""",
    "adf_lag1": """
        SELECT sample_key, (say * sbb - sby * sab) / det / sqrt((syy - ((say * sbb - sby * sab) * say + (sby * saa - say * sab) * sby) / det) / (n - 3) * sbb / det) AS adf_1
        FROM (SELECT *, saa * sbb - sab * sab AS det FROM (
          SELECT sample_key, n, list_sum(list_transform(range(1, n + 1), lambda i: (a[i] - ma) * (a[i] - ma))) AS saa,
                 list_sum(list_transform(range(1, n + 1), lambda i: (b[i] - mb) * (b[i] - mb))) AS sbb,
                 list_sum(list_transform(range(1, n + 1), lambda i: (a[i] - ma) * (b[i] - mb))) AS sab,
                 list_sum(list_transform(range(1, n + 1), lambda i: (a[i] - ma) * (y[i] - my))) AS say,
                 list_sum(list_transform(range(1, n + 1), lambda i: (b[i] - mb) * (y[i] - my))) AS sby,
                 list_sum(list_transform(y, lambda v: (v - my) * (v - my))) AS syy FROM adf_one))""",
}
WELL_POSED = "list_unique(x[1 : len(x) - 1]) > 3 AND list_unique(x) > 3"


@query(
    "e7_adf_fixed_lags",
    f"""SELECT sample_key, CASE WHEN abs(adf_0) < 1000 THEN adf_0 END AS adf_0, CASE WHEN abs(adf_1) < 1000 THEN adf_1 END AS adf_1
        FROM adf_lag0 JOIN adf_lag1 USING (sample_key) JOIN windows USING (sample_key) WHERE {WELL_POSED}""",
    ["adf_0", "adf_1"],
    _LAGS,
)
def _(ws):
    """Statistics without and with one lagged difference. Windows of at most three different values fit (nearly) exactly and are left to the tests."""
    apart = (F.size(F.array_distinct(F.slice("x", F.lit(1), F.size("x") - 1))) > 3) & (F.size(F.array_distinct("x")) > 3)
    rows = features.adf_statistics(ws.windows().select("sample_key", "x").filter(apart), [0, 1])
    small = [F.when(F.abs(F.element_at("adf", i + 1)) < 1000, F.element_at("adf", i + 1)).alias(f"adf_{i}") for i in (0, 1)]
    return rows.select("sample_key", *small)


SIXTEEN = [c for c in FEATURES if c != "stationarity"]


# all columns but the unit-root flag, which SQL does not give; compared in the tests
E8_SQL = f"""SELECT 'window_features_v1' AS feature_version, {STABLE_SQL}, history_length, pred_length, 'window_17' AS feature_type,
               17 AS feature_dim, {", ".join(SIXTEEN)}
        FROM windows JOIN time_features USING (sample_key) JOIN spectral USING (sample_key)"""


@query("e8_build_features")
def _(ws):
    """All seventeen features of every window."""
    return features.build_features(ws.windows())


@query(
    "e9_validate_features",
    zero_checks(["key_mismatch", "non_finite", "many_feature_version", "many_feature_type", "many_feature_dim", "duplicate_key", "extra_feature"])
    + """ UNION ALL SELECT 'missing_feature', count(*), false FROM windows WHERE window_index = 0
          UNION ALL SELECT 'row_count_difference', count(*), false FROM windows WHERE window_index = 0""",
)
def _(ws):
    return features.validate_features(ws.features().filter("window_index <> 0"), ws.samples())


@query(
    "e10_feature_columns",
    "SELECT feature, count(*) AS finite_values FROM windows CROSS JOIN (SELECT unnest([" + ", ".join(f"'{c}'" for c in FEATURES) + "]) AS feature) GROUP BY feature",
)
def _(ws):
    f = ws.features()
    cols = features.feature_columns(f)
    wide = f.agg(*[F.count_if(features.is_finite(F.col(c))).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "finite_values")
