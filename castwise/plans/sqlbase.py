"""DuckDB common table expressions that mirror the derived tables, for the checks.

Each entry names the tables it needs; :func:`with_tables` puts the needed ones in
front of a query body.
"""

from __future__ import annotations

import re

from castwise.plans.derived import CONFIGS, EXPERTS, LIMITS, ROUTER, ROUTER_NAME

STABLE_SQL = "sample_key, config_name, split, dataset_name, item_id, channel_id, window_index"


SHIFT = 1.37e-7


def r6(expr: str) -> str:
    """Round to 6 digits (off the decimal halves, see registry.rounded) without a negative zero."""
    return f"(CASE WHEN round({expr} + {SHIFT}, 6) = 0 THEN 0.0 ELSE round({expr} + {SHIFT}, 6) END)"


def q(expr: str) -> str:
    return f"(floor(({expr}) * 1048576.0 + 0.5) / 1048576.0)"


def asum(arr: str) -> str:
    return f"list_reduce({arr}, lambda a, b: a + b, CAST(0 AS DOUBLE))"


_cfg = ", ".join(f"('{name}', {l}, {h})" for name, (l, h) in CONFIGS.items())
_err = "list_transform(range(1, len(y_true) + 1), lambda i: {})"
_KEY = (
    "config_name || '__' || split || '__' || dataset_name || '__item' || item_id || '__ch' || channel_id"
    " || '__win' || window_index"
)


def _cat(expr: str, limit: float) -> str:
    return f"CASE WHEN round({expr}, 9) > {limit} THEN 'HIGH' ELSE 'LOW' END"


_mae = ", ".join(f"max(CASE WHEN model_name = '{e}' THEN mae END) AS mae_{e}" for e in EXPERTS)
_mse = ", ".join(f"max(CASE WHEN model_name = '{e}' THEN mse END) AS mse_{e}" for e in EXPERTS)


def _label_rows(metric: str) -> str:
    vals = ", ".join(f"{metric}_{e} AS {e}" for e in EXPERTS)
    return f"SELECT {STABLE_SQL}, '{metric}' AS metric, {vals} FROM wide_errors"


_arr = "[" + ", ".join(EXPERTS) + "]"
_names = "[" + ", ".join(f"'{e}'" for e in EXPERTS) + "]"
_regrets = ", ".join(f"{e} - list_min({_arr}) AS {e}_regret" for e in EXPERTS)

_logits = "[" + ", ".join(
    f"{b}" + "".join(f" + {w} * (({n} - {m}) / {s})" for n, w, m, s in zip(ROUTER.features, row, ROUTER.center, ROUTER.scale))
    for row, b in zip(ROUTER.coef, ROUTER.intercept)
) + "]"

TABLES: dict[str, str] = {
    "ev_hits": """
        SELECT user_id AS item_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 7200) AS INTEGER) AS step, value
        FROM events""",
    "ev_axis": "SELECT min(step) AS lo, max(step) AS hi FROM ev_hits",
    "ev_agg": """
        SELECT item_id, step - lo AS step, round(sum(value) * 100) AS c0, CAST(count(*) AS DOUBLE) AS c1
        FROM ev_hits CROSS JOIN ev_axis GROUP BY item_id, step - lo""",
    "li_hits": """
        SELECT l_suppkey + 1000000 AS item_id,
               CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) AS step,
               l_returnflag, l_quantity FROM lineitem""",
    "li_axis": "SELECT min(step) AS lo, max(step) AS hi FROM li_hits",
    "li_agg": """
        SELECT item_id, step - lo AS step, """
    + ", ".join(f"sum(CASE WHEN l_returnflag = '{f}' THEN l_quantity ELSE 0 END) AS c{i}" for i, f in enumerate("ANR"))
    + """ FROM li_hits CROSS JOIN li_axis GROUP BY item_id, step - lo""",
    "raw_panel": """
        SELECT 'EVENTS_2H' AS dataset_name, i.item_id, c.channel_id, s.step,
               coalesce(CASE WHEN c.channel_id = 0 THEN a.c0 ELSE a.c1 END, 0.0) AS raw
        FROM (SELECT DISTINCT item_id FROM ev_agg) i CROSS JOIN (SELECT unnest([0, 1]) AS channel_id) c
        CROSS JOIN (SELECT unnest(range(0, hi - lo + 1)) AS step FROM ev_axis) s
        LEFT JOIN ev_agg a ON a.item_id = i.item_id AND a.step = s.step
        UNION ALL
        SELECT 'ITEMS_1W', i.item_id, c.channel_id, s.step,
               coalesce(CASE c.channel_id WHEN 0 THEN a.c0 WHEN 1 THEN a.c1 ELSE a.c2 END, 0.0)
        FROM (SELECT DISTINCT item_id FROM li_agg) i CROSS JOIN (SELECT unnest([0, 1, 2]) AS channel_id) c
        CROSS JOIN (SELECT unnest(range(0, hi - lo + 1)) AS step FROM li_axis) s
        LEFT JOIN li_agg a ON a.item_id = i.item_id AND a.step = s.step""",
    "split_panel": """
        SELECT * EXCLUDE (a, b), CASE WHEN step < a THEN 'train' WHEN step < b THEN 'vali' ELSE 'test' END AS split,
               CAST(CASE WHEN step < a THEN step WHEN step < b THEN step - a ELSE step - b END AS INTEGER) AS pos
        FROM raw_panel JOIN (
          SELECT 'EVENTS_2H' AS dataset_name, (hi - lo + 1) * 2 // 4 AS a, (hi - lo + 1) * 2 // 4 + (hi - lo + 1) // 4 AS b FROM ev_axis UNION ALL
          SELECT 'ITEMS_1W', (hi - lo + 1) * 2 // 4, (hi - lo + 1) * 2 // 4 + (hi - lo + 1) // 4 FROM li_axis) USING (dataset_name)""",
    "moments": """
        SELECT dataset_name, item_id, channel_id, CAST(count(*) AS DOUBLE) AS n, sum(raw) AS s, sum(raw * raw) AS ss
        FROM split_panel WHERE split = 'train' GROUP BY ALL""",
    "panel": f"""
        SELECT p.dataset_name, p.item_id, p.channel_id, p.step, p.raw, p.split, p.pos,
               {q("CASE WHEN n * ss - s * s > 0 THEN (n * raw - s) / sqrt(n * ss - s * s) ELSE raw - s / n END")} AS value
        FROM split_panel p JOIN moments USING (dataset_name, item_id, channel_id)""",
    "cfg": f"SELECT * FROM (VALUES {_cfg}) t(config_name, l, h)",
    "series": """
        SELECT dataset_name, item_id, channel_id, split, list(value ORDER BY pos) AS v, count(*) AS t
        FROM panel WHERE split <> 'train' GROUP BY ALL""",
    "windows0": """
        SELECT config_name, l, h, split, dataset_name, item_id, channel_id, v,
               CAST(unnest(range(0, t - l - h + 1)) AS INTEGER) AS window_index
        FROM series CROSS JOIN cfg""",
    "windows": f"""
        SELECT {_KEY} AS sample_key, config_name, split, dataset_name, item_id, channel_id, window_index,
               CAST(l AS INTEGER) AS history_length, CAST(h AS INTEGER) AS pred_length,
               v[window_index + 1 : window_index + l] AS x, v[window_index + l + 1 : window_index + l + h] AS y_true
        FROM windows0""",
    "expert_inputs": f"""
        SELECT *, CASE WHEN dataset_name = 'EVENTS_2H' THEN 12 ELSE 4 END AS m,
               {q(asum('x') + ' / len(x)')} AS mean_f,
               {q("list_reduce(x, lambda s, v: 0.3 * v + 0.7 * s)")} AS ses_f
        FROM windows""",
    "preds": f"""
        SELECT * EXCLUDE (m, mean_f, ses_f), 'last' AS model_name,
               list_transform(range(1, pred_length + 1), lambda k: x[-1]) AS y_pred FROM expert_inputs
        UNION ALL
        SELECT * EXCLUDE (m, mean_f, ses_f), 'snaive',
               list_transform(range(1, pred_length + 1), lambda k: x[len(x) - m + ((k - 1) % m) + 1]) FROM expert_inputs
        UNION ALL
        SELECT * EXCLUDE (m, mean_f, ses_f), 'mean',
               list_transform(range(1, pred_length + 1), lambda k: mean_f) FROM expert_inputs
        UNION ALL
        SELECT * EXCLUDE (m, mean_f, ses_f), 'drift',
               list_transform(range(1, pred_length + 1),
                              lambda k: {q("x[-1] + k * ((x[-1] - x[1]) / (len(x) - 1))")}) FROM expert_inputs
        UNION ALL
        SELECT * EXCLUDE (m, mean_f, ses_f), 'ses',
               list_transform(range(1, pred_length + 1), lambda k: ses_f) FROM expert_inputs""",
    "forecasts": f"""
        SELECT 'forecast_cache_v1' AS cache_version, {STABLE_SQL}, history_length, pred_length, model_name,
               'simple_v1' AS expert_version, 'not_applicable' AS checkpoint_selection, y_true, y_pred,
               {asum(_err.format("abs(y_pred[i] - y_true[i])"))} / len(y_true) AS mae,
               {asum(_err.format("(y_pred[i] - y_true[i]) * (y_pred[i] - y_true[i])"))} / len(y_true) AS mse
        FROM preds""",
    "wide_errors": f"SELECT {STABLE_SQL}, {_mae}, {_mse} FROM forecasts GROUP BY ALL",
    "labels": f"""
        SELECT {STABLE_SQL}, metric, {_names}[list_position({_arr}, list_min({_arr}))] AS oracle_model,
               list_min({_arr}) AS oracle_value, list_min({_arr}) AS oracle_top1_value,
               {", ".join(EXPERTS)}, {_regrets}
        FROM ({_label_rows('mae')} UNION ALL {_label_rows('mse')})""",
    "item_series": f"""
        SELECT dataset_name, item_id, step, CASE WHEN dataset_name = 'EVENTS_2H' THEN 12 ELSE 4 END AS lag,
               {q("avg(value)")} AS value
        FROM panel WHERE split = 'train' GROUP BY ALL""",
    "item_stats": """
        SELECT a.*, b.* EXCLUDE (item_id), c.* EXCLUDE (item_id), d.* EXCLUDE (item_id), sy / n AS mu, syy - sy * (sy / n) AS sxx
        FROM (SELECT dataset_name, item_id, CAST(count(*) AS DOUBLE) AS n, sum(CAST(step AS DOUBLE)) AS st,
                     sum(CAST(step AS DOUBLE) * step) AS stt, sum(value) AS sy, sum(value * value) AS syy,
                     sum(step * value) AS sty FROM item_series GROUP BY ALL) a
        JOIN (SELECT s.item_id, CAST(count(*) AS DOUBLE) AS l1_n, sum(s.value * t.value) AS l1_p, sum(s.value + t.value) AS l1_s
              FROM item_series s JOIN item_series t ON s.item_id = t.item_id AND t.step = s.step + 1 GROUP BY ALL) b
          ON a.item_id = b.item_id
        JOIN (SELECT s.item_id, CAST(count(*) AS DOUBLE) AS ls_n, sum(s.value * t.value) AS ls_p, sum(s.value + t.value) AS ls_s
              FROM item_series s JOIN item_series t ON s.item_id = t.item_id AND t.step = s.step + s.lag GROUP BY ALL) c
          ON a.item_id = c.item_id
        JOIN (SELECT item_id, CAST(count(*) AS DOUBLE) AS rn, sum(raw) AS rs, sum(raw * raw) AS rss,
                     CAST(count(*) FILTER (WHERE raw = 0) AS DOUBLE) AS rz
              FROM panel WHERE split = 'train' GROUP BY ALL) d ON a.item_id = d.item_id""",
    "item_cats": f"""
        SELECT item_id,
          {_cat("CASE WHEN sxx > 1e-9 THEN (n*sty-st*sy)*(n*sty-st*sy) / ((n*stt-st*st)*n*sxx) ELSE 0 END", LIMITS["trend"])}
            AS trend_strength_cat,
          {_cat("CASE WHEN sxx > 1e-9 THEN (ls_p - mu*ls_s + ls_n*mu*mu) / sxx ELSE 0 END", LIMITS["season"])}
            AS season_strength_cat,
          {_cat("CASE WHEN sxx > 1e-9 THEN (l1_p - mu*l1_s + l1_n*mu*mu) / sxx ELSE 0 END", LIMITS["forecastability"])}
            AS forecastability_cat,
          {_cat("sqrt(CASE WHEN rs > 0 THEN (rn*rss - rs*rs) / (rs*rs) ELSE 0 END)", LIMITS["cv"])} AS cv_cat,
          {_cat("rz / rn", LIMITS["missing"])} AS missing_ratio_cat
        FROM item_stats""",
    "regimes": """
        SELECT item_id, CAST((CASE WHEN trend_strength_cat = 'HIGH' THEN 0 ELSE 18 END)
                 + (CASE WHEN season_strength_cat = 'HIGH' THEN 0 ELSE 6 END)
                 + (CASE WHEN forecastability_cat = 'HIGH' THEN 0 ELSE 2 END) AS INTEGER) AS cluster,
               trend_strength_cat || '_' || season_strength_cat || '_' || forecastability_cat AS group_name,
               forecastability_cat, season_strength_cat, trend_strength_cat, cv_cat, missing_ratio_cat
        FROM item_cats""",
    "hist": f"""
        SELECT {STABLE_SQL}, history_length, pred_length, x, y_true, {asum('x')} / len(x) AS mu FROM windows""",
    "feat4": f"""
        SELECT {STABLE_SQL}, history_length, pred_length, x, mu AS mean,
               sqrt({asum("list_transform(x, lambda v: (v - mu) * (v - mu))")} / len(x)) AS std,
               list_min(x) AS min, list_max(x) AS max FROM hist""",
    "twiddle": """
        SELECT l, k, list(cos(2 * pi() * k * t / l) ORDER BY t) AS c, list(sin(2 * pi() * k * t / l) ORDER BY t) AS s
        FROM (SELECT DISTINCT l, unnest(range(0, l // 2 + 1)) AS k FROM cfg) CROSS JOIN (SELECT unnest(range(0, 64)) AS t)
        WHERE t < l GROUP BY l, k""",
    "bins": """
        SELECT sample_key, k, pow(list_inner_product(d, c), 2) + pow(list_inner_product(d, s), 2) AS p
        FROM (SELECT sample_key, history_length, list_transform(x, lambda v: v - mu) AS d FROM hist)
        JOIN twiddle ON l = history_length""",
    "powers": "SELECT sample_key, list(p ORDER BY k) AS power FROM bins WHERE k > 0 GROUP BY sample_key",
    "psd": """
        SELECT sample_key, l, psd, list_sum(psd) AS total, list_sum(psd) / len(psd) AS mu FROM (
          SELECT sample_key, any_value(history_length) AS l,
                 list(p / history_length * CASE WHEN k = 0 OR 2 * k = history_length THEN 1 ELSE 2 END ORDER BY k) AS psd
          FROM bins JOIN (SELECT sample_key, history_length FROM windows) USING (sample_key) GROUP BY sample_key)""",
    "psd_moments": """
        SELECT *, list_sum(list_transform(psd, lambda v: pow(v - mu, 2))) / len(psd) AS m2,
               list_sum(list_transform(psd, lambda v: pow(v - mu, 3))) / len(psd) AS m3,
               list_sum(list_transform(psd, lambda v: pow(v - mu, 4))) / len(psd) AS m4,
               list_transform(psd, lambda v: (v + 1e-12) / (total + 1e-12 * len(psd))) AS w
        FROM psd""",
    "spectral": """
        SELECT sample_key, mu AS frequency_mean, (list_filter(range(1, len(psd) + 1), lambda i: psd[i] >= list_max(psd) - 1e-12 * total)[1] - 1) / l AS frequency_peak,
               -list_sum(list_transform(w, lambda v: v * ln(v))) AS spectral_entropy,
               CASE WHEN m2 <= pow(2.220446049250313e-16 * mu, 2) THEN 0 ELSE m3 / pow(m2, 1.5) END AS spectral_skewness,
               CASE WHEN m2 <= pow(2.220446049250313e-16 * mu, 2) THEN 0 ELSE m4 / (m2 * m2) - 3 END AS spectral_kurtosis
        FROM psd_moments""",
    "hist_moments": f"""
        SELECT *, {asum("list_transform(x, lambda v: pow(v - mu, 2))")} AS s2, {asum("list_transform(x, lambda v: pow(v - mu, 3))")} AS s3,
               {asum("list_transform(x, lambda v: pow(v - mu, 4))")} AS s4,
               {asum("list_transform(range(1, len(x)), lambda i: (x[i] - mu) * (x[i + 1] - mu))")} AS lag,
               list_transform(list_filter(range(1, len(x)), lambda i: x[i] <> 0), lambda i: (x[i + 1] - x[i]) / x[i]) AS roc,
               x[1 : len(x) - 1] AS xa, x[2 : len(x)] AS xb, len(x) - 1 AS nn
        FROM hist""",
    "ar_sums": f"""
        SELECT *, {asum("list_transform(xa, lambda v: pow(v - ma, 2))")} AS sxx, {asum("list_transform(xb, lambda v: pow(v - mb, 2))")} AS syy,
               {asum("list_transform(range(1, nn + 1), lambda i: (xa[i] - ma) * (xb[i] - mb))")} AS sxy,
               list_sum(roc) / len(roc) AS rmu
        FROM (SELECT *, {asum('xa')} / nn AS ma, {asum('xb')} / nn AS mb FROM hist_moments)""",
    "time_features": """
        SELECT sample_key, mu AS mean, sqrt(s2 / len(x)) AS std, list_min(x) AS min, list_max(x) AS max,
               CASE WHEN s2 / len(x) <= pow(2.220446049250313e-16 * mu, 2) THEN 0
                    ELSE (s3 / len(x)) / pow(s2 / len(x), 1.5) END AS skewness,
               CASE WHEN s2 / len(x) <= pow(2.220446049250313e-16 * mu, 2) THEN 0
                    ELSE (s4 / len(x)) / pow(s2 / len(x), 2) - 3 END AS kurtosis,
               CASE WHEN s2 = 0 THEN 0 ELSE lag / s2 END AS autocorrelation_mean,
               coalesce(rmu, 0) AS rate_of_change_mean,
               CASE WHEN len(roc) = 0 THEN 0 ELSE sqrt(list_sum(list_transform(roc, lambda v: pow(v - rmu, 2))) / len(roc)) END
                 AS rate_of_change_std,
               CASE WHEN sxx <= 1e-18 THEN ma * mb / (1 + ma * ma) ELSE sxy / sxx END AS autoreg_coef_mean,
               sqrt(greatest(CASE WHEN sxx <= 1e-18 THEN syy ELSE syy - sxy * sxy / sxx END / nn, 0)) AS residual_std_mean
        FROM ar_sums""",
    "feature_rows": """
        SELECT w.config_name, w.split, t.*, s.* EXCLUDE (sample_key) FROM time_features t JOIN spectral s USING (sample_key)
        JOIN (SELECT sample_key, config_name, split FROM windows) w USING (sample_key)""",
    "logits": f"SELECT {STABLE_SQL}, {_logits} AS z FROM feat4 WHERE split = 'test'",
    "weights": f"""
        SELECT {STABLE_SQL}, list_transform(e, lambda v: v / list_sum(e)) AS weights
        FROM (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM logits)""",
    "routed": f"""
        SELECT '{ROUTER_NAME}' AS router_name, {STABLE_SQL}, selected_model, selected_value, oracle_model, oracle_value,
               selected_value - oracle_value AS regret_to_oracle, selected_model = oracle_model AS oracle_label_correct,
               ent AS weight_entropy, ent / ln({float(len(EXPERTS))}) AS normalized_weight_entropy,
               list_max(weights) AS max_weight, {", ".join(f"weights[{i + 1}] AS weight_{e}" for i, e in enumerate(EXPERTS))}
        FROM (SELECT *, -list_sum(list_transform(weights, lambda w: w * ln(greatest(w, 1e-8)))) AS ent,
                     {_names}[list_position(weights, list_max(weights))] AS selected_model,
                     {_arr}[list_position(weights, list_max(weights))] AS selected_value
              FROM weights JOIN (SELECT sample_key, oracle_model, oracle_value, {", ".join(EXPERTS)} FROM labels
                                 WHERE metric = 'mae' AND split = 'test') USING (sample_key))""",
    "items": """
        SELECT model_name AS model, config_name, item_id, count(*) AS n_samples, round(avg(mae), 9) AS MAE, round(avg(mse), 9) AS MSE
        FROM forecasts WHERE split = 'test' GROUP BY ALL""",
    "choices": f"""
        SELECT c.*, r.* EXCLUDE (item_id) FROM (
          SELECT config_name, item_id, metric, {_names}[list_position({_arr}, list_min({_arr}))] AS oracle_model,
                 list_min({_arr}) AS oracle_value, list_min({_arr}) AS oracle_top1_value, {", ".join(EXPERTS)}, {_regrets}
          FROM (SELECT config_name, item_id, 'mae' AS metric,
                       {", ".join(f"max(CASE WHEN model = '{e}' THEN MAE END) AS {e}" for e in EXPERTS)} FROM items GROUP BY ALL
                UNION ALL
                SELECT config_name, item_id, 'mse',
                       {", ".join(f"max(CASE WHEN model = '{e}' THEN MSE END)" for e in EXPERTS)} FROM items GROUP BY ALL)) c
        JOIN regimes r USING (item_id)""",
    "faulty": f"""
        SELECT CASE WHEN window_index = 8 AND model_name = 'last' THEN 'v0' ELSE cache_version END AS cache_version,
               CASE WHEN window_index = 2 THEN sample_key || 'x' ELSE sample_key END AS sample_key,
               config_name, split, dataset_name, item_id, channel_id, window_index, history_length,
               CASE WHEN window_index = 3 AND model_name = 'mean' THEN pred_length + 1 ELSE pred_length END AS pred_length,
               model_name, expert_version, checkpoint_selection,
               CASE WHEN window_index = 4 AND model_name = 'drift' THEN list_transform(y_true, lambda v: v + 1) ELSE y_true END AS y_true,
               CASE WHEN window_index = 5 AND model_name = 'snaive' THEN y_pred[1 : len(y_pred) - 1]
                    WHEN window_index = 6 AND model_name = 'ses' THEN list_transform(y_pred, lambda v: CAST('NaN' AS DOUBLE))
                    ELSE y_pred END AS y_pred,
               CASE WHEN window_index = 7 AND model_name = 'last' THEN mae + 0.001 ELSE mae END AS mae, mse
        FROM (SELECT * FROM forecasts UNION ALL SELECT * FROM forecasts WHERE window_index = 0 AND model_name = 'last')
        WHERE NOT (window_index = 1 AND model_name = 'ses')""",
    "enriched": "SELECT l.*, r.cluster, r.group_name FROM labels l JOIN regimes r USING (item_id)",
}

_word = re.compile(r"[a-z_][a-z_0-9]*")


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by every derived table it mentions, directly or not."""
    tables = {**TABLES, **(extra or {})}
    order: list[str] = []

    def visit(text: str, busy: tuple[str, ...] = ()) -> None:
        words = set(_word.findall(text))
        for name in tables:
            if name in words and name not in order and name not in busy:
                visit(tables[name], (*busy, name))
                order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({tables[n]})" for n in order) + "\n" + body
