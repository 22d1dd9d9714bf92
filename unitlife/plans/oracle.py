"""DuckDB SQL for the registered queries, over the same tables. Queries without SQL fit models."""

from __future__ import annotations

from unitlife.operators.features import FEATURE_COLUMNS, REGISTRY
from unitlife.plans.registered import AS_OF, DRIFT_COLUMNS, SLICES
from unitlife.schema import HORIZON_GRID, HORIZONS, STANDING_FRACTIONS

FLEET = """
fleet AS (
  SELECT user_id AS unit_id, row_number() OVER w AS cycle_index, event_id AS file_cycle_number,
         ts AS cycle_start_time, value, event_type,
         CASE WHEN user_id % 7 = 0 AND event_type = 'error' THEN 43.0::DOUBLE ELSE 24.0::DOUBLE END
           AS ambient_temperature,
         round(1 - 1e-4::DOUBLE * sum(value) OVER w, 6) AS soh,
         3000 + value AS discharge_duration_s, 2.5::DOUBLE + value / 1000 AS voltage_min,
         30 + value / 10 AS temp_max,
         CASE WHEN event_type <> 'error' THEN 10000 - value END AS charge_duration_s,
         CASE WHEN event_type <> 'error' THEN value / 10000 END AS charge_current_end,
         CASE WHEN event_type <> 'error' THEN 25 + value / 20 END AS charge_temp_max
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
)"""

FEATURES = FLEET + """,
features AS (
  SELECT *, lag(soh) OVER u AS soh_prev,
         CASE WHEN count(soh) OVER f >= 2 THEN avg(soh) OVER f END AS soh_roll_mean,
         CASE WHEN count(soh) OVER f >= 2 THEN stddev_samp(soh) OVER f END AS soh_roll_std,
         CASE WHEN count(soh) OVER f = 5 THEN regr_slope(soh, cycle_index::DOUBLE) OVER f END AS fade_rate,
         lag(discharge_duration_s) OVER u AS discharge_duration_prev,
         lag(voltage_min) OVER u AS voltage_min_prev, lag(temp_max) OVER u AS temp_max_prev,
         (epoch_us(cycle_start_time) - lag(epoch_us(cycle_start_time)) OVER u) / 3.6e9::DOUBLE
           AS time_since_prev_cycle_h,
         CASE WHEN unit_id % 10 < 6 THEN 'train' WHEN unit_id % 10 = 6 THEN 'val'
              WHEN unit_id % 10 = 7 THEN 'test' END AS split
  FROM fleet
  WINDOW u AS (PARTITION BY unit_id ORDER BY cycle_index),
         f AS (PARTITION BY unit_id ORDER BY cycle_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
)"""

SLOPE = """,
slope AS (SELECT avg(soh - soh_prev) AS slope FROM features WHERE split = 'train')"""

THRESHOLDS = "(SELECT unnest([0.7::DOUBLE, 0.8::DOUBLE]) AS threshold)"

EOL = f""",
eol AS (
  SELECT unit_id, threshold, min(CASE WHEN soh < threshold THEN cycle_index END) AS eol_cycle
  FROM fleet, {THRESHOLDS} GROUP BY unit_id, threshold
)"""

SLOPE_RUL = """CASE WHEN slope >= 0 THEN NULL WHEN soh_prev < threshold THEN 0.0::DOUBLE
       ELSE (threshold - soh_prev) / slope END"""

STANDING = """,
standing AS (
  SELECT unit_id, cycle_index, soh_prev, split, threshold, soh,
         (eol_cycle - (cycle_index - 1))::DOUBLE AS rul_true
  FROM features JOIN eol USING (unit_id)
  WHERE cycle_index >= 10 AND soh_prev IS NOT NULL AND eol_cycle - (cycle_index - 1) > 0
)"""

SLOPE_POINTS = FEATURES + SLOPE + EOL + STANDING + f""",
slope_points AS (
  SELECT unit_id, cycle_index, split, 'global_slope' AS method, threshold, rul_true, {SLOPE_RUL} AS rul_pred
  FROM standing, slope WHERE split IN ('val', 'test')
)"""

SUMMARY = """
SELECT unit_id, threshold, method, count(*) AS n_points,
       count(*) FILTER (rul_pred IS NULL) AS n_censored_preds,
       round(avg(abs(rul_pred - rul_true)), 6) AS rul_mae_cycles,
       round(median(abs(rul_pred - rul_true)), 6) AS rul_median_ae_cycles,
       round(max(abs(rul_pred - rul_true)), 6) AS rul_max_ae_cycles
FROM {points} GROUP BY unit_id, threshold, method"""


# Over the lists h and y of ``curves``.
CROSSING = """
  SELECT *, CASE
    WHEN j = 1 THEN h[1]
    WHEN j > 1 THEN h[j - 1] + (y[j - 1] - threshold) * (h[j] - h[j - 1]) / (y[j - 1] - y[j])
    WHEN (y[-1] - y[-2]) / (h[-1] - h[-2]) < 0
      THEN h[-1] + (y[-1] - threshold) / -((y[-1] - y[-2]) / (h[-1] - h[-2])) END AS rul_pred
  FROM (SELECT *, coalesce(list_position(list_transform(y, lambda v: coalesce(v < threshold, false)), true), 0) AS j
        FROM {curves})"""


def _crossing(horizons, values: str) -> str:
    """The crossing rule over a list column ``y`` built by ``values``; adds ``rul_pred``."""
    h = "[" + ", ".join(f"{k}::DOUBLE" for k in horizons) + "]"
    return CROSSING.format(curves=f"(SELECT *, {h} AS h, {values} AS y FROM standing_rows)")


def _ridge(horizons) -> str:
    """``ridge(unit_id, cycle_index, split, soh, soh_prev, horizon, y, p)``: the closed form with scaled features, a
    centred label and alpha 1, solved by elimination per horizon."""
    n = len(FEATURE_COLUMNS)
    at = range(1, n + 1)
    each = lambda make: "[" + ", ".join(make(i) for i in at) + "]"
    gram = each(lambda i: "[" + ", ".join(
        [f"sum(z[{i}] * z[{j}]) + {int(i == j)}" for j in at] + [f"sum(z[{i}] * c)"]) + "]")
    return f"""
labelled AS (SELECT *, {_targets(horizons)} FROM features),
asked AS (
  SELECT unit_id, cycle_index, split, soh, soh_prev, unnest([{', '.join(f'{k}::INTEGER' for k in horizons)}]) AS horizon,
         unnest([{', '.join(f'soh_h{k}' for k in horizons)}]) AS y, [{', '.join(f'{c}::DOUBLE' for c in FEATURE_COLUMNS)}] AS x
  FROM labelled
),
fit AS (SELECT * FROM asked WHERE split = 'train' AND y IS NOT NULL),
med AS (SELECT horizon, {each(lambda i: f'median(x[{i}])')} AS m FROM fit GROUP BY horizon),
raw AS (SELECT horizon, y, {each(lambda i: f'coalesce(x[{i}], m[{i}])')} AS x FROM fit JOIN med USING (horizon)),
scale AS (
  SELECT horizon, avg(y) AS ay, {each(lambda i: f'avg(x[{i}])')} AS a,
         {each(lambda i: f'CASE WHEN stddev_pop(x[{i}]) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(x[{i}]) END')} AS s
  FROM raw GROUP BY horizon
),
z AS (
  SELECT horizon, y - ay AS c, {each(lambda i: f'(x[{i}] - a[{i}]) / s[{i}]')} AS z FROM raw JOIN scale USING (horizon)
),
solved AS (
  SELECT horizon, 1 AS k, {gram} AS g FROM z GROUP BY horizon
  UNION ALL
  SELECT horizon, k + 1, list_transform(g, lambda line, r: CASE
    WHEN r = k THEN list_transform(line, lambda v: v / line[k])
    ELSE list_transform(line, lambda v, j: v - line[k] * g[k][j] / g[k][k]) END)
  FROM solved WHERE k <= {n}
),
ridge AS (
  SELECT unit_id, cycle_index, split, soh, soh_prev, horizon, y,
         ay + {' + '.join(f'g[{i}][{n + 1}] * (coalesce(x[{i}], m[{i}]) - a[{i}]) / s[{i}]' for i in at)} AS p
  FROM asked JOIN med USING (horizon) JOIN scale USING (horizon) JOIN solved USING (horizon)
  WHERE k = {n + 1} AND split IN ('val', 'test')
)"""


GRID_CURVES = """
      grid AS (
        SELECT horizon FROM (
          SELECT horizon, min(count(y)) OVER (ORDER BY horizon) AS fewest FROM asked WHERE split = 'train' GROUP BY horizon)
        WHERE fewest >= 50),
      curves AS (
        SELECT unit_id, cycle_index, list(horizon::DOUBLE ORDER BY horizon) AS h, list(p ORDER BY horizon) AS y
        FROM ridge JOIN grid USING (horizon) GROUP BY unit_id, cycle_index),"""


def _targets(horizons) -> str:
    return ", ".join(
        f"lead(soh, {k - 1}) OVER (PARTITION BY unit_id ORDER BY cycle_index) AS soh_h{k}" for k in horizons)


METRICS = """,
metrics AS (
  SELECT split, method, horizon, unit_id, count(*) AS n, avg(abs(y - p)) AS mae,
         sqrt(avg((y - p) * (y - p))) AS rmse,
         CASE WHEN count(*) < 2 THEN NULL
              WHEN min(y) = max(y) THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
              ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2
  FROM forecasts WHERE split IN ('val', 'test') AND y IS NOT NULL AND soh_prev IS NOT NULL
  GROUP BY split, method, horizon, unit_id
)"""

LABELLED = f""",
labelled AS (SELECT *, {_targets(HORIZONS)} FROM features)"""
BASELINES = f""",
baseline_forecasts AS (
  {" UNION ALL ".join(
      f"SELECT split, unit_id, {k}::INTEGER AS horizon, soh_h{k} AS y, soh_prev, "
      f"'baseline_last_value' AS method, soh_prev AS p FROM labelled UNION ALL "
      f"SELECT split, unit_id, {k}::INTEGER, soh_h{k}, soh_prev, 'baseline_global_slope', "
      f"soh_prev + slope * {k} FROM labelled, slope" for k in HORIZONS)}
)"""
ERRORS = (FEATURES + SLOPE + LABELLED + BASELINES + ",\nforecasts AS (SELECT * FROM baseline_forecasts)" + METRICS)

PROBABILITIES = ", ".join(f"{p!r}::DOUBLE" for p in [i * 0.1 for i in range(10)] + [1.0])


def _psi(by: str = "") -> str:
    """PSI from the long tables ``ref(feature, x)`` and ``cur(by..., feature, x)``, without NULLs."""
    comma = f"{by}, " if by else ""
    return f"""
edge_lists AS (
  SELECT feature, count(*) AS n_ref,
         list_sort(list_distinct(list_transform(quantile_cont(x, [{PROBABILITIES}]), lambda q: round(q, 9)))) AS e
  FROM ref GROUP BY feature
),
edges AS (
  SELECT feature, n_ref, CASE WHEN len(e) >= 3 THEN e[2:len(e) - 1]
    ELSE [e[1] - greatest(abs(e[1]), 1.0::DOUBLE) * 1e-6::DOUBLE, e[1] + greatest(abs(e[1]), 1.0::DOUBLE) * 1e-6::DOUBLE]
    END AS edges
  FROM edge_lists
),
ref_counts AS (
  SELECT feature, len(list_filter(edges, lambda e: x >= e)) AS bin, count(*) AS n
  FROM ref JOIN edges USING (feature) GROUP BY ALL
),
cur_counts AS (
  SELECT {comma}feature, len(list_filter(edges, lambda e: x >= e)) AS bin, count(*) AS n
  FROM cur JOIN edges USING (feature) GROUP BY ALL
),
cur_sizes AS (SELECT {comma}feature, sum(n) AS n_cur FROM cur_counts GROUP BY ALL),
cells AS (
  SELECT {comma}feature, n_ref, n_cur, unnest(range(0, len(edges) + 1)) AS bin
  FROM cur_sizes JOIN edges USING (feature)
),
shares AS (
  SELECT {comma}cells.feature AS feature, greatest(coalesce(r.n, 0) / n_ref::DOUBLE, 1e-4::DOUBLE) AS a,
         greatest(coalesce(c.n, 0) / n_cur::DOUBLE, 1e-4::DOUBLE) AS b
  FROM cells LEFT JOIN ref_counts r USING (feature, bin) LEFT JOIN cur_counts c USING ({comma}feature, bin)
),
scored AS (SELECT {comma}feature, sum((b - a) * ln(b / a)) AS psi FROM shares GROUP BY ALL),
drift AS (
  SELECT {comma}feature, round(psi, 9) AS psi,
         CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate shift' ELSE 'significant shift' END AS rating
  FROM scored
)"""


def _long(columns, source: str, ids: str = "") -> str:
    comma = f"{ids}, " if ids else ""
    return " UNION ALL ".join(
        f"SELECT {comma}'{c}' AS feature, {c}::DOUBLE AS x FROM {source} WHERE {c} IS NOT NULL" for c in columns)


ITEMS = f"""
items AS (SELECT *, 7.0::DOUBLE AS l_constant FROM lineitem),
old_items AS (SELECT * FROM items WHERE l_shipdate < TIMESTAMP '1998-01-01'),
new_items AS (SELECT * FROM items WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
ref AS ({_long(DRIFT_COLUMNS, 'old_items')})"""
ITEM_DRIFT = f"{ITEMS}, cur AS ({_long(DRIFT_COLUMNS, 'new_items')}), {_psi()}"
SLICED = f"(SELECT *, (l_orderkey % {SLICES})::BIGINT AS batch_id FROM items)"
STREAM_DRIFT = f"{ITEMS}, cur AS ({_long(DRIFT_COLUMNS, SLICED, 'batch_id')}), {_psi('batch_id')}"


SETTLED = ", ".join(f"round({c}, 10) AS {c}" for c in FEATURE_COLUMNS)


LIVED = "(unit_id % 5 <> 0 OR cycle_index <= 12)"
SILENCED = ", ".join("CASE WHEN unit_id % 3 <> 1 THEN charge_current_end END AS charge_current_end"
                     if c == "charge_current_end" else c for c in FEATURE_COLUMNS)


def _fleet_drift(by: str, *, silenced: bool = False) -> str:
    columns, rows = (SILENCED, f" AND {LIVED}") if silenced else (", ".join(FEATURE_COLUMNS), "")
    return (f"{FEATURES}, settled AS (SELECT unit_id, split, {SETTLED} FROM features), train AS (SELECT * FROM settled WHERE split = 'train'), "
            f"held AS (SELECT {by}, {columns} FROM settled WHERE split IN ('val', 'test'){rows}), "
            f"ref AS ({_long(FEATURE_COLUMNS, 'train')}), cur AS ({_long(FEATURE_COLUMNS, 'held', by)}), {_psi(by)}")


def _with_no_data(by: str, groups: str) -> str:
    """The drift rows, and one without a number for every group and feature that has no value."""
    names = ", ".join(f"'{c}'" for c in FEATURE_COLUMNS)
    return f"""SELECT {by}, feature, psi, rating FROM drift
      UNION ALL
      SELECT {by}, feature, NULL, 'no data'
      FROM (SELECT DISTINCT {by} FROM {groups}), (SELECT unnest([{names}]) AS feature)
      WHERE ({by}, feature) NOT IN (SELECT ({by}, feature) FROM drift)"""


def _standing_cycles(rows: str = "true") -> str:
    return f"""
lengths AS (SELECT unit_id, max(cycle_index) AS max_cycle FROM fleet WHERE {rows} GROUP BY unit_id),
standing_cycles AS (
  SELECT unit_id, max_cycle, fraction, round_even(max_cycle * fraction, 0)::BIGINT AS standing_cycle
  FROM lengths, (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in STANDING_FRACTIONS)}]) AS fraction)
)"""


STANDING_CYCLES = _standing_cycles()


def _prefix(*, silenced: bool = False) -> str:
    columns, rows = (SILENCED, LIVED) if silenced else (", ".join(FEATURE_COLUMNS), "true")
    return f"""{FEATURES}, {_standing_cycles(rows)},
settled AS (SELECT unit_id, split, {SETTLED} FROM features),
train AS (SELECT * FROM settled WHERE split = 'train'),
asked AS (SELECT DISTINCT unit_id, standing_cycle FROM standing_cycles),
lived AS (SELECT unit_id, {columns} FROM settled WHERE {rows}),
seen AS (
  SELECT a.standing_cycle, f.* FROM lived f JOIN asked a ON f.unit_id = a.unit_id AND f.cycle_index <= a.standing_cycle
),
ref AS ({_long(FEATURE_COLUMNS, 'train')}),
cur AS ({_long(FEATURE_COLUMNS, 'seen', 'unit_id, standing_cycle')}),
{_psi('unit_id, standing_cycle')}"""


PREFIX = _prefix()

ROUTES = """
routed AS (
  SELECT user_id AS unit_id, event_id AS file_cycle_number, value,
         CASE WHEN value <= 2 THEN NULL WHEN value <= 5 THEN 0.0::DOUBLE ELSE value / 1000 + 1 END AS capacity_ah,
         CASE WHEN event_type = 'click' THEN 'charge' WHEN event_type = 'error' THEN 'impedance'
              WHEN event_type <> 'purchase' THEN 'unknown type' WHEN value <= 2 THEN 'no capacity'
              WHEN value <= 5 THEN 'non-positive capacity' ELSE 'discharge' END AS route
  FROM events
)"""

FLAWED = """
flawed AS (
  SELECT user_id AS unit_id, event_id // 40 AS cycle_index,
         CASE WHEN event_type <> 'error' THEN value / 10 END AS capacity_ah, value - 5 AS discharge_duration_s
  FROM events
)"""

COHORT = """
units AS (SELECT DISTINCT user_id AS unit_id FROM events),
cohort AS (
  SELECT unit_id, CASE WHEN unit_id % 10 < 6 THEN 'train' WHEN unit_id % 10 = 6 THEN 'val' ELSE 'test' END AS split
  FROM units WHERE unit_id % 10 < 8
),
excluded AS (SELECT unit_id FROM units WHERE unit_id % 10 >= 8)"""

DOUBLED = """,
doubled AS (SELECT * FROM cohort UNION ALL SELECT unit_id, 'test' FROM units WHERE unit_id % 4 = 3)"""

_FINE_FEATURES = ("soh_roll_mean", "soh_roll_std", "fade_rate", "voltage_min_prev",
                  "temp_max_prev", "charge_temp_max", "charge_current_end")


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["skip_counts"] = f"""WITH {ROUTES}
      SELECT unit_id, count(*) AS n_entries, count(*) FILTER (route = 'discharge') AS n_cycles,
             count(*) FILTER (route = 'no capacity') AS n_no_capacity,
             count(*) FILTER (route = 'non-positive capacity') AS n_non_positive,
             count(*) FILTER (route = 'unknown type') AS n_unknown
      FROM routed GROUP BY unit_id"""
    sql["charge_carry"] = f"""WITH {ROUTES},
      segmented AS (
        SELECT *, coalesce(sum(CASE WHEN route = 'discharge' THEN 1 ELSE 0 END) OVER (
            PARTITION BY unit_id ORDER BY file_cycle_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg
        FROM routed),
      charges AS (
        SELECT unit_id, seg, max_by(value, file_cycle_number) AS charge FROM segmented
        WHERE route = 'charge' GROUP BY unit_id, seg)
      SELECT s.unit_id, s.file_cycle_number, s.capacity_ah, charge * 100 AS charge_duration_s,
             charge / 1000 AS charge_current_end, (s.seg + 1)::INTEGER AS cycle_index
      FROM segmented s LEFT JOIN charges c ON s.unit_id = c.unit_id AND s.seg = c.seg
      WHERE s.route = 'discharge'"""
    three = "(value + value / 2 + 3.0::DOUBLE) / 3"
    sql["ingest_run"] = f"""WITH {ROUTES.replace('event_id AS file', 'ts, event_id AS file')},
      segmented AS (
        SELECT *, coalesce(sum(CASE WHEN route = 'discharge' THEN 1 ELSE 0 END) OVER (
            PARTITION BY unit_id ORDER BY file_cycle_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg
        FROM routed),
      charges AS (
        SELECT unit_id, seg, max_by(value, file_cycle_number) AS value FROM segmented
        WHERE route = 'charge' GROUP BY unit_id, seg),
      charged AS (
        SELECT unit_id, seg, round(value * 10, 9) AS charge_duration_s, 3.0::DOUBLE AS charge_current_end,
               round(greatest(value, 3.0::DOUBLE), 9) AS charge_temp_max, round({three}, 9) AS charge_temp_mean FROM charges)
      SELECT 'U' || s.unit_id AS battery_id, s.file_cycle_number::INTEGER AS file_cycle_number, ts AS cycle_start_time,
             24.0::DOUBLE AS ambient_temperature, round(capacity_ah, 9) AS capacity_ah,
             round(value * 10, 9) AS discharge_duration_s, round(least(value / 2, 3.0::DOUBLE), 9) AS voltage_min,
             round({three}, 9) AS voltage_mean, round({three}, 9) AS current_mean,
             round(greatest(value, 3.0::DOUBLE), 9) AS temp_max, round({three}, 9) AS temp_mean,
             charge_duration_s, charge_current_end, charge_temp_max, charge_temp_mean, (s.seg + 1)::INTEGER AS cycle_index
      FROM segmented s LEFT JOIN charged c ON s.unit_id = c.unit_id AND s.seg = c.seg
      WHERE s.route = 'discharge'"""
    nested = sql["ingest_run"].replace(
        "ts, event_id AS file_cycle_number", "ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS file_cycle_number")
    sql["ingest_landings"], sql["ingest_files"] = nested, nested
    sql["landed_copies"] = """SELECT (user_id % 2)::BIGINT AS batch, 'U' || user_id AS battery_id,
             (CASE WHEN user_id % 4 = 2 THEN 0 ELSE max((event_id % 2 = 0)::INTEGER) END)::BIGINT AS n_skipped
      FROM events GROUP BY user_id"""
    steps = ("rows", "rows WHERE capacity_ah IS NOT NULL", "one", "one WHERE capacity_ah > 0 AND capacity_ah < 3.2",
             "one WHERE capacity_ah > 0 AND capacity_ah < 3.2 AND discharge_duration_s > 0", "rows WHERE false")
    sql["rejections"] = f"""WITH {FLAWED}, rows AS (SELECT * FROM flawed),
      one AS (
        SELECT unit_id, cycle_index, min(capacity_ah) AS capacity_ah, min(discharge_duration_s) AS discharge_duration_s
        FROM rows WHERE capacity_ah IS NOT NULL GROUP BY unit_id, cycle_index),
      steps AS ({' UNION ALL '.join(f'SELECT {i} AS step, * FROM {rows}' for i, rows in enumerate(steps))}),
      per_key AS (
        SELECT step, count(*) AS n, count(*) FILTER (capacity_ah IS NULL) AS n_null,
               count(*) FILTER (capacity_ah <= 0 OR capacity_ah >= 3.2) AS n_capacity,
               count(*) FILTER (discharge_duration_s <= 0) AS n_duration FROM steps GROUP BY step, unit_id, cycle_index),
      counts AS (
        SELECT step, sum(n) AS n, sum(n_null) AS n_null, sum(n - 1) AS n_duplicate, sum(n_capacity) AS n_capacity,
               sum(n_duration) AS n_duration FROM per_key GROUP BY step)
      SELECT s.step::INTEGER AS step, CASE WHEN n IS NULL THEN 'empty' WHEN n_null > 0 THEN 'null'
               WHEN n_duplicate > 0 THEN 'duplicate' WHEN n_capacity > 0 THEN 'capacity'
               WHEN n_duration > 0 THEN 'duration' ELSE 'none' END AS rule,
             CASE WHEN n IS NULL THEN 0 WHEN n_null > 0 THEN n_null WHEN n_duplicate > 0 THEN n_duplicate
               WHEN n_capacity > 0 THEN n_capacity ELSE n_duration END::BIGINT AS n_rows
      FROM (SELECT unnest(range(0, {len(steps)})) AS step) s LEFT JOIN counts USING (step)
      UNION ALL SELECT {len(steps)}, 'written', n::BIGINT FROM counts WHERE step = 4"""
    sql["charge_carry_chunked"] = sql["charge_carry"]
    sql["fleet_chunked"] = (f"WITH {FLEET} SELECT unit_id, cycle_index, file_cycle_number, 2 * soh AS capacity_ah, "
                            "ambient_temperature FROM fleet")
    sql["waveform_summaries"] = """WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
      SELECT vec_id, round(v[-1], 9) AS discharge_duration_s, round(list_min(v), 9) AS voltage_min,
             round(list_avg(v), 9) AS voltage_mean, round(list_avg(v), 9) AS current_mean,
             round(list_max(v), 9) AS temp_max, round(list_avg(v), 9) AS temp_mean,
             round(v[-1], 9) AS charge_duration_s, round(v[1], 9) AS charge_current_end,
             round(list_max(v), 9) AS charge_temp_max, round(list_avg(v), 9) AS charge_temp_mean
      FROM w"""
    sql["datevec_times"] = "SELECT event_id, ts + INTERVAL 37250 MILLISECONDS AS start_time FROM events"
    sql["largest_copy"] = r"""WITH listing AS (
        SELECT url AS path, strlen(html) AS length,
               regexp_replace(regexp_extract(url, '([^/]+)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages),
      ranked AS (
        SELECT *, count(*) OVER (PARTITION BY stem) - 1 AS n_skipped,
               row_number() OVER (PARTITION BY stem ORDER BY length DESC, string_split(path, '/')) AS place
        FROM listing)
      SELECT stem, path, length::INTEGER AS length, n_skipped FROM ranked WHERE place = 1"""
    sql["validation_counts"] = f"""WITH {FLAWED}
      SELECT (SELECT count(*) FROM flawed) AS n_rows,
             (SELECT count(*) FROM flawed WHERE unit_id IS NULL OR cycle_index IS NULL OR capacity_ah IS NULL) AS n_null,
             (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM flawed GROUP BY unit_id, cycle_index)) AS n_duplicate,
             (SELECT count(*) FROM flawed WHERE NOT (capacity_ah > 0 AND capacity_ah < 3.2::DOUBLE)) AS n_capacity,
             (SELECT count(*) FROM flawed WHERE discharge_duration_s <= 0) AS n_duration"""
    sql["capacity_examples"] = f"""WITH {FLAWED}
      SELECT unit_id, cycle_index, capacity_ah FROM flawed
      WHERE NOT (capacity_ah > 0 AND capacity_ah < 3.2::DOUBLE)
      ORDER BY unit_id, cycle_index, capacity_ah LIMIT 5"""

    digits = {c: 9 for c in _FINE_FEATURES} | {"time_since_prev_cycle_h": 10}
    shown = ", ".join(f"round({c}, {digits[c]}) AS {c}" if c in digits else c for c in FEATURE_COLUMNS)
    sql["feature_build"] = f"WITH {FEATURES} SELECT unit_id, soh, {shown} FROM features"
    sql["feature_build_as_of"] = f"""WITH {FEATURES}
      SELECT unit_id, cycle_index, soh, soh_prev, round(soh_roll_mean, 9) AS soh_roll_mean,
             round(soh_roll_std, 9) AS soh_roll_std, round(fade_rate, 9) AS fade_rate
      FROM features WHERE cycle_index <= {AS_OF}"""
    sql["feature_coverage"] = f"WITH {FEATURES} " + " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {str(not held_back).lower()} AS included, count({name}) AS n_present, "
        f"count(*) - count({name}) AS n_missing FROM features" for name, _, held_back in REGISTRY)
    sql["horizon_targets"] = f"WITH {FLEET} SELECT unit_id, cycle_index, soh, {_targets(HORIZONS)} FROM fleet"
    sql["grid_labels"] = f"""WITH {FEATURES},
      labelled AS (SELECT *, {_targets(HORIZON_GRID)} FROM features),
      counts AS ({" UNION ALL ".join(
          f"SELECT {k}::INTEGER AS horizon, count(soh_h{k}) AS n_labels FROM labelled WHERE split = 'train'"
          for k in HORIZON_GRID)})
      SELECT horizon, n_labels, min(n_labels) OVER (ORDER BY horizon) >= 50 AS in_grid FROM counts"""
    sql["seen_and_future"] = f"""WITH {FLEET}
      SELECT unit_id, count(*) AS n, 'seen' AS part FROM fleet WHERE cycle_index <= {AS_OF} GROUP BY unit_id
      UNION ALL
      SELECT unit_id, count(*), 'future' FROM fleet WHERE cycle_index >= {AS_OF} GROUP BY unit_id"""

    assigned = f"WITH {FEATURES}, assigned AS (SELECT unit_id, cycle_index, split FROM features WHERE split IS NOT NULL)"
    sql["split_assignment"] = f"{assigned} SELECT * FROM assigned"
    sql["split_sizes"] = (f"{assigned} SELECT split, count(*) AS n_rows, count(DISTINCT unit_id) AS n_units "
                          "FROM assigned GROUP BY split")
    sql["split_units"] = f"{assigned} SELECT split, unit_id, count(*) AS n_rows FROM assigned GROUP BY split, unit_id"
    sql["unknown_units"] = f"""WITH {COHORT}
      SELECT unit_id FROM units WHERE unit_id NOT IN (SELECT unit_id FROM cohort WHERE split <> 'test')
        AND unit_id NOT IN (SELECT unit_id FROM excluded)"""
    sql["excluded_present"] = f"WITH {COHORT} SELECT unit_id FROM units INTERSECT SELECT unit_id FROM excluded"
    sql["leaked_units"] = f"""WITH {COHORT}{DOUBLED}
      SELECT unit_id, min(split) AS first_split, max(split) AS last_split FROM doubled
      GROUP BY unit_id HAVING count(DISTINCT split) > 1"""
    sql["cohort_mismatch"] = f"""WITH {COHORT},
      decided AS (SELECT unit_id FROM cohort WHERE split <> 'test' UNION SELECT unit_id FROM excluded)
      SELECT unit_id, 'undecided' AS side FROM (SELECT unit_id FROM units EXCEPT SELECT unit_id FROM decided)
      UNION ALL
      SELECT unit_id, 'not in fleet' FROM (SELECT unit_id FROM decided EXCEPT SELECT unit_id FROM units)"""
    sql["cohort_problems"] = f"""WITH {COHORT}{DOUBLED}
      SELECT unit_id, 'admitted and excluded' AS problem FROM doubled WHERE unit_id IN (SELECT unit_id FROM excluded)
      UNION ALL
      SELECT unit_id, 'unknown split label' FROM doubled WHERE unit_id % 10 = 7
      UNION ALL
      SELECT NULL, 'no unit in split ' || split FROM (SELECT unnest(['train', 'val', 'test']) AS split)
      WHERE split NOT IN (SELECT split FROM doubled WHERE unit_id % 10 <> 7)"""

    sql["fade_slope"] = f"WITH {FEATURES}{SLOPE} SELECT round(slope, 9) AS slope FROM slope"
    sql["baseline_metrics"] = f"""WITH {ERRORS}
      SELECT split, method, horizon, unit_id, n, round(mae, 12) AS mae, round(rmse, 12) AS rmse, round(r2, 6) AS r2
      FROM metrics"""
    sql["leakage_suspects"] = f"""WITH {ERRORS}
      SELECT split, method, horizon, unit_id, round(r2, 6) AS r2 FROM metrics
      WHERE r2 > 0.5::DOUBLE AND method NOT LIKE 'baseline_global%'"""
    sql["metrics_report"] = f"""WITH {ERRORS}
      SELECT split, unit_id, horizon, method, round(mae, 12) AS mae, round(rmse, 12) AS rmse FROM metrics"""

    sql["rul_points"] = f"""WITH {SLOPE_POINTS}
      SELECT unit_id, cycle_index, split, method, threshold, rul_true, round(rul_pred, 4) AS rul_pred FROM slope_points"""
    sql["rul_slope_error"] = f"WITH {SLOPE_POINTS} {SUMMARY.format(points='slope_points')}"
    sql["rul_slope_error_chunked"] = sql["rul_slope_error"]
    observed = "[" + ", ".join(f"soh_h{k}" for k in HORIZON_GRID) + "]"
    sql["rul_trajectory_points"] = f"""WITH {FEATURES}{EOL}{STANDING},
      labelled AS (SELECT unit_id, cycle_index, {_targets(HORIZON_GRID)} FROM fleet),
      standing_rows AS (SELECT * FROM standing JOIN labelled USING (unit_id, cycle_index)),
      crossed AS ({_crossing(HORIZON_GRID, observed)})
      SELECT unit_id, cycle_index, 'observed_trajectory' AS method, threshold, rul_true, round(rul_pred, 6) AS rul_pred
      FROM crossed"""
    line = "[" + ", ".join(f"soh_prev + slope * {k}" for k in HORIZON_GRID) + "]"
    sql["rul_trajectory_error"] = f"""WITH {SLOPE_POINTS},
      standing_rows AS (SELECT * FROM standing, slope WHERE split IN ('val', 'test')),
      crossed AS ({_crossing(HORIZON_GRID, line)}),
      both_methods AS (
        SELECT unit_id, threshold, method, rul_true, rul_pred FROM slope_points
        UNION ALL SELECT unit_id, threshold, 'baseline_trajectory', rul_true, rul_pred FROM crossed)
      {SUMMARY.format(points='both_methods')}"""
    sql["eol_cycles"] = f"WITH {FLEET}{EOL} SELECT unit_id, threshold, eol_cycle FROM eol"
    sql["censored_units"] = f"""WITH {FEATURES}{EOL}
      SELECT DISTINCT unit_id, threshold, split FROM eol JOIN features USING (unit_id)
      WHERE eol_cycle IS NULL AND split IS NOT NULL"""

    sql["drift_report"] = f"WITH {ITEM_DRIFT} SELECT * FROM drift"
    sql["worst_drift"] = f"WITH {ITEM_DRIFT} SELECT * FROM drift ORDER BY psi DESC, feature LIMIT 1"
    sql["drift_edges"] = f"""WITH {ITEM_DRIFT}
      SELECT feature, n_ref AS n, unnest(range(0, len(edges)))::INTEGER AS position, round(unnest(edges), 9) AS edge
      FROM edges"""
    sql["drift_histogram"] = f"""WITH {ITEM_DRIFT},
      grid AS (SELECT feature, unnest(range(0, 10)) AS bin FROM edges)
      SELECT grid.feature AS feature, grid.bin::INTEGER AS bin, coalesce(n, 0) AS n
      FROM grid LEFT JOIN cur_counts USING (feature, bin)"""
    sql["drift_by_split"] = f"WITH {_fleet_drift('split')} {_with_no_data('split', 'held')}"
    sql["drift_by_unit"] = f"WITH {_fleet_drift('split, unit_id')} {_with_no_data('split, unit_id', 'held')}"
    sql["drift_by_unit_silenced"] = (
        f"WITH {_fleet_drift('split, unit_id', silenced=True)} {_with_no_data('split, unit_id', 'held')}")
    sql["drift_edges_narrowed"] = sql["drift_edges"]
    sql["drift_stream"] = f"WITH {STREAM_DRIFT} SELECT batch_id, feature, psi, rating FROM drift"

    curve = "[" + ", ".join(str(k) for k in HORIZON_GRID) + "]"
    sql["projections"] = f"""WITH {FEATURES}{SLOPE}, {STANDING_CYCLES},
      stood AS (
        SELECT f.unit_id, fraction, max_cycle, cycle_index, soh, soh_prev
        FROM features f JOIN standing_cycles s ON f.unit_id = s.unit_id AND f.cycle_index = s.standing_cycle
        WHERE soh_prev IS NOT NULL AND split IN ('val', 'test'))
      SELECT unit_id, NULL::DOUBLE AS fraction, 'actual' AS series, cycle_index::DOUBLE AS x, round(soh, 9) AS soh
      FROM features WHERE split IN ('val', 'test')
      UNION ALL
      SELECT unit_id, fraction, 'baseline', (cycle_index - 1 + k)::DOUBLE, round(soh_prev + slope * k, 9)
      FROM stood, slope, (SELECT unnest({curve}) AS k) WHERE cycle_index - 1 + k <= max_cycle + 25
      UNION ALL
      SELECT unit_id, fraction, 'model', (cycle_index - 1 + k)::DOUBLE, round(soh_prev + 2 * slope * k, 9)
      FROM stood, slope, (SELECT unnest({curve}) AS k) WHERE cycle_index - 1 + k <= max_cycle + 25"""
    steep = "[" + ", ".join(f"soh_prev + 2 * slope * {k}" for k in HORIZON_GRID) + "]"
    sql["point_in_time"] = f"""WITH {FEATURES}{SLOPE}{EOL}, {STANDING_CYCLES},
      stood AS (
        SELECT DISTINCT f.unit_id, cycle_index, soh, soh_prev
        FROM features f JOIN standing_cycles s ON f.unit_id = s.unit_id AND f.cycle_index = s.standing_cycle
        WHERE soh_prev IS NOT NULL),
      answered AS (
        SELECT stood.*, threshold, CASE WHEN eol_cycle > cycle_index - 1 THEN (eol_cycle - (cycle_index - 1))::DOUBLE END AS rul_true,
               {SLOPE_RUL} AS rul_baseline
        FROM stood JOIN eol USING (unit_id), slope),
      standing_rows AS (SELECT answered.*, slope FROM answered, slope),
      crossed AS ({_crossing(HORIZON_GRID, steep)})
      SELECT unit_id, cycle_index, soh, soh_prev, threshold, rul_true, round(rul_baseline, 4) AS rul_baseline,
             round(rul_baseline - rul_true, 4) AS delta_baseline, round(rul_pred, 4) AS rul_model,
             round(rul_pred - rul_true, 4) AS delta_model FROM crossed"""
    standing = "unit_id, standing_cycle"
    sql["prefix_drift"] = f"WITH {PREFIX} {_with_no_data(standing, 'seen')}"
    sql["prefix_drift_silenced"] = f"WITH {_prefix(silenced=True)} {_with_no_data(standing, 'seen')}"
    sql["worst_prefix_drift"] = f"""WITH {PREFIX},
      ranked AS (SELECT *, row_number() OVER (PARTITION BY unit_id, standing_cycle ORDER BY psi DESC, feature) AS place FROM drift)
      SELECT unit_id, standing_cycle, feature, psi, rating FROM ranked WHERE place = 1"""

    sql["fleet_audit"] = f"""WITH {FLEET},
      audit AS (
        SELECT unit_id, count(*) AS n, round_even(min_by(soh, cycle_index), 3) AS soh_first,
               round_even(max_by(soh, cycle_index), 3) AS soh_last, round_even(min(soh), 3) AS soh_min,
               round_even(max(soh), 3) AS soh_max, count(DISTINCT ambient_temperature) AS n_ambients
        FROM fleet GROUP BY unit_id)
      SELECT *, concat_ws('; ', CASE WHEN soh_max > 1.005::DOUBLE THEN 'SoH > 1 (impossible)' END,
          CASE WHEN soh_first < 0.7::DOUBLE THEN 'below EOL at first cycle' END,
          CASE WHEN soh_min < 0.2::DOUBLE THEN 'near-zero capacity runs' END,
          CASE WHEN n_ambients > 1 THEN 'ambient changes mid-experiment' END,
          CASE WHEN n < 30 THEN 'very short run' END) AS flags
      FROM audit"""
    sql["ambient_settings"] = (f"WITH {FLEET} SELECT unit_id, ambient_temperature, count(*) AS n FROM fleet "
                               "GROUP BY unit_id, ambient_temperature")
    sql["run_classes"] = f"""WITH {FLEET}
      SELECT unit_id, cycle_index, soh, round(voltage_min, 9) AS voltage_min,
             CASE WHEN soh < 0.7::DOUBLE THEN 'aborted' ELSE 'complete' END AS run FROM fleet"""
    sql["aborted_runs"] = (f"WITH {FLEET} SELECT unit_id, count(*) AS n_aborted FROM fleet "
                           "WHERE soh < 0.7::DOUBLE GROUP BY unit_id")
    sql["hot_cycles"] = f"WITH {FLEET} SELECT unit_id, cycle_index, soh FROM fleet WHERE ambient_temperature > 30"
    sql["fleet_size"] = f"WITH {FLEET} SELECT count(*) AS n_rows, count(DISTINCT unit_id) AS n_units FROM fleet"

    sql["feature_medians"] = f"""WITH {FEATURES}, train AS (SELECT * FROM features WHERE split = 'train'),
      ref AS ({_long(FEATURE_COLUMNS, 'train')})
      SELECT feature, count(*) AS n, round(median(x), 6) AS median, round(avg(x), 6) AS mean,
             round(CASE WHEN stddev_pop(x) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(x) END, 6) AS std
      FROM ref GROUP BY feature"""
    sql["feature_medians_narrowed"] = sql["feature_medians"]
    sql["ridge_forecast"] = f"""WITH RECURSIVE {FEATURES}, {_ridge(HORIZONS)}
      SELECT unit_id, cycle_index, horizon, round(p, 6) AS prediction FROM ridge
      WHERE soh_prev IS NOT NULL AND y IS NOT NULL"""
    rounded = ", ".join(
        f"CASE WHEN method LIKE 'baseline%' THEN round({c}, 12) ELSE round({c}, 6) END AS {c}" for c in ("mae", "rmse"))
    sql["ridge_metrics"] = f"""WITH RECURSIVE {FEATURES}{SLOPE}, {_ridge(HORIZONS)}{BASELINES},
      forecasts AS (
        SELECT * FROM baseline_forecasts
        UNION ALL SELECT split, unit_id, horizon, y, soh_prev, 'ridge_autoregressive', p FROM ridge){METRICS}
      SELECT split, method, horizon, unit_id, n, {rounded}, round(r2, 6) AS r2 FROM metrics"""
    unknown = ", ".join(f"CASE WHEN method LIKE 'baseline%' THEN round({c}, {n}) END AS {c}"
                        for c, n in (("mae", 12), ("rmse", 12), ("r2", 6)))
    sql["boosted_metrics"] = f"""WITH {FEATURES}{SLOPE}{LABELLED}{BASELINES},
      forecasts AS (
        SELECT * FROM baseline_forecasts
        UNION ALL SELECT split, unit_id, horizon, y, soh_prev, unnest(['gbt_autoregressive', 'gbt_telemetry']), p
        FROM baseline_forecasts WHERE method = 'baseline_last_value'){METRICS}
      SELECT split, method, horizon, unit_id, n, {unknown} FROM metrics"""
    sql["rul_model_error"] = f"""WITH RECURSIVE {FEATURES}{SLOPE}{EOL}{STANDING},
      slope_points AS (
        SELECT unit_id, threshold, 'global_slope' AS method, rul_true, {SLOPE_RUL} AS rul_pred
        FROM standing, slope WHERE split IN ('val', 'test')), {_ridge(HORIZON_GRID)},
{GRID_CURVES}
      standing_curves AS (
        SELECT s.*, h, y FROM standing s JOIN curves USING (unit_id, cycle_index) WHERE split IN ('val', 'test')),
      crossed AS ({CROSSING.format(curves='standing_curves')}),
      both_methods AS (
        SELECT unit_id, threshold, method, rul_true, rul_pred FROM slope_points
        UNION ALL SELECT unit_id, threshold, 'ridge_trajectory', rul_true, rul_pred FROM crossed)
      {SUMMARY.replace(', 6)', ', 3)').format(points='both_methods')}"""
    sql["projections_fitted"] = f"""WITH RECURSIVE {FEATURES}{SLOPE}, {STANDING_CYCLES}, {_ridge(HORIZON_GRID)},{GRID_CURVES}
      stood AS (
        SELECT f.unit_id, fraction, max_cycle, cycle_index, soh_prev
        FROM features f JOIN standing_cycles s ON f.unit_id = s.unit_id AND f.cycle_index = s.standing_cycle
        WHERE soh_prev IS NOT NULL AND split IN ('val', 'test')),
      ahead AS (SELECT *, cycle_index - 1 + horizon AS x FROM stood, grid, slope WHERE cycle_index - 1 + horizon <= max_cycle + 25)
      SELECT unit_id, NULL::DOUBLE AS fraction, 'actual' AS series, cycle_index::DOUBLE AS x, round(soh, 6) AS soh
      FROM features WHERE split IN ('val', 'test')
      UNION ALL SELECT unit_id, fraction, 'baseline', x::DOUBLE, round(soh_prev + slope * horizon, 6) FROM ahead
      UNION ALL SELECT a.unit_id, fraction, 'model', x::DOUBLE, round(p, 6)
      FROM ahead a JOIN ridge r ON a.unit_id = r.unit_id AND a.cycle_index = r.cycle_index AND a.horizon = r.horizon"""
    sql["point_in_time_fitted"] = f"""WITH RECURSIVE {FEATURES}{SLOPE}{EOL}, {STANDING_CYCLES}, {_ridge(HORIZON_GRID)},{GRID_CURVES}
      stood AS (
        SELECT DISTINCT f.unit_id, cycle_index, soh, soh_prev
        FROM features f JOIN standing_cycles s ON f.unit_id = s.unit_id AND f.cycle_index = s.standing_cycle
        WHERE soh_prev IS NOT NULL AND split IN ('val', 'test')),
      answered AS (
        SELECT stood.*, threshold, h, y, CASE WHEN eol_cycle > cycle_index - 1 THEN (eol_cycle - (cycle_index - 1))::DOUBLE END AS rul_true,
               {SLOPE_RUL} AS rul_baseline
        FROM stood JOIN eol USING (unit_id) JOIN curves USING (unit_id, cycle_index), slope),
      crossed AS ({CROSSING.format(curves='answered')})
      SELECT unit_id, cycle_index, soh, soh_prev, threshold, rul_true, round(rul_baseline, 4) AS rul_baseline,
             round(rul_baseline - rul_true, 4) AS delta_baseline, round(rul_pred, 3) AS rul_model,
             round(rul_pred - rul_true, 3) AS delta_model FROM crossed"""
    points = "SELECT unit_id, threshold, unnest(['global_slope', 'gbt_trajectory']) AS method, rul_true, rul_pred FROM slope_points"
    settled = ", ".join(f"CASE WHEN method = 'global_slope' THEN {c} END AS {c}" for c in (
        "n_censored_preds", "rul_mae_cycles", "rul_median_ae_cycles", "rul_max_ae_cycles"))
    sql["rul_boosted_counts"] = f"""WITH {FEATURES}{SLOPE}{EOL}{STANDING},
      slope_points AS (
        SELECT unit_id, threshold, rul_true, {SLOPE_RUL} AS rul_pred FROM standing, slope WHERE split IN ('val', 'test')),
      both_methods AS ({points}), summary AS ({SUMMARY.replace(', 6)', ', 3)').format(points='both_methods')})
      SELECT unit_id, threshold, method, n_points, {settled} FROM summary"""
    sql["rul_records"], sql["rul_summary_records"] = sql["rul_points"], sql["rul_slope_error"]
    sql["artifact_metrics"], sql["artifact_forecast"] = sql["ridge_metrics"], sql["ridge_forecast"]
    sql["rul_run_censored"] = sql["censored_units"].replace("DISTINCT unit_id, threshold, split", "DISTINCT unit_id, threshold").replace(
        "split IS NOT NULL", "split IN ('val', 'test')")
    sql["report_soh"] = f"SELECT split, unit_id, horizon, method, mae, rmse FROM ({sql['ridge_metrics']})"
    sql["report_rul"] = sql["rul_model_error"].replace("'ridge_trajectory'", "'gbt_trajectory'")
    sql["report_drift"] = (
        f"SELECT split || ' ' || unit_id AS compared_to_train, feature, psi, rating FROM ({sql['drift_by_unit']})")
    sql["report_projection"] = sql["projections_fitted"]
    return sql
