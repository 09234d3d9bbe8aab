"""Common table expressions for the SQL side of the registered queries."""

from __future__ import annotations

MONTHS = "['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']"


def season_case(month: str, calendar: str) -> str:
    december = "WINTER" if calendar == "B" else "POST_MONSOON"
    return (
        f"CASE WHEN {month} IN (1,2) THEN 'WINTER' WHEN {month} IN (3,4,5) THEN 'PRE_MONSOON' "
        f"WHEN {month} IN (6,7,8,9) THEN 'MONSOON' WHEN {month} IN (10,11) THEN 'POST_MONSOON' "
        f"WHEN {month} = 12 THEN '{december}' END"
    )


def _panel(name: str, inner: str) -> str:
    return (
        f"{name} AS (SELECT entity, year, month_no, {MONTHS}[month_no] AS month, "
        f"make_date(year, month_no, 1) AS date, measure FROM ({inner}))"
    )


# Quantity per brand and month.
P = _panel(
    "p",
    "SELECT p_brand AS entity, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month_no, "
    "sum(l_quantity) AS measure FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3",
)

# Order value per nation and month.
G = _panel(
    "g",
    "SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month_no, "
    "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS measure FROM orders "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3",
)


def features(source: str, name: str = "feat") -> str:
    """Rolling sums, baseline, anomaly, deficit, flags, z-score, condition."""
    return f"""{name}_a AS (
  SELECT *, year * 12 + month_no AS month_index,
    sum(measure) OVER (PARTITION BY entity ORDER BY year * 12 + month_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS measure_3m,
    sum(measure) OVER (PARTITION BY entity ORDER BY year * 12 + month_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS measure_6m,
    sum(measure) OVER (PARTITION BY entity ORDER BY year * 12 + month_no ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS measure_12m,
    avg(measure) OVER h AS historical_mean, coalesce(stddev_samp(measure) OVER h, 0) AS historical_std
  FROM {source}
  WINDOW h AS (PARTITION BY entity, month_no ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name}_b AS (
  SELECT *, measure - historical_mean AS anomaly,
    (measure - historical_mean) / nullif(historical_mean, 0) * 100 AS anomaly_pct,
    CASE WHEN measure IS NULL OR historical_mean IS NULL THEN NULL ELSE greatest(historical_mean - measure, 0) END AS deficit,
    CASE WHEN measure IS NULL THEN 1 ELSE 0 END AS missing,
    (measure - historical_mean) / nullif(historical_std, 0) AS zscore
  FROM {name}_a),
{name} AS (
  SELECT *, CASE WHEN anomaly_pct <= -25 THEN 1 ELSE 0 END AS stress,
    CASE WHEN zscore IS NULL THEN NULL WHEN zscore <= -2 THEN 'EXTREME_DRY' WHEN zscore <= -1.5 THEN 'SEVERE_DRY'
      WHEN zscore <= -1 THEN 'DRY' WHEN zscore <= 0 THEN 'BELOW_NORMAL' ELSE 'NORMAL_OR_WET' END AS condition
  FROM {name}_b)"""


def risk(source: str, name: str = "risk") -> list[str]:
    """Dry episodes, stress and risk on top of the features."""
    return [
        features(source),
        f"""ep_a AS (
  SELECT *, CASE WHEN condition IN ('DRY', 'SEVERE_DRY', 'EXTREME_DRY') THEN 1 ELSE 0 END AS is_dry FROM feat),
ep_b AS (
  SELECT *, CASE WHEN month_index = lag(month_index) OVER w + 1 THEN 1 ELSE 0 END AS is_consecutive,
    coalesce(lag(is_dry) OVER w, 0) AS previous_dry
  FROM ep_a WINDOW w AS (PARTITION BY entity ORDER BY month_index)),
ep_c AS (
  SELECT *, sum(CASE WHEN is_dry <> previous_dry OR is_consecutive = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY entity ORDER BY month_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode_id
  FROM ep_b),
ep_d AS (
  SELECT *, sum(is_dry) OVER (PARTITION BY entity, episode_id) AS dry_episode_length,
    sum(is_dry) OVER (PARTITION BY entity, episode_id ORDER BY month_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_length
  FROM ep_c),
ep_e AS (
  SELECT *, CASE WHEN is_dry = 1 AND dry_episode_length >= 3 THEN 1 ELSE 0 END AS persistent_drought_signal,
    least(greatest(0.8 * coalesce(least(greatest(-anomaly_pct, 0), 100), 0) + 10 * missing, 0), 100) AS stress_score
  FROM ep_d),
ep_f AS (
  SELECT *, least(greatest(coalesce(least(greatest(-25 * zscore, 0), 50), 0)
      + CAST(least(dry_episode_length, 6) AS DOUBLE) / 6 * 30 * is_dry + 20 * persistent_drought_signal, 0), 100) AS risk_score
  FROM ep_e),
{name} AS (
  SELECT *, CASE WHEN stress_score <= 20 THEN 'LOW' WHEN stress_score <= 40 THEN 'MODERATE' WHEN stress_score <= 60 THEN 'ELEVATED'
      WHEN stress_score <= 80 THEN 'HIGH' ELSE 'SEVERE' END AS stress_level,
    CASE WHEN risk_score <= 20 THEN 'LOW' WHEN risk_score <= 40 THEN 'MODERATE' WHEN risk_score <= 60 THEN 'ELEVATED'
      WHEN risk_score <= 80 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
    {season_case('month_no', 'A')} AS season
  FROM ep_f)""",
    ]


TARGETS = """tgt AS (
  SELECT * FROM (
    SELECT *, CASE WHEN max(persistent_drought_signal) OVER n3 = 1 THEN 1 ELSE 0 END AS target_3m_stress,
      CASE WHEN min(zscore) OVER n3 <= -1.5 THEN 1 ELSE 0 END AS target_3m_severe_anomaly,
      lead(month_index, 3) OVER (PARTITION BY entity ORDER BY month_index) AS ahead
    FROM risk WINDOW n3 AS (PARTITION BY entity ORDER BY month_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
  WHERE ahead = month_index + 3)"""

TEMPORAL = """temporal AS (
  SELECT *, lag_1m - lag_3m AS trend_3m, sin(month_no * 2 * pi() / 12) AS month_sin, cos(month_no * 2 * pi() / 12) AS month_cos
  FROM (
    SELECT *, lag(measure, 1) OVER w AS lag_1m, lag(measure, 2) OVER w AS lag_2m, lag(measure, 3) OVER w AS lag_3m,
      sum(measure) OVER (PARTITION BY entity ORDER BY month_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prev_3m,
      sum(measure) OVER (PARTITION BY entity ORDER BY month_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prev_6m,
      sum(measure) OVER (PARTITION BY entity ORDER BY month_index ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS prev_12m
    FROM tgt WINDOW w AS (PARTITION BY entity ORDER BY month_index)))"""

# One scored row per line item.
S = f"""s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r_name AS region, {season_case('month', 'B')} AS season, year, month, actual,
    probability, probability * probability AS probability_2, sqrt(probability) AS probability_3
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year,
      CAST(month(l_shipdate) AS INTEGER) AS month, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual,
      CAST((l_orderkey * 37 + l_linenumber * 11 + l_partkey * 7) % 1000 AS DOUBLE) / 1000 AS probability FROM lineitem)
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def confusion(source: str, name: str, by: str = "", threshold: str = "0.09", p: str = "probability", extra: str = "") -> str:
    """Confusion counts per slice."""
    alerted = f"({p} >= CAST({threshold} AS DOUBLE))"
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""{name} AS (SELECT {keys}
    count(*) FILTER (WHERE actual = 1 AND {alerted}) AS true_positive, count(*) FILTER (WHERE actual = 0 AND {alerted}) AS false_positive,
    count(*) FILTER (WHERE actual = 1 AND NOT {alerted}) AS false_negative, count(*) FILTER (WHERE actual = 0 AND NOT {alerted}) AS true_negative,
    avg({p}) AS average_probability, max({p}) AS maximum_probability, avg(({p} - actual) * ({p} - actual)) AS brier_score{extra}
  FROM {source}{group})"""


def rates(source: str, name: str) -> str:
    """Rates from confusion counts."""

    def share(a: str, b: str) -> str:
        return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"

    tp, fp, fn, tn = "true_positive", "false_positive", "false_negative", "true_negative"
    n = f"({tp} + {fp} + {fn} + {tn})"
    return f"""{name} AS (SELECT *, {n} AS observations, {tp} + {fn} AS events, {tp} + {fp} AS alerts,
    {share(f'({tp} + {fn})', n)} AS event_rate, {share(f'({tp} + {fp})', n)} AS alert_rate,
    {share(tp, f'({tp} + {fp})')} AS precision, {share(tp, f'({tp} + {fn})')} AS recall,
    {share(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS f1, {share(fp, f'({fp} + {tn})')} AS false_positive_rate,
    {share(fn, f'({fn} + {tp})')} AS false_negative_rate, {share(tp, f'({tp} + {fn})')} AS event_capture_rate
  FROM {source})"""


def ranking(source: str, name: str, by: str = "", p: str = "probability") -> str:
    """Average precision and ROC-AUC per slice, ties grouped."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""{name}_c AS (SELECT {keys}{p} AS score, count(*) FILTER (WHERE actual = 1) AS pos, count(*) FILTER (WHERE actual = 0) AS neg
  FROM {source} GROUP BY {keys}{p}),
{name}_r AS (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS cp, CAST(sum(neg) OVER w AS DOUBLE) AS cn FROM {name}_c
  WINDOW w AS ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (SELECT {keys}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * cp / (cp + cn)) / sum(pos) END AS pr_auc,
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN 1 - sum(pos * (cn - neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS roc_auc
  FROM {name}_r{group})"""


# Multiples of 0.1 as a float loop gives them, after a round trip through percent.
STEPS = "[0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7, 0.8, 0.9, 1.0]"


def quantile_edges(source: str, name: str, value: str, by: str = "", steps: str = STEPS, where: str = "") -> list[str]:
    """Interpolated quantiles as rows (by, edge), spelled out.

    Built-in quantile functions round the interpolation differently in the last
    digit, which matters where an edge meets a data value.
    """
    keys = by or "one"
    source_key = by or "1 AS one"
    return [
        f"{name}_o AS (SELECT {source_key}, {value} AS v, row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY {value}) - 1 AS i, "
        f"count(*) OVER ({'PARTITION BY ' + by if by else ''}) AS n FROM {source} WHERE {value} IS NOT NULL {where})",
        f"{name}_t AS (SELECT {keys}, (n - 1) * q AS pos FROM (SELECT DISTINCT {keys}, n FROM {name}_o) CROSS JOIN (SELECT unnest(CAST({steps} AS DOUBLE[])) AS q))",
        f"{name}_e AS (SELECT t.{keys}, a.v AS lo, b.v AS hi, pos - floor(pos) AS g FROM {name}_t t JOIN {name}_o a ON a.{keys} = t.{keys} AND a.i = floor(pos) "
        f"JOIN {name}_o b ON b.{keys} = t.{keys} AND b.i = ceil(pos))",
        f"{name} AS (SELECT {keys}, CASE WHEN g >= 0.5 THEN hi - (hi - lo) * (1 - g) ELSE lo + (hi - lo) * g END AS edge FROM {name}_e)",
    ]


def sweep(source: str, name: str, start: int, stop: int, step: int, by: str = "", p: str = "probability") -> list[str]:
    """All metrics at every threshold of a grid."""
    keys = f"{by}, " if by else ""
    return [
        f"""{name}_c AS (SELECT {keys}{p} AS score, count(*) FILTER (WHERE actual = 1) AS pos, count(*) FILTER (WHERE actual = 0) AS neg
  FROM {source} GROUP BY {keys}{p}),
{name}_g AS (SELECT CAST(k AS DOUBLE) / 1000 AS threshold FROM range({start}, {stop + 1}, {step}) AS t(k)),
{name}_k AS (SELECT {keys}threshold, sum(CASE WHEN score >= threshold THEN pos ELSE 0 END) AS true_positive,
    sum(CASE WHEN score >= threshold THEN neg ELSE 0 END) AS false_positive,
    sum(CASE WHEN score >= threshold THEN 0 ELSE pos END) AS false_negative,
    sum(CASE WHEN score >= threshold THEN 0 ELSE neg END) AS true_negative
  FROM {name}_c CROSS JOIN {name}_g GROUP BY {keys}threshold)""",
        rates(f"{name}_k", name),
    ]


COUNT_COLUMNS = "true_positive false_positive false_negative true_negative observations events alerts"
RATE_COLUMNS = "event_rate alert_rate precision recall f1 false_positive_rate false_negative_rate event_capture_rate"
METRIC_COLUMNS = RATE_COLUMNS + " average_probability maximum_probability brier_score"
