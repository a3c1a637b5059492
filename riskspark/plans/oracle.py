"""The same queries as SQL for a second engine, as named steps and one select per query."""

from __future__ import annotations

import re

from riskspark.functions.display import USD_TO_IDR
from riskspark.operators.clean import INPUT_BOUNDS
from riskspark.operators.policy import DECISION_LABELS, DECISION_TEXTS
from riskspark.operators.profile import DERIVED_HISTOGRAMS
from riskspark.operators.report import CONTRIBUTION_LABELS, FEATURE_HINTS, FEATURE_LABELS, NO_HINT
from riskspark.plans import oracle_forest
from riskspark.plans.scorecard import SCALED_INTERCEPT, SCALED_WEIGHTS, THRESHOLD
from riskspark.schema import DERIVED_FEATURES, FEATURE_COLS, RAW_FEATURES

NUMERIC = ["target", *RAW_FEATURES]
DOUBLES = {"revolving_utilization", "debt_ratio", "monthly_income", "num_dependents", "income_per_dependent",
           "monthly_debt", "dti_adjusted", "credit_lines_per_age", "log_income"}


def r(expr: str, digits: int = 6) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0e0)"


def rounded(cols, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" if c in DOUBLES else c for c in cols)


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(key: str, values: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items()) + f" ELSE {default} END"


STEPS: dict[str, str] = {}

STEPS["li"] = """
  SELECT l_orderkey,
         COUNT(*) AS n_lines,
         COUNT(DISTINCT l_suppkey % 4) AS n_grp,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross,
         CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax,
         SUM(CASE WHEN l_partkey % 20 = 0 THEN 1 ELSE 0 END) AS d30,
         SUM(CASE WHEN l_partkey % 50 = 1 THEN 1 ELSE 0 END) AS d60,
         SUM(CASE WHEN l_partkey % 40 = 2 THEN 1 ELSE 0 END) AS d90
  FROM lineitem GROUP BY l_orderkey"""

STEPS["b"] = """
  SELECT o.o_orderkey AS id,
         COALESCE(li.gross, 0.0) / o.o_totalprice * 0.4 AS revolving_utilization,
         CASE WHEN o.o_orderkey % 997 = 1 THEN 0
              ELSE 18 + (o.o_custkey * 7 + o.o_orderkey) % 84 END AS age,
         COALESCE(li.d30, 0) AS late_30_59,
         COALESCE(li.tax, 0.0) * 3.0 AS debt_ratio,
         CASE WHEN o.o_orderkey % 5 = 3 THEN NULL ELSE o.o_totalprice / 40.0 END AS monthly_income,
         COALESCE(li.n_lines, 0) + c.c_nationkey % 10 AS open_credit_lines,
         COALESCE(li.d90, 0) AS late_90d,
         COALESCE(li.n_grp, 0) AS real_estate_loans,
         COALESCE(li.d60, 0) AS late_60_89,
         CASE WHEN o.o_orderkey % 37 = 5 THEN NULL ELSE CAST(o.o_custkey % 5 AS DOUBLE) END AS num_dependents,
         (o.o_orderkey * 7919 + o.o_custkey * 104729) % 1000 AS noise
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey"""

STEPS["borrowers"] = """
  SELECT CAST(id AS BIGINT) AS id,
       CAST(CASE WHEN noise < 20 + 150 * LEAST(late_90d, 3) + 90 * LEAST(late_60_89, 3)
                 + 50 * LEAST(late_30_59, 3)
                 + CASE WHEN revolving_utilization > 1.0 THEN 90 ELSE 0 END
                 + CASE WHEN age < 35 THEN 30 ELSE 0 END
            THEN 1 ELSE 0 END AS INT) AS target,
       CAST(revolving_utilization AS DOUBLE) AS revolving_utilization, CAST(age AS INT) AS age,
       CAST(late_30_59 AS INT) AS late_30_59, CAST(debt_ratio AS DOUBLE) AS debt_ratio,
       CAST(monthly_income AS DOUBLE) AS monthly_income, CAST(open_credit_lines AS INT) AS open_credit_lines,
       CAST(late_90d AS INT) AS late_90d, CAST(real_estate_loans AS INT) AS real_estate_loans,
       CAST(late_60_89 AS INT) AS late_60_89, CAST(num_dependents AS DOUBLE) AS num_dependents
  FROM b"""

AGE_GROUP = ("CASE WHEN age > 100 OR age <= 0 THEN NULL WHEN age <= 30 THEN '<30' WHEN age <= 45 THEN '30-45' "
             "WHEN age <= 60 THEN '45-60' ELSE '60+' END")
CAPPED = "CASE WHEN revolving_utilization > 1.5e0 THEN 1.5e0 ELSE revolving_utilization END"
STEPS["aged"] = "SELECT * FROM borrowers WHERE age > 0 AND age <= 95"
STEPS["grouped"] = (
    f"SELECT * REPLACE ({CAPPED} AS revolving_utilization), {AGE_GROUP} AS age_group FROM aged"
)
STEPS["medians"] = "SELECT age_group, quantile_cont(monthly_income, 0.5) AS median FROM grouped GROUP BY age_group"
STEPS["cleaned"] = """
  SELECT g.* EXCLUDE (age_group) REPLACE (
           COALESCE(g.monthly_income, m.median,
                    (SELECT quantile_cont(monthly_income, 0.5) FROM grouped)) AS monthly_income,
           COALESCE(g.num_dependents, 0e0) AS num_dependents)
  FROM grouped g LEFT JOIN medians m ON g.age_group = m.age_group"""
STEPS["featured"] = """
  SELECT *, CAST(total_late_payments > 0 AS INT) AS ever_late,
         monthly_debt / (monthly_income + 1) AS dti_adjusted
  FROM (SELECT *,
         CAST(late_30_59 + late_60_89 + late_90d AS INT) AS total_late_payments,
         CAST(late_30_59 + 2 * late_60_89 + 4 * late_90d AS INT) AS weighted_late_score,
         monthly_income / (num_dependents + 1) AS income_per_dependent,
         debt_ratio * monthly_income AS monthly_debt,
         CAST(CASE WHEN revolving_utilization <= -0.01e0 THEN NULL WHEN revolving_utilization <= 0.3e0 THEN 0
              WHEN revolving_utilization <= 0.7e0 THEN 1 WHEN revolving_utilization <= 1e0 THEN 2 ELSE 3 END AS INT)
           AS utilization_risk,
         round_even(open_credit_lines / CAST(age AS DOUBLE) * 1e4, 0) / 1e4 AS credit_lines_per_age,
         ln(1 + monthly_income) AS log_income
       FROM cleaned)"""


def split_of(source: str) -> str:
    return f"""
  SELECT * EXCLUDE (rk, cnt), CASE WHEN rk <= 0.2e0 * cnt THEN 'test' WHEN rk <= 0.4e0 * cnt THEN 'val'
         ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || id), id) AS rk,
               count(*) OVER (PARTITION BY target) AS cnt FROM {source})"""


STEPS["splits"] = split_of("featured")
STEPS["aged_split"] = split_of("aged")
STEPS["params"] = (
    "SELECT " + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS c_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) - "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS s_{c}" for c in FEATURE_COLS
    ) + " FROM splits WHERE split = 'train'"
)


def scaled_expr(c: str) -> str:
    return f"({c} - c_{c}) / CASE WHEN s_{c} < 2.220446049250313e-15 THEN 1e0 ELSE s_{c} END"


STEPS["scaled"] = (
    "SELECT splits.*, " + ", ".join(f"{scaled_expr(c)} AS z_{c}" for c in FEATURE_COLS) + " FROM splits, params"
)
STEPS["scored"] = (
    "SELECT *, 1e0 / (1e0 + exp(-margin)) AS prob FROM (SELECT *, CAST("
    + f"{SCALED_INTERCEPT}" + " AS DOUBLE)"
    + "".join(f" + CAST({SCALED_WEIGHTS[c]} AS DOUBLE) * z_{c}" for c in FEATURE_COLS if c in SCALED_WEIGHTS)
    + " AS margin FROM scaled)"
)
STEPS["means"] = "SELECT " + ", ".join(f"avg(z_{c}) AS m_{c}" for c in FEATURE_COLS) + " FROM scaled WHERE split = 'train'"
STEPS["contrib"] = (
    "SELECT id, unnest([" + ", ".join(
        f"{{'position': {i}, 'feature': '{c}', 'value': CAST({c} AS DOUBLE), 'contribution': "
        + r(f"CAST({SCALED_WEIGHTS[c]} AS DOUBLE) * (z_{c} - m_{c})") + "}"
        for i, c in enumerate(FEATURE_COLS)
    ) + "], recursive := true) FROM scaled, means WHERE split = 'test'"
)
STEPS["importance"] = """
  SELECT feature, mean_abs, CAST(row_number() OVER (ORDER BY mean_abs DESC, position) AS INT) AS rank
  FROM (SELECT feature, position, avg(abs(contribution)) AS mean_abs FROM contrib GROUP BY feature, position)"""
STEPS["by_size"] = """
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY -abs(contribution), position) AS place,
         max(abs(contribution)) OVER (PARTITION BY id) AS most FROM contrib"""

# The same over every scored application instead of the test rows.
STEPS["contrib_all"] = STEPS["contrib"].replace(" WHERE split = 'test'", "")
STEPS["importance_all"] = STEPS["importance"].replace("FROM contrib ", "FROM contrib_all ")
STEPS["by_size_all"] = STEPS["by_size"].replace("FROM contrib", "FROM contrib_all")

MARGIN = {
    "a": """-1.2e0 + 0.9e0 * LEAST(revolving_utilization, 1.5e0) + 1.1e0 * late_90d + 0.6e0 * late_60_89
             + 0.35e0 * late_30_59 - 0.012e0 * (age - 50)""",
    "b": "-0.9e0 + 0.5e0 * LEAST(revolving_utilization, 1.5e0) + 0.9e0 * (late_90d + late_60_89 + late_30_59)",
}


def card_of(source: str, margin: str, cols: str = "id, target") -> str:
    return f"""
  SELECT *, 1e0 / (1e0 + exp(-margin)) AS prob, CAST(ROUND(margin * 1e6) AS BIGINT) AS score
  FROM (SELECT {cols}, {margin} AS margin FROM {source})"""


STEPS["card"] = card_of("aged", MARGIN["a"])
STEPS["models"] = (
    card_of("aged_split", MARGIN["a"], "'card_a' AS model, split, target") + " WHERE split IN ('val', 'test') UNION ALL "
    + card_of("aged_split", MARGIN["b"], "'card_b' AS model, split, target") + " WHERE split IN ('val', 'test')"
)


def ranked_of(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""
  SELECT *, coalesce(sum(neg) OVER (ORDER_BEFORE), 0) AS neg_before,
         sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp,
         sum(pos) OVER ({part}) AS p_all, sum(neg) OVER ({part}) AS n_all
  FROM (SELECT {keys}score, sum(target) AS pos, sum(1 - target) AS neg FROM {source} GROUP BY {keys}score)""".replace(
        "ORDER_BEFORE", f"{part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    )


STEPS["ranked"] = ranked_of("card")
STEPS["ranked_models"] = ranked_of("models", "model, split")
AUC = "CAST(sum(pos * (neg_before + neg / 2e0)) AS DOUBLE) / (max(p_all) * CAST(max(n_all) AS DOUBLE))"
AP = "sum(CAST(pos AS DOUBLE) / p_all * tp / (tp + fp))"


def confusion_of(source: str, keys: str = "") -> str:
    head, tail = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {head}count(*) FILTER (prob >= 0.5 AND target = 1) AS tp, count(*) FILTER (prob >= 0.5 AND target = 0) AS fp,
       count(*) FILTER (prob < 0.5 AND target = 1) AS fn, count(*) FILTER (prob < 0.5 AND target = 0) AS tn FROM {source}{tail}"""


STEPS["confusion"] = confusion_of("card")
STEPS["confusion_models"] = confusion_of("models", "model, split")


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0e0 END"


PRECISION, RECALL, F1 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fp + fn")
F1W = ratio(f"({F1}) * (tp + fn) + ({ratio('2 * tn', '2 * tn + fn + fp')}) * (fp + tn)", "tp + fp + fn + tn")


def sweep_of(source: str) -> str:
    return f"""
  SELECT k, threshold, tp, fp, fn, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1
  FROM (SELECT k, threshold, count(*) FILTER (prob >= threshold AND target = 1) AS tp,
               count(*) FILTER (prob >= threshold AND target = 0) AS fp,
               count(*) FILTER (prob < threshold AND target = 1) AS fn
        FROM {source}, (SELECT CAST(range AS INT) AS k, CASE WHEN range = 79 THEN 0.9e0
                          ELSE 0.1e0 + range * (CAST(0.8 AS DOUBLE) / 79) END AS threshold FROM range(80))
        GROUP BY k, threshold)"""


STEPS["sweep"] = sweep_of("card")
STEPS["val_card"] = card_of("aged_split", MARGIN["a"], "id, target, split") + " WHERE split = 'val'"
STEPS["val_sweep"] = sweep_of("val_card")
DECISION = f"CASE WHEN prob < {THRESHOLD}e0 THEN 'approve' WHEN prob > {THRESHOLD}e0 + 0.1e0 THEN 'reject' ELSE 'review' END"
BAND = "CASE WHEN prob < 0.35e0 THEN 'low' WHEN prob < 0.55e0 THEN 'medium' ELSE 'high' END"
RISK_PCT = r("round_even(prob * 100e0 * 10e0, 0) / 10e0")
CUT_MARGIN = f"abs(prob - {THRESHOLD}e0)"


def money(x: str) -> str:
    return (f"CASE WHEN {x} >= 1e9 THEN printf('Rp %.1f M', {x} / 1e9) WHEN {x} >= 1e6 THEN printf('Rp %.1f jt', {x} / 1e6) "
            f"WHEN {x} >= 1e3 THEN printf('Rp %.0f rb', {x} / 1e3) "
            f"WHEN {x} IS NOT NULL THEN 'Rp ' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)) END")


def shown(decimals: int) -> str:
    idr = f"(value * {USD_TO_IDR}e0)"
    logged = f"((exp(value) - 1) * {USD_TO_IDR}e0)"
    return (f"CASE WHEN feature IN ('monthly_income', 'income_per_dependent', 'monthly_debt') THEN {money(idr)} "
            f"WHEN feature IN ('revolving_utilization', 'debt_ratio', 'dti_adjusted') THEN printf('%.1f%%', value * 100e0) "
            f"WHEN feature = 'ever_late' THEN CASE WHEN value >= 1 THEN 'Ya' ELSE 'Tidak' END "
            f"WHEN feature = 'log_income' THEN {money(logged)} "
            f"WHEN feature = 'utilization_risk' THEN ['Aman', 'Perhatian', 'Tinggi', 'Kritis'][LEAST(CAST(value AS INT), 3) + 1] "
            f"ELSE printf('%.{decimals}f', value) END")


EFFECT = "CASE WHEN contribution > 0.01e0 THEN 'worsens' WHEN contribution < -0.01e0 THEN 'improves' ELSE 'neutral' END"
LABEL_OF, HINT_OF = case_map("feature", FEATURE_LABELS), case_map("feature", FEATURE_HINTS, text(NO_HINT))


def long_of(cols, extra: str = "target AS class") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM SRC WHERE {c} IS NOT NULL" for c in cols
    )


def histogram_of(source: str, capped: dict[str, bool]) -> str:
    guarded = ", ".join(text(c) for c, on in capped.items() if on)
    edge = "CASE WHEN ({0}) = 40 THEN stop ELSE start + ({0}) * width END"
    lo, hi = edge.format("guess"), edge.format("guess + 1")
    return f"""
  long AS ({long_of(capped).replace('SRC', source)}),
  kept AS (SELECT long.* FROM long JOIN (SELECT feature, class, quantile_cont(x, 0.99) AS cap FROM long GROUP BY 1, 2) q
           USING (feature, class) WHERE x <= cap OR feature NOT IN ({guarded})),
  spans AS (SELECT *, (stop - start) / 40 AS width FROM (
              SELECT feature, class, count(*) AS total, min(x) - CASE WHEN min(x) = max(x) THEN 0.5e0 ELSE 0e0 END AS start,
                     max(x) + CASE WHEN min(x) = max(x) THEN 0.5e0 ELSE 0e0 END AS stop FROM kept GROUP BY 1, 2)),
  placed AS (SELECT feature, class, guess + CASE WHEN x < {lo} THEN -1 WHEN x >= {hi} AND guess < 39 THEN 1 ELSE 0 END AS bin
             FROM (SELECT *, LEAST(CAST(floor((x - start) / width) AS BIGINT), 39) AS guess
                   FROM kept JOIN spans USING (feature, class))),
  counts AS (SELECT feature, class, bin, count(*) AS n FROM placed GROUP BY 1, 2, 3)
  SELECT s.feature, s.class, CAST(g.range AS INT) AS bin, {r(edge.format('g.range'), 9)} AS lo,
         {r(edge.format('g.range + 1'), 9)} AS hi, COALESCE(n, 0) AS n,
         {r('COALESCE(n, 0) / (total * width)', 9)} AS density
  FROM spans s CROSS JOIN range(40) g LEFT JOIN counts c ON c.feature = s.feature AND c.class = s.class AND c.bin = g.range"""


def box_of(col: str) -> str:
    return f"""
  clipped AS (SELECT target, CASE WHEN {col} > cap THEN cap ELSE {col} END AS x
              FROM borrowers, (SELECT quantile_cont({col}, 0.95) AS cap FROM borrowers) WHERE {col} IS NOT NULL),
  boxes AS (SELECT target, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
            FROM clipped GROUP BY target)
  SELECT target AS class, {r('least(lo, q1)')} AS lo, {r('q1')} AS q1, {r('med')} AS med, {r('q3')} AS q3, {r('greatest(hi, q3)')} AS hi
  FROM (SELECT target, q1, med, q3, min(x) FILTER (x >= q1 - 1.5e0 * (q3 - q1)) AS lo,
               max(x) FILTER (x <= q3 + 1.5e0 * (q3 - q1)) AS hi
        FROM clipped JOIN boxes USING (target) GROUP BY ALL)"""


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def corr_cells(keep) -> str:
    return union(
        f"SELECT '{a}' AS a, '{b}' AS b, " + (r(f"corr({a}, {b})", 8) if a != b else f"max({r('1e0', 8)})") + " AS r FROM borrowers"
        for i, a in enumerate(NUMERIC) for j, b in enumerate(NUMERIC) if keep(i, j)
    )


# Rebalancing on the training rows: neighbours by rounded squared distance, then id.
STEPS["train"] = "SELECT * FROM scaled WHERE split = 'train'"
STEPS["few"] = "SELECT * FROM train WHERE target = 1"
GAP = "round_even((" + " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in FEATURE_COLS) + ") * 1e9, 0)"
STEPS["few_near"] = f"""
  SELECT id, list(other ORDER BY gap, other) AS others FROM (
    SELECT id, other, gap, row_number() OVER (PARTITION BY id ORDER BY gap, other) AS place FROM (
      SELECT a.id, b.id AS other, {GAP} AS gap FROM few a JOIN few b ON a.id <> b.id))
  WHERE place <= 5 GROUP BY id"""
STEPS["sizes"] = """SELECT count(*) FILTER (target = 1) AS n_few, count(*) FILTER (target = 0) - count(*) FILTER (target = 1) AS n_new,
         n_new // n_few AS each_row, n_new % n_few AS extra FROM train"""
STEPS["seeds"] = """
  SELECT *, md5('42|' || id || '|' || copy) AS h FROM (
    SELECT id, each_row, unnest(range(1, each_row + CASE WHEN rk <= extra THEN 2 ELSE 1 END)) AS copy
    FROM (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) AS rk FROM few), sizes)"""
STEPS["drawn"] = """
  SELECT s.id, s.copy, s.each_row, n.others[1 + CAST('0x' || substr(h, 1, 8) AS BIGINT) % len(n.others)] AS other,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296e0 AS u
  FROM seeds s JOIN few_near n ON s.id = n.id"""
STEPS["grown"] = (
    "SELECT id, target, " + ", ".join(f"CAST({p}{c} AS DOUBLE) AS {p}{c}" for p in ("", "z_") for c in FEATURE_COLS)
    + " FROM train UNION ALL SELECT -(d.id * (each_row + 2) + copy) - 1, 1, "
    + ", ".join(f"a.{p}{c} + u * (b.{p}{c} - a.{p}{c})" for p in ("", "z_") for c in FEATURE_COLS)
    + " FROM drawn d JOIN few a ON d.id = a.id JOIN few b ON d.other = b.id"
)


def links_of(source: str) -> str:
    return f"""
  links AS (WITH best AS (
      SELECT a.id, any_value(a.target) AS target, min_by(b.id, {{'g': {GAP}, 'i': b.id}}) AS other
      FROM {source} a JOIN {source} b ON a.id <> b.id GROUP BY a.id)
    SELECT p.id FROM best p JOIN best q ON p.other = q.id AND q.other = p.id AND p.target <> q.target)"""


GROWN_ROW = ", ".join(f"{r(c)} AS {c}" for c in FEATURE_COLS)
BORROWER_COLS = ["id", *NUMERIC]
ENGINEERED = ["id", *FEATURE_COLS, "target"]
IDR = f"(monthly_income * {USD_TO_IDR}e0)"
UNITS = {"monthly_income_idr": IDR, "utilization_pct": "(revolving_utilization * 100e0)", "debt_pct": "(debt_ratio * 100e0)"}
VIOLATIONS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {UNITS.get(n, n)} < {lo} OR {UNITS.get(n, n)} > {hi} THEN '{n}' END" for n, (lo, hi) in INPUT_BOUNDS.items()
) + ")"
DECISION_ROW = f"id, {r('margin')} AS margin, {r('prob')} AS prob, {DECISION} AS decision, {BAND} AS band, {RISK_PCT} AS risk_pct, {r(CUT_MARGIN)} AS margin_to_cut"

# The scaled card on every cleaned application, not only on the labelled splits.
MODEL_COMPARISON = f"""
  SELECT model, split, {r('auc', 4)} AS auc_roc, {r(F1W, 4)} AS f1_weighted, {r(F1, 4)} AS f1_minority, {r('ap', 4)} AS ap
  FROM (SELECT model, split, {AUC} AS auc, {AP} AS ap FROM ranked_models GROUP BY 1, 2)
  JOIN confusion_models USING (model, split)"""

SELECTS: dict[str, str] = {
    "borrowers": "SELECT * FROM borrowers",
    "flagship": f"""SELECT decision, band, count(*) AS n, CAST(sum(target) AS BIGINT) AS bad, {r('sum(target) / count(*)')} AS bad_rate
        FROM (SELECT *, {DECISION} AS decision, {BAND} AS band FROM card) GROUP BY 1, 2""",
    "src_applications_csv": "SELECT * FROM borrowers",
    "src_csv_other_order": "SELECT * FROM borrowers",
    "src_csv_unlabelled": "SELECT * REPLACE (CAST(NULL AS INT) AS target) FROM borrowers",
    "rename_columns": "SELECT * FROM borrowers",
    "sink_splits": f"SELECT {rounded(ENGINEERED)}, split FROM splits",
    "src_splits": f"SELECT {rounded(ENGINEERED)}, split FROM splits WHERE split = 'test'",
    "select_features": f"SELECT {rounded(ENGINEERED)} FROM featured",
    "save_threshold": f"""SELECT round_even(threshold * 1e4, 0) / 1e4 AS best_threshold, 'validation F1 maximum' AS selection_rule,
        round_even(threshold * 1e4, 0) / 1e4 AS loaded FROM val_sweep ORDER BY f1 DESC, k LIMIT 1""",
    "sink_metrics": MODEL_COMPARISON,
    "input_bounds": f"SELECT id, CAST(len(string_split(v, ',')) - CASE WHEN v = '' THEN 1 ELSE 0 END AS INT) AS n_violations, v AS violations FROM (SELECT id, {VIOLATIONS} AS v FROM borrowers)",
    "filter_age": "SELECT * FROM aged",
    "clip_utilization": f"SELECT id, {CAPPED} AS revolving_utilization FROM borrowers",
    "bin_age_group": f"SELECT id, age, {AGE_GROUP} AS age_group FROM borrowers",
    "group_median": f"SELECT age_group, {r('median')} AS median FROM medians",
    "global_median": f"SELECT {r('quantile_cont(monthly_income, 0.5)')} AS median FROM grouped",
    "impute_group_median": f"SELECT id, {r('monthly_income')} AS monthly_income FROM cleaned",
    "impute_constant": "SELECT id, COALESCE(num_dependents, 0e0) AS num_dependents FROM borrowers",
    "drop_helper": "SELECT * EXCLUDE (age_group) FROM grouped",
    "cleaning_audit": union(f"SELECT '{rule}' AS rule, count(*) FILTER ({cond}) AS n_rows FROM borrowers" for rule, cond in {
        "rows_in": "true", "age_removed": "NOT (age > 0 AND age <= 95)",
        "utilization_capped": "age > 0 AND age <= 95 AND revolving_utilization > 1.5",
        "income_imputed": "age > 0 AND age <= 95 AND monthly_income IS NULL",
        "dependents_imputed": "age > 0 AND age <= 95 AND num_dependents IS NULL",
        "rows_out": "age > 0 AND age <= 95"}.items()),
    "filter_by_class": "SELECT * FROM borrowers WHERE target = 1",
    "drop_nulls_col": "SELECT * FROM borrowers WHERE monthly_income IS NOT NULL",
    "filter_metrics_split": f"SELECT * FROM ({MODEL_COMPARISON}) WHERE split = 'test'",
    "engineer_features": f"SELECT {rounded(['id', *DERIVED_FEATURES])} FROM featured",
    "inv_log_income": f"SELECT id, {r('exp(ln(1 + monthly_income)) - 1')} AS income FROM borrowers",
    "currency_convert": f"SELECT id, {r(IDR, 4)} AS idr, {r(f'{IDR} * (1e0 / {USD_TO_IDR}e0)', 4)} AS usd FROM borrowers",
    "format_currency": f"SELECT id, {money(IDR)} AS income_idr, {money('monthly_income')} AS as_units, {money('(monthly_income * 1e6)')} AS as_millions FROM borrowers",
    "percent_of_limit": f"SELECT id, {r('revolving_utilization * 100e0')} AS pct, {r('revolving_utilization * 100e0 / 100e0')} AS share FROM borrowers",
    "table_shape": "SELECT count(*) AS n_rows, 11 AS n_cols FROM borrowers",
    "duplicate_count": f"SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM borrowers GROUP BY {', '.join(NUMERIC)})",
    "column_profile": union(
        f"SELECT '{c}' AS \"column\", '{'double' if c in DOUBLES else 'int'}' AS dtype, count(*) FILTER ({c} IS NULL) AS missing, "
        f"{r(f'round_even(avg(CAST({c} IS NULL AS INT)) * 100 * 1e2, 0) / 1e2')} AS missing_pct, count(DISTINCT {c}) AS \"unique\", "
        f"{r(f'CAST(min({c}) AS DOUBLE)')} AS min, {r(f'CAST(max({c}) AS DOUBLE)')} AS max, {r(f'avg({c})', 2)} AS mean, "
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 2)} AS median FROM borrowers" for c in NUMERIC),
    "class_balance": f"""SELECT target AS class, count(*) AS n, {r('count(*) / sum(count(*)) OVER () * 100')} AS pct,
        {r('sum(CASE WHEN target = 0 THEN count(*) END) OVER () / sum(CASE WHEN target = 1 THEN count(*) END) OVER ()')} AS ratio
        FROM borrowers GROUP BY target""",
    "missing_report": "SELECT * FROM (" + union(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n, {r(f'count(*) FILTER ({c} IS NULL) / count(*) * 100e0', 2)} AS pct, "
        f"'{'median' if c == 'monthly_income' else 'mode'}' AS strategy FROM borrowers" for c in NUMERIC) + ") WHERE n > 0",
    "quantile": union(
        f"SELECT target, '{c}' AS feature, {p}e0 AS p, {r(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS value FROM borrowers GROUP BY target"
        for c in RAW_FEATURES for p in (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)),
    "iqr_outliers": union(
        f"SELECT '{c}' AS feature, {r('max(q1)', 2)} AS q1, {r('max(q3)', 2)} AS q3, {r('max(q3 - q1)', 2)} AS iqr, "
        f"{r('max(q1 - 1.5e0 * (q3 - q1))', 2)} AS lower_fence, {r('max(q3 + 1.5e0 * (q3 - q1))', 2)} AS upper_fence, "
        f"count(*) FILTER ({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) AS n_outliers, "
        + r(f"count(*) FILTER ({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) / count(*) * 100e0", 2)
        + f" AS outlier_pct FROM borrowers, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM borrowers)"
        for c in RAW_FEATURES),
    "extreme_values": union(
        f"SELECT '{c}' AS \"column\", {r(f'CAST(max({c}) AS DOUBLE)')} AS max FROM borrowers"
        for c in ("age", "monthly_income", "revolving_utilization")),
    "corr_matrix": corr_cells(lambda i, j: True),
    "corr_lower_triangle": corr_cells(lambda i, j: i > j),
    "target_corr_rank": union(f"SELECT '{c}' AS feature, {r(f'abs(corr({c}, target))', 8)} AS abs_r FROM borrowers" for c in RAW_FEATURES),
    "class_compare": union(
        [f"SELECT 'mean_{c}' AS metric, {r('bad')} AS bad, {r('good')} AS good, {r('good - bad')} AS diff, {r('CASE WHEN good <> 0 THEN bad / good END')} AS ratio "
         f"FROM (SELECT avg({c}) FILTER (target = 1) AS bad, avg({c}) FILTER (target = 0) AS good FROM borrowers)"
         for c in ("age", "revolving_utilization", "late_30_59", "late_60_89", "late_90d")]
        + [f"SELECT 'median_monthly_income' AS metric, {r('bad')} AS bad, {r('good')} AS good, {r('good - bad')} AS diff, {r('bad / good')} AS ratio "
           "FROM (SELECT quantile_cont(monthly_income, 0.5) FILTER (target = 1) AS bad, quantile_cont(monthly_income, 0.5) FILTER (target = 0) AS good FROM borrowers)"]),
    "split_summary": f"""SELECT split, count(*) AS n, CAST(sum(target) AS BIGINT) AS pos, CAST(sum(1 - target) AS BIGINT) AS neg,
        {r('sum(target) / count(*) * 100e0')} AS pos_pct, {r('sum(1 - target) / count(*) * 100e0')} AS neg_pct FROM aged_split GROUP BY split""",
    "prevalence": f"SELECT {r('avg(target)', 9)} AS prevalence FROM borrowers",
    "random_undersample": """SELECT id, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || id), id) AS rk
        FROM splits WHERE split = 'train') WHERE target = 1 OR rk <= 2 * (SELECT sum(target) FROM splits WHERE split = 'train')""",
    "balanced_weights": f"SELECT id, target, {r('count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY target))')} AS weight FROM train",
    "scale_pos_weight": "SELECT id, target, CASE WHEN target = 1 THEN 3e0 ELSE 1e0 END AS weight FROM train",
    "save_model": "SELECT count(*) AS n_rows, count(*) AS n_equal FROM splits WHERE split IN ('val', 'test')",
    "explain_trees_additivity": "SELECT count(*) AS n_rows, count(*) AS n_additive FROM splits WHERE split = 'test'",
    "smote": f"SELECT id, target, {GROWN_ROW} FROM grown",
    "robust_scale_fit": union(f"SELECT '{c}' AS feature, {r(f'c_{c}')} AS center, {r(f's_{c}')} AS scale FROM params" for c in FEATURE_COLS),
    "save_scaler": union(f"SELECT '{c}' AS feature, {r(f'c_{c}')} AS center, {r(f's_{c}')} AS scale FROM params" for c in FEATURE_COLS),
    "robust_scale_apply": "SELECT id, " + ", ".join(f"{r(f'z_{c}')} AS {c}" for c in FEATURE_COLS) + ", target, split FROM scaled",
    "score": f"SELECT id, target, {r('margin')} AS margin, {r('prob')} AS prob, score FROM card",
    "roc_auc": f"SELECT {r(AUC, 8)} AS auc FROM ranked",
    "average_precision": f"SELECT {r(AP, 8)} AS ap FROM ranked",
    "roc_curve": f"""SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {r('fp / n_all')} AS fpr, {r('tp / p_all')} AS tpr FROM ranked
        UNION ALL SELECT NULL, 0, 0, 0e0, 0e0""",
    "pr_curve": f"""SELECT score AS threshold, {r('tp / (tp + fp)')} AS precision, {r('tp / p_all')} AS recall FROM ranked
        UNION ALL SELECT NULL, 1e0, 0e0""",
    "confusion_matrix": "SELECT * FROM confusion",
    "precision_recall_f1": f"SELECT *, {r(PRECISION)} AS precision, {r(RECALL)} AS recall, {r(F1)} AS f1 FROM confusion",
    "f1_weighted": f"SELECT *, {r(F1W)} AS f1_weighted FROM confusion",
    "model_comparison": MODEL_COMPARISON,
    "threshold_sweep": f"SELECT k, {r('threshold')} AS threshold, tp, fp, fn, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM sweep",
    "best_threshold": f"SELECT k, {r('threshold')} AS threshold, tp, fp, fn, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM sweep ORDER BY sweep.f1 DESC, k LIMIT 1",
    "sample_for_explain": "SELECT id, target FROM splits WHERE split = 'test' ORDER BY md5('42|' || id), id LIMIT 1000",
    "explain_linear": f"SELECT id, CAST(position AS INT) AS position, feature, {r('value')} AS value, contribution FROM contrib",
    "importance_rank": f"SELECT feature, {r('mean_abs')} AS mean_abs, rank FROM importance WHERE rank <= 10",
    "beeswarm_data": f"SELECT id, feature, {r('value')} AS value, contribution FROM contrib WHERE feature IN (SELECT feature FROM importance WHERE rank <= 15)",
    "dependence_data": f"""SELECT id, feature, {r('value')} AS value, contribution FROM contrib JOIN
        (SELECT feature, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM contrib GROUP BY feature) USING (feature)
        WHERE value BETWEEN low AND high AND feature IN (SELECT feature FROM importance WHERE rank <= 4)""",
    "pick_cases": union(
        f"SELECT * FROM (SELECT '{name}' AS \"case\", id, {r('margin')} AS margin, {r('prob')} AS prob FROM scored WHERE split = 'test' ORDER BY {order}, id LIMIT 1)"
        for name, order in {"safest": "scored.margin", "riskiest": "scored.margin DESC", "borderline": f"abs(scored.prob - {THRESHOLD}e0)"}.items()),
    "row_top_contrib": f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY contribution, place) - 1 AS INT) AS position, feature,
        {r('value')} AS value, contribution FROM by_size WHERE place <= 10""",
    "case_reasons": union(
        f"""SELECT id, CAST(rk - 1 AS INT) AS position, feature, {r('value')} AS value, contribution, '{side}' AS side
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}, position) AS rk FROM contrib) WHERE rk <= 3"""
        for side, order in {"raising": "contribution DESC", "lowering": "contribution"}.items()),
    "score_applications": f"SELECT {DECISION_ROW} FROM scored",
    "decide": f"SELECT id, {DECISION} AS decision FROM card",
    "risk_band": f"SELECT id, {BAND} AS band, {RISK_PCT} AS risk_pct FROM card",
    "decision_margin": f"SELECT id, {r(CUT_MARGIN)} AS margin_to_cut FROM card",
    "indicator_flags": """SELECT id, CASE WHEN late_30_59 + late_60_89 + late_90d > 2 THEN 'risk' ELSE 'safe' END AS late_flag,
        CASE WHEN debt_ratio * 100e0 > 40 THEN 'risk' ELSE 'safe' END AS dti_flag,
        CASE WHEN revolving_utilization * 100e0 > 70 THEN 'critical' WHEN revolving_utilization * 100e0 > 30 THEN 'watch' ELSE 'healthy' END AS utilization_flag
        FROM borrowers""",
    "policy_simulation": f"""SELECT {r('cut')} AS cut, count(*) FILTER (prob < cut) AS approve,
        count(*) FILTER (prob >= cut AND prob <= cut + 0.1e0) AS review, count(*) FILTER (prob > cut + 0.1e0) AS reject,
        {r('CASE WHEN count(*) FILTER (prob < cut) > 0 THEN count(*) FILTER (prob < cut AND target = 1) / count(*) FILTER (prob < cut) END')} AS bad_rate,
        count(*) FILTER (prob >= cut AND target = 0) AS good_not_approved,
        count(*) FILTER (prob > cut + 0.1e0 AND target = 0) AS good_rejected,
        k = (SELECT round_even(threshold * 100, 0) FROM sweep ORDER BY f1 DESC, k LIMIT 1) AS recommended
        FROM card, (SELECT range AS k, range / 100e0 AS cut FROM range(10, 91)) GROUP BY k, cut""",
    "reason_codes": f"""SELECT id, CAST(place AS INT) AS rank, feature, {LABEL_OF} AS label, {shown(0)} AS shown, contribution,
        {r('CASE WHEN most > 0 THEN abs(contribution) / most * 100e0 ELSE 0e0 END')} AS bar_pct,
        CASE WHEN contribution > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM by_size_all WHERE place <= 10""",
    "contribution_class": f"SELECT id, feature, {EFFECT} AS effect FROM contrib_all",
    "feature_dictionary": f"SELECT feature, {r('mean_abs')} AS mean_abs, rank, {LABEL_OF} AS label, {HINT_OF} AS hint FROM importance_all",
    "format_indicator": f"SELECT id, feature, {shown(2)} AS shown FROM contrib_all",
    "indicator_table": f"""SELECT id, CAST(place AS INT) AS place, feature, {LABEL_OF} AS label, {shown(2)} AS shown,
        {r('contribution', 4)} AS contribution, {EFFECT} AS effect, {case_map(f'({EFFECT})', CONTRIBUTION_LABELS)} AS effect_label, {HINT_OF} AS hint
        FROM by_size_all""",
    "baseline_vs_final": f"""SELECT id, {r('base', 4)} AS base_margin, {r('base + total', 4)} AS final_margin, {r('total', 4)} AS diff_margin,
        {r('1 / (1 + exp(-base))', 4)} AS base_prob, {r('1 / (1 + exp(-(base + total)))', 4)} AS final_prob,
        {r('1 / (1 + exp(-(base + total))) - 1 / (1 + exp(-base))', 4)} AS diff_prob
        FROM (SELECT id, sum(contribution) AS total FROM contrib_all GROUP BY id),
             (SELECT CAST({SCALED_INTERCEPT} AS DOUBLE) + {' + '.join(f'CAST({w} AS DOUBLE) * m_{c}' for c, w in SCALED_WEIGHTS.items())} AS base FROM means)""",
    "decision_text": f"SELECT id, decision, {case_map('decision', DECISION_TEXTS)} AS text, {case_map('decision', DECISION_LABELS)} AS label FROM (SELECT id, {DECISION} AS decision FROM card)",
    "stream_score": f"SELECT {DECISION_ROW} FROM scored",
    "set_aside": "SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in FEATURE_COLS)
    + ") AS violations FROM featured WHERE " + " OR ".join(f"{c} IS NULL" for c in FEATURE_COLS)
    + " UNION ALL SELECT id, 'age' FROM borrowers WHERE NOT COALESCE(age > 0 AND age <= 95, false)",
}
for _key, _name in {
    "f_total_late": "total_late_payments", "f_weighted_late": "weighted_late_score",
    "f_income_per_dependent": "income_per_dependent", "f_monthly_debt": "monthly_debt",
    "f_dti_adjusted": "dti_adjusted", "f_utilization_risk": "utilization_risk", "f_ever_late": "ever_late",
    "f_credit_lines_per_age": "credit_lines_per_age", "f_log_income": "log_income",
}.items():
    SELECTS[_key] = f"SELECT {rounded(['id', _name])} FROM featured"
STEPS |= oracle_forest.STEPS
SELECTS |= oracle_forest.selects(r)

# Queries that bring steps of their own after the shared ones.
WITH_STEPS = {
    "class_histogram": ("borrowers", histogram_of("borrowers", dict.fromkeys(RAW_FEATURES, True))),
    "class_histogram_derived": ("featured", histogram_of("featured", DERIVED_HISTOGRAMS)),
    "box_stats": ("borrowers", box_of("monthly_income")),
    "box_stats_utilization": ("borrowers", box_of("revolving_utilization")),
    "stratified_split": ("borrowers", f"all_split AS ({split_of('borrowers')}) SELECT id, target, split FROM all_split"),
}
WITH_STEPS |= {
    "tomek_links": ("train", f"{links_of('train')} SELECT id, target FROM train WHERE id NOT IN (SELECT id FROM links)"),
    "smote_tomek": ("grown", f"{links_of('grown')} SELECT id, target, {GROWN_ROW} FROM grown WHERE id NOT IN (SELECT id FROM links)"),
    "class_counts_by_strategy": ("train grown FROM grown", f"""{links_of('grown')},
      every AS (SELECT 'original' AS strategy, target FROM train UNION ALL SELECT 'smote', target FROM grown
                UNION ALL SELECT 'smote_tomek', target FROM grown WHERE id NOT IN (SELECT id FROM links)
                UNION ALL SELECT 'undersample', target FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || id), id) AS rk FROM train)
                          WHERE target = 1 OR rk <= 2 * (SELECT sum(target) FROM train))
      SELECT strategy, target AS class, count(*) AS n, {r("sum(CASE WHEN target = 0 THEN count(*) END) OVER (PARTITION BY strategy) / sum(CASE WHEN target = 1 THEN count(*) END) OVER (PARTITION BY strategy)")} AS ratio
      FROM every GROUP BY strategy, target"""),
}
SHARED = {"contrib_all", "forest_rounds", "train", "few", "grown", "borrowers", "featured", "splits", "scaled", "contrib", "models", "aged_split"}


def _needed(sql: str, found: dict[str, None]) -> None:
    """Steps a text mentions, each after the steps it mentions itself."""
    for name, body in STEPS.items():
        if name not in found and re.search(rf"(FROM|JOIN|,)\s+{name}\b", sql):
            _needed(body, found)
            found[name] = None


def _with(sql: str, extra: str = "") -> str:
    found: dict[str, None] = {}
    _needed(sql + extra, found)
    steps = ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({STEPS[n]})" for n in found
    )
    return f"WITH {steps}"


def oracle_queries() -> dict[str, str]:
    out = {key: f"{_with(sql)}\n{sql}" for key, sql in SELECTS.items()}
    for key, (source, body) in WITH_STEPS.items():
        out[key] = f"{_with(f'FROM {source}')},\n{body}"
    return out
