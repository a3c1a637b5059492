"""The frozen forest's operators as SQL: trees as nested cases, attribution by its definition over all subsets."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import factorial

from riskspark.plans.forest import DEPTH, TREES, node
from riskspark.plans.scorecard import SCALED_INTERCEPT, SCALED_WEIGHTS
from riskspark.schema import FEATURE_COLS

INNER = 2**DEPTH - 1


def number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def cover(tree: int, i: int) -> float:
    return node(tree, i)[3] if i >= INNER else cover(tree, 2 * i + 1) + cover(tree, 2 * i + 2)


def case(tree: int, i: int = 0) -> str:
    feature, cut, value, _ = node(tree, i)
    if i >= INNER:
        return number(value)
    return f"CASE WHEN z_{FEATURE_COLS[feature]} <= {number(cut)} THEN {case(tree, 2 * i + 1)} ELSE {case(tree, 2 * i + 2)} END"


def leaves(tree: int, i: int = 0, conditions: tuple = ()) -> Iterator[tuple[float, tuple]]:
    """(value, ((feature, condition, share), ...)) of every leaf."""
    feature, cut, value, _ = node(tree, i)
    if i >= INNER:
        yield value, conditions
        return
    name = FEATURE_COLS[feature]
    for child, sign in ((2 * i + 1, "<="), (2 * i + 2, ">")):
        step = (name, f"z_{name} {sign} {number(cut)}", cover(tree, child) / cover(tree, i))
        yield from leaves(tree, child, (*conditions, step))


def by_feature(conditions: tuple) -> dict[str, tuple[str, float]]:
    found: dict[str, list] = defaultdict(list)
    for name, condition, share in conditions:
        found[name].append((condition, share))
    out = {}
    for name, steps in found.items():
        share = 1.0
        for _, s in steps:
            share *= s
        met = " AND ".join(c for c, _ in steps)
        out[name] = (f"(CASE WHEN {met} THEN 1e0 ELSE 0e0 END)", share)
    return out


def contributions() -> dict[str, list[str]]:
    """The terms of every feature's contribution: one for each leaf with the feature and subset of its other features."""
    terms: dict[str, list[str]] = defaultdict(list)
    for tree in range(TREES):
        for value, conditions in leaves(tree):
            own = by_feature(conditions)
            d = len(own)
            for name, (met, share) in own.items():
                others = [x for x in own if x != name]
                for size in range(d):
                    weight = factorial(size) * factorial(d - size - 1) / factorial(d)
                    for known in combinations(others, size):
                        rest = "".join(f" * {own[o][0] if o in known else number(own[o][1])}" for o in others)
                        terms[name].append(f"{number(value * weight)} * ({met} - {number(share)}){rest}")
    return terms


def expected() -> float:
    total = 0.0
    for tree in range(TREES):
        for value, conditions in leaves(tree):
            for _, _, share in conditions:
                value *= share
            total += value
    return total


STEPS = {
    "forest_rounds": "SELECT id, target, split, " + ", ".join(f"{case(t)} AS v{t + 1}" for t in range(TREES)) + " FROM scaled",
    "forest_margins": "SELECT id, target, split, unnest([" + ", ".join(
        f"{{'round': {k}, 'margin': {' + '.join(f'v{i}' for i in range(1, k + 1))}}}" for k in range(1, TREES + 1)
    ) + "], recursive := true) FROM forest_rounds",
    "forest_curve": """
      SELECT split, round, (sum(CASE WHEN target = 1 THEN low + (same - 1) / 2e0 END) - pos * (pos + 1) / 2e0) / (pos * neg) AS auc, avg(loss) AS loss
      FROM (SELECT split, round, target,
                   rank() OVER (PARTITION BY split, round ORDER BY margin) AS low, count(*) OVER (PARTITION BY split, round, margin) AS same,
                   CAST(sum(target) OVER (PARTITION BY split, round) AS DOUBLE) AS pos, CAST(sum(1 - target) OVER (PARTITION BY split, round) AS DOUBLE) AS neg,
                   greatest(CASE WHEN target = 1 THEN -margin ELSE margin END, 0e0) + ln(1 + exp(-abs(margin))) AS loss
            FROM forest_margins WHERE split IN ('train', 'val'))
      GROUP BY split, round, pos, neg""",
}


def selects(r) -> dict[str, str]:
    """One select per query; `r` rounds an expression."""
    terms = contributions()
    parts = ", ".join(
        f"{{'position': {i}, 'feature': '{c}', 'value': CAST({c} AS DOUBLE), 'contribution': {' + '.join(terms.get(c) or ['0e0'])}}}"
        for i, c in enumerate(FEATURE_COLS)
    )
    p = f"(1e0 / (1e0 + exp(-(CAST({SCALED_INTERCEPT} AS DOUBLE) + " + " + ".join(f"CAST({w} AS DOUBLE) * z_{c}" for c, w in SCALED_WEIGHTS.items()) + "))))"
    columns = {"(intercept)": ("1e0", float(SCALED_INTERCEPT), 0.0), **{c: (f"z_{c}", float(w), 1.0) for c, w in SCALED_WEIGHTS.items()}}
    certificate = " UNION ALL ".join(
        f"SELECT '{term}' AS term, {number(b)} AS coefficient, {r(f'0.1e0 * sum(w * (p - target) * {x}) + {number(b * ridge)}')} AS gradient, "
        f"{r(f'0.1e0 * sum(w * p * (1 - p) * {x} * {x}) + {number(ridge)}')} AS curvature FROM weighed"
        for term, (x, b, ridge) in columns.items()
    )
    return {
        "forest_score": f"SELECT id, {r('margin')} AS margin, {r('1e0 / (1e0 + exp(-margin))')} AS prob FROM forest_margins WHERE round = {TREES} AND split IN ('val', 'test')",
        "forest_learning_curve": f"SELECT split, CAST(round AS INT) AS round, {r('auc')} AS auc, {r('loss')} AS loss, row_number() OVER (PARTITION BY split ORDER BY forest_curve.auc DESC, forest_curve.round) = 1 AS best FROM forest_curve",
        "forest_explain": f"SELECT id, CAST(position AS INT) AS position, feature, {r('value')} AS value, {r('contribution')} AS contribution FROM (SELECT id, unnest([{parts}], recursive := true) FROM scaled WHERE split = 'test')",
        "forest_expected_value": f"SELECT {r(number(expected()))} AS expected_margin, {r(f'1e0 / (1e0 + exp(-{number(expected())}))')} AS expected_prob, count(*) AS n_rows FROM splits WHERE split = 'test'",
        "logreg_certificate": f"SELECT * FROM (WITH weighed AS (SELECT *, {p} AS p, count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY target)) AS w FROM scaled WHERE split = 'train') {certificate})",
    }
