"""A frozen forest: a boosted model given by a rule, so that tree scoring, curves and attribution are exactly checkable.

It stands beside the frozen scorecards: what a fitted forest's operators compute doesn't depend on where its
trees come from, and these trees can be written down in another engine's language.
"""

from __future__ import annotations

import numpy as np

from riskspark.operators.trees import Tree
from riskspark.schema import FEATURE_COLS

TREES, DEPTH = 6, 3


def node(tree: int, i: int) -> tuple[int, float, float, float]:
    """(feature, threshold, leaf value, leaf cover) of node i of a tree; children of i are 2 i + 1 and 2 i + 2."""
    feature = (5 * tree + 3 * i + 1) % len(FEATURE_COLS)
    return feature, ((7 * tree + 11 * i) % 9 - 4) * 0.21 + 0.013, ((13 * tree + 17 * i) % 15 - 7) / 20, float((tree + 3 * i) % 7 + 1)


def frozen_forest(trees: int = TREES, depth: int = DEPTH) -> list[Tree]:
    """Complete trees over the scaled features, in the order of FEATURE_COLS."""
    inner, n = 2**depth - 1, 2 ** (depth + 1) - 1
    out = []
    for t in range(trees):
        rows = [node(t, i) for i in range(n)]
        cover = np.array([r[3] for r in rows])
        for i in range(inner - 1, -1, -1):
            cover[i] = cover[2 * i + 1] + cover[2 * i + 2]
        leaf = np.arange(n) >= inner
        out.append(Tree(
            feature=np.where(leaf, -1, [r[0] for r in rows]), threshold=np.where(leaf, 0.0, [r[1] for r in rows]),
            left=np.where(leaf, -1, 2 * np.arange(n) + 1), right=np.where(leaf, -1, 2 * np.arange(n) + 2),
            value=np.array([r[2] for r in rows]), cover=cover,
        ))
    return out
