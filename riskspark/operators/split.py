"""Stratified split and random undersampling, both decided by exact hash ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators.ordered import at_or_before, class_sizes, hash_cuts, hash_key
from riskspark.schema import ID, LABEL

# The seed, and test and validation shares of the whole.
SEED = 42
TEST_SHARE, VAL_SHARE = 0.2, 0.2


def stratified_split(
    df: DataFrame,
    label: str = LABEL,
    test: float = TEST_SHARE,
    val: float = VAL_SHARE,
    seed: int = SEED,
    id_col: str = ID,
) -> DataFrame:
    """Add `split`: the first `test` share of every class by hash rank, then `val`, then train. Rows without a label
    are a class of their own.

    Once the cut hashes are known the assignment is a projection: no row moves.
    """
    sizes = class_sizes(df, label)
    ranks = {c: (int(test * n), int((test + val) * n)) for c, n in sizes.items()}
    cuts = hash_cuts(df, label, ranks, id_col, seed, sizes)

    def within(which: int):
        hit = F.lit(False)
        for c, wanted in ranks.items():
            hit = hit | (F.col(label).eqNullSafe(F.lit(c)) & at_or_before(cuts.get((c, wanted[which])), id_col, seed, F.col("_hash")))
        return hit

    # A column of its own: the hash is computed once a row, not once for each comparison.
    hashed = df.withColumn("_hash", hash_key(id_col, seed))
    return hashed.withColumn("split", F.when(within(0), "test").when(within(1), "val").otherwise("train")).drop("_hash")


def random_undersample(
    df: DataFrame, label: str = LABEL, ratio: float = 0.5, seed: int = SEED, id_col: str = ID
) -> DataFrame:
    """All minority rows, and majority rows by hash rank until minority / majority = `ratio`. Rows without a label go."""
    df = df.where(F.col(label).isNotNull())
    sizes = class_sizes(df, label)
    if not sizes:
        return df
    minority = min(sizes, key=lambda c: (sizes[c], -c))
    wanted = {c: (min(n, int(sizes[minority] / ratio)),) for c, n in sizes.items() if c != minority}
    cuts = hash_cuts(df, label, wanted, id_col, seed, sizes)
    keep = F.col(label) == minority
    for c, (rank,) in wanted.items():
        keep = keep | ((F.col(label) == c) & at_or_before(cuts.get((c, rank)), id_col, seed))
    return df.where(keep)


def split_summary(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum(label).alias("pos"),
        F.sum(1 - F.col(label)).alias("neg"),
    ).select(
        "split", "n", "pos", "neg",
        (F.col("pos") / F.col("n") * 100).alias("pos_pct"),
        (F.col("neg") / F.col("n") * 100).alias("neg_pct"),
    )
