"""Running sums and exact ranks in a global order, without a global window.

`ordered_prefix` groups equal keys first, so a hot key becomes one row, then cuts the key range
into buckets of similar weight. A row's bucket depends on its key alone, never on where the row
happens to be, so a recomputed partition gives the same answer. Windows run inside a bucket;
the bucket totals, a table of at most `groups x buckets` rows, supply the offsets.

`hash_cuts` finds the hash value at a given rank of every class from prefix histograms and
ranks only the rows sharing the last prefix, so a split never moves or sorts the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CLASSES = 1_000
HASH_DIGITS, PREFIX_STEP = 32, 3
ORDER_ROWS = 200_000


def _bucket_splits(df: DataFrame, key: str, buckets: int | None) -> list[float]:
    if buckets is None:
        buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2, buckets)
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), probs, 20 * buckets)).first()[0]
    return [float("-inf"), *(sorted(c for c in set(cuts or ()) if math.isfinite(c)) or [0.0]), float("inf")]


def ordered_prefix(
    df: DataFrame, key: str, sums: Sequence[str], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """One row per `(by, key)` with, for every summed column `s`: `s`, `s_before`, `s_total`.

    `s_before` is the sum over strictly smaller keys of the same group. Null and NaN keys are left out. The number
    of ranges follows the session's shuffle partitions, as the number of tasks does.
    """
    df = df.where(F.col(key).isNotNull() & ~F.isnan(F.col(key).cast("double")))
    bucketizer = Bucketizer(
        splits=_bucket_splits(df, key, buckets), inputCol="_key", outputCol="_bucket"
    )
    grouped = df.groupBy(*by, key).agg(*[F.sum(s).alias(s) for s in sums])
    grouped = bucketizer.transform(grouped.withColumn("_key", F.col(key).cast("double"))).drop("_key")
    grouped = grouped.withColumn("_bucket", F.col("_bucket").cast("int"))

    before = Window.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = grouped.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_{s}") for s in sums]).select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_offset") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    local = grouped.withColumns({f"_{s}_local": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums})
    return local.join(offsets, [*by, "_bucket"]).select(
        *by, key, *sums,
        *[(F.col(f"_{s}_local") + F.col(f"_{s}_offset")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def hash_key(id_col: str, seed: int) -> Column:
    """Order-defining hash of an id, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def class_sizes(df: DataFrame, label: str) -> dict[int, int]:
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return {r[label]: r["count"] for r in rows}


def hash_cuts(
    df: DataFrame, label: str, ranks: Mapping[int, Sequence[int]], id_col: str, seed: int,
    sizes: Mapping[int, int] | None = None, order_rows: int = ORDER_ROWS,
) -> dict[tuple[int, int], tuple[str, int]]:
    """`(class, rank) -> (hash, id)` of the row at that 1-based rank by (hash, id) in its class.

    While more than `order_rows` rows share a wanted rank's hash prefix, a histogram over three
    more digits (4,096 groups per rank) finds the longer prefix; only the remaining rows are
    ordered. Ranks below 1 have no row and are left out.
    """
    sizes = class_sizes(df, label) if sizes is None else sizes
    keyed = df.select(F.col(label).alias("c"), F.col(id_col).alias("i"), hash_key(id_col, seed).alias("h"))
    # (class, rank) -> prefix, rank within the prefix, rows with the prefix
    state = {(c, r): ("", r, sizes[c]) for c, rs in ranks.items() for r in set(rs) if r >= 1}
    if not state:
        return {}

    def in_reach() -> DataFrame:
        hits = F.array(*[
            F.when(F.col("c").eqNullSafe(F.lit(c)) & F.startswith("h", F.lit(p)),
                   F.struct(F.lit(r).cast("bigint").alias("r"), F.lit(skip).cast("bigint").alias("skip")))
            for (c, r), (p, skip, _) in state.items()
        ])
        return keyed.select("c", "h", "i", F.explode(hits).alias("w")).where("w is not null").select(
            "c", "h", "i", "w.r", "w.skip"
        )

    def first_reaching(order: Sequence[str], counted: DataFrame) -> list:
        upto = F.sum("n").over(Window.partitionBy("c", "r").orderBy(*order))
        left = F.col("skip") - F.col("upto") + F.col("n")
        return (
            counted.withColumn("upto", upto).where("upto >= skip").groupBy("c", "r")
            .agg(F.min_by(F.struct(*order, left.alias("left"), "n"), F.struct(*order)).alias("hit"))
            .select("c", "r", "hit.*").collect()
        )

    digits = 0
    while digits < HASH_DIGITS and max(n for _, _, n in state.values()) > order_rows:
        digits = min(digits + PREFIX_STEP, HASH_DIGITS)
        counted = in_reach().groupBy("c", "r", "skip", F.substring("h", 1, digits).alias("p")).agg(
            F.count("*").alias("n")
        )
        state = {(x["c"], x["r"]): (x["p"], x["left"], x["n"]) for x in first_reaching(["p"], counted)}
    counted = in_reach().groupBy("c", "r", "skip", "h", "i").agg(F.count("*").alias("n"))
    return {(x["c"], x["r"]): (x["h"], x["i"]) for x in first_reaching(["h", "i"], counted)}


def at_or_before(cut: tuple[str, int] | None, id_col: str, seed: int, hashed: Column | None = None) -> Column:
    """Whether a row's (hash, id) is at most the cut; no cut means no row. `hashed` is the row's hash, if it has one."""
    if cut is None:
        return F.lit(False)
    h = hash_key(id_col, seed) if hashed is None else hashed
    return (h < cut[0]) | ((h == cut[0]) & (F.col(id_col) <= cut[1]))
