"""Decisions, risk bands and the effect of moving the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.display import convert_percent
from riskspark.functions.features import round_half_even
from riskspark.operators.metrics import index_frame
from riskspark.schema import LABEL

# Review band above the threshold, risk band cuts, and the display names.
REVIEW_BAND = 0.1
RISK_CUTS = (0.35, 0.55)
DECISION_LABELS = {"approve": "LAYAK", "review": "PERLU KAJIAN", "reject": "TIDAK LAYAK"}
RISK_LABELS = {"low": "RISIKO RENDAH", "medium": "RISIKO SEDANG", "high": "RISIKO TINGGI"}
DECISION_TEXTS = {
    "approve": "Profil menunjukkan kapasitas bayar yang baik dan riwayat kredit yang terjaga. "
               "Direkomendasikan untuk diproses lebih lanjut.",
    "reject": "Risiko gagal bayar tinggi. Periksa faktor merah di grafik sebelah kanan "
              "sebagai dasar pertimbangan penolakan.",
    "review": "Skor di zona abu-abu. Disarankan kajian manual oleh analis kredit "
              "sebelum keputusan akhir diberikan.",
}
# Limits of the indicator cards (late payments, debt %, utilisation %).
LATE_LIMIT, DTI_LIMIT, WATCH_LIMIT, CRITICAL_LIMIT = 2, 40, 30, 70
# The slider's range and step, in hundredths.
SLIDER_LOW, SLIDER_HIGH = 10, 90


def decide(prob: Column, t: float, band: float = REVIEW_BAND) -> Column:
    return F.when(prob < t, "approve").when(prob > t + band, "reject").when(prob.isNotNull(), "review")


def risk_band(prob: Column, cuts=RISK_CUTS) -> Column:
    return F.when(prob < cuts[0], "low").when(prob < cuts[1], "medium").when(prob.isNotNull(), "high")


def risk_percent(prob: Column) -> Column:
    return round_half_even(convert_percent(prob), 1)


def decision_margin(prob: Column, t: float) -> Column:
    return F.abs(prob - F.lit(t))


def _names(values: dict[str, str], key: str, value: str) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in values.items()]))


def decision_text(df: DataFrame, texts: dict[str, str] = DECISION_TEXTS) -> DataFrame:
    """Add the guidance text and display label of each decision, from a three-row table."""
    one = df.sparkSession.range(1)
    lookup = one.select(_names(texts, "decision", "text")).join(
        one.select(_names(DECISION_LABELS, "decision", "label")), "decision"
    )
    return df.join(F.broadcast(lookup), "decision", "left")


def indicator_flags(df: DataFrame) -> DataFrame:
    late = F.col("late_30_59") + F.col("late_60_89") + F.col("late_90d")
    dti, used = convert_percent(F.col("debt_ratio")), convert_percent(F.col("revolving_utilization"))
    return df.withColumns({
        "late_flag": F.when(late > LATE_LIMIT, "risk").otherwise("safe"),
        "dti_flag": F.when(dti > DTI_LIMIT, "risk").otherwise("safe"),
        "utilization_flag": F.when(used > CRITICAL_LIMIT, "critical").when(used > WATCH_LIMIT, "watch")
        .otherwise("healthy"),
    })


def policy_simulation(
    scored: DataFrame,
    recommended: float | None = None,
    lo: int = SLIDER_LOW,
    hi: int = SLIDER_HIGH,
    band: float = REVIEW_BAND,
    label: str = LABEL,
    prob: str = "prob",
) -> DataFrame:
    """Approve / review / reject counts and bad rate for every slider position (hundredths).

    A row is approved from the first cut above its probability on, and rejected up to the last
    cut whose review band ends below it; both are one integer per row, so one pass counts all
    cuts and the totals are running sums over one group per cut.
    """
    n = hi - lo + 1
    p = F.col(prob)

    def cut(k: Column) -> Column:
        return (k + lo) / F.lit(100.0)

    def leading_cuts(offset: float, strict: bool) -> Column:
        """How many cuts lie (strictly) below `p - offset`: a guess, then the cuts beside it."""
        def below(c: Column) -> Column:
            return c + F.lit(offset) < p if strict else c + F.lit(offset) <= p

        guess = F.least(F.greatest(F.floor((p - F.lit(offset)) * 100 - lo), F.lit(-1)), F.lit(n))
        last = guess - 1
        for d in (-1, 0, 1, 2):
            k = guess + d
            last = F.when((k >= 0) & (k < n) & below(cut(k)), k).otherwise(last)
        return F.least(F.greatest(last + 1, F.lit(0)), F.lit(n)).cast("int")

    counted = scored.where(p.isNotNull()).select(
        leading_cuts(0.0, False).alias("not_approved"), leading_cuts(band, True).alias("rejected"),
        F.col(label).alias("bad"),
    ).groupBy("not_approved", "rejected").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))

    def per_cut(count: str, name: str) -> DataFrame:
        return counted.groupBy(F.col(count).alias("k")).agg(
            F.sum("n").alias(f"n_{name}"), F.sum("bad").alias(f"bad_{name}")
        )

    every = index_frame(scored, n + 1)
    joined = every.join(F.broadcast(per_cut("not_approved", "a")), "k", "left").join(
        F.broadcast(per_cut("rejected", "r")), "k", "left"
    ).fillna(0)
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)

    def sums(c: str, w) -> Column:
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    everyone = Window.partitionBy()
    out = joined.select(
        "k", sums("n_a", upto).alias("approve"), sums("bad_a", upto).alias("bad_approved"),
        sums("n_r", after).alias("reject"), sums("bad_r", after).alias("bad_rejected"),
        F.sum("n_a").over(everyone).alias("total"), F.sum("bad_a").over(everyone).alias("bad_total"),
    ).where(F.col("k") < n)
    flag = F.lit(False) if recommended is None else F.col("k") + lo == F.rint(F.lit(recommended * 100))
    return out.select(
        cut(F.col("k")).alias("cut"), "approve",
        (F.col("total") - F.col("approve") - F.col("reject")).alias("review"), "reject",
        F.when(F.col("approve") > 0, F.col("bad_approved") / F.col("approve")).alias("bad_rate"),
        (F.col("total") - F.col("bad_total") - F.col("approve") + F.col("bad_approved")).alias("good_not_approved"),
        (F.col("reject") - F.col("bad_rejected")).alias("good_rejected"),
        flag.alias("recommended"),
    )
