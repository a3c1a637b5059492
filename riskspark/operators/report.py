"""Per-application reports: reason codes, indicator tables, labels and hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.display import format_indicator
from riskspark.functions.features import round_half_even
from riskspark.operators.explain import TOP_RANK, strongest, to_long
from riskspark.schema import ID

# Display names and hints of the features, and the placeholder for no hint.
FEATURE_LABELS = {
    "revolving_utilization": "Beban Limit Kredit",
    "age": "Usia Pemohon",
    "late_30_59": "Tunggakan 30–59 Hari",
    "debt_ratio": "Rasio Utang",
    "monthly_income": "Pendapatan Bulanan",
    "open_credit_lines": "Jumlah Fasilitas Kredit",
    "late_90d": "Tunggakan 90+ Hari",
    "real_estate_loans": "Pinjaman Properti / Aset",
    "late_60_89": "Tunggakan 60–89 Hari",
    "num_dependents": "Jumlah Tanggungan",
    "total_late_payments": "Total Riwayat Tunggakan",
    "weighted_late_score": "Skor Disiplin Pembayaran",
    "income_per_dependent": "Pendapatan per Tanggungan",
    "monthly_debt": "Cicilan Utang Bulanan",
    "dti_adjusted": "Rasio Cicilan vs Pendapatan",
    "utilization_risk": "Tingkat Risiko Limit",
    "ever_late": "Pernah Menunggak",
    "credit_lines_per_age": "Kredit per Usia",
    "log_income": "Skala Pendapatan (Log)",
}
FEATURE_HINTS = {
    "revolving_utilization": "Seberapa penuh limit KMK/kartu kredit terpakai. <30% = sehat, >70% = berisiko.",
    "debt_ratio": "Total cicilan dibagi total pendapatan. Idealnya di bawah 40%.",
    "monthly_income": "Pendapatan bersih per bulan dari usaha maupun gaji.",
    "total_late_payments": "Jumlah total kejadian menunggak dari semua pinjaman.",
    "weighted_late_score": "Semakin panjang tunggakan, semakin besar skor negatifnya.",
    "income_per_dependent": "Sisa pendapatan setelah dibagi jumlah tanggungan keluarga.",
    "dti_adjusted": "Porsi pendapatan untuk membayar cicilan. Standar perbankan: maks 30–40%.",
}
NO_HINT = "—"
# Contributions this close to zero are neutral, and the display names.
NEUTRAL = 0.01
CONTRIBUTION_LABELS = {
    "worsens": "[RISK] Memperburuk kelayakan",
    "improves": "[BOOST] Memperkuat kelayakan",
    "neutral": "[NEUTRAL] Tidak signifikan",
}


def contribution_class(contribution: Column, eps: float = NEUTRAL) -> Column:
    return F.when(contribution > eps, "worsens").when(contribution < -eps, "improves").otherwise("neutral")


def _looked_up(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def feature_dictionary(
    df: DataFrame, labels: dict[str, str] = FEATURE_LABELS, hints: dict[str, str] = FEATURE_HINTS
) -> DataFrame:
    """Add `label` and `hint` of `feature`; an unknown name is title-cased, a missing hint is a dash.

    The dictionary has one entry per model feature and travels as a literal map.
    """
    name = F.col("feature")
    return df.withColumns({
        "label": F.coalesce(_looked_up(name, labels), F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))),
        "hint": F.coalesce(_looked_up(name, hints), F.lit(NO_HINT)),
    })


def reason_codes(df: DataFrame, n: int = TOP_RANK, keys: Sequence[str] = (ID,), decimals: int = 0) -> DataFrame:
    """The row's n strongest factors: direction, and bar length relative to the strongest."""
    kept = df.select(*keys, strongest(n).alias("top"))
    most = F.abs(F.get("top", F.lit(0))["contribution"])
    long = kept.select(*keys, most.alias("most"), F.posexplode("top").alias("place", "c")).select(
        *keys, "most", (F.col("place") + 1).alias("rank"), "c.*"
    )
    size = F.abs("contribution") / F.col("most") * 100
    return feature_dictionary(long).select(
        *keys, "rank", "feature", "label", format_indicator(F.col("feature"), F.col("value"), decimals).alias("shown"),
        "contribution", F.when(F.col("most") > 0, size).otherwise(0.0).alias("bar_pct"),
        F.when(F.col("contribution") > 0, "raises").otherwise("lowers").alias("direction"),
    )


def indicator_table(df: DataFrame, keys: Sequence[str] = (ID,), decimals: int = 2) -> DataFrame:
    """One row per feature of every application, strongest contribution first (`place`)."""
    ordered = df.withColumn("contributions", strongest())
    long = to_long(ordered, keys)
    c = F.col("contribution")
    return feature_dictionary(long).select(
        *keys, (F.col("position") + 1).alias("place"), "feature", "label",
        format_indicator(F.col("feature"), F.col("value"), decimals).alias("shown"),
        round_half_even(c, 4).alias("contribution"),
        contribution_class(c).alias("effect"),
        _looked_up(contribution_class(c), CONTRIBUTION_LABELS).alias("effect_label"),
        "hint",
    )
