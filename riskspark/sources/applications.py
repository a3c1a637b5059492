"""Readers and writers for applications, splits and fitted artifacts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.schema import BORROWER_SCHEMA, ID, LABEL, RAW_TO_NAME

DEFAULT_THRESHOLD = 0.5
LABEL_HEADER = next(raw for raw, name in RAW_TO_NAME.items() if name == LABEL)
# Fixed value: the rule stored next to the threshold.
SELECTION_RULE = "validation F1 maximum"


def rename_columns(df: DataFrame, names: Mapping[str, str] = RAW_TO_NAME) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def _text_columns(spark: SparkSession, path: str) -> DataFrame:
    """The file's fields as text under their own headers; the first one, whatever its header, is `id`.

    Raises ValueError on a header with unknown, repeated or missing columns. Only the label may be absent.
    All files of a folder must have the same header: Spark checks each of them, unless the first header is empty.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    found = reader.csv(path).columns
    first, named = found[0] if found else None, found[1:]
    unknown = sorted(set(named) - set(RAW_TO_NAME))
    missing = sorted(set(RAW_TO_NAME) - set(named) - {LABEL_HEADER})
    if first is None or first in RAW_TO_NAME or unknown or missing or len(set(named)) < len(named):
        raise ValueError(f"applications need an id and the known headers: found {found}, unknown {unknown}, missing {missing}")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in found)
    text = reader.option("enforceSchema", first == "_c0").schema(schema).csv(path)
    return text.withColumnRenamed(first, ID)


def _parsed(text: DataFrame) -> dict[str, Column]:
    """Column per field of BORROWER_SCHEMA; unparsable text is null, whole numbers may be written `40.0`."""
    raw_names = {name: raw for raw, name in RAW_TO_NAME.items()} | {ID: ID}
    out = {}
    for field in BORROWER_SCHEMA.fields:
        raw = raw_names[field.name]
        if raw not in text.columns:
            value = F.lit(None).cast(field.dataType)
        elif field.dataType == T.DoubleType():
            value = F.col(raw).try_cast("double")
        else:
            number = F.col(raw).try_cast("double")
            exact = F.col(raw).try_cast(field.dataType)
            value = F.coalesce(F.when(~F.col(raw).contains("."), exact), F.when(number == F.floor(number), number.try_cast(field.dataType)))
        out[field.name] = value
    return out


def read_applications_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV read by column name, in any order; the first column is the applicant id.

    `NA`, empty and unparsable fields are null; `malformed_applications` lists the latter. A file without the
    label has a null one. Other headers than the known ones raise ValueError.
    """
    text = _text_columns(spark, path)
    return nan_to_null(text.select(*(c.alias(name) for name, c in _parsed(text).items())))


def malformed_applications(spark: SparkSession, path: str) -> DataFrame:
    """(id, fields) of rows with text that is no value of its column, `fields` naming these columns."""
    text = _text_columns(spark, path)
    raw_names = {name: raw for raw, name in RAW_TO_NAME.items()} | {ID: ID}
    bad = [F.when(F.col(raw_names[n]).isNotNull() & c.isNull(), F.lit(n)) for n, c in _parsed(text).items() if raw_names[n] in text.columns]
    rows = text.select(F.col(ID).alias("id"), F.array_compact(F.array(*bad)).alias("fields"))
    return rows.where(F.size("fields") > 0)


def write_applications_csv(df: DataFrame, path: str) -> None:
    raw_names = {name: raw for raw, name in RAW_TO_NAME.items()}
    df.select(*BORROWER_SCHEMA.names).withColumnsRenamed(raw_names).write.option("header", True).option(
        "nullValue", "NA"
    ).csv(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split, features and label in the same row, id kept."""
    writer = df.write.partitionBy("split").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def save_scaler(params: DataFrame, path: str) -> None:
    params.select("feature", "center", "scale").write.parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, center double, scale double").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_threshold(best: DataFrame, path: str, source: str = "riskspark") -> None:
    """Store a one-row frame with a `threshold` column as JSON, rounded to four places."""
    best.select(
        (F.rint(F.col("threshold") * 1e4) / 1e4).alias("best_threshold"),
        F.lit(SELECTION_RULE).alias("selection_rule"),
        F.lit(source).alias("source"),
    ).write.json(path)


def load_threshold(spark: SparkSession, path: str) -> float:
    """The stored threshold, or the default if the file or the key is missing."""
    try:
        row = spark.read.schema("best_threshold double").json(path).first()
    except AnalysisException:
        return DEFAULT_THRESHOLD
    if row is None or row["best_threshold"] is None:
        return DEFAULT_THRESHOLD
    return row["best_threshold"]


def save_metrics(metrics: DataFrame, path: str) -> None:
    """The model comparison is one row per model and split, so one file."""
    metrics.coalesce(1).write.option("header", True).csv(path)
