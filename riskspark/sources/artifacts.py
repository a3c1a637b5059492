"""Versions of stored artifacts: each run writes into a folder of its own, then names it in a manifest.

The manifest entry is written last, with the row counts, schemas and checksums of all that the run wrote. Readers
take the newest entry and nothing else, so a run that ended half-way is never read, and a rerun into the same
folder never touches what a reader has pinned.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "version long, folder string, uses string, parts string"


@dataclass(frozen=True)
class Version:
    """A committed run: its number, folder, the run it was built on, and what it wrote."""

    number: int
    folder: str
    uses: str | None
    parts: dict[str, dict]

    def path(self, name: str) -> str:
        if name not in self.parts:
            raise KeyError(f"{name} is not part of version {self.number} in {self.folder}")
        return f"{self.folder}/{name}"


def new_folder(out: str, phase: str) -> str:
    return f"{out}/{phase}/{uuid.uuid4().hex[:12]}"


def _of_table(df: DataFrame) -> dict:
    """Rows and a checksum that doesn't depend on their order."""
    got = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": got["rows"], "checksum": str(got["sum"]), "schema": df.schema.jsonValue()}


def _of_files(spark: SparkSession, path: str) -> dict:
    """The same of small files in any format, such as a saved model."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    got = files.agg(F.sum("length").alias("bytes"), F.sum(F.xxhash64("content").cast("decimal(38,0)")).alias("sum")).first()
    return {"bytes": got["bytes"], "checksum": str(got["sum"])}


def commit(
    spark: SparkSession, out: str, phase: str, folder: str, tables: Sequence[str], files: Sequence[str] = (), uses: str | None = None
) -> Version:
    """Name a written folder as the newest version of its phase. `files` are read whole to be summed: models, settings."""
    parts = {name: _of_table(spark.read.parquet(f"{folder}/{name}")) for name in tables}
    parts |= {name: _of_files(spark, f"{folder}/{name}") for name in files}
    number = max((v.number for v in versions(spark, out, phase)), default=0) + 1
    entry = spark.createDataFrame([(number, folder, uses, json.dumps(parts))], ENTRY)
    entry.coalesce(1).write.mode("append").json(f"{out}/manifest/{phase}")
    return Version(number, folder, uses, parts)


def versions(spark: SparkSession, out: str, phase: str) -> list[Version]:
    """The committed versions of a phase, oldest first; one small entry a run."""
    try:
        rows = spark.read.schema(ENTRY).json(f"{out}/manifest/{phase}").orderBy("version", "folder").collect()
    except AnalysisException:
        return []
    return [Version(r["version"], r["folder"], r["uses"], json.loads(r["parts"])) for r in rows]


def newest(spark: SparkSession, out: str, phase: str) -> Version:
    found = versions(spark, out, phase)
    if not found:
        raise FileNotFoundError(f"no committed {phase} below {out}")
    return found[-1]


def by_folder(spark: SparkSession, out: str, phase: str, folder: str) -> Version:
    return next(v for v in versions(spark, out, phase) if v.folder == folder)


def read_table(spark: SparkSession, version: Version, name: str, verify: bool = False) -> DataFrame:
    """A table of a version, with the schema it was committed with; `verify` sums it again."""
    part = version.parts[name]
    df = spark.read.schema(StructType.fromJson(part["schema"])).parquet(version.path(name))
    if verify and _of_table(df) != part:
        raise ValueError(f"{version.path(name)} is not what version {version.number} committed")
    return df


def verify_files(spark: SparkSession, version: Version, name: str) -> str:
    """The path of a version's files, summed again."""
    if _of_files(spark, version.path(name)) != version.parts[name]:
        raise ValueError(f"{version.path(name)} is not what version {version.number} committed")
    return version.path(name)
