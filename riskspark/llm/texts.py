"""Shared plumbing of the text operators: Arrow maps over whole texts, words, samples, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
TEXT_IN = "__text_in"


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of text; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes]], Sequence[pa.Array]]],
    fields: str,
    text: str = "text",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """`df` with the columns of `fields` (DDL) computed from whole texts, batch by batch, without a shuffle.

    `make` is called once per task and returns the function from a list of UTF-8 texts (null: empty) to
    arrays. `carry` names the columns kept (default all). A kept column with the name of a result goes. A kept
    text is sent to the workers once, as the text to work on.
    """
    spark = df.sparkSession
    new = spark.createDataFrame([], fields).schema
    carry = [c for c in (df.columns if carry is None else carry) if c not in new.names]
    work, schema = df.select(*carry), df.select(*carry).schema
    source = text if text in carry and dict(work.dtypes)[text] == "string" else TEXT_IN
    if source == TEXT_IN:
        work = df.select(*carry, F.col(text).cast("binary").alias(TEXT_IN))
    for f in new.fields:
        schema = schema.add(f)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, source):
                column = part.column(source)
                if source != TEXT_IN:
                    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
                texts = [x or b"" for x in column.to_pylist()]
                arrays = [part.column(c) for c in carry] + list(compute(texts))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        del compute
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return work.mapInArrow(run, schema)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once a row, wherever f uses it: also inside another array function, and after filters are moved."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def runs_of(texts: Sequence[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different runs between ASCII white space, the run at each place of all texts end to end, where each text begins)."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    edges = split.offsets.to_numpy()
    runs, codes, edges = coded.dictionary.to_pylist(), coded.indices.to_numpy(), edges - edges[0]
    if "" in runs:  # white space at an end leaves an empty run
        some = codes != runs.index("")
        codes, edges = codes[some], np.concatenate(([0], np.cumsum(some)))[edges]
    return runs, codes, edges


class Kept:
    """A dict with two generations: when the younger is full, the older goes. It bounds what a worker remembers."""

    def __init__(self, limit: int):
        self.limit, self.size, self.new, self.old = limit, 0, {}, {}

    def get(self, key):
        got = self.new.get(key)
        return self.old.get(key) if got is None else got

    def put(self, key, value, size: int) -> None:
        self.put_all({key: value}, size)

    def put_all(self, items: dict, size: int) -> None:
        self.new.update(items)
        self.size += size
        if self.size > self.limit // 2:
            self.new, self.old, self.size = {}, self.new, 0

    def all(self, keys: Sequence, make: Callable[[list], list], size: int) -> list:
        """The values of different keys; `make` gives those of the unknown ones, each counted as `size` bytes."""
        found = list(map(self.new.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            old = self.old.get
            todo = []
            for i in missing:
                found[i] = old(keys[i])
                if found[i] is None:
                    todo.append(i)
            for i, value in zip(todo, make([keys[i] for i in todo])):
                found[i] = value
            self.put_all({keys[i]: found[i] for i in missing if len(keys[i]) <= 256}, size * len(missing))
        return found


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id is in fold 0 of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, by: str, rows: int, key: str, salt: str) -> DataFrame:
    """About `rows` rows of each value of `by` (null left out), chosen by a hash of `key`.

    One counting pass; the choice is a filter, so nothing is shuffled or gathered.
    """
    sizes = {r[by]: r["count"] for r in df.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    spread = 1 << 30
    at = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(spread))
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col(by) == F.lit(value)) & (at < F.lit(min(spread, int(spread * rows / n) + 1))))
    return df.where(keep)
