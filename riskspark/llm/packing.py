"""Best-fit packing of documents into token sequences by minimum bin slack.

A document's ids, followed by one separator, are cut into pieces only where they exceed a sequence. A
sequence is then filled like this: the longest piece left opens it, and a subset-sum over the lengths
still available (a bitset, copies by binary splitting, longer lengths first) finds the fullest feasible
combination for the rest, which is removed. Only lengths matter, so the search works on a histogram of at
most `capacity` counts, and a combination is taken as many times as its scarcest length allows: there are
at most `capacity` different combinations, whatever the number of documents. Pieces meet their places by
their rank among the pieces of the same length, which Spark counts in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.bpe import encoder
from riskspark.llm.texts import map_texts
from riskspark.session import materialize

CAPACITY = 2_048
BLOCK_ROWS = 20_000


def token_pieces(
    docs: DataFrame, vocab: str, capacity: int = CAPACITY, separator: int = 0, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, piece, start, length, ids): each document's ids and a separator, cut every `capacity` tokens.

    Null or empty text: the separator alone. Repeated rows are documents of their own. Other columns are left out.
    """

    def make():
        enc, last = encoder(vocab), np.array([separator], "<u4").tobytes()

        def compute(texts: list[bytes]) -> list[pa.Array]:
            ids, upto = enc.many(texts)
            raw, places = memoryview(ids.tobytes()), (4 * upto).tolist()
            whole = [bytes(raw[a:b]) + last for a, b in zip(places, places[1:])]
            step = 4 * capacity
            return [pa.array([[x[a : a + step] for a in range(0, len(x), step)] for x in whole], pa.list_(pa.binary()))]

        return compute

    whole = map_texts(docs, make, "pieces array<binary>", text, [key])
    return whole.select(key, F.posexplode("pieces").alias("piece", "ids")).select(
        key, "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        F.expr("octet_length(ids) div 4").cast("long").alias("length"), "ids",
    )


def fullest(counts: Sequence[int], room: int) -> list[tuple[int, int]]:
    """The fullest combination of available lengths within `room`: (length, copies), longer first."""
    full, mask = 1 << room, (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            grown = (reach | reach << (k * length)) & mask
            if grown != reach:
                steps.append((length, k, reach))
                reach = grown
            left, k = left - k, 2 * k
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= k * length
    return sorted(taken.items(), reverse=True)


def bin_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, combination) until no length is left; a combination is (length, copies), longer first."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            taken = dict(fullest(counts, capacity - longest))
            counts[longest] += 1
            taken[longest] = taken.get(longest, 0) + 1
            times = min(counts[x] // k for x, k in taken.items())
            for x, k in taken.items():
                counts[x] -= times * k
            out.append((times, sorted(taken.items(), reverse=True)))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`pieces` (with length from 1 to `capacity`) and `sequence_id`, `offset`; an empty table gives none.

    Equal rows are interchangeable. The driver sees one count per length; the places, at most one row for
    each length in each combination, are broadcast: their number is bounded by the capacity alone. A length's
    rows are ranked in hash blocks of about `block_rows`, so no length is gathered in one task.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for times, taken in bin_patterns(histogram, capacity):
        offset = 0
        for length, k in taken:
            rows.append((length, used[length], used[length] + times * k, sequence, k, offset))
            used[length] += times * k
            offset += length * k
        sequence += times
    places = spark.createDataFrame(rows, "length long, lo long, hi long, first long, copies long, at long")
    blocks = max([1, *histogram.values()]) // block_rows + 1
    order = [c for c in pieces.columns if c != "length"]
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy("length", "_block").agg(F.count("*").alias("_n")).select(
        "length", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order))
    ranked = blocked.withColumn("_in", within - 1).join(sizes, ["length", "_block"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    nth = F.col("_rank") - F.col("lo")
    hit = (ranked["length"] == places["length"]) & (ranked["_rank"] >= places["lo"]) & (ranked["_rank"] < places["hi"])
    return ranked.join(F.broadcast(places), hit).select(
        *[ranked[c] for c in pieces.columns],
        (F.col("first") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("copies")) * ranked["length"]).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, vocab: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with the checksum of its ids and its place in a sequence."""
    pieces = token_pieces(docs, vocab, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(pieces, "pieces"), capacity)
