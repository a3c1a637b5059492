"""Ranked lexical search: best-first document intervals over range-maximum tables.

Documents are tokenised once; those of their terms that a query may hold are stored with their counts. Blocks of at
most `SHARD_DOCS` stored documents in one order of ids are indexed in memory: each term has a posting list, with a
sparse table over its impacts, so the largest impact between any two documents is two look-ups. A query starts
with the whole block as one interval. The interval with the largest bound (the sum over its terms of their
largest impact inside, times the term's weight) is taken next; it is split at the document with the largest weighted
impact, which is scored exactly, and both sides are bounded again; an interval of at most `LEAF_DOCS` documents
is scored as a whole. An interval that can't reach the query's k-th best score, or only by a larger id, ends the search.
The best of all blocks are then ranked by Spark.

Weights depend on counts over all documents; impacts are integers and every sum is exact.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.texts import Kept
from riskspark.session import materialize

K = 10
SHARD_DOCS = 32_768
LEAF_DOCS = 2_048
#: Cells of the query terms' filter: a fixed size, whatever the queries.
FILTER_BITS = 22
#: Pairs of query and term answered by one job; a query with more terms is a block of its own.
BLOCK_TERMS = 100_000
WORD_BYTES = 20 << 20
# Length share and saturation of the impact, as in the query's contract.
LENGTH_SHARE, UNIT, LEVEL = 90, 1_000_000_000, 8
# Bytes that belong to a term: digits, letters (A-Z lower-cased) and everything outside ASCII.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def cell(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) >> (64 - FILTER_BITS)


def query_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """(item, terms): the different terms of each query, sorted; a null text has none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(set(terms_of(x or b""))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.binary()))], names=["item", "terms"]
            )

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(key).alias("item"), F.col(text).cast("binary")).mapInArrow(split, f"item {kind}, terms array<binary>")


def filter_cells(terms: DataFrame) -> np.ndarray:
    """Bitmap of the cells that some query term has; at most 2^FILTER_BITS numbers reach the driver."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({cell(t) for t in batch.column(0).to_pylist()}), pa.int32())], names=["c"])

    found = terms.select(F.explode("terms").alias("term")).distinct().mapInArrow(cells, "c int").distinct().toArrow()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[found["c"].to_numpy()] = True
    return np.packbits(bits)


def counted_documents(docs: DataFrame, packed: np.ndarray, text: str, key: str) -> DataFrame:
    """(id, n, terms, tfs): every document with a term; its number of terms, and those in the filter with their counts."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        known = Kept(WORD_BYTES)

        def wanted(words: list[bytes]) -> list[bool]:
            return [bool(bits[cell(w)]) for w in words]

        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                words = terms_of(value.as_py() or b"")
                if not words:
                    continue
                counts = Counter(words)
                names = list(counts)
                here = [w for w, ok in zip(names, known.all(names, wanted, 120)) if ok]
                ids.append(i)
                sizes.append(len(words))
                terms.append(here)
                tfs.append([counts[w] for w in here])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.binary())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "tfs"],
            )

    return docs.select(F.col(key).alias("id"), F.col(text).cast("binary")).mapInArrow(count, f"id {kind}, n long, terms array<binary>, tfs array<long>")


def weight(documents: int, df: Column) -> Column:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) in doubles."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (F.lit(2.0) * df + 1))).cast("long")


class Postings:
    """Posting lists of a block of documents with a sparse maximum table for each list that a query asks for.

    `lists[term]` is (places ascending, impacts, tables); level j of the tables holds the maximum of 2^j neighbours.
    """

    def __init__(self, terms: pa.Array, place: np.ndarray, impact: np.ndarray):
        coded = terms.dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.place, self.impact = place[order], impact[order]
        edges = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        self.range = {t: (a, b) for t, a, b in zip(coded.dictionary.to_pylist(), edges[:-1].tolist(), edges[1:].tolist())}
        self.tables: dict[bytes, list[np.ndarray]] = {}

    def table(self, term: bytes) -> list[np.ndarray]:
        levels = self.tables.get(term)
        if levels is None:
            a, b = self.range[term]
            levels = [self.impact[a:b]]
            while 2 << (len(levels) - 1) <= b - a:
                half = 1 << (len(levels) - 1)
                levels.append(np.maximum(levels[-1][:-half], levels[-1][half:]))
            self.tables[term] = levels
        return levels


class Search:
    """One query in one block: the posting lists of its terms end to end, searched by intervals of places."""

    def __init__(self, index: Postings, terms: list[tuple[bytes, int]], k: int, leaf: int, floor: int = 0):
        have = [(t, w) for t, w in terms if w > 0 and t in index.range]
        self.k, self.leaf, self.floor = k, leaf, floor
        self.weights = [w for _, w in have]
        self.lists = [index.place[slice(*index.range[t])] for t, _ in have]
        self.tables = [index.table(t) for t, _ in have]
        self.best: list[tuple[int, int]] = []  # a heap of (score, -place)

    def bound(self, cuts: list[tuple[int, int]]) -> tuple[int, int]:
        """(sum of the largest weighted impacts in the posting ranges, the list with the largest)."""
        total, most, top = 0, -1, -1
        for i, (a, b) in enumerate(cuts):
            if a < b:
                j = (b - a).bit_length() - 1
                level = self.tables[i][j]
                x = self.weights[i] * max(int(level[a]), int(level[b - (1 << j)]))
                total += x
                if x > most:
                    most, top = x, i
        return total, top

    def offer(self, score: int, place: int) -> None:
        if len(self.best) < self.k:
            heapq.heappush(self.best, (score, -place))
        elif (score, -place) > self.best[0]:
            heapq.heapreplace(self.best, (score, -place))

    def hopeless(self, bound: int, low: int) -> bool:
        """No document from place `low` on with this bound can be among the best."""
        return bound <= 0 or bound < self.floor or len(self.best) == self.k and (bound, -low) < self.best[0]

    def score_all(self, cuts: list[tuple[int, int]], low: int, high: int) -> None:
        sums = np.zeros(high - low, np.int64)
        for i, (a, b) in enumerate(cuts):
            if a < b:
                sums[self.lists[i][a:b] - low] += self.weights[i] * self.tables[i][0][a:b]
        some = np.flatnonzero(sums)
        if len(some) > self.k:
            some = some[np.lexsort((some, -sums[some]))[: self.k]]
        for at in some.tolist():
            self.offer(int(sums[at]), low + at)

    def run(self, documents: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents with a score above 0; equal scores: the smaller place."""
        cuts = [(0, len(x)) for x in self.lists]
        total, top = self.bound(cuts)
        heap = [(-total, 0, documents, cuts, top)]
        while heap:
            bound, low, high, cuts, top = heapq.heappop(heap)
            if self.hopeless(-bound, low):
                break  # the rest of the heap has smaller bounds, or larger places
            if high - low <= self.leaf:
                self.score_all(cuts, low, high)
                continue
            a, b = cuts[top]
            at = a + int(self.tables[top][0][a:b].argmax())
            pivot = int(self.lists[top][at])
            left, right, score = [], [], 0
            for i, (a, b) in enumerate(cuts):
                m = a + int(self.lists[i][a:b].searchsorted(pivot)) if a < b else a
                hit = m < b and bool(self.lists[i][m] == pivot)
                score += self.weights[i] * int(self.tables[i][0][m]) if hit else 0
                left.append((a, m))
                right.append((m + hit, b))
            self.offer(score, pivot)
            for lo, hi, part in ((low, pivot, left), (pivot + 1, high, right)):
                total, first = self.bound(part)
                if lo < hi and not self.hopeless(total, lo):
                    heapq.heappush(heap, (-total, lo, hi, part, first))
        return sorted(((s, -p) for s, p in self.best), key=lambda x: (-x[0], x[1]))


def impacts(tf: np.ndarray, n: np.ndarray, place: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) with m = 100 - 90 + (90 n N) div L; `n` by document, `place` the posting's document."""
    m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * documents // length for x in n.tolist()], np.int64)
    return (UNIT * tf) // (1000 * tf + LEVEL * m[place])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in tables of at most `SHARD_DOCS`."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, SHARD_DOCS - size)
            held.append(some)
            size += some.num_rows
            batch = batch.slice(some.num_rows)
            if size == SHARD_DOCS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def block_candidates(stored: DataFrame, queries: list[tuple[int, list[tuple[bytes, int]]]], documents: int, length: int, k: int, leaf: int) -> DataFrame:
    """(query, id, score): the k best documents of every block of stored documents for each of `queries`."""
    kind = stored.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The k-th best score of this task's documents so far: a later block's documents must reach it.
        tops: dict[int, list[int]] = {}
        for part in blocks_of(batches):
            part = part.take(pc.array_sort_indices(part.column("id").combine_chunks()))
            lengths = pc.list_value_length(part.column("terms")).to_numpy()
            place = np.repeat(np.arange(part.num_rows), lengths)
            tf = pc.list_flatten(part.column("tfs")).to_numpy()
            worth = impacts(tf, part.column("n").to_numpy(), place, documents, length)
            index = Postings(pc.list_flatten(part.column("terms")).combine_chunks(), place, worth)
            q, at, score = [], [], []
            for number, terms in queries:
                top = tops.get(number, [])
                found = Search(index, terms, k, leaf, top[-1] if len(top) == k else 0).run(part.num_rows)
                tops[number] = sorted([*top, *(s for s, _ in found)], reverse=True)[:k]
                q += [number] * len(found)
                score += [s for s, _ in found]
                at += [p for _, p in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), part.column("id").take(pa.array(at, pa.int64())).combine_chunks(), pa.array(score, pa.int64())],
                names=["query", "id", "score"],
            )

    return stored.select("id", "n", "terms", "tfs").mapInArrow(search, f"query long, id {kind}, score long")


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", key: str = "doc_id", item: str = "item_id",
    item_text: str = "text", leaf: int = LEAF_DOCS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item, rank, key, score): the k best documents of each query with a score above 0, equal scores by ascending key.

    A null or empty text has no term, and takes no part; a null key is the largest. Repeated documents and queries
    are rows of their own. Other columns are left out. No documents or no queries: no rows.

    Queries are answered in blocks of `block_terms` terms; a block's candidates are written before the next one.
    """
    queries = materialize(query_terms(items, item_text, item), "lexical-queries")
    stored = materialize(counted_documents(docs, filter_cells(queries), text, key), "lexical-documents")
    sizes = stored.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
    documents, length = int(sizes["n"]), int(sizes["length"] or 0)

    df = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    numbered = queries.groupBy("terms").agg(F.count("*").alias("n")).where(F.size("terms") > 0)
    pairs = numbered.select(F.xxhash64("terms").alias("query"), F.explode("terms").alias("term"))
    weighed = materialize(
        pairs.join(df, "term").withColumn("w", weight(documents, F.col("df"))).groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms")),
        "lexical-weights",
    )
    rows = weighed.withColumn("size", F.size("terms"))
    # Blocks by hash, so that none gathers more than a few times its share; their number follows the queries.
    total = int(rows.agg(F.sum("size").alias("s")).first()["s"] or 0)
    blocks = max(1, -(-total // block_terms))
    kind = docs.schema[key].dataType.simpleString()
    order = [F.desc("score"), F.asc_nulls_last("id")]
    best = None
    for b in range(blocks):
        chosen = rows.where(F.pmod(F.xxhash64(F.lit("block"), "query"), F.lit(blocks)) == b).select("query", "terms").collect()
        asked = [(r["query"], [(bytes(t["term"]), t["w"]) for t in r["terms"]]) for r in chosen]
        if not asked:
            continue
        found = block_candidates(stored, asked, documents, length, k, leaf)
        first = F.row_number().over(Window.partitionBy("query").orderBy(*order))
        kept = materialize(found.withColumn("rank", first).where(F.col("rank") <= k), "lexical-best")
        best = kept if best is None else best.unionByName(kept)
    if best is None:
        best = docs.sparkSession.createDataFrame([], f"query long, id {kind}, score long, rank int")
    asked = queries.where(F.size("terms") > 0).select(F.col("item").alias(item), F.xxhash64("terms").alias("query"))
    return asked.join(best, "query").select(item, "rank", F.col("id").alias(key), "score")


#: The contract in SQL.
SQL = """
with words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws
  from documents
), sizes as (
  select r, doc_id, len(ws) as n from words where len(ws) > 0
), totals as (
  select count(*) as docs, sum(n)::bigint as length from sizes
), tfs as (
  select r, w, count(*) as tf from (select r, unnest(ws) as w from words) group by r, w
), dfs as (
  select w, count(*) as df from tfs group by w
), asked as (
  select distinct q, item_id, w from (
    select row_number() over () as q, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as w
    from benchmark)
), weights as (
  select q, item_id, w, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * df + 1)))::bigint as weight
  from asked join dfs using (w), totals
), scores as (
  select q, item_id, doc_id, r,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))))::bigint as score
  from weights join tfs using (w) join sizes using (r), totals group by q, item_id, doc_id, r
), ranked as (
  select item_id, row_number() over (partition by q order by score desc, doc_id asc nulls last, r) as rank, doc_id, score
  from scores where score > 0
)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10
"""
