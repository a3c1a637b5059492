"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join, confirmed on full sets.

A document is the set of its five-word shingles. Documents with equal sets form one class, so copies cost one
row each and never meet. A class has a signature of SYMBOLS min-hashes, 16 bits each. The first
CHUNKS * WIDTH symbols are split into CHUNKS chunks; a pair that differs in at most
`CHUNKS * (ERRORS + 1) - 1` of them has, by the pigeonhole principle, a chunk with at most ERRORS differences,
so it shares one of the keys that enumerate the chunk's error places (each chunk without ERRORS of its
symbols). At a similarity of 0.75 two sets miss all chunks with probability (1 - 0.738)^8, about 2e-5, and
less above. Classes of a key are compared by size (0.75 is out of reach for sets of more unequal sizes) and by the distance
of whole signatures; a pair is dropped only beyond
DISTANCE differing symbols, 4.3 standard deviations above the mean at 0.75.

Links are confirmed on full sets. First, ROUNDS times, every class's NEIGHBOURS nearest by signature in other
components (as many pairs a class at most), the confirmed links contracted into components each time. Then keys that
still hold several components are laid out with the full sets, and a task compares all pairs between components
in its block: a pair is tested under the first key that it shares, and only links that join two components of the
block come out, so a block of n classes gives at most n - 1 rows however many pairs it tests. Pairs inside a
component can't change the result. Keys with many or large classes are cut into blocks of bounded size. Sets of the
classes in question are read again from the documents, not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.texts import map_texts, runs_of
from riskspark.session import materialize

SHINGLE, PERCENT = 5, 75
SYMBOLS, CHUNKS, WIDTH, ERRORS = 128, 8, 4, 1
DISTANCE = 53
ROUNDS, NEIGHBOURS = 1, 3
#: Classes, and shingles of all their sets, of a block.
BLOCK, BLOCK_SHINGLES = 2_048, 4_000_000
SLOTS = 1 << 19
SET_BYTES = 5
_MIX = np.random.default_rng(75).integers(1, 1 << 63, (SYMBOLS, 2), dtype=np.uint64) | np.uint64(1)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, each text's sorted and distinct, end to end; where each text begins).

    Words are runs between ASCII white space with A-Z lowered. A text of one to four words is one shingle.
    """
    runs, codes, edges = runs_of([t.lower() for t in texts])
    words = np.fromiter((xxhash.xxh64_intdigest(r) for r in runs), np.uint64, len(runs))[codes]
    sizes = np.diff(edges)
    span = np.minimum(sizes, SHINGLE)
    count = np.where(sizes > 0, sizes - span + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    upto = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(upto[-1]) - upto[text] + edges[text]
    h = span[text].astype(np.uint64)
    for k in range(SHINGLE):
        live = k < span[text]
        h = np.where(live, (h * _TIMES) ^ words[np.minimum(at + k, max(len(words) - 1, 0))], h) if len(words) else h
    h = mixed(h)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols of each non-empty set."""
    starts = edges[:-1][np.diff(edges) > 0]
    out = np.empty((len(starts), SYMBOLS), np.uint16)
    for k, (a, b) in enumerate(_MIX):
        out[:, k] = (np.minimum.reduceat((h ^ b) * a >> np.uint64(16), starts) & np.uint64(0xFFFF)) if len(starts) else 0
    return out


def sketch(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry, n_shingles, set_id, keys, signature) of every row; without words 0, null, null, null.

    `set_id` is a 64-bit hash of the whole set: equal for equal sets; two different sets share one by chance
    only once in 2^64 pairs. `keys` are the index keys, `signature` one byte of each symbol.
    """
    chosen = [np.array(c) for c in combinations(range(WIDTH), WIDTH - ERRORS)]

    def make():
        def compute(texts: list[bytes]) -> list[pa.Array]:
            h, edges = shingle_sets(texts)
            n = np.diff(edges)
            has = np.flatnonzero(n)
            ids, keys, marks = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            if len(has):
                whole = mixed(np.add.reduceat(mixed(h + _TIMES), edges[:-1][has]) + n[has].astype(np.uint64))
                sig = signatures(h, edges)
                parts = []
                for c in range(CHUNKS):
                    chunk = sig[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
                    for e, places in enumerate(chosen):
                        v = np.full(len(has), 1 + c * len(chosen) + e, np.uint64)
                        for p in places:
                            v = v * np.uint64(1 << 16) ^ chunk[:, p]
                        parts.append(mixed(v * _TIMES))
                grid = np.stack(parts, axis=1).view(np.int64)
                low = (sig & 0xFF).astype(np.uint8)
                for j, i in enumerate(has.tolist()):
                    ids[i], keys[i], marks[i] = int(whole[j].view(np.int64)), grid[j], low[j].tobytes()
            return [pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())]

        return compute

    return map_texts(docs, make, "n_shingles long, set_id long, keys array<long>, signature binary", text, [key, *carry])


def whole_groups(batches: Iterator[pa.RecordBatch], cols: list[str]) -> Iterator[pa.Table]:
    """The rows of a partition sorted by `cols`, regrouped so that no group is split."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        n = table.num_rows
        if not n:
            continue
        same = np.ones(n, bool)
        for c in cols:
            v = table.column(c).to_numpy()
            same &= v == v[-1]
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def close_pairs(table: pa.Table, cols: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, later row, distance) of all pairs of a group within DISTANCE, one offset at a time."""
    n = table.num_rows
    group = np.zeros(n, np.int64)
    for c in cols:
        v = table.column(c).to_numpy()
        group[1:] += v[1:] != v[:-1]
    group = np.cumsum(group > 0)
    size = np.bincount(group)
    left_over = (np.cumsum(size)[group] - 1) - np.arange(n)
    size_of = table.column("n_shingles").to_numpy()
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(n, SYMBOLS)
    rows = np.flatnonzero(left_over > 0)
    d = 1
    while len(rows):
        for a in range(0, len(rows), 1 << 16):
            i = rows[a : a + (1 << 16)]
            i = i[100 * np.minimum(size_of[i], size_of[i + d]) >= PERCENT * np.maximum(size_of[i], size_of[i + d])]
            far = (sig[i] != sig[i + d]).sum(axis=1)
            near = far <= DISTANCE
            if near.any():
                yield i[near], i[near] + d, far[near]
        d += 1
        rows = rows[left_over[rows] >= d]


def nearest(members: DataFrame) -> DataFrame:
    """(a, b) with a < b: each class's nearest ones of other components.

    A key's block offers a class its nearest; of these, one for each of its keys at most, NEIGHBOURS are taken.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "block"]):
            ids, parts = table.column("set_id").to_numpy(), table.column("part").to_numpy()
            best, other = np.full(len(ids), SYMBOLS + 1), np.zeros(len(ids), np.int64)
            for i, j, far in close_pairs(table, ["key", "block"]):
                apart = parts[i] != parts[j]
                i, j, far = i[apart], j[apart], far[apart]
                for x, y in ((i, j), (j, i)):
                    nearer = (far < best[x]) | ((far == best[x]) & (ids[y] < other[x]))
                    best[x[nearer]], other[x[nearer]] = far[nearer], ids[y[nearer]]
            at = np.flatnonzero(best <= SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best[at]), pa.array(other[at])], names=["set_id", "far", "other"])

    found = members.mapInArrow(find, "set_id long, far long, other long")
    best = found.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "other"))), 1, NEIGHBOURS).alias("best"))
    best = best.select("set_id", F.explode("best.other").alias("other"))
    return best.select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b")).distinct()


def first_met(keys: np.ndarray, key: int, i: int, js: np.ndarray) -> np.ndarray:
    """Those of the rows `js` that share no key with row `i` before `key`; keys[p] has the rows' keys at place p."""
    for at in keys:
        if at[i] == key or not len(js):
            break
        js = js[at[js] != at[i]]
    return js


def joining_links(table: pa.Table) -> Iterator[tuple[int, int]]:
    """(row, row) of confirmed links that join two components of a (key, block) group."""
    n = table.num_rows
    key, block, own, part, size = (table.column(c).to_numpy() for c in ("key", "block", "own", "part", "n_shingles"))
    keys = np.ascontiguousarray(pa.concat_arrays(table.column("keys").chunks).flatten().to_numpy().reshape(n, -1).T)
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(n, SYMBOLS)
    sets = table.column("members")
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
    for s, e in zip(starts, [*starts[1:], n]):
        comp = np.unique(part[s:e], return_inverse=True)[1]
        codes = None
        if comp.max() == 0:
            continue
        mixed_blocks = len(np.unique(own[s:e])) > 1
        for i in range(s, e - 1):
            js = np.flatnonzero(comp[i + 1 - s :] != comp[i - s]) + i + 1
            if mixed_blocks:  # pairs inside a block are tested where the block is alone
                js = js[own[js] != own[i]]
            js = js[100 * np.minimum(size[i], size[js]) >= PERCENT * np.maximum(size[i], size[js])]
            js = first_met(keys[:, s:e], key[i], i - s, js - s) + s
            js = js[(sig[js] != sig[i]).sum(axis=1) <= DISTANCE]
            if not len(js):
                continue
            if codes is None:
                found = [numbers(x) for x in sets.slice(s, e - s).to_pylist()]
                long = np.array([len(x) for x in found])
                at = np.concatenate(([0], np.cumsum(long)))
                codes = np.unique(np.concatenate(found), return_inverse=True)[1]
                mark = np.zeros(codes.max() + 1, bool)
                del found
            mine, rows = codes[at[i - s] : at[i - s + 1]], js - s
            mark[mine] = True
            upto = np.cumsum(long[rows])
            begin = upto - long[rows]
            # Every candidate's shingles end to end, and how many of each are among this row's.
            places = np.arange(upto[-1]) + np.repeat(at[rows] - begin, long[rows])
            common = np.add.reduceat(mark[codes[places]].astype(np.int64), begin)
            mark[mine] = False
            for j in rows[100 * common >= PERCENT * (len(mine) + long[rows] - common)]:
                if comp[j] != comp[i - s]:
                    comp[comp == comp[j]] = comp[i - s]
                    yield i, j + s


def between(laid: DataFrame) -> DataFrame:
    """(a, b) with a < b: confirmed links that join different components, from members laid out with their sets."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "block"]):
            ids = table.column("set_id").to_numpy()
            links = np.array(list(joining_links(table)), np.int64).reshape(-1, 2)
            ends = np.sort(ids[links], axis=1)
            if len(ends):
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return materialize(laid.mapInArrow(find, "a long, b long").distinct(), "links")


def blocked(members: DataFrame, classes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Members (key, n, weight, set_id, ...) with their signatures, laid out by (key, block) of bounded size.

    With `sets`, a row has its keys and its full set too, and a key of several blocks is laid out by pairs of
    blocks, so that all its pairs meet.
    """
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("long")
    placed = members.withColumn("own", F.pmod(F.xxhash64("set_id"), blocks))
    columns = ["set_id", "signature", "n_shingles"]
    if sets is None:
        laid = placed.withColumn("block", F.col("own"))
    else:
        each = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least("own", j) * blocks + F.greatest("own", j))
        laid = placed.withColumn("block", F.explode(each)).join(sets, "set_id")
        columns.append("keys")
    laid = laid.join(classes.select(columns), "set_id")
    return laid.repartition("key", "block").sortWithinPartitions("key", "block", "set_id")


def numbers(raw: bytes) -> np.ndarray:
    """The shortened hashes of a set."""
    wide = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
    return wide.view("<u8").ravel()


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """(set_id, members) of the classes whose set_id is in `ids`, members being shortened hashes end to end.

    Sets come from the classes' first documents. These are found without moving texts: the ids in question
    leave marks in SLOTS slots, a table of bounded size that is broadcast; what else a slot lets through goes
    in the join on the class.
    """
    needed = ids.select("set_id").distinct().join(classes.select("set_id", "first_doc"), "set_id")
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(SLOTS)).cast("int")
    slots = materialize(needed.select(slot("first_doc").alias("_slot")).distinct(), "slots")

    def make():
        def compute(texts: list[bytes]) -> list[pa.Array]:
            h, edges = shingle_sets(texts)
            n = np.diff(edges)
            raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
            ids = [None] * len(texts)
            has = np.flatnonzero(n)
            if len(has):
                whole = mixed(np.add.reduceat(mixed(h + _TIMES), edges[:-1][has]) + n[has].astype(np.uint64))
                for i, v in zip(has.tolist(), whole.view(np.int64).tolist()):
                    ids[i] = v
            return [pa.array(ids, pa.int64()), pa.array([raw[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())]

        return compute

    near = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).withColumn("_slot", slot("_doc")).join(F.broadcast(slots), "_slot", "left_semi")
    sets = map_texts(near.select("_doc", "_text"), make, "set_id long, members binary", "_text", ["_doc"])
    sets = sets.join(needed, (sets["set_id"] == needed["set_id"]) & sets["_doc"].eqNullSafe(needed["first_doc"]), "left_semi")
    return materialize(sets.select("set_id", "members").dropDuplicates(["set_id"]), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= PERCENT * union."""
    pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id")))
    sets = full_sets(ends, classes, docs, text, key)
    both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("members").alias("of_a")), "a").join(
        sets.select(F.col("set_id").alias("b"), F.col("members").alias("of_b")), "b"
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist()):
                x, y = numbers(x), numbers(y)
                # A set's own members differ; equal shortened hashes of two sets count as one.
                joint = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((joint[1:] == joint[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.select("a", "b", "of_a", "of_b").mapInArrow(test, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes of `links` (a, b).

    Alternating star contractions: every node's larger neighbours, then its smaller ones, are tied to its
    smallest neighbour, until each component is a star. A round writes its edges as a shared table; rounds grow
    with the logarithm of the longest chain.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def open_members(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members with their component `part`, in keys that hold several components."""
    if roots is None:
        return members.withColumn("part", F.col("set_id"))
    labelled = members.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("part", F.coalesce("root", "set_id")).drop("root")
    keys = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    return labelled.join(keys, "key")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry, n_shingles, component_id, kept, set_id, root) of every row.

    Rows without words are alone: `component_id` is their own key. `component_id` is the smallest key of the
    component, `kept` whether it is the row's own; repeated rows have the same answer. A null key takes part
    with its text; its component is the smallest key that isn't null, if there is one. `root` is
    the smallest set_id of the component, null without words: unlike `component_id` it tells components apart when
    ids are null or repeat. Of the other columns those in `carry` are kept.
    """
    sketches = materialize(sketch(docs, text, key, carry), "sketches")
    rows = sketches.where("set_id is not null")
    classes = materialize(
        rows.groupBy("set_id").agg(F.min(key).alias("first_doc"), F.first("keys").alias("keys"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "classes"
    )
    each = classes.select("set_id", "n_shingles", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).where("n > 1")
    members = materialize(each.drop("n_shingles").join(shared, "key"), "members")
    links, roots = None, None
    for _ in range(ROUNDS):
        pairs = nearest(blocked(open_members(members, roots), classes))
        new = confirmed(pairs, classes, docs, text, key)
        links = new if links is None else links.unionByName(new)
        roots = materialize(components(links), "roots")
    rest = materialize(open_members(members, roots), "open")
    last = between(blocked(rest, classes, full_sets(rest, classes, docs, text, key)))
    links = last if links is None else links.unionByName(last)
    roots = materialize(components(links), "roots")
    firsts = classes.select("set_id", "first_doc").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    smallest = firsts.groupBy("root").agg(F.min("first_doc").alias("_component"))
    of_set = firsts.join(smallest, "root").select("set_id", "_component", "root")
    found = sketches.select(key, *carry, "n_shingles", "set_id").join(of_set, "set_id", "left").withColumn("component_id", F.coalesce("_component", key))
    return found.select(key, *carry, "n_shingles", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("kept"), "set_id", "root")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
