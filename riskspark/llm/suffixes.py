"""Removal of long repeated byte strings by distributed prefix doubling.

A byte goes if a string of `width` bytes over it also starts in a document with a smaller id. The classes of
equal strings are found as in a suffix array built by prefix doubling, where a rank covers 8, 16, 32 and then
`width` bytes, each from two ranks at growing offsets, and where a position leaves as soon as it is alone:

1. Not every position is sorted. Of the 16-byte strings inside each string of `width` bytes the one with the least
   hash is its anchor; equal strings have equal anchors at equal places, and about one position in 18 is one.
   Anchors are sorted by Spark on their rank pair (8 bytes, the next 8 bytes). Anchors that only one text has leave,
   and with them every string they stand for.
2. The rest meet again in one range of Spark's order, each with the bytes of its strings; there the strings
   are ranked at 16, 32 and `width` bytes, and the least document of each final rank decides.

Rank names are 64-bit; final ranks are compared byte by byte. Equal texts are one text, owned by their least document.
A rank pair of a large share of all anchors (bounded list, counted first) isn't sorted by the pair: its strings are
dealt out one by one, by their own hash, after equal ones of a slice were settled where they lie. So no task gathers
a common passage. A text longer than `SEGMENT` is worked on in segments that overlap by `width` - 1 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import materialize

WIDTH = 50
GRAM = 16
SEGMENT = 1 << 20
#: A rank pair is common if as many texts of one slice, and as many or this share of all anchors over all, have it.
COMMON_HERE, COMMON_ROWS, COMMON_SHARE = 4, 16_384, 1 << 18
NO_ID = (1 << 63) - 1
_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    return x ^ (x >> np.uint64(29))


def paired(rank: np.ndarray, offset: int) -> np.ndarray:
    """The rank of twice the length (or less, if they overlap): from the ranks at each place and `offset` behind."""
    out = rank * _C
    out[: len(out) - offset] += rank[offset:]
    return mixed(out)


def ranked(b: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(rank pair of 16 bytes, rank of `width` bytes) at every place of a buffer; places near its end mean nothing."""
    r = b.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes are their own rank
        r[: len(r) - step] |= r[step:] << np.uint64(8 * step)
    r = mixed(r * _C)
    pair = (r >> np.uint64(40)) << np.uint64(24)  # two names of 24 bits: more would only make the sorted rows wider
    pair[: len(r) - 8] |= r[8:] >> np.uint64(40)
    size = 8
    while 2 * size <= width:
        r, size = paired(r, size), 2 * size
    return pair, (paired(r, width - size) if size < width else r)


def anchored(pair: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For every place the anchor of the string that starts there: its 16-byte string with the least hash, leftmost of equals."""
    places = width - GRAM + 1
    m = (mixed(pair ^ _C) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(pair), dtype=np.uint64)
    size = 1
    while 2 * size <= places:
        m[: len(m) - size] = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    if size < places:
        m[: len(m) - places + size] = np.minimum(m[: len(m) - places + size], m[places - size :])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Slice:
    """Segments of some texts end to end: strings by anchor. Arrays a, low, high, seg hold one row for an anchor and the
    first and last place of the strings that it stands for (buffer places), and the segment that they are in."""

    def __init__(self, segments: list[tuple[int, int, bytes]], width: int):
        self.of = np.array([s[0] for s in segments], np.int64)
        sizes = np.array([len(s[2]) for s in segments], np.int64)
        begin = np.cumsum(sizes) - sizes
        self.shift = np.array([s[1] for s in segments], np.int64) - begin
        self.buffer = b"".join(s[2] for s in segments)
        self.width, self.bytes = width, np.frombuffer(self.buffer + bytes(width), np.uint8)
        self.pair = ranked(self.bytes, 8)[0]
        counts = sizes - width + 1
        seg = np.repeat(np.arange(len(segments)), counts)
        at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - begin, counts)
        anchor = anchored(self.pair, width)[at]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1]))))
        last = np.append(new[1:], len(at)) - 1
        self.a, self.low, self.high, self.seg = anchor[new], at[new], at[last], seg[new]
        self.key = self.pair[self.a].view(np.int64)
        self.text = self.of[self.seg]


    @cached_property
    def rank(self) -> np.ndarray:
        """Ranks of `width` bytes; only the last round needs them."""
        return ranked(self.bytes, self.width)[1]


def sliced(texts: list[bytes], width: int) -> Iterator[Slice]:
    """Slices of about `SEGMENT` bytes; texts shorter than `width` have no string and are in none."""
    held, size = [], 0
    for i, x in enumerate(texts):
        for at in range(0, len(x) - width + 1, SEGMENT):
            part = x[at : at + SEGMENT + width - 1]
            if size and size + len(part) > SEGMENT:
                yield Slice(held, width)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield Slice(held, width)


def firsts(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rows of the first place of each key in each text, in order of key, then text."""
    order = np.lexsort((text, key))
    t, k = text[order], key[order]
    return order[np.concatenate((np.ones(min(1, len(t)), bool), (t[1:] != t[:-1]) | (k[1:] != k[:-1])))]


def among(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array `chosen`."""
    if not len(chosen):
        return np.zeros(len(keys), bool)
    return chosen[np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)] == keys


def common_pairs(docs: DataFrame, width: int) -> np.ndarray:
    """Rank pairs that many texts have, sorted; at most `COMMON_SHARE`, because each has that share of all anchors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, keys, counts = 0, [], []
            for s in sliced([x.as_py() for x in batch.column(0)], width):
                one = firsts(s.text, s.key)
                k, n = np.unique(s.key[one], return_counts=True)
                total += len(one)
                keys.append(k[n >= COMMON_HERE])
                counts.append(n[n >= COMMON_HERE])
            keys = pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64())
            counts = pa.array(np.concatenate(counts)) if counts else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array([None], pa.int64()), keys]), pa.concat_arrays([pa.array([total], pa.int64()), counts])], names=["k", "n"]
            )

    found = materialize(docs.select("body").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "anchor-counts")
    total = F.sum(F.when(F.col("k").isNull(), F.col("n"))).alias("total")
    anchors = found.agg(total).first()["total"] or 0
    chosen = found.where(F.col("k").isNotNull() & (F.col("n") >= max(COMMON_ROWS, anchors // COMMON_SHARE))).select("k").toArrow()
    return np.sort(chosen["k"].to_numpy())


def sorted_anchors(docs: DataFrame, common: np.ndarray, width: int) -> DataFrame:
    """(t, n, pairs): for each text the rank pairs of its anchors that another text has too.

    Spark sorts the pairs; those of one text only leave. Common pairs are known and not sorted.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in sliced([x.as_py() for x in batch.column(2)], width):
                one = firsts(s.text, s.key)
                one = np.sort(one[~among(s.key[one], common)])
                i = s.text[one]
                yield pa.RecordBatch.from_arrays([pa.array(s.key[one]), pa.array(t[i]), pa.array(n[i], pa.int32())], names=["k", "t", "n"])

    rows = docs.select("t", "n", "body").mapInArrow(anchors, "k long, t long, n int")
    same = Window.partitionBy("k")
    shared = (F.min("t").over(same) < F.max("t").over(same)) | (F.min("n").over(same) < F.max("n").over(same))
    kept = rows.withColumn("_shared", shared).where("_shared")
    return kept.groupBy("t", "n").agg(F.collect_set("k").alias("pairs"))


def packed(docs: DataFrame) -> DataFrame:
    """(doc, t, n, packed): documents whose text travels compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            small = [codec.compress(x.as_py(), asbytes=True) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(small, pa.binary())], names=["doc", "t", "n", "packed"])

    return docs.select("doc", "t", "n", "body").mapInArrow(pack, "doc long, t long, n int, packed binary")


def unpacked(batch: pa.RecordBatch) -> list[bytes]:
    return [pa.decompress(x.as_py(), decompressed_size=n, codec="zstd", asbytes=True) for x, n in zip(batch.column("packed"), batch.column("n").to_pylist())]


#: A stretch of bytes of a text: n << 32 | its first place, and its further places; without bytes, settled spans.
STRINGS = "deal int, doc long, t long, at long, bytes binary, more array<int>"
SPANS = "t long, n int, spans array<int>"


def joined_spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[low, high) spans, sorted by low, as (start, end, start, end ...) without overlaps."""
    if not len(low):
        return np.zeros(0, np.int64)
    upto = np.maximum.accumulate(high)
    new = np.concatenate(([True], low[1:] > upto[:-1]))
    out = np.empty(2 * int(new.sum()), np.int64)
    out[::2], out[1::2] = low[new], upto[np.append(np.flatnonzero(new)[1:], len(low)) - 1]
    return out


def lists(values: np.ndarray, counts: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Lists of `counts` values each; null where not `valid`."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    mask = None if valid is None else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=mask)


def dealt(name: np.ndarray) -> np.ndarray:
    """32 bits to deal rows by: groups may hold several names, a name is in one group."""
    return (name >> np.uint64(32)).astype(np.uint32).view(np.int32)


def ranges_of(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... `count` numbers each, end to end."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def strings_of(s: Slice, kept: np.ndarray, common: np.ndarray, doc, t, n, width: int) -> Iterator[pa.RecordBatch]:
    """What the anchors `kept` of a slice stand for: one row for each different stretch of bytes of the least document here,
    with its places; stretches that a smaller document of this slice has too are settled, as spans (no bytes)."""
    hot = kept & among(s.key, common)
    cold = kept & ~hot
    count = (s.high - s.low + 1)[hot]
    one = ranges_of(s.low[hot], count)
    low = np.concatenate((s.low[cold], one))
    high = np.concatenate((s.high[cold], one))
    seg = np.concatenate((s.seg[cold], np.repeat(s.seg[hot], count)))
    deal = np.concatenate((s.key[cold].view(np.uint64), s.rank[one]))
    name = mixed(s.rank[low] * _C + mixed(s.rank[high] + (high - low).astype(np.uint64)))
    text = s.of[seg]
    owner = doc[text]
    order = np.lexsort((low, text, owner, name))
    low, high, seg, deal, name, text, owner = (x[order] for x in (low, high, seg, deal, name, text, owner))
    if not len(low):
        return
    new = np.concatenate(([True], name[1:] != name[:-1]))
    least = np.repeat(owner[new], np.diff(np.append(np.flatnonzero(new), len(new))))
    settled = owner > least
    place = low + s.shift[seg]
    # Rows to compare: one for each stretch and text.
    some = np.flatnonzero(~settled)
    first = np.concatenate((np.ones(min(1, len(some)), bool), (name[some][1:] != name[some][:-1]) | (text[some][1:] != text[some][:-1])))
    head = some[first]
    copies = np.diff(np.append(np.flatnonzero(first), len(some)))
    raw = [s.buffer[a : b + width] for a, b in zip(low[head].tolist(), high[head].tolist())]
    names = ["deal", "doc", "t", "at", "bytes", "more"]
    more = lists(place[some][~first], copies - 1, copies > 1)
    at = (n[text[head]].astype(np.int64) << 32) | place[head]
    yield pa.RecordBatch.from_arrays(
        [pa.array(dealt(mixed(deal[head]))), pa.array(owner[head]), pa.array(t[text[head]]), pa.array(at), pa.array(raw, pa.binary()), more], names=names
    )
    done = np.flatnonzero(settled)
    done = done[np.lexsort((place[done], text[done]))]
    edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(done)), bool), text[done][1:] != text[done][:-1])))
    spans = [joined_spans(place[g], (place + high - low)[g] + width) for g in np.split(done, edges[1:])] if len(done) else []
    of = text[done[edges]]
    if len(of):
        yield pa.RecordBatch.from_arrays(
            [pa.array(dealt(t[of].view(np.uint64))), pa.array(doc[of]), pa.array(t[of]), pa.array(n[of].astype(np.int64) << 32),
             pa.array([None] * len(of), pa.binary()), lists(np.concatenate(spans), np.array([len(x) for x in spans]))],
            names=names,
        )


def open_strings(texts: DataFrame, anchors: DataFrame, common: np.ndarray, width: int) -> DataFrame:
    """The strings of the anchors left, with their bytes, and spans settled at once (`STRINGS`)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n, doc = (batch.column(i).to_numpy() for i in range(3))
            pairs = batch.column("pairs")
            for s in sliced(unpacked(batch), width):
                kept = among(s.key, common)
                edges = np.flatnonzero(np.concatenate(([True], s.text[1:] != s.text[:-1], [True])))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    own = pairs[int(s.text[a])]
                    if own.is_valid:
                        kept[a:b] |= among(s.key[a:b], np.sort(own.values.to_numpy()))
                yield from strings_of(s, kept, common, doc, t, n, width)

    rows = texts.join(anchors, ["t", "n"], "left").select("t", "n", "doc", "packed", "pairs")
    return rows.mapInArrow(cut, STRINGS)


def compared(raw: list[bytes], doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string inside the stretches `raw`: the stretch, and whether a smaller document of this group has it."""
    sizes = np.array([len(x) for x in raw], np.int64)
    counts = sizes - width + 1
    at = ranges_of(np.cumsum(sizes) - sizes, counts)
    of = np.repeat(np.arange(len(raw)), counts)
    b = np.frombuffer(b"".join(raw) + bytes(width), np.uint8)
    rank = ranked(b, width)[1][at]
    order = np.argsort(rank)
    new = np.concatenate((np.ones(min(1, len(order)), bool), rank[order][1:] != rank[order][:-1]))
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.flatnonzero(~new)
    eights = np.lib.stride_tricks.as_strided(b, (len(b) - 7, 8), (1, 1))
    for step in (*range(0, width - 8, 8), width - 8):
        if (eights[at[order[again]] + step] != eights[at[head[again]] + step]).any():
            # Equal names of different strings: names are the strings themselves.
            plain = [bytes(b[i : i + width]) for i in at.tolist()]
            rank = np.unique(np.array(plain, f"V{width}"), return_inverse=True)[1]
            order = np.argsort(rank)
            new = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
            break
    least = np.minimum.reduceat(doc[of[order]], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    gone = np.empty(len(order), bool)
    gone[order] = doc[of[order]] > np.repeat(least, np.diff(np.append(np.flatnonzero(new), len(order))))
    return of, gone


def settle(batches: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    """Spans of whole groups of equal `deal`: one row for each place of a stretch with any, and the settled ones."""
    batch = pa.Table.from_batches(batches).combine_chunks()
    doc, t, at = (batch.column(name).to_numpy() for name in ("doc", "t", "at"))
    known = batch.column("bytes").is_null().to_numpy()
    rows = np.flatnonzero(~known)
    of, gone = compared(batch.column("bytes").drop_null().to_pylist(), doc[rows], width)
    hit = np.flatnonzero(gone)
    of, start = of[hit], np.searchsorted(of, np.arange(len(rows)))
    low = hit - start[of]
    new = np.ones(len(hit), bool)
    new[1:] = (of[1:] != of[:-1]) | (low[1:] > low[:-1] + width)
    first = np.flatnonzero(new)
    low, high, of = low[first], low[np.append(first[1:], len(hit))[: len(first)] - 1] + width, of[first]
    # Every place of a stretch has the spans of the stretch.
    further = pc.fill_null(pc.list_value_length(batch.column("more")), 0).to_numpy()
    flat, begin = pc.list_flatten(batch.column("more")).to_numpy(), np.cumsum(further) - further
    spans = np.bincount(of, minlength=len(rows))
    some = np.flatnonzero(spans)
    places = 1 + further[rows[some]]
    row = np.repeat(some, places)
    place = np.empty(len(row), np.int64)
    heads = np.cumsum(places) - places
    place[heads] = at[rows[some]] & 0xFFFFFFFF
    rest = np.ones(len(row), bool)
    rest[heads] = False
    place[rest] = flat[ranges_of(begin[rows[some]], places - 1)]
    each = ranges_of((np.cumsum(spans) - spans)[row], spans[row])
    shift = np.repeat(place, spans[row])
    values = np.stack((low[each] + shift, high[each] + shift), axis=1).ravel()
    done = np.flatnonzero(known)
    values = np.concatenate((values, flat[ranges_of(begin[done], further[done])]))
    whose = np.concatenate((rows[row], done))
    return pa.RecordBatch.from_arrays(
        [pa.array(t[whose], pa.int64()), pa.array(at[whose] >> 32, pa.int32()), lists(values, np.concatenate((2 * spans[row], further[done])))], names=["t", "n", "spans"]
    )


def repeated_spans(strings: DataFrame, width: int) -> DataFrame:
    """(t, n, spans): spans to remove, from strings that Spark has sorted by their deal."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            deal = batch.column(0).to_numpy()
            if not len(deal):
                continue
            if held and held[-1].column(0)[-1].as_py() != deal[0]:
                yield settle(held, width)
                held = []
            cut = int(max(np.flatnonzero(deal[1:] != deal[:-1]) + 1, default=0))
            if cut:
                yield settle([*held, batch.slice(0, cut)], width)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield settle(held, width)

    return strings.repartition("deal").sortWithinPartitions("deal").mapInArrow(groups, SPANS)


def cut_out(texts: DataFrame, spans: DataFrame, width: int, digest: bool) -> DataFrame:
    """(t, n, doc, n_removed, n_spans, kept): each text of its least document without its spans, or its SHA-256."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept = [], [], []
            for body, found in zip(unpacked(batch), batch.column(4).to_pylist()):
                pairs = np.array(found or [], np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                own = joined_spans(pairs[:, 0], pairs[:, 1])
                edges = [0, *own.tolist(), len(body)]
                left = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                removed.append(len(body) - len(left))
                runs.append(len(own) // 2)
                kept.append(hashlib.sha256(left).digest() if digest else left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                names=["t", "n", "doc", "n_removed", "n_spans", "kept"],
            )

    whole = spans.groupBy("t", "n").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rows = texts.join(whole, ["t", "n"], "left").select("t", "n", "doc", "packed", "spans")
    return rows.mapInArrow(cut, "t long, n int, doc long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, digest: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): every document without the bytes that a smaller document has too.

    Null text is empty, a null key is the largest one; rows of equal key don't remove each other's bytes. Repeated rows
    stay, each with the same result; other columns are left out. `kept` are bytes, as a cut may part a character;
    with `digest` their SHA-256 (and what is kept is never moved).
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("id"), body.alias("body")).select(
        "id", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("body").alias("t"),
        F.octet_length("body").alias("n"), "body",
    )
    common = common_pairs(rows, width)
    long = F.col("n") >= width
    texts = packed(rows.where(long)).groupBy("t", "n").agg(F.min("doc").alias("doc"), F.first("packed").alias("packed"))
    anchors = sorted_anchors(rows, common, width)
    spans = repeated_spans(open_strings(texts, anchors, common, width), width)
    found = cut_out(texts, spans, width, digest)
    final = (lambda c: F.unhex(F.sha2(c, 256))) if digest else (lambda c: c)
    short = rows.select("id", "doc", "t", "n", F.when(~long, final(F.col("body"))).alias("body"))
    return short.join(found, ["t", "n", "doc"], "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_bytes"),
        # A long text that isn't its least document's: all of it starts there.
        F.coalesce("n_removed", F.when(long, F.col("n")).otherwise(F.lit(0)).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", long.cast("long")).alias("n_spans"),
        F.coalesce("kept", "body", final(F.lit(b""))).alias("kept"),
    )


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    found = without_repeats(docs, digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


#: The definition itself, for engines with SQL only: every string of 50 bytes as a row.
SQL = """
with texts as (
  select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as d, hex(encode(coalesce(text, ''))) as h from documents
), parts as (
  select r, d, c, substr(h, 2 * c + 1, 1122) as part from texts, unnest(range(0, greatest(length(h) // 2 - 49, 0), 512)) u(c)
), places as (
  select r, d, c + p as p, substr(part, 2 * p + 1, 100) as s from parts, unnest(range(0, least(512, length(part) // 2 - 49))) u(p)
), smallest as (
  select s, min(d) as d from places group by s
), hits as (
  select r, p, lag(p) over (partition by r order by p) as before from places join smallest using (s) where smallest.d < places.d
), runs as (
  select r, p, sum(case when before is null or p > before + 50 then 1 else 0 end) over (partition by r order by p) as g from hits
), spans as (
  select r, g, min(p) as a, max(p) + 50 as b from runs group by r, g
), ends as (
  select r, a, b, lag(b, 1, 0) over (partition by r order by a) as before from spans
), cut as (
  select r, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept
  from ends join texts using (r) group by r
)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from texts left join cut using (r)
"""


def brute_force(docs: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by the definition, for tests."""
    whole = [(NO_ID if d is None else d, (x or "").encode()) for d, x in docs]
    least: dict[bytes, int] = {}
    for d, x in whole:
        for i in range(len(x) - width + 1):
            s = x[i : i + width]
            least[s] = min(least.get(s, NO_ID), d)
    out = []
    for d, x in whole:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - width + 1):
            if least[x[i : i + width]] < d:
                gone[i : i + width] = True
        left = bytes(c for c, g in zip(x, gone) if not g)
        out.append((len(x), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return out
