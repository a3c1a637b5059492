"""BPE encoding and decoding by content-defined chunk reuse, exact against the tokenizers library.

A text is cut where a rolling hash of its last 16 bytes hits a mask, so equal passages of different
documents give equal chunks wherever they stand. A chunk is encoded once and kept; the chunks of a
document are then joined, and each join is repaired by re-encoding the words around it until the
tokens outside the repaired stretch are those that the chunks already had.

Inside a chunk, and at a join, the unit given to the library is a run between ASCII white space: the
vocabulary's rules drop white space and never look across it (`Encoder` refuses others). Runs of plain Latin
letters and signs go straight to the library's BPE model, word by word; all others take its whole route.

Chunks are shared by the documents of a Python worker, in memory of a fixed size. Sharing them over the
whole cluster would move every document's ids through a shuffle to save re-encoding what a worker has
already seen; a worker that never meets a chunk again pays once more for it, the result is the same.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.texts import Kept, map_texts, runs_of

WINDOW = 16
CHUNK_BITS = 9
MAX_CHUNK = 8_192
RUN_BYTES, WORD_BYTES, CHUNK_BYTES = 100 << 20, 50 << 20, 24 << 20
_LONG_WORD = 256
# Runs whose normal form is their own lower case, and which hold no white space of any kind.
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u017f]+").fullmatch
_GEAR = np.random.default_rng(20_011).integers(1, 1 << 32, 256, dtype=np.uint32)
_MULTIPLIER = 2_654_435_761


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file's text, read on the driver; `path` defaults to the public word BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack_ids(ids: Sequence[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a printable letter: its own, or the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}


_LETTERS = byte_letters()


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, and their decoding."""

    def __init__(self, vocab: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        rules = json.loads(vocab)
        self.tokenizer = Tokenizer.from_str(vocab)
        self.model = self.tokenizer.model
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = "a bc\tde\nf  g"
        apart = [i for w in probe.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        if rules.get("decoder") is not None or self.tokenizer.encode(probe, add_special_tokens=False).ids != apart:
            raise ValueError("white space must separate tokens, and tokens must be decoded with blanks between")
        self.runs, self.pieces, self.chunks = Kept(RUN_BYTES), Kept(WORD_BYTES), Kept(CHUNK_BYTES)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.split, self.special = self._rules(rules)

    def _rules(self, rules: dict):
        """The word pattern, if the file's rules are those of the short route, and the special strings."""
        special = [t["content"] for t in rules["added_tokens"]]
        normal, before = rules["normalizer"]["normalizers"], rules["pre_tokenizer"]["pretokenizers"]
        known = (
            [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["content"] == " "
            and [x["type"] for x in before] == ["Split", "ByteLevel"]
            and before[0]["behavior"] == "Removed" and before[0]["invert"]
            and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
        )
        return regex.compile(before[0]["pattern"]["Regex"]).findall if known else None, special

    def _piece_ids(self, word: str) -> bytes:
        """Ids of one lower-case word of the split pattern."""
        ids = self.pieces.get(word)
        if ids is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            ids = pack_ids([t.id for t in self.model.tokenize(letters)])
            self.pieces.put(word, ids, 150 + len(ids))
        return ids

    def _model_ids(self, run: str) -> bytes | None:
        """Ids of a plain run, word by word through the library's model; None if it isn't plain."""
        if self.split is None or len(run) > _LONG_WORD:
            return None
        low = run.lower()
        if low.isalpha() and (low.isascii() or _PLAIN(low)):
            return self._piece_ids(low)
        if not _PLAIN(run) or ("<|" in run and any(x in run for x in self.special)):
            return None
        return b"".join(map(self._piece_ids, self.split(low)))

    def run_ids(self, runs: Sequence[str]) -> list[bytes]:
        """Ids of each run between white space; the runs should differ."""
        found = list(map(self.runs.new.get, runs))
        if None not in found:
            return found
        rest, short, size = [], {}, 0
        old, model = self.runs.old.get, self._model_ids
        for i, ids in enumerate(found):
            if ids is None:
                run = runs[i]
                ids = found[i] = old(run)
                if ids is None:
                    ids = found[i] = model(run)
                if ids is None:
                    rest.append(i)
                elif len(run) <= _LONG_WORD:
                    short[run] = ids
                    size += len(ids)
        if rest:
            done = self.tokenizer.encode_batch_fast([runs[i] for i in rest], add_special_tokens=False)
            for i, e in zip(rest, done):
                found[i] = pack_ids(e.ids)
        self.runs.put_all(short, size + 160 * len(short))
        return found

    def many(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin and end: the runs of a batch are looked up once."""
        runs, codes, edges = runs_of(texts)
        ids = self.run_ids(runs)
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        of_run = sizes[codes]
        upto = np.concatenate(([0], np.cumsum(of_run)))
        starts = (np.cumsum(sizes) - sizes)[codes]
        at = np.repeat(starts - upto[:-1], of_run)
        at += np.arange(len(at))
        return flat[at], upto[edges]

    def text_ids(self, text: bytes) -> bytes:
        """Ids of one text, without chunks."""
        return self.many([text])[0].tobytes()

    def learn(self, chunks: Sequence[bytes]) -> dict[bytes, tuple]:
        """What `joined` needs of each different chunk: (ids, first run, bytes of its ids, last run, bytes of
        its ids, number of runs). Known chunks are not encoded again."""
        known = {c: got for c in set(chunks) if (got := self.chunks.get(c)) is not None}
        todo = [c for c in dict.fromkeys(chunks) if c not in known]
        ids, upto = self.many(todo)
        for c, x, y in zip(todo, upto.tolist(), upto[1:].tolist()):
            first, last = c.split(None, 1)[:1], c.rsplit(None, 1)[-1:]
            if not first:
                known[c] = (b"", b"", 0, b"", 0, 0)
                continue
            head, tail = first[0], last[0].rstrip()
            whole = ids[x:y].tobytes()
            known[c] = (whole, head, len(self.one(head)), tail, len(self.one(tail)), 1 + (len(head) < len(c.strip())))
        new = {c: known[c] for c in todo}
        self.chunks.put_all(new, sum(map(len, todo)) + 4 * len(ids) + 400 * len(todo))
        return known

    def texts(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each text by its chunks: each different chunk is encoded once."""
        chunks = cut(texts)
        known = self.learn([c for cs in chunks for c in cs])
        return [self.joined(cs, known) for cs in chunks]

    def one(self, run: bytes) -> bytes:
        return self.run_ids([run.decode("utf-8")])[0]

    def joined(self, chunks: Sequence[bytes], known: dict[bytes, tuple]) -> bytes:
        """Ids of the text that the chunks make up, with every join repaired.

        The tokens before the last run of one chunk and after the first run of the next stand: white space
        parts them from the run that goes across, which is encoded anew however many chunks it spans.
        """
        out: list[bytes] = []
        open_run = b""  # the run that the last chunk left open at its end
        for c in chunks:
            ids, first, n_first, last, n_last, runs = known[c]
            if not runs:  # white space only: an open run ends here
                if open_run and c:
                    out.append(self.one(open_run))
                    open_run = b""
                continue
            begins, ends = not c[:1].isspace(), not c[-1:].isspace()
            a = b = 0
            if open_run:
                if begins:  # the run goes across the join: encode it whole, drop what the chunk has of it
                    if runs == 1 and ends:
                        open_run += c
                        continue
                    out.append(self.one(open_run + first))
                    a = n_first
                else:
                    out.append(self.one(open_run))
                open_run = b""
            if ends and (runs > 1 or not a):
                open_run, b = last, n_last
            out.append(ids[a : len(ids) - b] if a or b else ids)
        if open_run:
            out.append(self.one(open_run))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False) without a decoder: tokens with blanks between."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoder: dict[int, Encoder] = {}


def encoder(vocab: str) -> Encoder:
    """The worker's encoder; it outlives a task, so chunks are shared between tasks of a worker."""
    key = hash(vocab)
    if key not in _encoder:
        _encoder.clear()
        _encoder[key] = Encoder(vocab)
    return _encoder[key]


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends, for a run of texts laid end to end: the hash sees WINDOW bytes."""
    h = _GEAR[data]
    step, m = 1, _MULTIPLIER
    while step < WINDOW:
        h[step:] += h[:-step] * np.uint32(m)
        step, m = step * 2, m * m % (1 << 32)
    hit = (h >> np.uint32(32 - CHUNK_BITS)) == 0
    hit[:-1] &= (data[1:] & 0xC0) != 0x80  # never inside a character
    return np.flatnonzero(hit) + 1


def cut(texts: Sequence[bytes]) -> list[list[bytes]]:
    """Content-defined chunks of each text; a stretch without a cut is cut every MAX_CHUNK bytes."""
    ends = np.cumsum([len(t) for t in texts])
    points = cut_points(np.frombuffer(b"".join(texts), np.uint8)) if len(ends) and ends[-1] else np.zeros(0, np.int64)
    upto = np.searchsorted(points, ends).tolist()
    out, a, first = [], 0, 0
    for t, end, last in zip(texts, ends.tolist(), upto):
        # A hit within the first WINDOW bytes would depend on the text before.
        inner = [p - first for p in points[a:last].tolist() if WINDOW <= p - first < len(t)]
        edges = [0]
        for p in [*inner, len(t)]:
            while p - edges[-1] > MAX_CHUNK:
                e = edges[-1] + MAX_CHUNK
                while e < p and t[e] & 0xC0 == 0x80:
                    e += 1
                if e >= p:
                    break
                edges.append(e)
            if p > edges[-1]:
                edges.append(p)
        out.append([t[x:y] for x, y in zip(edges, edges[1:])])
        a, first = last, end
    return out


def encode(df: DataFrame, vocab: str, text: str = "text", carry: Sequence[str] | None = None, decoded: bool = False) -> DataFrame:
    """`df` with `ids` (binary, little-endian unsigned 32-bit) and `n_tokens`; with `decoded`, the decoded text too.

    Null or empty text: no ids, empty decoded text. Long texts are encoded whole. Repeated rows stay. An input
    column with the name of a result is replaced.
    """

    def make():
        enc = encoder(vocab)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            ids = enc.texts(texts)
            out = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            return [*out, pa.array([enc.decode(x) for x in ids], pa.string())] if decoded else out

        return compute

    return map_texts(df, make, "ids binary, n_tokens long" + (", decoded string" if decoded else ""), text, carry)


def bpe_digests(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    return encode(docs, vocab, carry=["doc_id"], decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
