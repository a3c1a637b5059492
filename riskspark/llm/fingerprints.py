"""Homomorphic multiset fingerprints of documents, by DataFrame functions alone.

A paragraph (line) has a wide vector: four 32-bit lanes hashed from the paragraph, and LANES small lanes that
count the hash bits of its word runs, cut by content every few words. A document's vector is the sum over its paragraphs, 32-bit lanes modulo
2^32 and small ones modulo 2^16: the order of paragraphs doesn't matter, and a paragraph is inserted or deleted
by adding or subtracting its vector. Equal multisets have equal fingerprints. The small lanes, read as sums of
random signs, estimate how far two multisets are apart, so two fingerprints tell their likeness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFTS, HASHES = 31, 2
LANES = 2 * SHIFTS * HASHES
WIDE = 4
CELLS, RANGE_ROWS = 1 << 14, 2_000
#: A word of a script with blanks (long ones in parts, a capital begins a new one), a number, or any other character
#: alone, each with the signs behind it.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"(?:\p{{Lu}}?[\p{{L}}\p{{M}}&&[^\p{{Lu}}{_ALONE}]]{{1,24}}|\p{{N}}{{1,8}}|\S)[^\p{{L}}\p{{M}}\p{{N}}\s]{{0,8}}"
#: One word in CUT ends a run, by its hash; a run has at most RUN words.
CUT, RUN = 3, 6
_LOW32, _LOW16, _PAIR = 0xFFFFFFFF, 0xFFFF, 1 | 1 << 31


def run_hashes(paragraph: Column) -> Column:
    """A hash of every word run of a paragraph, in order, each with the word before it; one of no words if it has none."""
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  evaluated once, not once an element
    upto = lambda at, i, words: F.coalesce(F.get(at, i + 1), F.size(words))

    def ends(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.when(F.pmod(F.xxhash64(F.lit(99), w), F.lit(CUT)) == 0, i + 1))
        return F.concat(F.array(F.lit(0)), F.filter(marked, lambda e: e < F.size(words)))

    def starts(words: Column) -> Column:
        return let(ends(words), lambda at: F.flatten(F.transform(at, lambda a, i: F.sequence(a, F.greatest(a, upto(at, i, words) - 1), F.lit(RUN)))))

    def hashes(words: Column) -> Column:
        return let(starts(words), lambda at: F.transform(at, lambda a, i: F.xxhash64(F.lit(100), F.slice(words, F.greatest(a, F.lit(1)), upto(at, i, words) - F.greatest(a - 1, F.lit(0))))))

    return let(F.regexp_extract_all(paragraph, F.lit(WORD), F.lit(0)), hashes)


def lane_sums(units: DataFrame, by: list[str], text: str) -> DataFrame:
    """One row per `by` with `wide` (32-bit lanes), `lanes` (small lanes) and `clauses` (word runs), summed over paragraphs.

    Sums are partial first, so rows of a long text leave a task as one. No lane can overflow: a text has fewer
    than 2^31 runs.
    """
    paragraphs = units.select(*by, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_p"))
    paragraphs = paragraphs.select(*by, *[F.xxhash64(F.lit(k), F.col("_p")).alias(f"_x{k}") for k in range(WIDE // 2)], run_hashes(F.col("_p")).alias("_runs"))
    clauses = paragraphs.select("*", F.posexplode_outer("_runs").alias("_i", "_c")).select(
        *by,
        *[F.when(F.col("_i") == 0, F.col(f"_x{k}")).otherwise(F.lit(0).cast("long")).alias(f"_w{k}") for k in range(WIDE // 2)],
        *[F.xxhash64(F.lit(100 + k), F.col("_c")).alias(f"_h{k}") for k in range(HASHES)],
    )
    wide = [x for k in range(WIDE // 2) for x in (F.col(f"_w{k}").bitwiseAND(_LOW32), F.shiftrightunsigned(f"_w{k}", 32))]
    bits = [F.shiftrightunsigned(f"_h{k}", s).bitwiseAND(_PAIR) for k in range(HASHES) for s in range(SHIFTS)]
    found = clauses.groupBy(*by).agg(
        F.count("*").alias("clauses"),
        *[F.sum(x).alias(f"_sw{i}") for i, x in enumerate(wide)], *[F.sum(x).alias(f"_sb{i}") for i, x in enumerate(bits)],
    )
    lanes = [x for i in range(len(bits)) for x in (F.col(f"_sb{i}").bitwiseAND((1 << 31) - 1), F.shiftrightunsigned(f"_sb{i}", 31))]
    return found.select(
        *by, "clauses", F.array(*[F.col(f"_sw{i}").bitwiseAND(_LOW32) for i in range(WIDE)]).alias("wide"), F.array(*lanes).alias("lanes")
    )


def fingerprint(wide: str, lanes: str) -> Column:
    """Hexadecimal digits of all lanes, small ones modulo 2^16, four lanes a word."""
    word = lambda xs: reduce(lambda a, b: a.bitwiseOR(b), xs)
    low = [F.get(lanes, F.lit(i)).bitwiseAND(_LOW16) for i in range(LANES)]
    words = [word([F.shiftleft(x, 16 * k) for k, x in enumerate(low[i : i + 4])]) for i in range(0, LANES, 4)]
    heads = [F.lpad(F.hex(F.get(wide, F.lit(i))), 8, "0") for i in range(WIDE)]
    return F.lower(F.concat(*heads, *[F.lpad(F.hex(w), 16, "0") for w in words]))


def _size(lanes: Column, count: Column) -> Column:
    """Estimated squared size of a multiset from its lanes: the mean square of their sums of signs."""
    sign = lambda a: 2 * a - count
    return F.aggregate(lanes, F.lit(0.0), lambda s, a: s + (sign(a) * sign(a)).cast("double")) / LANES


def likeness(a: str, n_a: str, b: str, n_b: str) -> Column:
    """0 to 1: the share of two multisets that they have in common, from their lanes; 1 if all lanes agree."""
    gap = _size(F.zip_with(a, b, lambda x, y: x - y), F.col(n_a) - F.col(n_b))
    whole = _size(F.col(a), F.col(n_a)) + _size(F.col(b), F.col(n_b))
    return F.when((F.col(a) == F.col(b)) & (F.col(n_a) == F.col(n_b)), 1.0).when(whole <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / whole))


def ranged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with their range of ascending keys `_range`; each range also holds, as `_guard`, the first rows of the next.

    The last range's guard is the first row of all. Cells of equal key width are counted and merged to ranges
    of about RANGE_ROWS rows; the driver sees CELLS counts. A null key comes first.
    """
    lo, hi = docs.agg(F.min(key), F.max(key)).first()
    lo, hi = (lo or 0) - 1, hi or 0
    at = F.coalesce(F.col(key), F.lit(lo))
    cell = F.least(F.floor((at - lo).cast("double") * (CELLS / (hi - lo + 1.0))), F.lit(CELLS - 1)).cast("int")
    counts = docs.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(at).alias("first")).orderBy("c").collect()
    of_cell, firsts, filled = [0] * CELLS, [], 0
    for r in counts:
        if not firsts or filled >= RANGE_ROWS:
            firsts.append(r["first"])
            filled = 0
        filled += r["n"]
        of_cell[r["c"]] = len(firsts) - 1
    n = max(1, len(firsts))
    placed = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text), F.get(F.lit(of_cell), cell).alias("_r"), at.alias("_at"))
    is_first = F.col("_at") == F.get(F.lit(firsts or [0]), F.col("_r"))
    own = F.struct(F.col("_r").alias("_range"), F.lit(0).alias("_guard"))
    guard = F.struct(F.pmod(F.col("_r") - 1, F.lit(n)).alias("_range"), F.lit(1).alias("_guard"))
    return placed.select(key, text, F.inline(F.when(is_first, F.array(own, guard)).otherwise(F.array(own))))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_range, _guard, _row, key, text, edited): the last quarter replaced by the start of the next document.

    Next is by ascending key, equal keys by text; after the last comes the first. The text is shuffled once.
    """
    order = Window.partitionBy("_range").orderBy("_guard", F.asc_nulls_first(key), text)
    rows = ranged(docs, key, text).withColumns({"_row": F.row_number().over(order), "_next": F.lead(text).over(order)})
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col(text), F.lit(1), n - quarter), F.substring(F.coalesce("_next", F.col(text)), F.lit(1), quarter))
    return rows.select("_range", "_guard", "_row", key, text, edited.alias("edited"))


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is empty; an empty one has a fingerprint of its own (one empty paragraph). Repeated rows are
    documents of their own. One document is its own next. Other columns are left out.
    """
    by = ["_range", "_row", "_guard", key, "n_chars", "edited_sha256"]
    rows = edited_pairs(docs, key, text).withColumns({"n_chars": F.char_length(text).cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)})
    both = rows.select(*by, F.inline(F.array(
        F.struct(F.lit(0).alias("_which"), F.col(text).alias("_t")), F.struct(F.lit(1).alias("_which"), F.col("edited").alias("_t"))
    )))
    sums = lane_sums(both, [*by, "_which"], "_t")
    pick = lambda which, c: F.max(F.when(F.col("_which") == which, F.struct("clauses", "wide", "lanes"))).alias(c)
    whole = sums.groupBy(*by).agg(pick(0, "o"), pick(1, "e"))
    order = Window.partitionBy("_range").orderBy("_row")
    flat = whole.withColumn("x", F.coalesce(F.lead("o").over(order), F.col("o"))).where("_guard = 0").select(
        key, "n_chars", "edited_sha256",
        *[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in "oex" for f in ("clauses", "wide", "lanes")],
    )
    return flat.select(
        key, "n_chars", "edited_sha256", fingerprint("o_wide", "o_lanes").alias("fingerprint"), fingerprint("e_wide", "e_lanes").alias("edited_fingerprint"),
        likeness("o_lanes", "o_clauses", "e_lanes", "e_clauses").alias("near_edited"),
        likeness("o_lanes", "o_clauses", "x_lanes", "x_clauses").alias("near_next"),
    )
