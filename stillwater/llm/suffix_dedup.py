"""Removal of repeated passages with a sparse suffix array."""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sequence, alone, cut, free_name, map_arrow, parts, pieces, shingles, word_hashes
from .exact_dedup import sorted_runs

#: Words of the n-grams whose least hash selects a position.
GRAM = 5
WORD = re.compile(rb"[^\x20\x09-\x0D]+").finditer
# kinds of rows that the neighbour comparison gives out
REMOVED, FIRST, ANCHOR = 0, 1, 2


#: Low bits that hold the position where hashes are compared; the rest are the hash.  Longer texts are taken in stretches of so many positions.
PLACE = 24
#: Documents, about, and suffixes that the limits of the sort's partitions are drawn from.
SAMPLE_DOCS, SAMPLE_ROWS = 4_000, 200_000


def select(h: np.ndarray, least: int) -> np.ndarray:
    """For each window of ``least`` words, the position of the least n-gram hash (the first, if equal) among those that begin in its first half (and a little)."""
    reach = least // 2 + 1
    many, step = len(h) - least + 1, (1 << PLACE) - reach
    return np.concatenate([i + _select(h[i : min(i + step, many) + least - 1], least, reach) for i in range(0, many, step)])


def _select(h: np.ndarray, least: int, reach: int) -> np.ndarray:
    g = shingles(h, min(GRAM, (least + 1) // 2))[: len(h) - least + reach]
    low = (g >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(g), dtype=np.uint64)
    size = 1  # low[i] is the least of this many from i
    while 2 * size <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    return (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)


class Words:
    """The words of a text with one space behind each, and where they begin."""

    def __init__(self, text: bytes) -> None:
        words = text.split()
        self.text = b" ".join(words) + b" "
        self.at = np.append(0, np.cumsum([len(w) + 1 for w in words])).tolist()

    def digests(self, start: np.ndarray, end: np.ndarray) -> bytes:
        """16-byte digests of stretches of words, one after the other."""
        text, at, new = self.text, self.at, hashlib.blake2b
        return b"".join([new(text[at[i] : at[j]], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist())])


def binary16(data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(data) // 16, [None, pa.py_buffer(data)]).cast(pa.binary())


def limits(docs: DataFrame, least: int, id_col: str, text_col: str, row: str, n: int) -> list[tuple]:
    """Keys that divide the sorted suffixes into about ``n`` equal partitions, from a bounded sample; they decide on balance only."""
    share = SAMPLE_DOCS / max(docs.count(), 1)
    sample = docs.sample(share, seed=1) if share < 1 else docs
    found = suffixes(sample, least, id_col, text_col, row, []).limit(SAMPLE_ROWS).select("head", "near", "doc", "row", "at").toArrow()
    # sorted as columns in the order of _key, so that the driver's Python holds the limits only
    order, size = pc.sort_indices(found, sort_keys=[(c, "ascending") for c in found.column_names]), found.num_rows
    found = found.take(order.take(pa.array([size * i // n for i in range(1, n)] if size > n else range(size), pa.int64())))
    return list(map(_key, *(found.column(c).to_pylist() for c in found.column_names)))


def _key(head: int, near: bytes, doc: int | None, row: int, at: int) -> tuple:
    return head, near, doc is None, doc or 0, row, at


def suffixes(docs: DataFrame, least: int, id_col: str, text_col: str, row: str, bounds: list[tuple]) -> DataFrame:
    """The retained suffixes: the ``part`` of the sort between ``bounds``, ``head`` (hash of the words that every window through the
    position has from there on), ``near`` (digest of the words around it), identifiers, position and the number of words around it to the left and right."""
    reach = least // 2 + 1
    head = least - reach + 1
    heads = np.array([b[0] for b in bounds], np.int64)

    def part(first: np.ndarray, near: bytes, doc: int | None, row: int, at: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(heads, first, "left"), np.searchsorted(heads, first, "right")
        for i in np.flatnonzero(hi > lo).tolist():  # the head of a bound, so a frequent one
            lo[i] = bisect.bisect_right(bounds, _key(int(first[i]), near[16 * i : 16 * i + 16], doc, row, int(at[i])), lo[i], hi[i])
        return lo.astype(np.int32)

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
            cols: list[list] = [[] for _ in range(8)]
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pieces(b.column(2))):
                h = word_hashes(text)
                if len(h) < least:
                    continue
                at, s = np.unique(select(h, least)), Sequence(h)
                left, right = np.minimum(at, reach - 1), np.minimum(len(h) - at, least)
                first, near = s.part(at, head).astype(np.int64), Words(text).digests(at - left, at + right)
                values = (part(first, near, doc, row, at), first, binary16(near), pa.array([doc] * len(at), pa.int64()), pa.array([row] * len(at), pa.int64()), at.astype(np.int32), left.astype(np.int16), right.astype(np.int16))
                for c, v in zip(cols, values):
                    c.append(v if isinstance(v, pa.Array) else pa.array(v))
            if not cols[0]:
                return None
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], ["part", "head", "near", "doc", "row", "at", "left", "right"])

        return f

    return map_arrow(docs.select(F.col(id_col).cast("long"), row, text_col), make, "part int, head long, near binary, doc long, row long, at int, left short, right short")


def _numpy(x: pa.Array) -> np.ndarray:
    """A column as numbers; 16-byte digests as fixed-width bytes, which compare in one piece."""
    return np.array(x.to_pylist(), "V16") if pa.types.is_binary(x.type) else x.to_numpy(zero_copy_only=False)


def _neighbours(least: int):
    """Compare the neighbours of a sorted partition of suffixes.

    Where the words around a position equal those of the suffix before it,
    the whole stretch occurred earlier.  Where only the head is equal, the
    suffix is given out as an anchor, to be extended word by word.  Heads at
    the edges of the partition may go on next door and count as shared.
    """

    def run(batches):
        cols = [c for c in zip(*([_numpy(x) for x in b.columns[1:]] for b in batches if b.num_rows))]
        if not cols:
            return
        head, near, doc, row, at, left, right = map(np.concatenate, cols)
        n = len(head)
        same_head = np.append(False, head[1:] == head[:-1])
        same_near = same_head & np.append(False, near[1:] == near[:-1])
        long = left.astype(int) + right >= least
        opens = ~same_near
        repeated = opens & np.append(same_near[1:], False)
        group = np.cumsum(~same_head) - 1
        variants = np.bincount(group, opens)
        variants[[0, -1]] = 2  # the groups at the edges
        anchor = opens & (variants[group] > 1)
        start, end = at - left, at + right
        kinds = [(REMOVED, ~opens & long, start, end), (FIRST, repeated & long, start, end), (ANCHOR, anchor, at, at)]
        for kind, which, a, b in kinds:
            i = np.flatnonzero(which)
            for k in range(0, len(i), 100_000):
                j = i[k : k + 100_000]
                ids = pa.array(doc[j], pa.int64(), from_pandas=True) if doc.dtype == np.float64 else pa.array(doc[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), kind, np.int32)), ids.cast(pa.int64()), pa.array(row[j]), pa.array(a[j].astype(np.int32)), pa.array(b[j].astype(np.int32))], ["kind", "doc", "row", "a", "b"])

    return run


def windows(docs: DataFrame, anchors: DataFrame, least: int, id_col: str, text_col: str, row: str) -> DataFrame:
    """Extend anchors left and right: the windows of ``least`` words that have their selected position at an anchor."""
    here = anchors.groupBy("row").agg(F.collect_list("a").alias("at"))  # fewer than the words of the text
    met = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(row).alias("row"), F.col(text_col).alias("text")).join(here, "row").select("doc", "row", "text", "at")

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
            cols: list[list] = [[] for _ in range(4)]
            for doc, row, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pieces(b.column(2)), b.column(3).to_pylist()):
                h = word_hashes(text)
                i = np.flatnonzero(np.isin(select(h, least), np.array(at)))
                raw = binary16(Words(text).digests(i, i + least))
                for c, v in zip(cols, (raw, pa.array([doc] * len(i), pa.int64()), pa.array([row] * len(i), pa.int64()), pa.array(i.astype(np.int64)))):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], ["norm", "doc", "rid", "id"])

        return f

    return map_arrow(met, make, "norm binary, doc long, rid long, id long")


def repeated_spans(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find the stretches of ``least`` or more words that occur more than once, in one text or in several.

    Words are separated by ASCII white space and compare byte by byte.  The
    first occurrence (by identifier, then row, then position) stays; a word
    belongs to a removed span if it lies in a window of ``least`` words that
    occurred earlier.

    Suffixes are retained at positions selected by content: each window keeps
    the position of the least hash among the n-grams of its first half, so
    that equal windows keep equal positions.  They are sorted so that those
    with equal words stand together and compared with their neighbours.
    Stretches whose whole surroundings are equal are found there; the other
    suffixes that share their head with a neighbour are extended left and right
    to the windows through them, which are sorted and compared in turn.  What
    a span rests on are digests (128 bits of BLAKE2b) of the words themselves;
    cheap hashes only choose positions and bring candidates together, so that
    equal ones cost time and nothing else.  Both sorts are range partitioned
    with the row as last key, so that a passage which a third of all texts
    share is spread over many partitions.

    Returns ``doc_id, row, start, end, removed``: word positions, ``end``
    exclusive, disjoint for each ``removed``; rows without a repeat are absent.
    Spans that are not removed consist of repeated windows and hold every first occurrence of one.
    ``row`` is the number of the input row (the order of the input must be
    repeatable, as a table's is).  Null, empty and short texts have no spans, texts of any length
    are taken whole; of repeated rows the later ones are removed whole.
    Extra columns may have any names.
    """
    row = free_name(docs, "_row")
    return _spans(docs.withColumn(row, F.monotonically_increasing_id()), least, id_col, text_col, row)


def _spans(docs: DataFrame, least: int, id_col: str, text_col: str, row: str) -> DataFrame:
    """``repeated_spans`` of rows that are numbered in the column ``row``."""
    n = parts(docs.sparkSession)
    keys = [F.col("head"), F.col("near"), F.col("doc").asc_nulls_last(), F.col("row"), F.col("at")]
    bounds = limits(docs, least, id_col, text_col, row, n)
    rows = suffixes(docs, least, id_col, text_col, row, bounds).repartitionById(n, F.col("part")).sortWithinPartitions(*keys)
    found = cut(rows.mapInArrow(alone(_neighbours(least)), "kind int, doc long, row long, a int, b int"))
    wide = windows(docs, found.filter(F.col("kind") == ANCHOR).select("row", "a"), least, id_col, text_col, row).withColumn("sha", F.lit(""))
    order = [F.col("norm"), F.col("doc").asc_nulls_last(), F.col("rid"), F.col("id")]
    runs = sorted_runs(wide, order).filter(F.col("size") > 1)
    spans = runs.select(F.col("rid").alias("row"), F.col("id").cast("int").alias("a"), (F.col("id") + least).cast("int").alias("b"), (~F.col("first")).alias("removed"))
    spans = spans.unionByName(found.filter(F.col("kind") != ANCHOR).select("row", "a", "b", (F.col("kind") == REMOVED).alias("removed")))
    # no more spans than the text has words
    lists = spans.groupBy("row", "removed").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    merged = lists.mapInArrow(alone(_merge), "row long, removed boolean, start int, end int")
    names = docs.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    return merged.join(names, "row").select("doc_id", "row", "start", "end", "removed")


def _merge(batches):
    for b in batches:
        out: list[list] = [[], [], [], []]
        for row, removed, starts, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            a, z = starts.values.to_numpy(), ends.values.to_numpy()
            order = np.argsort(a, kind="stable")
            a, z = a[order], np.maximum.accumulate(z[order])
            opens = np.flatnonzero(np.append(True, a[1:] > z[:-1]))
            for s, e in zip(a[opens], z[np.append(opens[1:], len(a)) - 1]):
                for c, v in zip(out, (row, removed, int(s), int(e))):
                    c.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int32(), pa.int32()))], ["row", "removed", "start", "end"])


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans and the white space behind them."""
    at = [m.start() for m in WORD(text)]
    at.append(len(text))
    out, last = [], 0
    for a, z in sorted(spans):
        out.append(text[last : at[a]])
        last = at[z]
    return b"".join(out) + text[last:]


def remove_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the later occurrences of repeated stretches out of the texts; texts that have no word left go.

    Other columns, whatever their names, and rows without a repeat stay as they are.  ``removed_words`` is added (one of that name is replaced).
    """
    from pyspark.sql.types import LongType, StructField, StructType

    row = free_name(docs, "_row")
    first, end = free_name(docs, "_from"), free_name(docs, "_to")
    rows = docs.drop("removed_words").withColumn(row, F.monotonically_increasing_id())
    spans = _spans(rows, least, id_col, text_col, row).filter("removed").groupBy(F.col("row").alias(row)).agg(F.collect_list("start").alias(first), F.collect_list("end").alias(end))
    met = rows.join(cut(spans), row, "left").drop(row)
    at = met.columns.index(text_col)
    keep = [i for i, c in enumerate(met.columns) if c not in (first, end)]
    schema = StructType([*(met.schema[met.columns[i]] for i in keep), StructField("removed_words", LongType())])
    a, z = met.columns.index(first), met.columns.index(end)

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, gone = b.column(at).to_pylist(), []
            for i, (s, e) in enumerate(zip(b.column(a).to_pylist(), b.column(z).to_pylist())):
                if s:
                    texts[i] = without(texts[i].encode(), list(zip(s, e))).decode()
                gone.append(sum(e) - sum(s) if s else 0)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in keep]
            return pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.int64())], schema.names)

        return f

    return map_arrow(met, make, schema).filter((F.col("removed_words") == 0) | F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"))
