"""Ranked lexical search of many items at once, by sums of terms that items share."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces, sliced

#: Items that are evaluated together have so many distinct terms at most (one item alone may have more); further ones make further passes.
BLOCK_TERMS, BLOCK_ITEMS = 100_000, 4_000
#: Accumulators (nodes times documents) that a task holds at a time, and the least documents of a step.
HELD, LEAST_DOCS = 1 << 22, 16
#: Shared nodes of an item that are paired with each other when shared sets are mined, in order of how many items have them.
PAIRED = 150
#: Groups of tasks whose best rows are ranked together first.
GROUPS = 64

#: Bytes of a term stay, A-Z lower-cased; all other ones become a space. Bytes above 0x7F belong to characters of terms.
_TERM = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_TERM).split()


class Sharing:
    """A DAG of sums for sets of terms: nodes below ``leaves`` are terms, each later one is the sum of two earlier ones, and every set is a sum of nodes.

    ``sums[i]`` are the two parts of node ``leaves + i``; ``sets[k]`` are the
    nodes of set k, each term in exactly one of them.

    Shared sets of terms are mined greedily: the pair of nodes that most sets
    have becomes a node that stands for both in all of them, and may become
    part of a larger pair, until no pair is in two sets.
    """

    def __init__(self, sets: list[list[int]], leaves: int) -> None:
        self.leaves, self.sums = leaves, []
        now = [set(s) for s in sets]
        has: dict[int, set[int]] = defaultdict(set)
        for k, s in enumerate(now):
            for x in s:
                has[x].add(k)
        pairs: Counter[tuple[int, int]] = Counter()
        for s in now:
            shared = sorted((x for x in s if len(has[x]) > 1), key=lambda x: (-len(has[x]), x))[:PAIRED]
            pairs.update((min(x, y), max(x, y)) for i, x in enumerate(shared) for y in shared[:i])
        heap = [(-n, x, y) for (x, y), n in pairs.items() if n > 1]
        heapq.heapify(heap)
        while heap:
            n, x, y = heapq.heappop(heap)
            both = has[x] & has[y]
            if len(both) < 2:
                continue
            if len(both) < -n:  # an earlier node has taken some of them
                heapq.heappush(heap, (-len(both), x, y))
                continue
            node = leaves + len(self.sums)
            self.sums.append((x, y))
            has[x], has[y], has[node] = has[x] - both, has[y] - both, both
            near: Counter[int] = Counter()
            for k in both:
                now[k] -= {x, y}
                near.update(z for z in now[k] if len(has[z]) > 1)
                now[k].add(node)
            for z, n in near.items():
                if n > 1:
                    heapq.heappush(heap, (-n, z, node))
        self.sets = [sorted(s) for s in now]

    def evaluate(self, leaf: dict[int, np.ndarray], n: int) -> np.ndarray:
        """The sums of all sets over ``n`` documents; ``leaf`` has the accumulators of the terms that occur.

        Every node's accumulator is made once; nodes without a term that occurs have none.
        """
        made: dict[int, np.ndarray] = dict(leaf)
        for node, (x, y) in enumerate(self.sums, self.leaves):
            a, b = made.get(x), made.get(y)
            if a is not None and b is not None:
                made[node] = a + b
            elif a is not None or b is not None:
                made[node] = a if b is None else b
        out = np.zeros((len(self.sets), n), np.int64)
        for row, s in zip(out, self.sets):
            for x in s:
                if (a := made.get(x)) is not None:
                    row += a
        return out


def postings(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tf`` for each text with a term: its length in terms, and the numbers and frequencies of those that are asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        width = max(1, len(shared.value))
        for b in sliced(batches):
            n, found, owner = [], [], []
            for i, text in enumerate(pieces(b.column(1))):
                words = terms(text)
                n.append(len(words))
                hits = [k for k in map(get, words) if k is not None]
                found += hits
                owner.append(len(hits))
            key = np.repeat(np.arange(len(n)), owner) * width + np.asarray(found, np.int64)
            key, tf = np.unique(key, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(n) + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, x) for x in ((key % width).astype(np.int32), tf)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(np.asarray(n) > 0))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


class Best:
    """The ``k`` highest scores of each set so far; equal ones by document, null last."""

    def __init__(self, sets: int, k: int) -> None:
        self.k, self.least = k, np.ones(sets, np.int64)
        self.scores: list[list[np.ndarray]] = [[] for _ in range(sets)]
        self.docs: list[list[np.ndarray]] = [[] for _ in range(sets)]
        self.size = np.zeros(sets, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        good = scores >= self.least[:, None]
        for s in np.flatnonzero(good.any(axis=1)).tolist():
            at = np.flatnonzero(good[s])
            self.scores[s].append(scores[s, at])
            self.docs[s].append(docs[at])
            self.size[s] += len(at)
            if self.size[s] > 8 * self.k:
                self.prune(s)

    def prune(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.size[s]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores, docs = np.concatenate(self.scores[s]), np.concatenate(self.docs[s])
        first = np.lexsort((docs, -scores))[: self.k]
        scores, docs = scores[first], docs[first]
        self.scores[s], self.docs[s], self.size[s] = [scores], [docs], len(first)
        if len(first) == self.k:
            self.least[s] = scores[-1]
        return scores, docs


#: Stands for a null identifier; sorts behind all others.
_NO_ID = np.iinfo(np.int64).max


def _best_rows(posted: DataFrame, sharing: Sharing, weight: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """The rows of each task that may be among the ``k`` best of a set: ``item, doc_id, score``."""
    shared = posted.sparkSession.sparkContext.broadcast((sharing, weight))
    step = max(LEAST_DOCS, HELD // (sharing.leaves + len(sharing.sums) + len(sharing.sets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, w = shared.value
        best = Best(len(dag.sets), k)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                docs = b.column(0).fill_null(_NO_ID).to_numpy()
                ends, flat, tf = b.column(2).offsets.to_numpy(), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
                m = 50 + (50 * b.column(1).to_numpy() * total) // length
                doc = np.repeat(np.arange(b.num_rows), np.diff(ends))
                present, row = np.unique(flat, return_inverse=True)
                table = np.zeros((len(present), b.num_rows), np.int64)
                table[row, doc] = w[flat] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                best.add(dag.evaluate(dict(zip(present.tolist(), table)), b.num_rows), docs)
        for s in range(len(dag.sets)):
            scores, docs = best.prune(s)
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), s, np.int32)), pa.array(docs, mask=docs == _NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return posted.mapInArrow(run, "item int, doc_id long, score long")


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[list[int]], dict[bytes, int]]]:
    """Items in blocks of bounded terms: their identifiers, their terms by number, and the numbers."""
    ids, sets, number = [], [], {}
    for r in items.select(id_col, text_col).toLocalIterator():
        found = set(terms((r[1] or "").encode()))
        if ids and (len(ids) >= BLOCK_ITEMS or len(number) + len(found - number.keys()) > BLOCK_TERMS):
            yield ids, sets, number
            ids, sets, number = [], [], {}
        ids.append(r[0])
        sets.append([number.setdefault(t, len(number)) for t in sorted(found)])
    if ids:
        yield ids, sets, number


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` documents of highest score for each item: ``item_id, rank, doc_id, score``.

    A document's score sums, over the distinct terms of the item that it
    holds, an integer weight of the term times its saturated frequency (see
    ``weights`` and ``_best_rows``).  Only scores above 0 count; equal ones
    rank by document, a null identifier last.

    Items are taken in blocks, each with one pass over the texts that gives a
    narrow table of the postings asked for.  The terms that items of a block
    share are mined on the driver (``Sharing``; a block is bounded); every
    step of a task makes each shared sum for its documents once and adds the
    sums up for the items.  A task hands on its ``k`` best rows an item.

    Null and empty texts have no terms: such documents take no part, such
    items have no rows.  Very long texts are taken whole; repeated rows count
    each, as documents and as items; other columns are not looked at.
    """
    spark, out = docs.sparkSession, None
    schema = items.select(F.lit(0).alias("item"), F.col(item_col).alias("item_id")).schema
    for ids, sets, number in _blocks(items, item_col, text_col):
        posted = cut(postings(docs, number, doc_col, text_col))
        total, length = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = dict(posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a count a term of the block
        weight = weights(total, np.array([held.get(t, 0) for t in range(len(number))], np.int64))
        rows = _best_rows(posted, Sharing(sets, len(number)), weight, total, max(1, length), k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        group = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
        some = rows.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("rank") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), schema)
        found = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long")
    return out


def weights(total: int, held: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) for each term, N documents having a term and df holding it."""
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
