"""Exact top-k search by inner product with a pivot-distance index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Slack for rounding in distances; scores themselves are whole numbers.
SLACK = 1e-6
#: Scaled components are kept within this number.
LARGEST = 2.0**53
#: Pivots at most: they and their sample are held by the driver.
MOST_PIVOTS = 4096
#: Vectors that a task holds against all pivots, and queries against a block, at a time.
STEP, QUERIES = 2_000, 500


@dataclass(frozen=True)
class Cells:
    """The annuli: cell ``i`` holds ``n[i]`` vectors whose distance to pivot ``pivot[i]`` is ``near[i]`` to ``far[i]``."""

    pivots: np.ndarray
    radius2: float
    cell: np.ndarray
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    n: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product of each query with any vector of each cell, by the triangle inequality."""
        d = _distances(q, np.zeros(len(q)), self.pivots)[:, self.pivot]
        least = np.maximum(np.maximum(d - self.far, self.near - d), 0) * (1 - SLACK)
        q2 = (q * q).sum(1)
        return (q2[:, None] + self.radius2 - least**2) / 2 + SLACK * (1 + q2[:, None] + self.radius2)


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; ``extra`` is the additional last coordinate."""
    v2 = (v * v).sum(1) + extra**2
    p2 = (pivots**2).sum(1)
    d2 = v2[:, None] + p2 - 2 * (v @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1])
    return np.sqrt(np.maximum(d2, 0))


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, v`` with whole components floor(scale * x), kept within ``LARGEST``; rows with a null id or a component that is null or not finite are left out."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(ok)
    whole = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(whole(x)).cast("long")).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    at = column.offsets.to_numpy()
    values, size = column.values.to_numpy()[at[0] : at[-1]].astype(float), np.diff(at)
    if (size == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - (at[:-1] - at[0])[row]] = values
    return out


def _products(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers; those beyond 64 bits are the largest or smallest one."""
    s = q @ v.T
    if exact:  # sums of products are whole numbers that a double holds
        return s.astype(np.int64)
    most = np.iinfo(np.int64).max
    with np.errstate(over="ignore"):
        whole = q.astype(np.int64) @ v.astype(np.int64).T  # right modulo 2**64
    whole = np.where(np.abs(s) < 2.0**62, whole, np.where(s > 0, most, -most))
    for i, j in zip(*np.nonzero((np.abs(s) >= 2.0**62) & (np.abs(s) < 2.0**65))):  # near the limit: digit by digit
        whole[i, j] = max(min(sum(int(x) * int(y) for x, y in zip(q[i], v[j])), most), -most)
    return whole


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the sampled vector farthest from those chosen."""
    chosen = [0]
    d = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, pivots: int | None = None, rings: int = 8, sample_rows: int = 4_000, block_rows: int = 4_000) -> DataFrame:
    """The ``k`` highest inner products of each query with all other rows; ties go to the smaller id.

    Vectors get one more coordinate that gives all of them the same length, so
    that a high inner product is a small distance.  Each is keyed by its
    nearest pivot and its distance to it; ``rings`` distances divide a pivot's
    vectors into annuli.  A query first scores the nearest annuli that hold
    enough rows; its k-th score then rules out every annulus whose bound by the
    triangle inequality is below it, and the others are scored.  Every row is
    indexed and the result is exact; only the pivots and the limits of the
    annuli come from a sample of ``sample_rows`` rows, or 16 for each pivot if
    those are more.  Their number grows with the square root of the rows, up to ``MOST_PIVOTS``.

    Vectors stay in their annulus, dealt out in blocks of about ``block_rows``
    rows; the queries go to the blocks
    that they open.  A task holds the vectors of one block while the queries
    of that block pass by.  Of equal vectors only the rows that can be among
    the best of a query are indexed, so copies cost nothing.

    Returns ``query_id, rank, vec_id, score``; fewer than ``k`` rows if there
    are fewer candidates.  Vectors that are null or hold a null or non-finite
    component take no part, and neither do rows with a null id; rows with the
    query's own id are no candidates; of queries that share an id the least
    vector is taken; repeated rows count each; shorter vectors end in zeros.
    Scaled components beyond ``LARGEST`` count as that, scores beyond 64 bits
    as the largest or smallest one.  Other columns may have any name and are
    not looked at, an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    # of equal vectors the k + 1 smallest ids can be among the best of any query, each k times at most
    alike = Window.partitionBy("v").orderBy("vec_id")
    rows = quantised(vectors, id_col, vec_col, scale).groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    rows = cut(rows.withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= k + 1).select("vec_id", "v", "copies"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, radius2 = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm2), F.lit(0.0))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = pivots or min(MOST_PIVOTS, max(32, round(n**0.5 / 10)))
    sample_rows = max(sample_rows, 16 * pivots)
    share = min(1.0, sample_rows / n)
    # by a hash of the vector too, as many rows may share an id
    drawn = F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(10**9)) < max(int(share * 10**9), 1)
    sample = _matrix(rows.filter(drawn).limit(2 * sample_rows).select("v").toArrow().column(0).combine_chunks(), width)
    if not len(sample):
        sample = _matrix(rows.limit(sample_rows).select("v").toArrow().column(0).combine_chunks(), width)
    longer = np.column_stack([sample, np.sqrt(np.maximum(radius2 - (sample**2).sum(1), 0))])
    chosen = _pivots(longer, pivots)
    d = _distances(sample, longer[:, -1], chosen)
    nearest, least = d.argmin(1), d.min(1)
    limits = [np.unique(np.quantile(least[nearest == p], np.arange(1, rings) / rings)) if (nearest == p).any() else np.zeros(0) for p in range(len(chosen))]
    fitted = spark.sparkContext.broadcast((chosen, limits))

    def index(batches):
        chosen, limits = fitted.value
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                v = _matrix(b.column(1), width)
                d = _distances(v, np.sqrt(np.maximum(radius2 - (v**2).sum(1), 0)), chosen)
                p = d.argmin(1)
                far = d[np.arange(len(p)), p]
                ring = np.array([np.searchsorted(limits[x], y) for x, y in zip(p, far)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p * rings + ring).astype(np.int32)), pa.array(far)], ["vec_id", "v", "copies", "cell", "distance"])

    indexed = cut(rows.mapInArrow(index, "vec_id long, v array<long>, copies int, cell int, distance double"))
    met = sorted(indexed.groupBy("cell").agg(F.count("*"), F.min("distance"), F.max("distance")).collect())  # a row an annulus
    cell, count, near, far = (np.array(c) for c in zip(*met))
    cells = Cells(chosen, float(radius2), cell, cell // rings, near, far, count)
    shared = spark.sparkContext.broadcast(cells)
    queries = cut(quantised(vectors.filter(is_query), id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")))

    def visits(first: bool):
        def run(batches):
            cells = shared.value
            step = max(1, min(STEP, 2_000_000 // len(cells.cell)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    ub = cells.bounds(_matrix(b.column(1), width))
                    order = np.argsort(-ub, axis=1, kind="stable")
                    # the nearest annuli that hold enough rows besides the query's own
                    start = np.cumsum(cells.n[order], axis=1) - cells.n[order] < 4 * k + 1
                    opened = np.zeros_like(start)
                    np.put_along_axis(opened, order, start, 1)
                    least = np.full(b.num_rows, np.nan)  # nan where all are needed
                    if not first:
                        least = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                        opened = ~opened & ~(ub < least[:, None])
                    i, c = np.nonzero(opened)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(cells.cell[c].astype(np.int32)), pa.array(least[i])], ["id", "v", "cell", "least"])

        return run

    parts = {int(c): -(-int(m) // block_rows) for c, m in zip(cell, count)}
    split = F.broadcast(spark.createDataFrame(list(parts.items()), "cell int, parts int"))
    part = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    kept = indexed.join(split, "cell").select("cell", part.alias("part"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", "copies", F.lit(None).cast("double").alias("least"))
    exact = radius2 < 2**52

    def scores(batches):
        """Blocks in order: the vectors of a block, then its queries."""
        now, ids, copies, held = None, [], [], []
        for b in batches:
            c, p, kind, key = (b.column(i).to_numpy() for i in range(4))
            ends = np.flatnonzero((np.diff(c) != 0) | (np.diff(p) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), b.num_rows]):
                if (c[lo], p[lo]) != now:
                    now, ids, copies, held = (c[lo], p[lo]), [], [], []
                if not kind[lo]:
                    ids.append(key[lo:hi])
                    copies.append(b.column(5).slice(lo, hi - lo).to_numpy())
                    held.append(_matrix(b.column(4).slice(lo, hi - lo), width))
                    continue
                if not ids:  # a block that got no vector
                    continue
                ids, copies, held = [np.concatenate(ids)], [np.concatenate(copies)], [np.concatenate(held)]
                for at in range(lo, hi, QUERIES):
                    own = key[at : min(at + QUERIES, hi)]
                    s = _products(_matrix(b.column(4).slice(at, len(own)), width), held[0], exact)
                    least = b.column(6).slice(at, len(own)).to_numpy(zero_copy_only=False).astype(float)
                    found = []
                    for q, row, m in zip(own, s, least):
                        x = _best(row, k + int((ids[0] == q).sum()))
                        x = x[ids[0][x] != q][:k]
                        found.append(x[~(row[x] < m)])
                    row = np.repeat(np.arange(len(own)), [*map(len, found)])
                    to = np.concatenate(found)
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[0][to]), pa.array(s[row, to]), pa.array(copies[0][to])], ["query_id", "vec_id", "score", "copies"])

    def scored(asked: DataFrame) -> DataFrame:
        sent = asked.join(split, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "v", F.lit(0).alias("copies"), "least")
        both = kept.unionByName(sent).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "id")
        return both.mapInArrow(scores, "query_id long, vec_id long, score long, copies int")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a limit by rank, which tasks apply before they hand rows on
    first_k = lambda df: df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    opened = "id long, v array<long>, cell int, least double"
    one = cut(first_k(scored(queries.mapInArrow(visits(True), opened))).drop("rank"))
    kth = one.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    kth = kth.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("score")).cast("double").alias("least"))
    two = scored(queries.join(kth, "vec_id", "left").mapInArrow(visits(False), opened))
    best = first_k(one.unionByName(two)).drop("rank").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return first_k(best).select("query_id", "rank", "vec_id", "score")


def _best(row: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest values, earlier ones first among equals; the smallest 64-bit number is not among them."""
    if len(row) <= 4 * k:
        return np.argsort(-row, kind="stable")[:k]
    kth = np.partition(row, len(row) - k)[len(row) - k]
    at = np.flatnonzero(row >= kth)
    return at[np.argsort(-row[at], kind="stable")][:k]
