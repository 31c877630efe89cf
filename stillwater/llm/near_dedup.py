"""Near-duplicate detection with HyperMinHash registers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, alone, cut, digest16, lookup, map_arrow, only, parts, pieces, shingles, sliced, small, word_hashes
from .components import smallest_reachable

#: Buckets (registers) of a signature and registers of a band.
REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
#: A register has two bytes: 0 if its bucket is empty, else 1 + 1024 * leading zeros (up to 62) + 10 bits of mantissa.
MANTISSA, MOST_ZEROS = 10, 62
#: Sets of up to so many shingles are compared by the upper halves of their hashes in crowded groups.
SMALL = 320
#: Registers of the second signature, by which larger sets are compared there; one byte each, with 4 bits of mantissa.
WIDE, WIDE_MANTISSA, WIDE_ZEROS = 512, 4, 14
#: Neighbours in sorted order that a text is compared with first, for each band; larger groups are compared whole afterwards.
NEIGHBOURS = 3
#: Rows of a block of a crowded group; two blocks meet in a task.
BLOCK = 512
#: A candidate goes on if its estimate is within this many standard errors of the threshold.
ERRORS = 5.0


def collision(mantissa: int) -> float:
    """Chance that unequal minima give equal registers: about a third have the same zeros, one in 2**mantissa of these the same mantissa."""
    return 1 / 3 / (1 << mantissa)


def signature(s: np.ndarray, registers: int = REGISTERS, mantissa: int = MANTISSA, most_zeros: int = MOST_ZEROS) -> np.ndarray:
    """The registers of a sorted set of 64-bit hashes: equal stretches of the hashes' range are the buckets, and the
    least hash of a bucket gives leading zeros and mantissa of its distance from the bucket's beginning."""
    width = 2**64 // registers
    lows = np.arange(registers, dtype=np.uint64) * np.uint64(width)
    at = np.searchsorted(s, lows)
    full = np.flatnonzero(np.diff(np.append(at, len(s))))
    x = np.maximum((s[at[full]] - lows[full]).astype(float) / width, 2.0 ** -(most_zeros + 1))
    m, e = np.frexp(np.minimum(x, 1 - 2.0**-53))  # x = m * 2**e, m in [.5, 1)
    out = np.zeros(registers, np.uint16 if mantissa > 4 else np.uint8)
    fine = np.minimum((m - 0.5) * 2 * (1 << mantissa), (1 << mantissa) - 1).astype(int)
    out[full] = 1 + np.minimum(-e, most_zeros) * (1 << mantissa) + fine
    return out


def estimate(a: np.ndarray, b: np.ndarray, mantissa: int = MANTISSA) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of signatures, corrected for collisions, and the numbers of buckets that they rest on."""
    chance = collision(mantissa)
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1) / np.maximum(used, 1)
    return np.clip((same - chance) / (1 - chance), 0, 1), used


def _set(text: bytes, k: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(text, LOWER), k))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, row_col: str | None, k: int) -> DataFrame:
    """``doc_id, row, n, fp, sig``: the size of each shingle set, a 16-byte digest of it and its registers (null without words)."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [_set(t, k) for t in pieces(b.column(2))]
            fps, sigs = zip(*((digest16(s.tobytes()), signature(s).tobytes()) if len(s) else (None, None) for s in sets))
            columns = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "fp", "sig"])

        return f

    return map_arrow(docs.select(F.col(id_col).cast("long"), (F.col(row_col) if row_col else F.lit(0)).cast("long"), text_col), make, "doc_id long, row long, n long, fp binary, sig binary")


def _neighbours(batches):
    """Pairs of neighbours of a sorted partition that share a bucket, and the members of the groups that these do not cover.

    Those are the groups with more than ``NEIGHBOURS`` + 1 rows, and the first
    and the last of the partition, which may go on in the next one.  Only the
    end of the group that a batch breaks off in is held.
    """
    bucket, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    told, first = 0, None  # rows held that are given out as members already; the first bucket

    def out(bucket, a, b):
        absent = np.zeros(len(a), bool)
        return pa.RecordBatch.from_arrays([pa.array(x, mask=absent if x is not None else ~absent) if x is not None else pa.nulls(len(a), pa.int64()) for x in (bucket, a, b)], ["bucket", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        old = len(bucket)
        bucket, c = np.append(bucket, batch.column(0).to_numpy()), np.append(c, batch.column(1).to_numpy())
        first = bucket[0] if first is None else first
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        sizes = np.diff(np.append(starts, len(bucket)))
        crowded = (sizes > NEIGHBOURS + 1) | (bucket[starts] == first)
        member = np.repeat(crowded, sizes)
        member[:told] = False
        yield out(bucket[member], c[member], None)
        for d in range(1, NEIGHBOURS + 1):
            j = np.arange(max(old, d), len(bucket))
            j = j[bucket[j] == bucket[j - d]]
            met = np.unique(np.column_stack([c[j - d], c[j]]), axis=0)
            yield out(None, met[:, 0], met[:, 1])
        keep = min(sizes[-1], NEIGHBOURS + 1)
        bucket, c, told = bucket[-keep:], c[-keep:], keep if crowded[-1] else 0
    if not told and len(bucket):
        yield out(bucket, c, None)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of classes that share a band, and the members ``bucket, c`` of the groups whose pairs are not all among them.

    The rows of the bands hold two numbers: a hash of the band and its
    registers, and the class.  A range partitioning spreads a bucket of any
    size; each row meets the ``NEIGHBOURS`` before it, and groups that this
    does not cover are left to ``crowded_pairs``.  As a register has two
    bytes, unlike texts share a band by chance less than once in 10**12 pairs, so
    buckets do not fill up as the table grows.
    """
    at = F.col("band") * (2 * ROWS) + 1
    bands = classes.select("c", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig").select("c", "band", F.substring("sig", at, F.lit(2 * ROWS)).alias("key"))
    rows = bands.filter(F.col("key") != F.lit(bytearray(2 * ROWS))).select(F.xxhash64("band", "key").alias("bucket"), "c")
    n = 2 * parts(classes.sparkSession)
    rows = rows.repartitionByRange(n, "bucket", "c").sortWithinPartitions("bucket", "c")
    found = cut(rows.mapInArrow(alone(_neighbours), "bucket long, a long, b long").distinct())
    return found.filter(F.col("bucket").isNull()).select("a", "b"), found.filter(F.col("bucket").isNotNull()).select("bucket", F.col("a").alias("c"))


def estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sizes allow a link and whose estimate is within ``ERRORS`` standard errors of the threshold."""
    sides = [classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab"]
    met = small(pairs).join(sides[0], "a").join(sides[1], "b").filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))

    def compare(batches):
        for b in sliced(batches):
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            est, used = estimate(x, y)
            near = est >= threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1)) - collision(MANTISSA)
            yield b.select(["a", "b"]).filter(pa.array(near))

    return met.select("a", "b", "sa", "sb").mapInArrow(alone(compare), "a long, b long")


def sketches(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``c, n, sketch`` of the wanted classes ``c``, from their texts: the upper halves of the hashes of a set of up to
    ``SMALL`` shingles, the wide registers of a larger one."""
    wanted = cut(classes.join(small(wanted), "c", "left_semi").select("c", "n", "fp", F.col("label").alias("wanted")))
    texts = only(docs.select(id_col, text_col), id_col, wanted.select("wanted").distinct())

    def sketch(s: np.ndarray) -> bytes:
        return (_upper(s) if len(s) <= SMALL else signature(s, WIDE, WIDE_MANTISSA, WIDE_ZEROS)).tobytes()

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s for s in (_set(t, k) for t in pieces(b.column(0))) if len(s)]
            return pa.RecordBatch.from_arrays([pa.array([digest16(s.tobytes()) for s in sets], pa.binary()), pa.array(map(sketch, sets), pa.binary())], ["fp", "sketch"])

        return f

    found = map_arrow(texts.select(text_col), make, "fp binary, sketch binary")
    return cut(found.join(small(wanted), "fp").groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))


def _upper(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32)


class _Block:
    """Rows of a block of a crowded group: classes, components, sizes and what their sets can be compared by."""

    def __init__(self, t: pa.Table) -> None:
        self.c, self.comp, self.n = (t.column(name).to_numpy() for name in ("c", "comp", "n"))
        raw = t.column("sketch").to_pylist()
        self.small = np.array([len(r) == 4 * n for r, n in zip(raw, self.n.tolist())])  # a whole set
        self.sets = [np.frombuffer(r, np.uint32) if few else None for r, few in zip(raw, self.small)]
        as_wide = lambda s: signature(s.astype(np.uint64) << np.uint64(32), WIDE, WIDE_MANTISSA, WIDE_ZEROS)
        self.raw, self.as_wide, self._wide = raw, as_wide, None
        owners = np.flatnonzero(self.small)
        flat = np.concatenate([np.zeros(0, np.uint32), *(self.sets[i] for i in owners)])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(owners, self.n[owners])[order]

    @property
    def wide(self) -> np.ndarray:
        """The wide registers of all rows; the upper halves of the hashes of a small set give the same as the hashes."""
        if self._wide is None:
            self._wide = np.array([np.frombuffer(r, np.uint8) if s is None else self.as_wide(s) for r, s in zip(self.raw, self.sets)]).reshape(-1, WIDE)
        return self._wide

    def shared(self, s: np.ndarray) -> np.ndarray:
        """How many of the hashes each row has; equal upper halves may only add to it."""
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        size = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=len(self.c))


def _block_pairs(threshold: float):
    """Compare the rows of two blocks of a group: those of different components, by what they share.

    For small sets no link is missed, as the count of shared hashes is never
    too low.  For larger ones an estimate by the wide registers goes on if it
    is within ``ERRORS`` standard errors of the threshold; its error is that of
    drawing the used buckets from the union without putting back, and of
    registers that are equal by chance; the correction for these is taken back
    where unequal words mostly meet empty registers.
    """
    chance = collision(WIDE_MANTISSA)

    def compare(x: _Block, y: _Block, same_block: bool):
        for i in range(len(x.c)):
            ok = (y.comp != x.comp[i]) & (np.minimum(x.n[i], y.n) >= threshold * np.maximum(x.n[i], y.n))
            if same_block:
                ok[: i + 1] = False
            exact = ok & y.small & x.small[i]
            found = [np.zeros(0, np.int64)]
            if exact.any():
                both = y.shared(x.sets[i])
                found.append(np.flatnonzero(exact & (both * (1 + threshold) >= threshold * (x.n[i] + y.n) - 1e-9)))
            j = np.flatnonzero(ok & ~exact)
            if len(j):
                est, used = estimate(np.broadcast_to(x.wide[i], (len(j), WIDE)), y.wide[j], WIDE_MANTISSA)
                union = (x.n[i] + y.n[j]) / (1 + threshold)
                drawn = threshold * (1 - threshold) * np.clip((union - used) / np.maximum(union - 1, 1), 0, 1)
                found.append(j[est >= threshold - ERRORS * np.sqrt((drawn + (1 - threshold) * chance) / used) - (1 - threshold) * chance])
            j = np.concatenate(found)
            yield np.minimum(x.c[i], y.c[j]), np.maximum(x.c[i], y.c[j])

    def meet(t: pa.Table) -> pa.RecordBatch:
        block, first, second = t.column("block").to_numpy(), t.column("x")[0].as_py(), t.column("y")[0].as_py()
        x, y = (_Block(t.filter(pa.array(block == k))) for k in (first, second))
        none = np.zeros(0, np.int64)
        a, b = zip((none, none), *compare(x, y, first == second))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            key = np.column_stack([t.column(name).to_numpy() for name in ("bucket", "x", "y")])
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
            for s, e in zip(starts, starts[1:]):
                yield meet(t.slice(s, e - s))
            held = t.slice(starts[-1])
        if held is not None:
            yield meet(held)

    return run


def crowded_pairs(docs: DataFrame, classes: DataFrame, members: DataFrame, labels: DataFrame, threshold: float, id_col: str, text_col: str, k: int) -> DataFrame:
    """Pairs ``a, b`` that may be linked in the crowded groups, between the components ``labels`` found so far.

    What is in one component already needs no further link, so a group with one
    component is done.  In the others, the rows outside the largest component
    are dealt to the first blocks, of about ``BLOCK`` rows; each of these meets every block
    once (a group of one block only itself), so a task holds two blocks whatever the size of a group, and a large
    family with few strangers costs a few passes over it.
    """
    rows = cut(members.join(labels.select(F.col("v").alias("c"), F.col("label").alias("comp")), "c"))
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.sum("m").alias("all"), F.count("*").alias("comps"), F.max(F.struct("m", "comp")).alias("top"))
    sizes = cut(sizes.filter("comps > 1").select("bucket", "all", F.col("top.m").alias("most"), F.col("top.comp").alias("largest")))
    rows = rows.join(small(sizes), "bucket")
    drawn = sketches(docs, classes, cut(rows.select("c").distinct()), id_col, text_col, k)
    one = F.col("all") <= BLOCK  # a group that fits into a block needs no second one
    inside = ~one & (F.col("comp") == F.col("largest"))
    outer, inner = F.when(one, F.lit(1).cast("long")).otherwise(F.ceil((F.col("all") - F.col("most")) / BLOCK)), F.when(one, F.lit(0).cast("long")).otherwise(F.ceil(F.col("most") / BLOCK))
    dealt = F.xxhash64("c")
    block = F.when(inside, outer + F.pmod(dealt, inner)).otherwise(F.pmod(dealt, outer))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, outer).otherwise(outer + inner) - 1))
    rows = rows.select("bucket", "c", "comp", block.alias("block"), other.alias("other"))
    rows = rows.select("bucket", "c", "comp", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    rows = rows.join(drawn, "c")
    keys = ["bucket", "x", "y"]
    rows = rows.repartition(2 * parts(classes.sparkSession), *keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(alone(_block_pairs(threshold)), "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Keep the pairs with ``100 * intersection >= percent * union`` on their full shingle sets.

    Only the texts that are in a pair are read again, found by the identifier
    of their class and confirmed by digest; each set is kept once and meets
    the pairs in two joins.
    """
    ends = cut(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct())
    wanted = cut(classes.join(small(ends), "c", "left_semi").select("c", "fp", F.col("label").alias("wanted")))

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [_set(t, k).tobytes() for t in pieces(b.column(0))]
            return pa.RecordBatch.from_arrays([pa.array([digest16(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["fp", "members"])

        return f

    texts = only(docs.select(id_col, text_col), id_col, wanted.select("wanted").distinct())
    members = map_arrow(texts.select(text_col), make, "fp binary, members binary").join(small(wanted.select("fp", "c")), "fp")
    members = cut(members.groupBy("c").agg(F.first("members").alias("members")))
    met = small(pairs).join(members.select(F.col("c").alias("a"), F.col("members").alias("sa")), "a").join(members.select(F.col("c").alias("b"), F.col("members").alias("sb")), "b")

    def compare(batches):
        for b in sliced(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            t = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(b.column(0), t), pc.filter(b.column(1), t)], ["a", "b"])

    return met.select("a", "b", "sa", "sb").mapInArrow(alone(compare), "a long, b long")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``v, label`` after more links: the components are the vertices now, so the rounds run over the new links only."""
    first = small(links).join(labels.select(F.col("v").alias("a"), F.col("label").alias("x")), "a").select("x", "b")
    edges = small(cut(first)).join(labels.select(F.col("v").alias("b"), F.col("label").alias("y")), "b")
    edges = cut(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    ends = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).distinct()
    moved = smallest_reachable(ends.select("v", F.col("v").alias("label")), edges).filter("label < v").select(F.col("v").alias("label"), F.col("label").alias("first"))
    return labels.join(small(cut(moved)), "label", "left").select("v", F.coalesce("first", "label").alias("label"))


def near_dedup(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Link texts whose sets of word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are separated by ASCII white space, A-Z lower-cased; a text with
    fewer than ``words`` words has its whole sequence as its one shingle.
    Documents with equal sets form a class first (so copies never pair up).
    Classes that share a band of registers are compared by neighbours first:
    the corrected estimate of the registers chooses the pairs whose full sets
    are compared.  What is left between the components found so is then
    compared whole, in blocks, and confirmed in the same way.  The smallest
    identifier of a component names it.

    Returns ``doc_id, row, n_shingles, component_id, kept``, one row for each
    input row; ``row`` is carried from ``row_col`` (else 0) and other columns
    are not looked at.  A text without words (null, empty or blank) has an
    empty set and is linked with nothing.  A text of any length counts whole.
    Null identifiers never name a component that has another identifier; rows
    that repeat an identifier are judged by their texts.  An empty table gives
    an empty result.
    """
    found = cut(fingerprints(docs, id_col, text_col, row_col, words))
    classes = found.filter(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("label"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n", "sig")))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))
    close, members = candidates(classes)
    pairs = cut(estimated(close, classes, percent / 100))
    links = cut(verified(docs, pairs, classes, id_col, text_col, words, percent))
    labels = cut(smallest_reachable(classes.select(F.col("c").alias("v"), F.col("c").alias("label")), links))
    more = cut(crowded_pairs(docs, classes, members, labels, percent / 100, id_col, text_col, words).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        late = cut(verified(docs, more, classes, id_col, text_col, words, percent))
        labels = cut(joined(labels, late))
    # the name of a component of several classes; a third of all classes may be in one
    named = classes.select("fp", "label", "rows", F.col("c").alias("v")).join(labels.withColumnRenamed("label", "comp"), "v")
    grown = cut(named.groupBy("comp").agg(F.min("label").alias("least"), F.count("*").alias("of")).filter("of > 1"))
    table = cut(lookup(named, grown, ["comp"], "of").select("fp", "rows", F.coalesce("least", "label").alias("component")))
    # a text without words gets a key of its own
    alone = F.concat(F.lit(b"\0"), F.monotonically_increasing_id().cast("string").cast("binary"))
    rows = found.select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("fp", alone).alias("fp"))
    out = lookup(rows, table, ["fp"], "rows").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "row", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
