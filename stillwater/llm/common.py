"""Building blocks shared by the operators: lineage cuts, ranks and runs over sorted partitions."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: monotonically_increasing_id() keeps the partition number above these bits.
PARTITION_BITS = 33
#: Rows that a table may have at most to be broadcast whole.
BROADCAST_ROWS = 400_000
#: The same for tables of a few numbers that ``small`` marks: several stand in one query, and the driver takes about 100 bytes a row for each, several times over.
SMALL_ROWS = 50_000
#: Most words of 64 bits that ``only`` broadcasts, 8 MB; a thirty-second to a sixteenth of the bits is set, more only beyond four million identifiers.
FILTER_WORDS = 1 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions for an explicit range or hash repartition."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
    local session without that setting gets a folder of its own.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a cluster has to name it, as a temporary one would be local to a machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
    return where


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def text_key(col: Column) -> Column:
    """crc32 of a value written as text; null counts as the empty string."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def sorted_ranks(df: DataFrame, cls: str, order: list[Column], n: int | None = None, out: str = "rank") -> DataFrame:
    """Number the rows of each class ``cls`` (a null is a class) from 0 in the given order, as column ``out``, which the table must not have.

    Rows are range-partitioned by class and order, so a class of any size is
    spread over as many partitions as it fills.  Each partition needs the
    offset of its first class only, as every later class starts in it; the
    table of offsets has at most one row for each partition and class.
    """
    n = n or parts(df.sparkSession)
    keys = [F.col(cls), *order]
    at, of, part, base = (free_name(df, x) for x in ("_at", "_of", "_part", "_base"))
    rows = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()))
    in_part = F.shiftrightunsigned(at, PARTITION_BITS).cast("int")
    met = rows.groupBy(F.col(cls).alias(of), in_part.alias(part)).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    before = Window.partitionBy(of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    met = met.select(of, part, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias(base))
    on = rows[cls].eqNullSafe(met[of]) & (in_part == met[part])
    return rows.join(F.broadcast(met), on).withColumn(out, F.col(at) + F.col(base)).drop(at, of, part, base)


#: Rows that are taken out of an Arrow batch at a time, so that their values are held twice for these only.
ROWS_AT_ONCE = 2_000


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function that is made once for each task; a worker lets go of what other kinds of tasks kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = begun(make)
        for b in sliced(batches):
            if (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def alone(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that keeps nothing in the worker and lets go of what tasks before it kept there."""

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from begun(lambda: run)(batches)

    return after


_MADE: dict[str, tuple[object, object]] = {}
#: Kinds that the running task has asked for.
_ASKED: set[str] = set()


def begun(make: Callable):
    """What ``make`` gives at the beginning of a task; the worker lets go of the kinds that it doesn't ask for.

    A function of the module, as those made inside another one are sent to the
    workers with copies of the module's variables, where nothing is kept.
    """
    _ASKED.clear()
    out = make()
    release(set(_MADE) - _ASKED)
    return out


def release(kinds: set[str]) -> None:
    """Let go of what earlier tasks of these kinds kept in this worker process, and give free memory back."""
    for kind in kinds:
        _MADE.pop(kind, None)
    if kinds:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def per_worker(kind: str, source: object, make: Callable):
    """What ``make`` gives for ``source``, kept for the later tasks of a worker process; one of each kind, so memory stays bounded."""
    _ASKED.add(kind)
    found = _MADE.get(kind)
    if found is None or not (found[0] is source or (isinstance(source, str) and found[0] == source)):
        found = None
        release(set(_MADE) - _ASKED | {kind})  # before the new one takes its place
        found = _MADE[kind] = (source, make(source))
    return found[1]


def pieces(column: pa.Array) -> list[bytes]:
    """The values of a string or binary array as bytes, null as empty; no copy through str."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def flush_counts(batches: Iterator[dict], limit: int) -> Iterator[list[tuple]]:
    """Add up dictionaries of counts, passing on what has been gathered whenever it exceeds ``limit`` keys."""
    total: dict = {}
    for d in batches:
        for k, v in d.items():
            total[k] = total.get(k, 0) + v
        if len(total) > limit:
            yield list(total.items())
            total = {}
    if total:
        yield list(total.items())


def seen_once(make: Callable[[list[str]], list], limit: int) -> Callable[[list[str]], list]:
    """Keep what ``make`` gives for each string, for at most ``limit`` strings at a time."""
    kept: dict = {}

    def get(words: list[str]) -> list:
        nonlocal kept
        try:
            return [kept[w] for w in words]
        except KeyError:
            if len(kept) > limit:
                kept = {}
            new = [w for w in dict.fromkeys(words) if w not in kept]
            kept.update(zip(new, make(new)))
            return [kept[w] for w in words]

    return get


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: An odd number and its inverse modulo 2**64, for hashes of sequences.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    """The first ``n`` powers modulo 2**64."""
    if base not in known or len(known[base]) < n:
        out = np.full(max(n, 4096), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        if len(out) > 1 << 20:  # one very long text
            return out[:n]
        known[base] = out
    return known[base][:n]


class Sequence:
    """Hashes of the parts of a sequence of 64-bit numbers."""

    def __init__(self, h: np.ndarray) -> None:
        self.n = len(h)
        self.sums = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * powers(BASE, self.n), out=self.sums[1:])
        self.back = powers(INVERSE, self.n + 1)

    def part(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[start + size] - self.sums[start]) * self.back[start] + np.asarray(size).astype(np.uint64))


#: A 64-bit number for each byte; in LOWER the letters A-Z have those of a-z.
EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(text: bytes, table: np.ndarray = EXACT) -> np.ndarray:
    """64-bit hashes of the words of a text, which ASCII white space separates."""
    b = np.frombuffer(text, np.uint8)
    edge = np.zeros(len(b) + 2, np.int8)
    edge[1:-1] = ~_SPACE[b]
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return Sequence(table[b]).part(starts, ends - starts)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k successive words; of the whole sequence if it is shorter; none without words."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[i : len(h) - k + 1 + i]
    return mix(out + np.uint64(k))


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def small(df: DataFrame) -> DataFrame:
    """A table (cut before) marked for broadcast if it has at most ``SMALL_ROWS`` rows of a few numbers; a larger one is met in a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def only(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose identifier is in the column ``wanted`` of ``ids`` (distinct; null counts as a value), and some others.

    At most ``SMALL_ROWS`` identifiers are broadcast, and then there are no others.  Of more, a bit for each by its hash is broadcast, so that
    the rows stay where they are; rows that meet a bit of another identifier pass as well, so who asks has to confirm them.
    """
    ids = cut(ids.select("wanted"))
    n = ids.count()
    if n <= SMALL_ROWS:
        return docs.join(F.broadcast(ids), docs[id_col].cast("long").eqNullSafe(F.col("wanted")), "left_semi")
    words = min(FILTER_WORDS, 1 << (n // 4).bit_length())
    place = lambda c: (F.xxhash64(c).bitwiseAND(words - 1).cast("int"), F.shiftrightunsigned(F.xxhash64(c), 58).cast("int"))
    name = free_name(docs, "_bits")

    def gather(batches):
        out = np.zeros(words, np.int64)
        for b in batches:
            out[b.column(0).to_numpy()] = b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.int64()))], [name])

    word, bit = place(F.col("wanted"))
    bits = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit"))
    word, bit = place(docs[id_col].cast("long"))
    return docs.join(F.broadcast(cut(bits.coalesce(1).mapInArrow(alone(gather), f"{name} array<long>"))), F.getbit(F.get(name, word), bit) == 1, "left_semi")


#: A key is hot if it has more than one in so many of all rows; there are fewer hot keys than that.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, on: list[str], n_col: str, matching: Column | None = None) -> DataFrame:
    """Left join to a table with one row for each key, whatever the share of a key in ``rows``.

    ``n_col`` of ``table`` says how many rows have the key.  Keys with more
    than a thousandth of all rows (so fewer than a thousand keys) are met by a
    broadcast join; for the shuffle that follows, their rows are dealt out by
    row number, and so are those that ``matching`` says no key can fit.  A key
    that the table lacks has to be rare or not ``matching``.
    ``table`` is read several times and should be a checkpoint; its columns
    but ``on`` must not be in ``rows``.
    """
    total = table.agg(F.sum(n_col)).first()[0] or 0
    values = [c for c in table.columns if c not in on and c != n_col]
    mark, deal = free_name(rows, "_hot"), free_name(rows, "_deal")
    of = {c: free_name(rows, f"_hot_of_{c}") for c in values}
    hot = table.filter(F.col(n_col) * HOT_SHARE > total).select(*on, *(F.col(c).alias(of[c]) for c in values), F.lit(True).alias(mark))
    cold = table.filter(F.col(n_col) * HOT_SHARE <= total).select(*on, *values, F.lit(0).cast("long").alias(deal))
    rows = rows.join(F.broadcast(hot), on, "left")
    alone = F.col(mark) if matching is None else F.col(mark) | ~F.coalesce(matching, F.lit(False))
    rows = rows.withColumn(deal, F.when(alone, 1 + F.monotonically_increasing_id()).otherwise(F.lit(0)))
    out = rows.join(cold, [*on, deal], "left")
    return out.withColumns({c: F.coalesce(of[c], c) for c in values}).drop(mark, deal, *of.values())
