"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import MARKS, NOT_SPACE, PLAIN, Encoder
from .common import alone, cut, map_arrow, per_worker

#: Chunks of the newest generation whose ids a worker remembers; the one before is kept too.
REMEMBERED = 200_000


def chunk_encoder(tokenizer_json: str, limit: int = REMEMBERED):
    """A function from a text to its ids as little-endian bytes.

    No token of this kind of vocabulary reaches across white space, so a text
    is encoded chunk by chunk and the ids of frequent chunks are remembered;
    the words of the others are spelled by the tokenizers library.
    """
    encoder = Encoder(tokenizer_json, library=True)
    spell, symbols = encoder.spell, encoder.symbols
    packers = [struct.Struct(f"<{n}I").pack for n in range(64)]
    kept: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        return packers[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def make(chunk: str) -> bytes:
        nonlocal older
        found = older.get(chunk)
        if found is None:
            if chunk.isalpha() and PLAIN(chunk):  # one word
                word = chunk.lower()
                found = packed(spell(word if word.isascii() else word.translate(symbols)))
            elif chunk[-1] in MARKS and (word := chunk[:-1]).isalpha() and PLAIN(word):  # a word and a mark
                return (kept.get(word) or make(word)) + (kept.get(chunk[-1]) or make(chunk[-1]))
            else:
                found = packed(encoder.ids(chunk))
        if len(kept) > limit:
            older = kept.copy()
            kept.clear()
        kept[chunk] = found
        return found

    def encode(text: str) -> bytes:
        if any(c in text for c in NOT_SPACE):
            ids = encoder.ids(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        get = kept.get
        return b"".join([get(c) or make(c) for c in text.split()])

    return encode


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise each document, add id 0 and cut what is longer than ``capacity``.

    Returns ``doc_id, piece, start, length, ids_crc32``.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def make():
        encode = per_worker("packing", vocabulary.value, chunk_encoder)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = memoryview(encode(text or "") + b"\0\0\0\0")
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    for c, v in zip(cols, (doc, k, at, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return f

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def bands(counts: dict[int, int], capacity: int, rows: int) -> list[tuple[int, int]]:
    """Ranges (above, up to) of lengths, the longest first: each takes in ``rows`` pieces, or lengths down to two thirds if those hold more."""
    out, top, held = [], capacity, 0
    for length in range(capacity, 0, -1):
        n = counts.get(length, 0)
        if held and held + n > rows and 3 * length <= 2 * top:
            out.append((length, top))
            top, held = length, 0
        held += n
    return [*out, (0, top)]


#: If fewer than one in so many of the pieces left find a gap elsewhere, the others open sequences.
FEW = 10
#: Kinds of rows of a sweep: a piece with its place, a piece without one, a gap.
PLACED, LEFT, GAP = range(3)


def best_fit(size: np.ndarray, piece: np.ndarray, of: np.ndarray, capacity: int, fresh: int | None) -> tuple[list, list, list]:
    """Sweep over sizes in descending order: each piece takes the smallest gap that holds it, and the gap left over comes back at its own size.

    ``fresh`` numbers the sequences that pieces without a gap open; None
    leaves them.  Returns placed (piece, sequence, offset), left (piece,
    length), gaps (sequence, free), the last ones in ascending order.
    """
    held: list[tuple[int, int]] = []  # gaps that hold the piece in turn, smallest first
    later: list[tuple[int, int]] = []  # gaps that smaller pieces fit in, largest first
    placed, left = [], []
    for n, is_piece, i in zip(size.tolist(), piece.tolist(), of.tolist()):
        if not is_piece:
            heapq.heappush(held, (n, i))
            continue
        while later and -later[0][0] >= n:
            free, s = heapq.heappop(later)
            heapq.heappush(held, (-free, s))
        if held:
            free, s = heapq.heappop(held)
        elif fresh is not None:
            free, s, fresh = capacity, fresh, fresh + 1
        else:
            left.append((i, n))
            continue
        placed.append((i, s, capacity - free))
        if free > n:
            heapq.heappush(later, (n - free, s))
    return placed, left, sorted([(f, s) for f, s in held] + [(-f, s) for f, s in later])


_RANKS = pa.schema({"k": pa.int32(), "p": pa.int32(), "lo": pa.int64(), "hi": pa.int64(), "first": pa.int64()})
_SWEPT = "kind int, part int, place long, id long, size long, sequence long, at long"


def swept(rows: DataFrame, n: int, capacity: int, step: int, may_open: bool) -> DataFrame:
    """Range-sort pieces and gaps (``size, piece, id``) into ``n`` partitions and sweep over each.

    Gives rows of ``PLACED`` (id, sequence, at), ``LEFT`` (id, size) and
    ``GAP`` (sequence, size), the last two with their ``place`` among those of
    the partition; a gap that not every piece of the later partitions fits in has no place.
    """
    order = [F.desc("size"), F.asc("piece"), F.asc("id")]
    dealt = (rows.repartition(1) if n == 1 else rows.repartitionByRange(n, *order)).sortWithinPartitions(*order)

    def run(batches):
        part = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        size, piece, of = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(3))
        placed, left, gaps = best_fit(size, piece, of, capacity, (step << 48) + (part << 28) if may_open else None)
        none = lambda k: [None] * k
        fit = [g for g in gaps if g[0] >= size[-1]]
        short = gaps[: len(gaps) - len(fit)]
        tables = (
            (PLACED, none(len(placed)), [p[0] for p in placed], none(len(placed)), [p[1] for p in placed], [p[2] for p in placed]),
            (LEFT, range(len(left)), [p[0] for p in left], [p[1] for p in left], none(len(left)), none(len(left))),
            (GAP, [*none(len(short)), *range(len(fit))], none(len(gaps)), [g[0] for g in gaps], [g[1] for g in gaps], none(len(gaps))),
        )
        for kind, *columns in tables:
            if m := len(columns[1]):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), pa.array([part] * m, pa.int32()), *(pa.array(list(c), pa.int64()) for c in columns)], ["kind", "part", "place", "id", "size", "sequence", "at"])

    return cut(dealt.select("size", "piece", "id").mapInArrow(alone(run), _SWEPT))


def across(counts: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple], int]:
    """Match what partitions have left, by rank: pieces take the gaps of the nearest partition of larger sizes.

    ``counts`` has (partition, pieces left, gaps that fit) in order of falling
    size.  Returns intervals (partition, from place, to place, first match) of pieces and of gaps, and the matches.
    """
    open_: list[list[int]] = []  # partition, next place, end
    pieces, gaps, met = [], [], 0
    for part, left, fit in counts:
        at = 0
        while at < left and open_:
            q, lo, hi = open_[-1]
            n = min(left - at, hi - lo)
            pieces.append((part, at, at + n, met))
            gaps.append((q, lo, lo + n, met))
            at, met = at + n, met + n
            open_[-1][1] += n
            if lo + n == hi:
                open_.pop()
        if fit:
            open_.append([part, 0, fit])
    return pieces, gaps, met


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", rows_a_task: int = 64_000) -> DataFrame:
    """Assign ``sequence_id`` and ``offset`` to pieces of length 1 to ``capacity`` by bulk-synchronous best fit.

    Lengths are taken in bands from the longest to the shortest.  In a step,
    the pieces of the band and the gaps that some of them fit in are
    range-sorted by size into partitions of about ``rows_a_task`` rows; every
    partition sweeps over its sizes and gives each piece the smallest gap that
    holds it, again and again.  What partitions have left is matched by rank
    (a piece takes a gap of the nearest partition of larger sizes), the gaps
    are updated and the step repeats, until few pieces find one; those open
    new sequences.  The driver holds a count for each length and, in a step,
    two counts for each partition.

    Of equally long pieces the order is that of their rows.  Repeated rows are
    packed each; an empty table gives an empty result.  All columns stay,
    whatever their names, but for ``sequence_id`` and ``offset``, which are replaced.
    """
    spark = pieces.sparkSession
    # the caller's columns by number, so that no name of theirs meets one of ours
    own = [F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(pieces.columns)]
    rows = cut(pieces.select(*own).withColumn("id", F.monotonically_increasing_id()))
    sizes = rows.select(F.col(f"own{pieces.columns.index(length_col)}").cast("long").alias("size"), F.lit(1).alias("piece"), "id")
    counts = {r[0]: r[1] for r in sizes.groupBy("size").count().collect()}  # as many as lengths
    least, step = min(counts, default=0), 0
    # made in the JVM, as lists of Python objects start workers of another kind
    placed = spark.range(0).select("id", F.col("id").alias("sequence_id"), F.col("id").alias("offset"))
    gaps = spark.range(0).select(F.col("id").alias("size"), F.lit(0).alias("piece"), "id")
    in_place = lambda out: out.filter(F.col("kind") == PLACED).select("id", F.col("sequence").alias("sequence_id"), F.col("at").alias("offset"))
    as_gaps = lambda out: out.filter((F.col("kind") == GAP) & (F.col("size") >= least)).select("size", F.lit(0).alias("piece"), F.col("sequence").alias("id"))
    for above, top in bands(counts, capacity, rows_a_task):
        left, n_left = sizes.filter((F.col("size") > above) & (F.col("size") <= top)), sum(n for x, n in counts.items() if above < x <= top)
        waiting, gaps = gaps.filter(F.col("size") <= above), gaps.filter(F.col("size") > above)
        while n_left:
            step += 1
            n = -(-(n_left + gaps.count()) // rows_a_task)
            out = swept(left.unionByName(gaps), n, capacity, step, may_open=n == 1)
            placed, gaps = placed.unionByName(in_place(out)), as_gaps(out)
            if n == 1:
                break
            left_in = F.count_if(F.col("kind") == LEFT)
            counted = out.filter(F.col("kind") != PLACED).groupBy("part").agg(left_in.alias("n"), F.count_if((F.col("kind") == GAP) & F.col("place").isNotNull()).alias("fit"))
            met = sorted(tuple(r) for r in counted.collect())
            of_pieces, of_gaps, matches = across(met)
            before, n_left = sum(x[1] for x in met), sum(x[1] for x in met) - matches
            ranks = [(LEFT, *x) for x in of_pieces] + [(GAP, *x) for x in of_gaps]  # a few a partition
            ranks = F.broadcast(spark.createDataFrame(pa.Table.from_pylist([dict(zip(_RANKS.names, x)) for x in ranks], _RANKS)))
            tagged = out.join(ranks, (F.col("kind") == F.col("k")) & (F.col("part") == F.col("p")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")), "left")
            match, free = (F.col("first") + F.col("place") - F.col("lo")).alias("match"), tagged.filter(F.col("kind") == GAP).filter("first is not null")
            pairs = tagged.filter(F.col("kind") == LEFT).filter("first is not null").select(match, "id", "size").join(free.select(match, F.col("size").alias("free"), "sequence"), "match")
            pairs = cut(pairs.select("id", "size", "free", "sequence"))
            placed = placed.unionByName(pairs.select("id", F.col("sequence").alias("sequence_id"), (capacity - F.col("free")).alias("offset")))
            alone = tagged.filter("first is null")
            left = alone.filter(F.col("kind") == LEFT).select("size", F.lit(1).alias("piece"), "id")
            smaller = pairs.select((F.col("free") - F.col("size")).alias("size"), F.lit(0).alias("piece"), F.col("sequence").alias("id")).filter(F.col("size") >= least)
            gaps = as_gaps(alone).unionByName(smaller)
            if matches * FEW < before and n_left:
                step += 1
                out = swept(left, -(-n_left // rows_a_task), capacity, step, may_open=True)
                placed, gaps = placed.unionByName(in_place(out)), gaps.unionByName(as_gaps(out))
                break
        gaps = waiting.unionByName(gaps)
    out = rows.join(placed, "id")
    return out.select(*(F.col(f"own{i}").alias(c) for i, c in enumerate(pieces.columns) if c not in ("sequence_id", "offset")), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack documents; null text counts as empty and gives the closing id alone.

    Texts of any length are encoded whole and cut into pieces of ``capacity``;
    repeated rows and null identifiers count each, an empty table gives an
    empty result, other columns are not looked at.
    """
    return pack(token_pieces(docs, tokenizer_json, capacity, id_col, text_col), capacity)
