"""Exact deduplication by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, cut, parts

#: White space that counts as one space: U+0020 and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Bytes of text in the keys that the splitters are sampled from.
PREFIX = 24


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Find the runs of equal texts in a sorted partition by comparing each text with the one before it.

    Only row numbers, identifiers and one digest a run are held; the texts pass
    by in batches.  The first and the last run may go on in the partitions
    next to this one, so their text is given out once as ``edge``.
    """
    ids: list[pa.Array] = []
    shas: list[str] = []
    starts: list[int] = []
    rids: list[pa.Array] = []
    total, first, last = 0, None, None
    for b in batches:
        if not b.num_rows:
            continue
        text, sha = b.column("norm"), b.column("sha")
        same = pc.equal(text.slice(1), text.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        heads = [] if total and text[0].as_py() == last else [0]
        heads += [int(i) + 1 for i in (~same).nonzero()[0]]
        starts += [total + i for i in heads]
        shas += [sha[i].as_py() for i in heads]
        if not total:
            first = text[0].as_py()
        last = text[b.num_rows - 1].as_py()
        ids.append(b.column("id"))
        rids.append(b.column("rid"))
        total += b.num_rows
    if not total:
        return
    part = _partition()
    all_ids, all_rids = pa.chunked_array(ids).combine_chunks(), pa.chunked_array(rids).combine_chunks()
    ends = [*starts[1:], total]
    step = 100_000
    out: dict[str, list] = {k: [] for k in ("keep", "size", "sha", "run", "n_in", "edge")}
    rows = 0
    for r, (a, z, sha) in enumerate(zip(starts, ends, shas)):
        keep = all_ids[a].as_py()  # nulls are sorted last
        edge = first if r == 0 else last if r == len(starts) - 1 else None
        for at in range(a, z, step):
            n = min(z, at + step) - at
            out["keep"] += [keep] * n
            out["size"] += [z - a] * n
            out["sha"] += [sha] * n
            out["run"] += [r if edge is not None else -1] * n
            out["n_in"] += range(at - a, at - a + n)
            out["edge"] += [edge if at == a else None] + [None] * (n - 1)
            if len(out["run"]) >= step:
                yield _batch(out, all_ids, all_rids, part, rows)
                rows += len(out["run"])
                out = {k: [] for k in out}
    if out["run"]:
        yield _batch(out, all_ids, all_rids, part, rows)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _batch(out: dict[str, list], ids: pa.Array, rids: pa.Array, part: int, at: int) -> pa.RecordBatch:
    n = len(out["run"])
    return pa.RecordBatch.from_arrays(
        [ids.slice(at, n), rids.slice(at, n), pa.array(out["keep"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array([part] * n, pa.int32()), pa.array(out["run"], pa.int32()), pa.array(out["n_in"], pa.int64()), pa.array(out["edge"], pa.binary())],
        ["id", "rid", "keep", "size", "sha", "part", "run", "n_in", "edge"],
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Group the rows whose normalised texts are equal; the row with the smallest identifier stays.

    Normalised bytes are range-partitioned at sampled splitters and sorted, so
    that equal texts stand next to each other, and neighbours are compared in
    full.  The sort key is a prefix of the text, then its SHA-256, then the
    identifier: the order is one of normalised texts, the sampled keys are
    short, and a text that a third of all rows hold is spread over partitions.
    Runs that touch the edge of a partition (two at most in each) are joined
    by their text.

    Returns ``id, rid, keep_id, group_size, kept, text_sha256``; one row for
    each input row.  ``row_col`` may name a column of row numbers to carry as
    ``rid`` (else 0).  Null text counts as empty.  A null identifier is larger
    than any other; of rows with the same text and identifier one stays.  An
    empty table gives an empty result; other columns are not looked at.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    rid = F.col(row_col) if row_col else F.lit(0)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), rid.cast("long").alias("rid"), norm.cast("binary").alias("norm"))
    rows = rows.withColumns({"sha": F.sha2("norm", 256), "pre": F.substring("norm", 1, PREFIX)})
    out = sorted_runs(rows, [F.col("pre"), F.col("sha"), F.col("id").asc_nulls_last(), F.col("rid")])
    return out.select("id", "rid", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("first").alias("kept"), F.col("sha").alias("text_sha256"))


def sorted_runs(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Range-sort rows ``id, rid, norm, sha`` by keys that put equal ``norm`` next to each other, and find the runs.

    Returns ``id, rid, sha``, the ``size`` of the row's run, the ``id`` that opens it as ``keep`` and whether the
    row is that ``first`` one.
    """
    rows = rows.repartitionByRange(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys).select("id", "rid", "norm", "sha")
    found = cut(rows.mapInArrow(alone(_runs), "id long, rid long, keep long, size long, sha string, part int, run int, n_in long, edge binary"))

    # At most two rows for each partition.
    edges = found.filter(F.col("edge").isNotNull()).select("part", "run", "edge", "keep", "size")
    same = Window.partitionBy("edge")
    in_order = same.orderBy("part", "run")
    edges = edges.select(F.col("part").alias("_part"), F.col("run").alias("_run"), F.first("keep").over(in_order).alias("_keep"), F.sum("size").over(same).alias("_size"), (F.row_number().over(in_order) == 1).alias("_opens"))
    out = found.join(F.broadcast(edges), (found.part == edges["_part"]) & (found.run == edges["_run"]), "left")
    opens = (F.col("n_in") == 0) & F.coalesce("_opens", F.lit(True))
    # a run that goes on from an earlier partition is named there, be it by null
    return out.select("id", "rid", "sha", F.coalesce("_size", "size").alias("size"), F.when(F.col("_opens").isNotNull(), F.col("_keep")).otherwise(F.col("keep")).alias("keep"), opens.alias("first"))
