"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import cut, flush_counts, map_arrow, parts, per_worker, sliced

#: The white space marker.
MARK = "▁"
#: The table that all tasks share has at most so many chunks, of at most so many UTF-8 bytes each; so its broadcast is bounded.
TABLE_ROWS, TABLE_BYTES = 200_000, 48
#: Distinct chunks that a task gathers before it hands on their counts, and chunks outside of the table that a worker keeps.
GATHERED, KEPT = 300_000, 150_000
#: Characters of texts that are taken apart at a time, or one longer text.
AT_ONCE = 1_000_000
#: Classes of counts to each doubling, for the choice of the table.
STEPS = 8

_RUNS = re.compile(" +[^ ]*").findall


def chunks(text: str) -> list[str]:
    """The marked words of a text, each without its first marker.

    A chunk is a run of markers with what follows up to the next marker.  No
    piece of the vocabulary has a marker behind another symbol (``Pieces``
    checks it), so none reaches from one chunk into the next.  The text gets
    one marker in front, as the library adds it; an empty text has no chunk.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [c[1:] for c in _RUNS(" " + text)]


class Pieces:
    """Chunks to ids and back for a model file."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces reach across a marker: {crossing[:3]}")
        self.lone = self.model.piece_to_id(MARK)

    def ids(self, words: list[str]) -> list[list[int]]:
        """The ids of chunks; the one of a marker alone, which ends a text, is its piece."""
        return [found if c else [self.lone] for c, found in zip(words, self.model.encode(words, num_threads=1))]

    def segment(self, words: list[str]) -> list[tuple[str, str]]:
        """The ids of chunks as decimals with commas, and what they decode to."""
        ids = self.ids(words)
        return [(",".join(map(str, i)), d) for i, d in zip(ids, self.model.decode(ids))] if words else []


class Joiner:
    """Texts to ids by a shared table of chunks; each chunk outside of it is segmented when it is first met."""

    def __init__(self, model: bytes, table: dict[str, tuple[str, str]]) -> None:
        self.pieces, self.table, self.kept = Pieces(model), table, {}

    def texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """The ids with commas and the decoded text of each text, joined by position; a bounded stretch of texts is taken apart at a time."""
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size > AT_ONCE:
                yield from self._joined(part)
                part, size = [], 0
        yield from self._joined(part)

    def _joined(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        split = [chunks(t) for t in texts]
        if len(self.kept) > KEPT:
            self.kept = {}
        table, kept = self.table, self.kept
        new = list({c for s in split for c in s if c not in table and c not in kept})
        kept.update(zip(new, self.pieces.segment(new)))
        for s in split:
            found = [table.get(c) or kept[c] for c in s]
            # a marker stands in front of each chunk; that of the text is taken off
            yield ",".join([x[0] for x in found]), " ".join([x[1] for x in found])


def chunk_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each chunk occurs in all texts: ``chunk, n``; added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts() -> Iterator[dict[str, int]]:
            for b in sliced(batches):
                total: dict[str, int] = {}
                for t in b.column(0).to_pylist():
                    for c in chunks(t or ""):
                        total[c] = total.get(c, 0) + 1
                yield total

        for rows in flush_counts(counts(), GATHERED):
            words, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["chunk", "n"])

    return docs.select(text_col).mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, model: bytes, text_col: str = "text", rows: int = TABLE_ROWS) -> dict[str, tuple[str, str]]:
    """The most frequent chunks of all texts, each segmented once: chunk to ids with commas and decoded text.

    At most ``rows`` chunks of at most ``TABLE_BYTES`` bytes: those above the
    smallest class of counts (``STEPS`` to a doubling) that they fit in.
    """
    spec = docs.sparkSession.sparkContext.broadcast(model)
    counted = chunk_counts(docs, text_col).filter((F.octet_length("chunk") <= TABLE_BYTES) & (F.col("n") > 1))
    counted = cut(counted.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")))
    least, held = None, 0
    for step, n in sorted(counted.groupBy("step").count().collect(), reverse=True):  # some hundred classes at any size
        if held + n > rows:
            break
        least, held = step, held + n
    if least is None:
        return {}

    def make():
        segment = per_worker("pieces", spec.value, Pieces).segment

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, decoded = zip(*segment(b.column(0).to_pylist()))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["chunk", "ids", "decoded"])

        return f

    table = map_arrow(counted.filter(F.col("step") >= least).select("chunk").coalesce(parts(docs.sparkSession)), make, "chunk string, ids string, decoded string")
    return {r[0]: (r[1], r[2]) for r in table.toLocalIterator()}


def encode_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", rows: int = TABLE_ROWS) -> DataFrame:
    """Encode and decode every whole text; returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The most frequent chunks of all texts are segmented once and shared with
    all tasks; any other chunk is segmented once by a worker (as long as it
    remembers it), with the same result.  Null and empty text give no ids; a
    text of any length is encoded whole.  Repeated rows, equal texts and null
    identifiers give a row each, an empty table none; other columns are not
    looked at.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model, chunk_table(docs, model, text_col, rows)))

    def make():
        joiner = per_worker("joiner", shared.value, lambda x: Joiner(*x))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [(i.count(",") + 1 if i else 0, sha(i), sha(d)) for i, d in joiner.texts([t or "" for t in b.column(1).to_pylist()])]
            n, i, d = zip(*found)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return f

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: bytes, text_col: str = "text", out_col: str = "ids", rows: int = TABLE_ROWS) -> DataFrame:
    """Add the ids of ``text_col`` as ``out_col`` (a column of that name is replaced); null text gives an empty list."""
    shared = docs.sparkSession.sparkContext.broadcast((model, chunk_table(docs, model, text_col, rows)))
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)

    def make():
        joiner = per_worker("joiner", shared.value, lambda x: Joiner(*x))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [[*map(int, i.split(","))] if i else [] for i, _ in joiner.texts([t or "" for t in b.column(at).to_pylist()])]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, out_col])

        return f

    return map_arrow(docs, make, StructType([*docs.schema, StructField(out_col, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded text of ``ids_col`` as ``out_col`` (a column of that name is replaced); null ids give an empty text."""
    spec = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop(out_col)
    at = rows.columns.index(ids_col)

    def make():
        pieces = per_worker("pieces", spec.value, Pieces).model
        return lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces.decode([i or [] for i in b.column(at).to_pylist()]), pa.string())], [*b.schema.names, out_col])

    return map_arrow(rows, make, StructType([*rows.schema, StructField(out_col, StringType())]))
