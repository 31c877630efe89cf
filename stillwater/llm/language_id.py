"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, cut, flush_counts, map_arrow, per_worker, sorted_ranks, text_key

UNKNOWN = "und"
#: Lengths of the n-grams that an unseen word falls back to, in this order.
ORDERS = (5, 4, 3, 2, 1)
#: Marks at the end of a chunk that are no part of its words.
MARKS = ",.;:!?"
#: Length of the n-grams by which a text counts as explained, and the share from which one is usual in a language.
EXPLAINED_BY, USUAL = 3, 1e-5
WORDS = re.compile(r"[^\W\d_]+").findall


def grams(word: str, n: int) -> list[str]:
    """The character n-grams of a word with its ends marked; single characters are unmarked."""
    s = word if n == 1 else f"<{word}>"
    return [s[i : i + n] for i in range(len(s) - n + 1)]


@dataclass(frozen=True)
class Model:
    """Log frequencies by language: row ``index[n][key]`` of ``table``; keys are words (n 0) and n-grams.

    ``usual`` says by row and language whether the key has at least
    ``USUAL`` of the language's keys of its length.
    """

    langs: list[str]
    prior: np.ndarray
    index: dict[int, dict[str, int]]
    table: np.ndarray
    usual: np.ndarray


def drawn(docs: DataFrame, text_col: str, lang_col: str, key_col: str, max_rows: int) -> DataFrame:
    """The labelled rows, or about ``max_rows`` of them, as many of each language as it has, up to an equal share.

    Rows are drawn by a hash of ``key_col`` and text, so rows that share a key are drawn apart.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = dict(rows.groupBy(lang_col).count().collect())  # a row a language
    if sum(n.values()) <= max_rows:
        return rows
    most, left = 0.0, max_rows
    for i, m in enumerate(sorted(n.values())):  # what small languages leave goes to the larger ones
        most = max(most, left / (len(n) - i))
        left -= min(m, left / (len(n) - i))
    share = F.lit(1_000_000)
    for lang, m in n.items():
        if m > most:
            share = F.when(F.col(lang_col) == lang, int(most / m * 1_000_000)).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.col(key_col), F.col(text_col), F.lit(7)), F.lit(1_000_000)) < share)


def train(docs: DataFrame, text_col: str, lang_col: str, key_col: str, max_rows: int = 20_000, words: int = 15_000, per_order: int = 3_000) -> Model:
    """Fit on labelled rows; at most about ``max_rows`` of them (see ``drawn``).

    The whole texts of the drawn rows count.  The model keeps every word that
    is among the ``words`` most frequent ones of some language, and every
    n-gram that is among the ``per_order`` most frequent ones of its length.
    """
    rows = drawn(docs, text_col, lang_col, key_col, max_rows)

    def as_batches(counters):
        for items in flush_counts(counters, 400_000):
            lang, order, key, n = zip(*((*k, n) for k, n in items))
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(order, pa.int32()), pa.array(key), pa.array(n, pa.int64())], ["lang", "order", "key", "n"])

    def count_words(batches):
        def each():
            for b in batches:
                by_lang: dict[str, Counter] = {}
                for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    by_lang.setdefault(lang, Counter()).update(WORDS(text.lower()))
                yield {(lang, 0, w): n for lang, found in by_lang.items() for w, n in found.items()}

        return as_batches(each())

    def count_grams(batches):
        def each():
            for b in batches:
                c: dict = {}
                for lang, w, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    for k in ORDERS:
                        for g in grams(w, k):
                            key = (lang, k, g)
                            c[key] = c.get(key, 0) + n
                yield c

        return as_batches(each())

    def added_up(rows: DataFrame, count) -> DataFrame:
        return cut(rows.mapInArrow(alone(count), "lang string, order int, key string, n long").groupBy("lang", "order", "key").agg(F.sum("n").alias("n")))

    # each distinct word is taken apart once
    found_words = added_up(rows.select(text_col, lang_col), count_words)
    counts = found_words.unionByName(added_up(found_words, count_grams))
    totals = counts.groupBy("lang", "order").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    langs = sorted({r["lang"] for r in totals})
    if not langs:
        return Model([], np.zeros(0), {n: {} for n in (0, *ORDERS)}, np.zeros((1, 0), np.float32), np.zeros((1, 0), bool))
    n = np.zeros((max(ORDERS) + 1, len(langs)))
    for r in totals:
        n[r["order"], langs.index(r["lang"])] = r["n"]
    # a bounded number of rows for each language: its most frequent keys of each order
    limit = {0: words, **{k: per_order for k in ORDERS}}
    place = F.row_number().over(Window.partitionBy("lang", "order").orderBy(F.desc("n"), "key"))
    most = F.when(F.col("order") == 0, words).otherwise(per_order)
    keys = counts.withColumn("place", place).filter(F.col("place") <= max(words, per_order)).filter(F.col("place") <= most).select("order", "key").distinct()
    wide = counts.join(keys, ["order", "key"]).groupBy("order", "key").agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(langs)))
    wide = cut(wide)
    kept = [wide.filter(F.col("order") == k).orderBy("key") for k in limit]
    index: dict[int, dict[str, int]] = {k: {} for k in limit}
    table, usual = [np.zeros(len(langs), np.float32)], [np.zeros((1, len(langs)), bool)]  # row 0: says nothing
    for part, k in zip(kept, limit):
        found = part.toArrow()
        keys = found.column("key").to_pylist()
        c = np.array([found.column(f"l{i}").to_numpy() for i in range(len(langs))], float).T.reshape(len(keys), len(langs))
        logs = np.log((c + 0.5) / (n[k] + 0.5 * (len(keys) + 1)))
        usual.append((c > 0) & (c >= USUAL * n[k]))
        for key, row in zip(keys, logs):
            index[k][key] = len(table)
            table.append(row)
    return Model(langs, np.log((n[0] + 1) / (n[0] + 1).sum()), index, np.array(table, np.float32), np.concatenate(usual))


class Judge:
    """Scores texts by a model; what chunks of text amount to is remembered for a bounded number of them.

    With ``explains`` the n-grams of ``EXPLAINED_BY`` characters, ends of
    words marked, are counted as well: by language the usual ones, then all.
    """

    def __init__(self, model: Model, limit: int = 200_000, explains: bool = False) -> None:
        self.model, self.limit, self.explains = model, limit, explains
        self._reset()

    def _reset(self) -> None:
        self.chunks: dict[str, int] = {}
        self.rows = np.zeros((self.limit + 1, len(self.model.langs)), np.float32)
        self.counts = np.zeros((self.limit + 1 if self.explains else 0, len(self.model.langs) + 1), np.int32)
        self.used = 1  # row 0: no letter

    def known(self, w: str) -> list[int]:
        """The row of a known word, else those of the longest n-grams of it that are known, else the row that says nothing."""
        index = self.model.index
        if (i := index[0].get(w)) is not None:
            return [i]
        for n in ORDERS:
            get = index[n].get
            if found := [i for g in grams(w, n) if (i := get(g)) is not None]:
                return found
        return [0]

    def _learn(self, chunks: list[str]) -> None:
        """Add the rows of chunks not met before: the sum over their words, each the mean of its rows."""
        first, starts, ids, weights, parts, at_part = self.used, [], [], [], [], []
        get = self.model.index[EXPLAINED_BY].get
        for chunk in chunks:
            if chunk in self.chunks:
                continue
            core = chunk.rstrip(MARKS)
            if (at := self.chunks.get(core)) is None:
                words = [core.lower()] if core.isascii() and core.isalpha() else [w for w in WORDS(core.lower()) if any(map(str.isalpha, w))]
                at = 0
                if words:
                    at = self.used
                    self.used += 1
                    starts.append(len(ids))
                    for w in words:
                        found = self.known(w)
                        ids += found
                        weights += [1 / len(found)] * len(found)
                    if self.explains:
                        at_part.append(len(parts))
                        parts += [get(g, 0) for w in words for g in grams(w, EXPLAINED_BY)]
                self.chunks[core] = at
            self.chunks[chunk] = at
        if starts:
            self.rows[first : self.used] = np.add.reduceat(self.model.table[ids] * np.array(weights, np.float32)[:, None], starts)
        if at_part:
            self.counts[first : self.used, :-1] = np.add.reduceat(self.model.usual[parts], at_part, dtype=np.int32)
            self.counts[first : self.used, -1] = np.diff([*at_part, len(parts)])

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, its score and, with ``explains``, the share of the n-grams that are usual in it (else 0)."""
        if not text:
            return UNKNOWN, 0.0, 0.0
        total, letters, get = self.model.prior.copy(), False, self.chunks.get
        counts = np.zeros(self.counts.shape[1], np.int64)
        words = text.split()
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            if self.used + len(part) > self.limit or len(self.chunks) > 2 * self.limit:
                self._reset()
                get = self.chunks.get
            rows = [get(w) for w in part]
            if None in rows:
                self._learn(part)
                rows = [get(w) for w in part]
            letters = letters or any(rows)
            total += self.rows[rows].sum(0, dtype=float)
            if self.explains:
                counts += self.counts[rows].sum(0, dtype=np.int64)
        if not letters or not self.model.langs:
            return UNKNOWN, 0.0, 0.0
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.langs[best], float(p[best] / p.sum()), float(counts[best] / max(counts[-1], 1))


def predict(docs: DataFrame, model: Model, text_col: str = "text", explained: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the share of the best language, 0 to 1) to every row.

    With ``explained`` a column of that name too: the share of the n-grams of
    the text's words that are usual in the predicted language; n-grams that
    the model doesn't know are in no language.

    Only the text is looked at, all of it.  Null text and text without a
    letter give ``und`` and 0; so does a model without languages.  Letters
    that the model knows nothing about leave the shares of the languages in
    training.  Existing columns of these names are replaced.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), *([StructField("explained", DoubleType())] if explained else [])]
    docs = docs.drop(*(f.name for f in added))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def make():
        judge = per_worker("language and share" if explained else "language", shared.value, lambda m: Judge(m, explains=explained))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = list(zip(*map(judge.judge, b.column(at).to_pylist())))
            return pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, k) for v, k in zip(found, (pa.string(), pa.float64(), pa.float64())[: len(added)]))], [*b.schema.names, *(f.name for f in added)])

        return f

    return map_arrow(docs, make, StructType([*docs.schema, *added]))


def least_explained(docs: DataFrame, model: Model, text_col: str, lang_col: str, key_col: str) -> list[float]:
    """``half_medians`` of all labelled rows, which are judged for it; no row is drawn, so ``key_col`` doesn't matter."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return half_medians(predict(rows, model, explained=True), model.langs)


def half_medians(judged: DataFrame, langs: list[str]) -> list[float]:
    """By language: half the median share explained of the rows ``lang, lang_pred, explained`` that are predicted as labelled.

    All such rows count; shares of 0 don't, and of two middle ones the lesser is taken.  0 without such rows.
    """
    # numbered, so that rows with equal shares are dealt to many tasks
    rows = cut(judged.filter("lang_pred = lang and explained > 0").select("lang", "explained", F.monotonically_increasing_id().alias("row")))
    n = rows.groupBy(F.col("lang").alias("of")).count()  # a row a language
    middle = sorted_ranks(rows, "lang", [F.col("explained"), F.col("row")]).join(F.broadcast(n), (F.col("lang") == F.col("of")) & (F.col("rank") == F.expr("(count - 1) div 2")))
    found = dict(middle.select("lang", "explained").collect())
    return [found.get(x, 0.0) / 2 for x in langs]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learn from the rows outside the held-out fold and predict all: ``doc_id, held_out, lang_pred, score``.

    The fold is crc32 of the identifier as text modulo ``folds``; a null
    identifier counts as empty text.  Rows with a null language or text teach
    nothing; null, empty and letterless text is ``und`` with score 0, and so is
    all if there is nothing to learn from.  Texts of any length are judged
    whole; of equally likely languages the first in text order is taken.
    Repeated rows are predicted each, other columns are not looked at; an
    empty table gives an empty result.
    """
    fold = F.pmod(text_key(F.col(id_col)), F.lit(folds)) == held_out
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold.alias("held_out"))
    model = train(rows.filter(~F.col("held_out")), "text", "lang", "doc_id")
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
