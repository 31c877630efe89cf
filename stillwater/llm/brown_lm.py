"""Scoring with a class-based bigram model whose classes come from exchange clustering (Brown)."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_key

#: The end of a text; no word is empty.
END = b""


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null as empty), A-Z lower-cased, and the number of words of each text; its end is not among them."""
    texts = pc.fill_null(pc.cast(texts, options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)), "")
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # ASCII letters, and the six white-space characters of ASCII
    words = found.flatten().cast(pa.binary())
    full = pc.binary_length(words).to_numpy() > 0
    upto = np.concatenate(([0], np.cumsum(full)))
    ends = np.cumsum(pc.list_value_length(found).to_numpy().astype(np.int64))
    return words.filter(pa.array(full)), np.diff(upto[ends], prepend=0)


def numbers(words: pa.Array, sizes: np.ndarray, listed: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, each text closed by ``end``: their places in ``listed`` (behind it for a word that isn't listed), and which of the words each is."""
    inner = np.ones(len(words) + len(sizes), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    out = np.full(len(inner), end, np.int64)
    out[inner] = pc.fill_null(pc.index_in(words, value_set=listed), len(listed)).to_numpy()
    return out, np.cumsum(inner) - 1


def _slices(batches, column: int = 0, size: int = 8_000_000):
    """The batches in slices of about ``size`` bytes of text, so that the words of only so much are in memory at once."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over whole texts (one column ``text``); END is the empty word.  Counts are added up before the shuffle."""

    def run(batches):
        held, n, ends = [], 0, 0

        def added():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in _slices(batches):
            words, sizes = tokens(b.column(0))
            ends += len(sizes)
            found = words.value_counts()
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            n += len(found)
            if n > 1_000_000:
                held = [added()]
                n = len(held[0])
                if n > 500_000:
                    yield from held[0].to_batches(100_000)
                    held, n = [], 0
        held.append(pa.table({"word": pa.array([END] * (ends > 0), pa.binary()), "n": pa.array([ends] * (ends > 0), pa.int64())}))
        yield from added().to_batches(100_000)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count that no more than ``most`` words reach."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    seen, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        seen += r["count"]
        if seen > most:
            break
        least = r["level"]
    return counts.filter(level >= least if least is not None else F.lit(False))


def pair_counts(texts: DataFrame, words: list[bytes], to: np.ndarray, near: int | None = None) -> DataFrame:
    """``a, b, n``: how often number ``b`` follows ``a``; word ``i`` of ``words`` has the number ``to[i]``, all others ``to[-1]``.

    With ``near`` the neighbours of the words from there to the last but one
    of ``words``: ``a`` is the word (from 0), ``b`` the number before it or,
    plus the number of numbers, after it.  A text follows an END.  Each task
    adds up its pairs before the shuffle.
    """
    shared = texts.sparkSession.sparkContext.broadcast((pa.array(words, pa.binary()), to, words.index(END)))

    def run(batches):
        listed, to, end = shared.value
        width = int(to.max()) + 1
        base = width if near is None else 2 * width
        keys, ns, held = [], [], 0

        def out():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(ns)).astype(np.int64)
            return k, n

        for b in _slices(batches):
            cur, _ = numbers(*tokens(b.column(0)), listed, end)
            prev = np.concatenate(([end], cur[:-1]))
            if near is None:
                k = to[prev] * width + to[cur]
            else:
                after, before = ((x >= near) & (x < len(listed) - 1) for x in (cur, prev))
                k = np.concatenate([(cur[after] - near) * base + to[prev[after]], (prev[before] - near) * base + width + to[cur[before]]])
            k, n = np.unique(k, return_counts=True)
            keys.append(k)
            ns.append(n)
            held += len(k)
            if held > 2_000_000:
                k, n = out()
                keys, ns, held = [k], [n], len(k)
                if held > 1_000_000:
                    yield from _pairs(k, n, base)
                    keys, ns, held = [], [], 0
        if keys:
            yield from _pairs(*out(), base)

    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _pairs(k: np.ndarray, n: np.ndarray, width: int):
    for at in range(0, len(k), 100_000):
        x, y = k[at : at + 100_000], n[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array((x // width).astype(np.int32)), pa.array((x % width).astype(np.int32)), pa.array(y)], ["a", "b", "n"])


def _f(x: np.ndarray) -> np.ndarray:
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1))


def gains(t: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, own: float, n: float) -> np.ndarray:
    """By class: the log likelihood won by adding a word to it.

    ``t[c, d]`` counts class d after class c without the word, ``left[c]`` the
    word after class c, ``right[c]`` class c after the word, ``own`` the word after itself.
    """
    col = _f(t + left[:, None]) - _f(t)
    row = _f(t + right[None, :]) - _f(t)
    d = np.diag(t)
    both = _f(d + left + right + own) - _f(d)
    return col.sum(0) - np.diag(col) + row.sum(1) - np.diag(row) + both - 2 * (_f(size + n) - _f(size))


class Chooser:
    """Gives a word the class that wins most, from its neighbours' classes; as ``gains``, on the classes that occur only."""

    def __init__(self, t: np.ndarray, classes: int) -> None:
        self.t, self.classes, self.size, self.d = t, classes, t.sum(0), np.diag(t)
        self.ft, self.fsize, self.fd = _f(t), _f(self.size), _f(self.d)

    def __call__(self, left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray) -> int:
        """The class for distinct classes ``left`` before and ``right`` after the word with their counts."""
        col = _f(self.t[left] + left_n[:, None]) - self.ft[left]
        row = _f(self.t[:, right] + right_n) - self.ft[:, right]
        g = col.sum(0) + row.sum(1) - self.fd - 2 * (_f(self.size + left_n.sum()) - self.fsize)
        g[left] -= col[np.arange(len(left)), left]
        g[right] -= row[right, np.arange(len(right))]
        d = self.d.copy()
        d[left] += left_n
        d[right] += right_n
        return int((g + _f(d))[: self.classes].argmax())


def exchange(pairs: DataFrame, n_words: int, classes: int, fixed: int, sweeps: int) -> np.ndarray:
    """Exchange clustering: the class of each of ``n_words`` words; numbers from there on keep classes of their own.

    In every sweep Spark adds up the pair counts to words by class
    (``n_words * 2 * (classes + fixed)`` numbers); then each word in turn moves
    to the class with the highest likelihood, the class counts following the
    moves of the sweep.  Stops early when no word moves.
    """
    spark = pairs.sparkSession
    width = classes + fixed
    of = np.concatenate([np.arange(n_words) % classes, classes + np.arange(fixed)]).astype(np.int64)
    own = np.zeros(n_words)
    for r in pairs.filter((F.col("a") == F.col("b")) & (F.col("a") < n_words)).collect():
        own[r["a"]] = r["n"]
    for _ in range(sweeps):
        table = F.broadcast(spark.createDataFrame(list(enumerate(of.tolist())), "w int, c int"))
        by = pairs.join(table.toDF("a", "ca"), "a").join(table.toDF("b", "cb"), "b")
        sides = by.select(F.col("b").alias("w"), F.col("ca").alias("c"), "n").unionByName(by.select(F.col("a").alias("w"), (F.col("cb") + width).alias("c"), "n"))
        found = sides.groupBy("w", "c").agg(F.sum("n").alias("n")).toArrow()
        v = np.zeros((n_words + fixed, 2 * width))
        v[found.column("w").to_numpy(), found.column("c").to_numpy()] = found.column("n").to_numpy()
        left, right = v[:, :width], v[:, width:]
        t = np.zeros((width, width))
        np.add.at(t.T, of, left)  # t[c, class of w] += how often w follows c
        size = t.sum(0)
        moved = 0
        for w in np.argsort(-left[:n_words].sum(1), kind="stable"):
            g, n, s = of[w], left[w].sum(), own[w]
            if not n:
                continue
            a, b = left[w].copy(), right[w].copy()
            a[g] -= s
            b[g] -= s
            a, b = np.maximum(a, 0), np.maximum(b, 0)
            t[:, g] = np.maximum(t[:, g] - a, 0)
            t[g, :] = np.maximum(t[g, :] - b, 0)
            t[g, g] = max(t[g, g] - s, 0)
            size[g] -= n
            k = int(gains(t, size, a, b, s, n)[:classes].argmax())
            t[:, k] += a
            t[k, :] += b
            t[k, k] += s
            size[k] += n
            of[w] = k
            moved += k != g
        if not moved:
            break
    return of


@dataclass(frozen=True)
class ClassModel:
    """Word ``i`` of ``words`` has class ``of[i]`` and occurred ``n[i]`` times; for the words not listed ``rest`` has ``word, n, c``."""

    words: list[bytes]
    n: np.ndarray
    of: np.ndarray
    step: np.ndarray  # log10 probability of a class after a class
    emit: np.ndarray  # log10 probability of a listed word in its class
    size: np.ndarray  # occurrences of the words of each class
    other: int
    other_n: int
    other_v: int
    total: int
    types: int
    rest: DataFrame | None


def fit(texts: DataFrame, counts: DataFrame, classes: int | None = None, core: int | None = None, clustered: int | None = None, listed: int = 200_000, sweeps: int = 6, least: int = 5) -> ClassModel:
    """Fit the class model on all whole texts.

    Every word that occurs ``least`` times has a class.  The ``core`` most
    frequent words are clustered by exchange; the next ones, up to ``listed``,
    join the class with the highest gain by their core neighbours, and the
    others, in Spark only, by their listed neighbours.  ``classes`` grows with
    the fourth root of the number V of words with a class (2 V ** 0.25, 32 at
    least), ``core`` with ``classes`` (60 for each, 2,000 at least); the
    neighbour counts that the driver holds for an
    exchange take about 3,840 sqrt(V) bytes.  Rarer words form
    the class ``other``, whose members' probabilities come from their exact
    counts with an addition of 1/2 (one unseen word included).  ``listed``
    bounds the words that are sent to the workers, not those with a class;
    ``clustered``, if given, ends the words with a class at that rank.
    """
    spark = texts.sparkSession
    named = F.col("word") != F.lit(bytearray(END))
    total, types, said, known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)), F.count_if(named & (F.col("n") >= least))).first()
    found = frequent(counts.filter(named), listed).toArrow()
    n = found.column("n").to_numpy()
    names = found.column("word").to_pylist()
    rank = sorted(range(len(names)), key=lambda i: (-n[i], names[i]))
    words, n = [names[i] for i in rank], n[rank].astype(np.int64)
    classes = classes or max(32, math.ceil(2 * known**0.25))
    core = min(core or max(2_000, 60 * classes), len(words))
    rest_least = least if clustered is None else None
    clustered = int((n >= least).sum()) if clustered is None else min(clustered, len(words))
    clustered = max(core, clustered)
    ends = total - said

    # numbers: core words, then END, then other
    pairs = cut(pair_counts(texts, [*words[:core], END], np.arange(core + 2)))
    of_core = exchange(pairs, core, classes, 2, sweeps)
    end, other = classes, classes + 1
    of = np.full(len(words), other, np.int64)
    of[:core] = of_core[:core]
    width = classes + 2
    t = np.zeros((width, width))
    for r in pairs.join(F.broadcast(spark.createDataFrame(list(enumerate(of_core.tolist())), "a int, ca int")), "a").join(F.broadcast(spark.createDataFrame(list(enumerate(of_core.tolist())), "b int, cb int")), "b").groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect():
        t[r["ca"], r["cb"]] = r["n"]
    shared = spark.sparkContext.broadcast(t)
    if clustered > core:
        to = np.concatenate([of_core[:core], np.full(clustered - core, other), [end, other]])
        by = pair_counts(texts, [*words[:clustered], END], to, core).groupBy(F.col("a").alias("w")).agg(F.collect_list(F.struct("b", "n")).alias("v"))

        def choose(batches):
            best = Chooser(shared.value, classes)
            for b in batches:
                v, at = b.column(1), b.column(1).offsets.to_numpy()
                c, m = v.values.field(0).to_numpy(), v.values.field(1).to_numpy().astype(float)
                out = []
                for x, y in zip(at[:-1], at[1:]):
                    left = c[x:y] < width
                    out.append(best(c[x:y][left], m[x:y][left], c[x:y][~left] - width, m[x:y][~left]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], ["w", "c"])

        got = by.mapInArrow(choose, "w int, c int").toArrow()
        of[core + got.column("w").to_numpy()] = got.column("c").to_numpy()

    rest, moves = unlisted(texts, [*words, END], np.append(of, end), shared, classes, rest_least)
    share = (moves.sum(0) + 0.5) / (moves.sum() + 0.5 * width)
    step = np.log10((moves + share) / (moves.sum(1, keepdims=True) + 1))
    in_class = of != other
    size = np.bincount(of[in_class], n[in_class], width)
    v = int(in_class.sum())
    for r in rest.filter(F.col("c") != other).groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        size[r["c"]] += r["n"]
        v += r["v"]
    other_n = total - ends - int(size.sum())
    other_v = types - (ends > 0) - v
    emit = np.where(in_class, np.log10(n / np.maximum(size[of], 1)), np.log10((n + 0.5) / (other_n + 0.5 * (other_v + 1)))) if len(n) else np.zeros(0)
    # END is the last listed word
    return ClassModel([*words, END], np.append(n, ends), np.append(of, end), step, np.append(emit, 0.0), size, other, other_n, other_v, total, types, rest)


def unlisted(texts: DataFrame, words: list[bytes], of: np.ndarray, table, classes: int, least: int | None) -> tuple[DataFrame, np.ndarray]:
    """``word, n, c`` of all words that are not in ``words``, and how often each class follows each over all texts.

    A word with ``least`` occurrences (none if null) gets the class with the
    highest gain by its listed neighbours, any other one ``other``.  Each
    occurrence is a row; these words are rare, so none is hot.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((pa.array(words, pa.binary()), of))
    width, other, none = classes + 2, classes + 1, -1
    schema = "word binary, l int, r int, next binary, n long"

    def occurrences(batches):
        listed, to = shared.value
        cls, moves = np.append(to, none), np.zeros(width * width, np.int64)
        for b in _slices(batches):
            words, sizes = tokens(b.column(0))
            # a text ends with END and follows one, so the ends of a slice are no unlisted words
            i, place = numbers(words, sizes, listed, len(listed) - 1)
            c = cls[i]
            prev = np.concatenate(([classes], c[:-1]))
            both = (prev != none) & (c != none)
            moves += np.bincount(prev[both] * width + c[both], minlength=width * width)
            at = np.flatnonzero(c == none)
            if len(at):
                after = c[at + 1]
                follow = words.take(pa.array(place[at + 1], mask=after != none))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(place[at])), pa.array(prev[at].astype(np.int32)), pa.array(after.astype(np.int32)), follow, pa.array(np.ones(len(at), np.int64))], ["word", "l", "r", "next", "n"])
        k = np.flatnonzero(moves)
        if len(k):
            # a key of its own for each pair of classes, which no word equals
            yield pa.RecordBatch.from_arrays([pa.array([b" %d" % x for x in k.tolist()], pa.binary()), pa.array((k // width).astype(np.int32)), pa.array((k % width).astype(np.int32)), pa.nulls(len(k), pa.binary()), pa.array(moves[k])], ["word", "l", "r", "next", "n"])

    met = texts.mapInArrow(occurrences, schema).repartition(F.col("word")).groupBy("word", "l", "r", "next").agg(F.sum("n").alias("n"))
    by = met.groupBy("word").agg(F.collect_list(F.struct("l", "r", "next", "n")).alias("v"))

    def choose(batches):
        best = Chooser(table.value, classes)
        moves = np.zeros((width, width), np.int64)
        for b in batches:
            v, at, names = b.column(1), b.column(1).offsets.to_numpy(), b.column(0)
            left, right, follow, n = (v.values.field(i).slice(at[0], at[-1] - at[0]) for i in range(4))
            left, right, n = left.to_numpy(), right.to_numpy(), n.to_numpy()
            at = at - at[0]
            sums = np.add.reduceat(n, at[:-1]) if len(names) else n[:0]
            cs = np.where(pc.starts_with(names, b" ").to_numpy(zero_copy_only=False), none, other)
            for i in np.flatnonzero((cs != none) & (sums >= least)).tolist() if least is not None else ():
                x, y = at[i], at[i + 1]
                m = n[x:y].astype(float)
                lc, rc = (np.bincount(np.where(z[x:y] == none, other, z[x:y]), m, width) for z in (left, right))
                li, ri = np.flatnonzero(lc), np.flatnonzero(rc)
                cs[i] = best(li, lc[li], ri, rc[ri])
            c = np.repeat(cs, np.diff(at))
            for ok, i, j in ((c == none, left, right), ((c != none) & (left != none), left, c), ((c != none) & (right != none), c, right)):
                np.add.at(moves, (i[ok], j[ok]), n[ok])
            words = np.flatnonzero(cs != none)
            yield out(0, names.take(pa.array(words)), cs[words], None, sums[words])
            pending = np.flatnonzero((c != none) & (right == none))
            yield out(1, follow.take(pa.array(pending)), c[pending], None, n[pending])
        i, j = np.nonzero(moves)
        yield out(2, None, i, j, moves[i, j])

    def out(kind, word, c, d, n):
        k = len(n)
        columns = [np.full(k, kind, np.int32), pa.nulls(k, pa.binary()) if word is None else word, c.astype(np.int32), pa.nulls(k, pa.int32()) if d is None else d.astype(np.int32), n.astype(np.int64)]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["kind", "word", "c", "d", "n"])

    found = cut(by.mapInArrow(choose, "kind int, word binary, c int, d int, n long"))
    rest = found.filter("kind = 0").select("word", "n", "c")
    pending = found.filter("kind = 1").select("word", F.col("c").alias("l"), F.col("n").alias("m"))
    moved = pending.join(rest, "word").select("l", F.col("c").alias("r"), "m")
    moved = moved.unionByName(found.filter("kind = 2").select(F.col("c").alias("l"), F.col("d").alias("r"), F.col("n").alias("m")))
    moves = np.zeros((width, width))
    for r in moved.groupBy("l", "r").agg(F.sum("m").alias("m")).collect():
        moves[r["l"], r["r"]] = r["m"]
    return rest, moves


def _numbers(x: np.ndarray):
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(map(repr, x.ravel().tolist()))), ",").cast("array<double>")


def score(docs: DataFrame, model: ClassModel, text_col: str = "text") -> DataFrame:
    """Score whole texts; replaces ``text_col`` by ``n_tokens, n_known, base_score, score``.

    Columns of these four names are replaced; the others stay, whatever their names.
    """
    names = [c for c in docs.columns if c not in (text_col, "n_tokens", "n_known", "base_score", "score")]
    # the caller's columns by number, so that no name of theirs meets one of ours
    own = docs.select(F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(names)))
    out = _score(own, model)
    return out.select(*(F.col(f"own{i}").alias(c) for i, c in enumerate(names)), "n_tokens", "n_known", "base_score", "score")


def _score(docs: DataFrame, model: ClassModel, text_col: str = "text") -> DataFrame:
    """``score`` on columns whose names are known.

    Listed words are looked up in the tasks.  Each occurrence of another one
    leaves as a row with the classes beside it and meets its count and class
    in a join; they are rare, so no key of the join is hot.  Where two of them
    follow each other, their classes meet when the rows of a text do.  Texts
    are numbered on the way, so repeated rows keep a row each.
    """
    from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast((replace(model, rest=None, words=[]), pa.array(model.words, pa.binary())))
    others = [c for c in docs.columns if c != text_col]
    at = docs.columns.index(text_col)
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    keep = [c for c in numbered.columns if c != text_col]
    added = [("n_tokens", LongType()), ("n_known", LongType()), ("base_score", DoubleType()), ("score", DoubleType()), ("_word", BinaryType()), ("_l", IntegerType()), ("_r", IntegerType()), ("_at", LongType())]
    schema = StructType([*(numbered.schema[c] for c in keep), *(StructField(c, k) for c, k in added)])
    width, none = len(model.step), -1

    def run(batches):
        m, listed = shared.value
        of = np.append(m.of, none)
        base = np.append(np.log10((m.n + 0.5) / (m.total + 0.5 * (m.types + 1))), 0.0)
        emit = np.append(m.emit, 0.0)
        known = np.append((m.n > 0).astype(np.int64), 0)
        step = np.zeros((width + 1, width + 1))  # the last ones: not listed
        step[:width, :width] = m.step
        end_class = int(m.of[-1])
        for b in _slices(batches, at):
            words, sizes = tokens(b.column(at))
            i, place = numbers(words, sizes, listed, len(listed) - 1)
            sizes = sizes + 1  # with the end
            c = of[i]
            prev = np.concatenate(([end_class], c[:-1]))
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            local = [pa.array(sizes), pa.array(np.add.reduceat(known[i], first)), pa.array(np.add.reduceat(base[i], first)), pa.array(np.add.reduceat(emit[i] + step[prev, c], first))]
            plain = [b.column(k) for k, name in enumerate(b.schema.names) if name != text_col]
            rows = b.column(b.schema.names.index("_row")).to_numpy()
            # a key of its own for each text, which no word equals
            key = pa.array([b" %d" % r for r in rows.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*plain, *local, key, *(pa.nulls(b.num_rows, k) for k in (pa.int32(), pa.int32(), pa.int64()))], schema.names)
            miss = np.flatnonzero(c == none)
            if n := len(miss):
                doc = np.repeat(np.arange(len(sizes)), sizes)[miss]
                zero = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())]
                idle = [pa.array(rows[doc]) if name == "_row" else pa.nulls(n, b.schema.field(name).type) for name in keep]
                beside = [pa.array(prev[miss].astype(np.int32)), pa.array(c[miss + 1].astype(np.int32)), pa.array(miss - first[doc])]
                yield pa.RecordBatch.from_arrays([*idle, *zero, words.take(pa.array(place[miss])), *beside], schema.names)

    parts = numbered.mapInArrow(run, schema)
    joined = parts.join(model.rest.select(F.col("word").alias("_word"), F.col("n").alias("_n"), F.col("c").alias("_c")), "_word", "left")
    rare, n, c = F.col("_at").isNotNull(), F.coalesce("_n", F.lit(0)), F.coalesce("_c", F.lit(model.other))
    step = _numbers(model.step)
    emit = F.when(c == model.other, F.log10((n + 0.5) / (model.other_n + 0.5 * (model.other_v + 1)))).otherwise(F.log10(n / F.get(_numbers(model.size), c)))
    won = emit + F.when(F.col("_l") >= 0, F.get(step, F.col("_l") * width + c)).otherwise(0.0) + F.when(F.col("_r") >= 0, F.get(step, c * width + F.col("_r"))).otherwise(0.0)
    side = rare & ((F.col("_l") < 0) | (F.col("_r") < 0))
    out = joined.groupBy("_row").agg(
        *(F.max(k).alias(k) for k in others),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.count_if(rare & (n > 0))).alias("n_known"),
        (F.sum("base_score") + F.coalesce(F.sum(F.when(rare, F.log10((n + 0.5) / (model.total + 0.5 * (model.types + 1))))), F.lit(0.0))).alias("base_score"),
        (F.sum("score") + F.coalesce(F.sum(F.when(rare, won)), F.lit(0.0))).alias("score"),
        F.collect_list(F.when(side, F.struct(F.col("_at").alias("at"), c.alias("c")))).alias("_side"),
    ).drop("_row")

    def follow(batches):
        step = shared.value[0].step
        for b in batches:
            v, ends = b.column(b.num_columns - 1), b.column(b.num_columns - 1).offsets.to_numpy()
            doc = np.repeat(np.arange(b.num_rows), np.diff(ends))
            at, c = (v.values.field(i).to_numpy()[ends[0] : ends[-1]] for i in range(2))
            order = np.lexsort((at, doc))
            doc, at, c = doc[order], at[order], c[order]
            pair = np.flatnonzero((doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + 1))
            more = np.bincount(doc[pair], step[c[pair], c[pair + 1]], b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(b.column(b.num_columns - 2).to_numpy() + more)], b.schema.names[:-1])

    return out.mapInArrow(follow, StructType(out.schema.fields[:-1]))


def brown_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, **fit_options) -> DataFrame:
    """Learn from the rows outside the held-out fold, score all.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, perplexity``.  Null text counts as empty and has one token (its
    end); the fold is crc32 of the identifier as text, null as empty.  Repeated
    rows are scored each.  Without rows to learn from every word is unseen.
    """
    fold = F.pmod(text_key(F.col(id_col)), F.lit(folds)) == held_out
    rows = docs.select(F.col(id_col).alias("doc_id"), fold.alias("held_out"), F.col(text_col).alias("text"))
    texts = rows.filter(~F.col("held_out")).select("text")
    counts = cut(word_counts(texts))
    model = fit(texts, counts, **fit_options)
    out = score(rows, model)
    return out.withColumns({"train_tokens": F.lit(int(model.total)).cast("long"), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})
