"""Repair of the structure of conversations: least-cost edits of their turns by bidirectional Dijkstra over the edit lattice."""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sorted_ranks

#: Turns that one search takes; longer conversations are put together from blocks of so many.
BLOCK = 512
#: ASCII white space and the marks that close a text.
SPACE, CLOSING = " \t\n\x0b\x0c\r", ".!?"
#: What the repaired roles have come to: nothing yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: A turn is one letter: its role's initial (s, u, a or another), times four, plus its fault.
CODES = "ABCDEFGHIJKLMNOP"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INSERT, REROLE, DELETE, CUT_OFF = 2, 2, 3, 1


def damage(rows: DataFrame) -> DataFrame:
    """Damage ``conv_id, turn, role, text`` by crc32 of ``conv_id:turn`` modulo 20; a null counts as one space.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4
    sets the role to user.  Other columns are left behind.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", CLOSING, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _after(state: int, initial: int) -> int:
    """The state after keeping a role; -1 if it may not stand there."""
    if initial == 0:
        return SYSTEM if state == NONE else -1
    if initial == 1:
        return USER if state != USER else -1
    return ASSISTANT if initial == 2 and state == USER else -1


def _turned(state: int) -> int:
    """The state after the only role that can be inserted or set there."""
    return ASSISTANT if state == USER else USER


@functools.cache
def arcs(code: str) -> tuple[tuple[int, int, int, str], ...]:
    """The edits of a turn as (state before, state after, cost, initial)."""
    initial, fault = divmod(CODES.index(code), 4)
    out = [(s, s, DELETE, "D") for s in range(4)]
    if fault in (SOUND, TRUNCATED):
        more = CUT_OFF * (fault == TRUNCATED)
        out += [(s, _turned(s), REROLE + more, "R") for s in range(4)]
        out += [(s, to, more, "K") for s in range(4) if (to := _after(s, initial)) >= 0]
    return tuple(out)


INSERTS = tuple((s, _turned(s)) for s in range(4))


@functools.lru_cache(100_000)
def search(codes: str, source: int, targets: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost from ``source`` before the turns to one of ``targets`` behind them, and the ASCII-least audit of that cost; None if there is no way.

    Nodes are (turns passed, state).  Two heaps settle nodes from both ends by
    cost, equal costs in the order of the turns, so that every equal-cost way
    into a node is known when it is settled.  Equal-cost audits of one node
    never begin with each other (the longer one would have an insertion
    more), so the least audits of both sides give the least joined one.  The
    search goes on until the heaps' least costs together exceed the best
    crossing: all crossings of that cost are met.
    """
    n = len(codes)
    fore: dict[tuple[int, int], tuple[int, str]] = {(0, source): (0, "")}
    back: dict[tuple[int, int], tuple[int, str]] = {(n, t): (0, "") for t in targets}
    fore_heap, back_heap = [(0, 0, source)], [(0, -n, t) for t in targets]
    fore_done: set[tuple[int, int]] = set()
    back_done: set[tuple[int, int]] = set()
    best: tuple[float, str] = (float("inf"), "")
    while fore_heap and back_heap and fore_heap[0][0] + back_heap[0][0] <= best[0]:
        if fore_heap[0][0] <= back_heap[0][0]:
            _, i, s = heapq.heappop(fore_heap)
            if (i, s) in fore_done:
                continue
            fore_done.add((i, s))
            cost, audit = fore[i, s]
            if (i, s) in back_done:
                best = min(best, (cost + back[i, s][0], audit + back[i, s][1]))
            ways = [(i, _turned(s), INSERT, "I")]
            if i < n:
                ways += [(i + 1, to, c, e) for at, to, c, e in arcs(codes[i]) if at == s]
            for j, to, c, e in ways:
                new, known = (cost + c, audit + e), fore.get((j, to))
                if known is None or new < known:
                    fore[j, to] = new
                    heapq.heappush(fore_heap, (new[0], j, to))
                if (j, to) in back_done:
                    best = min(best, (new[0] + back[j, to][0], new[1] + back[j, to][1]))
        else:
            _, i, s = heapq.heappop(back_heap)
            i = -i
            if (i, s) in back_done:
                continue
            back_done.add((i, s))
            cost, audit = back[i, s]
            if (i, s) in fore_done:
                best = min(best, (cost + fore[i, s][0], fore[i, s][1] + audit))
            ways = [(i, at, INSERT, "I") for at, to in INSERTS if to == s]
            if i:
                ways += [(i - 1, at, c, e) for at, to, c, e in arcs(codes[i - 1]) if to == s]
            for j, at, c, e in ways:
                new, known = (cost + c, e + audit), back.get((j, at))
                if known is None or new < known:
                    back[j, at] = new
                    heapq.heappush(back_heap, (new[0], -j, at))
                if (j, at) in fore_done:
                    best = min(best, (new[0] + fore[j, at][0], fore[j, at][1] + new[1]))
    return best if best[0] < float("inf") else None


def _paths(codes: str, block: int) -> list[dict]:
    """The least edits of a block from every state to every state; of a whole conversation only those that count."""
    if block == 0 and len(codes) < BLOCK:
        cost, audit = search(codes, NONE, (NONE, ASSISTANT))
        return [{"at": NONE, "to": ASSISTANT, "cost": cost, "audit": audit}]
    out = []
    for at in (NONE,) if block == 0 else range(4):
        for to in range(4):
            if found := search(codes, at, (to,)):
                out.append({"at": at, "to": to, "cost": found[0], "audit": found[1]})
    return out


_PATHS = "paths array<struct<at: int, to: int, cost: long, audit: string>>"
_FACTS = "blank long, duplicate long, truncated long, illegal long"


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for b in batches:
        conv, block, codes = b.column(0), b.column(1), b.column(2).to_pylist()
        faults = [[c % 4 for c in map(CODES.index, x)] for x in codes]
        initials = ["".join("sua-"[CODES.index(c) // 4] for c in x) for x in codes]
        counts = [pa.array([f.count(k) for f in faults], pa.int64()) for k in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = pa.array([sum(x[i : i + 2] not in ("su", "ua", "au") for i in range(len(x) - 1)) for x in initials], pa.int64())
        ends = [pa.array([x[0] for x in initials], pa.string()), pa.array([x[-1] for x in initials], pa.string())]
        paths = pa.array([_paths(x, k) for x, k in zip(codes, block.to_pylist())], path)
        yield pa.RecordBatch.from_arrays([conv, block, *counts, illegal, *ends, paths], ["conv", "block", "blank", "duplicate", "truncated", "illegal", "first", "last", "paths"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the blocks of each conversation together, in order: the state between two blocks and what lies before it are all that is kept."""
    names = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
    now, facts, last, ways, done = None, [0] * 4, "", {}, []

    def close() -> None:
        if now is not None:
            done.append((now, *facts, *min(ways[s] for s in (NONE, ASSISTANT) if s in ways)))

    for b in batches:
        for r in b.to_pylist():
            if r["conv"] != now:
                close()
                now, facts, last, ways = r["conv"], [0] * 4, "", {NONE: (0, "")}
            for k, name in enumerate(names[1:5]):
                facts[k] += r[name]
            facts[3] += bool(last) and last + r["first"] not in ("su", "ua", "au")
            last, new = r["last"], {}
            for p in r["paths"]:
                if p["at"] in ways:
                    cost, audit = ways[p["at"]]
                    way = (cost + p["cost"], audit + p["audit"])
                    new[p["to"]] = min(new.get(p["to"], way), way)
            ways = new
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)


def _key(col: Column) -> Column:
    """A conversation's identifier as text; null is a conversation of its own."""
    return F.coalesce(col.cast("string"), F.lit(" "))


def _turns(rows: DataFrame) -> DataFrame:
    """The turns of all conversations with their place, from 0, in the order of turn (null first), role and text; equal ones stand side by side."""
    rows = rows.select(_key(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return sorted_ranks(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])


def _audits(turns: DataFrame) -> DataFrame:
    """One row a conversation with turns: ``conv, blank, duplicate, truncated, illegal, cost, audit``."""
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(~F.substring(body, -1, 1).isin(*CLOSING), TRUNCATED).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = turns.select("conv", "rank", (place * 4).alias("initial"), fault.alias("fault"), F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("content"))
    # (conversation, place) is a key without repetition, so a conversation of any length is spread
    first = narrow.groupBy("conv", "content").agg(F.min("rank").alias("rank")).select("conv", "rank", F.lit(True).alias("first"))
    seen = narrow.join(first, ["conv", "rank"], "left")
    code = F.col("initial") + F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    letter = F.substring(F.lit(CODES), code + 1, F.lit(1))
    block = F.floor(F.col("rank") / BLOCK).alias("block")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", letter.alias("code")))), lambda x: x.code)
    blocks = seen.groupBy("conv", block).agg(F.array_join(in_order, "").alias("codes"))
    solved = blocks.mapInArrow(_solve_blocks, f"conv string, block long, {_FACTS}, first string, last string, {_PATHS}")
    return cut(solved.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_join_blocks, f"conv string, {_FACTS}, cost long, audit string"))


def _edited(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """A row for each turn that stays, with the insertions before it, and one for insertions at the end: ``conv, rank, edit, role, text``, the turns of a conversation together and in order."""
    edits = audits.select("conv", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[DKR]|I+$"), F.lit(0))).alias("rank", "edit")).filter("edit <> 'D'")
    edits = edits.withColumn("rank", F.col("rank").cast("long"))
    return edits.join(turns.select("conv", "rank", "role", "text"), ["conv", "rank"], "left").repartition("conv").sortWithinPartitions("conv", "rank")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, str, str, str]]]:
    """The repaired turns (conversation, place, edit, role, text), batch by batch; a conversation is never held whole."""
    now, at, last = None, 0, ""
    for b in batches:
        out = []
        for conv, edits, was, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
            if conv != now:
                now, at, last = conv, 0, ""
            for e in edits.replace("D", ""):
                role = was if e == "K" else "assistant" if last == "u" else "user"
                out.append((conv, at, e, role, "" if e == "I" else text))
                at, last = at + 1, role[:1]
        yield out


_LINE = "conv string, place long, edit string, role string, text string"


def _write_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _lines(batches):
        if rows:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv", "place", "edit", "role", "text"])


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha, done = None, hashlib.sha256(), []
    for rows in _lines(batches):
        for conv, at, _, role, text in rows:
            if conv != now:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256()
            sha.update(f"{chr(10) * (at > 0)}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["conv", "sha"])
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["conv", "sha"])


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns after repair: ``conv_id`` (as text; null as one space), ``place`` from 0, ``edit`` (K, R or I), ``role``, ``text``."""
    turns = _turns(rows)
    return _edited(turns, _audits(turns)).mapInArrow(_write_lines, _LINE).withColumnRenamed("conv", "conv_id")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Find the faults of each conversation and the cheapest edits that give roles ``(s?(ua)+)?`` by initial.

    ``rows`` has ``conv_id, turn, role, text``; other columns are not looked
    at.  A null ``conv_id`` is a conversation of its own, a null role or text
    counts as one space, null turns come first.  Rows of one turn are taken by
    role and text, equal ones side by side.  Empty and very long texts are
    judged whole.  Costs: keep 0, set the role 2, delete 3 (the only edit of
    a blank or repeated turn), insert an empty one 2, leave a truncated one 1.
    Of equally cheap audits the ASCII-least is taken.

    Returns a row for each ``conv_id`` of ``ids`` (of ``rows`` without it):
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost`` (longs),
    ``audit`` (K, R, D, I in order), ``repaired_sha256`` (of the repaired
    ``role:text``, joined by newlines).  Conversations without a row have
    zeros, an empty audit and the hash of the empty text; an empty table gives none.

    A long conversation is dealt out: its turns are ranked over range
    partitions, blocks of ``BLOCK`` turns are searched apart from every state
    to every state, and a stream over the blocks joins them.  Only the audit,
    which is one value of the result, and one batch of texts are held.
    """
    turns = _turns(rows)
    audits = _audits(turns)
    hashes = _edited(turns, audits).mapInArrow(_hash_lines, "conv string, sha string")
    by_turn = turns.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = by_turn.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    ids = (rows if ids is None else ids).select(F.col("conv_id"), _key(F.col("conv_id")).alias("conv")).groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(gaps, "conv", "left").join(audits, "conv", "left").join(hashes, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))
