"""Conversation repair, piece chunks and lexical search against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from stillwater.llm import conversation_repair as R
from stillwater.llm import lexical_search as S
from stillwater.llm import piece_chunks as C
from stillwater.llm import queries as Q

# ---- conversation repair

TURNS = "conv_id long, turn long, role string, text string, conv string, rank int, _at int, block int"


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            out += [(c, t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def plain_repair(rows):
    """All facts of one conversation; edits by going through the turns with the least (cost, audit) of each state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[2][:1], b[2][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(rows, rows[1:]))
    ways = {"": (0, "", [])}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for s, (c, a, lines) in list(out.items()):
                role = "assistant" if s == "u" else "user"
                put(out, role[0], (c + 2, a + "I", [*lines, f"{role}:"]))
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for s, (c, a, lines) in inserted(ways).items():
            put(new, s, (c + 3, a + "D", lines))
            if fault in ("", "truncated"):
                more, turned = fault == "truncated", "assistant" if s == "u" else "user"
                put(new, turned[0], (c + 2 + more, a + "R", [*lines, f"{turned}:{text}"]))
                i = role[:1]
                if (i == "s" and s == "") or (i == "u" and s != "u") or (i == "a" and s == "u"):
                    put(new, i, (c + more, a + "K", [*lines, f"{role}:{text}"]))
        ways = new
    cost, audit, lines = min((w for s, w in inserted(ways).items() if s in ("", "a")), key=lambda w: w[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations():
    r = random.Random(7)
    rows = []
    for c in [*range(120), None]:
        for t in range(r.randint(0, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "", "tool", "User", None])
            text = r.choice(["Yes.", "No!", "Why?", "cut off", "", " \n\t", None, "é.\x85", "And so on.  \n", f"{r.random()}.", "long " * 2000])
            rows.append((c, r.choice([t, t, t, t + 1, None]), role, text))
    rows += rows[5:9] + rows[5:7]
    for n, c in ((R.BLOCK - 1, 900), (R.BLOCK, 901), (R.BLOCK + 1, 902), (3 * R.BLOCK + 7, 903)):
        rows += [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["Same.", f"T{t}.", f"U{t}", ""])) for t in range(n)]
    return rows


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TURNS).repartition(3)


def test_damage(spark):
    rows = conversations()
    got = R.damage(turn_frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_damage(rows))


def test_repair(spark):
    rows = [*conversations(), (5000, 1, "user", "x")] + [(c, 0, "user", "Dropped.") for c in range(6000, 6040)]
    df = turn_frame(spark, rows)
    got = {r[0]: tuple(r)[1:] for r in R.repair(R.damage(df), df).collect()}
    damaged = plain_damage(rows)
    assert set(got) == {r[0] for r in rows}
    assert set(got) - {r[0] for r in damaged}  # some conversations lose all
    for c in got:
        assert got[c] == plain_repair([r for r in damaged if r[0] == c]), c


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "So?"), (1, 2, "user", "So?"), (2, 0, "user", "open")]
    got = [tuple(r) for r in R.repaired_turns(turn_frame(spark, rows)).orderBy("conv_id", "place").collect()]
    # of equally cheap repairs the ASCII-least: IKKDI before RRD, and D before KI
    assert got == [("1", 0, "I", "user", ""), ("1", 1, "K", "assistant", "Hi."), ("1", 2, "K", "user", "So?"), ("1", 3, "I", "assistant", "")]


def test_search_meets_every_crossing():
    r = random.Random(2)
    for _ in range(400):
        codes = "".join(r.choice(R.CODES) for _ in range(r.randint(0, 4)))
        best = []

        def go(i, s, cost, audit, added):
            if i == len(codes) and s in (R.NONE, R.ASSISTANT):
                best.append((cost, audit))
            if added < 3:
                go(i, R._turned(s), cost + 2, audit + "I", added + 1)
            if i < len(codes):
                for at, to, c, e in R.arcs(codes[i]):
                    if at == s:
                        go(i + 1, to, cost + c, audit + e, 0)

        go(0, R.NONE, 0, "", 0)
        assert R.search(codes, R.NONE, (R.NONE, R.ASSISTANT)) == min(best), codes


def test_repair_of_an_empty_table(spark):
    df = turn_frame(spark, conversations()).limit(0)
    assert R.repair(R.damage(df), df).count() == 0


# ---- piece chunks

SPELL = [" ", "  ", "▁", "\n", "\t", "a", "b", "the", "ing", "é", "ß", "́", "<s>", "</s>", "<0x0A>", "\0", "\U0001f600", "漢", "​", "　", " ", ".", "1", "2024", "Word", "\r"]
DOCS = "doc_id long, text string, chunk string, ids string, n long, decoded string, item int"


def piece_texts():
    r = random.Random(4)
    texts = ["".join(r.choice(SPELL) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    return [*enumerate(texts), (2000, None), (2001, ""), (2002, " "), (2003, "word " * 30_000), (2004, "x" * 50_000), (2005, " " * 5_000), (None, "no id"), (3, texts[3]), (3, texts[3])]


def doc_frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1, "z", 2) for d, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize("table", [0, 5, 200_000])
def test_piece_chunks(spark, table):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=Q.piece_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = piece_texts()
    want = Counter()
    for d, t in rows:
        ids = library.encode(t or "")
        want[d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(map(tuple, C.encode_digests(doc_frame(spark, rows), Q.piece_model(), rows=table).collect())) == want


def test_the_table_holds_the_most_frequent_chunks_and_its_bound(spark):
    df = doc_frame(spark, [(i, "often often rare") for i in range(50)] + [(100 + i, "seldom") for i in range(3)] + [(200, "once " + "y" * 60)] * 3)
    assert set(C.chunk_table(df, Q.piece_model(), rows=1)) == {"often"}
    assert set(C.chunk_table(df, Q.piece_model(), rows=2)) == {"often", "rare"}
    assert set(C.chunk_table(df, Q.piece_model(), rows=100)) == {"often", "rare", "seldom", "once"}


def test_piece_round_trip(spark):
    rows = [(i, t) for i, t in piece_texts() if t and "▁" not in t]
    df = C.decode(C.encode(doc_frame(spark, rows), Q.piece_model()), Q.piece_model())
    assert all(r["decoded"] == r["text"] and r["n"] == 1 for r in df.collect())


def test_pieces_of_an_empty_table(spark):
    df = doc_frame(spark, piece_texts()).limit(0)
    assert C.encode_digests(df, Q.piece_model()).count() == 0 and C.encode(df, Q.piece_model()).count() == 0


# ---- lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    held = [(d, Counter(w), len(w)) for d, w in ((d, plain_terms(t)) for d, t in docs) if w]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for i, t in items:
        scored = []
        for d, tf, n in held:
            m = 50 + 50 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in set(plain_terms(t)) if w in tf)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def search_rows():
    r = random.Random(6)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(400)] + ["Émile", "naïve", "日本", "ÀB", "x_y", "it's", "A1", "a1"]
    make = lambda n: r.choice([" ", "\n", ", "]).join(r.choice(vocabulary) for _ in range(n))
    docs = [(d, make(r.randint(1, 80))) for d in range(300)] + [(400, None), (401, ""), (402, "?! ..."), (403, make(60_000)), (None, make(30)), (None, make(20))]
    docs += [docs[1], docs[1], docs[2], (500, docs[3][1]), (501, docs[3][1])]
    items = [(i, make(r.randint(1, 40))) for i in range(30)] + [(50, None), (51, ""), (52, "unheardof"), (53, docs[3][1]), (3, "w1 w1 w2")]
    items += [(60 + i, items[i][1] + " more w5") for i in range(8)]
    return docs, items


@pytest.mark.parametrize("terms, count", [(100_000, 4_000), (60, 4_000), (100_000, 7)])
def test_search(spark, monkeypatch, terms, count):
    monkeypatch.setattr(S, "BLOCK_TERMS", terms)
    monkeypatch.setattr(S, "BLOCK_ITEMS", count)
    docs, items = search_rows()
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in items], "item_id long, text string, rank int, score string").repartition(2)
    got = Counter(tuple(r) for r in S.search(doc_frame(spark, docs), frame, 50).collect())
    assert got == plain_search(docs, items, 50)


def test_sharing_makes_every_set_from_fewer_sums():
    r = random.Random(9)
    groups = [r.sample(range(200), 6) for _ in range(12)]
    sets = [sorted({x for g in r.sample(groups, 3) for x in g} | set(r.sample(range(200), 4))) for _ in range(60)]
    dag = S.Sharing(sets, 200)
    stands = {i: {i} for i in range(200)}
    for node, (x, y) in enumerate(dag.sums, 200):
        assert not stands[x] & stands[y]
        stands[node] = stands[x] | stands[y]
    for s, nodes in zip(sets, dag.sets):
        assert sorted(t for x in nodes for t in stands[x]) == s
    assert len(dag.sums) + sum(map(len, dag.sets)) < sum(map(len, sets)) / 2
    node_uses = Counter(k for s in dag.sets for k in s) + Counter(k for pair in dag.sums for k in pair)
    assert all(node_uses[node] > 0 for node in range(200, 200 + len(dag.sums)))


def test_search_of_empty_tables(spark):
    docs, items = search_rows()
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert S.search(doc_frame(spark, docs).limit(0), frame).count() == 0
    assert S.search(doc_frame(spark, docs), frame.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
