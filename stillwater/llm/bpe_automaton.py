"""Byte-pair encoding and decoding with a deterministic automaton over tokens."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import map_arrow, per_worker

#: Separators that Python's str.split knows and the tokenizer's white space does not have.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words whose ids a worker remembers, and chunks of the newest generation; the one before is kept too.
REMEMBERED = 150_000
#: Marks that are a word of their own behind another one.
MARKS = frozenset(",.;:!?")
#: Compiled states of the spelling automaton that a worker keeps.
STATES = 300_000


class State(dict):
    """A state of the spelling automaton: its arcs by symbol, compiled as they are met, and the token that ends where it stands.

    ``open`` holds the tokens that may be on their way: for each, the token before it
    and the node of the label tree that its beginning leads to.
    """

    __slots__ = ("automaton", "open", "ended", "last")

    def __init__(self, automaton: TokenAutomaton, open_: tuple[tuple[int, dict], ...], ended: int) -> None:
        super().__init__()
        self.automaton, self.open, self.ended = automaton, open_, ended
        self.last: dict[str, int] = {}

    def __missing__(self, symbol: str) -> State:
        to = self[symbol] = self.automaton.after(self, symbol)
        return to


class TokenAutomaton:
    """The automaton whose accepted token sequences are exactly those that the merges produce.

    It starts as one state with a loop for each base symbol.  The gadget of a
    merge (a, b) -> c, applied merge by merge:

    * wherever an arc ``a`` leads to a state with an arc ``b``, the arc ``a``
      now leads to a copy of that state without ``b``;
    * the place that had the arc ``a`` gets an arc ``c`` to where ``b`` led.

    So the state after an arc depends on its label alone: the state of ``c``
    begins as the state that ``b`` led to at that time, and a state has the
    arc ``c`` if it had the arc ``a`` then.  ``left``, ``right`` and ``time``
    keep these inheritances, ``removed`` the arcs that gadgets took away;
    ``step`` reads a transition off them and keeps it in the transition table.
    A merge that no path can use (its arc ``b`` was gone) gives a dead token.

    For spelling, its arcs are labelled by symbols instead of tokens and the
    result is made deterministic as far as texts use it: a ``State`` is the set
    of tokens that may be under way, and a word takes one table step a symbol.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>") -> None:
        self.end, self.vocab = end, vocab
        self.label = {i: s for s, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.time: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        made = {a + b for a, b in merges}
        self.alive = {s: i for s, i in vocab.items() if s not in made}
        self.table: dict[tuple[int, int], bool] = {}
        for t, (a, b) in enumerate(merges):
            x, y, c = vocab[a], vocab[b], vocab[a + b]
            if a not in self.alive or b not in self.alive or not self._has_arc(x, y, t):
                continue
            self.removed[x, y] = t
            if a + b not in self.alive:
                self.left[c], self.right[c], self.time[c] = x, y, t
                self.alive[a + b] = c
        #: The tree of live labels: a node holds its children by symbol, the id of its label (``""``) and that of its label at a word's end (``end``).
        self.tree: dict = {}
        self.size: dict[int, int] = {}
        for label, i in self.alive.items():
            last = label.endswith(end)
            body = label.removesuffix(end) if last else label
            node = self.tree
            for symbol in body:
                node = node.setdefault(symbol, {})
            if body:
                node[end if last else ""] = i
                self.size[i] = len(body)
        self._forget()

    def _has_arc(self, x: int, y: int, before: float) -> bool:
        """Whether the state after ``x`` has an arc ``y`` once the gadgets of the merges below ``before`` are in."""
        time, removed = self.time, self.removed
        limit = before - 0.5
        while True:
            if removed.get((x, y), 1e18) <= limit:
                return False
            tx, ty = time.get(x, -1), time.get(y, -1)
            if tx < 0 and ty < 0:
                return True
            if ty >= tx:  # the arc came with its left part, after this merge took effect
                limit, y = ty, self.left[y]
            else:  # the state came from its right part, before this merge took effect
                limit, x = tx - 0.5, self.right[x]

    def step(self, x: int, y: int) -> bool:
        """The transition table, filled as transitions are met."""
        key = (x, y)
        found = self.table.get(key)
        if found is None:
            if len(self.table) > 1_000_000:
                self.table.clear()
            found = self.table[key] = self._has_arc(x, y, 1e17)
        return found

    def _forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = State(self, ((-1, self.tree),), -1)

    def after(self, state: State, symbol: str) -> State:
        """Compile an arc: every open token that goes on with the symbol; the one that ends there opens the next.

        The path to a place is unique, so one token at most ends there, and
        states with the same open tokens are one.
        """
        ended, going, key, known = -1, [], [], self.table.get
        for before, node in state.open:
            if symbol in node:
                node = node[symbol]
                going.append((before, node))
                key += (before, id(node))
                c = node.get("", -1)
                if c >= 0 and (before < 0 or (way := known((before, c))) or (way is None and self.step(before, c))):
                    ended = c
        if ended >= 0:
            going.append((ended, self.tree))
        key = (ended, *key)
        found = self.states.get(key)
        if found is None:
            if len(self.states) > STATES:
                self._forget()
            found = self.states[key] = State(self, tuple(going), ended)
        return found

    def closing(self, state: State, symbol: str) -> int:
        """The token that ends a word with its last symbol; -1 if none does."""
        for before, node in state.open:
            c = node.get(symbol, {}).get(self.end, -1)
            if c >= 0 and (before < 0 or self.step(before, c)):
                return c
        return -1

    def encode_word(self, word: str) -> list[int]:
        """The labels of the only path that spells ``word``: one arc of the spelling automaton for each symbol, then back from the end token by token."""
        state, states = self.start, []
        for symbol in word[:-1]:
            state = state[symbol]
            states.append(state)
        symbol = word[-1]
        c = state.last.get(symbol)
        if c is None:
            c = state.last[symbol] = self.closing(state, symbol)
        if c < 0:
            raise ValueError(f"no path spells {word!r}")
        path, at = [c], len(word) - self.size[c]
        while at > 0:
            c = states[at - 1].ended
            path.append(c)
            at -= self.size[c]
        path.reverse()
        return path


#: Chunks of printable ASCII and precomposed Latin-1 letters are their own normal form, so that they
#: can be lower-cased and split here just as the library does it.
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+").findall


class Encoder:
    """Whole texts to ids and back for a tokenizer file of the word-end kind.

    Words are spelled by the token automaton, or with ``library`` by the model
    of the tokenizers library, which needs no automaton.
    """

    def __init__(self, tokenizer_json: str, limit: int = REMEMBERED, library: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        spec, tok = json.loads(tokenizer_json), Tokenizer.from_str(tokenizer_json)
        self.normalise, self.split = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.symbols = {i: as_bytes(chr(i))[0][0] for i in range(0xC0, 0x100)}
        model = spec["model"]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.labels = {i: s for s, i in (*model["vocab"].items(), *self.added.items())}
        if library:
            tokens = tok.model.tokenize
            self.spell = lambda word: [t.id for t in tokens(word)]
        else:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.automaton = TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
            self.spell = self.automaton.encode_word
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda s: [s]
        self.limit = limit
        self.words: dict[str, list[int]] = {}  # of frequent words
        self.chunks: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def _word(self, word: str) -> list[int]:
        if len(self.words) > self.limit:
            self.words.clear()
        found = self.words[word] = self.spell(word)
        return found

    def ids(self, text: str) -> list[int]:
        """The ids of a text: added tokens first, then normalised and pre-split words by the automaton."""
        out: list[int] = []
        get, make = self.words.get, self._word
        for part in self.parts(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                if PLAIN(part):
                    part = part.lower()
                    words = PLAIN_WORDS(part)
                    if not part.isascii():
                        words = [w.translate(self.symbols) for w in words]
                else:
                    words = [w for w, _ in self.split(self.normalise(part))]
                for w in words:
                    out += get(w) or make(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by a space as a tokenizer without decoder does; special ones too."""
        return " ".join(map(self.labels.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """What a chunk amounts to; a mark behind a word is a word of its own, so that the word is remembered once."""
        if chunk[-1] in MARKS and (word := chunk[:-1]).isalpha() and PLAIN(word):
            (i, d), (j, e) = self.chunks.get(word) or self._chunk(word), self.chunks.get(chunk[-1]) or self._chunk(chunk[-1])
            return f"{i} {j}", f"{d} {e}"
        found = self.older.get(chunk)
        if found is None:
            if chunk.isalpha() and PLAIN(chunk):
                word = chunk.lower()
                ids = self.spell(word if word.isascii() else word.translate(self.symbols))
            else:
                ids = self.ids(chunk)
            found = " ".join(map(str, ids)), self.decode(ids)
        if len(self.chunks) > self.limit:  # what is frequent comes back from the older half
            self.older = self.chunks.copy()
            self.chunks.clear()
        self.chunks[chunk] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the ids as decimal text and the decoded text; no token reaches across white space."""
        if any(c in text for c in NOT_SPACE):
            ids = self.ids(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        get, make = self.chunks.get, self._chunk
        found = [get(c) or make(c) for c in text.split()]
        if not found:
            return 0, "", ""
        ids, labels = (" ".join(part) for part in zip(*found))
        return ids.count(" ") + 1, ids, labels


def encode_digests(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null and empty text give no ids; a text of any length is encoded whole.
    Repeated rows, equal texts and null identifiers give a row each, an empty
    table none; other columns are not looked at.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def make():
        digest, sha = per_worker("tokens", spec.value, Encoder).digest, lambda s: hashlib.sha256(s.encode()).hexdigest()

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(n, sha(i), sha(d)) for n, i, d in (digest(t or "") for t in b.column(1).to_pylist())]
            n, i, d = zip(*rows)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return f

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer_json: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add the ids of ``text_col`` as ``out_col``; null text gives an empty list."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    docs = docs.drop(out_col)
    schema = StructType([*docs.schema, StructField(out_col, ArrayType(IntegerType()))])
    at = docs.columns.index(text_col)

    def make():
        ids = per_worker("tokens", spec.value, Encoder).ids
        return lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array([ids(t or "") for t in b.column(at).to_pylist()], pa.list_(pa.int32()))], [*b.schema.names, out_col])

    return map_arrow(docs, make, schema)


def decode(rows: DataFrame, tokenizer_json: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded text of ``ids_col`` as ``out_col``; null ids give an empty text."""
    spec = rows.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = rows.drop(out_col)
    at = rows.columns.index(ids_col)

    def make():
        text = per_worker("tokens", spec.value, Encoder).decode
        return lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array([text(i or []) for i in b.column(at).to_pylist()], pa.string())], [*b.schema.names, out_col])

    return map_arrow(rows, make, StructType([*rows.schema, StructField(out_col, StringType())]))
