"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled into a deterministic automaton over token labels, one
merge gadget after the other.  It starts with one state that has a loop for
every symbol.  The gadget of a merge (u, v) with label w = uv acts on every
state that an arc labelled u enters and an arc labelled v leaves: u-arcs are
led into a copy of that state without the v-arc, and the state before gets a
w-arc to where v led.  A label sequence is a path of the finished automaton if
and only if it is the tokenization of the text it spells; so for every prefix
of a word exactly one state is reached.

All arcs with one label enter one state, so states are named by labels.  A
state is stored as the difference to the state it was copied from: state(w)
branched off state(v) when w was made, and from then on lost arcs of its own.
The table of an arc (state u, label t) follows from two chains: the states u
branched from, with the time of each branching, and the labels that t's arc
was derived from (its first parts), with the time of each derivation.  An arc
is missing when one of these states lost one of these labels' arcs in between.
Looked-up entries are kept in the transition table.

Encoding walks a word once, from symbol to symbol: for each place it takes the
one label, among those that end there, with an arc from the state at the
label's start.  Decoding emits the arc labels of the path.

Defined edge results: a null or empty text has no ids and decodes to the empty
text; the strings of special tokens in a text are their ids, as in the library;
repeated rows agree; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import map_arrow, values_of
from airwell.llm._encode import byte_symbols

WORD_TABLE = 500_000        # a worker's table of encoded words is emptied beyond this
GROUP_CHARS = 6 << 20       # texts are learned in groups of about this size
ARC_TABLE = 1_000_000       # and so is its transition table
NEVER = 1 << 60

_IDS, _LABELS, _COUNT = itemgetter(0), itemgetter(1), itemgetter(2)
_AUTOMATA: dict[str, "Automaton"] = {}
_BREAK = regex.compile("[\t-\r \x85\\p{Z}]+")
_CONTROL = regex.compile("[\x1c-\x1f]")


def automaton(path: str) -> "Automaton":
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(path)
    return _AUTOMATA[path]


class Automaton:
    """The automaton of a word-end BPE vocabulary and its pre-splitting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.labels = {i: t for t, i in self.ids.items()}
        self.decimal = {i: str(i) for i in self.labels}
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.labels.update({i: t for t, i in self.special.items()})
        self._cut_special = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(split)
        self._compile([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.word_table: dict[str, tuple[str, str, int]] = {}
        self.chunk_table: dict[str, tuple[str, str, int]] = {}

    # -- construction ------------------------------------------------------

    def _compile(self, merges: list[tuple[str, str]]) -> None:
        ids = self.ids
        self.width = max(ids.values()) + 1
        base = [s for s in ids if len(s.removesuffix(self.end) if self.end else s) == 1]
        # chains end at symbols; gadgets extend them merge by merge
        branched: dict[int, tuple[tuple[int, int], ...]] = {ids[s]: ((ids[s], NEVER),) for s in base}
        derived: dict[int, tuple[tuple[int, int], ...]] = dict(branched)
        lost: dict[int, int] = {}
        for time, (u, v) in enumerate(merges):
            a, b, w = ids[u], ids[v], ids[u + v]
            lost.setdefault(a * self.width + b, time)                    # the copy of state(u) has no v-arc
            if w not in branched:
                branched[w] = ((w, NEVER), *((s, min(t, time)) for s, t in branched[b]))
                derived[w] = ((w, NEVER), *((s, min(t, time)) for s, t in derived[a]))
        self._branched, self._derived, self._lost = branched, derived, lost
        self.by_text = {s: i for s, i in ids.items() if i in branched}
        # how far back a label may start, by the last two symbols before its end
        self.back: dict[str, int] = {}
        self.back_end: dict[str, int] = {}
        for label in self.by_text:
            final = bool(self.end) and label.endswith(self.end)
            text = label.removesuffix(self.end) if final else label
            far = self.back_end if final else self.back
            far[text[-2:]] = max(far.get(text[-2:], 1), len(text))
        self.arcs: dict[int, bool] = {}

    def arc(self, state: int, label: int) -> bool:
        """Whether ``label`` leaves state(``state``)."""
        key = state * self.width + label
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > ARC_TABLE:
                self.arcs.clear()
            known = True
            for s, branch in self._branched[state]:
                for t, derivation in self._derived[label]:
                    time = self._lost.get(s * self.width + t, NEVER)
                    if time < branch and time <= derivation and time != NEVER:
                        known = False
            self.arcs[key] = known
        return known

    def paths(self, words: list[str]):
        """(word, labels of its path) of every word, a string of symbols, in
        sorted order: what the walk of a word shares with the one before is kept."""
        by_text, arcs, width, end = self.by_text, self.arcs, self.width, self.end
        reached, came = [-1], [0]       # label that ends at a place, and where it starts
        before = ""
        for word in sorted(words):
            n = len(word)
            keep = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                keep += 1
            keep = min(keep, n - 1, max(len(before) - 1, 0))
            del reached[keep + 1:], came[keep + 1:]
            for j in range(keep + 1, n + 1):
                if j < n:
                    far, tail = self.back.get(word[max(0, j - 2):j], 1), ""
                else:
                    far, tail = self.back_end.get(word[max(0, j - 2):], 1) if end else self.back.get(word[max(0, j - 2):], 1), end
                for i in range(max(0, j - far), j):
                    label = by_text.get(word[i:j] + tail)
                    if label is not None:
                        if i == 0:
                            break
                        state = reached[i]
                        known = arcs.get(state * width + label)
                        if self.arc(state, label) if known is None else known:
                            break
                else:
                    raise ValueError(f"no path for {word!r}: a symbol is not in the vocabulary")
                reached.append(label)
                came.append(i)
            before, labels, j = word, [], n
            while j:
                labels.append(reached[j])
                j = came[j]
            yield word, labels[::-1]

    # -- texts -------------------------------------------------------------

    def _split(self, chunk: str) -> list[str]:
        """The words of a chunk without white space, as symbols: normalised, pre-split."""
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if len(low) > 1 and low[-1] in ".," and low[:-1].isalpha():
                return [low[:-1], low[-1]]
        else:
            text = unicodedata.normalize("NFC", chunk)
            low = "".join(c.lower() for c in text)
        found = self._words.findall(low)
        return [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.symbols) for w in found]

    def _learn(self, chunks) -> None:
        """Walk the new words of new chunks and add both to their tables."""
        if len(self.word_table) > WORD_TABLE:
            self.word_table.clear()
        split = {c: self._split(c) for c in chunks}
        words, labels, decimal = self.word_table, self.labels, self.decimal
        for word, path in self.paths(list({w for ws in split.values() for w in ws if w not in words})):
            words[word] = (" ".join([decimal[i] for i in path]), " ".join([labels[i] for i in path]), len(path))
        for c, ws in split.items():
            parts = [words[w] for w in ws]
            self.chunk_table[c] = parts[0] if len(parts) == 1 else (
                " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum(p[2] for p in parts))

    def _pieces(self, text: str) -> list[str]:
        """The chunks and special tokens of a text."""
        if not (self._cut_special and any(s in text for s in self.special)):
            return [c for c in _BREAK.split(text) if c] if _CONTROL.search(text) else text.split()
        out = []
        for part in self._cut_special.split(text):
            out += [part] if part in self.special else [c for c in _BREAK.split(part) if c]
        return out

    def _entries(self, texts):
        """Per text, (ids, labels, count) of its pieces; new pieces are learned a group of texts at a time."""
        group, size = [], 0
        for t in [*texts, None]:
            if t is not None:
                group.append(self._pieces(t))
                size += len(t)
            if t is None or size >= GROUP_CHARS:
                table = self.chunk_table
                table.update((s, (str(i), s, 1)) for s, i in self.special.items())
                new: set[str] = set()
                for pieces in group:
                    new |= set(pieces).difference(table)
                if new:
                    # a full table is emptied first, so what the group needs is learned anew
                    if len(table) > WORD_TABLE:
                        table.clear()
                        table.update((s, (str(i), s, 1)) for s, i in self.special.items())
                        new = {p for pieces in group for p in pieces}.difference(table)
                    self._learn(new)
                get = table.__getitem__
                for pieces in group:
                    yield list(map(get, pieces))
                group, size = [], 0

    def encode(self, texts):
        """The ids of each text (None: empty)."""
        for entries in self._entries(t or "" for t in texts):
            yield [int(i) for e in entries for i in e[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The arc labels of a path, joined as the library does without a decoder."""
        return " ".join(self.labels[i] for i in ids)

    def digests(self, texts):
        """(number of ids, decimal ids joined by spaces, decoded text) of each text."""
        for entries in self._entries(t or "" for t in texts):
            yield sum(map(_COUNT, entries)), " ".join(filter(None, map(_IDS, entries))), " ".join(filter(None, map(_LABELS, entries)))


def _ids_of(path: str):
    def run(batches):
        a = automaton(path)
        for batch in batches:
            ids = list(a.encode(values_of(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return run


def _texts_of(path: str):
    def run(batches):
        a = automaton(path)
        for batch in batches:
            texts = [None if x is None else a.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return run


def _digests_of(path: str):
    def run(batches):
        a = automaton(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for count, decimal, text in a.digests(values_of(batch.column(1))):
                n.append(count)
                ids.append(hashlib.sha256(decimal.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _rows(df: DataFrame, doc_id: str, value: str) -> tuple[DataFrame, str]:
    t = df.select(F.col(doc_id).alias("doc_id"), F.col(value).alias("value"))
    return t, t.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) per row."""
    t, id_type = _rows(docs, doc_id, text)
    return map_arrow(t, _ids_of(tokenizer), f"doc_id {id_type}, ids array<int>")


def decode(rows: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) per row of ids."""
    t, id_type = _rows(rows, doc_id, ids)
    return map_arrow(t, _texts_of(tokenizer), f"doc_id {id_type}, text string")


def digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding of every row, as hashes."""
    t, id_type = _rows(docs, doc_id, text)
    return map_arrow(t, _digests_of(tokenizer),
                     f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
