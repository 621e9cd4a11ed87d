"""Whole-text encoding with the tokenizers library, one word at a time.

A word-based tokenizer encodes a text as the concatenation of its pieces, when
the text is cut only where no token can cross.  Each worker keeps a bounded
table of pieces already encoded; the library sees the rest, many at a time.
The cut depends on the tokenizer's own description:

* byte-level with its regular expression and no normaliser: before every space
  that a non-space follows (white space before it stays with the left piece,
  where it is matched the same way), and around a line feed between two other
  characters;
* a split pattern that matches no white space and removes the rest: at white
  space; text is lower-cased first where the normaliser would do the same;
* anything else: not at all.

Merges in ascending rank are also what tiktoken does, without objects per token.
It is used where it is proved to give the library's ids: ids ascend in merge
order and every token of the vocabulary merges to itself (``_in_rank_order``).
Then a merge that joins two neighbours to a token's bytes is that token's own
merge: nothing has crossed the token's edges before, so its bytes were merged as
they are alone.  Everything outside that proof goes through the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TABLE_PIECES = 300_000      # a worker's table of encoded pieces is emptied beyond this
JOINED = 96                 # pieces per call into the library
GROUP_CHARS = 4 << 20       # texts are cut and encoded in groups of about this size

_SPACE_THEN_OTHER = re.compile(r" (?=\S)")
_WHITE_RUN = re.compile(r"[ \n](?:\s|\Z)|\x01")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_OTHER_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x01"
_ODD_WHITE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# fixed value: the pre-splitting pattern of byte-level vocabularies
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# blocks whose characters' classes are the same in all recent versions of Unicode
_STABLE = re.compile("[\x00-\u07ff\u1e00-\u20bf\u2100-\u214f\u2190-\u27bf]*")
_LONG_WHITE = re.compile(r"\s{1000}")
_WORD_END = "\x01"          # stands for the end-of-word suffix in the ranks of words
_TOKEN_ID = attrgetter("id")
_ENCODERS: dict[str, "Encoder"] = {}


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the rest for code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def encoder(path: str, table_pieces: int = TABLE_PIECES, group_chars: int = GROUP_CHARS) -> "Encoder":
    """The worker's encoder for a tokenizer file, made once; larger tables and
    groups encode fewer pieces again, at some 200 bytes a piece."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    found = _ENCODERS[path]
    found.table_pieces, found.group_chars = table_pieces, group_chars
    return found


def rank_encoder(path: str, literal: bool = False) -> "RankEncoder":
    """The worker's whole-text encoder of a byte-level file, made once; ``literal``
    reads the strings of special tokens as plain text."""
    key = f"{path} {literal}"
    if key not in _ENCODERS:
        _ENCODERS[key] = RankEncoder(path, literal)
    return _ENCODERS[key]


def _in_rank_order(merges: list, vocab: dict[str, int], alone=None) -> bool:
    """Whether ids ascend in merge order and every merged token merges to itself
    (``alone`` tells it for a token where the library can; else merges are followed here)."""
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    ids = [vocab[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(ids, ids[1:])) or len(set(pairs)) < len(pairs):
        return False
    if alone:
        return all(alone(a + b) == [i] for (a, b), i in zip(pairs, ids))
    rank, whole = {p: i for i, p in enumerate(pairs)}, {}
    for a, b in pairs:
        whole[a + b] = whole[a] + whole[b] if a in whole and b in whole else whole.get(a, (a,)) + whole.get(b, (b,))
    none = len(pairs)
    for token, symbols in whole.items():
        parts = list(symbols)
        while len(parts) > 1:
            found = [rank.get(p, none) for p in zip(parts, parts[1:])]
            best = min(found)
            if best == none:
                return False
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return True


class RankEncoder:
    """Whole texts through tiktoken where that is proved equal, else through the library.

    Texts with characters of blocks that are still being filled (their class may
    differ between versions of Unicode), with very long runs of white space, or
    with a special token's string (unless ``literal``) go to the library."""

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if literal:
            self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, pre = told["model"], told.get("pre_tokenizer") or {}
        added = [t["content"] for t in told.get("added_tokens", [])]
        self.special = [] if literal else added
        number = {s: b for b, s in enumerate(byte_symbols())}
        self.bytes = {i: bytes(number[c] for c in t) for t, i in model["vocab"].items()
                      if t not in added and all(c in number for c in t)}
        self.core = None
        plain = all(model.get(k) in (None, False, "") for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if plain and told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") \
                and not pre.get("add_prefix_space") and {bytes([b]) for b in range(256)} <= set(self.bytes.values()) \
                and _in_rank_order(model["merges"], model["vocab"], lambda t: [x.id for x in self.library.model.tokenize(t)]):
            import tiktoken
            self.core = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, special_tokens={},
                                          mergeable_ranks={b: i for i, b in self.bytes.items()})

    def ids(self, text: str) -> list[int]:
        if self.core is None or not (text.isascii() or _STABLE.fullmatch(text)) or _LONG_WHITE.search(text) \
                or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.core.encode_ordinary(text)

    def encode(self, texts):
        """The ids of each text (None: empty), as arrays of little-endian 32-bit numbers."""
        for t in texts:
            yield np.array(self.ids(t) if t else [], dtype="<u4")


def _odd(text: str) -> bool:
    """Whether a text has other white space than single spaces and line feeds inside it."""
    if not text.isascii():
        return _WHITE_RUN.search(text) is not None
    return "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text.endswith((" ", "\n")) \
        or any(c in text for c in _OTHER_ASCII)


def _space_pieces(text: str) -> list[str]:
    """Pieces of a text whose spaces are not all single: cut before every space that a non-space follows."""
    head, *rest = _SPACE_THEN_OTHER.split(text)
    rest = [" " + r for r in rest]
    return [head, *rest] if head else rest


def _lowered(text: str) -> str:
    """The text in lower case where the library's normaliser would give the same."""
    if text.isascii():
        return text.lower()
    if "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
        low = text.lower()
        if unicodedata.is_normalized("NFC", low):
            return low
    return text


class Encoder:
    table_pieces, group_chars = TABLE_PIECES, GROUP_CHARS

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, self.kind = told.get("pre_tokenizer") or {}, None
        split = pre.get("pretokenizers", [pre])[0]
        if told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") \
                and not pre.get("add_prefix_space"):
            self.kind = "space"
        elif split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") \
                and "[^\\s\\p{L}\\p{N}]" in split.get("pattern", {}).get("Regex", ""):
            self.kind = "white"
        self.model = self.library.model
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        special = [t for t in told.get("added_tokens", [])
                   if t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"])]
        self.ranks = self._word_ranks(told["model"]) if self.kind == "white" else None
        self.separator = (special[0]["content"], special[0]["id"]) if special and self.kind else None
        self._empty()

    def _word_ranks(self, model: dict):
        """tiktoken over whole words, each closed by a byte for the suffix, if that is proved equal."""
        suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
        number = {s: bytes([b]) for b, s in self.symbols.items()}
        if not suffix or any(model.get(k) not in (None, False, "") for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback")):
            return None
        first = max((vocab.get(s + suffix, 1 << 40) for s in number), default=0)
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if first >= min(merged, default=0) or not _in_rank_order(model["merges"], vocab):
            return None
        ranks, self.final = {}, np.zeros(max(vocab.values()) + 1, dtype=bool)
        for t, i in vocab.items():
            body, end = (t[:-len(suffix)], _WORD_END) if t.endswith(suffix) else (t, "")
            if all(c in number for c in body) and b"\x01" not in (b := b"".join(number[c] for c in body)):
                ranks[b + end.encode()] = i
                self.final[i] = bool(end)
        import tiktoken
        return tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", special_tokens={}, mergeable_ranks=ranks)

    # -- the table of encoded pieces: a number per piece, ids in one array --

    def _empty(self) -> None:
        self.number: dict[str, int] = {}
        self.ends = np.zeros(1 << 16, dtype=np.int64)       # ends[n + 1]: where the ids of piece n end
        self.ids = np.empty(1 << 18, dtype="<u4")

    def _add(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """New pieces with their ids one after the other; ``ends`` says where each one's end."""
        n, k = len(self.number), len(pieces)
        while n + k + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        low = self.ends[n]
        while low + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[low:low + len(ids)] = ids
        self.ends[n + 1:n + k + 1] = low + ends
        self.number.update(zip(pieces, range(n, n + k)))

    def _add_one(self, piece: str, ids: np.ndarray) -> None:
        self._add([piece], ids, np.array([len(ids)]))

    def _one(self, piece: str) -> np.ndarray:
        return np.asarray(self.library.encode(piece, add_special_tokens=False).ids, dtype="<u4")

    def _one_word(self, pieces: list[str]) -> list[str]:
        """The pieces that are one word of the pre-splitting pattern, of letters only, that no normaliser changes."""
        if self.kind == "space":
            return [p for p in pieces if (p[1:] if p[0] == " " else p).isalpha()]
        return [p for p in pieces if p.isalpha() and p == p.lower() and unicodedata.is_normalized("NFC", p)]

    def _learn(self, missing: list[str]) -> None:
        """Encode new pieces and add them to the table."""
        # a letter or digit and one final stop or comma are two pieces of either pattern
        both = [p for p in missing if len(p) > 1 and p[-1] in ".," and p[-2].isalnum()]
        need = {p[:-1] for p in both} | {p[-1] for p in both}
        missing = list((set(missing).difference(both) | need).difference(self.number))
        # single words go to the library's model at once, the rest through its whole chain
        words = self._one_word(missing)
        if words and self.ranks:
            ids = np.array(self.ranks.encode_ordinary(_WORD_END.join(words) + _WORD_END), dtype="<u4")
            self._add(words, ids, np.flatnonzero(self.final[ids]) + 1)
            missing = list(set(missing).difference(words))
        elif words:
            tokenize, space, ends, ids = self.model.tokenize, self.symbols[32], [], []
            for w in words:
                if not w.isascii():
                    w = w.encode().decode("latin-1").translate(self.symbols)
                elif w[0] == " ":
                    w = space + w[1:]
                ids.extend(map(_TOKEN_ID, tokenize(w)))
                ends.append(len(ids))
            self._add(words, np.array(ids, dtype="<u4"), np.array(ends))
            missing = list(set(missing).difference(words))
        plain = [p for p in missing if self.separator and "<|" not in p]
        if len(plain) < len(missing):
            for p in set(missing).difference(plain):
                self._add_one(p, self._one(p))
        mark, mark_id = self.separator or ("", -1)
        for block in range(0, len(plain), JOINED * 64):
            part = plain[block:block + JOINED * 64]
            groups = [part[i:i + JOINED] for i in range(0, len(part), JOINED)]
            found = self.library.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False)
            for g, e in zip(groups, found):
                ids = np.asarray(e.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == mark_id)
                if len(cuts) == len(g) - 1:
                    ends = np.append(cuts, len(ids)) - np.arange(len(g))
                    self._add(g, ids[ids != mark_id], ends)
                else:
                    for p in g:
                        self._add_one(p, self._one(p))
        if both:
            number = self.number
            pairs = np.fromiter((number[x] for p in both for x in (p[:-1], p[-1])), dtype=np.int64, count=2 * len(both))
            ids, ends = self._take(pairs)
            self._add(both, ids, ends[1::2])

    def _take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and where each one's end."""
        start = self.ends[numbers]
        length = self.ends[numbers + 1] - start
        stop = np.cumsum(length)
        total = int(stop[-1]) if len(stop) else 0
        kind = np.int32 if max(total, len(self.ids)) < 1 << 31 else np.int64
        source = np.repeat((start - (stop - length)).astype(kind), length)
        source += np.arange(total, dtype=kind)
        return self.ids[source], stop

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        got = list(map(self.number.get, pieces))
        unknown = [i for i, n in enumerate(got) if n is None]
        if unknown:
            self._learn(list({pieces[i] for i in unknown}))
            for i in unknown:
                got[i] = self.number[pieces[i]]
        return np.array(got, dtype=np.int64)

    # -- texts --------------------------------------------------------------

    def encode(self, texts):
        """The ids of each text (None: empty), as arrays of little-endian 32-bit numbers."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(t or "")
            if size >= self.group_chars:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]):
        if len(self.number) > self.table_pieces:
            self._empty()
        if not texts:
            return
        if self.kind is None:
            for t in texts:
                yield self._one(t) if t else np.empty(0, dtype="<u4")
            return
        if self.kind == "white":
            low = [_lowered(t) for t in texts]
            tidy = [" ".join(w for w in _WHITE.split(t) if w) if _ODD_WHITE.search(t) else t for t in low]
            words = pc.ascii_split_whitespace(pa.array(tidy, pa.large_string()))
            yield from self._gather(words, "", [""] * len(texts), {})
            return
        heads, tails, odd = [], [], {}
        for i, t in enumerate(texts):
            if _odd(t):
                odd[i] = _space_pieces(t)
                t = ""
            # line feeds become words of their own; a mark says that no space stood before a word
            head, space, tail = t.replace("\n", " \x01\n \x01").partition(" ")
            heads.append(head)
            tails.append(tail if space else None)
        words = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        yield from self._gather(words, " ", heads, odd)

    def _gather(self, words, lead: str, heads: list[str], odd: dict[int, list[str]]):
        """Ids of texts given as a list array of words (each with ``lead`` before
        it), with an optional first piece; texts in ``odd`` are lists of pieces."""
        flat = words.flatten().dictionary_encode()
        vocabulary = flat.dictionary.to_pylist()
        if lead:
            vocabulary = [lead + w if w[:1] != "\x01" else w[1:] for w in vocabulary]
        index = flat.indices.to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.full(len(vocabulary), -1, dtype=np.int64)
        real = [i for i, w in enumerate(vocabulary) if w]
        number[real] = self._numbers([vocabulary[i] for i in real])
        first = self._numbers([h for h in heads if h])
        extra = {i: self._numbers(p) for i, p in odd.items()}
        # after all learning: the table does not move any more
        number = number[index]
        if (number < 0).any():
            kept = number >= 0
            owner = np.repeat(np.arange(len(counts)), counts)[kept]
            number, counts = number[kept], np.bincount(owner, minlength=len(counts))
        out, stop = self._take(number)
        edges = np.concatenate([[0], stop])
        lead_ids, lead_stop = self._take(first)
        lead_edges = np.concatenate([[0], lead_stop])
        low = n_lead = 0
        for i, high in enumerate(np.cumsum(counts).tolist()):
            body = out[edges[low]:edges[high]]
            low = high
            if i in extra:
                yield self._take(extra[i])[0] if len(extra[i]) else body
            elif heads[i]:
                yield np.concatenate([lead_ids[lead_edges[n_lead]:lead_edges[n_lead + 1]], body])
                n_lead += 1
            else:
                yield body
