"""Language identification by error-correcting output codes.

Every language gets a binary codeword; one linear classifier over hashed
character n-grams (1 to 3, inside words with their edges) is trained per bit,
by logistic loss on snippets of different lengths.  A text is decoded to the
codeword of least weighted logistic loss; bits count by how well they separate
the training snippets.

A row is flagged ambiguous if even the nearest codeword is far (its loss exceeds
``FAR`` of the loss of a coin's margins: a language that was never learned) or if
the second codeword is not far enough behind (its loss exceeds the first one's by
less than ``GAP_SHARE`` of what all but ``CLEAN_MISS`` of known texts of about
that length show: texts in two languages).  What known texts show is measured on
labelled rows of the sample that take no part in the training.

Training uses a bounded sample: about ``rows_per_language`` labelled rows per
language (never more than four times that in all), chosen by a hash of the id;
a fifth of them, by another hash, only measures the gaps.  Prediction reads whole
texts, a chunk at a time.

Defined edge results: a null text or one without a letter gives ``und`` with
score 0; without any labelled row every text is ``und``; with one language
every text with a letter gets it, score 1; repeated rows agree; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import map_arrow

DIMENSIONS = 4096
ROWS_PER_LANGUAGE = 300
SNIPPET_WORDS = (2, 6, 20, 80)
FAR = 0.1               # of the loss that margins of zero have
GAP_SHARE = 0.65
CLEAN_MISS = 0.01
MEASURED_LEAST = 25     # sampled rows of a language from which on some only measure
SIZES = 16              # sizes (powers of two of n-grams) with gap limits of their own
EXHAUSTIVE_UP_TO = 5    # languages with an exhaustive code; more get a random one
STEPS = 100
CHUNK_CHARS = 1 << 19
UNDETERMINED = "und"


def codewords(k: int) -> np.ndarray:
    """k codewords of -1/+1: all non-trivial splits for few languages, else a
    random code with the largest minimum distance of 64 draws."""
    if k < 2:
        return np.zeros((k, 0), dtype=np.float32)
    if k <= EXHAUSTIVE_UP_TO:
        cols = [[1 if (c >> j) & 1 else -1 for j in range(k)] for c in range(1, 1 << (k - 1))]
        return np.array(cols, dtype=np.float32).T.copy()
    length = int(np.ceil(10 * np.log2(k)))
    best, best_distance = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.float32), (k, length))
        mixed = np.abs(code.sum(axis=0)) < k
        distance = min(int((code[i] != code[j])[mixed].sum()) for i in range(k) for j in range(i))
        if distance > best_distance:
            best, best_distance = code[:, mixed], distance
    return best


_STATE: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _STATE:
        table = np.zeros(0x110000, dtype=bool)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                table[i] = True
        _STATE["letters"] = table
    return _STATE["letters"]


def _grams(text: str, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cell, place) of every n-gram of the lower-cased text whose middle or last letter stands at ``low`` ... ``high`` - 1
    (the place behind the text closes its last word)."""
    high = len(text) + 1 if high is None else high
    c = np.frombuffer(text[max(0, low - 1):high + 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, 0)
    front = np.zeros(1 if low == 0 else 0, dtype=np.int64)
    c = np.concatenate([front, c, np.zeros(high - low + 2 - len(front) - len(c), dtype=np.int64)])
    a, b, d = c[:-2], c[1:-1], c[2:]
    cells, starts = [], []
    for n, keep, value in (
            (1, b > 0, b * 0x9E3779B1),
            (2, (a > 0) | (b > 0), a * 0x85EBCA77 + b * 0xC2B2AE3D + 0x27D4EB2F),
            (3, b > 0, a * 0x165667B1 + b * 0x7FEB352D + d * 0x846CA68B + 0x68E31DA4)):
        at = np.flatnonzero(keep)
        v = value[at]
        v = (v ^ (v >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        v = (v ^ (v >> 12)) * 0x297A2D39 & 0xFFFFFFFF
        cells.append((v ^ (v >> 15)) % DIMENSIONS)
        starts.append(low + at - (b[at] == 0))
    return np.concatenate(cells), np.concatenate(starts)


def _histograms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length vectors of square-rooted counts, and the number of n-grams (0: no letter)."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < CHUNK_CHARS):
            size += len(texts[high])
            high += 1
        group = [t.lower() for t in texts[low:high]]
        if len(group) == 1:
            for at in range(0, len(group[0]) + 1, CHUNK_CHARS):
                cells, _ = _grams(group[0], at, min(at + CHUNK_CHARS, len(group[0]) + 1))
                out[low] += np.bincount(cells, minlength=DIMENSIONS)
            low = high
            continue
        cells, starts = _grams("\n".join(group))
        ends = np.cumsum([len(t) + 1 for t in group])
        owner = np.searchsorted(ends, starts, side="right")
        np.minimum(owner, len(group) - 1, out=owner)
        out[low:high] = np.bincount(owner * DIMENSIONS + cells, minlength=len(group) * DIMENSIONS) \
            .reshape(len(group), DIMENSIONS)
        low = high
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9), np.rint(norm[:, 0].astype(np.float64) ** 2).astype(np.int64)


def _size(grams: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(grams, 1)).astype(int), 0, SIZES - 1)


def _snippets(text: str) -> list[str]:
    """Parts of a text in several lengths, at places that its length decides, and the whole."""
    words = text.split()
    out = [text]
    for j, n in enumerate(SNIPPET_WORDS):
        if len(words) > n:
            at = (len(text) * 2654435761 + j * 40503) % (len(words) - n + 1)
            out.append(" ".join(words[at:at + n]))
    return out


def _training_rows(batches):
    for batch in batches:
        langs, measures, wholes, size, index, value = [], [], [], [], [], []
        for lang, text, measure in zip(*(batch.column(i).to_pylist() for i in range(3))):
            vectors, grams = _histograms(_snippets(text))
            for j, (v, n) in enumerate(zip(vectors, grams)):
                if n:
                    at = np.flatnonzero(v)
                    langs.append(lang)
                    measures.append(measure)
                    wholes.append(j == 0)
                    size.append(n)
                    index.append(at.astype(np.int32))
                    value.append(v[at])
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(measures, pa.bool_()), pa.array(wholes, pa.bool_()), pa.array(size, pa.int64()),
             pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
            names=["lang", "measure", "whole", "size", "idx", "val"])


@dataclass
class Model:
    """Languages, their codewords, one weight column per bit (the last row is the bias), the bits' weights, and per
    size of a text the gap below which it is ambiguous."""
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray
    gap_limits: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The weighted loss of every codeword, per row of vectors."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        return np.logaddexp(0.0, -self.code[None, :, :] * margins[:, None, :]) @ self.bit_weights

    def decode(self, x: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score in 0..1, ambiguous) per row of vectors."""
        if len(self.languages) == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x)), np.zeros(len(x), dtype=bool)
        loss = self.losses(x)
        ranked = np.sort(loss, axis=1)
        p = np.exp(ranked[:, :1] - loss)
        far = ranked[:, 0] > FAR * np.log(2) * self.bit_weights.sum()
        close = ranked[:, 1] - ranked[:, 0] < self.gap_limits[_size(grams)]
        return loss.argmin(axis=1), 1 / p.sum(axis=1), far | close


def _gap_limits(model: Model, rows: list) -> np.ndarray:
    """Per size, the share of the gap that all but a few of the measuring snippets have; sizes without enough
    of them take the next smaller one's (0 below the first)."""
    limits = np.zeros(SIZES)
    if not rows or len(model.languages) < 2:
        return limits
    x = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["idx"]] = r["val"]
    loss, number = model.losses(x), {lang: i for i, lang in enumerate(model.languages)}
    own = np.array([number[r["lang"]] for r in rows])
    rest = loss.copy()
    rest[np.arange(len(rows)), own] = np.inf
    gap = rest.min(axis=1) - loss[np.arange(len(rows)), own]
    size = _size(np.array([r["size"] for r in rows]))
    for s in range(SIZES):
        if (size == s).sum() >= MEASURED_LEAST:
            limits[s] = max(0.0, GAP_SHARE * float(np.quantile(gap[size == s], CLEAN_MISS)))
        elif s:
            limits[s] = limits[s - 1]
    return limits


def _fit_bits(rows: list, languages: list[str]) -> Model:
    """Logistic regression per bit by accelerated gradient steps over the sparse snippet rows."""
    code = codewords(len(languages))
    number = {lang: i for i, lang in enumerate(languages)}
    y = code[[number[r["lang"]] for r in rows]]
    lens = np.array([len(r["idx"]) for r in rows])
    idx = np.concatenate([np.asarray(r["idx"], dtype=np.int64) for r in rows])
    val = np.concatenate([np.asarray(r["val"], dtype=np.float32) for r in rows])
    owner = np.repeat(np.arange(len(rows)), lens)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    # languages weigh alike, however many snippets they have
    share = np.bincount([number[r["lang"]] for r in rows], minlength=len(languages))
    weight = (1.0 / share[[number[r["lang"]] for r in rows]] / len(languages)).astype(np.float32)[:, None]
    w = np.zeros((DIMENSIONS + 1, code.shape[1]), dtype=np.float32)
    look, rate, penalty = w.copy(), 40.0, 1e-6

    def margins(m):
        return np.add.reduceat(val[:, None] * m[idx], starts, axis=0) + m[-1]

    for step in range(STEPS):
        g = -y / (1.0 + np.exp(np.clip(y * margins(look), -30, 30))) * weight
        grad = np.empty_like(w)
        for b in range(code.shape[1]):
            grad[:-1, b] = np.bincount(idx, weights=val * g[owner, b], minlength=DIMENSIONS)
        grad[-1] = g.sum(axis=0) * 0.1
        new = look - rate * (grad + penalty * look)
        look = new + (step / (step + 3.0)) * (new - w)
        w = new
    right = ((margins(w) * y > 0) * weight).sum(axis=0)
    return Model(languages, code, w, np.maximum(2 * right - 1, 0.01).astype(np.float32), np.zeros(SIZES))


def held_out(doc_id) -> F.Column:
    """The rows that training never sees: crc32 of the id as text, remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Model from a bounded sample of the labelled rows outside the held-out part; None without any."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()
                         & ~held_out(F.col(doc_id)))
    counts = {r[0]: r[1] for r in usable.groupBy(F.col(lang).cast("string").alias("lang")).count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30))
    chosen = None
    for value, n in sorted(counts.items()):
        rule = (F.col(lang) == value) & (draw < int(min(1.0, rows_per_language / n) * (1 << 30)))
        chosen = rule if chosen is None else chosen | rule
    sample = usable.filter(chosen).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
        (F.pmod(F.xxhash64(F.col(doc_id), F.lit("measure")), F.lit(5)) == 0).alias("measure")).limit(4 * rows_per_language * len(counts))
    rows = map_arrow(sample, _training_rows, "lang string, measure boolean, whole boolean, size long, idx array<int>, val array<float>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], len(r["idx"]), r["idx"], r["val"]))
    held = {x: [r for r in rows if r["lang"] == x and r["whole"]] for x in sorted({r["lang"] for r in rows})}
    measuring = {x for x, found in held.items() if len(found) >= MEASURED_LEAST and not all(r["measure"] for r in found)}
    model = _fit_bits([r for r in rows if not (r["measure"] and r["lang"] in measuring)], sorted(held))
    model.gap_limits = _gap_limits(model, [r for r in rows if r["measure"] and r["lang"] in measuring])
    return model


def _decide(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of each text."""
    x, grams = _histograms(texts)
    some = grams > 0
    if model is None or not some.any():
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    best, p, unsure = model.decode(x, grams)
    langs = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, some)]
    return langs, np.where(some, p, 0.0).astype(float), ~some | unsure


def _pieces(batches, size: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _predictor(model: Model | None):
    def run(batches):
        for piece in _pieces(batches):
            langs, scores, unsure = _decide(model, [t or "" for t in piece.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(unsure)],
                names=["doc_id", "lang_pred", "score", "ambiguous"])
    return run


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) per row."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = t.schema["doc_id"].dataType.simpleString()
    return map_arrow(t, _predictor(model), f"doc_id {id_type}, lang_pred string, score double, ambiguous boolean")


def _keeper(model: Model | None, column: int):
    def run(batches):
        for piece in _pieces(batches):
            langs, scores, unsure = _decide(model, [t or "" for t in piece.column(column).to_pylist()])
            known = np.array([x != UNDETERMINED for x in langs], dtype=bool)
            yield piece.filter(pa.array(known & ~unsure))
    return run


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without rows of undetermined language: no letter, or ambiguous.
    All columns stay as they are.  Without a labelled row nothing can be told
    apart and only rows without a letter go."""
    model = fit(docs, doc_id, text, lang)
    if model is None:
        return docs.filter(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))
    return map_arrow(docs, _keeper(model, docs.columns.index(text)), docs.schema)
