"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizations of a text end tokens at byte offsets; where a token of A and
one of B end together the text is cut into groups, and every A token of a group
is linked with every B token of it.  The ends of a block of texts (offsets
counted through the block, so that texts' ends are common ends) are merged along
merge paths: diagonals at equal distances divide the merge of the two sorted
lists into pieces of equal work, a binary search on each diagonal finds where
the path crosses it, and every piece is merged for itself and emits the ends
that both lists share.  What is open at a piece's border is stitched to the next
piece's first group.  A text of any length is many pieces, many short ones share
one.

How many documents hold a pair of ids linked is counted over the whole corpus:
each block reduces its documents' pairs to one row per pair first, so the
shuffles see pairs per block and not pairs per document.  The counts go back to
the blocks by a join on the pair and to the documents by a join on the block;
the documents keep their pairs as numbers of the block's sorted pairs.  Nothing
is broadcast or collected.

Defined edge results: texts that are null, empty, or whose tokens' bytes are not
the text's own have no tokens (zeros, an empty group string); strings of special
tokens are plain text; a repeated row is a document of its own and counts as
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import _ship, map_arrow, materialize, values_of
from airwell.llm._encode import rank_encoder

PIECE = 1 << 16             # merged ends per piece of a merge path
GROUP_CHARS = 1 << 20       # texts are aligned in groups of about this size
BLOCK_CHARS = 8 << 20       # pairs are reduced over blocks of about this size
WIDE = 64                   # links of a group above which its ids are counted before they are paired

_PIECES: dict[str, "PieceModel"] = {}


class PieceModel:
    """A sentencepiece model and the bytes of its ids."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(self.model.id_to_piece(list(range(n))))]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def piece_model(path: str) -> PieceModel:
    if path not in _PIECES:
        _PIECES[path] = PieceModel(path)
    return _PIECES[path]


# -- merge paths ---------------------------------------------------------------

def path_splits(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two strictly ascending arrays crosses every ``piece``-th diagonal:
    (i, j) so that a[:i] and b[:j] are the merge's first elements.  Equal ends stay together."""
    d = np.arange(piece, len(a) + len(b), piece, dtype=np.int64)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        # a[mid] is among the first d exactly if it is not behind b[d - mid - 1]
        open_ = low < high
        first = np.zeros(len(d), dtype=bool)
        first[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    i, j = low, d - low
    if len(b):
        split = (i > 0) & (j < len(b))
        split[split] = a[i[split] - 1] == b[j[split]]
        j = j + split       # an end of A at the border takes its equal of B along
    return np.concatenate([[0], i, [len(a)]]), np.concatenate([[0], j, [len(b)]])


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many elements of ``a`` and of ``b`` lie up to each end that both have."""
    cuts_a, cuts_b = [], []
    i, j = path_splits(a, b, piece)
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:]):
        x, y = a[i0:i1], b[j0:j1]
        if len(x) and len(y):
            at = np.searchsorted(y, x)
            both = at < len(y)
            both[both] = y[at[both]] == x[both]
            cuts_a.append(np.flatnonzero(both) + (i0 + 1))
            cuts_b.append(at[both] + (j0 + 1))
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *cuts_a]), np.concatenate([none, *cuts_b])


# -- groups of a few documents -------------------------------------------------

def _links(a, b, cut_a, cut_b):
    """(group, A id, B id, links) of every group: all pairs of its tokens.  Groups of many
    links have their equal ids counted first."""
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    from_a, from_b = cut_a - n_a, cut_b - n_b
    many = n_a * n_b > WIDE
    n = np.where(many, 0, n_a * n_b)
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    width = n_b[group]
    yield group, a[from_a[group] + k // width], b[from_b[group] + k % width], np.ones(len(group), dtype=np.int64)
    for g in np.flatnonzero(many).tolist():
        one, times = np.unique(a[from_a[g]:cut_a[g]], return_counts=True)
        two, more = np.unique(b[from_b[g]:cut_b[g]], return_counts=True)
        step = max(1, (1 << 20) // len(two))
        for low in range(0, len(one), step):
            x, t = one[low:low + step], times[low:low + step]
            yield (np.full(len(x) * len(two), g), np.repeat(x, len(two)), np.tile(two, len(x)),
                   np.repeat(t, len(two)) * np.tile(more, len(x)))


def _strings(ids, cuts):
    """The ids of each group in decimal, joined by commas."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]).astype(np.int32)), pc.cast(pa.array(ids), pa.string()))
    return pc.binary_join(lists, ",")


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as four planes of bytes (the upper ones are nearly all zero and compress away)."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """Documents whose pairs are reduced together."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.rows: list[tuple] = []             # (n_a, n_b, n_groups, n_links, groups_sha256, pairs, links)

    def add(self, tokens: list) -> None:
        """Align a few documents: (A ids, B ids) or None each, with the bytes' lengths of all ids."""
        len_a, len_b, docs = tokens
        held = [d for d in docs if d is not None]
        nothing = np.empty(0, dtype=np.int64)
        a = np.concatenate([nothing, *(d[0] for d in held)])
        b = np.concatenate([nothing, *(d[1] for d in held)])
        cut_a, cut_b = common_ends(np.cumsum(len_a[a]), np.cumsum(len_b[b]))
        stop_a = np.cumsum([len(d[0]) for d in held], dtype=np.int64)
        last = np.searchsorted(cut_a, stop_a, side="left") + 1 if held else nothing      # groups up to each document's end
        n_links = np.concatenate([[0], np.cumsum(np.diff(cut_a, prepend=0) * np.diff(cut_b, prepend=0))])
        owner = np.repeat(np.arange(len(held)), np.diff(last, prepend=0))
        keys, counts = [nothing], [nothing]
        bits_b = int(len(len_b) - 1).bit_length()
        bits = int(len(len_a) - 1).bit_length() + bits_b
        for group, x, y, n in _links(a, b, cut_a, cut_b):
            keys.append(owner[group] << bits | x << bits_b | y)
            counts.append(n)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        if len(counts) and counts.max() > 1:
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        else:
            keys, counts = np.unique(keys, return_counts=True)
        doc = keys >> bits
        pair = (keys >> bits_b & (1 << bits - bits_b) - 1) << 32 | keys & (1 << bits_b) - 1
        edges = np.searchsorted(doc, np.arange(len(held) + 1))
        text = pc.binary_join_element_wise(_strings(a, cut_a), _strings(b, cut_b), "|")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last]).astype(np.int32)), text), ";")
        ends, k = np.concatenate([[0], last]), 0
        for d in docs:
            if d is None:
                self.rows.append((0, 0, 0, 0, "", nothing, nothing))
                continue
            low, high = edges[k], edges[k + 1]
            self.rows.append((len(d[0]), len(d[1]), int(ends[k + 1] - ends[k]), int(n_links[ends[k + 1]] - n_links[ends[k]]),
                              hashlib.sha256(text[k].as_buffer()).hexdigest(), pair[low:high], counts[low:high]))
            k += 1

    def batch(self, doc_ids: pa.Array) -> pa.RecordBatch:
        """One row per document and one for the block's pairs; documents hold numbers of the block's sorted pairs."""
        pairs = [r[5] for r in self.rows]
        known, at, n = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
        edge = np.cumsum([0, *map(len, pairs)])
        numbers = [_planes(np.diff(at[x:y], prepend=0)) for x, y in zip(edge[:-1], edge[1:])]
        links = [_planes(r[6]) if not len(r[6]) or r[6].max() < 1 << 32 else r[6].astype("<i8").tobytes() + b"\0" for r in self.rows]
        count = len(self.rows)
        offsets = pa.array(np.array([0] * (count + 1) + [len(known)], dtype=np.int32))
        column = lambda i: pa.array([*(r[i] for r in self.rows), None], pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array([self.number] * (count + 1), pa.int64()),
            doc_ids.take(pa.array([*range(count), None], pa.int64())), column(0), column(1), column(2), column(3),
            pa.array([*(r[4] for r in self.rows), None], pa.string()),
            pa.array([*numbers, None], pa.binary()), pa.array([*links, None], pa.binary()),
            pa.ListArray.from_arrays(offsets, pa.array(known)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))],
            names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "numbers", "links", "pairs", "docs"])


def _tokens(a_model, b_model, text):
    """The ids of both, if the bytes of either are the text's own behind a space."""
    if not text:
        return None
    data, a = (" " + text).encode(), a_model.ids(" " + text)
    table = a_model.bytes
    if b"".join([table[i] for i in a]) != data:
        return None
    b, table = b_model.ids(text), b_model.bytes
    if b"".join([table[i] for i in b]) != data:
        return None
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _align(path_a: str, path_b: str):
    def run(batches):
        a_model, b_model = rank_encoder(path_a, literal=True), piece_model(path_b)
        len_a = np.zeros(max(a_model.bytes) + 1, dtype=np.int64)
        for i, x in a_model.bytes.items():
            len_a[i] = len(x)
        len_b = np.array([len(x) for x in b_model.bytes], dtype=np.int64)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            block, ids, first, held, size = _Block(number), batch.column(0), 0, [], 0
            for i, text in enumerate(values_of(batch.column(1), 64)):
                held.append(_tokens(a_model, b_model, text))
                size += len(text or "")
                if size >= GROUP_CHARS or i + 1 == len(ids):
                    block.add((len_a, len_b, held))
                    block.chars, held, size = block.chars + size, [], 0
                if block.chars >= BLOCK_CHARS or i + 1 == len(ids):
                    yield block.batch(ids.slice(first, i + 1 - first))
                    number, first = number + 1, i + 1
                    block = _Block(number)
    return run


def _sums(key, docs, pairs):
    """The documents of one block with what the corpus-wide counts of their pairs add up to."""
    order = np.argsort(pairs.column("pair").to_numpy())
    count, best = (pairs.column(c).to_numpy(zero_copy_only=False)[order] for c in ("count", "best"))
    n_best, total = [], []
    for numbers, links in zip(docs.column("numbers").to_pylist(), docs.column("links").to_pylist()):
        at = np.cumsum(_numbers(numbers))
        n = _numbers(links) if len(links) % 4 == 0 else np.frombuffer(links[:-1], dtype="<i8")
        n_best.append(int(n[best[at]].sum()))
        total.append(int((n * count[at]).sum()))
    return pa.table([*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()),
                     pa.array(total, pa.int64()), docs.column("groups_sha256")],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _blocks(docs: DataFrame, tokenizer_a: str, model_b: str, doc_id: str, text: str) -> tuple[DataFrame, str]:
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = t.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(t, _align(tokenizer_a, model_b), f"block long, doc_id {id_type}, n_a long, n_b long, n_groups long, "
                     "n_links long, groups_sha256 string, numbers binary, links binary, pairs array<long>, docs array<long>")
    return materialize(rows, "align-blocks"), id_type


def _pairs(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of, pair, docs): the pairs of each block; and (pair, count, best) over all blocks: a pair's documents, and whether no other
    pair of its A id has more."""
    each = blocks.filter(F.col("n_a").isNull()).select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p")) \
        .select(F.col("block").alias("of"), F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = materialize(each.groupBy("pair").agg(F.sum("docs").alias("count")), "align-counts")
    top = counts.groupBy(F.shiftright("pair", 32).alias("__a")).agg(F.max("count").alias("__top"))
    told = counts.join(top, F.shiftright("pair", 32) == F.col("__a")) \
        .select(F.col("pair").alias("__pair"), "count", (F.col("count") == F.col("__top")).alias("best"))
    return each, told


def align(docs: DataFrame, tokenizer_a: str, model_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    _ship(docs.sparkSession)
    blocks, id_type = _blocks(docs, tokenizer_a, model_b, doc_id, text)
    each, told = _pairs(blocks)
    back = each.join(told, F.col("pair") == F.col("__pair")).select("of", "pair", "count", "best")
    rows = blocks.filter(F.col("n_a").isNotNull()).drop("pairs", "docs")
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(
        _sums, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(docs: DataFrame, tokenizer_a: str, model_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The translation table: (a_id, b_id, n_docs, best) of every pair of ids that some document links."""
    _, told = _pairs(_blocks(docs, tokenizer_a, model_b, doc_id, text)[0])
    return told.select(F.shiftright("__pair", 32).alias("a_id"), F.col("__pair").bitwiseAND((1 << 32) - 1).alias("b_id"),
                       F.col("count").alias("n_docs"), "best")


def _groups(path_a: str, path_b: str):
    def run(batches):
        a_model, b_model = rank_encoder(path_a, literal=True), piece_model(path_b)
        for batch in batches:
            doc, first, stop, left, right = [], [], [], [], []
            for i, text in enumerate(values_of(batch.column(1), 64)):
                found = _tokens(a_model, b_model, text)
                if found is None:
                    continue
                a, b = found
                end = np.cumsum([len(a_model.bytes[x]) for x in a.tolist()])
                cut_a, cut_b = common_ends(end, np.cumsum([len(b_model.bytes[x]) for x in b.tolist()]))
                stops = end[cut_a - 1]
                doc += [i] * len(stops)
                first += [0, *stops[:-1].tolist()]
                stop += stops.tolist()
                left += [x.tolist() for x in np.split(a, cut_a[:-1])]
                right += [x.tolist() for x in np.split(b, cut_b[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(first, pa.int64()), pa.array(stop, pa.int64()),
                 pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                names=["doc_id", "start", "end", "a_ids", "b_ids"])
    return run


def groups(docs: DataFrame, tokenizer_a: str, model_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, a_ids, b_ids): every group with its bytes in the text behind a space."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(t, _groups(tokenizer_a, model_b),
                     f"doc_id {t.schema['doc_id'].dataType.simpleString()}, start long, end long, a_ids array<long>, b_ids array<long>")
