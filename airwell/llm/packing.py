"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are encoded, closed with an end id and cut into pieces of at most
``capacity`` ids.  Pieces are range-sorted by length (long first), gaps by
size.  One round places all pieces of one length: a sweep from that length
upwards visits the gaps in ascending size, so every piece meets its successor,
the smallest gap that holds it; where several pieces want the same gap the
piece's rank in the sorted order decides; used gaps shrink, pieces without a
gap open new sequences, and the next shorter length follows.

Equal lengths and equal gaps are interchangeable, so a sweep works on runs
(size, count).  There are at most ``capacity`` lengths, and the run table
depends on them and not on the number of pieces; it is the only thing the
driver holds.  Ranking and placing the pieces themselves is distributed: a
range sort with global positions, then a lookup of each position in the plan.

Defined edge results: a null or empty text is one piece of one id (the end
id); repeated rows are packed each for itself; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import global_position, map_arrow, materialize, values_of
from airwell.llm._encode import encoder

CAPACITY = 2048
END_ID = 0


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = values_of(batch.column(1))
            end = np.uint32(END_ID).astype("<u4").tobytes()
            for i, found in enumerate(encoder(path).encode(texts)):
                data = found.tobytes() + end
                for j, low in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[low:low + 4 * capacity]
                    doc.append(i)
                    piece.append(j)
                    start.append(low // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {t.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return map_arrow(t, _cut(tokenizer, capacity, with_ids), schema + (", ids array<int>" if with_ids else ""))


def plan(lengths: dict[int, int], capacity: int) -> np.ndarray:
    """Rounds of best fit over runs: rows (first position, first sequence, place)
    of consecutive pieces in consecutive sequences.

    ``lengths`` maps a length to its number of pieces; positions count pieces in
    descending length."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]   # size -> runs (first sequence, count)
    rows: list[tuple[int, int, int]] = []
    position = sequences = 0

    def fill(size: int, first: int, count: int, length: int, left: int) -> int:
        """Place pieces into ``count`` equal gaps, as many to a gap as it holds, gap after gap; returns how many."""
        nonlocal position
        depth = size // length
        full, extra = divmod(min(left, depth * count), depth)
        for layer in range(depth):
            if full:
                rows.append((position, first, capacity - size + layer * length))
                position += full
        if full:
            gaps[size - depth * length].append((first, full))
        for layer in range(extra):
            rows.append((position, first + full, capacity - size + layer * length))
            position += 1
        if extra:
            gaps[size - extra * length].append((first + full, 1))
        rest = count - full - bool(extra)
        if rest:
            gaps[size].append((first + count - rest, rest))
        return full * depth + extra

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        for size in range(length, capacity + 1):
            runs, gaps[size] = gaps[size], []
            for n, (first, count) in enumerate(runs):
                if not left:
                    gaps[size] += runs[n:]
                    break
                left -= fill(size, first, count, length, left)
            if not left:
                break
        if left:
            count = -(-left // (capacity // length))
            first, sequences = sequences, sequences + count
            fill(capacity, first, count, length, left)
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def _place(table: np.ndarray):
    def run(batches):
        for batch in batches:
            pos = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(table[:, 0], pos, side="right") - 1
            found = table[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found[:, 1] + pos - found[:, 0]), pa.array(found[:, 2])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])
    return run


def assign(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ...; 1 <= length <= capacity) with sequence_id and offset."""
    rows = materialize(rows, "pack-pieces")     # the range sort reads its input twice
    sorted_rows = global_position(rows, [F.col("length").desc(), "doc_id", "piece", "start"], "pack-sorted", "pos")
    lengths = {r["length"]: r["n"] for r in sorted_rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = plan(lengths, capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_arrow(sorted_rows.select(*rows.columns, "pos"), _place(table), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    return assign(pieces(docs, tokenizer, capacity, doc_id, text), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences: (sequence_id, n_tokens, doc_ids, ids); a group holds at most ``capacity`` ids."""
    rows = pieces(docs, tokenizer, capacity, doc_id, text, with_ids=True)
    placed = assign(rows, capacity).groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return placed.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))
