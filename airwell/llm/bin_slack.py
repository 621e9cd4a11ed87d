"""Packing by minimum bin slack.

Documents are encoded and closed with an end id.  What fills whole windows of
``capacity`` ids is cut off as it is; the rests (1 to ``capacity`` - 1 ids) are
packed window by window.  A window is seeded with the longest rest that is
left.  A subset-sum dynamic programme over the multiset of the other lengths
(one bit per reachable sum, copies of a length as shifts by its multiples, long
lengths first) finds the fill closest to capacity, and is walked back for how
often each length is used; since the walk takes a short length only where no
longer ones give the sum, short rests stay for later windows.  The same choice
is repeated as often as the counts allow.

A window that no multiset of what is left fills completely would be padded, and
no later window could use its seed better, since the multiset only shrinks.
All rests of the seed's length then go to a tape, laid end to end and cut at
every ``capacity`` ids; so a document is cut only where slack remains.  What
remains at the tape's end is cut at powers of two, which need no padding.

Only the number of rests per length (at most ``capacity`` - 1 numbers) goes to
the driver, and the plan has rows per choice and length, not per document.
Ranking the rests is a range sort of small rows with global positions; a look-up
of the position in the plan places them.  Ids are encoded once: rests keep them
in the written table, and only those on the tape read them again.

Defined edge results: a null or empty text is the end id alone; repeated rows
are packed each for itself; rows with a null id are packed like others; an
empty table gives no rows; other columns are ignored.
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
END_ID = 1
FLUSH_BYTES = 8 << 20       # ids handed on at a time
SMALL_TAPE = 200_000        # rests on the tape (some 50 bytes each without ids) up to which they are sent to the ids


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    """Windows of ``capacity`` ids and one shorter rest per document; the rest carries its ids."""
    def rows_of(column, out):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        return pa.RecordBatch.from_arrays(
            [column.take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:5]), pa.array(out[5], pa.binary())],
            names=names)

    def run(batches):
        end, wide = np.uint32(end_id).astype("<u4").tobytes(), 4 * capacity
        for batch in batches:
            out, held = [[] for _ in range(6)], 0
            for i, found in enumerate(encoder(path).encode(values_of(batch.column(1)))):
                data = found.tobytes() + end
                for low in range(0, len(data), wide):
                    part = data[low:low + wide]
                    keep = part if with_ids or len(part) < wide else None
                    for column, value in zip(out, (i, low // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, keep)):
                        column.append(value)
                    held += len(keep or b"")
                if held >= FLUSH_BYTES:
                    yield rows_of(batch.column(0), out)
                    out, held = [[] for _ in range(6)], 0
            if out[0]:
                yield rows_of(batch.column(0), out)
    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """A written table (piece, doc_id, start, length, ids_crc32, doc_tokens, ids): windows and rests of every
    document, each with a number of its own.  ``ids`` are little-endian; windows have them only ``with_ids``."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = map_arrow(t, _cut(tokenizer, capacity, end_id, with_ids),
                     f"doc_id {t.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, "
                     "doc_tokens long, ids binary")
    return materialize(rows.select(F.monotonically_increasing_id().alias("piece"), "*"), "slack-pieces")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often each length is used in the fill of ``room`` closest to it: bit s of
    ``reach`` says that some multiset of the lengths so far has the sum s."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        steps.append((length, reach))
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            copies = min(copies, left)
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            used[length] = n
    return used


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int, int]:
    """(rows, windows, tape): runs of consecutive rests in descending length.

    A row is (first position, first sequence, offset, uses, length, tape): rest i
    of the run is use i % uses of the length in sequence first + i // uses, or, on
    the tape, begins at first + i * length there.  ``windows`` sequences are full
    without a cut; ``tape`` is the tape's length."""
    counts = {n: c for n, c in lengths.items() if c > 0}
    position, at = {}, 0
    for n in sorted(counts, reverse=True):
        position[n], at = at, at + counts[n]
    rows, sequences, tape = [], 0, 0
    for seed in sorted(counts, reverse=True):
        while counts[seed]:
            counts[seed] -= 1
            used = best_fill(counts, capacity - seed)
            counts[seed] += 1
            used[seed] = used.get(seed, 0) + 1
            if sum(n * u for n, u in used.items()) < capacity:
                rows.append((position[seed], tape, 0, 1, seed, 1))
                tape += seed * counts[seed]
                counts[seed] = 0
                break
            times, offset = min(counts[n] // u for n, u in used.items()), 0
            for n in sorted(used, reverse=True):
                rows.append((position[n], sequences, offset, used[n], n, 0))
                position[n] += used[n] * times
                counts[n] -= used[n] * times
                offset += n * used[n]
            sequences += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 6), sequences, tape


def tape_ends(tape: int, capacity: int) -> np.ndarray:
    """Where the sequences of the tape's unfilled end start and stop: powers of two, the largest first."""
    rest = tape % capacity
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return tape - rest + np.cumsum([0, *sizes])


def _place(table: np.ndarray):
    def run(batches):
        for batch in batches:
            pos = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(table[:, 0], pos, side="right") - 1]
            i = pos - row[:, 0]
            on_tape = row[:, 5] == 1
            sequence = np.where(on_tape, -1, row[:, 1] + i // row[:, 3])
            offset = np.where(on_tape, row[:, 1] + i * row[:, 4], row[:, 2] + i % row[:, 3] * row[:, 4])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset), pa.array(on_tape)],
                                             names=[*batch.schema.names[:-1], "sequence_id", "offset", "on_tape"])
    return run


def _cut_tape(capacity: int, windows: int, tape: int, with_ids: bool):
    """Rests on the tape cut at its sequences' ends."""
    ends = tape_ends(tape, capacity)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            starts, totals, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for i, ids in enumerate(values_of(batch.column(4))):
                low, at, high = 0, int(places[i]), int(places[i]) + len(ids) // 4
                while at < high:
                    if at < ends[0]:
                        number, inside = at // capacity, at % capacity
                        stop = min(high, at - inside + capacity)
                    else:
                        k = int(np.searchsorted(ends, at, side="right")) - 1
                        number, inside = ends[0] // capacity + k, at - ends[k]
                        stop = min(high, int(ends[k + 1]))
                    part = ids[4 * low:4 * (low + stop - at)]
                    for column, value in zip(out, (i, starts[i] + low, stop - at, zlib.crc32(part), totals[i],
                                                   windows + number, inside, part if with_ids else None)):
                        column.append(value)
                    low, at = low + stop - at, stop
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:7]),
                 pa.array(out[7], pa.binary())], names=names)
    return run


def assign(rows: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The rows of a written table as ``pieces`` makes it, placed: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset[, ids]).  Numbers of sequences are not dense: windows of one document have negative ones."""
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    small = rows.filter(F.col("length") < capacity).select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    order = global_position(small, [F.col("length").desc(), "doc_id", "piece"], "slack-sorted", "pos")
    counts = {r["length"]: r["n"] for r in order.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table, windows, tape = plan(counts, capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields)
    placed = map_arrow(order.select(*small.columns, "pos"), _place(table), f"{schema}, sequence_id long, offset long, on_tape boolean")
    full = rows.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("piece"), "offset": F.lit(0).cast("long")})
    whole = placed.filter(~F.col("on_tape"))
    ids = rows.filter(F.col("length") < capacity).select(F.col("piece").alias("__piece"), "ids")
    if with_ids:
        whole = whole.join(ids, F.col("piece") == F.col("__piece"))
    on_tape = placed.filter("on_tape").select("piece", "doc_id", "start", "doc_tokens", "offset")
    if int((np.diff(table[:, 0], append=sum(counts.values())) * table[:, 5]).sum()) <= SMALL_TAPE:
        on_tape = F.broadcast(on_tape)      # the plan tells the number of rows; more are joined by a shuffle
    cut = ids.join(on_tape, F.col("piece") == F.col("__piece")).select("doc_id", "start", "doc_tokens", "offset", "ids")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    cut = map_arrow(cut, _cut_tape(capacity, windows, tape, with_ids),
                    f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return full.select(*out).unionByName(whole.select(*out)).unionByName(cut.select(*out))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of ``docs``."""
    return assign(pieces(docs, tokenizer, capacity, end_id, doc_id, text), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """The packed sequences: (sequence_id, n_tokens, doc_ids, ids as little-endian bytes); a group holds at most
    ``capacity`` ids."""
    placed = assign(pieces(docs, tokenizer, capacity, end_id, doc_id, text, with_ids=True), capacity, with_ids=True)
    groups = placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    joined = F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return groups.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), joined.alias("ids"))
