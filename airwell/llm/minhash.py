"""MinHash near-duplicates with circulant permutations.

Shingles of five words are hashed to 64 bits.  One permutation (``SIGMA``, a
bijective mix) scatters a shingle over ``DOMAIN`` cells; a second one (``pi``,
a table) gives every cell a value.  Signature coordinate k is the smallest
value of ``pi`` shifted circularly by k, so two permutations serve all
coordinates.  A shingle's values for all shifts are one contiguous slice of
the doubled table, and a document's signature is the minimum over such slices.

The signature is cut into bands; the band height is the largest that misses a
pair at the threshold with a probability below 1e-8.  Candidates are
confirmed on full shingle sets, never on the signature.

Groups are never expanded into pairs.  Documents with equal sets become one
class.  In each band bucket all members are compared with the bucket's first
one; components then show which buckets still hold different components, and
only there members of different components are compared.  A large mixed bucket
is split first by a second band: two documents that share a band but no other
of the many bands are below the threshold (up to 1e-7; see ``least_hits``).

Defined edge results: a null or blank text has an empty set, links with
nothing and is kept; a null id links with nothing, its component is null and
it is kept; rows that share an id are one document, linked through it; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import map_arrow, materialize, values_of
from airwell.llm._graph import components

SHINGLE = 5
COORDINATES = 256
DOMAIN_BITS = 20
MISS = 1e-8
MINOR = 1000            # a bucket with more members outside its largest component is split by one more band
CHUNK_BYTES = 1 << 20   # texts are hashed in pieces of about this size
SIGMA = 0x9E3779B97F4A7C15


def bands_for(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the tallest band with miss probability below ``miss`` at the threshold."""
    for rows in range(12, 1, -1):
        if (1 - threshold ** rows) ** (coordinates // rows) <= miss:
            return coordinates // rows, rows
    return coordinates, 1


def least_hits(p: float, n: int, miss: float = 10 * MISS) -> int:
    """The most of ``n`` trials that succeed all but surely, each with
    probability ``p``: fewer do with probability ``miss`` at most; at least one."""
    below, need = 0.0, 0
    while need < n:
        below += math.comb(n, need) * p ** need * (1 - p) ** (n - need)
        if below > miss:
            break
        need += 1
    return max(1, need)


@lru_cache(1)
def _tables():
    """Byte codes, the powers of the word hash's base (grown on demand) and the windows of ``pi``."""
    rng = np.random.default_rng(20240607)
    codes = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    pi = rng.permutation(1 << DOMAIN_BITS).astype(np.uint32)
    doubled = np.concatenate([pi, pi[:COORDINATES]])
    return codes, np.lib.stride_tricks.sliding_window_view(doubled, COORDINATES)


@lru_cache(1)
def _powers(n: int):
    """base^i and base^-i mod 2^64 for i < n."""
    base = np.uint64(0xD6E8FEB86659FD93)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``data`` (lower-cased bytes that end with white space)."""
    codes, _ = _tables()
    size = max(1 << 21, 1 << int(len(data)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(codes[data] * up[:len(data)], out=total[1:])
        white = _SPACE[data]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        start = start[:len(end)]
        return start, _mix((total[end] - total[start]) * down[start])


def _shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, SHINGLE)
    with np.errstate(over="ignore"):
        acc = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            acc = _mix(acc * np.uint64(0xA24BAED4963EE407) + words[i:n - k + 1 + i])
    return np.unique(acc)


def shingle_sets(texts):
    """Sorted distinct shingle hashes of each text (None: empty), hashed piece by piece."""
    group: list[bytes] = []
    size = 0

    def flush():
        data = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
        ends = np.cumsum([len(b) + 1 for b in group])
        start, words = _word_hashes(data)
        cut = np.searchsorted(start, ends)
        low = 0
        for high in cut:
            yield _shingles(words[low:high])
            low = high

    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        group.append(b)
        size += len(b)
        if size >= CHUNK_BYTES:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def signature(shingles: np.ndarray) -> np.ndarray:
    """All circulant MinHash coordinates of one set."""
    _, windows = _tables()
    cells = (_mix(shingles ^ np.uint64(SIGMA)) >> np.uint64(64 - DOMAIN_BITS)).astype(np.int64)
    sig = windows[cells[:1]][0].copy()
    for i in range(0, len(cells), 512):
        np.minimum(sig, windows[cells[i:i + 512]].min(axis=0), out=sig)
    return sig


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        part = sig[:bands * rows].reshape(bands, rows).astype(np.uint64)
        for j in range(rows):
            acc = _mix(acc * np.uint64(0xA24BAED4963EE407) + part[:, j])
        return acc


def _marks(sig: np.ndarray) -> np.ndarray:
    """The signature in two bytes a coordinate: its number and eight bits of its
    value, so that the size of an intersection counts the coordinates that agree."""
    return (np.arange(len(sig)) * 256 + (_mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.int64) - 32768).astype(np.int16)


def _sketch(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            n, fp, keys, marks, offsets = [], [], [], [], [0]
            for s in shingle_sets(values_of(batch.column(1))):
                n.append(len(s))
                if len(s):
                    fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig = signature(s)
                    keys.append(_band_keys(sig, bands, rows))
                    marks.append(_marks(sig))
                else:
                    fp.append(None)
                    marks.append(None)
                offsets.append(offsets[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(fp, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64))),
                 pa.array(marks, pa.list_(pa.int16()))],
                names=["doc_id", "n_shingles", "fp", "bands", "marks"])
    return run


def _sets(batches):
    for batch in batches:
        sets = list(shingle_sets(values_of(batch.column(1))))
        offsets = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
            names=["id", "shingles"])


def _set_table(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ``ids``, written once.  The texts are
    joined by shuffle at every size: the ids grow with the corpus."""
    chosen = texts.hint("merge").join(ids, texts["doc_id"] == ids["id"], "left_semi")
    return materialize(map_arrow(chosen, _sets, "id long, shingles array<bigint>"), "minhash-sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b") \
        .withColumn("both", both) \
        .filter(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b").distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (used, id, component, ...) of buckets with several components, with
    the bucket's key, its largest component and the number of members outside it."""
    rows = rows.withColumn("key", F.xxhash64("used"))
    sizes = rows.groupBy("key", "component").count()
    state = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("major"),
                                     F.count("*").alias("parts"),
                                     (F.sum("count") - F.max("count")).alias("minor")) \
        .filter(F.col("parts") > 1).drop("parts")
    return rows.join(state, "key")


def _with_own(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Mixed rows with ``own``: how many of a document's shingles no other document
    of any mixed bucket has.  These can be in no intersection, so documents with
    too many of them cannot reach the threshold with any other and go."""
    mixed = materialize(_mixed(rows).select("used", "id", "n", "component"), "minhash-mixed")
    ids = mixed.select(F.col("id").alias("__id")).distinct()
    each = sets.join(ids, sets["id"] == ids["__id"], "left_semi").select("id", F.explode("shingles").alias("s"))
    single = each.groupBy("s").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter(F.col("lo") == F.col("hi"))
    own = single.groupBy("lo").agg(F.count("*").alias("own"))
    return mixed.join(own, mixed["id"] == own["lo"], "left") \
        .select("used", "id", "n", "component", F.coalesce("own", F.lit(0)).alias("own")) \
        .filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))


def _mixed_pairs(rows: DataFrame, buckets: DataFrame, marks: DataFrame, percent: int, common: int, alike: int) -> DataFrame:
    """Pairs of different components inside buckets (used, id, n, component, own).

    In each bucket the members outside its largest component meet all members
    of other components, if their sizes and own shingles leave room for the
    threshold, if they share ``common`` bands and if ``alike`` coordinates of
    their signatures agree; a pair that meets in several
    buckets is taken in the first.  A bucket with more than MINOR such members is replaced by its sub-buckets by
    one more band until those have the ``common`` bands that a pair must share: every pair meets in one of
    them, so splitting loses none, and they are compared whole."""
    keys = buckets.groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    # rows that share an id are one document: what any of them shows counts
    marks = marks.join(rows.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi") \
        .groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"))
    keys = materialize(keys.join(marks, F.col("__id") == F.col("doc_id")).drop("doc_id"), "minhash-marks")
    out = None
    for level in range(common):
        rows = materialize(_mixed(rows), "minhash-mixed")
        small = rows if level + 1 == common else rows.filter(F.col("minor") <= MINOR)
        small = small.join(keys, F.col("id") == F.col("__id")).drop("__id")
        x = small.filter(F.col("component") != F.col("major")).select(
            "key", "used", F.col("id").alias("a"), F.col("n").alias("na"), F.col("own").alias("oa"),
            F.col("component").alias("ca"), F.col("keys").alias("ka"), F.col("marks").alias("ma"))
        y = small.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob"),
                         F.col("component").alias("cb"), F.col("keys").alias("kb"), F.col("marks").alias("mb"), "major")
        room = 100 * F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob")) \
            >= percent * F.greatest(F.col("na") + F.col("ob"), F.col("nb") + F.col("oa"))
        once = (F.col("cb") == F.col("major")) | (F.col("a") < F.col("b"))
        shared = F.array_intersect("ka", "kb")
        near = F.size(F.array_intersect("ma", "mb")) >= alike
        first = (F.size(shared) >= common) & (F.slice(shared, 1, F.size("used")) == F.col("used"))
        pairs = x.join(y, (x["key"] == y["key"]) & (F.col("ca") != F.col("cb")) & once & room & first & near) \
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = pairs if out is None else out.union(pairs)
        wide = rows.filter(F.col("minor") > MINOR)
        if level + 1 == common or wide.isEmpty():
            break
        more = buckets.select(F.col("id").alias("__id"), F.col("key").alias("band"))
        rows = wide.join(more, wide["id"] == more["__id"]).filter(~F.array_contains("used", F.col("band"))) \
            .select(F.array_sort(F.array_append("used", F.col("band"))).alias("used"), "id", "n", "component", "own").distinct()
    return out.distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``;
    documents with Jaccard similarity of at least ``threshold`` (whole percent) are linked."""
    percent = round(100 * threshold)
    bands, rows = bands_for(threshold)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = materialize(map_arrow(
        texts, _sketch(bands, rows), "doc_id long, n_shingles long, fp binary, bands array<bigint>, "
        "marks array<smallint>"), "minhash-sketch")
    known = sketch.filter(F.col("doc_id").isNotNull() & F.col("fp").isNotNull())

    # classes of equal sets, named by their smallest id; only real ones are kept as a table
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")) \
        .filter(F.col("rep") != F.col("top")).select(F.col("fp").alias("class_fp"), "rep")
    member = known.join(classes, known["fp"] == classes["class_fp"]).select("doc_id", "rep")
    member = materialize(member.filter(F.col("doc_id") != F.col("rep")).distinct(), "minhash-classes")

    others = member.select(F.col("doc_id").alias("copy"))
    first = known.join(others, known["doc_id"] == others["copy"], "left_anti")
    band = first.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))

    # star pairs: every member of a bucket with the bucket's smallest id
    lead = band.groupBy("band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")) \
        .filter(F.col("lead") != F.col("last")).select(F.col("band").alias("key"), "lead")
    bucket = materialize(band.join(lead, band["band"] == lead["key"])
                         .select("key", F.col("doc_id").alias("id"), "n", "lead").distinct(), "minhash-buckets")
    star = materialize(bucket.filter(F.col("id") != F.col("lead"))
                       .select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "minhash-stars")
    sets = _set_table(bucket.select("id").distinct(), texts)
    links = materialize(_confirm(star, sets, percent), "minhash-links")

    # buckets in which several components are left
    comp = materialize(components(links), "minhash-comp")
    c = comp.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    rest = bucket.join(c, bucket["id"] == c["__n"], "left") \
        .select(F.array("key").alias("used"), "id", "n", F.coalesce("__c", "id").alias("component"))
    rest = materialize(_with_own(rest, sets, percent), "minhash-rest")
    pairs = _mixed_pairs(rest, bucket, known.select("doc_id", "marks"), percent, least_hits(threshold ** rows, bands),
                         least_hits(threshold, COORDINATES)).join(star, ["a", "b"], "left_anti")
    more = materialize(_confirm(materialize(pairs, "minhash-pairs"), sets, percent), "minhash-links")
    edges = links.union(more).union(member.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    final = components(edges)
    done = final.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    out = sketch.select("doc_id", "n_shingles").join(done, F.col("doc_id") == F.col("__n"), "left")
    comp_id = F.coalesce("__c", "doc_id")
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp_id, F.lit(True)).alias("kept"))


def filter_documents(docs: DataFrame, threshold: float = 0.8, **names) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; all columns stay as they are."""
    key = names.get("doc_id", "doc_id")
    gone = near_duplicates(docs, threshold, **names).filter(~F.col("kept")) \
        .select(F.col("doc_id").alias("__llm_id")).distinct()
    return docs.join(gone, docs[key] == gone["__llm_id"], "left_anti")
