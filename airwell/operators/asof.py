"""As-of join (J5): for each left row, the newest right row of the same key
with ``right_ts <= left_ts``.

Spark has no as-of operator, and a plain range join on the key alone pairs a
left row with every earlier reading of its site.  Here the time axis is cut
into buckets, so that no step pairs rows by a range:

1. in-bucket: left and right rows of a (key, bucket) are put in one time
   order and each left row takes the last right row before it, one pass;
2. carry-over: for left rows with no match in their own bucket, the answer is
   the last right row of the latest earlier bucket.  The same pass keeps each
   bucket's last right row; the (key, bucket) pairs that are asked for are put
   in one order with them, and their answers are looked up by equi-join.

Left rows are reduced to distinct (key, ts) first.  The right side is read
once, and reduced to one row per (key, ts) by the caller's tie order.  The
per-key window in step 2 runs over two rows per (key, bucket) at most --
bounded by the time span, not by data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airwell.session import materialize


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order`` tuple (A4).
    A partial aggregation on the map side ships one row per key and task.  The
    row is a struct, so the aggregate is sort-based; each task sorts its own
    rows by key first."""
    other = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in other]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


MAX_SENT_KEYS = 500_000     # left keys that are sent to every task to filter the right rows


def _last_rows(rows: DataFrame, key: str, bucket, time, payload: list[str], order: list[str]) -> DataFrame:
    """The greatest row by ``order`` per (key, bucket, time) as a struct."""
    by = [F.col(key), bucket.alias("_b")] + ([] if time is None else [time.alias("_at")])
    best = F.max_by(F.struct(*payload), F.struct(*[F.col(c) for c in order])).alias("_r")
    return rows.groupBy(*by).agg(best).select(key, "_b", "_r")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              bucket_seconds: int = 86400, right_prefix: str = "", tie_order: list[str] | None = None) -> DataFrame:
    """Left rows with the columns of their as-of right row appended (NULL when
    there is none).

    ``right`` may hold several rows per (key, right_ts); the one with the
    greatest ``tie_order`` tuple is used (without ``tie_order`` the right side
    must already be unique on (key, right_ts)).  Right rows inside the left's
    bucket range are first reduced per (key, bucket, time) with map-side
    partial aggregation, so a hot key ships at most one row per timestamp and
    map task; only then are they shuffled for the join.  Older rows are
    reduced to each key's last one the same way; later rows are dropped.
    """
    b = F.lit(bucket_seconds)
    rcols = [c for c in right.columns if c != key]
    rts = right_prefix + right_ts
    payload = [right_prefix + c for c in rcols]
    order = [rts] + [right_prefix + c for c in (tie_order or [])]

    lk = (left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"))
          .where(F.col("_k").isNotNull() & F.col("_t").isNotNull()).distinct()
          .withColumn("_b", F.floor(F.unix_seconds(F.col("_t")) / b)))
    # read by the bounds, the keys and the in-bucket pass: written once
    lk = materialize(lk, "asof-left")
    # the left's bucket range and number of keys (three scalars): right rows after it are never
    # needed; right rows before it matter only through each key's last one
    lo, hi, n_keys = lk.agg(F.min("_b"), F.max("_b"), F.count_distinct("_k")).first()
    if lo is None:
        lo, hi = 0, -1

    rr = (right.select(F.col(key).alias("_k"), *[F.col(c).alias(right_prefix + c) for c in rcols])
               .withColumn("_b", F.floor(F.unix_seconds(F.col(rts)) / b))
               .where(F.col("_b") <= F.lit(hi)))
    # rows of keys that no left row has are dropped before the sort and the shuffle, where the keys are few enough to send
    if n_keys <= MAX_SENT_KEYS:
        rr = rr.join(F.broadcast(lk.select("_k").distinct()), "_k", "left_semi")
    # One scan reduces both: rows of the left's buckets to one per (key, time), older rows to one per key, as the bucket
    # before the first.  No explicit repartition: this is a partial aggregation, so a hot (key, bucket) is pre-reduced on
    # the map side before any shuffle.
    old = F.col("_b") < F.lit(lo)
    if not tie_order:       # unique on (key, time): only the older rows are reduced
        rr = (rr.where(~old).select("_k", "_b", F.struct(*payload).alias("_r"))
                .unionByName(_last_rows(rr.where(old), "_k", F.lit(lo - 1).cast("bigint"), None, payload, order)))
    else:
        rr = _last_rows(rr, "_k", F.greatest(F.col("_b"), F.lit(lo - 1).cast("bigint")), F.when(~old, F.col(rts)), payload, order)

    # 1. newest right row in the same bucket, not after the left time: right
    # rows sort before left rows of the same time.  The same pass marks each bucket's last right row.
    events = (rr.select("_k", "_b", F.col("_r")[rts].alias("_t"), F.lit(0).alias("_left"), "_r")
              .unionByName(lk.withColumn("_left", F.lit(1)), allowMissingColumns=True))
    run = Window.partitionBy("_k", "_b").orderBy("_t", "_left")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(F.when(F.col("_left") == 0, F.col("_t"))).over(whole)
    found = (events.withColumn("_m", F.last("_r", True).over(upto)).withColumn("_last", last)
             .where((F.col("_left") == 1) | (F.col("_t") == F.col("_last"))).select("_k", "_b", "_t", "_left", "_m"))
    # read by the matches and the look-ups: written once
    found = materialize(found, "asof-found")
    hit = found.where(F.col("_left") == 1)

    # 2. left rows without one: last right row before their bucket, looked up once per (key, bucket)
    missed = hit.where(F.col("_m").isNull()).select("_k", "_t", "_b")
    asked = missed.select("_k", "_b").distinct().withColumn("_data", F.lit(0))
    last_in_bucket = found.where(F.col("_left") == 0).select("_k", "_b", "_m", F.lit(1).alias("_data"))
    before = Window.partitionBy("_k").orderBy("_b", "_data").rowsBetween(Window.unboundedPreceding, 0)
    carry = (last_in_bucket.unionByName(asked, allowMissingColumns=True)
             .withColumn("_c", F.last("_m", True).over(before))
             .where((F.col("_data") == 0) & F.col("_c").isNotNull()).select("_k", "_b", "_c"))
    missed = missed.join(carry, ["_k", "_b"]).select("_k", "_t", F.col("_c").alias("_m"))
    matched = hit.where(F.col("_m").isNotNull()).select("_k", "_t", "_m").unionByName(missed)
    out = left.join(matched, (left[key] == matched["_k"]) & (left[left_ts] == matched["_t"]), "left")
    return out.select(*left.columns, *[F.col("_m." + c).alias(c) for c in payload])
