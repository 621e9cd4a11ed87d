"""Latest state per key (A4, F7, K7) and newest-first history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airwell.functions.prepare import has_category, split_category
from airwell.operators.asof import latest_per_key  # noqa: F401  (re-export)


def newest_per_key(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows per key, with their rank (1 = newest).

    ``row_number() <= n`` lets Catalyst insert a partial window-group limit
    before the shuffle, so each map task sends at most n rows per key: a key
    holding a third of all rows does not ship them to one task.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def upsert(current: DataFrame, updates: DataFrame, key: str, seq_col: str = "load_seq") -> DataFrame:
    """K7: insert-as-upsert.  Both inputs carry ``seq_col``; per key the row
    with the highest sequence wins.  One aggregation, no driver loop."""
    allrows = current.unionByName(updates, allowMissingColumns=True)
    return latest_per_key(allrows, [key], [seq_col])


def advice_items(scored: DataFrame, *cols: str, entries: str = "recommendations") -> DataFrame:
    """``cols`` and one row per entry of the list.  The outer form, with its empty rows dropped, computes the
    list once: for the plain form Catalyst adds a filter on the list's size below, which computes it all again."""
    return scored.select(*cols, F.explode_outer(entries).alias("advice")).where(F.col("advice").isNotNull())


def latest_by_category(items: DataFrame) -> DataFrame:
    """P21 + T9: the newest text per (user, category) of (user_id, window_end, advice).  Texts repeat from window to
    window, so the newest time per (user, text) comes first, a hash aggregate; only what is left is split and sorted."""
    cat, content = split_category("advice")
    newest = (items.where(has_category("advice")).groupBy("user_id", "advice").agg(F.max("window_end").alias("window_end"))
              .select("user_id", "window_end", cat.alias("category"), content.alias("content")))
    return newest.groupBy("user_id", "category").agg(
        F.max_by("content", "window_end").alias("content"), F.max("window_end").alias("window_end"))
