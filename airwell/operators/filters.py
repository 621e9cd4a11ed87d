"""Filters, limits and splits (F1-F8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.operators.cohort import uniform


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """F1 / F2: rows with any NULL (or any NULL in ``subset``) removed."""
    return df.na.drop(how="any", subset=subset)


def split_first_n(df: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """the first ``n`` rows by a stable order, and the rest.

    The head is a top-n (partial top-n per partition, then a merge); the rest
    is an anti-join against those n rows, whose size is bounded by ``n``.
    """
    head = df.orderBy(*order).limit(n)
    rest = df.join(F.broadcast(head.select(*order)), order, "left_anti")
    return head, rest


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present in both inputs (a distinct set)."""
    return a.select(key).intersect(b.select(key))


def keep_with_key_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """F4 keeping a's rows: left-semi join."""
    return a.join(b.select(key), key, "left_semi")


def hash_split(df: DataFrame, key: str, fractions: list[float], seed: int = 42) -> list[DataFrame]:
    """F8, repeatable form: a row's part is the MD5 draw of its key and the
    seed, so it depends neither on partitioning nor on file order."""
    u = uniform(key, f"split{seed}")
    tot = float(sum(fractions))
    out, lo = [], 0.0
    for i, f in enumerate(fractions):
        hi = lo + f / tot
        cond = (u >= lo) & ((u < hi) if i < len(fractions) - 1 else F.lit(True))
        out.append(df.where(cond))
        lo = hi
    return out
