"""Names shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for a row however often body names it,
    also where the optimizer moves the whole expression into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of df in one struct `_row` beside the given working columns, so that
    no name in df can clash with a working name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(k) for k, c in columns.items()])


def unboxed(df: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """The boxed columns again, with the given result columns; a result column takes
    the place of an input column of the same name."""
    kept = [F.col(f"_row.`{n}`").alias(n) for n in names if n not in columns]
    return df.select(*kept, *[c.alias(k) for k, c in columns.items()])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: How to drop what operators keep in this Python worker between tasks, by operator.
_kept: dict[str, Callable[[], object] | None] = {}


def enter(operator: str, drop: Callable[[], object] | None = None) -> None:
    """A task of this operator begins: what the others left in this worker goes. Spark
    uses its workers again, so the stages of a pipeline would else add up in each."""
    others = [name for name in _kept if name != operator]
    for name in others:
        if clear := _kept.pop(name):
            clear()
    _kept[operator] = drop
    if others:
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system; Arrow and the C library would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
