"""Folds over arrays inside the JVM, where each step needs what the one before left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outputs that are collected before they join the others.
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_list(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """struct(state, made): the last state of a fold and the outputs of all its steps; step(state, item) gives (state, output).

    Outputs join the list a block at a time, so a long list is not copied for each of its items. A null array gives null.
    """
    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, x: Column) -> Column:
        state, made = step(acc["state"], x)
        return F.struct(state.alias("state"), F.array_append(acc["made"], made).alias("made"))

    def block(acc: Column, k: Column) -> Column:
        held = F.aggregate(F.slice(items, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), none.alias("made")), one)
        return let(held, lambda h: F.struct(h["state"].alias("state"), F.concat(acc["made"], h["made"]).alias("made")))

    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.struct(start.alias("state"), none.alias("made")), block)


def rows_of(df: DataFrame, keys: list[str], array: Column, pos: str, value: str) -> DataFrame:
    """(keys, pos, value): a row per item of an array, for arrays that cost much to make.

    An inner explode makes the optimizer test the array's size below all that makes it, which makes it again for each use.
    """
    return df.select(*keys, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())
