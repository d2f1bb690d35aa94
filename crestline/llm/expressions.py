"""Column helpers shared by the operators that stay inside DataFrame functions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_list(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def _running(values: Column, start: Column) -> Column:
    first = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(values, first, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all")),
                       lambda acc: acc["all"])


def running_sums(values: Column, block: int = 256) -> Column:
    """Prefix sums of an array<bigint>; cut into blocks, so that long arrays don't cost their square."""
    zero = F.lit(0).cast("bigint")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    def long(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        return let(parts, lambda p: F.flatten(F.zip_with(p, _running(F.transform(p, total), zero), lambda part, upto: _running(part, upto - total(part)))))

    return let(values, lambda v: F.when(F.size(v) <= block, _running(v, zero)).otherwise(long(v)))
