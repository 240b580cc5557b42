"""Array helpers in SQL functions only.

Spark 4.1 doesn't give a Python UDF an argument in which an inner function uses a variable of an outer one, as some of
these and those built on them do: write or cache what they make before such a call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 128


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array, ``op`` over all that lies before it, from ``zero`` on; ``op`` is associative.

    An array that grows one by one is copied each time, so that it is made in blocks of WIDTH: what lies before a block
    is found from the blocks' totals in the same way. The time is linear up to some millions of values.
    """
    start = F.struct(zero.alias("at"), F.filter(F.array(zero), lambda x: F.lit(False)).alias("out"))

    def short(v: Column) -> Column:
        return F.aggregate(v, start, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def joined(block: Column) -> Column:
        before = short(F.transform(block, lambda b: F.aggregate(b, zero, op)))
        return bind(before, lambda at: F.flatten(F.transform(block, lambda b, i: F.transform(short(b), lambda x: op(F.get(at, i), x)))))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(WIDTH)), lambda i: F.slice(v, i + 1, WIDTH))

    return bind(bind(values, blocks), joined)
