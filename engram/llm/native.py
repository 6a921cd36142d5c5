"""Column helpers shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    Inside higher-order functions Catalyst would otherwise inline ``value`` and
    evaluate it again for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def prefix_sums(values: Column, block: int = 128) -> Column:
    """Inclusive running sums of an integer array, in O(n * block) and no shuffle.

    Two levels: sums of whole blocks first, then inside each block, so that an array
    of any length costs no quadratic copying.
    """
    zero = F.lit(0).cast("bigint")

    def inner(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / F.lit(block)).cast("int")
        sums = F.transform(
            F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))),
            lambda b: F.aggregate(F.slice(v, b * block + 1, block), zero, lambda a, x: a + x.cast("bigint")),
        )
        starts = let(
            sums,
            lambda s: F.transform(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda b: F.when(b == 0, zero).otherwise(F.aggregate(F.slice(s, F.lit(1), F.greatest(b, F.lit(1))), zero, lambda a, x: a + x)),
            ),
        )
        return let(
            starts,
            lambda st: F.transform(
                v,
                lambda x, i: F.get(st, F.floor(i / F.lit(block)).cast("int"))
                + F.aggregate(F.slice(v, F.floor(i / F.lit(block)).cast("int") * block + 1, i % block + 1), zero, lambda a, y: a + y.cast("bigint")),
            ),
        )

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(values, inner))


def sha256_hex(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes of ``text``."""
    return F.sha2(text.cast("binary"), 256)
