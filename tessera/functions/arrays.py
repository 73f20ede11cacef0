"""Array work that several operators share: values named once, greedy grouping, runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def greedy(units: Column, limit: int) -> Column:
    """Where groups of neighbouring units begin, from 0. units: array of (n, key).

    A group's n add up to limit at most, unless one unit alone exceeds it, and its keys are all the same.
    The state is a few numbers and the starts so far: no texts are copied on the way."""
    first = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("key"))

    def step(a, x):
        opens = (a["i"] == 0) | (a["n"] + x["n"] > limit) | (a["key"] != x["key"])
        return F.struct(
            F.when(opens, F.array_append(a["starts"], a["i"])).otherwise(a["starts"]).alias("starts"),
            (a["i"] + 1).alias("i"),
            F.when(opens, x["n"]).otherwise(a["n"] + x["n"]).alias("n"),
            x["key"].alias("key"),
        )

    return F.aggregate(units, first, step, lambda a: a["starts"])


def runs(values: Column, starts: Column) -> Column:
    """The slices of values that begin at each of starts."""
    ends = lambda i: F.coalesce(F.get(starts, i + 1), F.size(values))
    return F.transform(starts, lambda s, i: F.slice(values, s + 1, ends(i) - s))
