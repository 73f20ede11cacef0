"""Model replies as they come over the wire: newline-delimited JSON, and server-sent events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_ndjson(body: Column) -> Column:
    """The text of a reply of JSON lines {"message": {"content": …}, "done": …}, up to the first done; bad lines are skipped."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.from_json(x, "message struct<content:string>, response string, done boolean"))
    good = F.filter(lines, lambda x: x.isNotNull())
    first = F.struct(F.lit("").alias("t"), F.lit(False).alias("done"))

    def step(a, x):
        piece = F.coalesce(x["message"]["content"], x["response"], F.lit(""))
        return F.struct(F.when(a["done"], a["t"]).otherwise(F.concat(a["t"], piece)).alias("t"), (a["done"] | F.coalesce(x["done"], F.lit(False))).alias("done"))

    return F.aggregate(good, first, step, lambda a: a["t"])


def from_events(body: Column) -> Column:
    """The text of a reply of `data: {"choices": [{"delta": {"content": …}}]}` lines, up to [DONE]."""
    upto = F.regexp_replace(body, r"(?s)data:\s*\[DONE\].*$", "")
    data = F.transform(F.filter(F.split(upto, "\n"), lambda x: x.startswith("data:")), lambda x: F.from_json(F.regexp_replace(x, r"^data:\s*", ""), "choices array<struct<delta:struct<content:string>>>"))
    return F.array_join(F.transform(F.filter(data, lambda x: x.isNotNull()), lambda x: F.coalesce(F.get(x["choices"], F.lit(0))["delta"]["content"], F.lit(""))), "")
