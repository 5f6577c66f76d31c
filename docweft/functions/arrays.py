"""Array expressions whose time grows in proportion to the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold appends to one array before it starts the next.
CHUNK = 256


def folded(items: Column, state: Column, step, element: str, last=None) -> Column:
    """A fold that emits: step(state, item) gives (new state, array of emitted elements); last(state) emits once more at the end. element: their type.

    Appending to one array copies it at every step; so elements are gathered in chunks, which are flattened at the end.
    """
    empty = F.array().cast(f"array<{element}>")

    def over(chunk: Column, acc: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), empty.alias("new"), acc["out"].alias("out"))

        def each(a: Column, x: Column) -> Column:
            state, emitted = step(a["state"], x)
            return F.struct(state.alias("state"), F.concat(a["new"], emitted).alias("new"), a["out"].alias("out"))

        return F.aggregate(chunk, start, each, lambda a: F.struct(a["state"].alias("state"), F.concat(a["out"], F.array(a["new"])).alias("out")))

    def whole(xs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{element}>>").alias("out"))
        done = F.aggregate(chunks, start, lambda acc, c: over(F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)), acc), lambda a: F.flatten(F.concat(a["out"], F.array(last(a["state"]))) if last else a["out"]))
        return F.when(F.size(xs) == 0, last(state) if last else empty).otherwise(done)

    # The items are a lambda's variable, so that they are computed once and not once a chunk.
    return F.transform(F.array(items), whole)[0]


def starts(lengths: Column) -> Column:
    """The sums of the lengths before each one."""
    return folded(lengths, F.lit(0), lambda at, n: (at + n, F.array(at)), "int")
