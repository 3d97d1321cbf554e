"""Counting within an array, as Column expressions: sort once, then cut where the value changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def runs(ordered: Column, value) -> Column:
    """Of an array of structs ordered by value(x): array of (x, at, n), the first element, place and length of each run of one value."""

    def cut(rows: Column) -> Column:
        changed = lambda k: (k == 0) | (value(F.get(rows, k - 1)) != value(F.get(rows, k)))
        marked = F.transform(rows, lambda x, k: F.struct(x.alias("x"), k.alias("at"), changed(k).alias("new")))
        return let(F.filter(marked, lambda r: r["new"]), lambda starts: F.transform(starts, lambda s, j: F.struct(s["x"].alias("x"), s["at"].alias("at"), (F.coalesce(F.get(starts, j + 1)["at"], F.size(rows)) - s["at"]).alias("n"))))

    return let(ordered, cut)


def counted(items: Column) -> Column:
    """Array of (item, n, first): how often each string of an array occurs, and its first place."""
    placed = F.array_sort(F.transform(items, lambda x, k: F.struct(x.alias("v"), k.alias("k"))))
    return F.transform(runs(placed, lambda x: x["v"]), lambda r: F.struct(r["x"]["v"].alias("item"), r["n"].cast("long").alias("n"), r["x"]["k"].alias("first")))


def first_of_each(items: Column, key) -> Column:
    """The array without later elements of a key(x) that was there before, in order."""
    placed = F.array_sort(F.transform(items, lambda x, k: F.struct(key(x).alias("v"), k.alias("k"), x.alias("x"))))
    kept = F.transform(runs(placed, lambda x: x["v"]), lambda r: F.struct(r["x"]["k"].alias("k"), r["x"]["x"].alias("x")))
    return F.transform(F.array_sort(kept), lambda r: r["x"])
