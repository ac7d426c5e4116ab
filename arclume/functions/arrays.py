"""Array functions: padding, sampling, gathering. JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_to_k(items: Column, k: int) -> Column:
    """The first ``k`` items; the last one is repeated where there are fewer. An empty array stays empty, null null."""
    return F.when(F.size(items) > 0, F.slice(F.concat(items, F.array_repeat(F.element_at(items, -1), k)), 1, k)).otherwise(items)


def sample_indices(length: Column, k: int) -> Column:
    """``k`` evenly spaced indices of 0 .. length-1, both ends included, rounded down."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (length - 1) / F.lit(k - 1)))


def gather_or_zeros(layers: Column, wanted: list[int], width: int) -> Column:
    """The wanted layers, counted from 0; a layer that is not there gives ``width`` zeros."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return F.array(*[F.coalesce(F.get(layers, F.lit(i)), zeros) for i in wanted])


def last_vision_state(states: Column, last_position: Column) -> Column:
    """The state at ``last_position`` (from 0), else the last state."""
    return F.coalesce(F.get(states, last_position), F.element_at(states, -1))


def marker_positions(ids: Column, start: int, end: int, k: int) -> Column:
    """Positions (from 0) strictly between the i-th start and i-th end marker, for the first ``k``; null without ``k`` of both."""
    at = lambda m: F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: F.get(ids, i) == m)
    starts, ends = F.slice(at(start), 1, k), F.slice(at(end), 1, k)
    between = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: F.when(p["s"] + 1 <= p["e"] - 1, F.sequence(p["s"] + 1, p["e"] - 1)).otherwise(F.array().cast("array<int>"))))
    return F.when((F.size(ids) > 0) & (F.size(starts) >= k) & (F.size(ends) >= k), F.array_sort(F.array_distinct(between)))


def shape_text(dims: Column) -> Column:
    """'[a, b, c]' of an array of whole numbers."""
    return F.concat(F.lit("["), F.array_join(F.transform(dims, lambda d: d.cast("string")), ", "), F.lit("]"))
