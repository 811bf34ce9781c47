"""Lists of observation identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged_ids(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*lists)))) if len(lists) > 1 else F.array_sort(F.array_distinct(lists[0]))


def compress_ids(ids: Column) -> Column:
    """Sorted distinct numbers as texts: runs of two or more as first-last. Linear: a run begins where the number before isn't one less."""
    sorted_ids = F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))
    text = lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))

    def runs(s: Column) -> Column:
        starts = F.filter(s, lambda x, i: (i == 0) | (F.try_element_at(s, i) != x - 1))
        ends = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.try_element_at(s, i + 2) != x + 1))
        return F.zip_with(starts, ends, text)

    return F.element_at(F.transform(F.array(sorted_ids), runs), 1)  # bound once: else each step of a lambda would sort anew


def expand_ids(ranges: Column) -> Column:
    bounds = lambda r: F.split(r, "-")
    one = lambda r: F.sequence(bounds(r)[0].cast("long"), F.element_at(bounds(r), -1).cast("long"))
    return F.flatten(F.transform(ranges, one))
