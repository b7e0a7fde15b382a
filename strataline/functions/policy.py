"""Policy envelopes as two array columns, capabilities and visibilities; null or empty arrays are public."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Scope


def _strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>") if items else F.array().cast("array<string>")


def visible(capabilities: Column, visibilities: Column, scope: Scope) -> Column:
    """Both lists are within the scope's; stays a row filter that is applied at the scan."""
    inside = lambda c, granted: c.isNull() | (F.size(F.array_except(c, _strings(granted))) == 0)
    return inside(capabilities, scope.capabilities) & inside(visibilities, scope.visibilities)


def contains(required: Column, containing: Column) -> Column:
    """The required list is within the containing one; null is empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(required, none), F.coalesce(containing, none))) == 0


def merged(*lists: Column) -> Column:
    """Sorted union of lists; null is empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists])))
