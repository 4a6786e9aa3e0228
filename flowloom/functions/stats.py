"""Named statistics of one packet series in one direction of a flow.

Each entry maps a `Series` to an aggregate over the flow's packets. Users add entries to `FEATURES`; all of them
are computed in the same aggregation. The given entries use only sums, counts and extremes, so the aggregation
keeps a fixed number of plain numbers per flow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Series:
    """Columns of one series: the value, whether the packet is of this direction, its 0-based place by arrival and by
    value within the direction, and the number of packets of the direction."""

    value: Column
    here: Column
    arrival: Column
    place: Column
    n: Column

    def own(self) -> Column:
        return F.when(self.here, self.value)


Feature = Callable[[Series], Column]


def _nth(n: int) -> Feature:
    return lambda s: F.max(F.when(s.here & (s.arrival == n), s.value))


def _quantile(p: float) -> Feature:
    """Linear interpolation between the two neighbouring places."""
    def feature(s: Series) -> Column:
        spot = F.lit(p) * (s.n - 1)
        below, above = F.floor(spot), F.ceil(spot)
        low = F.max(F.when(s.here & (s.place == below), s.value))
        high = F.max(F.when(s.here & (s.place == above), s.value))
        return low + F.max(F.when(s.here, spot - below)) * (high - low)

    return feature


FEATURES: dict[str, Feature] = {
    "0": _nth(0),
    "1": _nth(1),
    "_max": lambda s: F.max(s.own()),
    "_min": lambda s: F.min(s.own()),
    "_avg": lambda s: F.avg(s.own()),
    "_median": _quantile(0.5),
    "_25q": _quantile(0.25),
    "_75q": _quantile(0.75),
    "_sum": lambda s: F.sum(s.own()),
    "_number": lambda s: F.count_if(s.here & (s.value > 0)).cast("double"),
}


def _place(p: float) -> Callable[[Column, Column], Column]:
    def feature(own: Column, ordered: Column) -> Column:
        spot = F.lit(p) * (F.size(ordered) - 1)
        low, high = F.get(ordered, F.floor(spot).cast("int")), F.get(ordered, F.ceil(spot).cast("int"))
        return low + (spot - F.floor(spot)) * (high - low)

    return feature


def _total(own: Column) -> Column:
    return F.aggregate(own, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


#: The same statistics of a bounded array of values, given by arrival and by value: nothing has to be grouped.
ARRAY_FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "0": lambda own, ordered: F.get(own, F.lit(0)),
    "1": lambda own, ordered: F.get(own, F.lit(1)),
    "_max": lambda own, ordered: F.array_max(own),
    "_min": lambda own, ordered: F.array_min(own),
    "_avg": lambda own, ordered: F.try_divide(_total(own), F.size(F.filter(own, lambda x: x.isNotNull()))),
    "_median": _place(0.5),
    "_25q": _place(0.25),
    "_75q": _place(0.75),
    "_sum": lambda own, ordered: _total(own),
    "_number": lambda own, ordered: F.size(F.filter(own, lambda x: x > 0)).cast("double"),
}


def array_statistics(own: Column) -> Column:
    """A struct of all statistics; each array is built once."""
    def of(values: Column) -> Column:
        return F.get(F.transform(F.array(F.sort_array(values)), lambda ordered: F.struct(*[
            F.coalesce(fn(values, ordered).cast("double"), F.lit(0.0)).alias(name) for name, fn in ARRAY_FEATURES.items()
        ])), F.lit(0))

    return F.get(F.transform(F.array(own), of), F.lit(0))


def continuous_names(bases: tuple[str, ...] = ("bulk", "packet"), features: dict[str, Feature] | None = None) -> list[str]:
    """Statistic names without the direction prefix."""
    return [f"{base}{name}" for name in (features or FEATURES) for base in bases]


def flag_words(flag: Column, here: Column) -> list[Column]:
    """The set of one-byte flags that occur, as the bits of four numbers."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (flag % 64).cast("int"))
    return [F.bit_or(F.when(here & (F.floor(flag / 64) == word), bit)) for word in range(4)]


def flags_of(words: list[Column]) -> Column:
    """Sorted flags of the four numbers."""
    def expanded(i: int, word: Column) -> Column:
        def is_set(n: Column) -> Column:
            return F.call_function("shiftright", word, (n % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

        found = F.filter(F.sequence(F.lit(64 * i), F.lit(64 * i + 63)), is_set)
        return F.when(F.coalesce(word, F.lit(0).cast("long")) == 0, F.array().cast("array<int>")).otherwise(found)

    return F.concat(*[expanded(i, word) for i, word in enumerate(words)])
