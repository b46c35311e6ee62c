"""Composite regions: a named part of a parent region, given by its members (FIL-04, DER-03)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CompositeRegion:
    name: str
    parent: str
    members: tuple[str, ...]

    def condition(self, region: Column, member: Column) -> Column:
        return (region == self.parent) & member.isin(list(self.members))


# The two composite regions of the European region and their members.
EAST_EUROPE = CompositeRegion("East Europe", "EURO", (
    "Poland", "Czechia", "Czech Republic", "Slovakia", "Hungary",
    "Romania", "Bulgaria", "Croatia", "Slovenia",
    "Estonia", "Latvia", "Lithuania",
    "Serbia", "Bosnia and Herzegovina", "North Macedonia",
    "Albania", "Montenegro", "Moldova", "Ukraine", "Belarus",
))
WEST_EUROPE = CompositeRegion("West Europe", "EURO", (
    "Germany", "France", "Italy", "Spain", "Portugal",
    "Netherlands", "Belgium", "Luxembourg", "Austria",
    "Switzerland", "United Kingdom", "Ireland",
    "Norway", "Sweden", "Finland", "Denmark", "Iceland",
    "Greece", "Cyprus", "Malta",
))
EUROPE_PARTS = (WEST_EUROPE, EAST_EUROPE)


def region_condition(
    selected: Iterable[str],
    region: Column,
    member: Column,
    composites: Sequence[CompositeRegion] = EUROPE_PARTS,
    plain: Column | None = None,
) -> Column:
    """Rows in any selected region; unknown names add nothing, no selection takes all rows.

    Plain names and composites become one OR of simple comparisons, which reaches the scan. ``plain`` is the array of those
    composite names that the data has as regions of their own: of these, the plain region is meant.
    """
    names = list(dict.fromkeys(selected))
    if not names:
        return F.lit(True)
    by_name = {c.name: c for c in composites}
    parts = [region.isin(names)]
    for n in names:
        if n in by_name:
            condition = by_name[n].condition(region, member)
            parts.append(condition if plain is None else condition & ~F.array_contains(plain, n))
    return reduce(lambda a, b: a | b, parts)


def region_group(
    selected: Iterable[str],
    region: Column,
    member: Column,
    composites: Sequence[CompositeRegion] = EUROPE_PARTS,
) -> Column:
    """The row's region with selected composites split off; a missing region reads ``nan``."""
    wanted = set(selected)
    plain = F.coalesce(region, F.lit("nan"))
    # Later composites win where members overlap, hence the reversed order of tests.
    chosen = [c for c in composites if c.name in wanted]
    return reduce(
        lambda rest, c: F.when(c.condition(region, member), F.lit(c.name)).otherwise(rest),
        chosen,
        plain,
    )
