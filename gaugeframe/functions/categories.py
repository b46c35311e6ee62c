"""Codes, bins and flags (CLN-07, DER-08, DER-10)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the target groups.
TARGET_GROUP_LABELS = {
    "hcw": "Health & care workers",
    "old": "Older adults",
    "ad_chronic": "Adults with chronic conditions",
    "pw": "Pregnant women",
    "all": "All populations",
    "female": "Females",
    "male": "Males",
    "other": "Other target groups",
}

# Indicator names shown to users and the columns behind them.
UPTAKE_MEASURES = {
    "Total doses administered": "COVID_VACCINE_ADM_TOT_DOSES",
    "Doses administered per 100 people": "COVID_VACCINE_ADM_TOT_DOSES_PER100",
    "First dose administered": "COVID_VACCINE_ADM_TOT_A1D",
    "Completed primary series": "COVID_VACCINE_ADM_TOT_CPS",
    "Booster doses administered": "COVID_VACCINE_ADM_TOT_BOOST",
    "Coverage: at least one dose (%)": "COVID_VACCINE_COV_TOT_A1D",
    "Coverage: completed primary series (%)": "COVID_VACCINE_COV_TOT_CPS",
    "Coverage: booster (%)": "COVID_VACCINE_COV_TOT_BOOST",
}

# Wellbeing metrics by display name.
WELLBEING_METRICS = {
    "Anxiety Level": "anxiety_level",
    "Stress Level": "stress_level",
    "Mood Level": "mood_level",
}

# Upper bin edges and labels; the last label takes the rest and missing values.
SLEEP_BINS = ((6, 7, 8), ("<6h", "6–7h", "7–8h", "≥8h"))
ACTIVITY_BINS = ((30, 60, 90), ("<30min", "30–59min", "60–89min", "≥90min"))


def labelled(code: Column, labels: Mapping[str, str]) -> Column:
    """The label of a code; an unknown code is kept. For label sets of a few hundred entries."""
    if not labels:
        return code
    pairs = [F.lit(v) for v in chain.from_iterable(labels.items())]
    # A missing code cannot be looked up in a map, so it is passed by.
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*pairs), code), code))


def binned(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """First bin whose upper edge lies above the value; the rest, and null, in the last bin."""
    if len(names) != len(edges) + 1:
        raise ValueError("one name more than edges is needed")
    steps = F.when(value < F.lit(float(edges[0])), F.lit(names[0]))
    for edge, name in zip(edges[1:], names[1:]):
        steps = steps.when(value < F.lit(float(edge)), F.lit(name))
    return steps.otherwise(F.lit(names[-1]))


def highlight(member: Column, selected: Iterable[str]) -> Column:
    """``Selected`` or ``Other``; a missing member is ``Other``."""
    return F.when(member.isin(list(selected)), F.lit("Selected")).otherwise(F.lit("Other"))


def highlight_size(flag: Column) -> Column:
    """Marker size of a highlight flag."""
    return F.when(flag == "Selected", F.lit(18)).otherwise(F.lit(10)).cast("bigint")
