"""Code ladders and severity scores as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(steps: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    result = F.lit(otherwise)
    for condition, value in reversed(steps):
        result = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(result)
    return result


def age_points(age: Column) -> Column:
    """0 to 50 years, then a point per decade, 4 above 80 or unknown."""
    return ladder([(age <= 50, 0), (age <= 60, 1), (age <= 70, 2), (age <= 80, 3)], 4)


def unit_code(text: Column, names: list[tuple[str, int]]) -> Column:
    """Code of the first name that the text contains, 0 if none."""
    return ladder([(text.contains(n), code) for n, code in names], 0)


@dataclass(frozen=True)
class CodeRule:
    """A category of codes: the first ``length`` characters lie between two texts (inclusive)."""

    category: str
    version: int
    length: int
    low: str
    high: str

    def matches(self, code: Column, version: Column) -> Column:
        prefix = F.substring(code, 1, self.length)
        return (version == self.version) & prefix.between(self.low, self.high)


def category_flags(rules: list[CodeRule], code: Column, version: Column) -> dict[str, Column]:
    """For each category, an aggregate that is 1 if any code of the group matches any of its rules."""
    flags = {}
    for category in dict.fromkeys(r.category for r in rules):
        any_of = F.lit(False)
        for rule in rules:
            if rule.category == category:
                any_of = any_of | F.coalesce(rule.matches(code, version), F.lit(False))
        flags[category] = F.max(F.when(any_of, 1).otherwise(0))
    return flags


# Six organ scores from 0 to 4 and three bedside points; a missing value scores 0. The tiers are fixed values of the
# published scores.


def _falling(value: Column, below: list[float]) -> Column:
    """Points for a value under each of the limits, which fall from 1 point to more."""
    score = F.lit(0)
    for points, limit in enumerate(below, 1):
        score = F.when(value < limit, points).otherwise(score)
    return score


def _rising(value: Column, from_: list[float]) -> Column:
    score = F.lit(0)
    for points, limit in enumerate(from_, 1):
        score = F.when(value >= limit, points).otherwise(score)
    return score


def coagulation(platelets: Column) -> Column:
    return _falling(platelets, [150, 100, 50, 20])


def liver(bilirubin: Column) -> Column:
    return _rising(bilirubin, [1.2, 2.0, 6.0, 12.0])


def nervous(gcs: Column) -> Column:
    return _falling(gcs, [15, 13, 10, 6])


def cardiovascular(pressure: Column, vasopressor: Column) -> Column:
    support = F.coalesce(vasopressor, F.lit(0.0))
    return ladder([(support > 0.1, 4), (support > 0, 3), (pressure < 70, 1)], 0)


def renal(creatinine: Column, urine: Column, urine_rows: Column) -> Column:
    """The worse of the creatinine tier and, where urine was measured at all, the urine tier."""
    by_urine = F.when(urine_rows > 0, ladder([(urine < 200, 4), (urine < 500, 3)], 0)).otherwise(0)
    return F.greatest(_rising(creatinine, [1.2, 2.0, 3.5, 5.0]), by_urine)


def respiration(pao2: Column, fio2_percent: Column, spo2: Column, ventilated: Column) -> Column:
    """Arterial oxygen ratio, whose two worst tiers need ventilation; without it the saturation (97 at most) ratio."""
    share = F.when(fio2_percent > 0, fio2_percent / 100)
    ratio, saturation = pao2 / share, F.least(spo2, F.lit(97.0)) / share
    helped = F.coalesce(ventilated, F.lit(False))
    by_ratio = ladder([((ratio < 100) & helped, 4), ((ratio < 200) & helped, 3), (ratio < 300, 2), (ratio < 400, 1)], 0)
    by_saturation = ladder([(saturation <= 67, 4), (saturation <= 142, 3), (saturation <= 221, 2), (saturation <= 302, 1)], 0)
    measured = spo2.isNotNull() & share.isNotNull()
    return F.when(ratio.isNotNull(), by_ratio).when(measured, by_saturation).otherwise(0)


def bedside_parts(breaths: Column, gcs: Column, systolic: Column) -> list[Column]:
    return [ladder([(breaths >= 22, 1)], 0), ladder([(gcs < 15, 1)], 0), ladder([(systolic <= 100, 1)], 0)]


def bedside(breaths: Column, gcs: Column, systolic: Column) -> Column:
    one, two, three = bedside_parts(breaths, gcs, systolic)
    return one + two + three
