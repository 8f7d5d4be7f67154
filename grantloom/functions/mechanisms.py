"""Funding-mechanism families and the classifications built on activity codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    """Activity codes named one by one, by leading letter, or both."""

    codes: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()

    def sql(self, activity: str = "activity") -> str:
        """The membership test as a SQL expression."""
        tests = [f"startswith({activity}, '{prefix}')" for prefix in self.prefixes]
        if self.codes:
            tests.append(f"{activity} in ({quoted(self.codes)})")
        return "(" + " or ".join(tests) + ")"


def quoted(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def only(*codes: str) -> Family:
    return Family(codes=codes)


def series(*prefixes: str, also: tuple[str, ...] = ()) -> Family:
    return Family(codes=also, prefixes=prefixes)


# Activity-code lists.
RPG_WIDE = only("R01", "R03", "R15", "R21", "R34", "R35", "R37", "R56", "RF1", "RM1", "DP1", "DP2", "DP5")
RPG_STANDARD = only("R01", "R03", "R15", "R21", "R33", "R34", "R37", "R56")
HIGH_RISK = only("R35", "DP1", "DP2", "DP5", "RF1", "RM1")
HIGH_RISK_PEOPLE = only("R35", "DP1", "DP2", "DP5", "RF1")
CENTERS = series("P")
COOPERATIVE = series("U")
TRAINING = series("T")
TRAINING_CODES = only("T32", "T34", "T35", "T36", "T37", "T90", "TL1", "TU2")
CAREER = series("K", also=("R00",))
FELLOWSHIP = series("F")
FELLOWSHIP_CAREER_CODES = only(
    "F30", "F31", "F32", "F33", "K01", "K02", "K07", "K08", "K22", "K23", "K24", "K25", "K99", "R00"
)
SMALL_BUSINESS = only("R41", "R42", "R43", "R44", "U43", "U44")
SMALL_BUSINESS_GRANTS = only("R41", "R42", "R43", "R44")
INFRASTRUCTURE = series("C", "G", "S")
CONTRACTS = series("N")
INTRAMURAL = series("Z")
EARLY_INVESTIGATOR = only("R21", "R03", "K99", "R00", "DP2")
EARLY_CAREER = only("K99", "R00", "K01", "K08", "K23", "DP2")
ESTABLISHED = only("R35", "R37", "P01")
MINORITY_SERVING = only("G12", "U54", "S06")
SPECIALIZED_CENTERS = only("P50", "P30", "P60")
CONSTRUCTION = only("C06", "G20")
CLUSTERING_ELIGIBLE = only(
    "R01", "R21", "R03", "R15", "R35", "U01", "U19", "P01", "P30", "P50", "DP1", "DP2", "DP5"
)

# Class names, short form and display form, in order of precedence.
AWARD_CLASSES = (
    ("RPG", "Research Project Grants (RPG)", RPG_WIDE),
    ("Centers", "Program Projects & Centers", CENTERS),
    ("Fellowship/Career", "Fellowships & Career Awards", FELLOWSHIP_CAREER_CODES),
    ("Training", "Training Grants", TRAINING_CODES),
    ("SBIR/STTR", "SBIR/STTR", SMALL_BUSINESS),
)


def award_class(activity: str = "activity", display: bool = False) -> str:
    """First matching class of an activity code, ``Other`` when none matches, as a SQL expression."""
    branches = [
        f"when {family.sql(activity)} then '{shown if display else short}'" for short, shown, family in AWARD_CLASSES
    ]
    return f"case {' '.join(branches)} else 'Other' end"


@dataclass(frozen=True)
class Slice:
    """One family shown in a card: a count column and, optionally, a funding column."""

    family: Family
    count: str
    funding: str | None = None


def slice_columns(slices: tuple[Slice, ...], unit: float | None, count: str = "n", amount: str = "funding") -> list[Column]:
    """Aggregates over rows already rolled up per activity code.

    Funding is scaled to ``unit``; with no unit it stays a raw sum.
    """
    from grantloom.functions.numbers import in_units

    columns = []
    for item in slices:
        test = item.family.sql()
        columns.append(F.expr(f"sum(case when {test} then {count} else 0 end)").alias(item.count))
        if item.funding:
            raw = F.expr(f"coalesce(sum(case when {test} then {amount} end), 0)")
            columns.append((raw if unit is None else in_units(raw, unit)).alias(item.funding))
    return columns
