"""People, organisation and delimited-list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder and patterns in the source name fields.
UNNAMED_PERSON = "TBD, TBD"
MALFORMED_PERSON = "%,%  %"
CONTACT_MARK = r"\(contact\)"
OWN_LABORATORY_PATTERNS = (
    "%NATIONAL INSTITUTE%",
    "%NATIONAL CENTER FOR%",
    "%DIVISION OF%NCI%",
    "%DIVISION OF%NIH%",
)


def first_person(people: Column) -> Column:
    """First entry of a ``|`` list; NULL when there is none."""
    return F.trim(F.get(F.split(people, r"\|"), 0))


def without_contact_mark(people: Column) -> Column:
    unmarked = F.regexp_replace(people, CONTACT_MARK, "")
    return F.trim(F.regexp_replace(unmarked, r"\s+", " "))


def present(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def external_organization(name: Column) -> Column:
    """True unless the name is one of the funder's own laboratories."""
    test = name.isNotNull()
    for pattern in OWN_LABORATORY_PATTERNS:
        test = test & ~name.like(pattern)
    return test


def entries(text: Column, separator: str = ";") -> Column:
    """Trimmed, non-empty entries of a delimited list."""
    pieces = F.split(text, f"[{separator}]")
    return F.filter(F.transform(pieces, lambda piece: F.trim(piece)), lambda piece: piece != "")


def joined_distinct(values: Column, separator: str, limit: int | None = None) -> Column:
    """Distinct values in ascending order, joined; optionally only the first ``limit``."""
    ordered = F.array_sort(F.collect_set(values))
    if limit:
        ordered = F.slice(ordered, 1, limit)
    return F.array_join(ordered, separator)


def funding_split(text: Column) -> Column:
    r"""``UNIT:AMOUNT\UNIT:AMOUNT`` as a map from unit code to amount."""
    pairs = F.filter(F.split(text, r"\\"), lambda pair: F.contains(pair, F.lit(":")))
    return F.map_from_entries(
        F.transform(
            pairs,
            lambda pair: F.struct(
                F.trim(F.split_part(pair, F.lit(":"), F.lit(1))).alias("key"),
                F.split_part(pair, F.lit(":"), F.lit(2)).cast("double").alias("value"),
            ),
        )
    )
