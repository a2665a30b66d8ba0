"""Contracts of tables: what breaks them is an error, found in the pass that reads the rows anyway.

``Checks`` counts broken rules by an observation of the rows that an action passes by;
``verify``, after the action, raises with the counts. ``guard`` raises at the first broken
row, for results that are only computed later on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinelake.session import discard, settle


class ContractError(ValueError):
    """Rules that a table breaks; counts: rule to number of rows."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(", ".join(f"{name}: {n}" for name, n in sorted(counts.items())))
        self.counts = counts


class Checks:
    """Counts of broken rules, taken while an action passes by the rows."""

    def __init__(self, rules: dict[str, Column]) -> None:
        self.rules, self.observation = rules, Observation()

    def on(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *[F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in self.rules.items()])

    def verify(self) -> None:
        """After an action over the rows: ContractError if any rule was broken."""
        broken = {name: int(n) for name, n in self.observation.get.items() if n}
        if broken:
            raise ContractError(broken)


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, written once; ContractError with the counts of all broken rules if there are any."""
    checks = Checks(rules)
    settled = settle(checks.on(df))
    try:
        checks.verify()
    except ContractError:
        discard(settled)
        raise
    return settled


def guard(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, whose computation fails at the first row that a rule (message: condition) is true for."""
    fine = F.lit(True)
    for message, broken in rules.items():
        fine = F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(fine)
    return df.where(fine)


def require_columns(found: list[str], expected: list[str]) -> None:
    """ContractError if columns are missing or there are others."""
    missing, extra = [c for c in expected if c not in found], [c for c in found if c not in expected]
    if missing or extra:
        raise ContractError({f"missing {c}": 1 for c in missing} | {f"unexpected {c}": 1 for c in extra})


def not_finite(columns: list[str]) -> Column:
    """How many of a row's columns are NULL, NaN or infinite."""
    return sum((F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 1).otherwise(0) for c in columns), F.lit(0))
