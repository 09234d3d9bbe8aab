"""Column names that operators work on.

Operators never hard-code a table: a panel is any DataFrame with one row per
entity and month, a scored table is any DataFrame with a 0/1 outcome and a
probability.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelSpec:
    """One row per (entity, year, month).

    The key is unique and years lie in 1800..2100, so an entity never has more
    than 301 * 12 = 3612 rows. That bound is what makes per-entity windows safe
    however many rows the source of the panel had for one entity.
    """

    entity: str = "entity"
    year: str = "year"
    month: str = "month"
    month_no: str = "month_no"
    measure: str = "measure"

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.year, self.month_no]


@dataclass(frozen=True)
class ScoreSpec:
    """A 0/1 outcome, a probability, and the columns rows can be sliced by.

    ``weight`` names a column that says how many rows a row stands for, where rows
    with equal values are counted together.
    """

    actual: str = "actual"
    probability: str = "probability"
    region: str = "region"
    season: str = "season"
    year: str = "year"
    month: str = "month"
    weight: str | None = None
