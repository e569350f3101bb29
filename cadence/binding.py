"""The fact model: entity x time x measure.

A :class:`FactSet` holds one fact DataFrame with canonical columns

* ``ts``     TIMESTAMP_NTZ, the observation time
* ``id``     the entity id (any type)
* ``v``      DOUBLE, the measure
* ``key``    optional row key (kept by extracts)
* ``entity`` the entity name, either on every fact row (*inline*, as in the
  ridership export) or in a separate dimension ``names(id, entity)``.

With a names dimension the operators aggregate by ``id`` first and attach the
names to the (much smaller) aggregate, so the big fact table is never shuffled
for the name join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FactSet:
    facts: DataFrame
    names: DataFrame | None = None
    # None sums the measure as it is (doubles). A scale, which only a caller who
    # knows the measure gives, takes sums as whole 10^-scale units (BIGINT):
    # exact and free of the order of rows. A value with more decimals fails.
    scale: int | None = None

    @property
    def inline(self) -> bool:
        return self.names is None

    def where(self, cond: Column) -> FactSet:
        return replace(self, facts=self.facts.where(cond))

    def with_facts(self, facts: DataFrame) -> FactSet:
        return replace(self, facts=facts)

    def for_years(self, years: Iterable[int]) -> FactSet:
        """Rows of the given years: a timestamp range that reaches the
        Parquet scan, plus a partition filter when the facts were landed
        partitioned by ``year`` (whole folders are then skipped)."""
        from cadence.functions.calendar import in_years

        years = list(years)
        cond = in_years("ts", years)
        if "year" in self.facts.columns:
            cond = cond & F.col("year").isin(years)
        return self.where(cond)

    def for_month(self, year: int, month: int) -> FactSet:
        """Rows of one month (timestamp range, plus partition filters when
        landed partitioned by ``year`` and ``month``)."""
        from cadence.functions.calendar import in_month

        cond = in_month("ts", year, month)
        if "year" in self.facts.columns and "month" in self.facts.columns:
            cond = cond & (F.col("year") == year) & (F.col("month") == month)
        return self.where(cond)

    def named_facts(self) -> DataFrame:
        """Fact rows with ``entity`` on each row (joins the names dimension;
        use only where a per-row name is the point, e.g. extracts)."""
        if self.inline:
            return self.facts
        return self.facts.join(self.names, "id", "left")


def strip_column_names(df: DataFrame) -> DataFrame:
    """Remove outer blanks from every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Stop with ``ValueError`` naming the required columns that are absent."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def rename_to_canonical(
    df: DataFrame,
    ts: str,
    id: str,
    v: str,
    entity: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """Project source columns to the canonical names (prunes the rest)."""
    cols = [F.col(ts).alias("ts"), F.col(id).alias("id"), F.col(v).alias("v")]
    if entity:
        cols.append(F.col(entity).alias("entity"))
    if key:
        cols.append(F.col(key).alias("key"))
    return df.select(*cols)
