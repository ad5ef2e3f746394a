"""Who may see what: one predicate and one weight for every way of searching.

An empty list of departments means that nothing is visible; only None lifts the filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPANY = "company"
PENALTY = 0.85


@dataclass(frozen=True)
class Access:
    """Departments and clearance of a reader; ``soft`` weighs foreign departments down instead of hiding them."""

    departments: tuple[str, ...] | None = None
    clearance: int | None = None
    soft: bool = False
    penalty: float = PENALTY

    @property
    def inside(self) -> Column:
        return F.coalesce(F.col("department").isin(*self.departments), F.lit(False)) if self.departments else F.lit(self.departments is None)

    @property
    def predicate(self) -> Column:
        rule = ~F.col("is_deleted") & ~F.col("is_deprecated")
        if self.clearance is not None:
            rule &= F.col("secret_level") <= self.clearance
        if self.departments is not None and not (self.soft and self.departments):
            rule &= self.inside
        return rule

    @property
    def weight(self) -> Column:
        if self.departments and self.soft:
            return F.when(self.inside, 1.0).otherwise(self.penalty)
        return F.lit(1.0)

    def visible(self, chunks: DataFrame) -> DataFrame:
        """The chunks a reader may see, with their weight."""
        return chunks.where(self.predicate).withColumn("weight", self.weight)


def scope_of(department: Column) -> Column:
    """What a member of a department sees: it, and what belongs to the company."""
    return F.array_distinct(F.array_compact(F.array(department, F.lit(COMPANY))))


def identified(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with the user that their bearer token names; user columns are null where it names none, and status is 401."""
    token = F.when(F.startswith("authorization", F.lit("Bearer ")), F.substring("authorization", 8, 1 << 20))
    known = requests.withColumn("token", token).join(users, "token", "left")
    return known.withColumn("status", F.when(F.col("name").isNull(), 401).otherwise(200)).drop("token")
