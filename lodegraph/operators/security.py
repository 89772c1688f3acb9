"""Row- and column-level security as column expressions that Spark can push down."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: classification levels, and the highest one that a role may read
LEVELS = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}
ROLE_LEVEL = {"reader": "internal", "contributor": "internal", "reviewer": "confidential", "admin": "restricted"}


@dataclass(frozen=True)
class User:
    """Who asks: their role, groups, department and id."""

    role: str = "reader"
    groups: tuple[str, ...] = field(default_factory=tuple)
    department: str | None = None
    ident: str | None = None


def decision(user: User, classification: Column, groups: Column, owner: Column, viewers: Column, department: Column, unknown: str = "restricted") -> Column:
    """admin_access, granted, or the first rule that denies a row.

    A missing classification is internal, and one that isn't known counts as unknown: restricted unless a caller wants the
    laxer rule of the reports, public, under which a misspelt level opens a row to all. No groups admit all; an owner's row is open to
    the owner and its viewers, or to all where it has no viewers list.
    """
    if user.role == "admin":
        return F.lit("admin_access")
    level = F.coalesce(*[F.when(F.coalesce(classification, F.lit("internal")) == name, F.lit(n)) for name, n in LEVELS.items()], F.lit(LEVELS[unknown]))
    mine = F.array(*[F.lit(g) for g in user.groups]).cast("array<string>")
    me = F.lit(user.ident)
    closed = owner.isNotNull() & ~owner.eqNullSafe(me) & viewers.isNotNull() & ~F.coalesce(F.array_contains(viewers, me) if user.ident else F.lit(False), F.lit(False))
    return (
        F.when(level > LEVELS[ROLE_LEVEL.get(user.role, "internal")], "classification_denied")
        .when((F.coalesce(F.size(groups), F.lit(0)) > 0) & ~F.coalesce(F.arrays_overlap(groups, mine), F.lit(False)), "group_denied")
        .when(closed, "ownership_denied")
        .when(department.isNotNull() & ~department.eqNullSafe(F.lit(user.department)), "department_denied")
        .otherwise("granted")
    )


def masked(rows: DataFrame, user: User, hidden: dict[str, str]) -> DataFrame:
    """rows with the columns of hidden nulled for users whose role may read less than the level given for the column."""
    own = LEVELS[ROLE_LEVEL.get(user.role, "internal")]
    return rows.withColumns({c: F.lit(None).cast(dict(rows.dtypes)[c]) for c, level in hidden.items() if LEVELS[level] > own})
