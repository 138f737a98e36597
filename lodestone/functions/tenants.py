"""Tenant guard: the predicate that every search applies before it scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tenants that stand for none: only where all tenants are allowed do they see anything.
GLOBAL_TENANTS = ("", "ALL", "*")


def tenant_guard(column: str, tenant: str | None, allow_global: bool = False) -> Column:
    """Rows that a tenant may see: its own; all with ``allow_global`` and no tenant; none without either."""
    if tenant is None or tenant in GLOBAL_TENANTS:
        return F.lit(bool(allow_global))
    return F.col(column) == tenant


def same_tenant(a: Column, b: Column) -> Column:
    """Equal tenants, where null and the empty one are equal."""
    return F.nullif(a, F.lit("")).eqNullSafe(F.nullif(b, F.lit("")))
