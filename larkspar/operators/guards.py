"""Point-in-time guards: which candidates a query may see.

A candidate's outcome over ``horizon`` bars must be known ``purge`` bars before the query:
candidate <= query - horizon - purge.  Guards are join predicates, never post-filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZON = PURGE = 20
HORIZONS = ("T5", "T10", "T20")
EMBEDDINGS = ("raw", "z", "kronos", "fused")


def bound(query_idx: Column, horizon: int = HORIZON, purge: int = PURGE) -> Column:
    """Largest candidate index that is safe."""
    return query_idx - F.lit(horizon + purge)


def is_safe(query_idx: Column, candidate_idx: Column, horizon: int = HORIZON, purge: int = PURGE) -> Column:
    return candidate_idx <= bound(query_idx, horizon, purge)


def check_index(*indices: Column) -> Column:
    """Raises on a negative index; else true.  Use once, where rows enter."""
    bad = F.lit(False)
    for i in indices:
        bad = bad | (i < 0)
    return F.when(bad, F.raise_error(F.lit("trade indices must not be negative"))).otherwise(F.lit(True)).cast("boolean")


def enforce(query_idx: int, candidate_idx: int, horizon: int = HORIZON, purge: int = PURGE) -> bool:
    """The same for two numbers."""
    if min(query_idx, candidate_idx, horizon, purge) < 0:
        raise ValueError("trade indices, horizon and purge must not be negative")
    return candidate_idx <= query_idx - horizon - purge


def other_symbol(q_symbol: Column, c_symbol: Column, q_idx: Column, c_idx: Column, gap: int | None = None) -> Column:
    """Another symbol, or with a gap the same symbol at least ``gap`` bars earlier."""
    if gap is not None and gap <= 0:
        raise ValueError("gap must be positive")
    return (c_symbol != q_symbol) if gap is None else (c_symbol != q_symbol) | (c_idx <= q_idx - gap)


def future(query_idx: Column, candidate_idx: Column, gap: int = 1) -> Column:
    """Sandbox rule: a candidate is future if it has no index or lies after query - gap."""
    return F.coalesce(candidate_idx > query_idx - gap, F.lit(True))


def past_only(df: DataFrame, query_idx: int, column: str = "trade_idx", gap: int = 1) -> DataFrame:
    """Rows that are not future; a missing index counts as the query's own and is dropped."""
    return df.filter(F.coalesce(F.col(column), F.lit(query_idx)) <= query_idx - gap)


def same_cohort(q_stats: Column, c_stats: Column) -> Column:
    """Vectors are comparable only within one normalisation cohort; '' is one."""
    return F.coalesce(q_stats, F.lit("")) == F.coalesce(c_stats, F.lit(""))


def check_parameters(horizon: str, embedding: str) -> None:
    if horizon not in HORIZONS:
        raise ValueError(f"horizon must be one of {HORIZONS}")
    if embedding not in EMBEDDINGS:
        raise ValueError(f"embedding must be one of {EMBEDDINGS}")


def complete(series: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that have no series: the run goes on only if there are none."""
    return wanted.join(series.select(*keys).distinct(), keys, "left_anti")
