"""Scopes that guard reads, and estimates that guard actions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """What a reader may see: provenances, edge types, a half-open window of
    generations, and whether it may act on the world. None is no limit."""

    strata: frozenset[str] | None = None
    edges: frozenset[str] | None = None
    window: tuple[int | None, int | None] = (None, None)
    authority: int = 0

    def meet(self, other: Scope) -> Scope:
        """What both allow."""
        both = lambda a, b: b if a is None else a if b is None else a & b
        lo = [x for x in (self.window[0], other.window[0]) if x is not None]
        hi = [x for x in (self.window[1], other.window[1]) if x is not None]
        return Scope(both(self.strata, other.strata), both(self.edges, other.edges), (max(lo, default=None), min(hi, default=None)), min(self.authority, other.authority))

    def join(self, other: Scope) -> Scope:
        """The least scope that allows what either allows."""
        either = lambda a, b: None if a is None or b is None else a | b
        lo, hi = zip(self.window, other.window, strict=True)
        return Scope(either(self.strata, other.strata), either(self.edges, other.edges), (None if None in lo else min(lo), None if None in hi else max(hi)), max(self.authority, other.authority))

    def allows(self, request: Scope) -> bool:
        return self.meet(request) == replace(request, authority=min(self.authority, request.authority)) and request.authority <= self.authority

    def read(self, rows: DataFrame, stratum: str = "provenance", generation: str = "generation", edge: str = "rel_type") -> DataFrame:
        """The rows that the scope shows; its filters reach the scan."""
        for limit, col in ((self.strata, stratum), (self.edges, edge)):
            if limit is not None and col in rows.columns:
                rows = rows.where(F.col(col).isin(*limit)) if limit else rows.where(F.lit(False))
        if generation in rows.columns:
            if self.window[0] is not None:
                rows = rows.where(F.col(generation) >= self.window[0])
            if self.window[1] is not None:
                rows = rows.where(F.col(generation) < self.window[1])
        return rows


def conforms(grant: Scope, request: Scope, private: frozenset[str]) -> None:
    """Refuse what exceeds the grant, or what reads private strata and may
    also reach the world."""
    if not grant.allows(request):
        raise PermissionError("the request exceeds the grant")
    if request.authority > 0 and (request.strata is None or request.strata & private):
        raise PermissionError("private reads and effects on the world exclude each other")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size; nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def forced(df: DataFrame, most_bytes: int) -> DataFrame:
    """df, or a refusal if its estimate exceeds the ceiling."""
    size = estimated_bytes(df)
    if size > most_bytes:
        raise ValueError(f"the estimate of {size} bytes exceeds {most_bytes}")
    return df
