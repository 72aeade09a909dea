"""Exact sequencing: the cheapest order of up to 18 stops, by Held-Karp, one group a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LIMIT = 18


def held_karp(cost: np.ndarray, start: int = 0, round_trip: bool = False) -> tuple[float, list[int]]:
    """(cost, order) from ``start`` over all nodes; inf where a leg is missing."""
    n = len(cost)
    if n > LIMIT:
        raise ValueError(f"at most {LIMIT} stops")
    if n == 1:
        return 0.0, [start]
    rest = [i for i in range(n) if i != start]
    m = len(rest)
    leg = cost[np.ix_(rest, rest)].astype(float)
    best = np.full((1 << m, m), np.inf)
    came = np.zeros((1 << m, m), np.int8)
    best[1 << np.arange(m), np.arange(m)] = cost[start, rest]
    for mask in range(1, 1 << m):
        here = best[mask]
        if not np.isfinite(here).any():
            continue
        step = here[:, None] + leg
        last = step.argmin(0)
        to = step[last, np.arange(m)]
        for j in range(m):
            if not mask >> j & 1 and to[j] < best[mask | 1 << j, j]:
                best[mask | 1 << j, j], came[mask | 1 << j, j] = to[j], last[j]
    full = (1 << m) - 1
    ends = best[full] + (cost[rest, start] if round_trip else 0)
    j = int(ends.argmin())
    total, order, mask = float(ends[j]), [], full
    while mask:
        order.append(rest[j])
        mask, j = mask & ~(1 << j), int(came[mask, j])
    return total, [start, *order[::-1]]


def sequence(matrix: DataFrame, key: str, round_trip: bool = False) -> DataFrame:
    """For each ``key`` of a (key, src, dst, cost) table: (key, total, stops), from the least
    stop. A stop list without a finite order has a NULL total."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        stops = sorted({*pdf["src"], *pdf["dst"]})
        at = {s: i for i, s in enumerate(stops)}
        cost = np.full((len(stops), len(stops)), np.inf)
        for s, d, c in zip(pdf["src"], pdf["dst"], pdf["cost"], strict=True):
            cost[at[s], at[d]] = min(cost[at[s], at[d]], c)
        total, order = held_karp(cost, 0, round_trip)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "total": [total if np.isfinite(total) else None], "stops": [[int(stops[i]) for i in order]]})

    return matrix.select(key, "src", "dst", "cost").groupBy(key).applyInPandas(solve, f"{key} {matrix.schema[key].dataType.simpleString()}, total double, stops array<long>")
