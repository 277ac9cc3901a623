"""The few grouped kernels: data-dependent merging of short runs, and penalised smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def merge_short(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Merge runs (start, stop, level) shorter than ``least`` into a touching neighbour one level away, until none can be.

    The shortest goes first, of equal ones the earliest; it takes the nearer level, then the longer neighbour, then the
    left. No sample's level moves by more than one from what it was.
    """
    # start, stop, level, lowest and highest original level inside
    live = [[a, b, v, v, v] for a, b, v in runs]

    def takes(i: int, j: int) -> bool:
        touch = live[j][1] == live[i][0] if j < i else live[i][1] == live[j][0]
        return touch and max(abs(live[j][2] - live[i][3]), abs(live[j][2] - live[i][4])) <= 1

    while True:
        best = None
        for i, r in enumerate(live):
            if r[1] - r[0] < least and (best is None or r[1] - r[0] < live[best][1] - live[best][0]) and any(0 <= j < len(live) and takes(i, j) for j in (i - 1, i + 1)):
                best = i
        if best is None:
            return [(a, b, v) for a, b, v, _, _ in live]
        r = live[best]
        options = [j for j in (best - 1, best + 1) if 0 <= j < len(live) and takes(best, j)]
        j = min(options, key=lambda j: (abs(live[j][2] - r[2]), live[j][0] - live[j][1], j))
        into = live[j]
        live[min(best, j) : max(best, j) + 1] = [[min(r[0], into[0]), max(r[1], into[1]), into[2], min(r[3], into[3]), max(r[4], into[4])]]
        at = min(best, j)
        for i in (at, at - 1):  # equal neighbours are one run
            if 0 <= i < len(live) - 1 and live[i][1] == live[i + 1][0] and live[i][2] == live[i + 1][2]:
                p, q = live[i], live[i + 1]
                live[i : i + 2] = [[p[0], q[1], p[2], min(p[3], q[3]), max(p[4], q[4])]]


def merge_short_runs(runs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Apply merge_short to each unit's runs (run_start, run_stop, level). A unit's runs are one group in memory."""
    types = dict(runs.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "run_start long, run_stop long, level int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run_start")
        merged = merge_short(list(zip(frame.run_start.tolist(), frame.run_stop.tolist(), frame.level.tolist(), strict=True)), least)
        out = pd.DataFrame(merged, columns=["run_start", "run_stop", "level"])
        for k in reversed(keys):
            out.insert(0, k, frame[k].iloc[0])
        return out

    return runs.groupBy(*keys).applyInPandas(run, schema)


def whittaker(y: np.ndarray, weight: float) -> np.ndarray:
    """Smooth by second differences: (I + weight D'D) x = y, solved along its five diagonals; under three values stay."""
    n = len(y)
    if n < 3:
        return y.copy()
    main, one, two = np.ones(n), np.zeros(n), np.zeros(n)
    for offset, c in enumerate((1.0, -2.0, 1.0)):
        main[offset : n - 2 + offset] += weight * c * c
    one[:-1] += weight * np.convolve(np.ones(n - 2), [-2.0, -2.0])[: n - 1]
    two[: n - 2] = weight
    d, e, f, z = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):  # LDL' of a symmetric pentadiagonal matrix
        d[i] = main[i] - (d[i - 1] * e[i - 1] ** 2 if i > 0 else 0) - (d[i - 2] * f[i - 2] ** 2 if i > 1 else 0)
        e[i] = (one[i] - (d[i - 1] * e[i - 1] * f[i - 1] if i > 0 else 0)) / d[i]
        f[i] = two[i] / d[i]
        z[i] = y[i] - (e[i - 1] * z[i - 1] if i > 0 else 0) - (f[i - 2] * z[i - 2] if i > 1 else 0)
    x = z / d
    for i in range(n - 2, -1, -1):
        x[i] -= e[i] * x[i + 1] + (f[i] * x[i + 2] if i < n - 2 else 0)
    return x


def smooth(df: DataFrame, keys: list[str], idx: str, value: str, weight: float = 2.0) -> DataFrame:
    """Whittaker smoothing of each unit's stretch in order of idx, as column smoothed."""
    types = dict(df.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in [*keys, idx, value]) + "smoothed double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(idx)
        return frame.assign(smoothed=whittaker(frame[value].to_numpy(float), weight))

    return df.select(*keys, idx, value).groupBy(*keys).applyInPandas(run, schema)
