"""Filters that need more than a window frame (W17, W18, P25): NumPy over bounded chunks of a series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.operators.ordered import Series, chunked
from sensorframe.operators.quantiles import attach
from sensorframe.session import stage


def _group_starts(pdf: pd.DataFrame, group: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(pdf), dtype=bool)
    new[0] = True
    for c in group:
        v = pdf[c]
        same = (v == v.shift()) | (v.isna() & v.shift().isna())
        new[1:] |= ~same.to_numpy(dtype=bool)[1:]
    return np.flatnonzero(new)


def _chunk_apply(parts: DataFrame, s: Series, fn, out_cols: Sequence[str]) -> DataFrame:
    """Run ``fn(frame in rn order)`` per chunk; it returns an array per output column for all its rows.

    Chunks of one partition follow each other in its batches, so many short series cost one call, and a task holds
    one chunk and one batch at most.
    """
    keep = [f for f in parts.schema.fields if f.name not in ("_chunk", "_halo", "_n")]
    schema = T.StructType(keep + [T.StructField(c, T.DoubleType()) for c in out_cols])
    names = [f.name for f in keep]
    group = [*s.keys, "_chunk"]

    def finish(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = np.full((len(out_cols), len(pdf)), np.nan)
        for a, z in zip(starts, [*starts[1:], len(pdf)]):
            for i, values in enumerate(fn(pdf.iloc[a:z])):
                out[i, a:z] = values
        res = pdf[names].copy()
        for i, c in enumerate(out_cols):
            res[c] = out[i]
        return res[~pdf["_halo"].to_numpy(dtype=bool)]

    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            edge = pd.concat([held[-1].iloc[-1:], pdf], ignore_index=True) if held else pdf
            if held and len(_group_starts(edge, group)) == 1:
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf], ignore_index=True)
            starts = _group_starts(whole, group)
            if len(starts) > 1:
                yield finish(whole.iloc[: starts[-1]], starts[:-1])
            held = [whole.iloc[starts[-1]:]]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield finish(whole, np.array([0]))

    ready = parts.repartition(*group).sortWithinPartitions(*group, "rn")
    return ready.mapInPandas(run, schema)


def _with_length(df: DataFrame, s: Series) -> DataFrame:
    return attach(df, df.groupBy(*s.keys).agg(F.count("*").alias("_n")), s.keys)


def resolve_window(n: int, window: int, order: int) -> tuple[int, int]:
    """Odd window of at least 3 that fits ``n`` rows, and a polynomial order below it."""
    if n < 3:
        raise ValueError("smoothing needs at least three rows")
    window = max(window, 3) | 1
    window = min(window, n if n % 2 else n - 1)
    return window, max(1, min(order, window - 1))


def _smooth(v: np.ndarray, rn: np.ndarray, n: int, window: int, order: int) -> np.ndarray:
    h = window // 2
    x = np.arange(-h, h + 1, dtype=float)
    hat = np.vander(x, order + 1, increasing=True)
    fit = hat @ np.linalg.pinv(hat)  # row i gives the polynomial's value at position i of a window
    out = np.full(len(v), np.nan)
    if len(v) >= window:
        out[h: len(v) - h] = np.lib.stride_tricks.sliding_window_view(v, window) @ fit[h]
        if rn[0] == 0:
            out[:h] = fit[:h] @ v[:window]
        if rn[-1] == n - 1:
            out[len(v) - h:] = fit[h + 1:] @ v[len(v) - window:]
    return out


def savgol(df: DataFrame, s: Series, cols: Sequence[str], window: int, order: int, suffix: str = "_smooth", rows: int = 200_000) -> DataFrame:
    """Polynomial smoothing over ``window`` rows; the ends follow the polynomial of the first and last window.

    Series with fewer than three rows keep nulls.
    """
    window = max(window, 3) | 1
    parts = chunked(_with_length(df, s), s, window, window, max(rows, window))

    def fn(pdf):
        n, rn = int(pdf["_n"].iloc[0]), pdf["rn"].to_numpy()
        if n < 3:
            return [np.full(len(pdf), np.nan) for _ in cols]
        w, p = resolve_window(n, window, order)
        return [_smooth(pdf[c].to_numpy(float), rn, n, w, p) for c in cols]

    out = _chunk_apply(parts, s, fn, [c + suffix for c in cols])
    return out.drop("rn")


def butterworth(order: int, cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass coefficients ``b, a`` by the bilinear transform."""
    if not 0 < cutoff < rate / 2:
        raise ValueError("cutoff must lie below half the rate")
    warped = 2.0 * np.tan(np.pi * cutoff / rate)
    k = np.arange(1, order + 1)
    poles = warped * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    z = (2.0 + poles) / (2.0 - poles)
    a = np.real(np.poly(z))
    b = np.poly(-np.ones(order))
    return b * (a.sum() / b.sum()), a


def _impulse(b: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(n)
    for i in range(n):
        past = sum(a[j] * h[i - j] for j in range(1, min(i, len(a) - 1) + 1))
        h[i] = (b[i] if i < len(b) else 0.0) - past
    return h


def response_length(b: np.ndarray, a: np.ndarray) -> int:
    """Rows after which the impulse response stays below double precision."""
    radius = max(np.abs(np.roots(a)).max(), 0.05)
    return int(np.ceil(np.log(1e-20) / np.log(radius))) + 8 * len(a)


def _filter_chunk(v: np.ndarray, first: bool, last: bool, h: np.ndarray, pad: int) -> np.ndarray:
    """Forward then backward filtering of one chunk; true series ends are mirrored through their end value."""
    reach = len(h)
    pad = min(pad, len(v) - 1)
    lead = 2 * v[0] - v[pad:0:-1] if first and pad else v[:0]
    tail = 2 * v[-1] - v[-2:-pad - 2:-1] if last and pad else v[:0]
    x = np.concatenate([lead, v, tail])
    forward = np.convolve(np.concatenate([np.full(reach, x[0]), x]), h)[reach: reach + len(x)]
    back = np.convolve(np.concatenate([np.full(reach, forward[-1]), forward[::-1]]), h)[reach: reach + len(x)][::-1]
    return back[len(lead): len(lead) + len(v)]


def lowpass(df: DataFrame, s: Series, cols: Sequence[str], rate_hz: float, *, cutoff_hz: float = 15.0, order: int = 4, suffix: str = "_filt", rows: int = 200_000) -> DataFrame:
    """Zero-phase low-pass per column.

    The filter forgets: beyond ``response_length`` rows its response is below double precision. A chunk with borders
    of that length therefore gives the values of the whole series, and no task holds more than a chunk.
    """
    b, a = butterworth(order, cutoff_hz, rate_hz)
    reach = response_length(b, a)
    h = _impulse(b, a, reach)
    pad = 3 * max(len(a), len(b))
    parts = chunked(_with_length(df, s), s, reach + pad, reach + pad, max(rows, 4 * (reach + pad)))

    def fn(pdf):
        n, rn = int(pdf["_n"].iloc[0]), pdf["rn"].to_numpy()
        return [_filter_chunk(pdf[c].to_numpy(float), rn[0] == 0, rn[-1] == n - 1, h, pad) for c in cols]

    return _chunk_apply(parts, s, fn, [c + suffix for c in cols]).drop("rn")


def _ends(nxt: np.ndarray) -> np.ndarray:
    """Where each place's path of next places ends, by doubling the step; ``len(nxt)`` stands for no next place."""
    jump = np.where(nxt < len(nxt), nxt, np.arange(len(nxt)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


def _path(nxt: np.ndarray, start: int) -> np.ndarray:
    """The places of the path from ``start``: each round appends as many as there are, one jump of that many steps from each."""
    jump, path = np.append(nxt, len(nxt)), np.array([start])
    while True:
        more = jump[path]
        more = more[more < len(nxt)]
        if not len(more):
            return path
        path, jump = np.concatenate([path, more]), jump[jump]


def rate_cap(df: DataFrame, s: Series, max_fps: float, rows: int = 200_000) -> DataFrame:
    """P25: keep a row when at least ``1/max_fps`` has passed since the last kept one.

    Which rows of a chunk stay depends on earlier chunks only through the first row kept in it, and that is one of
    the few rows within one step of the chunk start. Each chunk reports where each of these leads, a small table
    per key chains the chunks, and each chunk then picks its rows.
    """
    step = int(1e9 / max_fps)
    ts, keys, names = s.ts, list(s.keys), df.columns  # plain values only: the functions below run in tasks
    parts = stage(chunked(df, s, 0, 0, rows).drop("_halo"))
    key_fields = [parts.schema[k] for k in s.keys]
    ends = T.StructType(key_fields + [T.StructField(c, T.LongType()) for c in ("_chunk", "_t", "_rn", "_exit")])

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        t, rn = pdf[ts].to_numpy("int64"), pdf["rn"].to_numpy("int64")
        last = t[_ends(np.searchsorted(t, t + step))]
        n = min(int(np.searchsorted(t, t[0] + step)) + 1, len(t))
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys}, index=range(n))
        return out.assign(_chunk=pdf["_chunk"].iloc[0], _t=t[:n], _rn=rn[:n], _exit=last[:n])

    starts = T.StructType(key_fields + [T.StructField(c, T.LongType()) for c in ("_chunk", "_start")])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        last, found = None, []
        for chunk, g in pdf.sort_values(["_chunk", "_rn"]).groupby("_chunk", sort=True):
            ok = g if last is None else g[g["_t"] >= last + step]
            if len(ok):
                found.append((chunk, ok["_rn"].iloc[0]))
                last = ok["_exit"].iloc[0]
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys}, index=range(len(found)))
        return out.assign(_chunk=[f[0] for f in found], _start=[f[1] for f in found])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn").reset_index(drop=True)
        t = pdf[ts].to_numpy("int64")
        return pdf.loc[_path(np.searchsorted(t, t + step), int(pdf["_start"].iloc[0] - pdf["rn"].iloc[0])), names]

    group = [*s.keys, "_chunk"]
    heads = parts.groupBy(*group).applyInPandas(exits, ends)
    first = heads.groupBy(*s.keys).applyInPandas(chain, starts)
    ready = attach(parts, first, group).where(F.col("_start").isNotNull())
    return ready.groupBy(*group).applyInPandas(pick, df.schema)
