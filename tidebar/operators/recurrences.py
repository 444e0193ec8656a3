"""Recursive indicators of a symbol's series, carried across blocks of time.

EMA and Wilder's averages are affine steps, s -> a * s + b, and so are their seeds: the first value of an EMA has a = 0, and each of the first ``period`` values of a Wilder average
adds its share to a sum that begins at 0. A block of bars composes to one such step, whatever came before. So a series is worked on in
three parts: its blocks side by side give (a, b) of each average; one short fold over a symbol's blocks gives the state in which each begins; and the blocks,
side by side again, are replayed from that. A block is a grouped map, a series is not.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPANS = (9, 20, 50, 100, 200)
#: Seconds of a block: two years, a million bars of a minute.
SPAN = 63_072_000


def scan(a: np.ndarray, b: np.ndarray, state: float) -> np.ndarray:
    """The states after each affine step."""
    return np.fromiter(accumulate(zip(a.tolist(), b.tolist(), strict=True), lambda s, ab: ab[0] * s + ab[1], initial=state), float, len(a) + 1)[1:]


def composed(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """All steps as one."""
    later = np.append(np.cumprod(a[:0:-1])[::-1], 1.0)
    return float(a[0] * later[0]) if len(a) else 1.0, float(b @ later) if len(a) else 0.0


def ema_steps(x: np.ndarray, span: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the average; the values of x are the series' from index ``first`` on. Seeded with the first value; no warm-up nulls."""
    k, seed = 2 / (span + 1), first + np.arange(len(x)) == 0
    return np.where(seed, 0.0, 1 - k), np.where(seed, x, k * x)


def wilder_steps(x: np.ndarray, period: int, start: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the mean of the ``period`` values from index ``start`` on, then of Wilder's smoothing."""
    i = first + np.arange(len(x))
    return np.where(i < start + period, 1.0, (period - 1) / period), np.where(i < start, 0.0, x / period)


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return scan(*ema_steps(x, span), 0.0)


def wilder(x: np.ndarray, period: int, start: int) -> np.ndarray:
    """NaN before the mean of the first ``period`` values."""
    return np.where(np.arange(len(x)) < start + period - 1, np.nan, scan(*wilder_steps(x, period, start), 0.0))


def rsi(c: np.ndarray, period: int = 14) -> np.ndarray:
    d = np.diff(c, prepend=c[:1])
    return _strength(wilder(np.maximum(d, 0), period, 1), wilder(np.maximum(-d, 0), period, 1))


def _strength(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(gain), np.nan, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)))


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray, before: float | None = None) -> np.ndarray:  # noqa: E741
    """``before`` is the close before the first bar; without one its range is h - l."""
    last = np.concatenate([c[:1] if before is None else [before], c[:-1]])
    true = np.maximum(h - l, np.maximum(abs(h - last), abs(l - last)))
    if before is None and len(true):
        true[0] = h[0] - l[0]
    return true


def atr(h: np.ndarray, l: np.ndarray, c: np.ndarray, period: int = 14) -> np.ndarray:  # noqa: E741
    return wilder(true_range(h, l, c), period, 0)


class Indicators:
    """The averages behind ema9 ... ema200, rsi and atr of one series: their steps over some bars, and their values from a state."""

    def __init__(self, spans: tuple[int, ...] = SPANS, period: int = 14):
        self.spans, self.period = spans, period
        self.names = [f"ema{s}" for s in spans] + [f"rsi{period}", f"atr{period}"]

    def steps(self, h: np.ndarray, l: np.ndarray, c: np.ndarray, first: int, before: float | None) -> list[tuple[np.ndarray, np.ndarray]]:  # noqa: E741
        """Of bars from the series' index ``first`` on, after a close of ``before``."""
        d = np.diff(c, prepend=c[:1] if before is None else [before])
        wilders = (np.maximum(d, 0), 1), (np.maximum(-d, 0), 1), (true_range(h, l, c, before), 0)
        return [ema_steps(c, s, first) for s in self.spans] + [wilder_steps(x, self.period, start, first) for x, start in wilders]

    def states(self, steps: list[tuple[np.ndarray, np.ndarray]], state: list[float]) -> np.ndarray:
        """A row for each average, a column for each bar."""
        return np.array([scan(a, b, s) for (a, b), s in zip(steps, state, strict=True)])

    def values(self, states: np.ndarray, first: int) -> dict[str, np.ndarray]:
        i, p = first + np.arange(states.shape[1]), self.period
        known = np.where(i < p, np.nan, states[-3]), np.where(i < p, np.nan, states[-2])
        return dict(zip(self.names, [*states[:-3], _strength(*known), np.where(i < p - 1, np.nan, states[-1])], strict=True))

    def empty(self) -> list[float]:
        return [0.0] * (len(self.spans) + 3)


def in_blocks(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """bars with their block of time."""
    return bars.withColumn("_block", F.floor(F.col("t") / span).cast("long"))


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("t", kind="stable")
    return pdf, *(pdf[k].to_numpy(dtype=float) for k in "hlc")


def _before(row: pd.Series) -> float | None:
    return None if pd.isna(row["_before"]) else float(row["_before"])


def with_recurrences(bars: DataFrame, span: int = SPAN, spans: tuple[int, ...] = SPANS, period: int = 14) -> DataFrame:
    """bars with ema9 ... ema200, rsi14 and atr14 (null in warm-up)."""
    kind = Indicators(spans, period)
    keyed = in_blocks(bars, span)
    by = Window.partitionBy("symbol").orderBy("_block")
    begins = keyed.groupBy("symbol", "_block").agg(F.count("*").alias("n"), F.max_by("c", "t").alias("last"))
    first = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first")
    begins = begins.select("symbol", "_block", first, F.lag("last").over(by).alias("_before"))

    def compose(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        _, h, l, c = _sorted(pdf)  # noqa: E741
        row = begin.iloc[0]
        pairs = [composed(a, b) for a, b in kind.steps(h, l, c, int(row["_first"]), _before(row))]
        return begin.assign(a=[[a for a, _ in pairs]], b=[[b for _, b in pairs]])

    blocks = ["symbol", "_block"]
    step = "symbol string, _block long, _first long, _before double"
    parts = keyed.select("symbol", "_block", "t", "h", "l", "c").groupBy(*blocks).cogroup(begins.groupBy(*blocks)).applyInPandas(compose, f"{step}, a array<double>, b array<double>")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row for each block of a symbol: the state it begins in."""
        pdf = pdf.sort_values("_block")
        begun, state = [], np.array(kind.empty())
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            begun.append(state.tolist())
            state = np.asarray(a) * state + np.asarray(b)
        return pdf[["symbol", "_block", "_first", "_before"]].assign(_state=begun)

    begun = parts.groupBy("symbol").applyInPandas(carry, f"{step}, _state array<double>")

    def replay(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        pdf, h, l, c = _sorted(pdf)  # noqa: E741
        row = begin.iloc[0]
        at = int(row["_first"])
        new = kind.values(kind.states(kind.steps(h, l, c, at, _before(row)), list(row["_state"])), at)
        return pdf.drop(columns="_block").assign(**{k: pd.Series(v, index=pdf.index).astype("Float64").where(~np.isnan(v)) for k, v in new.items()})

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in bars.schema] + [f"{n} double" for n in kind.names])
    return keyed.groupBy(*blocks).cogroup(begun.groupBy(*blocks)).applyInPandas(replay, schema)
