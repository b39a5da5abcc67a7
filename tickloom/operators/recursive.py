"""Recursive indicators (R01-R07) as distributed linear scans.

y_i = a*y_{i-1} + t_i unrolls to the decayed sum of t, which is a running sum of t_j * a^-j scaled
by a^i: plain window functions, no per-row state. Old terms fade: after ``memory(a)`` rows their
weight is below 1e-20, so a halo of that many rows makes each piece of a segmented series exact to
double precision. Second-order filters are decayed sums too, through their impulse response.

Indicator inputs are non-NULL once warm (``start`` = number of leading NULL rows).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import col, ratio
from tickloom.operators import rolling as R
from tickloom.operators.layout import PIECE, POS, SEGMENT_ROWS, Pieces

FADE = 46.0        # exp(-46) is 1e-20
SAFE_EXPONENT = 600.0  # exp(600) times any price stays inside a double


def memory(a: float) -> int:
    return math.ceil(FADE / -math.log(a)) if 0 < a < 1 else 1


def ema_memory(n: int) -> int:
    return memory(1 - 2 / (n + 1)) + n if n > 1 else 1


def rma_memory(n: int) -> int:
    return memory(1 - 1 / n) + n + 1 if n > 1 else 2


def one_block_rows(halo: int, rate: float) -> int:
    """Rows of a piece that lies with its halo in one block of a filter of that rate: its sums then run over the piece as
    it is sorted. A second block would sort the piece twice more per filter, each sort holding all rows of a task."""
    return max(halo, min(SEGMENT_ROWS, int(SAFE_EXPONENT / rate) - halo - 1))


@dataclass(frozen=True)
class Filter:
    """One decayed-sum filter: ``sums`` maps a name to (term, modulation by local offset);
    ``read(offset, values)`` turns the running sums into the value at the current row."""
    out: str
    rate: float
    sums: dict[str, tuple[Column, Column]]
    read: Callable[[Column, dict[str, Column]], Column]


def _share_blocks(filters: list[Filter]) -> list[list[Filter]]:
    """Filters whose rates lie within SAFE_EXPONENT / FADE of each other can use one block length."""
    groups: list[list[Filter]] = []
    for f in sorted(filters, key=lambda f: f.rate):
        if groups and f.rate * FADE <= groups[-1][0].rate * SAFE_EXPONENT * 0.95:
            groups[-1].append(f)
        else:
            groups.append([f])
    return groups


def apply_filters(df: DataFrame, p: Pieces, filters: list[Filter]) -> DataFrame:
    """Scaled running sums per block of a piece, plus what the previous block left.

    All filters of a group share one window per step, so a feature set with a dozen averages needs
    no more sorts than one average.
    """
    for group in _share_blocks(filters):
        offset = F.col(POS) - (F.col(PIECE) * p.rows - p.halo)
        length = p.rows + p.halo + p.ahead
        block = max(1, min(int(SAFE_EXPONENT / group[-1].rate), length + 1))
        single = block > length
        df = df.withColumn("_o", (offset if single else offset % block).cast("double"))
        w = p.so_far
        if not single:
            df = df.withColumn("_b", F.floor(offset / block))
            w = Window.partitionBy(*p.keys, PIECE, "_b").orderBy(POS).rowsBetween(
                Window.unboundedPreceding, 0)
        o = F.col("_o")
        sums = {
            f"_s_{f.out}_{n}": F.sum(term * wave * F.exp(o * f.rate)).over(w)
            for f in group for n, (term, wave) in f.sums.items()
        }
        df = df.withColumns(sums)
        before = {}
        if not single:
            prior = p.whole.rowsBetween(Window.unboundedPreceding, -1)
            at_end = o == block - 1
            for f in group:
                for n in f.sums:
                    held = F.last(F.when(at_end, F.col(f"_s_{f.out}_{n}")), ignorenulls=True).over(prior)
                    before[f"_p_{f.out}_{n}"] = F.coalesce(held, F.lit(0.0)) * math.exp(-f.rate * block)
            df = df.withColumns(before)
        values = {}
        for f in group:
            v = f.read(o, {n: F.col(f"_s_{f.out}_{n}") for n in f.sums})
            if not single:
                v = v + f.read(o + block, {n: F.col(f"_p_{f.out}_{n}") for n in f.sums})
            values[f.out] = F.exp(-o * f.rate) * v
        df = df.withColumns(values).drop("_o", "_b", *sums, *before)
    return df


def decay_filter(out: str, term: Column, a: float) -> Filter:
    """out_i = sum over j <= i of a^(i-j) * term_j."""
    return Filter(out, -math.log(a), {"x": (term, F.lit(1.0))}, lambda o, s: s["x"])


def decayed_sum(df: DataFrame, p: Pieces, out: str, term: Column, a: float) -> DataFrame:
    if a <= 0:
        return df.withColumn(out, term)
    return apply_filters(df, p, [decay_filter(out, term, a)])


def two_pole(df: DataFrame, p: Pieces, out: str, term: Column, c2: float, c3: float) -> DataFrame:
    """out_i = term_i + c2*out_{i-1} + c3*out_{i-2}, with out = 0 before the first row."""
    disc = c2 * c2 + 4 * c3
    o = F.col("_o")
    if abs(c3) < 1e-15:
        return decayed_sum(df, p, out, term, c2)
    if disc < -1e-12:
        r = math.sqrt(-c3)
        angle = math.acos(c2 / (2 * r))
        return apply_filters(df, p, [Filter(
            out, -math.log(r), {"c": (term, F.cos(o * angle)), "s": (term, F.sin(o * angle))},
            lambda at, s: (F.sin((at + 1) * angle) * s["c"] - F.cos((at + 1) * angle) * s["s"])
            / math.sin(angle))])
    if disc <= 1e-12:
        return apply_filters(df, p, [Filter(
            out, -math.log(c2 / 2), {"u": (term, F.lit(1.0)), "k": (term, o)},
            lambda at, s: (at + 1) * s["u"] - s["k"])])
    big, small = (c2 + math.sqrt(disc)) / 2, (c2 - math.sqrt(disc)) / 2
    df = decayed_sum(df, p, "_big", term, big)
    df = decayed_sum(df, p, "_small", term, small)
    return df.withColumn(
        out, (big * F.col("_big") - small * F.col("_small")) / (big - small)
    ).drop("_big", "_small")


def two_pole_memory(c2: float, c3: float) -> int:
    disc = c2 * c2 + 4 * c3
    r = math.sqrt(-c3) if disc < 0 else (abs(c2) + math.sqrt(max(disc, 0.0))) / 2
    return 2 * memory(r) if abs(disc) <= 1e-12 else memory(r)


@dataclass(frozen=True)
class Average:
    """Exponential average seeded by the mean of the first n inputs; NULL before."""
    out: str
    x: str
    n: int
    alpha: float
    start: int = 0


def ema_of(out: str, x: str = "close", n: int = 20, start: int = 0) -> Average:
    return Average(out, x, n, 2 / (n + 1), start)


def rma_of(out: str, x: str, n: int, start: int = 0) -> Average:
    return Average(out, x, n, 1 / n, start)


def averages(df: DataFrame, p: Pieces, *wanted: Average) -> DataFrame:
    """Several exponential averages of existing columns in one go."""
    terms = {}
    for a in wanted:
        warm, x = a.start + a.n - 1, F.col(a.x)
        seed = F.avg(x).over(p.last(a.n))
        terms[f"_term_{a.out}"] = (
            F.when(F.col(POS) < warm, 0.0).when(F.col(POS) == warm, seed)
            .otherwise(F.coalesce(x * a.alpha, F.lit(0.0))))
    df = df.withColumns(terms)
    df = apply_filters(df, p, [decay_filter(a.out, F.col(f"_term_{a.out}"), 1 - a.alpha)
                               for a in wanted if a.alpha < 1])
    df = df.withColumns({a.out: F.col(f"_term_{a.out}") for a in wanted if a.alpha >= 1})
    return df.withColumns({
        a.out: F.when(F.col(POS) >= a.start + a.n - 1, F.col(a.out)) for a in wanted}).drop(*terms)


def ema(df: DataFrame, p: Pieces, out: str, x: str = "close", n: int = 20, start: int = 0) -> DataFrame:
    return averages(df, p, ema_of(out, x, n, start))


def rma(df: DataFrame, p: Pieces, out: str, x: str, n: int, start: int = 0) -> DataFrame:
    return averages(df, p, rma_of(out, x, n, start))


def ewm(df: DataFrame, p: Pieces, out: str, x, span: int) -> DataFrame:
    """Unseeded exponential average: starts at the first value."""
    alpha = 2 / (span + 1)
    term = F.when(F.col(POS) == 0, col(x)).otherwise(col(x) * alpha)
    return decayed_sum(df, p, out, term, 1 - alpha)


def atr(df: DataFrame, p: Pieces, out: str, n: int) -> DataFrame:
    df = df.withColumn("_tr", R.true_range(p))
    return rma(df, p, out, "_tr", n, start=1).drop("_tr")


def natr(df: DataFrame, p: Pieces, out: str, n: int) -> DataFrame:
    df = atr(df, p, out, n)
    return df.withColumn(out, ratio(100 * F.col(out), "close"))


@dataclass(frozen=True)
class Macd:
    fast: int = 21
    slow: int = 42
    signal: int = 9
    x: str = "close"
    names: tuple[str, str, str] = ("macd", "macd_signal", "macd_hist")

    def first(self) -> list[Average]:
        line = self.names[0]
        return [ema_of(f"_fast_{line}", self.x, self.fast), ema_of(f"_slow_{line}", self.x, self.slow)]

    def between(self) -> dict[str, Column]:
        line = self.names[0]
        return {line: F.col(f"_fast_{line}") - F.col(f"_slow_{line}")}

    def second(self) -> list[Average]:
        return [ema_of(self.names[1], self.names[0], self.signal, max(self.fast, self.slow) - 1)]

    def finish(self) -> dict[str, Column]:
        return {self.names[2]: F.col(self.names[0]) - F.col(self.names[1])}


@dataclass(frozen=True)
class Rsi:
    out: str = "rsi"
    n: int = 14

    def first(self) -> list[Average]:
        return [rma_of(f"_g_{self.out}", "_gain", self.n, 1), rma_of(f"_l_{self.out}", "_loss", self.n, 1)]

    def between(self) -> dict[str, Column]:
        g, l = F.col(f"_g_{self.out}"), F.col(f"_l_{self.out}")
        return {self.out: ratio(100 * g, g + l)}

    def second(self) -> list[Average]:
        return []

    def finish(self) -> dict[str, Column]:
        return {}


@dataclass(frozen=True)
class Adx:
    """ADX with both directional indicators; a bar without movement counts as DX 0."""
    n: int = 14
    names: tuple[str, str, str] = ("adx", "di_plus", "di_minus")

    def first(self) -> list[Average]:
        return [rma_of("_atr_adx", "_tr", self.n, 1), rma_of("_p_adx", "_pdm", self.n, 1),
                rma_of("_m_adx", "_mdm", self.n, 1)]

    def between(self) -> dict[str, Column]:
        plus = ratio(100 * F.col("_p_adx"), "_atr_adx")
        minus = ratio(100 * F.col("_m_adx"), "_atr_adx")
        dx = F.coalesce(ratio(100 * F.abs(plus - minus), plus + minus), F.lit(0.0))
        return {self.names[1]: plus, self.names[2]: minus, "_dx": F.when(F.col(POS) >= self.n, dx)}

    def second(self) -> list[Average]:
        return [rma_of(self.names[0], "_dx", self.n, self.n)]

    def finish(self) -> dict[str, Column]:
        return {}


def indicators(df: DataFrame, p: Pieces, *wanted, extra: tuple[Average, ...] = (), x: str = "close") -> DataFrame:
    """Several two-step indicators together: one batch of averages, then one over their results."""
    start = df.columns
    inputs = {}
    if any(isinstance(i, Rsi) for i in wanted):
        change = R.diff(x, 1, p)
        inputs |= {"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))}
    if any(isinstance(i, Adx) for i in wanted) or any(a.x == "_tr" for a in extra):
        up = F.col("high") - R.shift("high", 1, p)
        down = R.shift("low", 1, p) - F.col("low")
        inputs |= {"_tr": R.true_range(p), "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
                   "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0)}
    df = df.withColumns({k: F.when(F.col(POS) > 0, v) for k, v in inputs.items()})
    df = averages(df, p, *[a for i in wanted for a in i.first()], *extra)
    df = df.withColumns({k: v for i in wanted for k, v in i.between().items()})
    second = [a for i in wanted for a in i.second()]
    if second:
        df = averages(df, p, *second)
    df = df.withColumns({k: v for i in wanted for k, v in i.finish().items()})
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in start])


def macd(df: DataFrame, p: Pieces, fast=21, slow=42, signal=9, x="close",
         names=("macd", "macd_signal", "macd_hist")) -> DataFrame:
    return indicators(df, p, Macd(fast, slow, signal, x, names))


def macd_memory(fast=21, slow=42, signal=9) -> int:
    return ema_memory(max(fast, slow)) + ema_memory(signal)


def rsi(df: DataFrame, p: Pieces, out: str, n: int = 14, x="close") -> DataFrame:
    return indicators(df, p, Rsi(out, n), x=x)


def stochastic(df: DataFrame, p: Pieces, k: int = 14, d: int = 3, smooth: int = 3,
               names=("stoch_k", "stoch_d")) -> DataFrame:
    low, high = R.lowest("low", k, p), R.highest("high", k, p)
    df = df.withColumn("_raw", ratio(100 * (F.col("close") - low), high - low))
    df = df.withColumn(names[0], R.mean("_raw", smooth, p))
    return df.withColumn(names[1], R.mean(names[0], d, p)).drop("_raw")


def adx(df: DataFrame, p: Pieces, n: int = 14, names=("adx", "di_plus", "di_minus")) -> DataFrame:
    return indicators(df, p, Adx(n, names))


def adx_memory(n: int = 14) -> int:
    return 2 * rma_memory(n)


def supersmoother_coefficients(n: int) -> tuple[float, float, float]:
    root = math.sqrt(2) * math.pi / n
    a = math.exp(-root)
    c2, c3 = 2 * a * math.cos(root), -a * a
    return 1 - c2 - c3, c2, c3


def supersmoother_rate(n: int) -> float:
    return math.sqrt(2) * math.pi / n


def supersmoother(df: DataFrame, p: Pieces, out: str, x, n: int, start: int = 0) -> DataFrame:
    """Two-pole low-pass filter; the first two outputs equal the first two inputs."""
    c1, c2, c3 = supersmoother_coefficients(n)
    x = col(x)
    df = df.withColumn(
        "_term",
        F.when(F.col(POS) < start, 0.0).when(F.col(POS) == start, x)
        .when(F.col(POS) == start + 1, x - c2 * F.lag(x).over(p.whole)).otherwise(c1 * x),
    )
    df = two_pole(df, p, out, F.col("_term"), c2, c3)
    at = F.col(POS) - start
    return df.withColumn(out, F.when(at > 1, F.col(out)).when(at >= 0, x)).drop("_term")


def smoothing_coefficients(kind: str, n: int) -> dict[str, float]:
    """Recurrence coefficients of the filter family: gain*(b0*x + b1*x1 + b2*x2) + a1*y1 + a2*y2."""
    turn = 2 * math.pi / n
    c = {"gain": 1.0, "b0": 1.0, "b1": 0.0, "b2": 0.0, "a1": 0.0, "a2": 0.0}
    if kind in ("EMA", "RMA", "Ehlers EMA"):
        alpha = {
            "EMA": 2 / (n + 1), "RMA": 1 / n,
            "Ehlers EMA": (math.cos(turn) + math.sin(turn) - 1) / math.cos(turn),
        }[kind]
        return c | {"b0": alpha, "a1": 1 - alpha}
    if kind in ("Gaussian", "Butterworth"):
        beta = 2.415 * (1 - math.cos(turn))
        alpha = math.sqrt(beta * beta + 2 * beta) - beta
        c |= {"gain": alpha * alpha, "a1": 2 * (1 - alpha), "a2": -((1 - alpha) ** 2)}
        if kind == "Butterworth":
            c |= {"gain": alpha * alpha / 4, "b1": 2.0, "b2": 1.0}
        return c
    if kind == "BandStop":
        beta, gamma = math.cos(turn), 1 / math.cos(0.2 * turn)
        alpha = gamma - math.sqrt(gamma * gamma - 1)
        return c | {"gain": (1 + alpha) / 2, "b1": -2 * beta, "b2": 1.0,
                    "a1": beta * (1 + alpha), "a2": -alpha}
    raise ValueError(f"unknown filter {kind!r}")


def smoothing_memory(kind: str, n: int) -> int:
    if kind == "SMA":
        return n
    if kind == "SuperSmoother":
        return two_pole_memory(*supersmoother_coefficients(n)[1:])
    c = smoothing_coefficients(kind, n)
    return two_pole_memory(c["a1"], c["a2"])


def smoothing(df: DataFrame, p: Pieces, out: str, x, n: int, kind: str) -> DataFrame:
    """Filter family as true recurrences, outputs 0 before the first row, NULL for the first n-1.

    Missing earlier inputs count as the current one; SMA is the plain rolling mean.
    """
    if kind == "SuperSmoother":
        return supersmoother(df, p, out, x, n)
    if kind == "SMA":
        return df.withColumn(out, R.mean(x, n, p))
    x, c = col(x), smoothing_coefficients(kind, n)
    x1 = F.coalesce(F.lag(x, 1).over(p.whole), x)
    x2 = F.coalesce(F.lag(x, 2).over(p.whole), x)
    df = df.withColumn("_term", c["gain"] * (c["b0"] * x + c["b1"] * x1 + c["b2"] * x2))
    df = two_pole(df, p, out, F.col("_term"), c["a1"], c["a2"])
    return df.withColumn(out, F.when(F.col(POS) >= n - 1, F.col(out))).drop("_term")
