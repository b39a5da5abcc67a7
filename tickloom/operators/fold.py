"""State machines over a series (R08, R09) whose state has no closed form.

Three steps, whatever the series looks like:

1. every piece of the segmented series is read once, without its start state, and gives its *effect*: how it ends for
   every kind of start. A start matters until the machine first resets inside the piece, so an effect is a short
   table of bounds and end states, and the rule of a piece that never resets;
2. per series, the effects (one row per piece, as for any running value) are applied one after another, which
   gives each piece its start state;
3. every piece runs once from its start state.

Nothing is guessed or repeated: a series that never resets takes the same three steps. Series with NULL keys are series.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.operators.layout import OWN, PIECE, POS, Pieces

State = tuple[float, ...]
Table = list[list[float]]


class Machine(ABC):
    """A state machine: the columns it adds, its first state, and what a piece does."""

    columns: list[str]
    initial: State

    @abstractmethod
    def run(self, rows: pd.DataFrame, state: State) -> dict[str, np.ndarray]:
        """The columns of rows in order, from a start state."""

    @abstractmethod
    def effect(self, rows: pd.DataFrame) -> Table:
        """What the rows do to any start state."""

    @abstractmethod
    def apply(self, effect: Table, state: State) -> State:
        """The state after a piece."""


def fold_series(df: DataFrame, p: Pieces, machine: Machine) -> DataFrame:
    """Adds the machine's ``columns`` (doubles); returns own rows, layout columns kept."""
    place, own = [*p.keys, PIECE], df.filter(OWN)
    fields = {f.name: f for f in df.schema.fields}
    key_fields = [fields[k] for k in place]

    def summarise(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, machine.effect(rows.sort_values(POS, kind="stable"))]], columns=[*place, "_effect"])

    def resolve(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces, state, starts = pieces.sort_values(PIECE), machine.initial, []
        for effect in pieces["_effect"]:
            starts.append([float(v) for v in state])
            state = machine.apply([list(r) for r in effect], state)
        return pieces[place].assign(_start=starts)

    def finish(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(POS, kind="stable")
        return rows.assign(**machine.run(rows, tuple(start["_start"].iloc[0])))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    effects = own.groupBy(*place).applyInPandas(summarise, f"{names}, _effect array<array<double>>")
    starts = effects.groupBy(*p.keys).applyInPandas(resolve, f"{names}, _start array<double>")
    # own names: both sides stem from the same rows
    starts = starts.select(*[F.col(k).alias(f"_s_{k}") for k in place], "_start")
    schema = StructType(df.schema.fields + [StructField(c, DoubleType()) for c in machine.columns])
    return own.groupBy(*place).cogroup(starts.groupBy(*[f"_s_{k}" for k in place])).applyInPandas(finish, schema)


def _merged(table: Table, tail: State | None) -> Table:
    """Drop bounds that make no difference: neighbours, or the last one and the tail, with one outcome."""
    out: Table = []
    for row in table:
        if out and out[-1][1:] == row[1:]:
            out[-1] = row
        else:
            out.append(row)
    while out and tail is not None and tuple(out[-1][1:]) == tail:
        out.pop()
    return out


class ResetSum(Machine):
    """Running sum of slope changes, set to zero when it gives back a share of its extreme.

    State: sum, highest, lowest, trend (0 none, 1 up, -1 down). Going up, a start (sum t, highest h) flips at the first row i
    where t + S(i) <= keep * max(h, t + top(i)), S and top being the running sum and its maximum: the first row with
    S <= keep * h - t, or with keep * top - S >= (1 - keep) * t, whichever comes first. Both are records of the piece.
    Going down is the mirror image. Sums of different pieces are added up, so values agree with one pass
    up to rounding.
    """

    def __init__(self, out: str, change: str, sensitivity: float):
        self.columns, self.initial, self.change, self.keep = [out], (0.0, 0.0, 0.0, 0.0), change, 1 - sensitivity

    def _steps(self, changes: list[float], state: State, note=None) -> State:
        total, high, low, trend = state
        for i, d in enumerate(changes):
            total += d
            flipped = False
            if trend > 0:
                high = max(high, total)
                flipped = total <= high * self.keep
            elif trend < 0:
                low = min(low, total)
                flipped = total >= low * self.keep
            elif total > 0:
                trend, high = 1.0, total
            elif total < 0:
                trend, low = -1.0, total
            if flipped:
                total, high, low, trend = 0.0, 0.0, 0.0, -trend
            if note is not None and note(i, total, flipped, trend):
                return total, high, low, trend
        return total, high, low, trend

    def run(self, rows: pd.DataFrame, state: State) -> dict[str, np.ndarray]:
        changes = rows[self.change].to_numpy(dtype=float)
        known = ~np.isnan(changes)
        sums: list[float] = []
        self._steps(changes[known].tolist(), state, lambda i, total, *_: sums.append(total))
        result = np.full(len(rows), np.nan)
        result[known] = sums
        return {self.columns[0]: result}

    # rows of the effect: kind and side (1 up, -1 down, 0 no trend), then
    PASS, LOW, GAP, END, FIRST = range(5)

    def effect(self, rows: pd.DataFrame) -> Table:
        changes = rows[self.change].to_numpy(dtype=float)
        d = changes[~np.isnan(changes)].tolist()
        if not d:
            return []
        after = self._after(d)
        table: Table = []
        for side in (1.0, -1.0):
            s, top, lowest, widest, wanted = 0.0, -np.inf, np.inf, -np.inf, set()
            for i, x in enumerate(d):
                s += side * x
                top = max(top, s)
                gap = self.keep * top - s
                if s < lowest:
                    lowest = s
                    table.append([self.LOW, side, s, i])
                    wanted.add(i)
                if gap > widest:
                    widest = gap
                    table.append([self.GAP, side, gap, i])
                    wanted.add(i)
            table += [[self.END, side, i, *after(i, -side)] for i in sorted(wanted)]
            table.append([self.PASS, side, s, top])
        begun: list[State] = []

        def first(i, total, flipped, trend):
            if trend:
                begun.append((float(i), total, trend))
            return bool(trend)

        self._steps(d, self.initial, first)
        if begun:
            i, total, trend = begun[0]
            start = (total, total if trend > 0 else 0.0, total if trend < 0 else 0.0, trend)
            table.append([self.FIRST, 0.0, *self._steps(d[int(i) + 1:], start)])
        return table

    def _after(self, d: list[float]):
        """The end state of a flip to a side at row i; chains of flips are walked once."""
        known: dict[tuple[int, float], State] = {}

        def after(i: int, side: float) -> State:
            path = []
            while (i, side) not in known:
                path.append((i, side))
                at: list[int] = []

                def flip(j, total, flipped, trend):
                    if flipped:
                        at.append(j)
                    return flipped

                end = self._steps(d[i + 1:], (0.0, 0.0, 0.0, side), flip)
                if not at:
                    known[i, side] = end
                else:
                    i, side = i + 1 + at[0], -side
            for step in path:
                known[step] = known[i, side]
            return known[i, side]

        return after

    def apply(self, effect: Table, state: State) -> State:
        total, high, low, trend = state
        if not effect:
            return state
        if trend == 0:
            return next((tuple(r[2:]) for r in effect if r[0] == self.FIRST), state)
        mine = [r for r in effect if r[1] == trend]
        t, h = total * trend, (high if trend > 0 else -low)
        flips = [r[3] for r in mine if r[0] == self.LOW and r[2] <= self.keep * h - t][:1]
        flips += [r[3] for r in mine if r[0] == self.GAP and r[2] >= (1 - self.keep) * t][:1]
        if flips:
            return next(tuple(r[3:]) for r in mine if r[0] == self.END and r[2] == min(flips))
        s, top = next(r[2:] for r in mine if r[0] == self.PASS)
        total, best = trend * (t + s), trend * max(h, t + top)
        return (total, best, low, trend) if trend > 0 else (total, high, best, trend)


class SuperTrendBands(Machine):
    """Bands at mid +- multiplier*ATR; the active band only tightens, a close beyond the
    previous band flips the direction. State: previous upper band, lower band, direction.

    Going up, the upper band is the last bar's own and the lower one is the larger of a bound c and the bars' own. The
    start matters through c until a close leaves the upper band (a new start) or falls below the lower one (a
    flip): the running minima of the closes are the bounds of c, with one end state each. Going down is the
    mirror image. Only comparisons are made, so the result is that of one pass, bit by bit.
    """

    def __init__(self, multiplier: float, atr: str = "_atr"):
        self.columns, self.initial = ["supertrend", "supertrend_way"], (float("inf"), float("-inf"), 1.0)
        self.multiplier, self.atr = multiplier, atr

    def _bands(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mid = ((rows["high"] + rows["low"]) / 2).to_numpy(dtype=float)
        reach = self.multiplier * rows[self.atr].to_numpy(dtype=float)
        close = rows["close"].to_numpy(dtype=float)
        return close, mid + reach, mid - reach, ~np.isnan(mid + reach)

    def run(self, rows: pd.DataFrame, state: State) -> dict[str, np.ndarray]:
        upper0, lower0, way = state
        closes, uppers, lowers, known = self._bands(rows)
        line, ways = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
        at = np.flatnonzero(known)
        for i, close, upper, lower in zip(at.tolist(), closes[at].tolist(), uppers[at].tolist(), lowers[at].tolist()):
            if close > upper0:
                way = 1.0
            elif close < lower0:
                way = -1.0
            elif way > 0:
                lower = max(lower, lower0)
            else:
                upper = min(upper, upper0)
            upper0, lower0 = upper, lower
            line[i], ways[i] = (lower if way > 0 else upper), way
        return {"supertrend": line, "supertrend_way": ways}

    # rows of the effect: the first bar; then per side its bounds, largest first, and what no bound stops
    BAR, BOUND, CONSTANT, CARRY = range(4)

    def effect(self, rows: pd.DataFrame) -> Table:
        closes, uppers, lowers, known = self._bands(rows)
        if not known.any():
            return []
        close, upper, lower = closes[known], uppers[known], lowers[known]
        sides = {1.0: (close.tolist(), upper.tolist(), lower.tolist()), -1.0: ((-close).tolist(), (-lower).tolist(), (-upper).tolist())}
        n = len(close)
        memory: dict[tuple[int, float], State] = {}

        def event(i: int, side: float, bound: float) -> tuple[int, float] | None:
            """The next row after i at which the start no longer matters, and the side from there on."""
            c, other, own = sides[side]
            for j in range(i + 1, n):
                new, flip = c[j] > other[j - 1], c[j] < bound
                if new and (side > 0 or not flip):
                    return j, side
                if flip:
                    return j, -side
                bound = max(bound, own[j])
            return None

        def state_of(side: float, bound: float) -> State:
            last = sides[side][1][-1]
            return (last, bound, 1.0) if side > 0 else (-bound, -last, -1.0)

        def ended(i: int, side: float) -> State:
            """The state after the piece of a machine that starts anew at row i."""
            path = []
            while (i, side) not in memory:
                path.append((i, side))
                after = event(i, side, sides[side][2][i])
                if after is None:
                    memory[i, side] = state_of(side, max(sides[side][2][i:]))
                else:
                    i, side = after
            for step in path:
                memory[step] = memory[i, side]
            return memory[i, side]

        table: Table = [[self.BAR, 0.0, close[0], upper[0], lower[0]]]
        for side in (1.0, -1.0):
            c, other, own = sides[side]
            least, bound, tail, bounds = np.inf, own[0], None, []
            for j in range(1, n):
                new, flip = c[j] > other[j - 1], c[j] < bound
                if new and side > 0:
                    tail = ended(j, side)
                elif flip:
                    tail = ended(j, -side)
                else:
                    if c[j] < least:
                        least = c[j]
                        bounds.append([c[j], *ended(j, -side)])
                    if new:
                        tail = ended(j, side)
                if tail is not None:
                    break
                bound = max(bound, own[j])
            table += [[self.BOUND, side, *row] for row in _merged(bounds, tail)]
            table.append([self.CONSTANT, side, *tail] if tail is not None else [self.CARRY, side, bound, other[-1]])
        return table

    def apply(self, effect: Table, state: State) -> State:
        if not effect:
            return state
        upper0, lower0, way = state
        _, _, close, upper, lower = effect[0]
        if close > upper0:
            way = 1.0
        elif close < lower0:
            way = -1.0
        elif way > 0:
            lower = max(lower, lower0)
        else:
            upper = min(upper, upper0)
        bound = lower if way > 0 else -upper
        for row in effect[1:]:
            if row[1] != way:
                continue
            if row[0] == self.BOUND:
                if bound > row[2]:
                    return tuple(row[3:])
            elif row[0] == self.CONSTANT:
                return tuple(row[2:])
            else:
                bound, last = max(bound, row[2]), row[3]
                return (last, bound, 1.0) if way > 0 else (-bound, -last, -1.0)
        raise AssertionError("an effect without a tail")


def reset_cumsum(out: str, change: str, sensitivity: float) -> ResetSum:
    return ResetSum(out, change, sensitivity)


def supertrend(multiplier: float, atr: str = "_atr") -> SuperTrendBands:
    return SuperTrendBands(multiplier, atr)
