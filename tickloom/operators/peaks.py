"""Peaks and price levels (F03, F04) and the look-back to earlier peaks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import kernels as N
from tickloom.functions.columns import no_nan
from tickloom.operators.blocks import OF, SALTS, nearest_item, series_of
from tickloom.operators.layout import OWN, PIECE, POS, SERIES, join_series, number_rows, own_rows, prefix_scan, segmented
from tickloom.session import ensure_checkpoint_dir

ROWS = 8192


def _named(bars: DataFrame) -> DataFrame:
    return bars if POS in bars.columns else number_rows(bars)


def series_shape(bars: DataFrame, share: float) -> DataFrame:
    """Rows and nominal prominence (share of the price range) per series."""
    return bars.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("_n"), ((F.max("high") - F.min("low")) * share).alias("_prominence"))


def level_windows(bars: DataFrame, prominence: float = 0.01, distance: int = 5, clusters: int = 3, close_filter: bool = True,
                  window: int = 100, step: int = 50) -> DataFrame:
    """every ``step`` bars, the peaks of the last ``window`` bars clustered to price levels.

    A bar is copied to the windows it belongs to (window / step of them) and each window, a group of
    at most ``window`` rows, is analysed on its own.
    """
    df = join_series(_named(bars), series_shape(bars, prominence)).filter(F.col("_n") >= window)
    first = F.floor(F.col(POS) / step)
    last = F.least(F.floor((F.col(POS) + window - step) / step), F.floor(F.col("_n") / step) - 1)
    df = df.filter(first <= last).withColumn("_w", F.explode(F.sequence(first, last)))
    df = df.select(*SERIES, "_w", "ts", "high", "low", "close", POS, "_prominence")

    def levels(prices: np.ndarray, w: int) -> list[float]:
        if not close_filter and len(prices) <= clusters:
            return []
        if len(prices) < clusters or len(prices) == 0:
            return prices.tolist()
        labels = N.ward_labels(np.abs(prices[:, None] - prices[None, :]), clusters)
        return [float(prices[labels == k].mean()) for k in sorted(set(labels.tolist()))]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        high, low = pdf["high"].to_numpy(dtype=float), pdf["low"].to_numpy(dtype=float)
        close, nominal = float(pdf["close"].iloc[-1]), float(pdf["_prominence"].iloc[0])
        tops, bottoms = high[N.find_peaks(high, nominal, distance)], low[N.find_peaks(-low, nominal, distance)]
        if close_filter:
            tops, bottoms = tops[tops > close], bottoms[bottoms < close]
        return pd.DataFrame({"connector": [key[0]], "trading_pair": [key[1]], "window": [int(key[2])], "start_time": [pdf["ts"].iloc[0]],
                             "end_time": [pdf["ts"].iloc[-1]], "close": [close], "high_clusters": [levels(tops, key[2])],
                             "low_clusters": [levels(bottoms, key[2])]})

    return df.groupBy(*SERIES, "_w").applyInPandas(
        run, "connector string, trading_pair string, window long, start_time timestamp_ntz, end_time timestamp_ntz, close double, "
             "high_clusters array<double>, low_clusters array<double>")


def nearest_levels(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """newest window per series with the nearest level above and below the last close."""
    w = windows.groupBy(*SERIES).agg(F.max_by(F.struct("high_clusters", "low_clusters"), "window").alias("_v")).select(*SERIES, "_v.*")
    last = bars.groupBy(*SERIES).agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    d = join_series(last, w, how="left")
    close = F.col("close")
    return d.withColumns({
        "nearest_resistance": F.array_min(F.filter("high_clusters", lambda v: v > close)),
        "nearest_support": F.array_max(F.filter("low_clusters", lambda v: v < close)),
        "num_resistance_levels": F.coalesce(F.size("high_clusters"), F.lit(0)),
        "num_support_levels": F.coalesce(F.size("low_clusters"), F.lit(0))})


def level_signal(levels: DataFrame, proximity: float = 0.02, clusters: int = 3) -> DataFrame:
    """short near resistance, else long near support, stronger the nearer."""
    up = (F.col("nearest_resistance") - F.col("close")) / F.col("close")
    down = (F.col("close") - F.col("nearest_support")) / F.col("close")
    value = F.when((up > 0) & (up < proximity), -F.least(F.lit(1.0), (proximity - up) / proximity)).when(
        (down > 0) & (down < proximity), F.least(F.lit(1.0), (proximity - down) / proximity))
    return levels.withColumn("value", value).filter(F.col("value").isNotNull()).select(
        "ts", F.lit(f"peak_analyzer_{clusters}").alias("signal_name"), "trading_pair", F.lit("mr").alias("category"), "value")


# --- F04: peaks of a whole series ----------------------------------------------------------------

KEYS = (*SERIES, "kind")


def two_sided(bars: DataFrame) -> DataFrame:
    """Highs and mirrored lows as two series: a low is a peak of the mirrored price."""
    sides = F.array(F.struct(F.lit("high").alias("kind"), F.col("high").cast("double").alias("x")),
                    F.struct(F.lit("low").alias("kind"), (-F.col("low")).cast("double").alias("x")))
    return _named(bars).select(*SERIES, F.col(POS), F.explode(sides).alias("_s")).select(*SERIES, POS, "_s.*")


def local_maxima(sides: DataFrame) -> DataFrame:
    """Positions higher than both neighbours; equal neighbours form one plateau, kept at its middle."""
    df, p = segmented(sides, 1, KEYS, rows=ROWS)
    same = F.col("x").eqNullSafe(F.lag("x").over(p.whole))
    df = own_rows(df.withColumn("_new", F.when(same & (F.col(POS) > 0), 0).otherwise(1)))
    df = prefix_scan(df, {"_run": ("sum", "_new")}, KEYS, [POS], segment=F.floor(F.col(POS) / ROWS))
    runs = df.groupBy(*KEYS, "_run").agg(F.first("x").alias("x"), F.min(POS).alias("_a"), F.max(POS).alias("_b"))
    runs, q = segmented(runs.withColumn(POS, F.col("_run") - 1), 1, KEYS, rows=ROWS, ahead=1)
    runs = runs.withColumns({"_l": F.lag("x").over(q.whole), "_r": F.lead("x").over(q.whole)})
    top = runs.filter(F.col(OWN) & (F.col("x") > F.col("_l")) & (F.col("x") > F.col("_r")))
    return top.select(*KEYS, "x", F.floor((F.col("_a") + F.col("_b")) / 2).alias("p"))


# what is known of a peak while it is thinned
NEW, OPEN, KEPT, DROPPED = range(4)


def thin(peaks: DataFrame, distance: int) -> DataFrame:
    """Keep peaks by height while dropping lower ones closer than ``distance``.

    A chunk of positions, seen with a margin on both sides, decides its peaks from the highest down in one pass.
    Only a peak that hangs on one beyond the margin stays open, and only chunks with open peaks run again, so a
    chain of ever higher peaks takes one round per chunk it crosses. In each round the highest open peak of every
    series is decided.
    """
    ensure_checkpoint_dir(peaks.sparkSession)
    chunk, margin = max(ROWS, 4 * distance), 2 * distance
    spread = F.explode(F.sequence(F.floor((F.col("p") - margin) / chunk), F.floor((F.col("p") + margin) / chunk)))

    def decide(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", ignore_index=True)
        low, high = key[-1] * chunk - margin, (key[-1] + 1) * chunk + margin
        pos, status = pdf["p"].to_numpy(), np.where(pdf["settled"].to_numpy(dtype=bool), KEPT, NEW)
        left, right = np.searchsorted(pos, pos - distance, side="right"), np.searchsorted(pos, pos + distance, side="left")
        for i in np.lexsort((pos, pdf["x"].to_numpy()))[::-1]:
            if status[i] == KEPT:
                continue
            near = status[left[i]:right[i]]  # lower peaks near by are still NEW
            if (near == KEPT).any():
                status[i] = DROPPED
            elif (near == OPEN).any() or pos[i] - low < distance or high - pos[i] <= distance:
                status[i] = OPEN
            else:
                status[i] = KEPT
        home = (pos // chunk == key[-1]) & ~pdf["settled"].to_numpy(dtype=bool) & (status != DROPPED)
        return pdf.loc[home, [*KEYS, "x", "p"]].assign(kept=status[home] == KEPT)

    cell = F.struct(*KEYS, "_c")
    kept, open_ = None, peaks.select(*KEYS, "x", "p")
    while True:
        rows = open_.withColumn("settled", F.lit(False))
        if kept is not None:
            rows = rows.unionByName(kept.withColumn("settled", F.lit(True)))
        seen = rows.withColumn("_c", spread)
        if kept is not None:
            touched = open_.withColumn("_c", spread).select(cell.alias("_cell")).distinct()
            seen = seen.withColumn("_cell", cell).join(touched, "_cell", "left_semi").drop("_cell")
        verdict = seen.groupBy(*KEYS, "_c").applyInPandas(
            decide, "connector string, trading_pair string, kind string, x double, p long, kept boolean").checkpoint()
        now = verdict.filter("kept").drop("kept")
        kept = now if kept is None else kept.unionByName(now)
        open_ = verdict.filter("not kept").drop("kept")
        if open_.isEmpty():
            return kept


def prominent(peaks: DataFrame, sides: DataFrame, prominence: DataFrame) -> DataFrame:
    """Peaks that stand out by the series' nominal prominence on both sides.

    A side passes when, walking outwards, the price falls to ``x - prominence`` before it exceeds x.
    Most peaks see that inside their own piece of ROWS bars. The rest ask a block table over the pieces' lowest and highest
    prices for the nearest piece that decides, and then look at that piece only.
    """
    rows = sides.withColumnRenamed(POS, "p").withColumn(PIECE, F.floor(F.col("p") / ROWS))
    peaks = peaks.checkpoint()
    cand = join_series(peaks, prominence.select(*SERIES, "_prominence")).withColumn(PIECE, F.floor(F.col("p") / ROWS))
    shape = rows.groupBy(*KEYS, PIECE).agg(F.max("x").alias("hi"), F.min("x").alias("lo")).checkpoint()
    pieces = (shape.agg(F.max(PIECE)).first()[0] or 0) + 1
    items = shape.select(series_of(KEYS).alias(OF), F.col(PIECE).alias("_at"), "lo", "hi")
    out = None
    for side in ("left", "right"):
        first = _search(rows, cand.withColumn("at", F.col(PIECE)), side).checkpoint()
        good = first.filter("passed").select(*KEYS, "p")
        if pieces > 1:
            open_ = first.filter(F.col("passed").isNull()).withColumns(
                {OF: series_of(KEYS), "_p0": F.floor(F.col("p") / ROWS), "_salt": F.col("p")})
            decides = lambda lo, hi: (hi > F.col("x")) | (lo <= F.col("x") - F.col("_prominence"))
            later = nearest_item(open_, items, decides, pieces, side == "left", "at").filter(F.col("at").isNotNull())
            good = good.unionByName(_search(rows, later, side).filter("passed").select(*KEYS, "p"))
        out = good if out is None else join_series(out, good, [*KEYS, "p"], "left_semi")
    return join_series(peaks, out, [*KEYS, "p"], "left_semi")


_FOUND = "connector string, trading_pair string, kind string, p long, x double, _prominence double, passed boolean"
#: Peaks that look at one piece together; a piece that decides for more is handed out again.
ASKS = 4096


def _search(rows: DataFrame, cand: DataFrame, side: str) -> DataFrame:
    """passed = true/false where piece ``at`` decides, NULL where it shows neither a fall nor a rise.

    Peaks far away may all look at one piece, so they meet it in groups of near ones."""
    r = rows.select(*KEYS, F.col(PIECE).alias("at"), "p", "x", F.lit(None).cast("double").alias("_prominence"), F.lit(False).alias("is_peak"))
    c = cand.select(*KEYS, "at", "p", "x", "_prominence", F.lit(True).alias("is_peak"), F.floor(F.col("p") / (2 * ASKS)).alias("_group"))
    groups = c.select(*[F.col(k).alias(f"_g_{k}") for k in (*KEYS, "at")], "_group").distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in (*KEYS, "at")])
    r = r.join(groups, same).drop(*[f"_g_{k}" for k in (*KEYS, "at")])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        body = pdf[~pdf["is_peak"]].sort_values("p")
        pos, val = body["p"].to_numpy(), body["x"].to_numpy(dtype=float)
        out = []
        for p, x, nominal in pdf[pdf["is_peak"]][["p", "x", "_prominence"]].itertuples(index=False):
            v = val[:np.searchsorted(pos, p)][::-1] if side == "left" else val[np.searchsorted(pos, p, side="right"):]
            rise, fall = np.flatnonzero(v > x), np.flatnonzero(v <= x - nominal)
            a = rise[0] if len(rise) else None
            b = fall[0] if len(fall) else None
            passed = None if a is None and b is None else b is not None and (a is None or b < a)
            out.append((*key[:3], int(p), float(x), float(nominal), passed))
        return pd.DataFrame(out, columns=["connector", "trading_pair", "kind", "p", "x", "_prominence", "passed"])

    return r.unionByName(c).groupBy(*KEYS, "at", "_group").applyInPandas(run, _FOUND)


def series_peaks(bars: DataFrame, share: float = 0.01, distance: int = 5) -> DataFrame:
    """all peak highs and lows with time, price and kind ("high", "low")."""
    bars = _named(bars)
    ensure_checkpoint_dir(bars.sparkSession)
    bars = bars.select(*SERIES, POS, "ts", "high", "low").checkpoint()  # read by every step below
    sides = two_sided(bars)
    found = prominent(thin(local_maxima(sides), distance), sides, series_shape(bars, share))
    price = F.when(F.col("kind") == "low", -F.col("x")).otherwise(F.col("x"))
    out = found.select(*SERIES, F.col("p").alias(POS), price.alias("price"), "kind")
    return join_series(out, bars.select(*SERIES, POS, "ts"), [*SERIES, POS]).checkpoint()


# --- J09: latest earlier peak beyond the price ---------------------------------------------------

def earlier_peak(bars: DataFrame, peaks: DataFrame, out: str, above: bool, default: Column, price: str = "close") -> DataFrame:
    """Price of the latest peak strictly before the bar that lies above (below) its price, else
    ``default``.

    Most bars find theirs in their own piece of ROWS bars. The others ask a block table over the highest peak of each
    piece for the nearest earlier piece that has one, and take the latest of its peaks that no later one hides. No task sees more than a
    piece, and a piece that many bars ask for is only its visible peaks, a short array.
    """
    sign = 1.0 if above else -1.0
    ensure_checkpoint_dir(bars.sparkSession)
    b = _named(bars).withColumn(PIECE, F.floor(F.col(POS) / ROWS))
    pk = peaks.select(*SERIES, F.col(POS), (F.col("price") * sign).alias("_v")).withColumn(PIECE, F.floor(F.col(POS) / ROWS))
    place = [*SERIES, PIECE]

    def answer(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(POS), right.sort_values("_at")
        at, values = right["_at"].tolist(), right["_v"].tolist()
        stack: list[float] = []  # oldest and highest first
        k, found = 0, []
        for pos, px in zip(left[POS].tolist(), left["_px"].tolist()):
            while k < len(at) and at[k] < pos:
                while stack and stack[-1] <= values[k]:
                    stack.pop()
                stack.append(values[k])
                k += 1
            found.append(next((v for v in reversed(stack) if v > px), None))
        return pd.DataFrame({"connector": key[0], "trading_pair": key[1], POS: left[POS].to_numpy(), "_px": left["_px"].to_numpy(),
                             "_found": pd.Series(found, dtype=float).to_numpy()})

    asks = b.select(*place, POS, (F.col(price) * sign).cast("double").alias("_px"))
    facts = pk.select(*[F.col(c).alias(f"_k_{c}") for c in place], F.col(POS).alias("_at"), F.col("_v").alias("_v"))  # own names: both sides stem from the same bars
    own = asks.groupBy(*place).cogroup(facts.groupBy(*[f"_k_{c}" for c in place])).applyInPandas(
        answer, f"connector string, trading_pair string, {POS} long, _px double, _found double")
    own = own.withColumn("_found", no_nan("_found")).checkpoint()  # read for both kinds of bars
    home = F.floor(F.col(POS) / ROWS)
    pieces = (own.agg(F.max(home)).first()[0] or 0) + 1
    answers = own.select(*SERIES, POS, "_found")
    if pieces > 1:
        # visible peaks of a piece: from its end backwards, those above all later ones
        later = Window.partitionBy(*place).orderBy(F.col(POS).desc()).rowsBetween(Window.unboundedPreceding, -1)
        seen = pk.withColumn("_top", F.max("_v").over(later)).filter(F.col("_top").isNull() | (F.col("_v") > F.col("_top")))
        stairs = seen.groupBy(*place).agg(F.sort_array(F.collect_list("_v")).alias("_stairs"))
        every = own.select(*SERIES, home.alias(PIECE)).distinct()
        items = join_series(every, stairs, place, "left").select(
            series_of(SERIES).alias(OF), F.col(PIECE).alias("_at"), F.array_max("_stairs").alias("hi"), F.array_max("_stairs").alias("lo"))
        open_ = own.filter(F.col("_found").isNull() & F.col("_px").isNotNull()).withColumns(
            {OF: series_of(SERIES), "_p0": home, "_salt": F.col(POS)})
        far = nearest_item(open_, items, lambda lo, hi: hi > F.col("_px"), pieces, True, PIECE).filter(F.col(PIECE).isNotNull())
        # bars of one series may all ask for one piece: its array is copied, the bars are dealt
        salt = F.pmod(F.xxhash64(POS), F.lit(SALTS))
        copies = stairs.withColumn("_mine", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        far = join_series(far.withColumn("_mine", salt.cast("int")), copies, [*place, "_mine"])
        px = F.col("_px")
        far = far.select(*SERIES, POS, F.get(F.filter("_stairs", lambda v: v > px), F.lit(0)).alias("_far"))
        answers = join_series(answers, far, [*SERIES, POS], "left").withColumn("_found", F.coalesce("_found", "_far")).drop("_far")
    answers = answers.withColumn("_found", F.col("_found") * sign)
    return join_series(b.drop(PIECE), answers, [*SERIES, POS], "left").withColumn(out, F.coalesce("_found", default)).drop("_found")
