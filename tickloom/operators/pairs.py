"""Pair statistics over many series (Q-A to Q-M).

Three layouts:

* Second moments over any history (``pair_correlations``): each pair of symbol blocks runs through its time slices one
  by one, dense products of a slice being added to the sums of all its pairs, so no pair is shuffled. Many symbols get
  larger, not many more blocks. Few values are copied once per block in a shuffle; blocks of many values lie in the
  checkpoint folder, one a partition, and two meet where they are read.
* Statistics of lagged pairs over any history (``aligned_pairs``): pairs are joined by time, laid out in pieces with
  a halo of the lags, and sums or counts of the pieces are added up per pair.
* Tests over a bounded look-back (``analyse_pairs``): each series is cut to its last N rows, symbols
  are hashed to blocks of about ``per_block``, and a group holds the rows of two blocks, so a task
  sees at most 2 * per_block * N rows however many symbols there are. A row is copied once per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from tickloom.functions import kernels as N
from tickloom.functions.columns import epoch_micros, ratio
from tickloom.functions.stats import normal_tail
from tickloom.operators.joins import group_pairs, latest_rows
from tickloom.operators.layout import OWN, PIECE, POS, SEGMENT_ROWS, SERIES, join_series, own_rows, prefix_scan, segment_width, segmented, time_segment
from tickloom.plans.screeners import top_per_group
from tickloom.session import ensure_checkpoint_dir, held, stored

PAIR = ("connector", "pair1", "pair2")


def funding_differences(funding: DataFrame, blocks: int = 16) -> DataFrame:
    """Q-L/J05: rate differences of every pair of symbols of a venue."""
    d = group_pairs(funding, ["connector"], "trading_pair", ["rate"], blocks)
    gap = F.col("rate1") - F.col("rate2")
    return d.withColumnsRenamed({"item1": "pair1", "item2": "pair2"}).withColumns(
        {"rate_difference": gap, "abs_rate_difference": F.abs(gap)})


def top_funding_differences(funding: DataFrame, n: int) -> DataFrame:
    """Q-M: the n largest differences per venue.

    A pair among the n largest has its low side among the n lowest rates and its high side among the
    n highest, so only 2n symbols per venue are paired.
    """
    low = top_per_group(funding.select("connector", "trading_pair", "rate"), ["connector"], [F.asc("rate"), F.asc("trading_pair")], n).drop("rank")
    high = top_per_group(funding.select("connector", "trading_pair", "rate"), ["connector"], [F.desc("rate"), F.asc("trading_pair")], n).drop("rank")
    pairs = funding_differences(low.unionByName(high).distinct(), 4)
    return top_per_group(pairs, ["connector"], [F.desc("abs_rate_difference"), F.asc("pair1"), F.asc("pair2")], n)


def returns(bars: DataFrame) -> DataFrame:
    b = prefix_scan(bars.select(*SERIES, "ts", "close"), {"_p": ("prev", "close")})
    return b.withColumn("ret", ratio("close", "_p") - 1).drop("_p")


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last n rows per series with ``rank`` 1 for the newest."""
    return top_per_group(df, [*SERIES], [F.desc("ts")], n)


def symbol_blocks(df: DataFrame, per_block: int) -> int:
    """How many blocks keep about ``per_block`` symbols each (one scalar from the cluster)."""
    m = df.select("trading_pair").distinct().count()
    return max(1, -(-m // per_block))


def _cells(df: DataFrame, blocks: int) -> DataFrame:
    b = F.pmod(F.hash("trading_pair"), F.lit(blocks))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return df.withColumn("_b", b).withColumn("_o", other).withColumns(
        {"_lo": F.least("_b", "_o"), "_hi": F.greatest("_b", "_o")}).drop("_o")


def _pairs_in(blocks: dict[str, int], lo: int, hi: int) -> Iterable[tuple[str, str]]:
    names = sorted(blocks)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if {blocks[a], blocks[b]} == {lo, hi} if lo != hi else blocks[a] == blocks[b] == lo:
                yield a, b


def _slice_moments(names: tuple[dict, dict], rows: list[tuple]) -> list[np.ndarray]:
    """n, sx, sy, sxx, syy, sxy of every symbol of one block (rows) with every one of the other (columns) over a
    time slice. ``rows``: (side, place, times, centred values); both sides are one where a block meets itself."""
    times, at = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    ends = np.cumsum([len(r[2]) for r in rows])[:-1]
    dense = [np.full((len(times), len(n)), np.nan) for n in names]
    for (side, place, _, x), where in zip(rows, np.split(at, ends)):
        dense[side][where, place] = x
    if names[0] is names[1]:
        dense[1] = dense[0]
    (hx, x), (hy, y) = ((has.astype(float), np.where(has, d, 0.0)) for d in dense for has in [~np.isnan(d)])
    return [hx.T @ hy, x.T @ hy, hx.T @ y, (x * x).T @ hy, hx.T @ (y * y), x.T @ y]


MOMENTS = pa.schema([*((c, pa.string()) for c in PAIR), *((c, pa.float64()) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))])


def _moment_rows(venue: str | None, names: tuple[dict, dict], sums: list[np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    """A row per pair (pair1 < pair2) with at least ``least`` common points, some symbols of the first block at a time."""
    left, right = (np.array(list(n), dtype=object) for n in names)
    same = names[0] is names[1]
    for start in range(0, len(left), step := max(1, (1 << 17) // len(right))):
        n, sx, sy, sxx, syy, sxy = (m[start:start + step] for m in sums)
        swap = left[start:start + step, None] > right[None, :]
        keep = (n >= least) & (~swap & (left[start:start + step, None] != right[None, :]) if same else True)
        i, j = np.nonzero(keep)
        back = swap[i, j]
        a, b = left[start + i], right[j]
        pick = lambda p, q: pa.array(np.where(back, q[i, j], p[i, j]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([venue] * len(i), pa.string()), pa.array(np.where(back, b, a), pa.string()), pa.array(np.where(back, a, b), pa.string()),
             pa.array(n[i, j]), pick(sx, sy), pick(sy, sx), pick(sxx, syy), pick(syy, sxx), pa.array(sxy[i, j])], schema=MOMENTS)


def _block_moments(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of every cell (two symbol blocks) of a partition sorted by cell and slice; a cell and a slice are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = part = None
        names, sums, rows = ({}, {}), [], []

        def add() -> list[np.ndarray]:
            found = _slice_moments(names, rows)
            for total, new in zip(sums, found):  # symbols a later slice brought stand behind the earlier ones
                new[:total.shape[0], :total.shape[1]] += total
            return found

        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("connector", "_lo", "_hi", "_g", "_slice", "_b", "trading_pair", "_m")]
            ends = batch.column("_rows").offsets.to_numpy()
            points = batch.column("_rows").values
            t, x = (points.field(c).to_numpy(zero_copy_only=False) for c in ("t", "x"))
            for k, (*of, now, block, name, mean) in enumerate(zip(*keys)):
                if of != cell or now != part:
                    if rows:
                        sums, rows = add(), []
                    if of != cell:
                        if sums:
                            yield from _moment_rows(cell[0], names, sums, least)
                        cell, sums = of, []
                        names = ({}, {}) if of[1] != of[2] else ({},) * 2
                    part = now
                side = int(block != of[1])
                place = names[side].setdefault(name, len(names[side]))
                # copied, so that a batch is not held beyond its turn
                rows.append((side, place, t[ends[k]:ends[k + 1]].copy(), x[ends[k]:ends[k + 1]] - mean))
        if rows:
            sums = add()
        if sums:
            yield from _moment_rows(cell[0], names, sums, least)

    return run


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of a partition as one row per venue, block and slice: the venue's symbols in the block, its times in the
    slice, and for every value, centred on its series' mean, the places of its symbol and of its time."""
    rows = pa.Table.from_batches(list(batches), VALUES)
    if not len(rows):
        return
    # in one order, so that a rerun adds up the same numbers in the same order
    rows = rows.sort_by([("trading_pair", "ascending"), ("t", "ascending")])
    t, x, part = (rows[c].to_numpy() for c in ("t", "x", "_slice"))
    venue = rows["connector"].combine_chunks().dictionary_encode(null_encoding="encode")
    name = rows["trading_pair"].combine_chunks().dictionary_encode()
    symbol, block = name.indices.to_numpy(), rows["_b"].to_numpy()
    of = block * np.int64(len(venue.dictionary)) + venue.indices.to_numpy()
    for cell in np.unique(of):
        mine = np.flatnonzero(of == cell)
        found, place = np.unique(symbol[mine], return_inverse=True)
        names = name.dictionary.take(pa.array(found)).to_pylist()
        connector = venue.dictionary[int(cell) % len(venue.dictionary)].as_py()
        mean = np.bincount(place, x[mine]) / np.bincount(place)
        for now in np.unique(part[mine]):
            here = np.flatnonzero(part[mine] == now)
            times, at = np.unique(t[mine[here]], return_inverse=True)
            centred = x[mine[here]] - mean[place[here]]
            packed = [times.astype("<i8"), at.astype("<i4"), place[here].astype("<i4"), centred.astype("<f8")]
            yield pa.RecordBatch.from_pylist([dict(zip(BLOCK.names, (
                connector, int(block[mine[0]]), int(now), names, *(c.tobytes() for c in packed))))], BLOCK)


VALUES = pa.schema([("connector", pa.string()), ("trading_pair", pa.string()), ("_slice", pa.int64()), ("_b", pa.int32()), ("t", pa.int64()), ("x", pa.float64())])
BLOCK = pa.schema([("connector", pa.string()), ("block", pa.int32()), ("slice", pa.int64()), ("names", pa.list_(pa.string())),
                   *((c, pa.binary()) for c in ("times", "at", "place", "x"))])
CORRELATIONS = pa.schema([*((c, pa.string()) for c in PAIR), ("points", pa.int64()), ("correlation", pa.float64())])


def _correlations(venue: str | None, names: tuple[list, list], same: bool, sums: list[np.ndarray], least: float, within: float | None) -> Iterator[pa.RecordBatch]:
    """A row per pair (pair1 < pair2) with at least ``least`` common points, some symbols of the first block at a time."""
    every, codes = np.unique(np.array([*names[0], *names[1]], dtype=object), return_inverse=True)
    left, right, every = codes[:len(names[0])], codes[len(names[0]):], pa.array(every, pa.string())
    alone = np.zeros(len(every), bool)

    def batch(first, second, points, c) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([venue] * len(first), pa.string()), every.take(pa.array(first)), every.take(pa.array(second)), points, c], schema=CORRELATIONS)

    for start in range(0, len(left), step := max(1, (1 << 17) // len(right))):
        n, sx, sy, sxx, syy, sxy = (m[start:start + step] for m in sums)
        keep = n >= least
        if same:
            keep &= left[start:start + step, None] < right[None, :]
        with np.errstate(all="ignore"):
            var = (sxx - sx * sx / n) * (syy - sy * sy / n)
            root = np.sqrt(np.where(var < 0, 0.0, var))
            c = (sxy - sx * sy / n) / root
            if within is not None:
                near = keep & (root != 0) & (1 - c < within)
                alone[left[start:start + step][keep.any(axis=1)]] = alone[right[keep.any(axis=0)]] = True
                keep = near
        i, j = np.nonzero(keep)
        a, b = left[start + i], right[j]
        yield batch(np.minimum(a, b), np.maximum(a, b), pa.array(n[i, j].astype(np.int64)), pa.array(c[i, j], mask=root[i, j] == 0))
    if within is not None:
        own = np.flatnonzero(alone)
        yield batch(own, own, pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.float64()))


def _dense(side: dict, times: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a block at the common times (0 where there is none), and whether there is one."""
    at, place, x = (np.frombuffer(side[c], k) for c, k in (("at", "<i4"), ("place", "<i4"), ("x", "<f8")))
    where = np.searchsorted(common, times)
    where[~np.isin(times, common, assume_unique=True)] = len(common)
    d = np.full((len(common) + 1, len(side["names"])), np.nan)
    d[where[at], place] = x
    d = d[:-1]
    has = ~np.isnan(d)
    d[~has] = 0.0
    return d, has


def _met_blocks(least: float, within: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Correlations of the pairs of blocks that meet, slice by slice; the slices of a venue and first block follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, cells = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for other, (names, sums) in cells.items():
                yield from _correlations(first[0], names, first[1] == other, sums, least, within)
            cells.clear()

        for row in (r for batch in batches for r in batch.to_pylist()):
            if (row["connector"], row["block"]) != first:
                yield from done()
                first = row["connector"], row["block"]
            if row["o_block"] not in cells:
                names = row["names"], row["o_names"]
                cells[row["o_block"]] = names, [np.zeros((len(names[0]), len(names[1]))) for _ in range(6)]
            sums = cells[row["o_block"]][1]
            sides = row, {c: row[f"o_{c}"] for c in ("names", "times", "at", "place", "x")}
            times = [np.frombuffer(side["times"], "<i8") for side in sides]
            common = np.intersect1d(*times, assume_unique=True)
            if len(common):
                (x, hx), (y, hy) = (_dense(side, t, common) for side, t in zip(sides, times))
                sums[0] += hx.astype(np.float32).T @ hy.astype(np.float32)  # counts below 2 ** 24 are exact
                hx, hy = hx.astype(float), hy.astype(float)
                for total, (p, q) in zip(sums[1:], ((x, hy), (hx, y), (x * x, hy), (hx, y * y), (x, y))):
                    total += p.T @ q
        yield from done()

    return run


#: Cells (pairs of blocks, times groups of slices) that keep a cluster busy, blocks that do, and how much larger blocks may get.
CELLS, BLOCKS, LARGER = 32, 16, 16
#: Bytes that copies of the values may take in a shuffle, bytes of a block and of a symbol's values that may lie in one partition.
COPIES, WHOLE, LONGEST = 1 << 28, 1 << 26, 1 << 25


def pair_correlations(values: DataFrame, x: str, min_points: int = 100, slice_rows: int = 1024,
                      per_block: int = 128, within: float | None = None) -> DataFrame:
    """Q-J: correlation of every pair of a venue over the times both have a value, in long form.

    Values are centred per series first, so the partial sums keep their digits. Beyond BLOCKS blocks of ``per_block``
    symbols blocks grow, up to LARGER times. A task holds the sums of two blocks' pairs and one time slice of about
    ``slice_rows`` bars per symbol. Up to COPIES bytes (and for symbols of more than LONGEST bytes) the values are copied
    once per block, and few symbols have their slices in several groups, whose sums are added per pair. Beyond, a block is
    packed in a partition of its own, and two partitions are read where they meet. The values are stored while the plan
    is built. A symbol is not NULL. With ``within``, pairs whose correlation is not above 1 - ``within`` may be left out;
    each of their symbols then stands beside itself, without a correlation.
    """
    v = values.select(*SERIES, "ts", F.col(x).cast("double").alias("x"))
    v = v.filter(F.col("x").isNotNull() & F.col("ts").isNotNull() & F.col("trading_pair").isNotNull())
    width = segment_width(values, "ts") * slice_rows // SEGMENT_ROWS
    v = stored(v.select(*SERIES, time_segment("ts", max(1, width)).alias("_slice"), epoch_micros("ts").alias("t"), "x"), "values")
    sizes = v.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    seen = sizes.agg(F.count_distinct("trading_pair").alias("m"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    blocks = max(1, -(-seen["m"] // per_block))
    if blocks > BLOCKS:
        blocks = max(BLOCKS, -(-blocks // LARGER))
    size = 16 * (seen["n"] or 0)
    if blocks * size > COPIES and 16 * seen["most"] <= LONGEST and -(-size // WHOLE) <= seen["m"]:
        return _read_in_place(v, max(blocks, -(-size // WHOLE)), min_points, within)
    slices = v.agg(F.count_distinct("_slice")).first()[0]
    cells = blocks * (blocks + 1) // 2
    groups = max(1, min(slices, -(-CELLS // cells)))
    packed = v.groupBy(*SERIES, "_slice").agg(F.collect_list(F.struct("t", "x")).alias("_rows"))
    mean = v.groupBy(*SERIES).agg((F.sum("x") / F.count(F.lit(1))).alias("_m"))
    # never shuffled by symbol: the copies are
    spread = _cells(join_series(packed, mean), blocks).withColumn("_g", F.pmod("_slice", F.lit(groups)))
    cell = ["connector", "_lo", "_hi", "_g"]
    spread = spread.repartition(min(2 * cells * groups, 2000), *cell).sortWithinPartitions(*cell, "_slice")
    s = spread.mapInArrow(_block_moments(min_points if groups == 1 else 1), "connector string, pair1 string, pair2 string, "
                          "n double, sx double, sy double, sxx double, syy double, sxy double")
    if groups > 1:
        s = s.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    return s.filter(n >= min_points).select("connector", "pair1", "pair2", n.cast("bigint").alias("points"),
                                            ratio(cov, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("correlation"))


def _read_in_place(v: DataFrame, blocks: int, min_points: int, within: float | None) -> DataFrame:
    """The correlations of ``pair_correlations`` from blocks that lie in the checkpoint folder, a partition each."""
    v = v.select(*SERIES, "_slice", F.pmod(F.hash("trading_pair"), F.lit(blocks)).alias("_b"), "t", "x").repartitionById(blocks, F.col("_b"))
    one = v.mapInArrow(_block_rows, "connector string, block int, slice bigint, names array<string>, times binary, at binary, place binary, x binary")
    one = held(one)
    other = one.select(*(F.col(c).alias(f"o_{c}") for c in one.columns)).hint("shuffle_replicate_nl")
    same = F.col("connector").eqNullSafe(F.col("o_connector")) & (F.col("slice") == F.col("o_slice"))
    met = one.join(other, same & (F.col("block") <= F.col("o_block")))
    return met.mapInArrow(_met_blocks(min_points, within), "connector string, pair1 string, pair2 string, points bigint, correlation double")


# f(name1, name2, x1, x2, times) -> rows
PairFunction = Callable[[str, str, np.ndarray, np.ndarray, np.ndarray], list[tuple]]


def analyse_pairs(values: DataFrame, x: str, lookback: int | None, fn: PairFunction, schema: str, align: str = "ts",
                  min_points: int = 30, cuts: tuple[int, ...] = (0,), per_block: int = 16) -> DataFrame:
    """Runs ``fn`` on every pair (name1 < name2) over the last ``lookback`` rows of each series (None: all).

    ``align``: by time, or by position from the end ("tail"). ``cuts`` repeats the analysis after
    dropping the first c common rows (Q-I) and adds the column ``cut``.
    """
    v = values.select(*SERIES, "ts", F.col(x).cast("double").alias("x")).filter(F.col("x").isNotNull() & F.col("ts").isNotNull())
    if lookback is not None:
        v = tail(v, lookback)
    v = v.withColumn("t", epoch_micros("ts") if align == "ts" else -F.col("rank").cast("bigint"))
    v = v.select("connector", "trading_pair", "t", "x")
    names = StructType.fromDDL(schema).fieldNames()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        blocks = dict(zip(pdf["trading_pair"], pdf["_b"]))
        series = {n: g.sort_values("t") for n, g in pdf.groupby("trading_pair")}
        series = {n: (g["t"].to_numpy(), g["x"].to_numpy(dtype=float)) for n, g in series.items()}
        rows = []
        for a, b in _pairs_in(blocks, lo, hi):
            (ta, xa), (tb, xb) = series[a], series[b]
            t, ia, ib = np.intersect1d(ta, tb, assume_unique=True, return_indices=True)
            for cut in cuts:
                if len(t) - cut >= min_points:
                    rows += [(key[0], cut, *r) for r in fn(a, b, xa[ia][cut:], xb[ib][cut:], t[cut:])]
        return pd.DataFrame(rows, columns=["connector", "cut", *names])

    cells = _cells(v, symbol_blocks(v, per_block))
    return cells.groupBy("connector", "_lo", "_hi").applyInPandas(run, f"connector string, cut int, {schema}")


COINTEGRATION = ("base string, quote string, p_value double, alpha double, beta double, z_mean double, z_std double, "
                 "current_z_score double, median_error double, last_t bigint, points int")


def cointegration(bars: DataFrame, lookback: int, signal_rows: int, z_threshold: float = 2.0, align: str = "ts", **kw) -> DataFrame:
    """Q-A/Q-B: Engle-Granger p-value, hedge regression and spread signal for both directions."""

    def one(a, b, x1, x2, t):
        out = []
        for base, quote, y, x in ((a, b, x1, x2), (b, a, x2, x1)):
            alpha, beta = N.hedge(y, x)
            z = y - (alpha + beta * x)
            sd = float(z.std())
            recent = slice(max(0, len(y) - signal_rows), None)
            error = (alpha + beta * x[recent] - y[recent]) / np.abs(y[recent]) * 100
            out.append((base, quote, N.cointegration_p(y, x), alpha, beta, float(z.mean()), sd,
                        float((z[-1] - z.mean()) / sd) if sd > 0 else None, float(np.median(error)), int(t[-1]), len(y)))
        return out

    d = analyse_pairs(bars, "close", lookback, one, COINTEGRATION, align, **kw)
    z = F.abs("current_z_score")
    return d.withColumns({
        "side": F.when(z < z_threshold, "both").when(F.col("current_z_score") > z_threshold, "short").otherwise("long"),
        "signal_strength": z / z_threshold, "mean_reversion_probability": _normal_tail(z),
        "stop_loss_z_score": F.col("current_z_score") * 1.5, "position_ratio": F.col("beta")})


def _normal_tail(z: Column) -> Column:
    @F.pandas_udf("double")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series(normal_tail(s.to_numpy(dtype=float)), index=s.index)
    return udf(z)


def grid_levels(analysis: DataFrame, prices: DataFrame, entry: float = 1.5, stop: float = 1.0, levels: int = 5,
                limit_hours: int = 24) -> DataFrame:
    """Q-C: entry, end and limit price, equal steps and z-score targets from the spread signal.

    ``prices``: connector, trading_pair, price of the base leg.
    """
    d = join_series(analysis, prices.select("connector", F.col("trading_pair").alias("base"), "price"), ["connector", "base"])
    z, move = F.col("current_z_score"), F.col("z_std") * F.col("beta")
    live, short = F.abs(z) > entry, z > 0
    way = F.when(short, -1).otherwise(1)
    price = F.col("price")
    end = price * (1 + way * F.abs(z) * move)
    d = d.withColumns({
        "grid_side": F.when(live, F.when(short, "short").otherwise("long")).otherwise("both"),
        "entry_price": F.when(live, price), "end_price": F.when(live, end),
        "limit_price": F.when(live, price * (1 - way * stop * move)),
        "stop_z_score": F.when(live, z + F.when(short, stop).otherwise(-stop)), "target_z_score": F.when(live, F.lit(0.0)),
        "grid_step": F.when(live, F.abs(end - price) / (levels + 1)),
        "time_limit": F.when(live, F.timestamp_micros("last_t") + F.make_dt_interval(hours=F.lit(limit_hours)))})
    steps = F.sequence(F.lit(1), F.lit(levels))
    return d.withColumn("grid_prices", F.when(live, F.transform(steps, lambda i: F.col("entry_price") + i * F.col("grid_step") * way)))


def pair_ratings(grids: DataFrame, p_threshold: float = 0.05) -> DataFrame:
    """Q-D: cointegrated flag, potential profit and risk ratio, strongest signals first."""
    gain = F.abs(F.col("end_price") - F.col("entry_price"))
    off = F.col("grid_side") == "both"
    return grids.withColumns({
        "cointegrated": F.col("p_value") < p_threshold,
        "potential_profit": F.when(off, 0.0).otherwise(ratio(gain, "entry_price")),
        "risk_ratio": F.when(off, 0.0).otherwise(ratio(gain, F.abs(F.col("limit_price") - F.col("entry_price"))))})


def aligned_pairs(values: DataFrame, x: str, align: str = "ts", min_points: int = 30) -> DataFrame:
    """Every pair of a venue (pair1 < pair2) at every time both have a value: t, x1, x2 and ``_pos``, the row's
    number in its pair. ``align``: by time, or by position from the end ("tail"). Pairs with fewer than
    ``min_points`` common rows are left out. The whole history takes part."""
    v = values.select(*SERIES, "ts", F.col(x).cast("double").alias("x")).filter(F.col("x").isNotNull() & F.col("ts").isNotNull())
    width = segment_width(values, "ts") * 1_000_000
    if align == "ts":
        v = v.withColumn("t", epoch_micros("ts"))
    else:
        one = F.lit(1)
        v = prefix_scan(v, {"_n": ("count", one), "_all": ("series_sum", one)}).withColumn("t", F.col("_n") - F.col("_all") - 1)
        width = SEGMENT_ROWS
    a = v.select("connector", "t", F.col("trading_pair").alias("pair1"), F.col("x").alias("x1"))
    b = v.select(F.col("connector").alias("_venue"), F.col("t").alias("_t"), F.col("trading_pair").alias("pair2"), F.col("x").alias("x2"))
    both = a.join(b, F.col("connector").eqNullSafe(F.col("_venue")) & (F.col("t") == F.col("_t")) & (F.col("pair1") < F.col("pair2")))
    both = both.select(*PAIR, "t", "x1", "x2")
    one = F.lit(1)
    d = prefix_scan(both, {POS: ("count", one), "points": ("series_sum", one)}, PAIR, ["t"], segment=F.floor(F.col("t") / width))
    return d.withColumn(POS, F.col(POS) - 1).filter(F.col("points") >= min_points)


def lead_lag(values: DataFrame, x: str, max_lag: int = 6, align: str = "ts", min_points: int = 30) -> DataFrame:
    """Q-E: correlation per lag over the whole history; a positive best lag means the second symbol is shifted
    forward, so the first one leads. Lagged rows come from pieces with a halo, their co-moments are added up per pair."""
    d, pieces = segmented(aligned_pairs(values, x, align, min_points), max_lag, PAIR, ["t"])
    lags = range(-max_lag, max_lag + 1)
    sides = {}
    for n in lags:
        moved = F.lag("x2" if n >= 0 else "x1", abs(n)).over(pieces.whole)
        sides[f"_c{n + max_lag}"] = moved
    d = own_rows(d.withColumns(sides))
    c = d.groupBy(*PAIR).agg(F.array(*[F.corr("x1" if n >= 0 else "x2", f"_c{n + max_lag}") for n in lags]).alias("correlations"))
    known = F.filter(F.transform("correlations", lambda v, i: F.struct(v.alias("c"), (-i).alias("i"))), lambda v: v["c"].isNotNull() & ~F.isnan(v["c"]))
    best = F.array_max(known)
    lag = F.coalesce(-best["i"] - max_lag, F.lit(0)).cast("int")
    c = c.withColumns({"best_lag": lag, "best_lag_corr": best["c"]})
    side = F.when(F.col("best_lag") < 0, "pair2").when(F.col("best_lag") > 0, "pair1")
    return c.withColumns({"dominant": F.when(side == "pair2", F.col("pair2")).when(side == "pair1", F.col("pair1")),
                          "follower": F.when(side == "pair2", F.col("pair1")).when(side == "pair1", F.col("pair2"))})


def granger(values: DataFrame, x: str, max_lag: int = 6, significance: float = 0.05, align: str = "ts",
            min_points: int = 30) -> DataFrame:
    """Q-F: F-test p-values per lag for both directions over the whole history, rounded to 4 digits.

    A regression needs only sums of products of lagged values: each piece gives one such matrix, the matrices of a
    pair are added up, and only the small solve per pair is left."""
    d, pieces = segmented(aligned_pairs(values, x, align, min_points), max_lag, PAIR, ["t"])
    size = (2 * (max_lag + 1) + 1) ** 2

    def gram(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        full, head = N.lagged_products(pdf["x1"].to_numpy(), pdf["x2"].to_numpy(), pdf[POS].to_numpy(), pdf[OWN].to_numpy(), max_lag)
        return pd.DataFrame([(*key[:3], len(pdf), full.ravel().tolist(), head)], columns=[*PAIR, "n", "products", "head"])

    parts = d.select(*PAIR, PIECE, POS, OWN, "x1", "x2").groupBy(*PAIR, PIECE).applyInPandas(
        gram, "connector string, pair1 string, pair2 string, n long, products array<double>, head array<double>")
    sums = parts.groupBy(*PAIR).agg(F.array(*[F.sum(F.col("products")[i]) for i in range(size)]).alias("products"),
                                    F.max("head").alias("head"))

    @F.pandas_udf("array<array<double>>")
    def solve(products: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([N.granger_from_products(np.asarray(p), np.asarray(h), max_lag) for p, h in zip(products, head)])

    p = sums.select(*PAIR, solve("products", "head").alias("_p"))
    sides = F.array(F.struct(F.col("pair1").alias("predictor"), F.col("pair2").alias("response"), F.col("_p")[0].alias("p_values")),
                    F.struct(F.col("pair2").alias("predictor"), F.col("pair1").alias("response"), F.col("_p")[1].alias("p_values")))
    out = p.select("connector", F.inline(sides))
    out = out.withColumn("p_values", F.transform("p_values", lambda v: F.round(v, 4)))
    low = F.filter(F.transform("p_values", lambda v, i: F.struct(v.alias("p"), (i + 1).alias("lag"))), lambda v: v["p"] < significance)
    best = F.array_min(low)
    out = out.withColumns({"significant_lags": F.transform(low, lambda v: v["lag"]), "causal": F.size(low) > 0,
                           "best_lag": best["lag"].cast("int"), "best_p_value": best["p"]})
    return out.withColumns({"dominant": F.when(F.col("causal"), F.col("predictor")), "follower": F.when(F.col("causal"), F.col("response"))})


def time_warping(values: DataFrame, x: str, band: int | None = None, **kw) -> DataFrame:
    """Q-G: warped distance of whole series; the calmer one counts as the leader. A warping path runs through both
    series from end to end, so a group holds the two series of about one pair; ``band`` bounds its work."""

    def one(a, b, x1, x2, t):
        s1, s2 = x1.std(ddof=1), x2.std(ddof=1)
        lead, follow = (a, b) if s1 < s2 else (b, a) if s2 < s1 else (None, None)
        return [(a, b, round(N.dtw_distance(x1, x2, band), 6), lead, follow)]

    return analyse_pairs(values, x, None, one, per_block=1, schema="pair1 string, pair2 string, dtw_distance double, dominant string, follower string", **kw)


def information_flow(values: DataFrame, x: str, bins: int = 3, align: str = "ts", min_points: int = 30) -> DataFrame:
    """Q-H: transfer entropy in both directions over the whole history, rounded to 6 digits: counts of state
    changes per pair, added up in Spark. States are equal-width bins by lower edges; the maximum has its own."""
    d = aligned_pairs(values, x, align, min_points)
    d = d.withColumn("_of", F.struct(*PAIR))
    ends = d.groupBy("_of").agg(F.min("x1").alias("_a1"), F.max("x1").alias("_b1"), F.min("x2").alias("_a2"), F.max("x2").alias("_b2"))
    d = d.join(ends, "_of").drop("_of")

    def state(i: int) -> Column:
        low, high, v = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"x{i}")
        steps = [F.when(v >= low + (high - low) / bins * k, 1).otherwise(0) for k in range(1, bins)]
        return F.when(v >= high, bins).otherwise(sum(steps, F.lit(0)))

    d = d.select(*PAIR, "t", POS, state(1).alias("s1"), state(2).alias("s2"))
    d, pieces = segmented(d, 1, PAIR, ["t"])
    d = own_rows(d.withColumns({"p1": F.lag("s1").over(pieces.whole), "p2": F.lag("s2").over(pieces.whole)})).filter(F.col("p1").isNotNull())
    n = d.groupBy(*PAIR, "s1", "s2", "p1", "p2").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(*[F.struct(F.col(f"pair{i}").alias("predictor"), F.col(f"pair{j}").alias("response"), F.col(f"s{j}").alias("sn"),
                               F.col(f"p{j}").alias("sy"), F.col(f"p{i}").alias("sx")) for i, j in ((1, 2), (2, 1))])
    key = ["connector", "predictor", "response"]
    j = n.select("connector", "n", F.inline(sides)).groupBy(*key, "sn", "sy", "sx").agg(F.sum("n").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*key, *c))  # noqa: E731  at most (bins + 1) ** 3 rows per pair
    j = j.withColumns({"_tot": over(), "_past": over("sy", "sx"), "_moves": over("sn", "sy"), "_here": over("sy")})
    term = F.col("n") / F.col("_tot") * F.log2((F.col("n") / F.col("_past")) / (F.col("_moves") / F.col("_here")))
    te = j.groupBy(*key).agg(F.round(F.sum(term), 6).alias("transfer_entropy"))
    live = F.col("transfer_entropy") > 0
    return te.withColumns({"dominant": F.when(live, F.col("predictor")), "follower": F.when(live, F.col("response"))})


def distances(p_values: DataFrame, similarity: bool = False) -> DataFrame:
    """Q-K: distance 1 - p (p itself with ``similarity``), averaged over both directions."""
    d = F.col("p_value") if similarity else 1 - F.col("p_value")
    return p_values.groupBy("connector", F.least("base", "quote").alias("pair1"), F.greatest("base", "quote").alias("pair2")).agg(
        F.greatest(F.avg(d), F.lit(0.0)).alias("distance"))


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links of a partition those that hold its components together, and every symbol beside itself."""
    root: dict[tuple, tuple] = {}

    def top(k: tuple) -> tuple:
        while (up := root.setdefault(k, k)) != k:
            root[k] = root[up]
            k = up
        return k

    for batch in batches:
        pairs = pa.Table.from_batches([batch]).group_by(["connector", "a", "b"]).aggregate([]).to_pydict()
        for venue, a, b in zip(pairs["connector"], pairs["a"], pairs["b"]):
            p, q = top((venue, a)), top((venue, b))
            if p != q and a is not None and b is not None:
                root[max(p, q, key=lambda k: k[1])] = min(p, q, key=lambda k: k[1])
    nodes = list(root)
    for start in range(0, len(nodes), 10_000):
        some = nodes[start:start + 10_000]
        yield pa.RecordBatch.from_pydict({"connector": pa.array([k[0] for k in some], pa.string()), "a": pa.array([top(k)[1] for k in some], pa.string()),
                                          "b": pa.array([k[1] for k in some], pa.string())})


def clusters_at(edges: DataFrame, height: float) -> DataFrame:
    """Q-K: connected components of the pairs closer than ``height``: smallest label by repeated
    joins, with jumps over labels of labels; each round is cut by a checkpoint."""
    ensure_checkpoint_dir(edges.sparkSession)
    loop = lambda c: F.struct(F.col(c).alias("a"), F.col(c).alias("b"))
    near = F.array(F.struct(F.col("pair1").alias("a"), F.col("pair2").alias("b")))
    ends = F.when(F.col("distance") < height, near).otherwise(F.array(loop("pair1"), loop("pair2")))
    # far pairs only tell that their symbols exist, and of the near ones a task sends on a star per component: both are
    # dropped before the first shuffle, and no pair is stored
    kept = edges.select("connector", F.inline(ends)).mapInArrow(_spanning, "connector string, a string, b string").distinct().checkpoint()
    near = kept.filter("a <> b")
    both = near.unionByName(near.select("connector", F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    nodes = kept.select("connector", "a").union(kept.select("connector", "b")).distinct()
    labels = nodes.withColumn("label", F.col("a")).checkpoint()
    while True:
        seen = both.join(labels.select("connector", F.col("a").alias("b"), F.col("label").alias("_l")), ["connector", "b"])
        best = seen.groupBy("connector", "a").agg(F.min("_l").alias("_l"))
        new = labels.join(best, ["connector", "a"], "left").select("connector", "a", F.least("label", F.coalesce("_l", "label")).alias("label"))
        jump = new.select("connector", F.col("a").alias("label"), F.col("label").alias("_j"))
        new = new.join(jump, ["connector", "label"], "left").select("connector", "a", F.least("label", F.coalesce("_j", "label")).alias("label"))
        new = new.checkpoint()
        moved = new.join(labels.withColumnRenamed("label", "_old"), ["connector", "a"]).filter(F.col("label") != F.col("_old"))
        labels = new
        if moved.isEmpty():
            return labels.withColumnRenamed("a", "trading_pair")


def last_prices(bars: DataFrame) -> DataFrame:
    return latest_rows(bars.select(*SERIES, "ts", F.col("close").alias("price")))
