"""How ordered work over a series is spread out.

A series (one symbol) may hold a large share of all rows, so nothing here sorts a whole series in
one task:

* ``prefix_scan`` computes running aggregates (count, sum, min, max, first, last non-NULL) in two
  levels: a local running value inside each (series, time segment), plus the carry of the earlier
  segments taken from one row per segment.
* ``number_rows`` is the running count: the position of a row in its series.
* ``segmented`` cuts the numbered series in pieces of ``rows`` rows and repeats the last ``halo``
  rows of what comes before in front of each piece. Any function with a memory of at most ``halo``
  rows is then exact on (series, piece); ``own_rows`` drops the repeats.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tickloom.functions.columns import col, epoch_micros

SERIES = ("connector", "trading_pair")
SEGMENT_ROWS = 8192
BAR_SECONDS = "bar_seconds"  # metadata of the ts column: length of a bar
PIECE = "_piece"
POS = "_pos"
OWN = "_own"


def time_segment(ts: str | Column, seconds: int) -> Column:
    """Index of the fixed-width time slice that holds ``ts``."""
    return F.floor(epoch_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def mark_bars(df: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    """Note the bar length on the time column; it travels with the column through transforms."""
    return df.withMetadata(ts, {BAR_SECONDS: seconds})


def magnitude_slice(x: str | Column, per_fold: int = 64) -> Column:
    """A slice number that grows with ``x`` and is as fine for small numbers as for large ones: about 1.6% of
    the value wide. 0 has a slice of its own."""
    x = col(x).cast("double")
    size = F.floor(F.log(F.abs(x)) * per_fold) + 1000 * per_fold  # above 0 for every double
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("bigint") * size)


def segment_width(df: DataFrame, ts: str | Column) -> int:
    """Time slice that holds about SEGMENT_ROWS bars; 6 hours where the bar length is unknown (ticks)."""
    if isinstance(ts, str) and ts in df.columns:
        seconds = df.schema[ts].metadata.get(BAR_SECONDS)
        if seconds:
            return int(seconds) * SEGMENT_ROWS
    return 6 * 3600


def join_series(left: DataFrame, right: DataFrame, on: Sequence[str] = SERIES, how: str = "inner") -> DataFrame:
    """Join on key columns in which NULL equals NULL, so a series with a NULL key or venue stays a series.

    Spark plans it as an equi-join. The key columns are the left side's; other columns must differ in name."""
    names = {c: f"_right_{c}" for c in on}
    r = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(names[c])) for c in on])
    out = left.join(r, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def prefix_scan(
    df: DataFrame,
    specs: dict[str, tuple[str, str | Column]],
    keys: Sequence[str] = SERIES,
    order: Sequence[str | Column] = ("ts",),
    segment_seconds: int | None = None,
    segment: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates per ``keys`` in ``order``, without one task per key.

    ``specs`` maps the output name to (kind, column), kind in sum, count, min, max, first, last
    (these skip NULLs), prev (the previous row's value, NULL or not), sum_peak (the highest running
    sum so far) and series_sum (the sum over the whole series). The input is read twice, the second
    time for one row per segment, so related aggregates belong in one call. ``segment`` overrides the time slice: any expression that grows with the
    order. With ``inclusive=False`` the current row is left out.
    """
    keys = list(keys)
    seg = segment
    if seg is None:
        seg = time_segment(order[0], segment_seconds or segment_width(df, order[0]))
    order = [col(o) for o in order]
    # key and slice in one struct: it is never NULL and its NULL fields are equal, so the join below keeps rows
    # with a NULL key or time (a slice of their own) and reuses the window's partitioning
    df = df.withColumn("_cell", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], seg.alias("seg")))
    local = Window.partitionBy("_cell").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    fields = [F.col(f"_cell.k{i}") for i in range(len(keys))]
    before = Window.partitionBy(*fields).orderBy("_cell.seg").rowsBetween(Window.unboundedPreceding, -1)

    running, totals, carries, merged = {}, [], [], {}
    whole = Window.partitionBy(*fields)
    steps, extra = {}, {}
    for out, (kind, source) in specs.items():
        x = col(source)
        loc, car, tot = f"_l_{out}", f"_c_{out}", f"_t_{out}"
        known = F.when(x.isNotNull(), F.struct(*order))
        if kind in ("sum", "count"):
            fn = F.sum if kind == "sum" else F.count
            running[loc] = fn(x).over(local)
            totals.append(fn(x).alias(tot))
            carries.append(F.sum(tot).over(before).alias(car))
            both = F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(car), F.lit(0))
            merged[out] = both if kind == "count" else F.when(
                F.col(loc).isNotNull() | F.col(car).isNotNull(), both
            )
        elif kind == "sum_peak":
            # highest running sum so far: the best of each earlier segment, lifted by what came before it
            df = df.withColumn(f"_r_{out}", F.sum(x).over(local))
            running[loc] = F.max(f"_r_{out}").over(local)
            totals += [F.sum(x).alias(tot), F.max(f"_r_{out}").alias(f"{tot}_p")]
            steps[f"_b_{out}"] = F.coalesce(F.sum(tot).over(before), F.lit(0.0))
            carries.append(F.col(f"_b_{out}").alias(car))
            carries.append(F.max(F.col(f"_b_{out}") + F.col(f"{tot}_p")).over(before).alias(f"{car}_p"))
            merged[out] = F.greatest(F.col(loc) + F.col(car), F.col(f"{car}_p"))
            extra[f"{car}_p"] = extra[f"_r_{out}"] = None
        elif kind == "series_sum":
            totals.append(F.sum(x).alias(tot))
            carries.append(F.sum(tot).over(whole).alias(car))
            merged[out] = F.col(car)
        elif kind in ("min", "max"):
            fn = F.min if kind == "min" else F.max
            running[loc] = fn(x).over(local)
            totals.append(fn(x).alias(tot))
            carries.append(fn(tot).over(before).alias(car))
            merged[out] = (F.least if kind == "min" else F.greatest)(F.col(loc), F.col(car))
        elif kind == "last":
            running[loc] = F.last(x, ignorenulls=True).over(local)
            totals.append(F.max_by(x, known).alias(tot))
            carries.append(F.last(tot, ignorenulls=True).over(before).alias(car))
            merged[out] = F.coalesce(F.col(loc), F.col(car))
        elif kind == "prev":
            box = F.struct(x.alias("v"))
            running[loc] = F.lag(box).over(Window.partitionBy("_cell").orderBy(*order))
            totals.append(F.max_by(box, F.struct(*order)).alias(tot))
            carries.append(F.last(tot, ignorenulls=True).over(before).alias(car))
            merged[out] = F.coalesce(F.col(loc), F.col(car))["v"]
        elif kind == "first":
            running[loc] = F.first(x, ignorenulls=True).over(local)
            totals.append(F.min_by(x, known).alias(tot))
            carries.append(F.first(tot, ignorenulls=True).over(before).alias(car))
            merged[out] = F.coalesce(F.col(car), F.col(loc))
        else:
            raise ValueError(f"unknown running aggregate {kind!r}")

    carry = df.groupBy("_cell").agg(*totals).withColumns(steps).select("_cell", *carries)
    # a merge join keeps the rows partitioned and sorted by (key, segment) as the window left them;
    # left alone, adaptive execution may broadcast the rows and leave the carry's few partitions
    return (
        df.withColumns(running)
        .join(carry.hint("merge"), "_cell")
        .withColumns(merged)
        .drop("_cell", *running, *extra, *[f"_c_{o}" for o in specs])
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    order: Sequence[str | Column] = ("ts",),
    segment_seconds: int | None = None,
) -> DataFrame:
    """Adds ``_pos``: 0-based position of the row in its series."""
    out = prefix_scan(df, {POS: ("count", F.lit(1))}, keys, order, segment_seconds)
    return out.withColumn(POS, F.col(POS) - 1)


@dataclass(frozen=True)
class Pieces:
    """Geometry of a segmented frame and the window specs over it."""

    keys: tuple[str, ...]
    rows: int
    halo: int
    ahead: int = 0

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, PIECE).orderBy(POS)

    def last(self, n: int) -> WindowSpec:
        return self.whole.rowsBetween(-(n - 1), 0)

    def around(self, left: int, right: int) -> WindowSpec:
        return self.whole.rowsBetween(-left, right)

    @property
    def so_far(self) -> WindowSpec:
        return self.whole.rowsBetween(Window.unboundedPreceding, 0)


def segmented(
    df: DataFrame,
    halo: int,
    keys: Sequence[str] = SERIES,
    order: Sequence[str | Column] = ("ts",),
    rows: int | None = None,
    ahead: int = 0,
    segment_seconds: int | None = None,
) -> tuple[DataFrame, Pieces]:
    """Number the series and lay it out in pieces with ``halo`` earlier and ``ahead`` later rows.

    The copy factor is 1 + (halo + ahead) / rows; ``rows`` defaults to at least the halo, so a row
    is copied at most about once.
    """
    rows = rows or max(SEGMENT_ROWS, halo + ahead)
    if POS not in df.columns:
        df = number_rows(df, keys, order, segment_seconds)
    home = F.floor(F.col(POS) / rows)
    first = F.greatest(F.lit(0), F.floor((F.col(POS) - ahead) / rows)) if ahead else home
    final = F.floor((F.col(POS) + halo) / rows) if halo else home
    out = df.withColumn("_home", home)
    if halo or ahead:
        out = out.withColumn(PIECE, F.explode(F.sequence(first, final)))
    else:
        out = out.withColumn(PIECE, F.col("_home"))
    out = out.withColumn(OWN, F.col("_home") == F.col(PIECE)).drop("_home")
    return out, Pieces(tuple(keys), rows, halo, ahead)


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies. The position stays as ``_pos``: the next feature on the same rows uses
    it instead of numbering again. Drop it (``renumber``) after removing or adding rows."""
    return df.filter(F.col(OWN)).drop(OWN, PIECE)


def renumber(df: DataFrame) -> DataFrame:
    return df.drop(POS)
