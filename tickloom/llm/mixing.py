"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Documents are counted into cells (source, language, topic). A cell expects ``rate`` of its tokens at first, and these
expectations are raked in turn until their sums meet the target of every source, language and topic. No cell can expect
more than it has: a raking step multiplies the cells of a value by one factor, cuts those that are full, and the factor
is the one with which the sum is met exactly all the same (the others take what the full ones cannot). Rounds
go on until no marginal is off by more than ``ERROR``. A document is kept with the probability of its cell
(expected tokens / tokens), decided by a hash of its id, so its choice does not depend on how the data are
partitioned.

Default targets flatten the natural shares: share ** flatness, normalised. Where a value has fewer tokens than its target, all of
them are wanted and the rest goes to the other values in proportion; ``report`` names such values. Raking is window
sums over the cells of a value, a table of sources x languages x topics rows that is written after every few rounds;
the documents are read twice and never shuffled (the cells are joined by value, and Spark broadcasts them only where
they are small).

Nulls: a null source, language or topic is a value of its own; null or empty text has topic ``empty`` and one
token. A null doc_id is replaced by a hash of the text. Rows that repeat a doc_id are kept or dropped
together. Targets that contradict each other are met until rounds no longer help, those raked last best; ``report``
shows by how much they are missed. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written

DIMENSIONS = ("source", "lang", "topic")
FLATNESS = {"source": 0.7, "lang": 0.6, "topic": 0.8}
RATE, SALT = 0.6, "mix"
#: The largest relative error of a marginal, the rounds between two looks at it, and the looks at most.
ERROR, ROUNDS, LOOKS = 1e-9, 6, 16
#: Cells (counted) that one task rakes; more are dealt by value before every step, with the same result.
TOGETHER = 100_000


def tokens_of(text: Column | str) -> Column:
    """A token estimate: a quarter of the UTF-8 bytes, and one."""
    return F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / 4) + 1


def topic_of(text: Column | str) -> Column:
    """A form class that needs no model; pass a topic column of your own where there is one."""
    t = F.col(text) if isinstance(text, str) else text
    return (F.when(t.isNull() | (t == ""), "empty")
            .when(t.contains(" | "), "table")
            .when(t.contains("@"), "contact")
            .when(t.contains("!!"), "shout")
            .when(F.contains(t, F.lit("\n")), "prose")
            .otherwise("line"))


def filled(cells: DataFrame, keys: tuple[str, ...], size: str, capacity: str, target: Column, order: tuple[str, ...]) -> DataFrame:
    """``cells`` with ``size`` multiplied by one factor per ``keys`` and cut at ``capacity``, so that it sums to ``target``.

    With cells in order of capacity / size, a factor that fills exactly those before cell i is (target - their capacity) / (size of
    the others). It rises up to the true one and falls after it, so the true factor is the largest."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    fill = F.try_divide(F.col(capacity), F.col(size))
    up = whole.orderBy(fill.asc_nulls_last(), *order).rowsBetween(Window.unboundedPreceding, -1)
    down = whole.orderBy(fill.desc_nulls_first(), *[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = cells.withColumns({"_before": F.coalesce(F.sum(capacity).over(up), F.lit(0.0)), "_rest": F.sum(size).over(down)})
    out = out.withColumn("_factor", F.max(F.try_divide(target - F.col("_before"), F.col("_rest"))).over(whole))
    now = F.least(F.col(capacity), F.greatest(F.col("_factor"), F.lit(0.0)) * F.col(size))
    return out.withColumn(size, F.coalesce(now, F.lit(0.0))).drop("_before", "_rest", "_factor")


def marginals(cells: DataFrame, targets: Mapping[str, Mapping] | None, flatness: Mapping[str, float], rate: float) -> dict[str, DataFrame]:
    """Per dimension: its values with ``wanted`` (share asked for), ``capacity`` and ``target`` (tokens)."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    shares = {}
    for d in DIMENSIONS:
        values = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("capacity"))
        given = (targets or {}).get(d)
        if given is None:
            wanted = F.pow(F.col("capacity") / F.lit(total), F.lit(flatness[d]))
        else:
            pairs = [F.lit(x) for item in given.items() for x in item]
            wanted = F.coalesce(F.create_map(*pairs)[F.coalesce(F.col(d), F.lit(""))], F.lit(0.0))
        shares[d] = values.withColumn("wanted", wanted.cast("double"))
    # no more than what the values that are asked for hold
    reach = [float(v.agg(F.sum(F.when(F.col("wanted") > 0, F.col("capacity")))).first()[0] or 0) for v in shares.values()]
    size = min(rate * total, *reach)
    return {d: filled(v.withColumn("target", F.col("wanted")), (), "target", "capacity", F.lit(size), (d,)) for d, v in shares.items()}


def rake(cells: DataFrame, targets: Mapping[str, Mapping] | None = None, flatness: Mapping[str, float] = FLATNESS,
         rate: float = RATE, error: float = ERROR) -> DataFrame:
    """``cells`` (source, lang, topic, tokens, docs) with ``expected`` tokens, at most ``tokens``, and a column
    ``target_<dimension>`` of the tokens its value should have in all.

    ``targets[dimension]`` maps values to shares; values left out get none."""
    out = cells
    for d, values in marginals(cells, targets, flatness, rate).items():
        values = values.select(F.col(d).alias("_value"), F.col("target").alias(f"target_{d}"))
        out = out.join(values, out[d].eqNullSafe(F.col("_value")), "left").drop("_value")
    out = out.withColumns({"capacity": F.col("tokens").cast("double"), "expected": F.lit(rate) * F.col("tokens")})
    out = written(out, "raked")
    together, before = out.count() <= TOGETHER, float("inf")
    for _ in range(LOOKS):
        if together:
            out = out.coalesce(1)  # the windows of all rounds then need no exchange
        for _ in range(ROUNDS):
            for d in DIMENSIONS:
                out = filled(out, (d,), "expected", "capacity", F.col(f"target_{d}"), DIMENSIONS)
        out = written(out, "raked")
        off = worst(out)
        if off <= error or off > 0.9 * before:  # met, or contradictory
            break
        before = off
    return out.drop("capacity")


def worst(raked: DataFrame) -> float:
    """The largest relative error of a marginal."""
    sums = [raked.groupBy(d).agg(F.sum("expected").alias("e"), F.first(f"target_{d}").alias("t")) for d in DIMENSIONS]
    off = [s.agg(F.max(F.abs(F.try_divide(F.col("e"), F.col("t")) - 1))).first()[0] for s in sums]
    return max((x for x in off if x is not None), default=0.0)


def report(raked: DataFrame) -> DataFrame:
    """Per dimension and value: tokens, target, expected, error (relative) and full (all of its tokens are wanted)."""
    out = None
    for d in DIMENSIONS:
        rows = raked.groupBy(d).agg(F.sum("tokens").alias("tokens"), F.first(f"target_{d}").alias("target"), F.sum("expected").alias("expected"))
        rows = rows.select(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"), "tokens", "target", "expected",
                           (F.try_divide("expected", "target") - 1).alias("error"), (F.col("target") >= F.col("tokens")).alias("full"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mixed(docs: DataFrame, topic: Column | None = None, targets: Mapping[str, Mapping] | None = None,
          flatness: Mapping[str, float] = FLATNESS, rate: float = RATE) -> DataFrame:
    """Every document with ``row`` (all its columns as a struct), source, lang, topic, tokens, expected (tokens of its
    cell), probability and kept."""
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("source"), F.col("lang"),
        (topic_of("text") if topic is None else topic).alias("topic"), tokens_of("text").alias("tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit("")).alias("key"))
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    cells = rake(written(cells, "cells"), targets, flatness, rate).select(*DIMENSIONS, "tokens", "docs", "expected")
    cells = cells.withColumnsRenamed({c: f"c_{c}" for c in (*DIMENSIONS, "tokens", "docs")})
    same = [rows[d].eqNullSafe(cells[f"c_{d}"]) for d in DIMENSIONS]
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SALT}:"), F.col("key")).cast("binary")), 1, 8), 16, 10)
    return (rows.join(cells, same).withColumn("probability", F.col("expected") / F.col("c_tokens"))
            .withColumn("kept", chance.cast("double") / F.lit(float(1 << 32)) < F.col("probability"))
            .select("row", *DIMENSIONS, "tokens", "expected", "probability", "kept"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The kept documents with their own columns."""
    kept = mixed(docs, **options).filter("kept")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def oracle_sql(rounds: int = LOOKS * ROUNDS, rate: float = RATE) -> str:
    """The SQL of ``mixed`` with default targets over ``documents``: doc_id, dimensions, tokens, probability, kept."""
    def fill(source: str, keys: str, size: str, capacity: str, target: str, order: str) -> str:
        ratio = f"{capacity} / nullif({size}, 0)"
        part = f"PARTITION BY {keys}" if keys else ""
        return f"""SELECT * EXCLUDE ({size}, _factor), coalesce(least({capacity}, greatest(_factor, 0) * {size}), 0) AS {size}
  FROM (SELECT * EXCLUDE (_before, _rest), max((({target}) - coalesce(_before, 0)) / nullif(_rest, 0)) OVER ({part}) AS _factor
  FROM (SELECT *, sum({capacity}) OVER ({part} ORDER BY {ratio} NULLS LAST, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before,
  sum({size}) OVER ({part} ORDER BY {ratio} NULLS LAST, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _rest FROM {source}))"""

    parts = ["""docs AS (SELECT doc_id, source, lang,
  CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table'
       WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '!!') THEN 'shout'
       WHEN contains(text, chr(10)) THEN 'prose' ELSE 'line' END AS topic,
  coalesce(strlen(text), 0) // 4 + 1 AS tokens,
  coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS key FROM documents)""",
             "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
             "total AS (SELECT sum(tokens) AS n FROM cells)"]
    for d in DIMENSIONS:
        parts.append(f"""v_{d} AS (SELECT {d}, sum(tokens) AS capacity, pow(sum(tokens) / (SELECT n FROM total), {FLATNESS[d]}) AS target
  FROM cells GROUP BY {d})""")
        parts.append(f"t_{d} AS MATERIALIZED ({fill(f'v_{d}', '', 'target', 'capacity', f'{rate} * (SELECT n FROM total)', d)})")
    joins = " ".join(f"JOIN t_{d} ON cells.{d} IS NOT DISTINCT FROM t_{d}.{d}" for d in DIMENSIONS)
    parts.append(f"""w0 AS (SELECT cells.*, {', '.join(f't_{d}.target AS target_{d}' for d in DIMENSIONS)}, {rate} * tokens AS expected
  FROM cells {joins})""")
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            parts.append(f"w{k + 1} AS MATERIALIZED ({fill(f'w{k}', d, 'expected', 'tokens', f'target_{d}', ', '.join(DIMENSIONS))})")
            k += 1
    return "WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens::BIGINT AS tokens,
  round(w.expected / w.tokens, 6) AS probability,
  CAST('0x' || substr(md5('{SALT}:' || d.key), 1, 8) AS BIGINT) / 4294967296.0 < w.expected / w.tokens AS kept
FROM docs d JOIN w{k} w ON d.source IS NOT DISTINCT FROM w.source AND d.lang IS NOT DISTINCT FROM w.lang
  AND d.topic IS NOT DISTINCT FROM w.topic"""
