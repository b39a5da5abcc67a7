"""Q-*: pair statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.recursive import NB
from tickloom.catalog.registry import query
from tickloom.functions.columns import bars_per_day
from tickloom.operators import pairs as Q
from tickloom.operators.hierarchy import ward_clusters, ward_merges
from tickloom.operators.layout import SERIES
from tickloom.plans.grids import pair_grid_configs
from tickloom.plans.screeners import accepted_pairs, liquid_pairs, relationship_counts

LOOKBACK_DAYS, SIGNAL_DAYS = 14, 3
LOOK, SIGNAL = LOOKBACK_DAYS * bars_per_day("1h"), SIGNAL_DAYS * bars_per_day("1h")
RET = {**NB, "r": "SELECT *, close / nullif(prev_close, 0) - 1 AS ret FROM nb WHERE prev_close IS NOT NULL"}


@query("ql_funding_top", "connector pair1 pair2 abs_rate_difference:8 rank:i", "funding",
       sql="""SELECT *, row_number() OVER (PARTITION BY connector ORDER BY abs_rate_difference DESC, pair1, pair2) AS rank FROM (
SELECT a.connector, a.trading_pair AS pair1, b.trading_pair AS pair2, abs(a.rate - b.rate) AS abs_rate_difference FROM funding a JOIN funding b
ON a.connector = b.connector AND a.trading_pair < b.trading_pair) QUALIFY rank <= 3""")
def qm(view):
    return Q.top_funding_differences(view("funding"), 3)


@query("qj_correlation", "pair1 pair2 points:i correlation:6", "bars_1d", ctes={"nb": O.numbered("bars_1d"),
       "r": "SELECT trading_pair, ts, close / nullif(prev_close, 0) - 1 AS ret FROM nb WHERE prev_close IS NOT NULL"},
       sql="""SELECT a.trading_pair AS pair1, b.trading_pair AS pair2, count(*) AS points, corr(a.ret, b.ret) AS correlation FROM r a JOIN r b
ON a.ts = b.ts AND a.trading_pair < b.trading_pair GROUP BY 1, 2 HAVING count(*) >= 50""")
def qj(view):
    return Q.pair_correlations(Q.returns(view("bars_1d")), "ret", 50)


AL = """SELECT a.trading_pair AS pair1, b.trading_pair AS pair2, a.ts, a.{x} AS x1, b.{x} AS x2,
row_number() OVER (PARTITION BY a.trading_pair, b.trading_pair ORDER BY a.ts) AS k FROM {src} a JOIN {src} b ON a.ts = b.ts AND a.trading_pair < b.trading_pair"""


@query("qe_lead_lag", "pair1 pair2 best_lag:i best_lag_corr:6 dominant follower", "bars_1h",
       ctes={**RET, "al": AL.format(x="ret", src="r"),
             "c": """SELECT a.pair1, a.pair2, l.lag, corr(a.x1, b.x2) AS c FROM al a JOIN (SELECT unnest(range(-6, 7)) AS lag) l ON true
JOIN al b ON a.pair1 = b.pair1 AND a.pair2 = b.pair2 AND b.k = a.k - l.lag GROUP BY ALL""",
             "b": "SELECT pair1, pair2, arg_max(lag, c) AS best_lag, max(c) AS best_lag_corr FROM c GROUP BY 1, 2"},
       sql="""SELECT *, CASE WHEN best_lag < 0 THEN pair2 WHEN best_lag > 0 THEN pair1 END AS dominant, CASE WHEN best_lag < 0 THEN pair1 WHEN best_lag > 0 THEN pair2 END AS follower FROM b""")
def qe(view):
    return Q.lead_lag(Q.returns(view("bars_1h")), "ret")


@query("qe_lead_lag_tail", "pair1 pair2 best_lag:i best_lag_corr:6", "bars_1h",
       ctes={**RET, "t": "SELECT *, -row_number() OVER (PARTITION BY trading_pair ORDER BY ts DESC) AS pos FROM r",
             "al": AL.format(x="ret", src="t").replace("a.ts = b.ts", "a.pos = b.pos"),
             "c": """SELECT a.pair1, a.pair2, l.lag, corr(a.x1, b.x2) AS c FROM al a JOIN (SELECT unnest(range(-6, 7)) AS lag) l ON true
JOIN al b ON a.pair1 = b.pair1 AND a.pair2 = b.pair2 AND b.k = a.k - l.lag GROUP BY ALL"""},
       sql="SELECT pair1, pair2, arg_max(lag, c) AS best_lag, max(c) AS best_lag_corr FROM c GROUP BY 1, 2")
def qe_tail(view):
    return Q.lead_lag(Q.returns(view("bars_1h")), "ret", align="tail")


@query("qh_transfer_entropy", "predictor response transfer_entropy:6", "bars_1h",
       ctes={**RET, "al0": AL.format(x="ret", src="r"),
             "al": "SELECT pair1 AS predictor, pair2 AS response, k, x1 AS x, x2 AS y FROM al0 UNION ALL SELECT pair2, pair1, k, x2, x1 FROM al0",
             "e": "SELECT *, min(x) OVER g AS xa, max(x) OVER g AS xb, min(y) OVER g AS ya, max(y) OVER g AS yb FROM al WINDOW g AS (PARTITION BY predictor, response)",
             "s": """SELECT *, CASE WHEN x >= xb THEN 3 WHEN x >= xa + (xb - xa) / 3 * 2 THEN 2 WHEN x >= xa + (xb - xa) / 3 THEN 1 ELSE 0 END AS sx,
CASE WHEN y >= yb THEN 3 WHEN y >= ya + (yb - ya) / 3 * 2 THEN 2 WHEN y >= ya + (yb - ya) / 3 THEN 1 ELSE 0 END AS sy FROM e""",
             "m": "SELECT *, lead(sy) OVER (PARTITION BY predictor, response ORDER BY k) AS sn FROM s",
             "j": "SELECT predictor, response, sn, sy, sx, count(*) AS n FROM m WHERE sn IS NOT NULL GROUP BY ALL",
             "w": """SELECT *, sum(n) OVER (PARTITION BY predictor, response) AS tot, sum(n) OVER (PARTITION BY predictor, response, sy, sx) AS past,
sum(n) OVER (PARTITION BY predictor, response, sn, sy) AS moves, sum(n) OVER (PARTITION BY predictor, response, sy) AS here FROM j"""},
       sql="SELECT predictor, response, round(sum(n / tot * log2((n / past) / (moves / here))), 6) AS transfer_entropy FROM w GROUP BY 1, 2")
def qh(view):
    return Q.information_flow(Q.returns(view("bars_1h")), "ret")


SPREAD = {
    **NB, "recent": f"SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY connector, trading_pair ORDER BY ts DESC) <= {LOOK}",
    "al0": AL.format(x="close", src="recent"),
    "al": "SELECT pair1 AS base, pair2 AS quote, k, ts, x1 AS y, x2 AS x FROM al0 UNION ALL SELECT pair2, pair1, k, ts, x2, x1 FROM al0",
    "g": "SELECT base, quote, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, count(*) AS n FROM al GROUP BY ALL",
    "z": "SELECT al.*, alpha, beta, n, y - (alpha + beta * x) AS z FROM al JOIN g USING (base, quote)",
    "spread": """SELECT base, quote, any_value(alpha) AS alpha, any_value(beta) AS beta, stddev_pop(z) AS z_std,
(arg_max(z, k) - avg(z)) / stddev_pop(z) AS current_z_score, median((alpha + beta * x - y) / abs(y) * 100) FILTER (WHERE k > n - 72) AS median_error, max(ts) AS last_ts FROM z GROUP BY base, quote""",
}


def coint(view):
    return Q.cointegration(view("bars_1h"), LOOK, SIGNAL, 0.5)


# upper tail of the normal distribution at |z| by the series of the error function
N_TAIL = """0.5 - 0.5 * exp(-(current_z_score * current_z_score) / 2) * (SELECT sum((abs(current_z_score) / sqrt(2)) ** (2 * j + 1) / exp(lgamma(j + 1.5))) FROM (SELECT unnest(range(0, 100)) AS j))"""


@query("qb_spread", "base quote alpha:5 beta:7 z_std:5 current_z_score:5 side signal_strength:5 mean_reversion_probability:6 median_error:4", "bars_1h", ctes=SPREAD,
       sql=f"""SELECT *, {N_TAIL} AS mean_reversion_probability, CASE WHEN abs(current_z_score) < 0.5 THEN 'both' WHEN current_z_score > 0.5 THEN 'short' ELSE 'long' END AS side,
abs(current_z_score) / 0.5 AS signal_strength FROM spread""")
def qb(view):
    return coint(view)


GRID = {**SPREAD, "pr": "SELECT connector, trading_pair AS base, arg_max(close, ts) AS price FROM bars_1h GROUP BY 1, 2",
        "gr": """SELECT *, abs(current_z_score) > 0.4 AS live, CASE WHEN current_z_score > 0 THEN -1 ELSE 1 END AS way FROM spread JOIN pr USING (base)""",
        "gl": """SELECT *, CASE WHEN live THEN CASE WHEN way < 0 THEN 'short' ELSE 'long' END ELSE 'both' END AS grid_side, CASE WHEN live THEN price END AS entry_price,
CASE WHEN live THEN price * (1 + way * abs(current_z_score) * z_std * beta) END AS end_price, CASE WHEN live THEN price * (1 - way * z_std * beta) END AS limit_price FROM gr"""}


def grids(view):
    return Q.grid_levels(coint(view), Q.last_prices(view("bars_1h")), entry=0.4)


@query("qc_grid_levels", "base quote grid_side entry_price:4 end_price:4 limit_price:4 grid_step:5 stop_z_score:5", "bars_1h", ctes=GRID,
       sql="""SELECT *, abs(end_price - entry_price) / 6 AS grid_step, CASE WHEN live THEN current_z_score + CASE WHEN way < 0 THEN 1 ELSE -1 END END AS stop_z_score FROM gl""")
def qc(view):
    return grids(view)


@query("qd_ratings", "base quote potential_profit:6 risk_ratio:5", "bars_1h", ctes=GRID,
       sql="""SELECT *, CASE WHEN live THEN abs(end_price - entry_price) / entry_price ELSE 0 END AS potential_profit,
CASE WHEN live THEN abs(end_price - entry_price) / nullif(abs(limit_price - entry_price), 0) ELSE 0 END AS risk_ratio FROM gl""")
def qd(view):
    return Q.pair_ratings(grids(view))


@query("qa_cointegration", "base quote p_value:6 beta:6 current_z_score:5 points:i", "bars_1h")
def qa(view):
    return coint(view)


@query("qi_rolling_cuts", "base quote cut:i p_value:6 beta:6 points:i", "bars_1h")
def qi(view):
    return Q.cointegration(view("bars_1h"), LOOK, SIGNAL, cuts=(0, 100, 200))


@query("a26_accepted_pairs", "pair1 pair2 coint_value:6", "bars_1h")
def a26(view):
    return accepted_pairs(coint(view), 0.05)


@query("qf_granger", "predictor response causal best_lag:i best_p_value:4", "bars_1h")
def qf(view):
    return Q.granger(Q.returns(view("bars_1h")), "ret")


@query("qg_dtw", "pair1 pair2 dtw_distance:5 dominant follower", "bars_1h")
def qg(view):
    return Q.time_warping(Q.returns(view("bars_1h")), "ret")


def distance_table(view, within=None):
    """Distances of the liquid daily markets from correlations, which SQL can state as well. With ``within``, of the pairs
    further apart there may be the symbols only."""
    b = view("bars_1d")
    # a row per liquid market, so no bar is shuffled for it
    b = b.join(F.broadcast(liquid_pairs(b).select(*SERIES)), [*SERIES], "left_semi")
    c = Q.pair_correlations(Q.returns(b), "ret", 50, within=within)
    return c.select("connector", "pair1", "pair2", (1 - F.col("correlation")).alias("distance"))


NEAR = {
    "nb": O.numbered("bars_1d"),
    "liq": "SELECT connector, trading_pair FROM (SELECT connector, trading_pair, sum(quote_asset_volume) AS q FROM bars_1d GROUP BY 1, 2) QUALIFY q >= quantile_cont(q, 0.75) OVER ()",
    "r": "SELECT connector, trading_pair, ts, close / nullif(prev_close, 0) - 1 AS ret FROM nb JOIN liq USING (connector, trading_pair) WHERE prev_close IS NOT NULL",
    "c": """SELECT a.connector, a.trading_pair AS pair1, b.trading_pair AS pair2, 1 - corr(a.ret, b.ret) AS distance FROM r a JOIN r b
ON a.connector = b.connector AND a.ts = b.ts AND a.trading_pair < b.trading_pair GROUP BY 1, 2, 3 HAVING count(*) >= 50""",
    "e": "SELECT connector, pair1 AS a, pair2 AS b FROM c WHERE distance < 0.75 UNION SELECT connector, pair2, pair1 FROM c WHERE distance < 0.75",
    "reach(connector, node, l) AS (": """SELECT connector, pair1, pair1 FROM c UNION SELECT connector, pair2, pair2 FROM c
UNION SELECT e.connector, e.b, reach.l FROM reach JOIN e ON e.connector = reach.connector AND e.a = reach.node""",
}


@query("qk_clusters_at_height", "trading_pair label", "bars_1d", ctes=NEAR, sql="SELECT node AS trading_pair, min(l) AS label FROM reach GROUP BY connector, node")
def qk_height(view):
    return Q.clusters_at(distance_table(view, 0.75), 0.75)


CLUSTERS = 5
WARD = {
    **{n: NEAR[n] for n in ("nb", "liq", "r", "c")},
    "names": "SELECT connector, pair1 AS s FROM c UNION SELECT connector, pair2 FROM c",
    "w(step, connector, a, b, d, na, nb) AS (": """SELECT 1, x.connector, x.s, y.s, coalesce(c.distance, 1.0) ** 2, 1::DOUBLE, 1::DOUBLE FROM names x
JOIN names y ON x.connector = y.connector AND x.s < y.s LEFT JOIN c ON c.connector = x.connector AND c.pair1 = x.s AND c.pair2 = y.s
UNION ALL SELECT step + 1, connector, x, y, (sum(part) - CASE WHEN x = m.a THEN ny WHEN y = m.a THEN nx ELSE 0 END * m.d) / (nx + ny), nx, ny FROM (
SELECT step, connector, m, part, CASE WHEN p < q THEN p ELSE q END AS x, CASE WHEN p < q THEN q ELSE p END AS y,
CASE WHEN p < q THEN np ELSE nq END AS nx, CASE WHEN p < q THEN nq ELSE np END AS ny FROM (
SELECT step, connector, m, (na + nb) * d AS part, CASE WHEN a = m.b THEN m.a ELSE a END AS p, CASE WHEN b = m.b THEN m.a ELSE b END AS q,
CASE WHEN a IN (m.a, m.b) THEN m.n ELSE na END AS np, CASE WHEN b IN (m.a, m.b) THEN m.n ELSE nb END AS nq FROM (
SELECT *, min({'d': d, 'a': a, 'b': b, 'n': na + nb}) OVER (PARTITION BY connector) AS m FROM w)) WHERE p <> q) GROUP BY step, connector, x, y, nx, ny, m""",
    "merges": "SELECT connector, m.a AS a, m.b AS b, sqrt(m.d) AS height, m.n AS n FROM (SELECT connector, min({'d': d, 'a': a, 'b': b, 'n': na + nb}) AS m FROM w GROUP BY connector, step)",
}
WARD_CUT = WARD | {
    "top": f"""SELECT connector, height AS cut FROM (SELECT *, row_number() OVER (PARTITION BY connector ORDER BY height) AS k FROM merges)
JOIN (SELECT connector, count(*) - {CLUSTERS} AS needed FROM names GROUP BY 1) USING (connector) WHERE k = needed""",
    "made": "SELECT connector, a, b FROM merges JOIN top USING (connector) WHERE height <= cut",
    "lab(connector, s, l) AS (": "SELECT connector, s, s FROM names UNION ALL SELECT lab.connector, s, a FROM lab JOIN made ON made.connector = lab.connector AND b = l",
}


@query("qk_ward_merges", "a b height:5 n:i", "bars_1d", ctes=WARD, sql="SELECT * FROM merges")
def qk_merges(view):
    return ward_merges(distance_table(view))


@query("qk_ward_clusters", "trading_pair label members:i", "bars_1d", ctes=WARD_CUT,
       sql="SELECT *, count(*) OVER (PARTITION BY connector, label) AS members FROM (SELECT connector, s AS trading_pair, min(l) AS label FROM lab GROUP BY 1, 2)")
def qk_clusters(view):
    return ward_clusters(distance_table(view), CLUSTERS)


@query("a25_relationships", "p_below_005:i p_below_010:i corr_above_07:i corr_above_03:i both:i corr_only:i coint_only:i neither:i", "bars_1h")
def a25(view):
    b = view("bars_1h")
    p = Q.distances(coint(view)).select("connector", "pair1", "pair2", (1 - F.col("distance")).alias("p_value"))
    c = Q.pair_correlations(b, "close", 100)
    return relationship_counts(p.join(c, ["connector", "pair1", "pair2"]))


@query("g18_pair_grids", "config_id leg trading_pair side start_price:4 end_price:4 limit_price:4 amount_quote:2", "bars_1h", ctes=GRID,
       sql="""SELECT concat(base, '_', quote, '_coint_config') AS config_id, 'base' AS leg, base AS trading_pair, 'BUY' AS side, least(entry_price, end_price) AS start_price,
greatest(entry_price, end_price) AS end_price, greatest(limit_price, 0) AS limit_price, 500.0 AS amount_quote FROM gl WHERE live
UNION ALL SELECT concat(base, '_', quote, '_coint_config'), 'quote', quote, 'SELL', least(entry_price, end_price), greatest(entry_price, end_price), greatest(limit_price, 0), 500.0 FROM gl WHERE live""")
def g18(view):
    g = grids(view).filter(F.col("grid_side") != "both")
    legs = [F.col(c).alias(f"{leg}_{n}") for leg in ("base", "quote")
            for n, c in (("start_price", "entry_price"), ("end_price", "end_price"), ("limit_price", "limit_price"))]
    return pair_grid_configs(g.select("base", "quote", *legs))
