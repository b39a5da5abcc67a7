"""Numeric kernels for one pair of bounded series or one bounded window (numpy only)."""

from __future__ import annotations

import math

import numpy as np

from tickloom.functions.stats import f_tail, normal_tail

# MacKinnon response surface for two variables with constant.
EG_TAU_STAR, EG_TAU_MIN, EG_TAU_MAX = -2.62, -18.86, 0.92
EG_SMALL = (2.92, 1.5012, 0.039796)
EG_LARGE = (2.1945, 0.64695, -0.29198, -0.042377)


def engle_granger_p(stat: float) -> float:
    if stat > EG_TAU_MAX:
        return 1.0
    if stat < EG_TAU_MIN:
        return 0.0
    c = EG_SMALL if stat <= EG_TAU_STAR else EG_LARGE
    z = sum(v * stat ** i for i, v in enumerate(c))
    return float(1 - normal_tail(z))


def _lagged(e: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Difference, and its regressors: lagged level then ``lags`` lagged differences."""
    d = np.diff(e)
    columns = [e[lags:-1]] + [d[lags - k:len(d) - k] for k in range(1, lags + 1)]
    return d[lags:], np.column_stack(columns)


def unit_root_stat(e: np.ndarray) -> float:
    """t of the lagged level in the residual regression without constant, lag chosen by AIC on a
    common sample, then fitted on the longest sample for that lag."""
    n = len(e)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 1)
    y, x = _lagged(e, top)
    gram, cross, m = x.T @ x, x.T @ y, len(y)
    best, best_aic = 0, math.inf
    for p in range(top + 1):
        k = p + 1
        try:
            ssr = y @ y - cross[:k] @ np.linalg.solve(gram[:k, :k], cross[:k])
        except np.linalg.LinAlgError:
            continue
        aic = m * math.log(max(ssr, 1e-300) / m) + 2 * k
        if aic < best_aic:
            best, best_aic = p, aic
    y, x = _lagged(e, best)
    coef, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ coef
    var = rest @ rest / (len(y) - x.shape[1])
    se = math.sqrt(var * np.linalg.pinv(x.T @ x)[0, 0])
    return float(coef[0] / se) if se > 0 else -math.inf


def hedge(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """(alpha, beta) of y on x."""
    dx = x - x.mean()
    sxx = dx @ dx
    beta = float(dx @ (y - y.mean()) / sxx) if sxx > 0 else 0.0
    return float(y.mean() - beta * x.mean()), beta


def cointegration_p(y: np.ndarray, x: np.ndarray) -> float:
    a, b = hedge(y, x)
    e = y - a - b * x
    if len(e) < 20 or e @ e <= 1e-12 * max(((y - y.mean()) ** 2).sum(), 1e-300):
        return 1.0 if len(e) < 20 else 0.0
    return engle_granger_p(unit_root_stat(e))


def granger_p(y: np.ndarray, x: np.ndarray, max_lag: int) -> list[float]:
    """p-value of the F test that p lags of x add to p lags of y, for p = 1..max_lag."""
    out = []
    for p in range(1, max_lag + 1):
        n = len(y) - p
        own = [np.ones(n)] + [y[p - k:len(y) - k] for k in range(1, p + 1)]
        both = own + [x[p - k:len(x) - k] for k in range(1, p + 1)]
        ssr = []
        for cols in (own, both):
            z = np.column_stack(cols)
            coef, *_ = np.linalg.lstsq(z, y[p:], rcond=None)
            r = y[p:] - z @ coef
            ssr.append(float(r @ r))
        dof = n - 2 * p - 1
        if dof <= 0 or ssr[1] <= 0:
            out.append(float("nan"))
            continue
        out.append(float(f_tail((ssr[0] - ssr[1]) / p / (ssr[1] / dof), p, dof)))
    return out


def dtw_distance(a: np.ndarray, b: np.ndarray, band: int | None = None) -> float:
    """Square root of the cheapest squared-difference path, evaluated by anti-diagonals."""
    n, m = len(a), len(b)
    inf = math.inf
    before = np.full(n + 1, inf)   # diagonal k-2, indexed by i
    last = np.full(n + 1, inf)     # diagonal k-1
    before[0] = 0.0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        if band is not None:
            i = i[np.abs(2 * i - k) <= band]
        now = np.full(n + 1, inf)
        if len(i):
            cost = (a[i - 1] - b[k - i - 1]) ** 2
            now[i] = cost + np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1])
        before, last = last, now
    return float(math.sqrt(last[n]))


def lagged_products(x1: np.ndarray, x2: np.ndarray, pos: np.ndarray, own: np.ndarray, lags: int) -> tuple[np.ndarray, list[float]]:
    """Sums of products of [1, x1 and its lags, x2 and its lags] over the own rows at position ``lags`` or later,
    and, from the piece that begins the series, its first ``lags`` values of x1 and of x2."""
    rows = np.flatnonzero(own & (pos >= lags))
    z = np.column_stack([np.ones(len(rows))] + [x[rows - k] for x in (x1, x2) for k in range(lags + 1)])
    head = [*x1[:lags].tolist(), *x2[:lags].tolist()] if len(pos) and pos[0] == 0 else []
    return z.T @ z, head


def granger_from_products(products: np.ndarray, head: np.ndarray, max_lag: int) -> list[list[float]]:
    """``granger_p`` of x1 on x2 and of x2 on x1 from the sums of ``lagged_products``."""
    w = max_lag + 1
    total = products.reshape(2 * w + 1, 2 * w + 1)
    first = head[:max_lag], head[max_lag:]
    out = []
    for x, y in ((0, 1), (1, 0)):
        values = []
        for p in range(1, max_lag + 1):
            own = [0] + [1 + y * w + k for k in range(1, p + 1)]
            both = own + [1 + x * w + k for k in range(1, p + 1)]
            use = [1 + y * w, *both]
            g = total[np.ix_(use, use)].copy()
            for k in range(p, max_lag):  # rows that have p lags but not max_lag
                z = np.array([first[y][k], 1.0, *(first[y][k - i] for i in range(1, p + 1)), *(first[x][k - i] for i in range(1, p + 1))])
                g += np.outer(z, z)
            scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
            g = g / np.outer(scale, scale)
            ssr = []
            for m in (len(own), len(both)):
                coef, *_ = np.linalg.lstsq(g[1:m + 1, 1:m + 1], g[1:m + 1, 0], rcond=None)
                ssr.append(g[0, 0] - coef @ g[1:m + 1, 0])
            dof = int(round(g[1, 1] * scale[1] ** 2)) - 2 * p - 1
            values.append(float(f_tail((ssr[0] - ssr[1]) / p / (ssr[1] / dof), p, dof)) if dof > 0 and ssr[1] > 1e-14 else float("nan"))
        out.append(values)
    return out


def symbols(x: np.ndarray, bins: int) -> np.ndarray:
    """Equal-width bin index by lower edges; the maximum gets a symbol of its own."""
    edges = np.histogram_bin_edges(x, bins=bins)
    return np.digitize(x, edges) - 1


def transfer_entropy(x: np.ndarray, y: np.ndarray, bins: int = 3) -> float:
    """Plug-in transfer entropy x -> y in bits with history 1."""
    sx, sy = symbols(x, bins), symbols(y, bins)
    n = len(sy) - 1
    base = bins + 1
    joint = np.bincount(sy[1:] * base * base + sy[:-1] * base + sx[:-1], minlength=base ** 3).reshape(base, base, base) / n
    past = joint.sum(axis=0)        # p(y, x)
    moves = joint.sum(axis=2)       # p(y+, y)
    here = moves.sum(axis=0)        # p(y)
    nz = joint > 0
    ratio = np.divide(joint * here[None, :, None], past[None, :, :] * moves[:, :, None], out=np.ones_like(joint), where=nz)
    return float((joint[nz] * np.log2(ratio[nz])).sum())


def lagged_correlations(a: np.ndarray, b: np.ndarray, max_lag: int) -> list[float]:
    """corr(a_t, b_(t-lag)) for lag = -max_lag..max_lag over complete pairs."""
    out = []
    for lag in range(-max_lag, max_lag + 1):
        x, y = (a[lag:], b[:len(b) - lag]) if lag >= 0 else (a[:lag], b[-lag:])
        ok = ~(np.isnan(x) | np.isnan(y))
        x, y = x[ok], y[ok]
        out.append(float(np.corrcoef(x, y)[0, 1]) if len(x) > 2 and x.std() > 0 and y.std() > 0 else float("nan"))
    return out


def ward_labels(distance: np.ndarray, k: int) -> np.ndarray:
    """Merge by least increase in within-cluster variance until k clusters are left; labels 1..k in
    order of each cluster's first member."""
    n = len(distance)
    d = np.array(distance, dtype=float) ** 2
    np.fill_diagonal(d, np.inf)
    size, owner = np.ones(n), np.arange(n)
    for _ in range(max(0, n - k)):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        dij = d[i, j]
        with np.errstate(invalid="ignore"):
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * dij) / (size[i] + size[j] + size)
        d[i], d[:, i] = new, new
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        gone = ~np.isfinite(d).any(axis=1)
        d[i, gone], d[gone, i] = np.inf, np.inf
        size[i] += size[j]
        owner[owner == j] = i
    firsts = {o: r + 1 for r, o in enumerate(dict.fromkeys(owner.tolist()))}
    return np.array([firsts[o] for o in owner.tolist()])


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict local maxima; a plateau counts at its middle."""
    if len(x) < 3:
        return np.array([], dtype=int)
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    end = np.r_[start[1:], len(x)] - 1
    v = x[start]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (start[top] + end[top]) // 2


def find_peaks(x: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Local maxima, thinned to ``distance`` by height, then by prominence."""
    peaks = local_maxima(x)
    keep = np.ones(len(peaks), dtype=bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            keep &= ~near
    out = []
    for p in peaks[keep]:
        left = np.flatnonzero(x[:p] > x[p])
        right = np.flatnonzero(x[p + 1:] > x[p])
        lo = left[-1] + 1 if len(left) else 0
        hi = p + 1 + right[0] if len(right) else len(x)
        if x[p] - max(x[lo:p + 1].min(), x[p:hi].min()) >= prominence:
            out.append(int(p))
    return np.array(out, dtype=int)
