"""NumPy kernels for one short series or one small matrix; Spark deals series to tasks, these never see more than one.

Each returns None where its input does not define it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

# ---- special functions -------------------------------------------------------------------------------------------


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(statistic: float, freedom: float) -> float:
    return upper_gamma(freedom / 2, statistic / 2)


# ---- spectrum and complexity -------------------------------------------------------------------------------------


def welch(x: np.ndarray, segment: int = 256) -> tuple[np.ndarray, np.ndarray] | None:
    """Frequencies and one-sided density: means over half-overlapping Hann segments, nothing removed."""
    n = len(x)
    if n < 8:
        return None
    w = min(max(8, segment), n)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(w) / w)
    starts = np.arange(0, n - w + 1, w - w // 2)
    power = (np.abs(np.fft.rfft(x[starts[:, None] + np.arange(w)] * taper, axis=1)) ** 2).mean(axis=0) / (taper**2).sum()
    power[1 : (w + 1) // 2] *= 2
    return np.fft.rfftfreq(w), power


def periodogram(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Frequencies and one-sided density of the whole series: its full-length transform, nothing removed or tapered."""
    n = len(x)
    if n < 8:
        return None
    power = np.abs(np.fft.rfft(x)) ** 2 / n
    power[1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n), power


DENSITIES = {"welch": welch, "periodogram": periodogram}


def spectral(x: np.ndarray, low: float = 0.02, high: float = 1.0, points: int = 8, method: str = "welch") -> dict[str, float | None]:
    """Slope of log power over log frequency within the band, entropy and flatness over positive frequencies."""
    found = DENSITIES[method](x - x.mean()) if len(x) >= 8 else None
    out: dict[str, float | None] = {"slope": None, "entropy": None, "flatness": None}
    if found is None:
        return out
    f, p = found
    band = (f > 0) & (p > 0) & (f >= 0.5 * low) & (f <= 0.5 * high)
    if band.sum() >= points:
        out["slope"] = float(np.polyfit(np.log(f[band]), np.log(p[band]), 1)[0])
    q = p[f > 0]
    if q.sum() > 0 and len(q) > 1:
        share = np.maximum(q / q.sum(), 1e-18)
        out["entropy"] = float(-(share * np.log(share)).sum() / math.log(len(q)))
        floor = np.maximum(q, 1e-18)
        out["flatness"] = float(np.exp(np.log(floor).mean()) / floor.mean())
    return out


def lempel_ziv(x: np.ndarray) -> float | None:
    """Phrases of the series cut at its median, each the shortest not seen before, against those of a random one."""
    bits = (x > np.median(x)).astype(np.uint8).tobytes()
    n = len(bits)
    if n < 2 or len(set(bits)) < 2:
        return None
    at = phrases = 0
    while at < n:
        size = 1
        while at + size <= n and bits.find(bits[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        phrases, at = phrases + 1, at + size
    return phrases * math.log2(n) / n


def sample_entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float | None:
    """Minus the log of the share of matches of length m that go on; n-m+1 against n-m templates."""
    n = len(x)
    if n < m + 2 or (sd := x.std(ddof=1)) <= 0:
        return None

    # which values are near each other, in blocks of rows; templates match where each of their values does
    counts, bound = np.zeros(2, np.int64), share * sd
    for at in range(0, n, 512):
        near = np.abs(x[at : at + 512 + m, None] - x[None, :]) <= bound
        for i, (size, count) in enumerate(((m, n - m + 1), (m + 1, n - m))):
            rows = min(512, count - at)
            if rows > 0:
                every = near[:rows, :count].copy()
                for k in range(1, size):
                    every &= near[k : k + rows, k : k + count]
                counts[i] += np.count_nonzero(every)
    b, a = (int(counts[0]) - (n - m + 1)) // 2, (int(counts[1]) - (n - m)) // 2
    return -math.log(a / b) if a and b else None


# ---- non-linear dynamics -----------------------------------------------------------------------------------------


def mutual_information(x: np.ndarray, lag: int, bins: int = 24) -> float:
    joint, _, _ = np.histogram2d(x[:-lag], x[lag:], bins=bins)
    p = joint / joint.sum()
    px, py = p.sum(axis=1, keepdims=True), p.sum(axis=0, keepdims=True)
    on = p > 0
    return float((p[on] * np.log(p[on] / (px * py)[on])).sum())


def choose_delay(x: np.ndarray, longest: int = 50) -> tuple[int, str]:
    """First minimum of mutual information, else first zero or 1/e crossing of the autocorrelation, else one."""
    top = min(longest, len(x) // 3)
    ami = [mutual_information(x, k) for k in range(1, top + 1)]
    for i in range(1, len(ami) - 1):
        if ami[i] < ami[i - 1] and ami[i] <= ami[i + 1]:
            return i + 1, "ami"
    d = x - x.mean()
    r = np.array([(d[:-k] * d[k:]).sum() for k in range(1, top + 1)]) / max((d * d).sum(), 1e-300)
    for bound, name in ((0.0, "acf_zero"), (math.exp(-1), "acf_einv")):
        if len(hit := np.flatnonzero(r <= bound if bound == 0 else r < bound)):
            return int(hit[0]) + 1, name
    return 1, "fallback_default"


def embed(x: np.ndarray, dim: int, delay: int) -> np.ndarray:
    n = len(x) - (dim - 1) * delay
    return x[np.arange(max(n, 0))[:, None] + delay * np.arange(dim)] if n > 1 else np.empty((0, dim))


def _distances(v: np.ndarray) -> np.ndarray:
    g = v @ v.T
    s = np.diag(g)
    return np.sqrt(np.maximum(s[:, None] + s[None, :] - 2 * g, 0))


def false_neighbours(x: np.ndarray, delay: int, dims=range(2, 11), relative: float = 10.0, absolute: float = 2.0) -> dict[int, float]:
    """Share of nearest neighbours that the next coordinate drives apart, for each dimension."""
    out, sd = {}, max(x.std(), 1e-12)
    for m in dims:
        n = len(x) - m * delay
        if n < 3:
            break
        d = _distances(embed(x, m, delay)[:n])
        np.fill_diagonal(d, np.inf)
        near = d.argmin(axis=1)
        gap = np.abs(x[np.arange(n) + m * delay] - x[near + m * delay])
        out[m] = float(((gap / np.maximum(d[np.arange(n), near], 1e-12) > relative) | (gap / sd > absolute)).mean())
    return out


def choose_dimension(ratios: dict[int, float], threshold: float = 0.05, tolerance: float = 0.01, improvement: float = 0.03) -> tuple[int | None, str]:
    """First dimension at the threshold; else the first from which ratios hardly fall any more; else the best."""
    if not ratios:
        return None, "failed"
    dims, r = list(ratios), np.array(list(ratios.values()))
    if len(low := np.flatnonzero(r <= threshold)):
        return dims[low[0]], "strict_threshold"
    for i in range(1, len(r) - 1):
        if np.all(np.abs(np.diff(r[i:])) <= tolerance) and r[i] - r[i:].min() <= improvement:
            return dims[i], "stable_plateau"
    return dims[int(r.argmin())], "best_available"


def correlation_dimension(v: np.ndarray, radii: int = 24, window: int = 6, fit: float = 0.9) -> float | None:
    """Slope of the log correlation sum over the log radius, in the best-fitting run of radii. The sum is over all pairs of states."""
    d = _distances(v)[np.tri(len(v), k=-1, dtype=bool).T]
    d = np.sort(d[d > 0])
    if len(d) < 50:
        return None
    low, high = np.quantile(d, [0.05, 0.8])
    if not 0 < low < high:
        return None
    r = np.logspace(np.log10(low), np.log10(high), radii)
    c = np.searchsorted(d, r) / len(d)
    lr, lc = np.log(r), np.log(np.maximum(c, 1e-300))
    best = (-1.0, None)
    for i in range(radii - window + 1):
        x, y = lr[i : i + window], lc[i : i + window]
        slope, inter = np.polyfit(x, y, 1)
        spread = ((y - y.mean()) ** 2).sum()
        r2 = 1 - ((y - slope * x - inter) ** 2).sum() / spread if spread > 0 else 0.0
        best = max(best, (r2, float(slope)), key=lambda t: t[0])
    return best[1] if best[0] >= fit else None


def largest_lyapunov(v: np.ndarray, theiler: int = 10, neighbours: int = 50, length: int = 20, fit: tuple[int, int] = (1, 10), pairs: int = 20, points: int = 5) -> float | None:
    """Mean rate at which near states part: slope of the mean log distance over the first steps."""
    n = len(v) - length
    if n < theiler + 3:
        return None
    d = _distances(v[:n])
    order = np.argsort(d, axis=1, kind="stable")[:, 1 : neighbours + 1]
    at = np.arange(n)
    ok = (np.abs(order - at[:, None]) > theiler) & (np.take_along_axis(d, order, axis=1) > 0)
    has = ok.any(axis=1)
    i, j = at[has], order[at[has], ok[has].argmax(axis=1)]
    ks, means = [], []
    for k in range(length):
        gap = np.sqrt(((v[i + k] - v[j + k]) ** 2).sum(axis=1))
        gap = gap[gap > 0]
        if len(gap) >= pairs:
            ks.append(k)
            means.append(np.log(gap).mean())
    ks, means = np.array(ks), np.array(means)
    use = (ks >= fit[0]) & (ks <= fit[1]) if len(ks) else np.zeros(0, bool)
    return float(np.polyfit(ks[use], means[use], 1)[0]) if use.sum() >= points else None


def chaos(x: np.ndarray, least: int = 300) -> dict[str, float | int | str | None]:
    out: dict[str, float | int | str | None] = {"delay": None, "delay_method": "too_short", "dimension": None, "dimension_method": "too_short", "correlation_dimension": None, "lyapunov": None}
    if len(x) < least or x.std() <= 0:
        return out
    out["delay"], out["delay_method"] = choose_delay(x)
    out["dimension"], out["dimension_method"] = choose_dimension(false_neighbours(x, out["delay"]))
    if out["dimension"]:
        v = embed(x, out["dimension"], out["delay"])
        out["correlation_dimension"], out["lyapunov"] = correlation_dimension(v), largest_lyapunov(v)
    return out


# ---- clustering --------------------------------------------------------------------------------------------------

#: Rows of a matrix that are worked on at a time.
ROWS = 4096


def principal(x: np.ndarray, k: int) -> np.ndarray:
    """Scores on the first k principal axes of the centred matrix."""
    c = x - x.mean(axis=0)
    return c @ axes(c, k).T


def axes(c: np.ndarray, k: int) -> np.ndarray:
    """The first k principal axes of centred rows, from their triangular factor, which a block of rows at a time goes into."""
    factor = np.zeros((0, c.shape[1]))
    for at in range(0, len(c), ROWS):
        factor = np.linalg.qr(np.vstack([factor, c[at : at + ROWS]]), mode="r")
    return np.linalg.svd(factor, full_matrices=False)[2][:k]


def robust(x: np.ndarray) -> np.ndarray:
    """(value - median) / quartile range of each column; a range of zero divides by one."""
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    return (x - mid) / np.where(high > low, high - low, 1.0)


def normal_scores(x: np.ndarray) -> np.ndarray:
    """Each column's values as normal quantiles of their mean ranks."""
    out, probit = np.empty(x.shape), NormalDist().inv_cdf
    scores = np.array([probit((half / 2 - 0.5) / len(x)) for half in range(2, 2 * len(x) + 1)])  # of every mean rank there may be
    for c in range(x.shape[1]):
        _, at, times = np.unique(x[:, c], return_inverse=True, return_counts=True)
        rank = np.cumsum(times) - (times - 1) / 2
        out[:, c] = scores[(2 * rank - 2).astype(int)[at]]
    return out


SCALERS = {"identity": lambda x: x, "robust": robust, "quantile": normal_scores}


#: Ward holds the squared distances of at most so many rows (100 MB a task at 2,048, 1 GB at 8,192); of more it holds the rows alone.
WARD_HELD = 2048


def _held_merges(x: np.ndarray, size: np.ndarray) -> list[tuple[float, int, int]]:
    """Ward's merges (cost, i, j) by chains of nearest neighbours over the squared distances of all rows."""
    n, square = len(x), (x * x).sum(axis=1)
    d = np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0)
    if (size != 1).any():
        d *= 2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :])
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        j = int(d[i].argmin())
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        del chain[-2:]
        merges.append((d[i, j], i, j))
        rest = alive.copy()
        rest[[i, j]] = False
        s = size[rest]
        new = ((size[i] + s) * d[i, rest] + (size[j] + s) * d[j, rest] - s * d[i, j]) / (size[i] + size[j] + s)
        d[i, rest] = d[rest, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
    return merges


#: Rows of a leaf of near ones, leaves that are compared with another one at a time, and nearest ones that a row keeps.
LEAF, LEAVES, KEPT = 256, 4, 6


def _leaves(x: np.ndarray) -> np.ndarray:
    """The rows' numbers in an order in which every LEAF consecutive ones are near each other: halves at the median of the widest column."""
    order, parts = np.arange(len(x)), [(0, len(x))]
    while parts:
        a, b = parts.pop()
        if b - a > LEAF:
            own = x[order[a:b]]
            half = ((b - a - 1) // LEAF + 1) // 2 * LEAF
            order[a:b] = order[a:b][np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)]
            parts += [(a, a + half), (a + half, b)]
    return order


def _cheapest(x: np.ndarray, size: np.ndarray, asked: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The asked rows, the KEPT to each whose unions with it cost least, the costs, and what a union with any other costs at least.

    Leaf by leaf, the nearest leaves first, until the others are too far. In single precision what others cost is lowered by all that it may be wrong.
    """
    order, kept = _leaves(x), min(KEPT, len(x) - 1)
    y, thin, starts = x[order], 1 / size[order], np.arange(0, len(x), LEAF)
    square = (y * y).sum(axis=1)
    low, high, least = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts), np.maximum.reduceat(thin, starts)
    kind = np.float32 if single else float
    left, right, light = np.column_stack([y, square, np.ones(len(y))]).astype(kind), np.column_stack([-2 * y, np.ones(len(y)), square]).astype(kind), thin.astype(kind)
    place = np.empty(len(x), int)
    place[order] = np.arange(len(x))
    asked, near, cost = np.sort(place[asked]), [], []
    room = np.empty((2, LEAF * LEAF * LEAVES), kind)  # large arrays are slow to get anew
    for at in range(0, len(asked), LEAF):
        own = asked[at : at + LEAF]
        gap = np.maximum(np.maximum(low - y[own].max(axis=0), y[own].min(axis=0) - high), 0)
        bound = (gap * gap).sum(axis=1) / (thin[own].max() + least) * (1 - 1e-9)
        visit = np.argsort(bound, kind="stable")
        best, who, row = np.full((len(own), kept), np.inf, kind), np.zeros((len(own), kept), int), np.arange(len(own))
        for first in range(0, len(visit), LEAVES):
            some = visit[first : first + LEAVES]
            some = np.sort(some[bound[some] <= best[:, -1].max()])
            if not len(some):
                break
            cols = (some[:, None] * LEAF + np.arange(LEAF)).ravel()
            cols = cols[: np.searchsorted(cols, len(y))]
            d, weight = (r[: len(own) * len(cols)].reshape(len(own), len(cols)) for r in room)
            np.matmul(left[own], right[cols].T, out=d)
            np.divide(d, np.add(light[own][:, None], light[cols][None, :], out=weight), out=d)
            at_own = np.searchsorted(cols, own)
            here = cols[np.minimum(at_own, len(cols) - 1)] == own
            d[row[here], at_own[here]] = np.inf
            if first == 0 and len(cols) > kept:
                which = np.argpartition(d, kept - 1, axis=1)[:, :kept]
                best, who = np.take_along_axis(d, which, axis=1), cols[which]
                i, price, found = np.zeros(0, int), np.zeros(0, kind), np.zeros(0, int)
            else:
                flat = np.flatnonzero(d < best[:, -1:])
                if not len(flat):
                    continue
                i, j = np.divmod(flat, len(cols))
                price, found = d.ravel()[flat], cols[j]
            i, price, found = np.concatenate([np.repeat(row, kept), i]), np.concatenate([best.ravel(), price]), np.concatenate([who.ravel(), found])
            sort = np.lexsort((price, i))
            first_of = np.searchsorted(i[sort], row)
            take = sort[first_of[:, None] + np.arange(kept)]
            best, who = price[take], found[take]
        near.append(who)
        cost.append(np.maximum(2 * best.astype(float), 0))
    near, cost = np.concatenate(near), np.concatenate(cost)
    rest = cost[:, -1].copy()
    if single:
        rest -= 2 * (x.shape[1] + 4) * 2.0**-23 * 4 * square.max() / (thin[asked] + thin.min())
        for at in range(0, len(asked), ROWS):
            own, them = asked[at : at + ROWS], near[at : at + ROWS]
            for k in range(kept):
                gap = y[own] - y[them[:, k]]
                cost[at : at + ROWS, k] = (gap * gap).sum(axis=1) * 2 / (thin[own] + thin[them[:, k]])
    return order[asked], order[near], cost, rest


def _sought_merges(x: np.ndarray, size: np.ndarray) -> list[tuple[float, int, int]]:
    """The same merges from centres and sizes, in memory that grows like the rows.

    All pairs that are each other's nearest are merged at once, which no other merge would change. A union is no nearer to a third than its
    nearer part, so a row that is not merged finds its nearest among the ones it keeps and their unions, unless those get farther than
    the last of them was; only then, and for unions, it is sought among all. When few enough are left, their distances are held.
    """
    c, name, merges, kept = x - x.mean(axis=0), np.arange(len(x)), [], min(KEPT, len(x) - 1)
    near, cost, bound = np.zeros((len(x), kept), int), np.full((len(x), kept), np.inf), np.full(len(x), -np.inf)
    while len(c) > max(WARD_HELD // 2, KEPT):
        every = np.arange(len(c))
        asked = np.flatnonzero(~(cost.min(axis=1) <= bound))
        for single in (True, False) if c.shape[1] > 8 else (False,):  # of few columns, near ones are nearer than single precision can tell
            if len(asked):
                asked, found, price, rest = _cheapest(c, size, asked, single)
                near[asked], cost[asked], bound[asked] = found, price, rest
                asked = asked[cost[asked].min(axis=1) > bound[asked]]
        first = cost.argmin(axis=1)
        to, price = near[every, first], cost[every, first]
        i = np.flatnonzero((to[to] == every) & (every < to))
        if not len(i):  # only where rounding makes ties go in a circle
            i = np.array([price.argmin()])
        j = to[i]
        merges += zip(np.minimum(price[i], price[j]).tolist(), name[i].tolist(), name[j].tolist(), strict=True)
        total = size[i] + size[j]
        c[i] += (c[j] - c[i]) * (size[j] / total)[:, None]
        size[i] = total
        new, stay, into = np.zeros(len(c), bool), np.ones(len(c), bool), every.copy()
        new[i] = new[j] = True
        stay[j], into[j] = False, i
        near = into[near]
        for at in range(0, len(c), ROWS):
            a, b = np.nonzero(new[near[at : at + ROWS]])
            b = near[at + a, b], b
            gap = c[at + a] - c[b[0]]
            cost[at + a, b[1]] = (gap * gap).sum(axis=1) * 2 / (1 / size[at + a] + 1 / size[b[0]])
        bound[i] = -np.inf
        place = np.cumsum(stay) - 1
        c, size, name, cost, bound, near = c[stay], size[stay], name[stay], cost[stay], bound[stay], place[near[stay]]
    return merges + [(far, int(name[i]), int(name[j])) for far, i, j in _held_merges(c, size)]


def ward_merges(x: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """All merges (cost, i, j) of Ward's method in the order of their costs; of more than WARD_HELD rows, equal ones are merged first."""
    size = np.ones(len(x)) if sizes is None else np.asarray(sizes, float).copy()
    if len(x) <= WARD_HELD:
        return sorted(_held_merges(x, size))
    _, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)  # distinct rows stay in their order, so that chains begin, and clusters are numbered, as where distances are held
    first, which = first[order], np.argsort(order)[which.ravel()]
    copies = np.setdiff1d(np.arange(len(x)), first)
    merges = [(0.0, int(i), int(j)) for i, j in zip(first[which[copies]], copies, strict=True)]
    seek = _held_merges if len(first) <= WARD_HELD else _sought_merges
    return sorted(merges + [(far, int(first[i]), int(first[j])) for far, i, j in seek(x[first], np.bincount(which, size))])


def cut(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of k clusters of n rows from the merges of the least costs, numbered by the smallest of their rows."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for _, i, j in merges[: n - min(k, n)]:
        if (a := root(i)) != (b := root(j)):
            parent[max(a, b)] = min(a, b)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def ward(x: np.ndarray, k: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of k clusters by merging the two whose union costs least variance. sizes: how many points each row stands for.

    Follows chains of nearest neighbours, so it takes time in the square of the rows.
    """
    return cut(ward_merges(x, sizes), len(x), k)


def _scatter(x: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Weighted products of the rows' differences from the mean, summed."""
    out, root = np.zeros((x.shape[1], x.shape[1])), np.sqrt(weight)
    for at in range(0, len(x), ROWS):
        part = (x[at : at + ROWS] - mean) * root[at : at + ROWS, None]
        out += part.T @ part
    return out


@dataclass
class Mixture:
    """Log weights, means and lower triangular factors of the covariances of Gaussian components."""

    log_weights: np.ndarray
    means: np.ndarray
    factors: np.ndarray

    def chances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's probability of each component, and its log density."""
        m, log = x.shape[1], np.empty((len(x), len(self.means)))
        for c, (mean, low) in enumerate(zip(self.means, self.factors, strict=True)):
            inverse = np.linalg.inv(low).T
            for at in range(0, len(x), ROWS):
                z = (x[at : at + ROWS] - mean) @ inverse
                log[at : at + ROWS, c] = self.log_weights[c] - 0.5 * (m * math.log(2 * math.pi) + (z * z).sum(axis=1)) - np.log(np.diag(low)).sum()
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        return np.exp(log - total[:, None]), total


def said_by(chances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, largest probabilities and entropies."""
    return chances.argmax(axis=1), chances.max(axis=1), -(chances * np.log(np.maximum(chances, 1e-300))).sum(axis=1)


#: Matrices of at most so many columns are fitted by the products of their columns, all components at once.
FEW_COLUMNS = 8
#: Rows of a step of a fit, which fit a core's cache; and the largest square of a value, from the mean, up to which sums of products lose no digit that counts.
STEP, LARGEST = 512, 1e4


class _Products:
    """One pass of a fit over centred rows of few columns: log densities are linear in the products of a row's columns, and so are the sums that a fit needs."""

    def __init__(self, x: np.ndarray) -> None:
        self.m = x.shape[1]
        self.i, self.j = np.triu_indices(self.m)
        self.rows = np.column_stack([np.ones(len(x)), x, x[:, self.i] * x[:, self.j]])

    def given(self, resp: np.ndarray) -> np.ndarray:
        return resp.T @ self.rows

    def split(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, sums and summed products of each component."""
        square = np.empty((len(sums), self.m, self.m))
        square[:, self.i, self.j] = square[:, self.j, self.i] = sums[:, 1 + self.m :]
        return sums[:, 0], sums[:, 1 : 1 + self.m], square

    def step(self, mixture: Mixture) -> tuple[np.ndarray, float]:
        """The sums under the rows' probabilities, and the mean log density."""
        m, k = self.m, len(mixture.means)
        theta = np.empty((self.rows.shape[1], k))
        for c, (mean, low) in enumerate(zip(mixture.means, mixture.factors, strict=True)):
            inverse = np.linalg.inv(low)
            precision = inverse.T @ inverse
            theta[0, c] = mixture.log_weights[c] - 0.5 * (m * math.log(2 * math.pi) + mean @ precision @ mean) - np.log(np.diag(low)).sum()
            theta[1 : 1 + m, c] = precision @ mean
            theta[1 + m :, c] = -np.where(self.i == self.j, 0.5, 1.0) * precision[self.i, self.j]
        sums, total = np.zeros((k, self.rows.shape[1])), 0.0
        for at in range(0, len(self.rows), ROWS):
            rows = self.rows[at : at + ROWS]
            resp, log = _normed(rows @ theta)
            sums += resp.T @ rows
            total += log.sum()
        return sums, total / len(self.rows)


class _Rows:
    """The same pass over centred rows of many columns."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.m = x, x.shape[1]

    def _sums(self, x: np.ndarray, resp: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        sums[0][:] += resp.sum(axis=0)
        sums[1][:] += resp.T @ x
        root = np.sqrt(resp)
        for c in range(resp.shape[1]):
            part = x * root[:, c, None]
            sums[2][c] += part.T @ part

    def _none(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(k), np.zeros((k, self.m)), np.zeros((k, self.m, self.m))

    def given(self, resp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums = self._none(resp.shape[1])
        for at in range(0, len(self.x), STEP):
            self._sums(self.x[at : at + STEP], resp[at : at + STEP], sums)
        return sums

    def split(self, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return sums

    def step(self, mixture: Mixture) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
        m, k = self.m, len(mixture.means)
        inverse = [np.linalg.inv(low).T for low in mixture.factors]
        shift = np.concatenate([mean @ i for mean, i in zip(mixture.means, inverse, strict=True)])
        every = np.concatenate(inverse, axis=1)
        base = mixture.log_weights - 0.5 * m * math.log(2 * math.pi) - np.array([np.log(np.diag(low)).sum() for low in mixture.factors])
        sums, total = self._none(k), 0.0
        for at in range(0, len(self.x), STEP):
            x = self.x[at : at + STEP]
            z = x @ every
            z -= shift
            z = z.reshape(len(x), k, m)
            resp, log = _normed(base - 0.5 * np.einsum("rkm,rkm->rk", z, z))
            self._sums(x, resp, sums)
            total += log.sum()
        return sums, total / len(self.x)


class _Apart:
    """The same pass over rows whose values are too far from their mean for sums of products: products are of differences from a component's mean."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x

    def given(self, resp: np.ndarray) -> np.ndarray:
        return resp

    def split(self, resp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight, total = resp.sum(axis=0), resp.T @ self.x
        mean = total / np.maximum(weight, 1e-300)[:, None]
        return weight, total, np.stack([_scatter(self.x, resp[:, c], mean[c]) for c in range(resp.shape[1])])

    def step(self, mixture: Mixture) -> tuple[np.ndarray, float]:
        resp, total = mixture.chances(self.x)
        return resp, total.mean()


def _normed(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the columns from their logs, and the logs of the sums."""
    top = log.max(axis=1, keepdims=True)
    chances = np.exp(log - top)
    total = chances.sum(axis=1, keepdims=True)
    chances /= total
    return chances, top[:, 0] + np.log(total[:, 0])


def fit_mixture(x: np.ndarray, k: int, starts: int = 5, rounds: int = 100, seed: int = 42, ridge: float = 1e-6) -> tuple[Mixture, np.ndarray]:
    """The best of several full-covariance fits, and the rows' probabilities under it."""
    rng, best = np.random.default_rng(seed), (-np.inf, None)
    n, m = x.shape
    k = min(k, n)
    middle = x.mean(axis=0)
    c = x - middle
    apart = not (c * c).max() <= LARGEST
    data = _Apart(c) if apart else _Products(c) if m <= FEW_COLUMNS else _Rows(c)
    for _ in range(starts):
        centre = x[rng.choice(n, k, replace=False)]
        sums = data.given(np.eye(k)[np.column_stack([((x - one) ** 2).sum(axis=1) for one in centre]).argmin(axis=1)])
        before = -np.inf
        for _ in range(rounds):
            weight, total, square = data.split(sums)
            weight = weight + 1e-9
            mean = total / weight[:, None]
            spread = square / weight[:, None, None] - (0 if apart else mean[:, :, None] * mean[:, None, :])
            found = Mixture(np.log(weight / n), mean, np.linalg.cholesky(spread + ridge * np.eye(m)))
            sums, log = data.step(found)
            if abs(log - before) < 1e-4:
                break
            before = log
        if log > best[0]:
            best = (log, found)
    found = best[1]
    found = Mixture(found.log_weights, found.means + middle, found.factors)
    return found, found.chances(x)[0]


def gaussian_mixture(x: np.ndarray, k: int, starts: int = 5, rounds: int = 100, seed: int = 42, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, largest probabilities and entropies of the best of several full-covariance fits."""
    return said_by(fit_mixture(x, k, starts, rounds, seed, ridge)[1])


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    cells = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(cells, (a, b), 1)
    two = lambda v: (v * (v - 1) / 2).sum()
    rows, cols, all_ = two(cells.sum(axis=1)), two(cells.sum(axis=0)), two(np.array([len(a)]))
    expected = rows * cols / all_ if all_ else 0.0
    top = (rows + cols) / 2
    return float((two(cells) - expected) / (top - expected)) if top != expected else 1.0


def normalised_information(a: np.ndarray, b: np.ndarray) -> float:
    """Mutual information of two labellings over the mean of their entropies; one where both are constant."""
    cells = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(cells, (a, b), 1)
    p = cells / cells.sum()
    entropy = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
    rows, cols, both = entropy(p.sum(axis=1)), entropy(p.sum(axis=0)), entropy(p.ravel())
    return float(2 * (rows + cols - both) / (rows + cols)) if rows + cols > 0 else 1.0


def digamma(x: float) -> float:
    """Derivative of the logarithm of the gamma function, for positive numbers: recurrence up to six, then the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
