"""NumPy kernels for what the JVM can't express; called in grouped pandas functions on bounded groups."""

from __future__ import annotations

import numpy as np


def dbscan(x: np.ndarray, eps: float, min_samples: int, distances: np.ndarray | None = None) -> np.ndarray:
    """M1: DBSCAN labels, -1 noise; a neighbourhood holds the point itself, a border point joins the first cluster that reaches it."""
    n = len(x) if distances is None else len(distances)
    if n < min_samples:
        raise ValueError("fewer rows than min_samples")
    if distances is None:
        sq = (x * x).sum(1)
        near = np.empty((n, n), dtype=bool)
        for at in range(0, n, 512):
            near[at : at + 512] = np.sqrt(np.maximum(sq[at : at + 512, None] + sq - 2 * x[at : at + 512] @ x.T, 0)) <= eps
    else:
        near = distances <= eps
    core = near.sum(1) >= min_samples
    label = np.full(n, -1)
    k = 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        edge = np.zeros(n, dtype=bool)
        edge[i] = True
        while edge.any():
            label[edge & (label < 0)] = k
            edge = near[edge & core].any(0) & (label < 0)
        k += 1
    return label


def hdbscan(x: np.ndarray, min_size: int) -> np.ndarray:
    """M3: labels by excess of mass over the condensed tree of the mutual-reachability spanning tree; -1 noise."""
    n = len(x)
    if n < min_size:
        raise ValueError("fewer rows than the least cluster size")
    x = np.asarray(x, float)
    sq = (x * x).sum(1)

    def far(i: int) -> np.ndarray:
        d = sq[i] + sq - 2 * (x @ x[i])
        near = np.flatnonzero(d < 1e-4 * (sq[i] + sq))  # the product loses their digits
        d[near] = ((x[near] - x[i]) ** 2).sum(1)
        return np.sqrt(d)

    core = np.array([np.partition(far(i), min_size - 1)[min_size - 1] for i in range(n)])
    inside, best, frm = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    best[0], edges = 0, []
    for _ in range(n):
        i = int(np.argmin(np.where(inside, np.inf, best)))
        inside[i] = True
        if edges or i:
            edges.append((best[i], frm[i], i))
        reach = np.maximum(np.maximum(core[i], core), far(i))
        closer = ~inside & (reach < best)
        best[closer], frm[closer] = reach[closer], i
    # Dendrogram from the sorted edges: size, height and children of each node.
    size, height, kids = [1] * n + [0] * (n - 1), [0.0] * (2 * n - 1), [()] * (2 * n - 1)
    top = list(range(2 * n - 1))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for here, (w, a, b) in enumerate(sorted(edges), n):
        pair = find(a), find(b)
        size[here], height[here], kids[here] = size[pair[0]] + size[pair[1]], w, pair
        top[pair[0]] = top[pair[1]] = here

    # Condensed tree: (node, stability, clusters below) of each cluster, parents before their children.
    found, todo = [], [(2 * n - 2, 1 / max(height[2 * n - 2], 1e-12), -1)]
    while todo:
        here, born, parent = todo.pop()
        me, stability = len(found), 0.0
        found.append([here, 0.0, []])
        if parent >= 0:
            found[parent][2].append(me)
        while kids[here]:
            lam = 1 / max(height[here], 1e-12)
            big = [k for k in kids[here] if size[k] >= min_size]
            stability += (size[here] if len(big) == 2 else sum(size[k] for k in kids[here] if k not in big)) * (lam - born)
            if len(big) != 1:
                todo.extend((k, lam, me) for k in big)
                break
            here = big[0]
        found[me][1] = stability
    value, own = [s for _, s, _ in found], [True] * len(found)
    for me in range(len(found) - 1, -1, -1):
        below = found[me][2]
        total = sum(value[k] for k in below)
        if below and total > value[me]:
            value[me], own[me] = total, False
    chosen, todo = [], [0]
    while todo:
        me = todo.pop()
        if own[me]:
            leaves, stack = [], [found[me][0]]
            while stack:
                i = stack.pop()
                stack.extend(kids[i]) if kids[i] else leaves.append(i)
            chosen.append(leaves)
        else:
            todo.extend(found[me][2])
    label = np.full(n, -1)
    for k, c in enumerate(sorted(chosen, key=min)):
        label[c] = k
    return label


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = None) -> float:
    """M8: dynamic time warping with |x - y| (Euclidean for vectors), optional band; empty input is an error."""
    if not len(a) or not len(b):
        raise ValueError("empty sequence")
    a, b = np.asarray(a, float), np.asarray(b, float)
    cost = np.abs(a[:, None] - b[None]) if a.ndim == 1 else np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    n, m = cost.shape
    if band is not None:
        off = np.abs(np.arange(n)[:, None] * (m / n) - np.arange(m)[None]) > max(band, abs(n - m))
        cost = np.where(off, cost.sum() + 1, cost)  # dearer than any path inside the band
    row = np.cumsum(cost[0])
    for i in range(1, n):
        best = np.minimum(row, np.concatenate([[np.inf], row[:-1]]))
        along = np.cumsum(cost[i])  # a step to the right adds the costs between: a running minimum instead of a loop
        row = along + np.minimum.accumulate(best - along + cost[i])
    return float(row[-1])


def _diagonals(n: int, m: int, band: int | None) -> list[tuple[int, int]]:
    """Per diagonal i + j the first and the last i that ``dtw`` admits (first > last: none)."""
    i, k = np.arange(n), np.arange(n + m - 1)
    first, last = np.zeros(n, int), np.full(n, m - 1)
    if band is not None:
        width, at = max(band, abs(n - m)), i * (m / n)
        first, last = np.ceil(at - width).astype(int) - 1, np.floor(at + width).astype(int) + 1
        for _ in range(2):  # as ``dtw`` rounds
            first, last = first + (np.abs(at - first) > width), last - (np.abs(at - last) > width)
        first, last = np.maximum(first, 0), np.minimum(last, m - 1)
    return list(zip(np.searchsorted(i + last, k).tolist(), (np.searchsorted(i + first, k, "right") - 1).tolist(), strict=True))


def dtw_each(a: np.ndarray, b: np.ndarray, band: int | None = None, limit: float | None = None) -> np.ndarray:
    """M8: ``dtw`` of each row of a with that row of b, diagonal by diagonal over all of them; what must pass ``limit`` may be infinite."""
    (p, n), m = a.shape, b.shape[1]
    if not n or not m:
        raise ValueError("empty sequence")
    a, b, live, out = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T[::-1]), np.arange(p), np.full(p, np.inf)
    now, one, two = (np.full((n + 1, p), np.inf) for _ in range(3))  # row i + 1: of a's place i
    costs = np.empty((n, p))
    for k, (lo, hi) in enumerate(_diagonals(n, m, band)):
        now, one, two = two, now, one
        if lo > hi:
            now[:] = np.inf
            continue
        cost = np.subtract(a[lo : hi + 1], b[m - 1 - k + lo : m - k + hi], out=costs[: hi + 1 - lo])
        np.abs(cost, out=cost)
        here = now[lo + 1 : hi + 2]
        if k:
            np.minimum(one[lo + 1 : hi + 2], one[lo : hi + 1], out=here)
            np.minimum(here, two[lo : hi + 1], out=here)
            here += cost
        else:
            here[:] = cost
        now[lo] = np.inf
        now[hi + 2 : hi + 3] = np.inf
        if limit is not None and k % 8 == 7:  # each path meets one of two diagonals in a row
            open_ = np.minimum(here.min(0), one[lo : hi + 2].min(0)) <= limit
            if open_.sum() < 0.75 * len(live):
                live, a, b, now, one, two = live[open_], *(np.ascontiguousarray(x[:, open_]) for x in (a, b, now, one, two))
                costs = np.empty((n, len(live)))
                if not len(live):
                    return out
    out[live] = now[n]
    return out


def keogh(a: np.ndarray, b: np.ndarray, band: int) -> float:
    """A lower bound of the banded distance of equally long sequences, to leave the full one out."""
    lo = np.array([b[max(0, i - band) : i + band + 1].min() for i in range(len(a))])
    hi = np.array([b[max(0, i - band) : i + band + 1].max() for i in range(len(a))])
    return float((np.maximum(a - hi, 0) + np.maximum(lo - a, 0)).sum())


def change_points(x: np.ndarray, penalty: float, least: int = 2) -> list[int]:
    """Exact optimal partitioning of a series (squared error plus a penalty per segment), pruned; ends included: [0, .., n]."""
    n = len(x)
    if n < 2 * least:
        return [0, n]
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(np.square(x))])
    best, back, live = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    best[0] = -penalty
    for t in range(least, n + 1):
        ok = live[t - live >= least]
        cost = best[ok] + q[t] - q[ok] - (s[t] - s[ok]) ** 2 / (t - ok)
        k = int(np.argmin(cost))
        best[t], back[t] = cost[k] + penalty, ok[k]
        live = np.concatenate([ok[cost <= best[t]], live[t - live < least], [t]])
    out, t = [n], n
    while t:
        t = int(back[t])
        out.append(t)
    return out[::-1]


def viterbi(seq: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[list[int], float]:
    """M7: best states (ties to the lowest) and the log-probability of the path; under two symbols is an error."""
    if len(seq) < 2:
        raise ValueError("sequence of under two symbols")
    with np.errstate(divide="ignore"):
        ls, lt, le = np.log(start), np.log(trans), np.log(emit)
    v, back = ls + le[:, seq[0]], []
    for o in seq[1:]:
        all_ = v[:, None] + lt
        back.append(all_.argmax(0))
        v = all_.max(0) + le[:, o]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(v.max())


def baum_welch_counts(seq: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """M6, E-step of one sequence: expected starts, transitions, emissions, log-likelihood (scaled forward-backward)."""
    n, k = len(seq), len(start)
    alpha, scale = np.zeros((n, k)), np.zeros(n)
    a = start * emit[:, seq[0]]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ trans) * emit[:, seq[t]]
        scale[t] = a.sum() or 1e-300
        alpha[t] = a / scale[t]
    beta, xi = np.ones(k), np.zeros((k, k))
    gamma = np.zeros((n, k))
    gamma[-1] = alpha[-1]
    for t in range(n - 2, -1, -1):
        w = emit[:, seq[t + 1]] * beta / scale[t + 1]
        xi += alpha[t][:, None] * trans * w
        beta = trans @ w
        gamma[t] = alpha[t] * beta
    out = np.zeros_like(emit)
    np.add.at(out.T, seq, gamma)
    return gamma[0], xi, out, float(np.log(scale).sum())


def align_progressive(seqs: list[list[str]], gap: str = "-") -> list[list[str]]:
    """Progressive alignment: the next sequence is the nearest to those aligned, joined by its distance to the consensus."""
    if len(seqs) < 2:
        raise ValueError("alignment needs two sequences")

    def pair(columns: list[list[str]], s: list[str]) -> list[list[str]]:
        n, m, k = len(columns), len(s), len(columns[0]) if columns else 0
        cost = np.zeros((n + 1, m + 1))
        cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                miss = sum(x != s[j - 1] for x in columns[i - 1]) / k
                cost[i, j] = min(cost[i - 1, j - 1] + miss, cost[i - 1, j] + 1, cost[i, j - 1] + 1)
        out, i, j = [], n, m
        while i or j:
            if i and j and np.isclose(cost[i, j], cost[i - 1, j - 1] + sum(x != s[j - 1] for x in columns[i - 1]) / k):
                i, j = i - 1, j - 1
                out.append([*columns[i], s[j]])
            elif i and np.isclose(cost[i, j], cost[i - 1, j] + 1):
                i -= 1
                out.append([*columns[i], gap])
            else:
                j -= 1
                out.append([gap] * k + [s[j]])
        return out[::-1]

    order = sorted(range(len(seqs)), key=lambda i: (-len(seqs[i]), i))
    columns = [[x] for x in seqs[order[0]]]
    for i in order[1:]:
        columns = pair(columns, seqs[i]) if columns else [[gap, x] for x in seqs[i]]
    rows = [[c[order.index(i)] for c in columns] for i in range(len(seqs))]
    return rows


def yin(x: np.ndarray, rate: float, low: float = 50.0, threshold: float = 0.15) -> float:
    """Fundamental frequency by the cumulative mean normalised difference with parabolic refinement; 0 without one."""
    most = min(len(x) // 2, int(rate / low))
    if most < 3:
        return 0.0
    w = len(x) - most
    d = np.array([((x[:w] - x[t : t + w]) ** 2).sum() for t in range(most)])
    norm = np.ones(most)
    norm[1:] = d[1:] * np.arange(1, most) / np.maximum(np.cumsum(d[1:]), 1e-12)
    t = 2
    while t < most - 1 and not (norm[t] < threshold and norm[t] <= norm[t + 1]):
        t += 1
    if t >= most - 1:
        return 0.0
    a, b, c = norm[t - 1 : t + 2]
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return float(rate / (t + shift))


def waveform_features(x: np.ndarray, rate: float, bands: int) -> np.ndarray:
    """Level, crossing rate, centroid, spread, flatness, pitch, and log energies of equal bands up to ``bands`` in all."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros(bands)
    p = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2 + 1e-12
    f = np.fft.rfftfreq(len(x), 1 / rate)
    c = (f * p).sum() / p.sum()
    head = [np.sqrt((x * x).mean()), (np.diff(np.signbit(x)) != 0).mean(), c, np.sqrt(((f - c) ** 2 * p).sum() / p.sum()), np.exp(np.log(p).mean()) / p.mean(), yin(x, rate)]
    tail = [np.log(b.sum() + 1e-12) for b in np.array_split(p, max(1, bands - len(head)))]
    return np.array([*head, *tail])[:bands]


def segments(x: np.ndarray, rate: float, gap_ms: float, least_ms: float, level: float) -> list[tuple[int, int]]:
    """U8: (start, stop) samples of stretches whose smoothed level exceeds ``level``, joined over shorter gaps, of a least length."""
    k = max(1, int(rate * 0.005))
    loud = np.convolve(np.abs(x), np.ones(k) / k, "same") > level
    edge = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
    out: list[list[int]] = []
    for s, e in zip(edge[::2], edge[1::2], strict=True):
        if out and (s - out[-1][1]) * 1000 / rate < gap_ms:
            out[-1][1] = int(e)
        else:
            out.append([int(s), int(e)])
    return [(s, e) for s, e in out if (e - s) * 1000 / rate >= least_ms]
