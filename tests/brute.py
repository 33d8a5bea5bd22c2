"""Plain single-process versions of the vector operators, for small fixtures."""

import numpy as np


def euclid(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


def cosine(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.where(n > 0, x / np.where(n > 0, n, 1), x)
    return u @ u.T


def greedy_kept(x, t):
    sim = cosine(x)
    dropped = set()
    for i in range(len(x)):
        if i in dropped:
            continue
        for j in range(i + 1, len(x)):
            if sim[i, j] > t:
                dropped.add(j)
    return [i for i in range(len(x)) if i not in dropped]


def dbscan(d, eps, m):
    n = len(d)
    near = d <= eps
    core = near.sum(1) >= m
    label = np.full(n, -1)
    c = 0
    for i in range(n):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], c
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in np.nonzero(near[p])[0]:
                if label[q] == -1:
                    label[q] = c
                    stack.append(q)
        c += 1
    return label


def hdbscan(d, min_cluster_size, min_samples):
    """Top-down: split the component at its heaviest edge, keep parts of the minimum size."""
    n = len(d)
    core = np.sort(d, 1)[:, min_samples - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    edges, inside, best, link = [], {0}, w[0].copy(), np.zeros(n, int)
    while len(inside) < n:
        rest = [i for i in range(n) if i not in inside]
        j = min(rest, key=lambda i: (best[i], i))
        edges.append((best[j], link[j], j))
        inside.add(j)
        closer = w[j] < best
        best[closer], link[closer] = w[j][closer], j
    edges.sort()

    def split(points, births):
        """Returns (stability chosen, clusters chosen) of the cluster born at density ``births``."""
        points = set(points)
        own, total = sorted(e for e in edges if e[1] in points and e[2] in points), 0.0
        while True:
            if not own:
                return total, [], births
            weight, a, b = own.pop()
            lam = 1.0 / weight
            parts = []
            for start in (a, b):
                seen, stack = {start}, [start]
                while stack:
                    p = stack.pop()
                    for _, u, v in own:
                        q = v if u == p else u if v == p else None
                        if q is not None and q not in seen:
                            seen.add(q)
                            stack.append(q)
                parts.append(seen)
            big = [p for p in parts if len(p) >= min_cluster_size]
            if len(big) == 2:
                return total + (lam - births) * len(points), big, lam
            if not big:
                return total + (lam - births) * len(points), [], lam
            total += (lam - births) * (len(points) - len(big[0]))
            points, own = big[0], [e for e in own if e[1] in big[0]]

    def choose(members, births):
        stability, children, lam = split(members, births)
        if not children:
            return stability, [members]
        below = [choose(c, lam) for c in children]
        value = sum(b[0] for b in below)
        if value > stability:
            return value, [c for b in below for c in b[1]]
        return stability, [members]

    everything = set(range(n))
    _, children, lam = split(everything, 0.0)
    label = np.full(n, -1)
    chosen = [c for child in children for c in choose(child, lam)[1]]
    for k, members in enumerate(sorted(chosen, key=min)):
        label[list(members)] = k
    return label


def average_linkage(sim, k):
    """Labels after merging the most similar groups, ties to the least ids."""
    n = len(sim)
    groups = [[i] for i in range(n)]
    heights = []
    while len(groups) > 1:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                s = sim[np.ix_(groups[a], groups[b])].mean()
                if best is None or s > best[0] + 1e-12:
                    best = (s, a, b)
        s, a, b = best
        heights.append(s)
        if len(groups) > k:
            last = [sorted(groups[a] + groups[b]) if i == a else g
                    for i, g in enumerate(groups) if i != b]
            cut = last
        groups = [sorted(groups[a] + groups[b]) if i == a else g
                  for i, g in enumerate(groups) if i != b]
    return cut if n > k else [[i] for i in range(n)], heights


def silhouette(x, label):
    d = euclid(x)
    out = []
    for i in range(len(x)):
        mine = label == label[i]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][mine].sum() / (mine.sum() - 1)
        b = min(d[i][label == c].mean() for c in set(label) if c != label[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))
