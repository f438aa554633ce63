"""Numeric solvers on arrays of one task: motions, alignment, consensus, assignment."""

from __future__ import annotations

import itertools

import numpy as np


def hat(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def so3_exp(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w)
    k = hat(w)
    if a < 1e-9:
        return np.eye(3) + k + k @ k / 2
    return np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * k @ k


def so3_log(r: np.ndarray) -> np.ndarray:
    c = np.clip((np.trace(r) - 1) / 2, -1, 1)
    a = np.arccos(c)
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    if a < 1e-9:
        return v / 2
    if np.pi - a < 1e-6:  # near half a turn the axis is the largest column of (R + I) / 2
        s = (r + np.eye(3)) / 2
        axis = s[:, np.argmax(np.diag(s))]
        axis = axis / np.linalg.norm(axis)
        return a * axis * (1 if v @ axis >= 0 else -1)
    return a / (2 * np.sin(a)) * v


def _left(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w)
    k = hat(w)
    if a < 1e-6:
        return np.eye(3) + k / 2 + k @ k / 6
    return np.eye(3) + (1 - np.cos(a)) / a**2 * k + (a - np.sin(a)) / a**3 * k @ k


def se3_exp(x: np.ndarray) -> np.ndarray:
    """4 x 4 motion of a twist (translation part, rotation part)."""
    out = np.eye(4)
    out[:3, :3] = so3_exp(x[3:])
    out[:3, 3] = _left(x[3:]) @ x[:3]
    return out


def se3_log(m: np.ndarray) -> np.ndarray:
    w = so3_log(m[:3, :3])
    return np.concatenate([np.linalg.solve(_left(w), m[:3, 3]), w])


def inverse(m: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = m[:3, :3].T
    out[:3, 3] = -m[:3, :3].T @ m[:3, 3]
    return out


def moved(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p @ m[:3, :3].T + m[:3, 3]


def to_matrix(row: np.ndarray | list[float]) -> np.ndarray:
    return np.vstack([np.asarray(row, dtype=float).reshape(3, 4), [0, 0, 0, 1]])


def to_row(m: np.ndarray) -> list[float]:
    return m[:3].reshape(-1).tolist()


def rigid_alignment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The motion that brings points a onto b with least squares; a rotation, never a reflection."""
    ca, cb = a.mean(axis=0), b.mean(axis=0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    fix = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    out = np.eye(4)
    out[:3, :3] = vt.T @ fix @ u.T
    out[:3, 3] = cb - out[:3, :3] @ ca
    return out


def normal_equations(source: np.ndarray, target: np.ndarray, th: float | None, label_weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of J'wJ and J'wr; the label weight acts on the right side only."""
    r = source - target
    w = np.ones(len(r)) if th is None else th * th / (th + (r * r).sum(axis=1)) ** 2
    j = np.zeros((len(r), 3, 6))
    j[:, :, :3] = np.eye(3)
    j[:, 0, 4], j[:, 0, 5] = source[:, 2], -source[:, 1]
    j[:, 1, 3], j[:, 1, 5] = -source[:, 2], source[:, 0]
    j[:, 2, 3], j[:, 2, 4] = source[:, 1], -source[:, 0]
    left = np.einsum("nki,n,nkj->ij", j, w, j)
    right = np.einsum("nki,n,nk->i", j, w * (1 if label_weight is None else label_weight), r)
    return left, right


def solve_step(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(left, -right, rcond=None)[0]


#: The 27 cells around a cell, in order of x, y, z offset.
AROUND = np.array([(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)], dtype=np.int64)


def _cell_number(cells: np.ndarray) -> np.ndarray:
    """One number a cell, for coordinates of up to 20 bits and a sign."""
    return (cells[:, 0] << 42) + (cells[:, 1] << 21) + cells[:, 2]


class CellMap:
    """Points in voxels of a bounded number, with nearest search over the 27 cells around."""

    def __init__(self, size: float, cap: int) -> None:
        self.size, self.cap = size, cap
        self.cells: dict[tuple[int, int, int], list[np.ndarray]] = {}
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def key(self, p: np.ndarray) -> tuple[int, int, int]:
        return tuple(np.trunc(p / self.size).astype(int).tolist())

    def add(self, points: np.ndarray) -> None:
        self._table = None
        for p, k in zip(points, np.trunc(points / self.size).astype(int).tolist()):
            held = self.cells.setdefault(tuple(k), [])
            if len(held) < self.cap:
                held.append(p)

    def drop_far(self, origin: np.ndarray, most: float) -> None:
        self._table = None
        self.cells = {k: v for k, v in self.cells.items() if ((v[0] - origin) ** 2).sum() <= most * most}

    def points(self) -> np.ndarray:
        return np.array([p for v in self.cells.values() for p in v]).reshape(-1, 3)

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell numbers in order, where each cell's points start, and the points."""
        if self._table is None:
            cells = np.array(list(self.cells), dtype=np.int64).reshape(-1, 3)
            numbers = _cell_number(cells)
            order = np.argsort(numbers, kind="stable")
            lists = list(self.cells.values())
            held = [lists[k] for k in order.tolist()]
            starts = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int64)
            self._table = numbers[order], starts, np.array([p for x in held for p in x]).reshape(-1, 3)
        return self._table

    def nearest(self, points: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the points with a neighbour closer than ``within``, and those neighbours."""
        numbers, starts, held = self._sorted()
        if not len(numbers) or not len(points):
            return np.empty(0, dtype=int), np.empty((0, 3))
        around = _cell_number((np.trunc(points / self.size).astype(np.int64)[:, None] + AROUND).reshape(-1, 3))
        at = np.minimum(np.searchsorted(numbers, around), len(numbers) - 1)
        count = np.where(numbers[at] == around, starts[at + 1] - starts[at], 0)
        each = count.reshape(-1, len(AROUND)).sum(axis=1)
        some = np.flatnonzero(each)
        if not len(some):
            return np.empty(0, dtype=int), np.empty((0, 3))
        total = int(count.sum())
        which = np.arange(total) + np.repeat(starts[at] - (np.cumsum(count) - count), count)
        d = ((held[which] - points[np.repeat(np.arange(len(points)), each)]) ** 2).sum(axis=1)
        begin = np.cumsum(each[some]) - each[some]
        least = np.minimum.reduceat(d, begin)
        hit = np.flatnonzero(d == np.repeat(least, each[some]))
        first = hit[np.searchsorted(hit, begin)]  # the first of equals, in order of cells
        close = least < within * within
        return some[close], held[which[first[close]]]


def icp(source: np.ndarray, cells: CellMap, guess: np.ndarray, within: float, th: float | None, weights: np.ndarray | None = None, most: int = 500, least_step: float = 1e-4) -> np.ndarray:
    """Register points to a map from a guess: nearest pairs, one robust step, again until the step is small."""
    pose = guess.copy()
    points = moved(guess, source)
    for _ in range(most):
        at, target = cells.nearest(points, within)
        if len(at) < 3:
            break
        step = solve_step(*normal_equations(points[at], target, th, None if weights is None else weights[at]))
        motion = se3_exp(step)
        points, pose = moved(motion, points), motion @ pose
        if np.linalg.norm(step) < least_step:
            break
    return pose


def planes(points: np.ndarray, size: float = 1.0, least: int = 8, flat: float = 0.005) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, centres, normals) of voxels whose points lie on a plane."""
    if not len(points):
        return np.empty((0, 3), dtype=int), np.empty((0, 3)), np.empty((0, 3))
    keys, inverse_at = np.unique(np.trunc(points / size).astype(int), axis=0, return_inverse=True)
    inverse_at = inverse_at.reshape(-1)
    out = []
    for k in np.flatnonzero(np.bincount(inverse_at) >= least):
        p = points[inverse_at == k]
        c = p.mean(axis=0)
        values, vectors = np.linalg.eigh(p.T @ p / len(p) - np.outer(c, c))
        if values[0] <= flat:
            out.append((keys[k], c, vectors[:, 0]))
    if not out:
        return np.empty((0, 3), dtype=int), np.empty((0, 3)), np.empty((0, 3))
    return tuple(np.array(x) for x in zip(*out))


def plane_pairs(c1, n1, c2, n2, size: float = 1.0, parallel: float = 0.2, off: float = 0.5, d2: float = 3.0) -> np.ndarray:
    """Pairs (i, j): plane j is the nearest in the 27 cells around centre i, about parallel and close."""
    cells: dict[tuple, list[int]] = {}
    for j, k in enumerate(np.trunc(c2 / size).astype(int).tolist()):
        cells.setdefault(tuple(k), []).append(j)
    out = []
    for i, k in enumerate(np.trunc(c1 / size).astype(int).tolist()):
        near = [j for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) for j in cells.get((k[0] + x, k[1] + y, k[2] + z), ())]
        if not near:
            continue
        j = min(near, key=lambda j: (((c2[j] - c1[i]) ** 2).sum(), j))
        turn = min(np.linalg.norm(n1[i] - n2[j]), np.linalg.norm(n1[i] + n2[j]))
        if turn < parallel and abs(n2[j] @ (c1[i] - c2[j])) < off and ((c1[i] - c2[j]) ** 2).sum() < d2:
            out.append((i, j))
    return np.array(out, dtype=int).reshape(-1, 2)


def plane_icp(source: np.ndarray, target: np.ndarray, guess: np.ndarray, size: float = 1.0, most: int = 100) -> np.ndarray:
    """Point-to-plane least squares over pairs that are fixed at the guess."""
    _, c1, n1 = planes(source, size)
    _, c2, n2 = planes(target, size)
    if not len(c1) or not len(c2):
        return guess
    at = plane_pairs(moved(guess, c1), n1 @ guess[:3, :3].T, c2, n2, size)
    if len(at) < 6:
        return guess
    p, q, n = c1[at[:, 0]], c2[at[:, 1]], n2[at[:, 1]]
    pose = guess.copy()
    for _ in range(most):
        x = moved(pose, p)
        r = ((x - q) * n).sum(axis=1)
        j = np.concatenate([n, np.cross(x, n)], axis=1)
        step = np.linalg.lstsq(j.T @ j + 1e-9 * np.eye(6), -j.T @ r, rcond=None)[0]
        pose = se3_exp(step) @ pose
        if np.linalg.norm(step) < 1e-8:
            break
    return pose


class _Cells:
    """First point of each cell, looked up in the fixed order of the 27 cells around."""

    def __init__(self, points: np.ndarray, size: float) -> None:
        self.size = size
        self.cells, self.first = np.unique(np.trunc(points / size).astype(int), axis=0, return_index=True)

    def hits(self, p: np.ndarray) -> np.ndarray:
        """The point that each of p falls beside, or -1."""
        out = np.full(len(p), -1)
        step = max(1, (1 << 18) // max(len(self.cells), 1))
        for at in range(0, len(p) if len(self.cells) else 0, step):
            t = np.trunc(p[at : at + step] / self.size).astype(int)
            x, y, z = (self.cells[:, k] - t[:, k, None] for k in range(3))
            nth = np.where((np.abs(x) <= 1) & (np.abs(y) <= 1) & (np.abs(z) <= 1), 9 * x + 3 * y + z, 14)
            best = nth.argmin(axis=1)
            out[at : at + step] = np.where(nth[np.arange(len(nth)), best] < 14, self.first[best], -1)
        return out


def _alignments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """rigid_alignment of many sets of as many points; of points on a line, which leave the turn about it open, the turn that tilts least."""
    ca, cb = a.mean(axis=1), b.mean(axis=1)
    u, s, vt = np.linalg.svd((a - ca[:, None]).transpose(0, 2, 1) @ (b - cb[:, None]))
    line = s[:, 1] <= 1e-10 * s[:, 0]
    if line.any():
        # the upright's part across the line goes to the upright's part across the other
        x, y = u[line, :, 0], vt[line, 0]
        ux, uy = (np.array([0.0, 0.0, 1.0]) - d * d[:, 2:] for d in (x, y))
        u[line], _, vt[line] = np.linalg.svd(x[:, :, None] * y[:, None] + ux[:, :, None] * uy[:, None])
    v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
    sign = np.sign(np.linalg.det(v @ ut))
    fix = np.ones((len(a), 1, 3))
    fix[:, 0, 2] = np.where(sign == 0, 1.0, sign)
    out = np.tile(np.eye(4), (len(a), 1, 1))
    out[:, :3, :3] = (v * fix) @ ut
    out[:, :3, 3] = cb - (out[:, :3, :3] @ ca[:, :, None])[:, :, 0]
    return out


def _width(triples: np.ndarray) -> np.ndarray:
    """The least height of each triangle; 0 for points in a line."""
    sides = triples - np.roll(triples, 1, axis=1)
    area2 = np.linalg.norm(np.cross(sides[:, 0], sides[:, 1]), axis=1)
    longest = np.linalg.norm(sides, axis=2).max(axis=1)
    return np.divide(area2, longest, out=np.zeros(len(triples)), where=longest > 0)


def consensus(m1: np.ndarray, m2: np.ndarray, iterations: int | None, seed: int, mode: str = "direct", n1: np.ndarray | None = None, n2: np.ndarray | None = None, size: float = 0.2) -> tuple[np.ndarray, float, int]:
    """RANSAC over matched points: (motion of m1 onto m2, score, inliers), seeded, three different matches a sample.

    Without ``iterations`` every three matches are tried, as many as grow with the matches' cube.
    ``direct`` counts matches within ``size``; ``pairs`` counts points of n1
    that fall beside a cell of n2, scores exp(-mean distance) and stops early;
    ``graph`` counts likewise and scores inliers over the points of n1.
    Of motions with as many inliers, the one that more matches fit within
    ``size`` is taken, then the one that they fit best; ``pairs`` takes the first.
    Three points nearer to a line than ``size`` leave the turn about it open:
    ``pairs`` tries such samples, widest first, only where the others find nothing.
    """
    best, score, most = np.eye(4), 0.0, 0
    if len(m1) < 3:
        return best, score, most
    rng = np.random.default_rng(seed)
    cells = _Cells(n2, size) if mode != "direct" else None
    moving = m1 if mode == "direct" else n1
    total = len(moving)
    rank = (0, 0, 0.0)

    def tried(picks: np.ndarray) -> bool:
        """Whether the samples, in their order, end the search."""
        nonlocal best, score, most, rank
        step = max(1, (1 << 16) // max(total, 1))
        for at in range(0, len(picks), step):
            chosen = picks[at : at + step]
            motions = _alignments(m1[chosen], m2[chosen])
            at_all = lambda x: x @ motions[:, :3, :3].transpose(0, 2, 1) + motions[:, None, :3, 3]
            if mode != "direct":
                p = at_all(moving)
                hit = cells.hits(p.reshape(-1, 3)).reshape(len(p), -1)
                inside = hit >= 0
            if mode != "pairs":
                d = np.linalg.norm(at_all(m1) - m2, axis=2)
                fits = d < size
                counts = (fits if mode == "direct" else inside).sum(axis=1)
                fit, off = fits.sum(axis=1), np.where(fits, d, 0).sum(axis=1)
                k = np.lexsort((off, -fit, -counts))[0]
                this = (int(counts[k]), int(fit[k]), -float(off[k]))
                if this[0] and this > rank:
                    rank, best, most, score = this, motions[k], this[0], this[0] / total
                continue
            d = np.linalg.norm(p - n2[hit], axis=2)
            for motion, found, off in zip(motions, inside, d):
                n = int(np.count_nonzero(found))
                if n > most:
                    most, best = n, motion
                    score = float(np.exp(-off[found].mean()))
                if (most > 0.5 * total and most > 2) or most > 8:
                    return True
        return False

    if iterations is None:
        samples, block = itertools.combinations(range(len(m1)), 3), 1 << 12
    else:
        samples, block = (rng.choice(len(m1), 3, replace=False) for _ in range(iterations)), 64
    many, narrow = 1 if mode == "pairs" else block, []
    while drawn := list(itertools.islice(samples, many)):
        picks, many = np.array(drawn), min(2 * many, block)
        if mode != "pairs":
            tried(picks)
            continue
        width = np.minimum(_width(m1[picks]), _width(m2[picks]))
        narrow += zip(-width[width < size], picks[width < size])
        if tried(picks[width >= size]):
            return best, score, most
    if most < 3 and narrow:
        tried(np.array([pick for _, pick in sorted(narrow, key=lambda x: x[0])]))
    return best, score, most


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a one-to-one assignment of least total cost; -1 for rows left over.

    Shortest augmenting paths with potentials, one row at a time.
    """
    cost = np.asarray(cost, dtype=float)
    if cost.size == 0:
        return np.full(cost.shape[0], -1)
    if cost.shape[0] > cost.shape[1]:
        flipped = assignment(cost.T)
        out = np.full(cost.shape[0], -1)
        out[flipped] = np.arange(len(flipped))
        return out
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for row in range(n):
        slack = cost[row] - u[row] - v
        back = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        while True:
            j = int(np.where(done, np.inf, slack).argmin())
            reach = slack[j]
            done[j] = True
            i = row_of[j]
            if i < 0:
                break
            through = reach + cost[i] - u[i] - v
            better = ~done & (through < slack)
            slack[better], back[better] = through[better], j
        taken = np.flatnonzero(done & (np.arange(m) != j))
        u[row] += reach
        for k in taken:
            u[row_of[k]] += reach - slack[k]
            v[k] -= reach - slack[k]
        while j >= 0:
            k = back[j]
            row_of[j] = row_of[k] if k >= 0 else row
            j = k
    out = np.full(n, -1)
    for j, i in enumerate(row_of):
        if i >= 0:
            out[i] = j
    return out


def optimise_poses(poses: np.ndarray, factors: list[tuple[int, int, np.ndarray, float, float, float | None]], rounds: int = 20) -> np.ndarray:
    """Gauss-Newton over poses with relative factors (src, dst, motion, var_rot, var_trans, cauchy).

    src -1 is a prior.  Twists are eliminated over a banded-sparse system
    through conjugate gradients preconditioned by the chain.
    """
    x = poses.copy()
    n = len(x)
    for _ in range(rounds):
        blocks: dict[tuple[int, int], np.ndarray] = {}
        right = np.zeros((n, 6))
        for i, j, motion, var_rot, var_trans, cauchy in factors:
            predicted = x[j] if i < 0 else inverse(x[i]) @ x[j]
            e = se3_log(inverse(motion) @ predicted)
            info = np.array([1 / var_trans] * 3 + [1 / var_rot] * 3)
            w = 1.0 if cauchy is None else 1 / (1 + float(e @ (info * e)) / cauchy**2)
            info = info * w
            jj = np.eye(6)
            terms = [(j, jj)] if i < 0 else [(i, -_adjoint(inverse(predicted))), (j, jj)]
            for a, ja in terms:
                right[a] -= ja.T @ (info * e)
                for b, jb in terms:
                    blocks[a, b] = blocks.get((a, b), 0) + ja.T @ (info[:, None] * jb)
        step = _conjugate(blocks, right)
        for k in range(n):
            x[k] = x[k] @ se3_exp(step[k])
        if np.abs(step).max() < 1e-9:
            break
    return x


def _adjoint(m: np.ndarray) -> np.ndarray:
    out = np.zeros((6, 6))
    out[:3, :3] = out[3:, 3:] = m[:3, :3]
    out[:3, 3:] = hat(m[:3, 3]) @ m[:3, :3]
    return out


def _chain(blocks: dict[tuple[int, int], np.ndarray], n: int):
    """Solves the part of the system that links each pose with the next, exactly, in one pass forth and back."""
    none = np.zeros((6, 6))
    inverses, lower, upper = np.empty((n, 6, 6)), np.zeros((n, 6, 6)), np.zeros((n, 6, 6))
    for k in range(n):
        own = blocks.get((k, k), np.eye(6)) + 1e-12 * np.eye(6)
        if k:
            lower[k] = blocks.get((k, k - 1), none) @ inverses[k - 1]
            own = own - lower[k] @ upper[k - 1]
        inverses[k] = np.linalg.inv(own)
        upper[k] = blocks.get((k, k + 1), none)

    def solve(r: np.ndarray) -> np.ndarray:
        out = r.copy()
        for k in range(1, n):
            out[k] -= lower[k] @ out[k - 1]
        out[n - 1] = inverses[n - 1] @ out[n - 1]
        for k in range(n - 2, -1, -1):
            out[k] = inverses[k] @ (out[k] - upper[k] @ out[k + 1])
        return out

    return solve


def _conjugate(blocks: dict[tuple[int, int], np.ndarray], right: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Conjugate gradients preconditioned by the chain of poses: a few steps for each loop."""
    n = len(right)
    rows = np.array([k[0] for k in blocks])
    cols = np.array([k[1] for k in blocks])
    values = np.array(list(blocks.values()))
    chain = _chain(blocks, n)

    def times(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        np.add.at(out, rows, np.einsum("kij,kj->ki", values, v[cols]))
        return out

    x = np.zeros_like(right)
    r = right.copy()
    z = chain(r)
    p, rz = z.copy(), float((r * z).sum())
    start = rz
    for _ in range(12 * n + 50):
        if rz <= tol * max(start, 1e-300):
            break
        ap = times(p)
        a = rz / float((p * ap).sum())
        x, r = x + a * p, r - a * ap
        z = chain(r)
        rz, old = float((r * z).sum()), rz
        p = z + rz / old * p
    return x
