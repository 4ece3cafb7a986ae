"""Array kernels in numpy for what has no relational form: distances, labels, fills, traces, packings.

All take and return plain arrays, are deterministic for a seed, and treat NaN as missing.
"""

from __future__ import annotations

import heapq
import math

import numpy as np


def distance_transform(mask: np.ndarray, cell: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Distance of each true cell to the nearest false one, 0 for false ones, inf where there is none.

    Exact in two passes: along columns by scans, then over column offsets until no smaller distance is possible."""
    rows, cols = mask.shape
    far = np.where(mask, np.inf, 0.0)
    for order in (range(1, rows), range(rows - 2, -1, -1)):
        step = 1 if order.step == 1 else -1
        for r in order:
            far[r] = np.minimum(far[r], far[r - step] + cell[0])
    square = far * far
    best = square.copy()
    for d in range(1, cols):
        if (d * cell[1]) ** 2 >= best.max(initial=0.0):
            break
        add = (d * cell[1]) ** 2
        np.minimum(best[:, d:], square[:, :-d] + add, out=best[:, d:])
        np.minimum(best[:, :-d], square[:, d:] + add, out=best[:, :-d])
    return np.sqrt(best)


def labels(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Connected components: 1 + the row-major index of the component's first cell, 0 outside."""
    rows, cols = mask.shape
    label = np.where(mask.ravel(), np.arange(1, mask.size + 1), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    index = np.arange(mask.size).reshape(rows, cols)
    pairs = []
    for dr, dc in steps:
        a = index[: rows - dr, max(0, -dc) : cols - max(0, dc)]
        b = index[dr:, max(0, dc) : cols - max(0, -dc)]
        both = mask.ravel()[a] & mask.ravel()[b]
        pairs.append(np.stack((a[both], b[both])))
    a, b = np.concatenate(pairs, axis=1)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb) - 1, np.minimum(la, lb))
        while True:  # follow labels to their roots
            inside = label > 0
            up = label.copy()
            up[inside] = label[label[inside] - 1]
            if (up == label).all():
                break
            label = up
    return label.reshape(rows, cols)


def shifted_extreme(mask: np.ndarray, grow: bool) -> np.ndarray:
    """3 x 3 dilation or erosion; outside counts as false when growing, true when shrinking."""
    padded = np.pad(mask, 1, constant_values=not grow)
    views = [padded[r : r + mask.shape[0], c : c + mask.shape[1]] for r in range(3) for c in range(3)]
    return np.logical_or.reduce(views) if grow else np.logical_and.reduce(views)


def closed(mask: np.ndarray, times: int) -> np.ndarray:
    wide = np.pad(mask, times)
    for _ in range(times):
        wide = shifted_extreme(wide, True)
    for _ in range(times):
        wide = shifted_extreme(wide, False)
    return wide[times : wide.shape[0] - times, times : wide.shape[1] - times] if times else wide


def denoised(mask: np.ndarray, radius: int) -> np.ndarray:
    """Closed, then without components smaller than half the square of the radius."""
    if radius <= 0 or not mask.any():
        return mask
    out = closed(mask, radius)
    label = labels(out)
    sizes = np.bincount(label.ravel(), minlength=mask.size + 1)
    return out & (sizes[label] >= max(1, (2 * radius + 1) ** 2 // 2))


def relax(h: np.ndarray, free: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Free cells become the mean of their four neighbours, edges repeated, until they settle."""
    for _ in range(rounds if free.any() else 0):
        p = np.pad(h, 1, mode="edge")
        mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4
        change = np.abs(mean[free] - h[free]).max()
        h = np.where(free, mean, h)
        if change < tolerance:
            break
    return h


def coarser(h: np.ndarray, n: int) -> np.ndarray:
    """Square raster of n x n cells: means of the cells with data whose centres fall in each."""
    at = np.minimum((np.arange(h.shape[0]) + 0.5) * n / h.shape[0], n - 1).astype(int)
    key = (at[:, None] * n + at[None, :]).ravel()
    known = ~np.isnan(h.ravel())
    count = np.bincount(key[known], minlength=n * n)
    with np.errstate(invalid="ignore"):
        return (np.bincount(key[known], h.ravel()[known], n * n) / np.where(count, count, np.nan)).reshape(n, n)


def finer(h: np.ndarray, n: int) -> np.ndarray:
    """Bilinear, with corners on corners."""
    at = np.linspace(0, h.shape[0] - 1, n)
    i = np.minimum(at.astype(int), max(0, h.shape[0] - 2))
    t, j = at - i, np.minimum(i + 1, h.shape[0] - 1)
    rows = h[i] * (1 - t)[:, None] + h[j] * t[:, None]
    return rows[:, i] * (1 - t) + rows[:, j] * t


def nearest_seed(h: np.ndarray) -> np.ndarray:
    """Missing cells take the value of the nearest cell with data; ties the first in row-major order. For small rasters."""
    known = np.argwhere(~np.isnan(h))
    out = h.copy()
    for r, c in np.argwhere(np.isnan(h)):
        k = known[np.argmin(((known - (r, c)) ** 2).sum(axis=1))]
        out[r, c] = h[k[0], k[1]]
    return out


def nearest_value(h: np.ndarray, row: int, col: int) -> float:
    """The value of the cell with data nearest to a cell, as nearest_seed gives it, from squares that grow about it; NaN where no cell has data."""
    reach, last = 0, max(h.shape)
    while True:
        r0, c0 = max(0, row - reach), max(0, col - reach)
        part = h[r0 : row + reach + 1, c0 : col + reach + 1]
        at = np.argwhere(~np.isnan(part)) + (r0, c0)
        if len(at):
            square = ((at - (row, col)) ** 2).sum(axis=1)
            k = np.argmin(square)
            if square[k] <= reach * reach:  # nothing outside is as near
                return float(h[at[k, 0], at[k, 1]])
            reach = math.isqrt(int(square[k])) + 1
        elif reach >= last:
            return math.nan
        else:
            reach = 2 * reach + 1


def filled(h: np.ndarray, rounds: int = 200, tolerance: float = 1e-4, smallest: int = 32) -> np.ndarray:
    """Gaps filled from coarse to fine; cells with data keep their values."""
    if h.shape[0] != h.shape[1]:
        raise ValueError("the raster isn't square")
    missing = np.isnan(h)
    if missing.all():
        raise ValueError("no cell has data")
    if not missing.any():
        return h.copy()
    sizes = [h.shape[0]]
    while sizes[-1] // 2 >= smallest:
        sizes.append(sizes[-1] // 2)
    out = None
    for n in reversed(sizes):
        level = h if n == h.shape[0] else coarser(h, n)
        gap = np.isnan(level)
        start = nearest_seed(level) if out is None and n <= 4 * smallest else finer(out, n) if out is not None else np.where(gap, np.nanmean(level), level)
        out = relax(np.where(gap, start, level), gap, rounds * (4 if n == sizes[-1] else 1), tolerance)
    return out


def box_mean(h: np.ndarray, block: int) -> np.ndarray:
    """Mean over a square of block x block cells, edges mirrored."""
    k = block // 2
    p = np.pad(h, k, mode="symmetric")
    s = np.pad(p, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    n = 2 * k + 1
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / n**2


def gaussian(h: np.ndarray, sigma: float) -> np.ndarray:
    k = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    w /= w.sum()
    p = np.pad(h, k, mode="symmetric")
    p = np.apply_along_axis(np.convolve, 0, p, w, "valid")
    return np.apply_along_axis(np.convolve, 1, p, w, "valid")


def watershed(height: np.ndarray, seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Labels of seeds spread over mask, lowest cells first; ties in the order of arrival."""
    out = np.where(mask, seeds, 0)
    heap = [(height[r, c], i, r, c) for i, (r, c) in enumerate(np.argwhere(out > 0).tolist())]
    heapq.heapify(heap)
    n = len(heap)
    while heap:
        _, _, r, c = heapq.heappop(heap)
        for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= a < out.shape[0] and 0 <= b < out.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = out[r, c]
                heapq.heappush(heap, (height[a, b], n, a, b))
                n += 1
    return out


def peaks(h: np.ndarray, apart: int) -> np.ndarray:
    """Cells that are the highest within a square of apart cells to each side, off the border; True where so."""
    k = max(1, apart)
    p = np.pad(h, k, constant_values=-np.inf)
    top = np.max([p[r : r + h.shape[0], c : c + h.shape[1]] for r in range(2 * k + 1) for c in range(2 * k + 1)], axis=0)
    out = (h == top) & (h > 0)
    out[:k], out[-k:], out[:, :k], out[:, -k:] = False, False, False, False
    return out


def detect_trees(ground: np.ndarray, canopy: np.ndarray, cell: float, sigma: float = 1.5, block: float = 20.0, apart: float = 2.0, least: float = 3.5, outlier: float = 40.0, floor: float = 1.0) -> list[tuple[float, float, float, float]]:
    """(row, col, radius, height) of crowns in the height of the canopy over the ground."""
    chm = np.where(np.isnan(canopy), ground, canopy) - ground
    chm[chm > outlier] = np.nan
    chm = np.maximum(filled(chm), 0.0)
    smooth = gaussian(chm, max(sigma / cell, 0.5))
    span = smooth.max() - smooth.min()
    if span <= 0:
        return []
    norm = (smooth - smooth.min()) / span
    crown = (chm > floor) & (norm > box_mean(norm, max(3, int(block / cell) | 1)))
    depth = distance_transform(crown)
    depth[np.isinf(depth)] = 0
    label = watershed(-depth, labels(peaks(depth, max(1, int(apart / cell))), eight=True), crown)
    out = []
    for k in np.unique(label[label > 0]):
        at = np.argwhere(label == k)
        r, c = at.mean(axis=0)
        height = chm[int(round(r)), int(round(c))]
        if height >= least:
            out.append((float(r), float(c), math.sqrt(len(at) / math.pi) * cell, float(height)))
    return out


def boundary(mask: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """The outer boundary cells of a region in order, clockwise from its first cell, by following the last turn around."""
    turns = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    inside = lambda p: 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p]
    here, came, out, seen = start, 0, [start], set()
    while True:
        for k in range(1, 9):
            turn = (came + k) % 8
            step = (here[0] + turns[turn][0], here[1] + turns[turn][1])
            if inside(step):
                break
        else:
            return out
        if (here, turn) in seen:
            return out
        seen.add((here, turn))
        here, came = step, (turn + 4) % 8
        if here != start:
            out.append(here)


def simplified(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open line."""
    keep = np.zeros(len(pts), bool)
    keep[[0, -1]] = True
    stack = [(0, len(pts) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d = pts[j] - pts[i]
        rel = pts[i + 1 : j] - pts[i]
        n = np.hypot(*d)
        off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / n if n else np.hypot(*rel.T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return pts[keep]


def largest_rectangle(mask: np.ndarray, least: int = 1) -> tuple[int, int, int, int]:
    """(row, col, rows, cols) of the largest all-true rectangle of at least so many cells a side, zeros where there is none; the first in row-major order of its lower right corner."""
    best, run = (0, 0, 0, 0), np.zeros(mask.shape[1], int)
    for r in range(mask.shape[0]):
        run = np.where(mask[r], run + 1, 0)
        stack: list[tuple[int, int]] = []
        for c, v in enumerate([*run.tolist(), 0]):
            start = c
            while stack and stack[-1][1] >= v:
                start, height = stack.pop()
                if min(height, c - start) >= least and height * (c - start) > best[2] * best[3]:
                    best = (r - height + 1, start, height, c - start)
            if v:
                stack.append((start, v))
    return best


def smallest_rectangle(pts: np.ndarray) -> tuple[float, float, float, float, float]:
    """(x, z, half length, half width, angle) of the smallest rectangle, along a side of the convex hull."""
    order = sorted(map(tuple, pts.tolist()))

    def chain(points: list) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(chain(order) + chain(order[::-1]) or order)
    best = None
    for a, b in zip(hull, np.roll(hull, -1, axis=0)):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        c, s = math.cos(t), math.sin(t)
        u, v = hull @ (c, s), hull @ (-s, c)
        size = (np.ptp(u)) * (np.ptp(v))
        if best is None or size < best[0] - 1e-12:
            mu, mv = (u.min() + u.max()) / 2, (v.min() + v.max()) / 2
            best = (size, mu * c - mv * s, mu * s + mv * c, np.ptp(u) / 2, np.ptp(v) / 2, t)
    return best[1:]


class Discs:
    """Accepted discs in a hash grid, to find those that come too near."""

    def __init__(self, cell: float):
        self.cell, self.at, self.most = cell, {}, 0.0

    def free(self, x: float, z: float, r: float, ratio: float = 1.0) -> bool:
        k = int(math.ceil((r + self.most) * ratio / self.cell))
        i, j = int(x // self.cell), int(z // self.cell)
        return not any(math.hypot(x - a, z - b) < (r + q) * ratio for p in range(i - k, i + k + 1) for s in range(j - k, j + k + 1) for a, b, q in self.at.get((p, s), ()))

    def add(self, x: float, z: float, r: float) -> None:
        self.at.setdefault((int(x // self.cell), int(z // self.cell)), []).append((x, z, r))
        self.most = max(self.most, r)


def poisson_pack(mask: np.ndarray, cell: float, radii: list[float], plateau: float, edge: float, candidates: int, seed: int) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """(row, col, radius) of discs whose plateaus lie in mask and never overlap, large ones first, and the cells left over."""
    left = mask.copy()
    if plateau <= 0 or not mask.any():
        return [], left
    depth = distance_transform(np.pad(mask, 1), (cell, cell))[1:-1, 1:-1]
    rng, out, discs = np.random.default_rng(seed), [], Discs(max(cell, radii[0] * plateau))
    for radius in radii:
        p = radius * plateau
        sites = np.argwhere(depth >= p + edge)
        for r, c in sites[rng.permutation(len(sites))[:candidates]]:
            if discs.free(c * cell, r * cell, p):
                discs.add(c * cell, r * cell, p)
                out.append((int(r), int(c), radius))
                cover(left, r, c, p / cell)
    return out, left


def enough_candidates(mask: np.ndarray, cell: float, radii: list[float], plateau: float, edge: float, initial: int, most: int, gain: float, seed: int) -> int:
    """The number of candidates, doubled from initial up to most, at which packing leaves no longer clearly less of mask: a doubling takes away
    a share of gain or less of what was left before. Where nothing fits the first number stands; nothing left doesn't end the search."""
    n, before = initial, 0.0
    while n <= most:
        discs, left = poisson_pack(mask, cell, radii, plateau, edge, n, seed)
        bare = float(left.sum())
        if not discs or before and before - bare <= gain * before:
            return n
        n, before = 2 * n, bare
    return most


def cover(mask: np.ndarray, r: int, c: int, reach: float) -> None:
    """Clear the disc of this reach in cells."""
    k = int(reach)
    r0, r1, c0, c1 = max(0, r - k), min(mask.shape[0], r + k + 1), max(0, c - k), min(mask.shape[1], c + k + 1)
    rr, cc = np.ogrid[r0:r1, c0:c1]
    mask[r0:r1, c0:c1][(rr - r) ** 2 + (cc - c) ** 2 <= reach * reach] = False


def crumb_fill(left: np.ndarray, cell: float, radius: float, share: float) -> list[tuple[int, int]]:
    """Cells that cover what is left, each time the deepest one; ties in row-major order."""
    left, out = left.copy(), []
    claim = max(share * radius, 1.5 * cell) / cell
    while left.any():
        depth = distance_transform(np.pad(left, 1))[1:-1, 1:-1]
        r, c = np.unravel_index(int(np.argmax(depth)), left.shape)
        out.append((int(r), int(c)))
        cover(left, r, c, claim)
    return out


def prune(weights: list[tuple[np.ndarray, np.ndarray]], flatten: list[bool], cells: int, tolerance: float = 1e-3, eps: float = 1e-3) -> list[bool]:
    """Which stamps stay, given for each, in order, its cells and weights: from the newest back, one goes if every cell it matters in
    is wholly overwritten by flatten stamps that stay; one that touches no cell can't be judged and stays."""
    survives, keep = np.ones(cells), [True] * len(weights)
    for i in range(len(weights) - 1, -1, -1):
        at, w = weights[i]
        matters = at[w > eps]
        if len(matters) and (survives[matters] <= tolerance).all():
            keep[i] = False
        elif flatten[i]:
            survives[at] *= 1 - w
    return keep


def pack_circles(ring: np.ndarray, radius: float, ratio: float, seed: int, failures: int = 30, attempts: int = 500, smallest: float = 0.1) -> list[tuple[float, float, float]]:
    """Circles thrown into a polygon, wholly inside, apart by ratio times the sum of radii; then a pass with half the radius beside them."""
    rng, out = np.random.default_rng(seed), []
    a, b = ring, np.roll(ring, -1, axis=0)

    def clearance(p: np.ndarray) -> float:
        """Distance to the boundary, negative outside."""
        d = b - a
        t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        near = np.hypot(*(a + d * t[:, None] - p).T).min()
        flips = ((a[:, 1] > p[1]) != (b[:, 1] > p[1])) & (p[0] < (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / np.where(b[:, 1] == a[:, 1], 1, b[:, 1] - a[:, 1]) + a[:, 0])
        return near if flips.sum() % 2 else -near

    low, high = ring.min(0), ring.max(0)
    for k, r in enumerate((radius, radius / 2)):
        if k and r < smallest or (high - low).min() < 2 * r:
            continue
        missed = tried = 0
        before = list(out)
        while missed < failures and tried < attempts:
            tried += 1
            p = rng.uniform(low + r, high - r)
            apart = all(math.hypot(p[0] - x, p[1] - z) >= (r + q) * ratio for x, z, q in out) and all(math.hypot(p[0] - x, p[1] - z) >= r + q for x, z, q in before)
            if apart and clearance(p) >= r:
                out.append((float(p[0]), float(p[1]), r))
                missed = 0
            else:
                missed += 1
    return out


def density_sums(h: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Running sums, row by row, of how many stamps of the radius wanted there a cell takes: 1 / r^2 where there is data, else none."""
    wanted = np.where(np.isnan(radii), np.inf, np.maximum(radii, 1e-6))
    return np.cumsum(np.where(np.isnan(h), 0.0, 1.0 / wanted**2))


def drawn_cell(sums: np.ndarray, cols: int, rng: np.random.Generator) -> tuple[int, int]:
    """(row, col) of a cell, each as likely as its share of the sums' total."""
    return divmod(int(min(np.searchsorted(sums, rng.uniform(0, sums[-1]), side="right"), np.searchsorted(sums, sums[-1]))), cols)


def scatter(h: np.ndarray, cell: float, radius: float, jitter: float = 0.5, share: float = 1.0, failures: int = 300, brushes: int = 4, spread: float = 1.0, least: int = 3, seed: int = 1, radii: np.ndarray | None = None, density: bool = False, subpixel: float = 0.5) -> list[tuple[float, float, float, float, int]]:
    """(x, z, radius, value, rank of the brush) of stamps thrown at random sites with data, whose claims, share times the radius, don't
    overlap. The value is the mean of at least so many cells in the claim; the placed radius grows by spread with the rank. Ends
    after so many misses in a row. With radii the radius is that of the site's cell instead of a random one. With density cells are drawn by
    the number of stamps they want, and sites lie up to subpixel cells from their centres."""
    rng, out, discs = np.random.default_rng(seed), [], Discs(max(cell, radius * share))
    rows, cols = h.shape
    sums = density_sums(h, np.full(h.shape, radius) if radii is None else radii) if density else None
    missed = 0 if sums is None or (sums.size and sums[-1] > 0) else failures
    while missed < failures:
        if sums is None:
            x, z = rng.uniform(0, cols * cell), rng.uniform(0, rows * cell)
            at = min(int(z / cell), rows - 1), min(int(x / cell), cols - 1)
        else:
            at = drawn_cell(sums, cols, rng)
            z, x = (min(max((i + 0.5 + rng.uniform(-subpixel, subpixel)) * cell, 0.0), n * cell) for i, n in zip(at, h.shape))
        r = radius * rng.uniform(jitter, 1.0) if radii is None else float(radii[at])
        rank = int(rng.integers(brushes))
        claim = r * share
        missed += 1
        if np.isnan(h[at]) or np.isnan(r) or not discs.free(x, z, claim):
            continue
        k = int(claim / cell) + 1
        r0, c0 = int(z / cell), int(x / cell)
        rr, cc = np.arange(max(0, r0 - k), min(rows, r0 + k + 1)), np.arange(max(0, c0 - k), min(cols, c0 + k + 1))
        near = ((cc + 0.5) * cell - x)[None, :] ** 2 + ((rr + 0.5) * cell - z)[:, None] ** 2 <= claim * claim
        values = h[rr[0] : rr[-1] + 1, cc[0] : cc[-1] + 1][near]
        values = values[~np.isnan(values)]
        if len(values) < least:
            continue
        discs.add(x, z, claim)
        out.append((float(x), float(z), float(r * spread**rank), float(values.mean()), rank))
        missed = 0
    return out


def refine(actual: np.ndarray, predicted: np.ndarray, cell: float, smallest: float, largest: float, tolerance: float = 2.0, share: float = 1.0, least_cells: float = 1.0, least_points: int = 3, most: int | None = None) -> list[tuple[int, int, float, float, float]]:
    """(row, col, radius, peak error, mean of actual) of places where predicted is off by more than tolerance over the widest area:
    of the areas that are too high and too low the one whose deepest cell is deeper (too high at a tie) is taken, then its cells within the claim
    are done. Shallow peaks only claim their own cell."""
    error = predicted - actual
    claimed, out = np.isnan(error), []
    error = np.where(claimed, 0.0, error)
    while most is None or len(out) < most:
        sides = [(error > tolerance) & ~claimed, (error < -tolerance) & ~claimed]
        depth = [np.where(m, distance_transform(np.pad(m, 1), (cell, cell))[1:-1, 1:-1], 0.0) for m in sides]
        side = 0 if depth[0].max() >= depth[1].max() else 1
        r, c = np.unravel_index(int(np.argmax(depth[side])), error.shape)
        peak = float(depth[side][r, c])
        if peak <= 0:
            return out
        claimed[r, c] = True
        if peak < least_cells * cell:
            continue
        radius = min(max(peak, smallest), largest)
        rr, cc = np.ogrid[: error.shape[0], : error.shape[1]]
        apart = ((rr - r) ** 2 + (cc - c) ** 2) * cell * cell
        inside = (apart <= radius * radius) & ~np.isnan(actual)
        if inside.sum() < least_points:
            continue
        out.append((int(r), int(c), float(radius), float(error[r, c]), float(actual[inside].mean())))
        claimed |= (apart <= (share * radius) ** 2) & sides[side]
    return out
