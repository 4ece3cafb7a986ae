"""Array kernels against brute force and invariants."""

import numpy as np
import pytest

from greensward.functions import geometry as G
from greensward.functions import kernels as K


@pytest.fixture
def rng():
    return np.random.default_rng(3)


def test_distance_transform_equals_brute_force(rng):
    for _ in range(5):
        mask = rng.random((17, 23)) < 0.8
        zeros = np.argwhere(~mask) * (2.0, 3.0)
        want = [[np.hypot(*(zeros - (2.0 * r, 3.0 * c)).T).min() for c in range(23)] for r in range(17)]
        assert np.allclose(K.distance_transform(mask, (2.0, 3.0)), want)
    assert np.isinf(K.distance_transform(np.ones((3, 3), bool))).all()


@pytest.mark.parametrize("eight", [False, True])
def test_labels_equal_flood_fill(rng, eight):
    mask = rng.random((20, 20)) < 0.55
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    want = np.zeros(mask.shape, int)
    for r, c in np.argwhere(mask):
        if not want[r, c]:
            stack, k = [(r, c)], r * 20 + c + 1
            want[r, c] = k
            while stack:
                a, b = stack.pop()
                for dr, dc in steps:
                    p = (a + dr, b + dc)
                    if 0 <= p[0] < 20 and 0 <= p[1] < 20 and mask[p] and not want[p]:
                        want[p] = k
                        stack.append(p)
    assert (K.labels(mask, eight) == want).all()


def test_filled_keeps_known_cells_and_obeys_the_maximum_principle(rng):
    h = rng.random((64, 64))
    h[rng.random((64, 64)) < 0.4] = np.nan
    out = K.filled(h)
    known = ~np.isnan(h)
    assert (out[known] == h[known]).all() and not np.isnan(out).any()
    assert out.min() >= np.nanmin(h) and out.max() <= np.nanmax(h)
    assert (K.filled(np.ones((4, 4))) == 1).all()
    with pytest.raises(ValueError):
        K.filled(np.full((4, 4), np.nan))
    with pytest.raises(ValueError):
        K.filled(np.ones((4, 5)))


def test_largest_rectangle_equals_brute_force(rng):
    for _ in range(10):
        mask = rng.random((8, 9)) < 0.7
        best = max(((n * m) for r in range(8) for c in range(9) for n in range(1, 9 - r) for m in range(1, 10 - c) if mask[r : r + n, c : c + m].all()), default=0)
        r, c, n, m = K.largest_rectangle(mask)
        assert n * m == best and mask[r : r + n, c : c + m].all()


def test_closing_fills_and_denoising_drops_specks():
    mask = np.ones((9, 9), bool)
    mask[4, 4] = False
    assert K.closed(mask, 1).all()
    speck = np.zeros((20, 20), bool)
    speck[3, 3] = True
    assert not K.denoised(speck, 1).any()


def test_packed_plateaus_never_overlap_and_crumbs_cover_the_rest(rng):
    mask = np.ones((40, 40), bool)
    discs, left = K.poisson_pack(mask, 5.0, G.tier_radii(40, 10, 0.8), 0.5, 0.0, 500, 1)
    assert discs == K.poisson_pack(mask, 5.0, G.tier_radii(40, 10, 0.8), 0.5, 0.0, 500, 1)[0]
    for i, (r, c, q) in enumerate(discs):
        assert all(np.hypot((r - a) * 5, (c - b) * 5) >= (q + p) * 0.5 - 1e-9 for a, b, p in discs[:i])
    rest = left.copy()
    for r, c in K.crumb_fill(left, 5.0, 16.0, 0.25):
        K.cover(rest, r, c, max(4.0, 7.5) / 5.0)
    assert not rest.any()


def test_prune_drops_only_what_is_overwritten():
    every, ones = np.arange(4), np.ones(4)
    assert K.prune([(every, ones), (every, ones)], [True, True], 4) == [False, True]
    assert K.prune([(every, ones), (every[:3], ones[:3])], [True, True], 4) == [True, True]
    assert K.prune([(every, ones), (every, ones)], [True, False], 4) == [True, True]  # a raise stamp hides nothing
    assert K.prune([(every[:0], ones[:0]), (every, ones)], [True, True], 4) == [True, True]


def test_circles_lie_inside_and_apart():
    ring = np.array([(0.0, 0.0), (60.0, 0.0), (60.0, 40.0), (0.0, 40.0)])
    got = K.pack_circles(ring, 6.0, 1.0, 5)
    assert len(got) > 5
    for i, (x, z, r) in enumerate(got):
        assert r <= x <= 60 - r and r <= z <= 40 - r
        assert all(np.hypot(x - a, z - b) >= r + q - 1e-9 for a, b, q in got[:i])


def test_boundary_simplify_and_smallest_rectangle():
    mask = np.zeros((10, 12), bool)
    mask[2:7, 3:9] = True
    line = np.array(K.boundary(mask, (2, 3)), float)
    assert set(map(tuple, line.astype(int))) == {(r, c) for r, c in np.argwhere(mask) if r in (2, 6) or c in (3, 8)}
    assert len(K.simplified(line, 0.5)) <= 6
    x, z, a, b, _ = K.smallest_rectangle(np.array([(0, 0), (4, 0), (4, 2), (0, 2), (1, 1)], float))
    assert (x, z) == pytest.approx((2, 1)) and sorted((a, b)) == pytest.approx([1, 2])
    assert K.boundary(np.ones((1, 1), bool), (0, 0)) == [(0, 0)]


def test_detected_trees_are_where_crowns_are():
    ground = np.zeros((50, 50))
    canopy = np.zeros((50, 50))
    for r, c in ((12, 12), (12, 34), (34, 20)):
        canopy[r - 2 : r + 3, c - 2 : c + 3] = 9.0
    found = K.detect_trees(ground, canopy, 1.0)
    assert sorted((round(r), round(c)) for r, c, _, _ in found) == [(12, 12), (12, 34), (34, 20)]
    assert K.detect_trees(ground, ground, 1.0) == []


def test_scattered_claims_never_overlap(rng):
    h = rng.random((40, 40))
    h[:10] = np.nan
    got = K.scatter(h, 10.0, 30.0, share=0.8, seed=4)
    assert got and got == K.scatter(h, 10.0, 30.0, share=0.8, seed=4)
    for i, (x, z, r, v, _) in enumerate(got):
        assert z >= 100 and 15 <= r <= 30 and 0 <= v <= 1
        assert all(np.hypot(x - a, z - b) >= 0.8 * (r + q) - 1e-9 for a, b, q, _, _ in got[:i])


def test_refine_finds_the_widest_error_first():
    actual, predicted = np.zeros((30, 30)), np.zeros((30, 30))
    predicted[5:10, 5:10], predicted[15:26, 15:26] = 5.0, -5.0
    got = K.refine(actual, predicted, 1.0, 1.0, 6.0)
    assert got[0][:2] == (20, 20) and got[0][3] == -5.0 and any(g[:2] == (7, 7) for g in got)
    assert K.refine(actual, actual, 1.0, 1.0, 6.0) == [] and len(K.refine(actual, predicted, 1.0, 1.0, 6.0, most=1)) == 1


def test_a_long_strip_hides_no_rectangle():
    mask = np.zeros((6, 12), bool)
    mask[0] = mask[3:5, 3:5] = True
    assert K.largest_rectangle(mask) == (0, 0, 1, 12) and K.largest_rectangle(mask, 2) == (3, 3, 2, 2) and K.largest_rectangle(mask, 3) == (0, 0, 0, 0)


def test_nearest_value_equals_nearest_seed():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.9, 0.97):
        h = rng.random((12, 17))
        h[rng.random(h.shape) < share] = np.nan
        want = K.nearest_seed(h)
        assert all(K.nearest_value(h, r, c) == want[r, c] for r in range(12) for c in range(17))
    assert np.isnan(K.nearest_value(np.full((3, 4), np.nan), 1, 1))


def test_cells_are_drawn_by_the_stamps_they_want(rng):
    radii = rng.uniform(5, 20, (6, 7))
    h = rng.random((6, 7))
    h[2], radii[4, 4] = np.nan, np.nan
    sums = K.density_sums(h, radii)
    n = 40_000
    got = np.zeros(h.shape)
    for _ in range(n):
        got[K.drawn_cell(sums, 7, rng)] += 1
    want = np.where(np.isnan(h) | np.isnan(radii), 0, 1 / radii**2)
    want = want / want.sum()
    assert not got[want == 0].any() and (np.abs(got / n - want) < 5 * np.sqrt(want / n) + 1e-12).all()


def test_scattered_by_density_has_the_radii_of_its_cells(rng):
    h, radii = rng.random((30, 40)), np.full((30, 40), 40.0)
    radii[:, 20:] = 20.0
    h[:5], radii[5] = np.nan, np.nan
    got = K.scatter(h, 10.0, 40.0, share=0.7, seed=2, radii=radii, density=True)
    assert got == K.scatter(h, 10.0, 40.0, share=0.7, seed=2, radii=radii, density=True)
    for i, (x, z, r, v, _) in enumerate(got):
        claim = 0.7 * r
        cells = [h[p, q] for p in range(30) for q in range(40) if np.hypot((q + 0.5) * 10 - x, (p + 0.5) * 10 - z) <= claim and not np.isnan(h[p, q])]
        assert z >= 60 and r == (40.0 if x < 200 else 20.0) and len(cells) >= 3 and v == pytest.approx(np.mean(cells))
        assert all(np.hypot(x - a, z - b) >= 0.7 * (r + q) - 1e-9 for a, b, q, _, _ in got[:i])
    assert sum(r == 20.0 for _, _, r, _, _ in got) > sum(r == 40.0 for _, _, r, _, _ in got) > 0
    assert K.scatter(np.full((4, 4), np.nan), 10.0, 40.0, radii=np.full((4, 4), 9.0), density=True) == []


@pytest.mark.parametrize("gain", [0.0, 0.1, 0.9])
def test_candidates_double_until_little_is_gained(rng, gain):
    mask = rng.random((40, 40)) < 0.97
    args = (mask, 5.0, [30.0, 20.0, 12.0], 0.5, 0.0)
    left = {n: int(K.poisson_pack(*args, n, 3)[1].sum()) for n in (10, 20, 40, 80, 160)}
    want = next((n for n in (20, 40, 80, 160) if left[n // 2] and 1 - left[n] / left[n // 2] <= gain), 200)
    assert K.enough_candidates(*args, 10, 200, gain, 3) == want
    assert K.enough_candidates(np.zeros((4, 4), bool), *args[1:], 10, 200, gain, 3) == 10
