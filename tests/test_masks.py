import numpy as np
import pytest

from splinebrook.operators import masks as K


def frame(spark, cells):
    return spark.createDataFrame([tuple(int(v) for v in c) for c in cells], "x int, y int, z int")


def touching(c):
    return [tuple(v + s * (k == a) for k, v in enumerate(c)) for a in range(3) for s in (-1, 1)]


def slow_components(cells, shape):
    left, out = set(cells), {}
    while left:
        queue = [left.pop()]
        found = set(queue)
        while queue:
            for n in touching(queue.pop()):
                if n in left:
                    left.remove(n)
                    found.add(n)
                    queue.append(n)
        root = min((x * shape[1] + y) * shape[2] + z for x, y, z in found)
        out |= dict.fromkeys(found, root)
    return out


@pytest.mark.parametrize("share", [0.2, 0.33, 0.6])
def test_components_over_blocks(spark, share):
    shape = (40, 20, 18)
    cells = [tuple(c) for c in np.argwhere(np.random.default_rng(int(share * 100)).random(shape) < share).tolist()]
    got = {(r.x, r.y, r.z): r.root for r in K.components(frame(spark, cells), shape).collect()}
    assert got == slow_components(cells, shape)


def test_a_line_through_all_blocks_is_one(spark):
    """A winding line that crosses block faces again and again."""
    shape = (48, 33, 3)
    cells = [(x, y, 1) for y in range(0, 33, 2) for x in range(48)] + [(47 if y % 4 == 1 else 0, y, 1) for y in range(1, 32, 2)]
    found = K.components(frame(spark, cells), shape)
    assert found.select("root").distinct().count() == 1 and found.count() == len(cells)


def test_threshold_lies_in_the_widest_gap(spark):
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.uniform(0, 1, 300), rng.uniform(2, 3, 300), [50.0]])
    rows = spark.createDataFrame([(float(v),) for v in m] + [(None,), (float("nan"),)], "m double")
    s = np.sort(m)
    low, high = int(0.2 * len(s)), int(0.85 * len(s))
    k = low + int(np.argmax(np.diff(s[low : high + 1])))
    assert K.gap_threshold(rows) == pytest.approx((s[k] + s[k + 1]) / 2) and 1 < K.gap_threshold(rows) < 2
    with pytest.raises(ValueError):
        K.gap_threshold(rows.limit(1))


def test_holes_are_filled_and_bays_are_not(spark):
    shape = (20, 20, 20)
    ball = [c for c in np.ndindex(shape) if 3 <= sum((v - 9.5) ** 2 for v in c) ** 0.5 <= 8]
    got = {tuple(r) for r in K.filled(frame(spark, ball), shape).collect()}
    assert got == {c for c in np.ndindex(shape) if sum((v - 9.5) ** 2 for v in c) ** 0.5 <= 8}
    bored = [c for c in ball if not (c[0] >= 9 and c[1:] == (9, 9))]
    assert {tuple(r) for r in K.filled(frame(spark, bored), shape).collect()} == set(bored)


def test_mask_keeps_the_brain(spark):
    """A ball with a hole and a bright speck outside, in noise: opened, the largest kept, filled."""
    shape, rng = (24, 20, 20), np.random.default_rng(2)
    place = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), axis=-1)
    away = np.sqrt(((place - np.array([11.5, 9.5, 9.5])) ** 2).sum(axis=-1))
    image = rng.uniform(0, 0.2, shape) + (away <= 8) - (away <= 1.2)
    image[0:2, 0:2, 0:2] += 1
    means = spark.createDataFrame([(*map(int, c), float(image[tuple(c)])) for c in place.reshape(-1, 3)], "x int, y int, z int, m double")
    got = {tuple(r) for r in K.epi_mask(means, shape, opening=1, upper=0.9).collect()}
    ball = {tuple(int(v) for v in c) for c in place.reshape(-1, 3) if away[tuple(c)] <= 8}
    assert got <= ball and len(got) > 0.9 * len(ball) and (11, 9, 9) in got


def test_nothing_set(spark):
    assert K.components(frame(spark, []), (3, 3, 3)).count() == 0
    assert K.largest_component(frame(spark, []), (3, 3, 3)).count() == 0
