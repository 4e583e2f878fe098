import numpy as np
import pytest

from frameops.operators import palette as P, spacing as S


def code(colors):
    return (colors[:, 0] << 16) | (colors[:, 1] << 8) | colors[:, 2]


def frame(spark, sets):
    return spark.createDataFrame([(b, int(v)) for b, colors in sets.items() for v in code(colors)], "batch_id long, value int")


@pytest.fixture(scope="module")
def palettes():
    rng = np.random.default_rng(7)
    dark = rng.integers(0, 60, size=(400, 3))
    return {1: np.array([[5, 5, 5]]), 2: np.unique(rng.integers(0, 256, size=(300, 3)), axis=0),
            3: np.unique(dark, axis=0), 4: np.unique(rng.integers(0, 256, size=(3000, 3)), axis=0)}


def square_distances(points, palette):
    return np.concatenate([((part[:, None, :] - palette[None]) ** 2).sum(-1) for part in np.array_split(points, 40)])


def check_nearest(spark, palettes):
    rng = np.random.default_rng(8)
    asked = {b: np.unique(rng.integers(0, 256, size=(300, 3)), axis=0) for b in palettes}
    got = {(r.batch_id, r.value): (r.near, r.dist2) for r in S.nearest(frame(spark, asked), frame(spark, palettes)).collect()}
    for b, palette in palettes.items():
        distance = square_distances(asked[b], palette)
        for value, row in zip(code(asked[b]), distance):
            assert got.pop((b, int(value))) == (code(palette)[row == row.min()].min(), row.min())
    assert not got


def test_nearest_is_exact(spark, palettes):
    check_nearest(spark, palettes)


def test_nearest_without_broadcast(no_broadcast, palettes):
    check_nearest(no_broadcast, {b: palettes[b] for b in (1, 3)})


@pytest.mark.parametrize("limits", [(50, 0.2, 0.6), (60, 0.0, 0.3), (55, 0.5, 0.5)])
def test_farthest_is_exact(spark, palettes, limits):
    top, low, high = limits
    cube = np.stack(np.meshgrid(*[np.arange(top + 1)] * 3, indexing="ij"), -1).reshape(-1, 3)
    most, least = cube.max(1) / 255.0, cube.min(1) / 255.0
    saturation = np.divide(most - least, most, out=np.zeros_like(most), where=most > 0)
    allowed = cube[(most * 255.0 <= top) & (saturation >= low) & (saturation <= high)]
    got = {r.batch_id: (r.value, r.dist2) for r in S.farthest(frame(spark, palettes), *limits).collect()}
    for b, palette in palettes.items():
        distance = square_distances(allowed, palette).min(1)
        assert got[b] == (code(allowed)[distance == distance.max()].min(), distance.max())


def test_farthest_with_nothing_allowed(spark, palettes):
    assert S.farthest(frame(spark, palettes), 140, 0.5, 0.3).count() == 0
    pixels = spark.createDataFrame([(9, 1, 0, 0, 1, 2, 3)], "batch_id long, image_id long, y int, x int, r int, g int, b int")
    (summary,) = P.farthest_color_summary(pixels, min_sat=0.5, max_sat=0.3).collect()
    assert (summary.r, summary.g, summary.b, summary.distance ** 2) == (80, 100, 90, pytest.approx(79 ** 2 + 98 ** 2 + 87 ** 2))
    assert [tuple(r) for r in P.farthest_color(pixels, min_sat=0.5, max_sat=0.3).collect()] == [(9, 5268570, "#50645A", "80, 100, 90")]
