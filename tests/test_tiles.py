"""Tiled operators against the whole-mask kernels, for several tile sizes and masks that cross many seams."""

import numpy as np
import pytest

from wayfold.operators import raster, tiles


def masks():
    """Rings in rings, a long snake, noise, thick blobs with pinholes, and a single cell."""
    rng = np.random.default_rng(4)
    rings = np.zeros((41, 38), dtype=bool)
    for i in range(0, 18, 4):
        rings[i : 41 - i, i : 38 - i] = True
        rings[i + 2 : 39 - i, i + 2 : 36 - i] = False
    snake = np.zeros((30, 33), dtype=bool)
    for i in range(0, 30, 4):
        snake[i, :] = True
        snake[i : i + 5, 32 if i % 8 == 0 else 0] = True
    blobs = raster.dilate(rng.random((36, 44)) < 0.02, 4) & (rng.random((36, 44)) < 0.97)
    return {"rings": rings, "snake": snake, "noise": rng.random((25, 27)) < 0.55, "blobs": blobs, "one": np.ones((1, 1), dtype=bool)}


def cells(spark, every):
    return spark.createDataFrame([(k, int(r) - 40, int(c) + 7) for k, m in every.items() for r, c in zip(*np.nonzero(m), strict=True)], "key string, r int, c int")


def got(df, *more):
    out = {}
    for r in df.collect():
        out.setdefault(r.key, {})[r.r + 40, r.c - 7] = tuple(r[x] for x in more)
    return out


def want(every, make):
    out = {}
    for k, m in every.items():
        pad = 12
        result = make(np.pad(m, pad))
        out[k] = {(int(r) - pad, int(c) - pad): (result[r, c].item(),) if result.dtype != bool else () for r, c in zip(*np.nonzero(result), strict=True)}
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("size", [7, 24])
def test_equal_to_whole_masks(spark, size):
    every = masks()
    df = cells(spark, every)
    assert got(tiles.dilate(df, "key", 3, size)) == want(every, lambda m: raster.dilate(m, 3))
    assert got(tiles.closing(df, "key", 2, size)) == want(every, lambda m: raster.closing(m, 2))
    assert got(tiles.edge(df, "key", size)) == want(every, raster.edge)
    for eight in (False, True):
        assert got(tiles.label(df, "key", eight, size), "label") == want(every, lambda m, e=eight: raster.label(m, raster.EIGHT if e else raster.FOUR)[0])
    assert got(tiles.fill_holes(df, "key", size)) == want(every, raster.fill_holes)
    assert got(tiles.filled_mass(df, "key", 2, 0.2, size)) == want(every, lambda m: raster.filled_mass(m, 2, 0.2))
    assert got(tiles.skeleton(df, "key", size, 2)) == want(every, raster.skeleton)


def test_distances(spark):
    every = masks()
    found = got(tiles.distance(cells(spark, every), "key"), "d")
    exact = want(every, lambda m: np.where(m, raster.distance(m), 0.0))
    assert found.keys() == exact.keys()
    for k, v in exact.items():
        assert found[k].keys() == v.keys() and all(abs(found[k][x][0] - d[0]) < 1e-9 for x, d in v.items())


def test_masks_combine(spark):
    every = masks()
    a, b = cells(spark, every), cells(spark, {k: np.rot90(m, 2) for k, m in every.items()})
    for how, rule in (("and", np.logical_and), ("or", np.logical_or), ("not", lambda x, y: x & ~y)):
        both = {k: rule(m, np.rot90(m, 2)) for k, m in every.items()}
        assert got(tiles.combine(a, b, "key", how)) == want(both, lambda m: m)


def test_nothing(spark):
    none = spark.createDataFrame([], "key string, r int, c int")
    for df in (tiles.label(none, "key"), tiles.fill_holes(none, "key"), tiles.distance(none, "key"), tiles.skeleton(none, "key"), tiles.filled_mass(none, "key", 2)):
        assert df.collect() == []


@pytest.mark.parametrize("size", [9])
def test_outlines_hold_the_cells(spark, size):
    """Whatever cell: its centre is in as many outer rings as holes, plus one if it is set; rings don't touch themselves."""
    every = masks() | {"loop": np.array([[1, 1, 1], [1, 0, 1], [1, 1, 0]], dtype=bool), "corner": np.array([[1, 0], [0, 1]], dtype=bool)}
    rows = tiles.outlines(cells(spark, every), "key", size).collect()
    for k, m in every.items():
        labels, n = raster.label(m)
        mine = [r for r in rows if r.key == k]
        for i in range(1, n + 1):
            own = [r for r in mine if r.label == i]
            assert sum(-r.area if r.hole else r.area for r in own) == (labels == i).sum() and sum(not r.hole for r in own) >= 1
            inside = sum((-1 if r.hole else 1) * raster.polygon_mask(m.shape, [np.array([(p.x - 7, p.y + 40) for p in r.pts])]).astype(int) for r in own)
            assert (inside == (labels == i)).all()
        for r in mine:
            assert len({(p.x, p.y) for p in r.pts}) == len(r.pts) >= 4
    assert [(r.hole, r.area) for r in sorted(rows, key=lambda r: r.area) if r.key == "loop"] == [(True, 1.0), (False, 8.0)]
    assert tiles.outlines(spark.createDataFrame([], "key string, r int, c int"), "key").collect() == []
