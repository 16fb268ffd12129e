"""Edges of tiles of any size against one plain loop over the whole frame."""

import numpy as np
import pytest

from meridia.operators import edges

KIND = "video string, frame long, height int, width int, luma binary"


def plain_edges(v):
    """Thinned ridges above the low limit that hang together with one above the high limit, pixel by pixel."""
    h, w = v.shape
    at = lambda y, x: int(v[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    gx, gy, m = (np.zeros((h, w), dtype=int) for _ in range(3))
    for y in range(h):
        for x in range(w):
            gx[y, x] = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy[y, x] = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            m[y, x] = abs(gx[y, x]) + abs(gy[y, x])
    size = lambda y, x: m[y, x] if 0 <= y < h and 0 <= x < w else 0
    middle = np.median(v)
    low, high = int(max(0, (1 - 1 / 3) * middle)), int(min(255, (1 + 1 / 3) * middle))
    ridge = set()
    for y in range(h):
        for x in range(w):
            n, a, b = m[y, x], abs(gx[y, x]), abs(gy[y, x]) << 15
            if n <= low:
                continue
            if b < a * 13573:
                top = n > size(y, x - 1) and n >= size(y, x + 1)
            elif b > a * 13573 + (a << 16):
                top = n > size(y - 1, x) and n >= size(y + 1, x)
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                top = n > size(y - 1, x - s) and n > size(y + 1, x + s)
            if top:
                ridge.add((y, x))
    todo = [p for p in ridge if m[p] > high]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for p in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
            if p in ridge and p not in found:
                found.add(p)
                todo.append(p)
    out = np.zeros((h, w), dtype=np.uint8)
    for p in found:
        out[p] = 255
    return out


def plain_grown(e, k):
    h, w = e.shape
    r = k // 2
    return np.array([[e[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].max() for x in range(w)] for y in range(h)])


def pictures():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:23, :31]
    rings = (np.sin(np.hypot(y - 11, x - 14)) * 90 + 120).astype(np.uint8)
    blocks = np.kron(rng.integers(20, 230, (4, 6)), np.ones((6, 6)))[:23, :31].astype(np.uint8)
    return [rings, blocks, rng.integers(0, 256, (23, 31)).astype(np.uint8), np.full((23, 31), 7, dtype=np.uint8), (rings // 2 + blocks // 2).astype(np.uint8)]


def joined(rows, column, tile, shape):
    out = {}
    for r in rows:
        image = out.setdefault(r["frame"], np.zeros(shape, dtype=np.uint8))
        part = np.frombuffer(r[column], dtype=np.uint8).reshape(-1, min(tile, shape[1] - r["left"]))
        image[r["top"] : r["top"] + part.shape[0], r["left"] : r["left"] + part.shape[1]] = part
    return out


@pytest.mark.parametrize("tile", [1, 5, 64])
def test_tiles_of_any_size_give_the_frame_s_edges(spark, tile):
    images = pictures() if tile > 1 else [p[:7, :9].copy() for p in pictures()]
    frames = spark.createDataFrame([("v", k, *p.shape, p.tobytes()) for k, p in enumerate(images)], KIND)
    tiles = edges.written(edges.tiled(frames, tile), "tiles")
    maps = edges.edge_maps(tiles, tile)
    got, want = joined(maps.collect(), "edges", tile, images[0].shape), [plain_edges(p) for p in images]
    for k, w in enumerate(want):
        assert np.array_equal(got[k], w)
    assert sum(w.any() for w in want) >= 3
    wide = joined(edges.grown(maps, tile, 5).collect(), "edges", tile, images[0].shape)
    for k, w in enumerate(want):
        assert np.array_equal(wide[k], plain_grown(w, 5))
    far = {r["frame"]: r["delta_edges"] for r in edges.edge_deltas(tiles, tile, 3).collect()}
    grown = [plain_grown(w, 3).astype(int) for w in want]
    assert far == pytest.approx({k: abs(grown[k] - grown[k - 1]).mean() if k else 0.0 for k in range(len(want))})


def test_kernel_sizes_are_odd():
    assert [edges.kernel_size(w, h) for w, h in ((32, 32), (640, 480), (1280, 720), (1920, 1080))] == [5, 7, 9, 13]
