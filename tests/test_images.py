import numpy as np
import pytest

from tessella import model
from tessella.operators import analysis, blocks, drawing, geometry, palette, resample
from tessella.sources import codecs

RNG = np.random.default_rng(5)


def relation(spark, pictures):
    rows = [(i, x, y, *map(int, p[y, x])) for i, p in enumerate(pictures) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x int, y int, a int, r int, g int, b int")


def picture(h, w):
    return RNG.integers(0, 256, (h, w, 4)).astype(np.uint8)


def arrays(pixels):
    out = {}
    for r in pixels.collect():
        out.setdefault(r.image_id, {})[r.y, r.x] = (r.a, r.r, r.g, r.b)
    return {i: np.array([[d[y, x] for x in range(max(k[1] for k in d) + 1)] for y in range(max(k[0] for k in d) + 1)]) for i, d in out.items()}


def test_turns(spark):
    p = picture(5, 7)
    px = relation(spark, [p])
    for q in range(4):
        assert (arrays(geometry.rotate90(px, q))[0] == np.rot90(p, q)).all()
        assert (drawing.turned(p, 90.0 * q) == np.rot90(p, q)).all()
    flat = np.full((20, 20, 4), 200, np.uint8)
    for angle in (-30.0, 10.0, 44.0, 200.0):
        t = drawing.turned(flat, angle)
        assert t.shape[0] > 20 and t.shape[1] > 20
        assert t.max() <= 201 and abs(t[..., 1].astype(int).sum() / (200 * 400) - 1) < 0.05


def test_flood(spark):
    p = np.zeros((6, 6, 4), np.uint8)
    p[:, 3] = 9
    out = arrays(drawing.flood_fill(relation(spark, [p]), 0, 0, (1, 2, 3, 4)))[0]
    assert (out[:, :3] == (1, 2, 3, 4)).all() and (out[:, 3] == 9).all() and (out[:, 4:] == 0).all()
    edge = arrays(drawing.flood_fill(relation(spark, [p]), 5, 5, (1, 2, 3, 4), boundary=(9, 9, 9, 9)))[0]
    assert (edge[:, 4:] == (1, 2, 3, 4)).all() and (edge[:, :3] == 0).all()
    assert (arrays(drawing.flood_fill(relation(spark, [p]), 99, 0, (1, 2, 3, 4)))[0] == p).all()


def test_blocks():
    two = np.zeros((8, 8, 4), np.uint8) + 255
    two[::2, ::2, 1:] = 0
    for name in ("DXT1", "DXT3", "DXT5"):
        raw = blocks.FORMATS[name][1](blocks.to_blocks(two)).astype(np.uint8)
        assert raw.shape[1] == blocks.FORMATS[name][0]
        assert (blocks.from_blocks(blocks.FORMATS[name][2](raw), 8, 8) == two).all()
    clear = two.copy()
    clear[0, 0, 0] = 0
    got = blocks.from_blocks(blocks.color_decode(blocks.color_encode(blocks.to_blocks(clear), True), True), 8, 8)
    assert got[0, 0, 0] == 0 and (got[4:, 4:] == clear[4:, 4:]).all()
    v = RNG.integers(0, 256, (50, 16))
    assert np.abs(blocks.level_decode(blocks.level_encode(v).astype(np.uint8)) - v).max() <= 19
    assert blocks.to_blocks(picture(5, 6)).shape == (4, 16, 4)


@pytest.mark.parametrize("kind", resample.FILTERS)
def test_weights(kind):
    f, radius = resample.FILTERS[kind]
    assert f(0.0) > 0.3 and abs(f(radius + 1.0)) < 1e-3
    for src, dst in ((8, 13), (13, 8), (1, 4), (9, 1)):
        rows = resample.weights(src, dst, kind, 2)
        assert {r[0] for r in rows} == set(range(dst)) and all(2 <= r[1] < 2 + src for r in rows)
    if kind in ("linear", "catmullrom", "mitchell", "spline", "hermite", "cosine"):
        for i in range(13):
            assert sum(w for d, _, w in resample.weights(8, 13, kind) if d == i) == pytest.approx(1)


def test_sizes():
    assert resample.fit_size((100, 50), (10, 10)) == (10, 5) and resample.fit_size((1000, 1), (10, 10)) == (10, 1)
    assert resample.mip_sizes((8, 2)) == [(8, 2), (4, 1), (2, 1), (1, 1)]


def test_palette_cut():
    colors = np.unique(RNG.integers(0, 256, (400, 4)), axis=0)
    counts = RNG.integers(1, 9, len(colors))
    for most in (2, 16, 256):
        found = palette.median_cut(colors, counts, most)
        assert len(found) <= most and found.min() >= 0 and found.max() <= 255
    assert (palette.median_cut(colors[:3], counts[:3], 16) == colors[:3]).all()


def test_otsu(spark):
    pictures = [picture(6, 6) for _ in range(5)] + [np.full((2, 2, 4), 7, np.uint8)]
    got = {r.image_id: r.level for r in analysis.otsu(relation(spark, pictures)).collect()}
    for i, p in enumerate(pictures):
        assert got[i] == analysis.otsu_reference(np.bincount(p[..., 2].ravel(), minlength=256).tolist())


def test_objects(spark, tmp_path):
    frames = [np.where(True, picture(4, 4), 0).astype(np.uint8) for _ in range(3)]
    (tmp_path / "a.png").write_bytes(codecs.png_encode(frames))
    found = model.Images.read(spark, str(tmp_path))
    assert found.valid().first().valid
    back = found.reverse().delete(0).encode("png").first()
    assert all((a == b).all() for a, b in zip(codecs.png_decode(bytes(back.content)), frames[1::-1], strict=True))
    turned = found.map(lambda p: geometry.flip(p), frame=1)
    assert (np.frombuffer(turned.frames.first().bits, np.uint8).reshape(4, 4, 4) == frames[1][::-1]).all()
