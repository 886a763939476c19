import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import model, options
from tessella.functions import color, helpers
from tessella.operators import analysis, frames, neighborhood, palette
from tessella.sources import codecs, deep, formats, images, jpeg

RNG = np.random.default_rng(42)


def picture(h, w):
    yy, xx = np.mgrid[:h, :w]
    p = np.stack([np.full((h, w), 255), xx * 5 % 256, yy * 6 % 256, (xx + yy) * 3 % 256], 2)
    return np.clip(p + RNG.integers(0, 9, p.shape), 0, 255).astype(np.uint8) | np.array([255, 0, 0, 0], np.uint8)


def test_jpeg_against_java(spark, tmp_path):
    """Our files by Spark's image source, which decodes with another library; whole units, so that its colours are grown the same way."""
    made = {}
    for h, w in ((16, 16), (17, 33), (48, 64), (1, 1)):
        for progressive in (False, True):
            for gray in (False, True):
                name = f"{h}x{w}-{progressive:d}-{gray:d}.jpg"
                made[name] = jpeg.encode([picture(h, w)], 90, progressive, gray)
                (tmp_path / name).write_bytes(made[name])
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == len(made)
    for r in rows:
        theirs = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, -1).astype(int)[..., ::-1]
        ours = jpeg.decode(made[r.origin.rpartition("/")[2]])[0].astype(int)[..., 1:]
        gap = np.abs(ours - theirs)
        assert gap.max() <= (4 if r.nChannels == 3 else 1) and gap.mean() < 0.5, r.origin  # their transform is of whole numbers


def test_jpeg_noise_and_errors():
    raw = jpeg.encode([picture(16, 16)], 90)
    assert codecs.detect(raw, "x.JPG").name == "jpeg"
    for end in (40, len(raw) - 30):
        with pytest.raises(ValueError):
            jpeg.decode(raw[:end])
    noise = RNG.integers(0, 256, (40, 56, 4)).astype(np.uint8)
    for progressive in (False, True):
        got = jpeg.decode(jpeg.encode([noise], 100, progressive, gray=True))[0].astype(int)
        level = np.rint(noise[..., 1:] @ np.array(color.GRAY))
        assert np.abs(got[..., 1] - level).max() <= 2


def brute_cut(colors, counts, most):
    """Box by box over lists."""
    boxes = [list(range(len(colors)))]
    while len(boxes) < most:
        best, at, side = 0, None, None
        for i, b in enumerate(boxes):
            for k, w in enumerate((1024, 612, 1202, 234)):
                v = [int(colors[j][k]) for j in b]
                if (max(v) - min(v)) * w > best:
                    best, at, side = (max(v) - min(v)) * w, i, k
        if at is None:
            break
        v = [int(colors[j][side]) for j in boxes[at]]
        cut = (max(v) + min(v)) // 2
        low, high = [j for j in boxes[at] if colors[j][side] <= cut], [j for j in boxes[at] if colors[j][side] > cut]
        boxes[at] = low
        boxes.append(high)
    total = [sum(int(counts[j]) for j in b) for b in boxes]
    means = [tuple(sum(int(colors[j][k]) * int(counts[j]) for j in b) // t for k in range(4)) for b, t in zip(boxes, total)]
    return boxes, total, means


def test_median_cut_by_brute_force():
    for most in (2, 7, 16, 300):
        colors = np.unique(RNG.integers(0, 40, (200, 4)), axis=0)
        counts = RNG.permutation(len(colors)) + 1
        found = palette.median_boxes(colors, counts, most)
        boxes, total, means = brute_cut(colors, counts, most)
        order = sorted(range(len(boxes)), key=lambda i: -total[i])
        assert sorted(map(tuple, found.colors)) == sorted(means)
        if len(set(total)) == len(total):
            assert [tuple(c) for c in found.colors] == [means[i] for i in order]
        index = found.index(colors)
        for i, c in enumerate(colors):  # the first box whose ranges hold the colour
            held = [k for k in range(len(found.colors)) if (found.low[k] <= c).all() and (c <= found.high[k]).all()]
            assert index[i] == held[0]
    assert palette.median_boxes(np.zeros((0, 4), int), np.zeros(0, int), 4).colors.shape == (0, 4)


PLAIN = [n for n, kind, *_ in model.FORMATS if kind in ("argb", "gray", "float")]


def test_every_pair_of_formats():
    argb = RNG.integers(0, 256, (64, 4)).astype(np.uint8)
    source = argb[:, ::-1].tobytes()
    for name, *_ in model.FORMATS:
        w, h, raw, entries = formats.converted(8, 8, "A8R8G8B8", source, None, name)
        f = formats.named(name)
        size = {"block": 4 * f.size, "bits": 8}.get(f.kind, 64 * f.size)
        assert len(raw) == size and (entries is None) == (f.kind != "index")
        for other, *_ in model.FORMATS:
            w2, h2, raw2, _ = formats.converted(w, h, name, raw, entries, other)
            g = formats.named(other)
            assert (w2, h2) == (8, 8) and len(raw2) == {"block": 4 * g.size, "bits": 8}.get(g.kind, 64 * g.size), (name, other)
    for name in sorted(set(PLAIN) - {"X8R8G8B8"}):  # what a format holds survives itself
        raw = formats.converted(8, 8, "A8R8G8B8", source, None, name)[2]
        f = formats.named(name)
        if f.kind == "argb":
            assert formats.write_channels(f, formats.read_channels(f, raw)) == raw
        elif f.kind == "gray":
            assert formats.write_gray(f, *formats.read_gray(f, raw)) == raw
        else:
            assert formats.write_floats(f, formats.read_floats(f, raw)) == raw
    with pytest.raises(ValueError):
        formats.named("A1B2")
    assert formats.converted(5, 3, "A8R8G8B8", bytes(60), None, "DXT1")[:2] == (8, 4)


def test_halves(spark):
    x = np.concatenate([RNG.normal(size=400) * 10.0 ** RNG.integers(-8, 6, 400), [0, 1, -1, 65504, 65519, 65520, 1e9, -1e9, 2.0**-14, 2.0**-24, 2.0**-26, np.inf, -np.inf]]).astype(np.float32)
    bits = formats.half_of(x)
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).view(np.uint16)
    want[np.abs(x) < 2.0**-25] = 0  # without a sign
    tie = np.abs(bits.astype(int) - want.astype(int)) <= 1
    assert tie.all() and (bits == want).mean() > 0.97
    assert formats.half_of(np.array([np.nan], np.float32))[0] & 0x7C00 == 0x7C00
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = [r[0] for r in df.select(color.float_to_half("v")).collect()]
    assert all(abs(a - int(b)) <= 1 for a, b in zip(got, bits))


def test_deep_files(spark):
    values = RNG.integers(0, 65536, (6, 5, 4))
    for name in ("A16R16G16B16", "R16G16B16", "Gray16", "A16Gray16"):
        f = formats.named(name)
        raw = values[..., : f.size // 2].astype("<u2").tobytes()
        for kind in ("png", "pam"):
            made = deep.WRITERS[kind](5, 6, name, raw, None)
            assert deep.READERS[kind](made) == [(5, 6, name, raw, None)]
    bright = (RNG.random((6, 5, 3)) * 50).astype("<f4")
    assert deep.pnm_read(deep.pfm_write(5, 6, "R32G32B32F", bright.tobytes(), None)) == [(5, 6, "R32G32B32F", bright.tobytes(), None)]
    back = np.frombuffer(deep.hdr_read(deep.hdr_write(5, 6, "R32G32B32F", bright.tobytes(), None))[0][3], "<f4").reshape(6, 5, 3)
    assert (np.abs(back - bright).max(2) <= bright.max(2) / 100).all() and back.max() > 10
    table = spark.createDataFrame([("a.png", deep.png_write(5, 6, "Gray16", values[..., :1].astype("<u2").tobytes(), None)), ("b.png", b"\x89PNG\r\n\x1a\nxx"), ("c", None)], "path string, content binary")
    got = {r.path: r for r in deep.decode(table).collect()}
    assert got["a.png"].pixel_format == "Gray16" and got["b.png"].error and got["c"].error
    assert {r.path: r.pixel_format for r in deep.decode(table.limit(1), "R8G8B8").collect()} == {"a.png": "R8G8B8"}
    assert deep.compatible("pgm", "A16R16G16B16") == "Gray16" and deep.compatible("bmp", "Gray16") == "A8R8G8B8" and deep.compatible("pfm", "Gray8") == "R32G32B32F"


def test_registry():
    assert codecs.supported("A.PNG") and not codecs.supported("a.xyz") and codecs.by_name("jpeg").extensions[0] == "jpg"
    opening, saving = codecs.dialog_filter(), codecs.dialog_filter(False)
    assert opening.startswith("All Images (*.png") and "pcx" in opening and "pcx" not in saving
    for flag in (True, False):
        for name in ("x.png", "y.QOI", "z.jpeg"):
            at = codecs.filter_index(name, flag)
            assert codecs.filter_extension(at, flag) in codecs.by_extension(name).extensions
    assert codecs.filter_extension(1) == "" and codecs.filter_index("none.xyz") == 0


def test_options(spark):
    assert options.option(spark, "jpeg.quality") == 90
    with pytest.raises(ValueError):
        options.set_option(spark, "jpeg.quality", 101)
    with pytest.raises(KeyError):
        options.set_option(spark, "no.such", 1)
    assert all(options.push(spark) for _ in range(options.DEPTH)) and not options.push(spark)
    options.set_option(spark, "jpeg.quality", 50)
    assert options.pop(spark) and options.option(spark, "jpeg.quality") == 90
    while options.pop(spark):
        pass
    with pytest.raises(ValueError):
        images.encode(spark.createDataFrame([], "image_id long, width int, height int, bits binary"), "png", quality=3)


def test_objects_keep_all_frames(spark):
    packed = [(i, k, 3 + k, 2, "A8R8G8B8", RNG.integers(0, 256, (2, 3 + k, 4)).astype(np.uint8).tobytes(), None) for i in (1, 2) for k in range(3)]
    found = model.Images(spark.createDataFrame(packed, "image_id long, frame_idx int, width int, height int, format string, bits binary, error string"))
    turned = {(r.image_id, r.frame_idx): r for r in found.flip().frames.collect()}
    assert len(turned) == 6
    for i, k, w, h, _, bits, _ in packed:
        assert bytes(turned[i, k].bits) == np.frombuffer(bits, np.uint8).reshape(h, w, 4)[::-1].tobytes()
    sizes = {(r.width, r.height) for r in found.resize(4, 4, "nearest").frames.collect()}
    assert sizes == {(4, 4)} and found.resize(4, 4, "nearest").frames.count() == 6
    text = formats.described(found.typed("R5G6B5")).first().text
    assert text.startswith("R5G6B5 ")


def test_deskew_turns_back(spark):
    p = np.full((60, 90), 255)
    for y in range(8, 60, 10):
        for x in range(90):
            at = int(round(y + (x - 45) * 0.05))
            if 0 <= at < 60:
                p[at, x] = 0
    rows = [(1, x, y, 255, int(p[y, x]), int(p[y, x]), int(p[y, x])) for y in range(60) for x in range(90)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, a int, r int, g int, b int")
    before = analysis.skew_angle(df, 10).first().angle
    assert abs(before) > 1.5
    assert analysis.deskew(df).agg(F.max("x")).first()[0] > 90


def test_frames_and_bounds(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 1, 0, 0, 6)], "image_id long, frame_idx int, x int, y int, g int")
    assert sorted((r.frame_idx, r.g) for r in frames.append(df, df).collect()) == [(0, 5), (1, 6), (2, 5), (3, 6)]
    assert sorted((r.frame_idx, r.g) for r in frames.insert_many(df, 1, df).collect()) == [(0, 5), (1, 5), (2, 6), (3, 6)]
    one = spark.range(1)
    made = helpers.copy_bounds((F.lit(-2), F.lit(0)), (F.lit(10), F.lit(4)), (F.lit(3), F.lit(-1)), (F.lit(6), F.lit(9)), (F.lit(0), F.lit(0), F.lit(8), F.lit(2)))
    assert one.select(*(made[c] for c in ("src_x", "dst_x", "width", "src_y", "dst_y", "height"))).first()[:] == (0, 5, 3, 1, 0, 2)


def test_missing_pixels_are_an_error(spark):
    whole = spark.createDataFrame([(1, x, y, 5) for x in range(4) for y in range(3)], "image_id long, x int, y int, g int")
    assert neighborhood.filtered(whole, "gauss3", ("g",)).count() == 12
    for gone in ("x <> 2", "y <> 1", "not (x = 1 and y = 1)"):
        for f in (lambda p: neighborhood.filtered(p, "gauss3", ("g",)), lambda p: neighborhood.rank(p, "median", 3, ("g",))):
            with pytest.raises(Exception, match="missing or repeated"):
                f(whole.where(gone)).collect()


def test_tiff_packings_tiles_and_depths(spark, tmp_path):
    noise = RNG.integers(0, 256, (70, 45, 4)).astype(np.uint8)
    soft = np.repeat(np.repeat(noise[:10, :9], 7, 0), 5, 1)
    for p in (noise, soft, noise[:1, :1], np.zeros((200, 300, 4), np.uint8)):
        for packing in codecs.TIFF_PACKING:
            for tile in (0, 16, 64):
                assert (codecs.tiff_decode(codecs.tiff_encode([p, p[:1]], packing, tile))[0] == p).all(), (packing, tile, p.shape)
    for k, (packing, tile) in enumerate((("lzw", 0), ("lzw", 32), ("zlib", 16))):  # another library reads them
        (tmp_path / f"{k}.tiff").write_bytes(codecs.tiff_bytes([noise[..., 1:]], packing, tile))
    for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect():
        assert (np.frombuffer(bytes(r.data), np.uint8).reshape(70, 45, 3)[..., ::-1] == noise[..., 1:]).all()
    wide = RNG.integers(0, 65536, (5, 4, 3)).astype("<u2")
    assert deep.tiff_read(codecs.tiff_bytes([wide], "lzw"))[0][3] == wide[..., ::-1].tobytes()
    big = b"MM\0*" + codecs.tiff_bytes([wide])[4:]
    assert deep.decode(spark.createDataFrame([("x.tif", big)], "path string, content binary")).first().error
