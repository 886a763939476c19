import numpy as np
import pytest

from tessella.sources import codecs, images
from tessella.streaming import files as streams

RNG = np.random.default_rng(1)


def picture(h, w, alpha=False):
    p = RNG.integers(0, 256, (h, w, 4)).astype(np.uint8)
    p[h // 2 :] = p[0, 0]
    if not alpha:
        p[..., 0] = 255
    return p


@pytest.mark.parametrize("codec", [c for c in codecs.CODECS if c.encode], ids=lambda c: c.name)
@pytest.mark.parametrize("size", [(1, 1), (3, 5), (8, 8), (17, 9), (64, 2)])
def test_round_trip(codec, size):
    for alpha in (False, True):
        p = picture(*size, alpha)
        raw = codec.encode([p])
        assert codecs.detect(raw, f"x.{codec.extensions[0]}") is codec
        got, want = codec.decode(raw)[0].astype(int), p.astype(int)
        if codec.name in ("ppm", "pfm", "hdr", "pgm"):
            want[..., 0] = 255
        if codec.name == "pgm":
            want[..., 1:] = np.rint(p[..., 1:] @ np.array([0.299, 0.587, 0.114]))[..., None]
        if codec.name == "xpm":  # alpha is all or nothing
            want[want[..., 0] == 0] = 0
            want[..., 0][want[..., 0] > 0] = 255
        if codec.name == "gif":
            want[want[..., 0] < 128] = 0
            want[..., 0][want[..., 0] >= 128] = 255
            assert (got[..., 0] == want[..., 0]).all()
            if len(np.unique(p.reshape(-1, 4)[:, 1:], axis=0)) > 255:
                continue
        assert np.abs(got - want).max() <= (2 if codec.name == "hdr" else 0)


def test_frames_and_runs():
    frames = [picture(4, 6, True) for _ in range(3)]
    assert all((a == b).all() for a, b in zip(codecs.png_decode(codecs.png_encode(frames)), frames, strict=True))
    for name in ("gif", "tiff"):
        codec = next(c for c in codecs.CODECS if c.name == name)
        flat = [np.where(f[..., :1] < 128, 0, f | np.array([255, 0, 0, 0], np.uint8)).astype(np.uint8) for f in frames]
        assert all((a == b).all() for a, b in zip(codec.decode(codec.encode(flat)), flat, strict=True))
    p = picture(9, 300)
    assert (codecs.tga_decode(codecs.tga_encode([p], runs=True))[0] == p).all()


def test_textures():
    p = picture(16, 8, True)
    levels = [p, p[::2, ::2].copy(), p[::4, ::4].copy()]
    assert all((a == b).all() for a, b in zip(codecs.dds_decode(codecs.dds_encode(levels)), levels, strict=True))
    flat = np.zeros((8, 8, 4), np.uint8) + np.array([255, 255, 0, 0], np.uint8)
    for kind in ("DXT1", "DXT3", "DXT5"):
        assert (codecs.dds_decode(codecs.dds_encode([flat], kind))[0] == flat).all()
    assert codecs.dds_sizes(8, 8, 4, 3, 1) == [(8, 8)] * 4 + [(4, 4)] * 2 + [(2, 2)]
    assert len(codecs.dds_sizes(8, 8, 1, 2, 6)) == 12


def test_compressed_numbers():
    data = bytes(RNG.integers(0, 4, 20_000).astype(np.uint8)) + bytes(RNG.integers(0, 256, 20_000).astype(np.uint8))
    assert codecs.lzw_decode(codecs.lzw_encode(data, 8), 8, len(data)) == data


def test_text_maps_and_old_headers():
    assert codecs.pnm_decode(b"P2\n# note\n2 1\n15\n0 15\n")[0][0, :, 1].tolist() == [0, 255]
    assert codecs.pnm_decode(b"P1\n3 1\n1 0 1\n")[0][0, :, 1].tolist() == [0, 255, 0]
    assert codecs.pnm_decode(b"P4\n3 1\n\xa0")[0][0, :, 1].tolist() == [0, 255, 0]
    assert codecs.pnm_decode(b"P5\n1 1\n65535\n\xff\xff")[0][0, 0].tolist() == [255] * 4
    with pytest.raises(codecs.CodecError):
        codecs.pnm_decode(b"P6\n9 9\n255\nxx")


def test_files_pixels_and_back(spark, tmp_path):
    pictures = {f"i{k}.{c}": picture(5 + k, 7) for k, c in enumerate(("png", "bmp", "qoi", "tga"))}
    rows = [(n, p.shape[1], p.shape[0], p.tobytes()) for n, p in pictures.items()]
    table = spark.createDataFrame(rows, "name string, width int, height int, bits binary")
    for kind in ("png", "bmp", "qoi", "tga"):
        images.write_files(images.encode(table.where(f"name like '%.{kind}'"), kind, "name"), str(tmp_path / "in"))
    (tmp_path / "in" / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (tmp_path / "in" / "empty.bmp").write_bytes(b"")
    frames = images.read(spark, str(tmp_path / "in"))
    got = {r.path.rpartition("/")[2]: r for r in frames.collect()}
    assert got["broken.png"].error and len(got) == 5  # Spark lists no files without bytes
    assert all(bytes(got[n].bits) == p.tobytes() for n, p in pictures.items())
    kinds = {r.path.rpartition("/")[2]: r.format for r in images.detect(images.files(spark, str(tmp_path / "in"))).collect()}
    assert kinds["i1.bmp"] == "bmp" and kinds["broken.png"] == "png"
    nothing = spark.createDataFrame([("a", b""), ("b", None), (None, b"GIF")], "path string, content binary")
    assert all(r.error for r in images.decode(nothing).collect())
    px, fast = images.to_pixels(frames, ["path"]), images.to_pixels_fast(frames, ["path"], rows=10)
    assert sorted(map(tuple, px.collect())) == sorted(map(tuple, fast.collect()))
    back = {r.path.rpartition("/")[2]: bytes(r.bits) for r in images.from_pixels(px, "path").collect()}
    assert back == {n: p.tobytes() for n, p in pictures.items()}


def test_raw(spark):
    p = picture(4, 3, True)
    table = spark.createDataFrame([(1, 3, 4, p.tobytes())], "image_id long, width int, height int, bits binary")
    for kind in images.RAW:
        raw = images.write_raw(table, "image_id", kind, 7, 20).selectExpr("'x' path", "content")
        got = np.frombuffer(images.read_raw(raw, 3, 4, kind, 7, 20).first().bits, np.uint8).reshape(4, 3, 4)
        assert len(raw.first().content) == 7 + 4 * 20
        assert kind == "Gray8" or (got[..., 1:] == p[..., 1:]).all()


def test_stream(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.qoi").write_bytes(codecs.qoi_encode([picture(2, 2)]))
    query = streams.format_counts(streams.frames(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        query.processAllAvailable()
        assert [tuple(r) for r in spark.sql("select format, n_frames, n_bytes, n_errors from counts").collect()] == [("qoi", 3, 48, 0)]
    finally:
        query.stop()
