"""Results on tables that are not as the small ones are, and plans whose work grows with the input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import arrow
from tessella.operators import analysis, drawing, geometry
from tessella.plans import catalog
from tessella.sources import formats, images

RNG = np.random.default_rng(11)
SF = "/root/testdata/sf0.001"


def against_sql(spark, folder, names):
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        if (folder / f"{table}.parquet").exists():
            con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    for name in names:
        got = sorted((tuple(r) for r in catalog.queries()[name](spark, str(folder)).collect()), key=key)
        want = sorted(con.execute(catalog.oracle_sql()[name]).fetchall(), key=key)
        assert got == want, name


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def relation(spark, pictures):
    rows = [(i, x, y, *map(int, p[y, x])) for i, p in enumerate(pictures) for y in range(p.shape[0]) for x in range(p.shape[1])]
    RNG.shuffle(rows)
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], "image_id long, x int, y int, a int, r int, g int, b int")


@pytest.mark.parametrize("ids", [[*range(11)], [*range(5), 6, 7, 9, 10, 13, 14, 16]])
def test_images_that_lack_frames(spark, tmp_path, ids):
    """The last image of a table has as many frames as there are left; SQL counts five frames in every image."""
    rows = [(i, [float(x) for x in RNG.random(64) - 0.5], 0) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    against_sql(spark, tmp_path, ["frames_set_count", "frames_truncate", "object_append", "object_insert_many"])


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(1, "a" * 100), (1, "bc" * 9), (2, ""), (3, None), (4, "xyz" * 700), (None, "no id"), (5, "q"), (4, "w")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_turned_documents_join_nothing(spark, odd_texts):
    names = ["flip_doc", "mirror_doc", "rotate90_doc", "rotate180_doc", "rotate270_doc"]
    against_sql(spark, odd_texts, names)
    assert not any("Join" in plan(catalog.queries()[n](spark, str(odd_texts))) for n in names)


def test_split_filled_joins_nothing(spark, odd_texts):
    against_sql(spark, odd_texts, ["split_filled"])
    assert "Join" not in plan(catalog.queries()["split_filled"](spark, str(odd_texts)))
    p = RNG.integers(0, 256, (37, 70, 4))
    px = relation(spark, [p]).where("not (x = 3 and y = 5)")
    for w, h in ((70, 50), (33, 40), (1, 3), (5, 1000)):
        got = {(r.chunk_x, r.chunk_y, r.x, r.y): (r.a, r.r, r.g, r.b) for r in geometry.split_filled(px, w, h, {"a": 1, "r": 2, "g": 3, "b": 4}).collect()}
        want = {}
        for cx in range(-(-70 // w)):
            for cy in range(-(-37 // h)):
                for x in range(w):
                    for y in range(h):
                        at = cy * h + y, cx * w + x
                        want[cx, cy, x, y] = tuple(p[at]) if at[0] < 37 and at[1] < 70 and at != (5, 3) else (1, 2, 3, 4)
        if (w, h) == (1, 3):  # the one chunk column that lacks a pixel still has two
            assert (3, 1, 0, 2) in got
        assert got == want


STEPS = ["convert_gray32", "convert_x8r8g8b8", "samples_index8_gray8", "samples_float_swapped", "deep_png_a16r16g16b16", "deep_png_index8", "set_pixel_32", "raw_a8r8g8b8", "raw_gray16", "codec_jpeg_gray", "codec_png", "codec_detect", "flood_fill", "skew_angle"]


@pytest.mark.parametrize("name", STEPS)
def test_one_worker_before_the_shuffle_and_one_after_it(spark, name):
    found = plan(catalog.queries()[name](spark, SF))
    assert found.count("MapInArrow") <= 2 and "FlatMapGroups" not in found


def test_small_shuffles_keep_their_partitions(spark):
    packed = images.from_pixels(relation(spark, [RNG.integers(0, 256, (2, 2, 4)) for _ in range(40)]))
    assert packed.select(F.spark_partition_id().alias("p")).distinct().count() > 1  # the work isn't one task's


def test_scattered_pixels_come_together(spark):
    pictures = [RNG.integers(0, 256, (h, w, 4)).astype(np.uint8) for h, w in ((1, 1), (30, 7), (3, 200), (16, 16))]
    px = relation(spark, pictures)
    for key, frame in (("image_id", px), ("image_id", px.withColumn("image_id", F.struct("image_id", F.lit(None).cast("string").alias("z"))))):
        for r in images.from_pixels(frame, key).collect():
            p = pictures[r.image_id if frame is px else r.image_id.image_id]
            assert (np.frombuffer(r.bits, np.uint8).reshape(r.height, r.width, 4) == p).all() and p.shape[:2] == (r.height, r.width)
    back = images.to_pixels_fast(formats.untyped(formats.typed(images.from_pixels(px))), ["image_id"], rows=50)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect()))


def test_parts_and_codes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"bits": [b"x" * n for n in (5, 0, 9, 1, 20, 1)] + [None]})
    found = list(arrow.parts(iter([batch]), "bits", 10))
    assert pa.Table.from_batches(found).to_pydict() == batch.to_pydict() and max(b.num_rows for b in found) <= 3
    s = pa.array([{"a": 1, "b": None}, {"a": 1, "b": None}, {"a": 2, "b": None}, {"a": 1, "b": 5}, None])
    c = arrow.codes(s)
    assert c[0] == c[1] and len(set(c.tolist())) == 4
    assert arrow.codes(pa.array([7, None, 7])).tolist() == [1, 0, 1]


def test_flood_by_runs(spark):
    pictures = [np.repeat(RNG.integers(0, 2, (h, w, 1)) * 9, 4, 2).astype(np.uint8) for h, w in ((9, 9), (1, 12), (20, 3), (15, 40))]
    got = {}
    for r in drawing.flood_fill(relation(spark, pictures), 0, 0, (1, 2, 3, 4)).collect():
        got[r.image_id, r.y, r.x] = (r.a, r.r, r.g, r.b)
    for i, p in enumerate(pictures):
        same, todo, seen = (p == p[0, 0]).all(2), [(0, 0)], set()
        while todo:
            y, x = todo.pop()
            if 0 <= y < p.shape[0] and 0 <= x < p.shape[1] and same[y, x] and (y, x) not in seen:
                seen.add((y, x))
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        for y in range(p.shape[0]):
            for x in range(p.shape[1]):
                assert got[i, y, x] == ((1, 2, 3, 4) if (y, x) in seen else tuple(p[y, x]))


def test_skew_of_tall_images_by_definition(spark):
    """As many angles at a time as memory allows."""
    p = np.full((12_000, 2, 4), 255, np.uint8)
    p[::40, :, 2] = 0
    small = np.where(RNG.random((25, 31, 1)) < 0.3, 0, 255).astype(np.uint8).repeat(4, 2)
    got = {r.image_id: r.angle for r in analysis.skew_angle(relation(spark, [p, small])).collect()}
    for k, q in enumerate((p, small)):
        under = np.concatenate([q[1:, :, 2], np.full((1, q.shape[1]), 255)])
        y, x = np.nonzero((q[..., 2] < 128) & (under >= 128))
        votes = {}
        for i in range(201):
            t = np.radians(i * 0.1 - 10)
            for d in np.floor(np.round(y * np.cos(t) - x * np.sin(t), 6)).astype(int).tolist():
                votes[i, d] = votes.get((i, d), 0) + 1
        lines = sorted(votes, key=lambda v: (-votes[v], *v))[:20]
        assert got[k] == pytest.approx(sum(i for i, _ in lines) / len(lines) * 0.1 - 10)
