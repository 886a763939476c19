import hashlib
import zlib

from tessella.llm import webarchive as w


def brute(rows):
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(raw)
        revisit = to is not None and to != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return out


def key(t):
    return tuple((x is not None, x) for x in t)


ROWS = [
    (5, "https://www.Example.com/en/1", "<p>é</p>" * 30), (3, "http://b.example.com", "<p>é</p>" * 30), (9, None, "<p>é</p>" * 30),
    (1, "no scheme", "short"), (2, "http://a.com/x y\nz", "short"), (4, "http://a.com/", None), (6, "http://a.com/", ""),
    (7, "http://a.com/big", "line\r\n\r\n" * 200_000), (8, "http://a.com/x", "z" * 99), (10, "http://a.com/x", "z" * 99),
    (11, "http://a.com/x", "z" * 100), (12, "http://a.com/y", "z" * 100), (13, "http://a.com/rep", "same " * 50), (13, "http://a.com/rep", "same " * 50), (None, "http://a.com/null", "null id"),
]


def run(spark, rows, tmp_path, **how):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string").drop("key")
    folder = f"file://{tmp_path}/warc"
    captures = w.write_archives(pages, folder)
    return folder, w.build_index(captures, folder, **how), pages


def test_round_trip(spark, tmp_path):
    folder, top, pages = run(spark, ROWS, tmp_path, block_lines=2)
    found = w.lookup(pages.select(w.capture_key().alias("key")), folder, top).collect()
    got = []
    for r in found:
        to = r.refers_to and int(r.refers_to[10:-1])
        raw = bytes(r.payload) if r.payload is not None else None
        assert raw is None or (len(raw) == r.payload_bytes and "sha256:" + hashlib.sha256(raw).hexdigest() == r.payload_digest)
        got.append((None if "null" in r.record_id else int(r.record_id[10:-1]), r.payload_bytes, r.payload_digest[7:], r.record_type, to))
    assert sorted(got, key=key) == sorted(brute(ROWS), key=key)


def test_index_finds_every_key_and_no_other(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.org/{i % 11}", "x" * i) for i in range(300)]
    folder, top, pages = run(spark, rows, tmp_path, block_lines=3)
    index = w.Index(folder, top)
    for r in pages.select("page_id", w.capture_key().alias("key")).collect():
        (place,) = index.find(r.key.encode())
        head, body = index.record(place)
        assert head["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and body == b"x" * r.page_id
        assert index.find(r.key.encode() + b"0") == index.find(r.key.encode()[:-1]) == []
    assert index.find(b"") == index.find(b"\xff") == []
    missing = w.lookup(spark.createDataFrame([("zz",)], "key string"), folder, top).collect()
    assert missing[0].record_type is None


def test_equal_keys_over_several_blocks(spark, tmp_path):
    folder, top, pages = run(spark, [(1, "http://a.com/", "same")] * 9 + [(0, "http://a.com/", "other")], tmp_path, block_lines=2)
    assert len(w.Index(folder, top).find(b"com,a)/ 00000000000000000001")) == 9
    assert w.lookup(pages.select(w.capture_key().alias("key")), folder, top).where("record_type = 'response'").count() == 10


def test_archives_are_plain_gzip(spark, tmp_path):
    run(spark, ROWS, tmp_path)
    whole = b""
    for path in (tmp_path / "warc").glob("*.warc.gz"):
        raw = path.read_bytes()
        while raw:
            d = zlib.decompressobj(31)
            whole += d.decompress(raw) + d.flush()
            raw = d.unused_data
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS) and whole.count(b"WARC-Type: revisit") == 3


def test_keys(spark):
    urls = ["https://www.Example.com/En?q#f", "http://a.b.c", None, "no scheme", "/a://b"]
    df = spark.createDataFrame([(u, 7) for u in urls], "url string, page_id long")
    assert [r[0][:-21] for r in df.select(w.capture_key()).collect()] == ["com,example,www)/En?q#f", "c,b,a)", ")", ")no%20scheme", ")/a://b"]


def test_empty(spark, tmp_path):
    folder, top, pages = run(spark, [], tmp_path)
    assert top == [] and w.lookup(pages.select(w.capture_key().alias("key")), folder, top).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, w.op1_warc(spark, sf).collect())) == sorted(brute(rows))


def test_control_characters_anywhere(spark, tmp_path):
    """No page is lost by a character that index lines are split at."""
    marks = [chr(c) for c in [*range(1, 33), 127, 0x85, 0x2028]]
    rows = [(3 * i + k, u.replace("*", m), f"p{i}") for i, m in enumerate(marks) for k, u in enumerate(("http://exa*mple.com/x", "http://h.org/a*b", "http://h.org/?q=*"))]
    folder, top, pages = run(spark, rows, tmp_path, block_lines=4)
    found = w.lookup(pages.select(w.capture_key().alias("key")), folder, top).collect()
    assert sorted(r.record_id for r in found) == sorted(f"<urn:page:{i}>" for i, _, _ in rows)
    assert {r.record_id: bytes(r.payload).decode() for r in found} == {f"<urn:page:{i}>": h for i, _, h in rows}


def test_hot_payload_takes_the_broadcast_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "HOT", 3)
    rows = [(i, f"http://a.com/{i}", "hot " * 40 if i % 3 else f"own {i} " * 30 if i % 2 else "few " * 40) for i in range(1, 60)][:40]
    rows += [(50, "http://a.com/f", "two " * 40), (51, "http://a.com/g", "two " * 40), (51, "http://a.com/g", "two " * 40)]
    got = w.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {(i, t): to for i, _, _, t, to in brute(rows)}
    assert len(got) == len(rows) and all(r._first == want[r.page_id, "revisit" if r._revisit else "response"] for r in got)


def test_folders():
    import pytest

    assert w.file_system("file:/tmp/x")[1] == w.file_system("file:///tmp/x")[1] == w.file_system("/tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="viewfs"):
        w.file_system("viewfs://in/x")


def test_many_partitions_make_few_files(spark, tmp_path):
    """Files of Spark's writers cost forks of the executor; their number doesn't follow the shuffle's partitions."""
    from pathlib import Path

    from tessella.llm._shared import shared_dir

    rows = [(i, f"http://h{i % 9}.org/{i}", f"page {i % 150} " * 20) for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    shared, few = Path(shared_dir(spark).removeprefix("file:")), 2 * spark.sparkContext.defaultParallelism
    before = set(shared.glob("*/part-*"))
    set_to = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in set_to}
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        made = w.op1_warc(spark, str(tmp_path))
        made.write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=key) == sorted(brute(rows), key=key)
    assert len(list(tmp_path.glob("out/part-*"))) <= few
    assert len(set(shared.glob("*/part-*")) - before) <= few + 1  # the responses' ids, and the digests of one file


def test_captures_of_other_attempts_are_not_read(spark, tmp_path):
    folder, _, pages = run(spark, ROWS, tmp_path)
    again = w.write_archives(pages, folder)  # beside those of the first run
    assert again.count() == len(ROWS) and len(list((tmp_path / "warc").glob("captures-*"))) > len(set(again.inputFiles()))
