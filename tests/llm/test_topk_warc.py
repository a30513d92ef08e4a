"""Operators 9 and 10: brute force and round trips."""

import base64
import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.llm import topk, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, by):
    """Every row that takes part is a candidate, and a query if its id is divisible; scores are integers of any length."""
    live = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            live.append((i, [int(x) for x in np.floor(256 * np.float32(v).astype(np.float64))]))
    out = []
    for q, v in live:
        if q % by == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(v, x)), -(2**63)), 2**63 - 1), i) for i, x in live if i != q)[:k]
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("n,seed", [(3, 1), (40, 2), (700, 3)])
def test_matches_all_pairs(spark, n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), [float(x) for x in (centres[i % 6] + rng.normal(size=12) * 0.3) * (0.2 + (i % 7))]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, sample=64, cells=4).collect())
    assert got == brute(rows, 5, 10)


def test_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 30)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=5)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, sample=50, cells=3).collect()) == brute(rows, 5, 10)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0]), (10, []), (7, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rows, 5, 10)
    # (1, 2) has 5 x 65536 with each of the two rows of 6, 3 with (3), nothing with (-1, 0.5) and the empty vector.
    assert [x for x in got if x[0] == 0] == [(0, 1, 6, 5 << 16), (0, 2, 6, 5 << 16), (0, 3, 5, 3 << 16), (0, 4, 7, 0), (0, 5, 10, 0)]
    assert topk.top_k(df.where("1 = 0"), F.lit(True)).count() == 0


def test_repeats_and_large_components(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.25, 1.0]), (3, [1e8, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert [x[2] for x in got] == [3, 1, 1, 2] and got == brute(rows, 5, 50)
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(-2, 12)]) for i in range(200)]
    rows += [(200, [3e38] * 4), (201, [-3e38] * 4), (202, [3e38, -3e38, 3e38, -3e38]), *rows[:20], *rows[10:12]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, sample=30, cells=4).collect())
    assert got == brute(rows, 5, 10)


def test_blocks_hold_few_queries(monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 10)
    pivots = np.random.default_rng(1).normal(size=(6, 3))
    counts = {0: 3, 1: 4, 2: 25, 3: 9, 5: 10}
    got = topk.query_blocks(counts, pivots)
    load = {}
    for c, (a, n) in got.items():
        assert n == -(-counts[c] // 10)
        for k in range(a, a + n):
            load[k] = load.get(k, 0) + counts[c] / n
    assert set(got) == set(counts) and max(load.values()) <= 10 and sorted(load) == list(range(len(load)))
    assert topk.query_blocks({c: 2 for c in range(5)}, pivots) == {c: (0, 1) for c in range(5)}


def test_one_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 100)
    rng = np.random.default_rng(8)
    rows = [(int(i), [1.0, 2.0, 3.0] if i % 3 else [float(x) for x in rng.normal(size=3)]) for i in range(900)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, sample=50, cells=3).collect()) == brute(rows, 5, 50)


def pages(spark):
    big = "x" * 300_000
    rows = [(5, "http://a/5", "<p>one</p>"), (2, "http://a/2 b", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "u3", None), (4, "u4", ""), (7, "u7", big), (8, "u8", "é\r\n\r\nWARC/1.1\r\n"), (8, "u8", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "<p>one</p>"), (None, None, "alone"), (1, "c\r\nX: y", big + "y")]
    return spark.createDataFrame([(i, u, h, 1, "z") for i, u, h in rows], "page_id long, url string, html string, shard int, digest string"), rows


def expected(rows, least):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        first = min(same) if same and len(b) >= least else None
        again = first is not None and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,shard,roll", [(0, 1 << 20, 1 << 20), (20, 200_000, 300), (0, 1000, 1)])
def test_round_trip(spark, tmp_path, least, shard, roll):
    df, rows = pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write_pages(df, path, shard_bytes=shard, roll_bytes=roll, least_bytes=least)
    back = warc.read_records(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == expected(rows, least)
    assert all(r.block_digest_ok for r in back)
    files = json.loads((tmp_path / "w" / "_manifest.json").read_text())["files"]
    assert sum(f["records"] for f in files) == len(rows) and not (tmp_path / "w" / "_temporary").exists()
    assert {p.name for p in (tmp_path / "w").iterdir()} == {f["file"] for f in files} | {"_manifest.json"}
    for f in files:
        raw = (tmp_path / "w" / f["file"]).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] and gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    warc.write_pages(df.repartition(3), f"file://{tmp_path}/again", shard_bytes=shard, roll_bytes=roll, least_bytes=least)
    assert (tmp_path / "again" / "_manifest.json").read_text() == (tmp_path / "w" / "_manifest.json").read_text()


def test_nothing_to_write(spark, tmp_path):
    df, _ = pages(spark)
    warc.write_pages(df.where("1 = 0"), f"file://{tmp_path}/w")
    assert warc.read_records(spark, f"file://{tmp_path}/w").count() == 0


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    df, _ = pages(spark)
    warc.write_pages(df, f"file://{tmp_path}/w")
    f = next((tmp_path / "w").glob("*.gz"))
    f.write_bytes(f.read_bytes()[:-40])
    with pytest.raises(Exception, match="EOF|cut off|Compressed|incomplete"):
        warc.read_records(spark, f"file://{tmp_path}/w").collect()


def test_shards_follow_the_bytes(spark, tmp_path):
    """Page_ids at both ends, one far outlier, and a third of all rows with one page_id or none."""
    html = lambda i: f"<p>{i}</p>" + "x" * 5000
    rows = [(i, html(i)) for i in range(300)] + [(1 << 60, html(-1)), (-(2**63), html(-2)), (2**63 - 1, html(-3))]
    rows += [(7, html(1000 + i)) for i in range(100)] + [(None, html(2000 + i)) for i in range(100)]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    warc.write_pages(df, f"file://{tmp_path}/w", shard_bytes=100_000, roll_bytes=1 << 30)
    back = warc.read_records(spark, f"file://{tmp_path}/w")
    assert sorted(map(str, (r.page_id for r in back.collect()))) == sorted(str(i) for i, _ in rows)
    sizes = [r["c"] for r in back.groupBy("file").agg(F.count(F.lit(1)).alias("c")).collect()]
    assert len(sizes) > 25 and max(sizes) <= 20
    order = [r for r in back.select("file", "page_id").orderBy("file").collect()]
    ends = {}
    for r in order:
        key = -(2**64) if r.page_id is None else r.page_id
        a, b = ends.get(r.file, (key, key))
        ends[r.file] = (min(a, key), max(b, key))
    ends = [ends[f] for f in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_an_archive_is_not_written_over(spark, tmp_path):
    df, rows = pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write_pages(df, path, shard_bytes=1000, roll_bytes=1)
    with pytest.raises(Exception, match="holds an archive already"):
        warc.write_pages(df, path)
    warc.write_pages(df.where("page_id = 5"), path, mode="overwrite")
    assert [r.page_id for r in warc.read_records(spark, path).collect()] == [5] and len(list((tmp_path / "w").glob("*.gz"))) == 1


def test_a_replaced_file_is_an_error(spark, tmp_path):
    df, _ = pages(spark)
    warc.write_pages(df, f"file://{tmp_path}/w")
    warc.write_pages(df.where("page_id = 5"), f"file://{tmp_path}/other")
    next((tmp_path / "w").glob("*.gz")).write_bytes(next((tmp_path / "other").glob("*.gz")).read_bytes())
    with pytest.raises(Exception, match="doesn't match the manifest"):
        warc.read_records(spark, f"file://{tmp_path}/w").collect()


def test_only_empty_vectors_and_vectors_of_one_value(spark):
    """All scores are equal, so ties decide; fewer different vectors than cells."""
    for v in ([], [1.0, 2.0]):
        df = spark.createDataFrame([(k, v) for k in range(60)], "vec_id long, embedding array<float>")
        got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=3, cells=4).collect())
        score = sum(int(256 * x) ** 2 for x in v)
        assert got == [(0, 1, 1, score), (0, 2, 2, score), (0, 3, 3, score), (50, 1, 0, score), (50, 2, 1, score), (50, 3, 2, score)]
