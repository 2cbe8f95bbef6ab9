from __future__ import annotations

import hashlib

from runsieve.llm import merkle

SCHEMA = "page_id long, url string, html string, k string, p int, archive string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 0, "x") for i, u, h in rows], SCHEMA)


ROWS = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(600)] + [
    (None, None, None), (None, "http://n", ""), (7, "http://x/7", "<p>7</p>" * 2), (-5, "http://neg", "é" * 50),
]


def test_equal_replicas_need_no_descent(spark):
    found = merkle.audit(pages(spark, ROWS), pages(spark, ROWS[::-1]))
    volumes = found["volumes"].collect()
    assert len(volumes) == 5  # three of the keys, one of negative keys, one without
    assert all(v.ours == v.theirs for v in volumes)
    assert found["damage"].count() == 0


def test_damage_is_located(spark):
    other = [row for row in ROWS if row[0] != 17]
    other[40] = (*other[40][:2], "changed")
    other += [(300, "http://x/300#copy", "more"), (None, "http://n", ""), (9000, "http://new", "")]
    found = merkle.audit(pages(spark, ROWS), pages(spark, other))
    damage = {(r.k, r.status) for r in found["damage"].collect()}
    assert damage == {
        (17, "missing"), (other[40][0], "altered"), (300, "extra"), (None, "altered"), (9000, "extra"),
    }
    report = merkle.report(pages(spark, ROWS), pages(spark, other)).collect()
    assert sum(r.damaged for r in report) == 5
    for row in report:
        assert (row.root == row.replica_root) == (row.damaged == 0)
        assert (row.damage == "") == (row.damaged == 0)


def test_leaf_and_offsets_against_plain_python(spark):
    rows = sorted(ROWS[:20])
    placed = merkle.leaves(pages(spark, rows), pages(spark, rows)).filter("side = 0").orderBy("k").collect()
    start = 0
    for row, (key, url, html) in zip(placed, rows):
        whole = (
            f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {key}\r\nWARC-Target-URI: {url}\r\n"
            f"Content-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n"
        ).encode()
        assert row.record == hashlib.sha256(whole).hexdigest()
        assert (row.start, row.size) == (start, len(whole))
        start += len(whole)


def test_volumes_split_a_hot_archive(spark):
    rows = [(1, f"http://x/{i}", "same") for i in range(400)]
    placed = merkle.leaves(pages(spark, rows), pages(spark, rows[:-1]), capacity=50)
    sizes = [r["count"] for r in placed.filter("side = 0").groupBy("volume").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100


def test_empty_tables(spark):
    none = pages(spark, [])
    assert merkle.report(none, none).count() == 0
    assert merkle.report(pages(spark, ROWS[:3]), none).first().damaged == 3
