import gzip
import hashlib

import pytest

from glyphmill.llm import files
from glyphmill.llm import warc as W
from glyphmill.llm.common import work_dir


@pytest.mark.parametrize("roll", [W.ROLL_BYTES, 500])
def test_round_trip(spark, roll):
    big, other = "é" * 60, "z" * 100
    rows = [(i, f"http://x/{i}", p, 1) for i, p in enumerate([None, "", "short", "short", big, other, big, "y" * 99, "y" * 99, big, other])]
    rows += [(20, None, big, 1), (20, None, big, 1), (None, "http://n/", big, 1), (30, "http://u/\r\nx", "q" * 5000, 1), (40, "http://same/", "w" * 300, 1), (40, "http://same/", "w" * 300, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    folder = work_dir(spark, "w")
    W.write(pages, folder, roll=roll)
    files.put(folder, "pages-000000-0000-orphan.warc.gz", b"left by a lost task")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read(spark, folder).collect()), key=repr)
    want, first = [], {}
    for i, _, p, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        p = (p or "").encode()
        dup = len(p) >= 100 and p in first
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if dup else "response", first[p] if dup else None))
        first.setdefault(p, i)
    assert got == sorted(want, key=repr)


def test_damage_and_gzip():
    data = W.member(W.record(1, "http://a/", b"body" * 50, hashlib.sha256(b"body" * 50).hexdigest(), None, "", W.DATE))
    assert data == W.member(W.record(1, "http://a/", b"body" * 50, hashlib.sha256(b"body" * 50).hexdigest(), None, "", W.DATE))
    raw = gzip.decompress(data)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response")
    with pytest.raises(W.Broken):
        list(W.parse(W.member(raw.replace(b"bodybody", b"bodyBODY", 1))))


def test_empty(spark):
    folder = work_dir(spark, "w")
    W.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert W.read(spark, folder).count() == 0


def test_revisits_name_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a/", "p" * 200), (2, "http://b/", "p" * 200)], "page_id long, url string, html string")
    folder = work_dir(spark, "w")
    W.write(pages, folder)
    name = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    found = [h for r in name for h, _ in W.parse(files.read(folder, r.file))]
    first, again = sorted(found, key=lambda h: h["X-Page-ID"])
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == "http://a/"


def test_reading_is_dealt_to_many_tasks(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", str(i) * 300) for i in range(60)], "page_id long, url string, html string")
    folder = work_dir(spark, "w")
    W.write(pages, folder, roll=500)
    assert W.read(spark, folder).select("file").distinct().count() > 10
    assert W.read(spark, folder).rdd.getNumPartitions() > 10


def test_truncated():
    data = W.member(W.record(1, "http://a/", b"x" * 300, hashlib.sha256(b"x" * 300).hexdigest(), None, "", W.DATE))
    with pytest.raises(W.Broken):
        list(W.parse(data + data[:40]))
