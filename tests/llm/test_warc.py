import gzip
import hashlib
import io

import pytest

from factloom.llm import warc as w
from factloom.llm.common import scratch_path

BIG = "größe " * 40_000
ROWS = [
    (5, "http://a/5", "x" * 120), (3, "http://a/3", "x" * 120), (9, None, "x" * 120), (None, "http://a/n", "x" * 120), (1, "http://a\r\nX: y", "x" * 99), (2, "u", "x" * 99),
    (4, "u", None), (6, "u", ""), (7, "é", BIG), (8, "u", BIG), (3, "http://a/3", "x" * 120), (10, "u", "WARC/1.1\r\nContent-Length: 9\r\n\r\n" * 9),
]


def brute(rows):
    firsts = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(firsts.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = firsts.get(h or "")
        again = len(data) >= 100 and first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("few", [0, 10])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(w, "FEW", few)
    monkeypatch.setattr(w, "SPREAD", 2)
    pages(spark, ROWS).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, w.op9_warc(spark, str(tmp_path)).collect()), key=str) == brute(ROWS)


def test_round_trip_of_chunks(spark):
    manifest = w.write_archives(w.decided(pages(spark, ROWS)), scratch_path(spark, "warc-test"), chunk=1000)
    rows = w.read_archives(manifest, chunk=777).collect()
    assert max(len(r.chunk) for r in rows) <= 777
    whole = {}
    for r in sorted(rows, key=lambda r: r.chunk_no):
        whole.setdefault((r.page_id, r.record_type, r.url), []).append(r)
    big = whole[7, "response", "é"]
    data = b"".join(r.chunk for r in big)
    assert data == BIG.encode() and [r.chunk_no for r in big] == list(range(len(big))) and [r.last for r in big].count(True) == 1
    at = 0
    for r in big:
        at += len(r.chunk)
        assert r.bytes_so_far == at and r.digest_so_far == hashlib.sha256(data[:at]).hexdigest()
    assert whole[1, "response", "http://a X: y"]


def test_record_ids_are_unique_where_page_ids_repeat(spark):
    rows = [(i, u, t) for i, u, t in ROWS for _ in range(3)]
    ends = w.read_archives(w.write_archives(w.decided(pages(spark, rows)), scratch_path(spark, "warc-ids"))).where("last").collect()
    assert len(ends) == len(rows) == len({r.record_id for r in ends})


def test_damage_is_an_error():
    record = w._header({"id": 1, "url": "u", "bytes": 5, "digest": hashlib.sha256(b"hello").hexdigest(), "record_type": "response", "refers_to": None})
    list(w.read_records(io.BytesIO(record + b"hello\r\n\r\n")))
    for bad in (record + b"hellO\r\n\r\n", record + b"hel", b"junk\r\n"):
        with pytest.raises(ValueError):
            list(w.read_records(io.BytesIO(bad)))
    members = gzip.compress(record + b"hello\r\n\r\n") * 2
    assert len(list(w.read_records(gzip.GzipFile(fileobj=io.BytesIO(members))))) == 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert w.op9_warc(spark, str(tmp_path)).count() == 0
