import hashlib
import io

import pytest

from reelsift.llm import warc as A

PAGES = "page_id long, url string, html string, chunk int, _digest string"


def brute(rows):
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = best.get(b) if i is not None and b in best and i < best[b] else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_round_trip_equals_brute_force(spark, tmp_path):
    same, short = "same page é " * 200, "short"
    rows = [(1, "http://a/1", same), (5, "http://a/5", same), (9, None, same), (9, None, same), (2, "u", short), (3, "u", short), (4, "u", None), (6, "", ""), (7, "bad\r\nurl %41", "x" * 1000),
            (8, "u", "x" * 1000), (10, "u", "y" * 3_000_000 + "\r\n\r\nWARC/1.1\r\n"), (None, "u", same), (-3, "u", "x" * 999)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], PAGES).repartition(3)
    shards = A.write(df, str(tmp_path / "w")).collect()
    assert sum(s.n_records for s in shards) == len(rows)
    chunks = A.read(spark, str(tmp_path / "w"), shards).collect()
    last = [r for r in chunks if r.last]
    assert sorted(((r.page_id, r.bytes_so_far, r.sha1_so_far, r.record_type, r.refers_to) for r in last), key=repr) == brute(rows)
    big = sorted((r for r in chunks if r.page_id == 10), key=lambda r: r.chunk)
    assert [r.chunk for r in big] == [0, 1, 2] and b"".join(bytes(r.data) for r in big).decode() == rows[10][2] and max(len(r.data) for r in big) <= A.CHUNK
    assert {r.url for r in chunks if r.page_id == 7} == {"bad\r\nurl %41"} and {r.url for r in chunks if r.page_id == 9} == {None}


def test_headers_are_read_alike_by_others(spark, tmp_path):
    """URIs are written as they are, and no two records have one id, nor does any refer to one that isn't there."""
    import gzip
    import re

    same = "same page " * 200
    rows = [(1, "http://a/x%20y?q=%C3%A9", same), (9, "http://a/ b", same), (9, "u", same), (9, "u", "other"), (None, "u", "x"), (None, "u", "x"), (3, "u", "z" * 1000), (4, "u", "z" * 1000)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], PAGES).repartition(2)
    shards = A.write(df, str(tmp_path / "w")).collect()
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz"))).decode()
    ids = re.findall("WARC-Record-ID: (<.*>)", text)
    assert len(set(ids)) == len(ids) == len(rows) and set(re.findall("WARC-Refers-To: (<.*>)", text)) == {"<urn:x-page:4>"}
    assert "WARC-Target-URI: http://a/x%20y?q=%C3%A9\r\n" in text and "WARC-Target-URI: http://a/%20b\r\n" in text
    got = [(r.page_id, r.url) for r in A.read(spark, str(tmp_path / "w"), shards, data=False).where("last").collect()]
    assert sorted(got, key=repr) == sorted(((i, u) for i, u, _ in rows), key=repr)


def test_empty_table(spark, tmp_path):
    shards = A.write(spark.createDataFrame([], PAGES), str(tmp_path / "e")).collect()
    assert A.read(spark, str(tmp_path / "e"), shards).count() == 0


def test_damaged_archives_are_errors():
    out = io.BytesIO()
    payload = b"payload" * 500
    A.write_record(out, 1, "http://a", payload, hashlib.sha1(payload).hexdigest(), None)
    assert [r["bytes_so_far"] for r in A.read_chunks(io.BytesIO(out.getvalue()))] == [3500]
    with pytest.raises(ValueError, match="ends within"):
        list(A.read_chunks(io.BytesIO(out.getvalue()[:-40])))
    wrong = io.BytesIO()
    A.write_record(wrong, 1, "http://a", payload, hashlib.sha1(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        list(A.read_chunks(io.BytesIO(wrong.getvalue())))
