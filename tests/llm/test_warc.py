import base64
import gzip
import hashlib
import io

import pytest

from tidemark.llm import warc


def brute(rows):
    lead = {}
    for i, _, h in rows:
        p = (h or "").encode()
        lead[p] = max(lead.get(p, -1), -1 if i is None else i)
    out, seen = [], set()
    for i, _, h in rows:
        p = (h or "").encode()
        first = (-1 if i is None else i) == lead[p] and p not in seen
        if first:
            seen.add(p)
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((str(i), len(p), digest, "response" if first else "revisit", str(None if first or lead[p] < 0 else lead[p])))
    return sorted(out)


def got(spark, df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.round_trip(df, warc.archive_folder(spark)).collect())


def test_round_trip(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(9001, "u", None), (9002, None, ""), (9003, "é\r\nX: y", "é" * 200_000), (9004, "v", "é" * 200_000), (None, "w", "own"), (9005, "a", "twice"), (9005, "b", "twice"), (9005, "b", "twice"), (9006, "a", rows[0][2])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, size int, kind string")
    assert got(spark, df) == brute(rows)
    assert got(spark, df.limit(0)) == []


def test_ids_of_any_text(spark):
    odd = [None, "null", "~", "%7E", "a b", "a+b", "x>y\r\nZ: 1", "é:3", ""]
    rows = [(i, "u", f"page {k}") for k, i in enumerate(odd)] + [(None, f"v{k}", "") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    back = warc.round_trip(df.repartition(3), warc.archive_folder(spark)).collect()
    own = [r for r in back if r.payload_bytes]
    assert sorted(str(r.page_id) for r in own) == sorted(map(str, odd)) and all(r.record_type == "response" for r in own)
    empty = [r for r in back if not r.payload_bytes]
    assert [r.page_id for r in empty] == [None] * 40 and sum(r.record_type == "response" for r in empty) == 1


def test_reader_steps_and_faults():
    blocks = [b"", b"abc\r\n\r\n" * 50_000, b"x"]
    data = b"".join(warc.member("response", f"urn:page:{i}:0", "http://a/", b, warc.sha1_base32(b)) for i, b in enumerate(blocks))
    for step in (1 << 20, 7) if len(data) < 50_000 else (1 << 20, 97):
        assert [b for _, b in warc.read_records(io.BytesIO(data), step=step)] == blocks
    for bad in (data[:-3], data + b"junk", gzip.compress(gzip.decompress(data).replace(b"Content-Length: 1", b"Content-Length: 9")), gzip.compress(b"WARC/1.1\r\n\r\n"), warc.member("response", "r", None, b"abc", warc.sha1_base32(b"abd"))):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
