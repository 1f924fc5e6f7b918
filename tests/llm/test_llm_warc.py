"""Archives written and read."""

import base64
import gzip
import hashlib

import pytest

from canvass.llm import warc

DATE = "2024-01-01T00:00:00Z"
PAGES = [(5, "http://x/5", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://x/2\r\nInjected: y", ""), (9, "u", None), (7, "u", "z" * 300_000),
         (3, "u", "a\r\n\r\nb"), (None, "u", "<p>é</p>"), (None, "u", "only"), (4, "u", "twice"), (4, "u", "twice")]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, content string, payload int")


def expected(least=0):
    first = {}
    for i, _, html in PAGES:
        body = (html or "").encode()
        known = first.get(body)
        first[body] = i if known is None else known if i is None else min(known, i)
    out = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        again = i != first[body] and len(body) >= least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((str(i), len(body), digest, "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((str(r["page_id"]), *tuple(r)[1:5]) for r in df.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    assert rows(warc.round_trip(frame(spark))) == expected()
    assert rows(warc.round_trip(frame(spark), 6)) == expected(6)
    assert warc.round_trip(frame(spark).limit(0)).count() == 0


def test_predicates_skip_payloads(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(frame(spark), path)
    everything = warc.read_archives(spark, path)
    assert everything.count() == len(PAGES)
    assert {r["target_uri"] for r in everything.collect()} == {"http://x/5", None, "http://x/2%0D%0AInjected: y", "u"}
    revisits = warc.read_archives(spark, path, {"warc_type": "revisit"}, {"target_uri": "http"})
    assert [(r["record_id"], r["refers_to"], r["payload"]) for r in revisits.collect()] == [("<urn:page:5>", "<urn:page:1>", None)]
    assert warc.read_archives(spark, path, {"record_id": ["<urn:page:3>", "<urn:page:7>"]}).count() == 2
    assert warc.read_archives(spark, path).filter("payload_length > 1000").count() == 1
    with pytest.raises(ValueError):
        warc.read_archives(spark, path, {"payload_length": "1"})


def test_a_frame_with_two_predicates_keeps_all_rows(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(frame(spark), path)
    everything = warc.read_archives(spark, path)
    both = everything.filter("warc_type = 'response'").unionByName(everything.filter("warc_type = 'revisit'"))
    assert both.count() == len(PAGES)
    two = warc.read_archives(spark, path, {"warc_type": "response"}).unionByName(warc.read_archives(spark, path, {"warc_type": "revisit"}))
    assert two.count() == len(PAGES)


def test_headers_of_the_format(spark, tmp_path):
    path = tmp_path / "a"
    warc.write_archives(frame(spark), str(path))
    assert not list((path / "_pending").iterdir())
    records = b"".join(gzip.decompress(f.read_bytes()) for f in path.glob("*.warc.gz")).split(b"WARC/1.1\r\n")[1:]
    assert len(records) == len(PAGES) and all(r.startswith(b"WARC-Date: 20") for r in records)
    for r in records:
        assert (b"WARC-Type: revisit" in r) == (b"WARC-Profile: http://netpreserve.org/" in r) == (b"msgtype" not in r)


def test_refused_payloads_are_not_inflated(tmp_path):
    """A member of which only the start is readable does, as long as its payload is not wanted."""
    row = dict.fromkeys(warc.FIELDS) | {"warc_type": "response", "record_id": "r", "payload": bytes(range(256)) * 4000, "payload_length": 1}
    good = warc.member(warc.record_of(row | {"warc_type": "metadata", "payload": b"x"}, DATE), 1)
    big = bytearray(warc.member(warc.record_of(row, DATE), 9))
    big[-600:] = b"\0" * 600
    (tmp_path / "a.warc.gz").write_bytes(bytes(big) + good)
    reader = warc.WarcReader(str(tmp_path), [("warc_type", "equal", ["metadata"])])
    (part,) = reader.partitions()
    assert [r[0] for r in reader.read(part)] == ["metadata"]


def test_archives_of_others(tmp_path):
    """Plain files, and members without their length."""
    row = dict.fromkeys(warc.FIELDS) | {"warc_type": "response", "record_id": "r", "payload": b"body" * 9000}
    record = warc.record_of(row, DATE)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + record + record)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record) + gzip.compress(record))
    (tmp_path / "notes.txt").write_bytes(b"not an archive")
    reader = warc.WarcReader(str(tmp_path), [])
    found = [(r[0], r[6]) for part in reader.partitions() for r in reader.read(part)]
    assert found == [("warcinfo", None), ("response", b"body" * 9000), ("response", b"body" * 9000)] * 2
    reader.tests = [("warc_type", "equal", ["warcinfo"])]
    assert [r[0] for part in reader.partitions() for r in reader.read(part)] == ["warcinfo"] * 2
