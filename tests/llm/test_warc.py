from __future__ import annotations

import gzip
import io
import random
import zlib

import pytest

from lexarium.llm import warc

PAGES = [(1, "http://a/é", "<p>one</p>"), (2, "http://b/", ""), (3, None, None), (None, "http://c/", "x" * 3_000_000), (1, "http://a/é", "<p>one</p>"), (5, "http://d/", "WARC/1.0\r\nWARC-Type: response\r\n\r\n")]


def key(rows):
    return sorted(map(str, rows))


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, payload string").repartition(3)
    files = warc.write_pages(df, f"file://{tmp_path}/w")
    found = warc.read_warc(spark, ",".join(files))
    assert key(tuple(r) for r in warc.pages_from(found).collect()) == key(PAGES)
    assert {r["warc_type"]: r["count"] for r in found.groupBy("warc_type").count().collect()} == {"warcinfo": len(files), "request": 6, "response": 6}
    assert found.filter("http_status = 200").count() == 5 + 0
    assert found.filter("target_uri like 'http://a%' and warc_type = 'response'").count() == 2
    some = warc.read_warc(spark, ",".join(files), where={"warc_type": ["response", "request"], "target_uri": {"startswith": "http://a"}, "content_length": {">": 0}})
    assert some.count() == 4 and some.filter("warc_type = 'request'").union(some.filter("warc_type = 'response'")).count() == 4 and some.count() == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("warc").option("pushdown", "true").load(",".join(files)).filter("warc_type = 'response' and target_uri like 'http://a%'")
    assert pushed.count() == 2
    assert warc.read_warc(spark, f"file://{tmp_path}/w", payload=False).filter("payload is null").count() == 12 + len(files)
    assert warc.pages_from(warc.read_warc(spark, ",".join(warc.write_pages(df.limit(0), f"file://{tmp_path}/e")))).isEmpty()


def test_predicates_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, StringStartsWith

    reader = warc.PushingWarcReader({"path": "x"})
    given = [EqualTo(("warc_type",), "response"), IsNotNull(("warc_type",)), GreaterThan(("content_length",), 5), StringStartsWith(("target_uri",), "http"), EqualTo(("http_status",), 200)]
    assert [f.attribute for f in reader.pushFilters(given)] == [("http_status",)] and len(reader.filters) == 4


def test_unwanted_payloads_are_not_read():
    data = b"".join(r for p in PAGES[:4] for r in warc.page_records(*p))

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    from pyspark.sql.datasource import EqualTo

    raw = Counting(data)
    rows = list(warc.records(raw, False, len(data), [EqualTo(("warc_type",), "request")], True, "x"))
    assert len(rows) == 4 and all(r["payload"] == b"" and r["http_headers"] == {} for r in rows) and raw.taken < len(data)
    members = b"".join(gzip.compress(r) for p in PAGES for r in warc.page_records(*p))
    assert len(list(warc.records(io.BytesIO(members), True, len(members), [], True, "x"))) == 12
    offsets = [r["offset"] for r in warc.records(io.BytesIO(data), False, len(data), [], False, "x")]
    assert all(data[o : o + 5] == b"WARC/" for o in offsets)


@pytest.mark.parametrize("bad", [b"nonsense\r\n\r\n", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\nContent-Length: 10\r\n\r\nabc", b"WARC/1.0\r\nContent-Le"])
def test_broken(bad):
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(bad), False, len(bad), [], True, "x"))
    assert list(warc.records(io.BytesIO(b""), False, 0, [], True, "x")) == []


@pytest.mark.parametrize("step", [1_000, 70_000, 200_000])
def test_ranges_of_a_large_file(spark, tmp_path, step):
    """Every record once, whatever the ranges; archives inside payloads, stored as they are, are no place to begin."""
    r = random.Random(1)
    inner = b"".join(gzip.compress(x) for i in range(30) for x in warc.page_records(i, f"http://inner/{i}", "inner " * 20))
    bodies = [inner, r.randbytes(90_000), inner * 3, b"text " * 2_000] * 6
    made = [warc._record("resource", {"WARC-Record-ID": f"<{i}>", "WARC-Target-URI": f"http://x/{i}"}, b) for i, b in enumerate(bodies)]
    data = b"".join(gzip.compress(m) for m in made)
    (tmp_path / "big.warc.gz").write_bytes(data)
    spark.dataSource.register(warc.WarcSource)
    df = spark.read.format("warc").option("partitionbytes", step).load(f"file://{tmp_path}/big.warc.gz")
    assert df.rdd.getNumPartitions() == -(-len(data) // step)
    rows = df.select("target_uri", "payload", "offset").collect()
    assert sorted((x["target_uri"], bytes(x["payload"])) for x in rows) == sorted((f"http://x/{i}", b) for i, b in enumerate(bodies))
    assert all(zlib.decompressobj(31).decompress(data[x["offset"] :], 5) == b"WARC/" for x in rows) and len({x["offset"] for x in rows}) == len(bodies)
    whole = gzip.compress(b"".join(made))
    (tmp_path / "one.warc.gz").write_bytes(whole)
    assert spark.read.format("warc").option("partitionbytes", step).load(f"file://{tmp_path}/one.warc.gz").count() == len(bodies)
