import hashlib
import io
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusprep.llm import warc

from edge_rows import SMALL

PAGES = [(5, "http://a/x y\n", "é" * 60), (3, None, "é" * 60), (9, "http://b/", "é" * 60), (9, "http://b/", "é" * 60), (None, "http://c/", "é" * 60),
         (7, "http://d/", "short"), (8, "http://d/", "short"), (1, "http://e/", None), (2, "http://e/", ""), (None, "u", "n" * 100),
         (None, "u", "n" * 100), (11, "u", "b\r\n\r\nWARC/1.1\r\n" * 9), (12, "u", "L" * 2_000_000), (12, "u", "L" * 2_000_000), (13, "u", "z" * 99), (14, "u", "z" * 99)]


def brute(rows):
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[(h or "").encode()].append(p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        ids = [x for x in groups[data] if x is not None]
        again = len(data) >= 100 and bool(ids) and p != min(ids)
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture()
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1)).withColumn("payload", F.lit(2)).withColumn("salt", F.lit(3))


def test_edge_rows(spark, pages):
    assert rows_of(warc.archive(pages)) == brute(PAGES)
    assert warc.archive(pages.limit(0)).count() == 0


def test_shuffled_plan_gives_the_same(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "small_side", lambda df, n: df)
    assert rows_of(warc.archive(pages)) == brute(PAGES)


def test_query_equals_brute_force(spark):
    from corpusprep.llm.queries import op12_seekable_warc
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    got = op12_seekable_warc(spark, SMALL)
    assert dict(got.dtypes)["payload_bytes"] == "bigint"
    assert rows_of(got) == brute(rows)


def test_frames_bundles_and_lookup(spark, tmp):
    import zstandard

    r = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(r.choice("ab \n") for _ in range(r.randint(0, 400)))) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder, index = warc.write_bundles(df, f"file://{tmp}/w", frame_bytes=2000, bundle_bytes=6000)
    at = {x.record_id: x for x in index.collect()}
    assert len(at) == 300 and len({x.bundle for x in at.values()}) > 6
    open(f"{tmp}/w/bundle-lost.warc.zst", "wb").write(b"a lost attempt")  # not in the index, so never read
    plain = {}
    for name in {x.bundle for x in at.values()}:
        data = open(f"{tmp}/w/{name}", "rb").read()
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as f:
            plain[name] = f.read()  # any tool reads the whole file; the seek table is skipped
    assert sum(map(len, plain.values())) == sum(x.length for x in at.values())
    assert rows_of(warc.read_back(folder, index)) == brute(rows)
    some = [x for x in at.values() if x.page_id % 17 == 0]
    got = warc.fetch(folder, index, spark.createDataFrame([(x.record_id,) for x in some] * 2, "record_id string")).collect()
    assert {x.page_id: bytes(x.payload).decode() for x in got if x.record_type == "response"}.items() <= {p: h for p, _, h in rows}.items()
    assert len(got) == len(some)


def test_a_broken_payload_is_noticed(spark, tmp):
    rid, data = warc.to_record(4, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    assert [x.payload for x in warc.parse_records(data + data)] == [b"payload"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_records(data.replace(b"payload\r\n", b"pAyload\r\n")))
    assert os.path.isdir(tmp)
