import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from edge_rows import SMALL, edge  # noqa: F401

from corpusprep.llm import queries as Q
from corpusprep.llm.sharding import hilbert_index, hilbert_shards, prune, shard_ranges


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_curve_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = hilbert_index(cells, bits)
    assert sorted(at.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def law(rows, shards=16):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = Q.op8_hilbert_sharding(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        b = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "rows", None)
    law(rows)
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in rows)


def test_pruning_beats_arrival_order(spark):
    """Shards that a condition on any one dimension leaves, against those of rows dealt by id; every
    shard that holds a row of the answer is left."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sharded = hilbert_shards(df, shards=64).cache()
    ranges = shard_ranges(sharded)
    sizes = sorted(r["n_chars"] for r in df.select("n_chars").collect())
    left = dealt = 0
    for name, low, high in (("n_chars", sizes[-50], sizes[-1]), ("n_chars", sizes[0], sizes[100]), ("n_chars", sizes[450], sizes[550]),
                            ("lang", "de", "de"), ("lang", "fr", "fr")):
        hit = {r["shard"] for r in prune(ranges, name, low, high).select("shard").collect()}
        assert hit >= {r["shard"] for r in sharded.where(sharded[f"dim_{name}"].between(low, high)).select("shard").distinct().collect()}
        plain = df.where(df[name].between(low, high)).select((df["doc_id"] % 64).alias("s")).distinct().count()
        left, dealt = left + len(hit), dealt + plain
    assert left < 0.7 * dealt


def test_edge_rows(spark, edge):
    rows = hilbert_shards(edge, shards=3).collect()
    assert len(rows) == edge.count()
    law(rows, 3)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 2} == {(1, 0)}
    assert hilbert_shards(edge.limit(0)).count() == 0
    law(hilbert_shards(edge, shards=16, dimensions=("lang",)).collect())
