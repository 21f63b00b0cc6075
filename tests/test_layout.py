"""Layout invariance: order-dependent queries give the same rows at 1 and 7 shuffle partitions."""

import math

import pytest

from conftest import SMALL

NAMES = ["budget_batches_global", "budget_batches_sharded", "with_ordinal", "vocab_by_freq", "learn_bpe",
         "corpus_bleu", "read_word_counts", "token_batches"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_at_1_and_7_partitions(spark, name):
    from corpusprep.plans.registry import queries
    q = queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for p in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            rows = [tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in r)
                    for r in q(spark, SMALL).collect()]
            res.append(sorted(rows, key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1]
