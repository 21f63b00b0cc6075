"""The driver contract: entry() runs on sf0.001, registry and oracle keys agree."""

import __spark_entry__ as e


def test_entry_smoke(spark):
    df = e.entry(spark)
    assert df.columns == ["variant", "side", "split", "lines", "tokens", "max_len", "mean_len",
                          "distinct_words", "steps_per_epoch"]
    assert df.count() > 0


def test_default_merges_are_those_of_the_reference(monkeypatch):
    import inspect

    from corpusprep.plans.flagship import flagship, prepare
    assert all(inspect.signature(f).parameters["num_merges"].default == 10_000 for f in (prepare, flagship))
    monkeypatch.delenv("BENCH_MERGES", raising=False)
    monkeypatch.delitem(__import__("sys").modules, "bench", raising=False)
    import bench
    assert bench.LEARN_MERGES == 10_000


def test_registry_keys():
    from corpusprep.plans.registry import queries as own
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and set(own()) <= set(q)  # the entry may add the queries of optional packages
    assert set(own()) <= set(o)
    assert all(isinstance(s, str) and s.strip() for s in o.values())
