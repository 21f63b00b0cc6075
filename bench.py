"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed fully with the ``noop`` sink (every column computed, nothing collected
to the driver), after one warm-up scan that starts the JVM. Per-query seconds and the number
of shuffle partitions go into the JSON line; each query's seconds also go to stderr as it ends.
Queries that learn 10,000 merges run last. After BENCH_LIMIT_SEC no further query is started, and
those not run are named in ``not_run``, so that the line always comes.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LIMIT_SEC = float(os.environ.get("BENCH_LIMIT_SEC", "1200"))
LEARN_MERGES = int(os.environ.get("BENCH_MERGES", "10000"))


def main() -> None:
    from corpusprep.session import get_spark
    spark = get_spark(master=f"local[{CPUS}]", app="corpusprep-bench",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-ckpt-")})
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))

    spark.conf.set("corpusprep.scan.partitions", CPUS)  # the tables are one small file each

    from corpusprep.operators import bpe_apply as ba
    from corpusprep.operators import bpe_learn as bl
    from corpusprep.plans import fixtures as fx
    from corpusprep.plans.flagship import flagship
    from corpusprep.plans.registry import queries

    q = queries()
    d = SF_DIR

    merges_cache = {}

    def learn(spark, d):
        # the rounds run eagerly; the result is a small table of learned merges
        merges_cache["m"] = bl.learn_bpe(fx.table(spark, d, "documents"), "text", num_merges=LEARN_MERGES)
        return merges_cache["m"]

    def apply(spark, d):
        m = merges_cache.get("m")
        if m is None:
            m = learn(spark, d)
        return ba.apply_bpe(fx.lines(spark, d), "text", m, out_col="enc")

    def apply_distinct(spark, d):
        m = merges_cache.get("m")
        if m is None:
            m = learn(spark, d)
        return ba.apply_bpe_distinct(fx.lines(spark, d), "text", ["doc_id", "line_no"], m)

    plan = [
        ("word_counts", q["word_counts"]),
        ("align_by_key", q["align_by_key"]),
        ("corpus_bleu", q["corpus_bleu"]),
        ("corpus_chrf", q["corpus_chrf"]),
        ("score_runs", q["score_runs"]),
        ("budget_batches_sharded", q["budget_batches_sharded"]),
        ("budget_batches_global", q["budget_batches_global"]),
        ("token_batches", q["token_batches"]),
        ("best_per_run", q["best_per_run"]),
        ("map_batches", q["map_batches"]),
        ("flagship", lambda s, dd: flagship(s, dd, LEARN_MERGES)),
        (f"learn_bpe_{LEARN_MERGES}", learn),
        (f"apply_bpe_{LEARN_MERGES}", apply),
    ]
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    fx.table(spark, d, "documents").write.format("noop").mode("overwrite").save()  # warm-up
    times, not_run = {}, []
    start = time.time()
    for name, fn in plan:
        if only and name not in only:
            continue
        if time.time() - start > LIMIT_SEC:
            not_run.append(name)
            continue
        t0 = time.time()
        df = fn(spark, d)
        df.write.format("noop").mode("overwrite").save()  # every column computed, nothing collected
        times[name] = round(time.time() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    # alternative plans, timed for comparison only (not part of the total)
    comparisons = {}
    if merges_cache and (not only or f"apply_bpe_{LEARN_MERGES}_distinct" in only):
        t0 = time.time()
        apply_distinct(spark, d).write.format("noop").mode("overwrite").save()
        comparisons[f"apply_bpe_{LEARN_MERGES}_distinct"] = round(time.time() - t0, 3)
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "comparisons": comparisons,
        "not_run": not_run,
        "sf": os.path.basename(d.rstrip("/")).replace("sf", ""),
        "cpus": int(CPUS),
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "learn_merges": LEARN_MERGES,
    }
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
