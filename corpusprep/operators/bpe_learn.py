"""BPE merge learning (A2-A4, B1-B5) as an iterative Spark job.

Data layout: the word-type table ``(group..., sym, freq)``, one row per distinct word per
group, where ``sym`` is the word as space-wrapped symbols ``' a  b  c</w> '``, and the pair table
``(group, l, r, freq, places)``.

One round (``_learn``), for all groups at once; ``bpe_rounds`` holds what is done inside a group:

1. ``top_pairs``: the first ``candidates`` pairs of every group, from the pair table;
2. ``summarise``: one pass over the word types gives every group the bounded summary that its
   round needs (words with a hot pair, or distinct runs of hot pairs with added frequencies);
3. ``solve``: one task per group works out the merges of the round from that summary. Their number
   is about that of the hot pairs, so 10,000 merges take tens of rounds and not thousands;
4. ``step``: one pass over the word types applies the merges, which travel as data (one broadcast
   table for all groups, as many rows as the round has merges), and writes the touched words and
   the change of every pair they touch; changes are added up inside the task first;
5. the pair table takes the changes in one aggregation.

Bounds. A summary of whole words has at most ``rows`` words, proven from the pair table's
``places`` before it is made; one of runs is counted before a task gets it, and a group over
``rows`` goes again with half as many pairs, in the end with the first pair alone, which needs no
summary. The driver holds the candidates of ``GROUPS_AT_ONCE`` groups and the merges learned.

Store. Words and pairs are written as Parquet generations below ``spark.checkpoint.dir``, so a lost
executor costs one task. The word types lie in a *base* and a *young* part. The base holds words
without any of the group's first ``BASE_FACTOR * candidates`` pairs when it was written; no round
reads it until its pairs come up. A round rewrites the young part only. Words of a single symbol
leave the store. A generation that no later round reads is deleted.

Results are those of one merge at a time over true pair counts (the published definition), ties to
the greatest ``(left, right)`` by code points.
"""

from __future__ import annotations

import logging
from collections import defaultdict
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusprep.operators import bpe_rounds as rounds
from corpusprep.operators.stats import symbols_array, to_symbols, word_counts
from corpusprep.session import cut_lineage, ensure_checkpoint_dir, remove_path, shuffle_partitions

log = logging.getLogger(__name__)

MERGE_SCHEMA = "rank long, left string, right string, freq long"
GROUPS_AT_ONCE = 64
TASK_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
BASE_FACTOR = 4
PAIR_ROUNDS = 3  # changes of as many rounds are taken into the pair table at a time
BASE_ROUNDS = 8  # base and young are split anew after as many rounds at the latest
WHOLE_START = 64  # pairs of the first round in runs
WORDS = "gid int, sym string, freq long"
PAIRS = "gid int, l string, r string, freq long, places long"
#: Rows that a task adds up in memory before it lets them go.
IN_TASK = 200_000


def pairs_of(sym: Column) -> Column:
    """Adjacent symbol pairs of a symbol string as an array of ``struct(l, r)``."""
    s = symbols_array(sym)
    n = F.size(s) - 1
    return F.arrays_zip(F.slice(s, 1, n).alias("l"), F.slice(s, 2, n).alias("r"))


def word_types(words: DataFrame, group_cols: list[str] | None = None, word: str = "word",
               freq: str = "freq") -> DataFrame:
    g = list(group_cols or [])
    return words.select(*g, to_symbols(word).alias("sym"), F.col(freq).cast("long").alias("freq"))


def pair_counts(types: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A3: ``(groups..., l, r, freq)``; overlapping pairs count (``a a a`` gives 2 x freq)."""
    g = list(group_cols or [])
    return types.select(*g, "freq", F.explode(pairs_of(F.col("sym"))).alias("p")) \
        .groupBy(*g, F.col("p.l").alias("l"), F.col("p.r").alias("r")) \
        .agg(F.sum("freq").cast("long").alias("freq"))


def best_pair(pairs: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A4: highest count, ties to the lexicographically greatest ``(l, r)`` (code points)."""
    g = list(group_cols or [])
    m = F.max(F.struct("freq", "l", "r")).alias("m")
    return pairs.groupBy(*g).agg(m).select(*g, "m.l", "m.r", "m.freq")


def merge_pair(sym: Column, left: str, right: str) -> Column:
    """B2: merge every whole-symbol occurrence of ``(left, right)``, left to right."""
    return F.replace(sym, F.lit(f" {left}  {right} "), F.lit(f" {left}{right} "))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The first ``k`` pairs of every group by ``(freq, l, r)`` falling. Up to ``TASK_LIMIT`` pairs
    Spark limits each group inside the task before the shuffle; for more, a salted stage does."""
    order = [F.col("freq").desc(), F.col("l").desc(), F.col("r").desc()]
    if k > TASK_LIMIT:
        salt = F.pmod(F.xxhash64("l", "r"), F.lit(shuffle_partitions(pairs.sparkSession)))
        n = F.row_number().over(Window.partitionBy("gid", "__salt").orderBy(*order))
        pairs = pairs.withColumn("__salt", salt).withColumn("__n", n).where(F.col("__n") <= k).drop("__n", "__salt")
    n = F.row_number().over(Window.partitionBy("gid").orderBy(*order))
    return pairs.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")


def _added_up(rows, names: list[str], keys: int):
    """Arrow batches of ``rows`` (key columns, then numbers), equal keys added up in the task as
    far as memory goes."""
    import pyarrow as pa

    def batch(held):
        cols = list(zip(*(k + tuple(v) for k, v in held.items())))
        kinds = [pa.int32()] + [pa.string()] * (keys - 1) + [pa.int64()] * (len(names) - keys)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    held: dict[tuple, list] = {}
    for r in rows:
        key = r[:keys]
        if key in held:
            held[key] = [a + b for a, b in zip(held[key], r[keys:])]
        else:
            held[key] = list(r[keys:])
            if len(held) >= IN_TASK:
                yield batch(held)
                held = {}
    if held:
        yield batch(held)


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def summarise(words: DataFrame, plan) -> DataFrame:
    """``(gid, sym, freq)``: the summaries of the groups in the broadcast ``plan``
    (gid -> Round); equal rows of a group may remain where tasks met the same run."""

    def run(batches):
        todo = plan.value

        def rows():
            for gid, sym, freq in _rows(batches):
                rnd = todo.get(gid)
                if rnd is not None and rnd.form != "first":
                    for s in rounds.cut(sym.split(" "), rnd.hot, rnd.form):
                        yield gid, " ".join(s), freq
        yield from _added_up(rows(), ["gid", "sym", "freq"], 2)

    return words.mapInArrow(run, WORDS)


def solve(summary: DataFrame, plan, budget: dict, old, min_freq: int) -> DataFrame:
    """``(gid, k, l, r, freq)``: the merges of the round in their order, one task per group."""

    def run(key, part):
        import pandas as pd

        gid = key[0].as_py() if hasattr(key[0], "as_py") else int(key[0])
        items = [(s.split(" "), int(f)) for s, f in zip(part["sym"], part["freq"])]
        got = rounds.solve(items, plan.value[gid], budget[gid], min_freq, old.value.get(gid, set()))
        return pd.DataFrame([(gid, k, l, r, c) for k, (l, r, c) in enumerate(got)], columns=["gid", "k", "l", "r", "freq"])

    return summary.groupBy("gid").applyInPandas(run, "gid int, k int, l string, r string, freq long")


def step(words: DataFrame, orders) -> DataFrame:
    """One pass over the words with the round's merges (broadcast ``orders``: gid -> pair -> its
    positions): rows of kind 0 are words of two symbols or more, rows of kind 1 what the counts
    of pairs change by."""

    def run(batches):
        import pyarrow as pa

        todo = orders.value
        names = ["gid", "l", "r", "freq", "places"]
        changes: dict[tuple, list] = {}

        def change(gid, syms, freq, n):
            for p in zip(syms, syms[1:]):
                c = changes.setdefault((gid, *p), [0, 0])
                c[0] += n * freq
                c[1] += n

        def flush():
            rows = [(*k, *v) for k, v in changes.items() if v != [0, 0]]
            changes.clear()
            if rows:
                gid, l, r, f, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1] * len(rows), pa.int32()), pa.array(gid, pa.int32()), pa.nulls(len(rows), pa.string()),
                     pa.array(l, pa.string()), pa.array(r, pa.string()), pa.array(f, pa.int64()), pa.array(n, pa.int64())],
                    ["kind", "gid", "sym", *names[1:]])

        for b in batches:
            gids, syms, freqs = (c.to_pylist() for c in b.columns)
            keep: list[tuple] = []
            for gid, sym, freq in zip(gids, syms, freqs):
                order = todo.get(gid)
                s = sym.split(" ")
                if order is not None and any(p in order for p in zip(s, s[1:])):
                    t = rounds.replay(s, order)
                    change(gid, s, freq, -1)
                    change(gid, t, freq, 1)
                    if len(t) == 1:
                        continue
                    sym = " ".join(t)
                keep.append((gid, sym, freq))
            if keep:
                gid, sym, freq = zip(*keep)
                n = len(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * n, pa.int32()), pa.array(gid, pa.int32()), pa.array(sym, pa.string()),
                     pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(freq, pa.int64()), pa.nulls(n, pa.int64())],
                    ["kind", "gid", "sym", *names[1:]])
            if len(changes) >= IN_TASK:
                yield from flush()
        yield from flush()

    return words.mapInArrow(run, "kind int, gid int, sym string, l string, r string, freq long, places long")


def _split_words(words: DataFrame, young) -> DataFrame:
    """``kind`` 0 for words that hold a pair of the broadcast ``young`` (gid -> pairs, or None
    for all), 2 for the others, which form the base."""

    def run(batches):
        import pyarrow as pa

        sets = young.value
        for b in batches:
            gids, syms, freqs = (c.to_pylist() for c in b.columns)
            kinds = []
            for gid, sym in zip(gids, syms):
                hot, s = sets[gid], sym.split(" ")
                kinds.append(0 if hot is None or any(p in hot for p in zip(s, s[1:])) else 2)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(gids, pa.int32()), pa.array(syms, pa.string()),
                                              pa.array(freqs, pa.int64())], ["kind", "gid", "sym", "freq"])

    return words.mapInArrow(run, "kind int, gid int, sym string, freq long")


class _Store:
    """Generations of words (kind 0 young, 2 base) and pairs (kind 1) of one learning run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bpe-{uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> str:
        path = f"{self.root}/{self.n}"
        self.n += 1
        (df.write.partitionBy("kind") if "kind" in df.columns else df.write).parquet(path)
        return path

    def read(self, path: str, schema: str, kind: int | None = None) -> DataFrame:
        if kind is None:
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.read.schema(f"{schema}, kind int").parquet(path).where(F.col("kind") == kind).drop("kind")

    def drop(self, paths) -> None:
        for p in paths:
            remove_path(self.spark, p)


def _learn(words: DataFrame, gids: list[int], num_merges: int, min_freq: int, most: int, rows: int) -> dict[int, list]:
    """The merges ``(left, right, count)`` of every group of ``words`` (``gid, sym, freq``)."""
    spark, store = words.sparkSession, _Store(words.sparkSession)
    send = spark.sparkContext.broadcast
    learned: dict[int, list] = {g: [] for g in gids}
    live, size = set(gids), {g: WHOLE_START for g in gids}
    young_at = store.write(words.withColumn("kind", F.lit(0)))
    base_at: str | None = None
    young, base = store.read(young_at, WORDS, 0), None

    def counted(df: DataFrame) -> DataFrame:
        s = F.split("sym", " ")
        n = F.size(s) - 1
        p = F.explode(F.arrays_zip(F.slice(s, 1, n).alias("l"), F.slice(s, 2, n).alias("r")))
        return df.select("gid", "freq", p.alias("p")).groupBy("gid", F.col("p.l").alias("l"), F.col("p.r").alias("r")) \
            .agg(F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("places"))

    pairs_at = store.write(counted(young))
    changes_at: list[str] = []
    inside: dict[int, set | None] = {g: None for g in gids}  # pairs whose words are young; None: all are
    fresh: dict[int, set] = defaultdict(set)  # strings first made since the base was written
    since = 0

    def pairs() -> DataFrame:
        out = store.read(pairs_at, PAIRS)
        for path in changes_at:
            out = out.unionByName(store.read(path, PAIRS, 1))
        if changes_at:
            out = out.groupBy("gid", "l", "r").agg(F.sum("freq").alias("freq"), F.sum("places").alias("places")).where("freq > 0")
        return out

    def first_pairs(k: int) -> dict[int, list]:
        found: dict[int, list] = {g: [] for g in live}
        here = pairs().where(F.col("gid").isin(sorted(live))) if len(live) < len(gids) else pairs()
        for r in top_pairs(here, k).select("gid", "freq", "l", "r", "places").toArrow().to_pylist():
            found[r["gid"]].append((r["freq"], r["l"], r["r"], r["places"]))
        for c in found.values():
            c.sort(reverse=True)
        return found

    def split() -> None:
        """Write base and young anew, and the pairs with their changes taken in."""
        nonlocal young_at, base_at, young, base, pairs_at, since
        k = BASE_FACTOR * most
        cands = first_pairs(k + 1)
        for g in gids:
            c = cands.get(g, [])
            inside[g] = {(l, r) for _, l, r, _ in c[:k]} if len(c) > k or g not in live else None
        everything = young if base is None else young.unionByName(base)
        at = store.write(_split_words(everything.where(F.col("gid").isin(sorted(live))), send(dict(inside))))
        new_pairs = store.write(pairs())
        store.drop({young_at, pairs_at, *changes_at, *([base_at] if base_at else [])})
        young_at, base_at, pairs_at = at, at, new_pairs
        changes_at.clear()
        young, base = store.read(at, WORDS, 0), store.read(at, WORDS, 2)
        fresh.clear()
        since = 0

    while live:
        cands = first_pairs(most + 1)
        plan = {}
        for g in sorted(live):
            rnd = rounds.plan_round(cands[g], most, size[g], rows, min_freq)
            if rnd is None:
                live.discard(g)
            else:
                plan[g] = rnd
        if not plan:
            break
        away = any(inside[g] is not None and p not in inside[g] and not (p[0] in fresh[g] or p[1] in fresh[g])
                   for g, rnd in plan.items() for p in rnd.hot)
        if away or since >= BASE_ROUNDS:
            split()
        made = {g: {a + b for a, b, _ in learned[g]} for g in plan}
        plan_b, old_b = send(plan), send(made)
        budget = {g: num_merges - len(learned[g]) for g in plan}
        found: dict[int, list] = defaultdict(list)
        for g, rnd in plan.items():
            if rnd.form == "first":
                found[g] = rounds.solve([], rnd, 1, min_freq, set())
                size[g] = max(size[g], 1)
        summary = summarise(young, plan_b)
        cut_up = [g for g, rnd in plan.items() if rnd.form == "runs"]
        held = None
        if cut_up:  # equal runs become one row, and are counted before a task gets them
            held = summary = summary.groupBy("gid", "sym").agg(F.sum("freq").alias("freq")).persist()
            n = dict(summary.groupBy("gid").count().collect())
            over = [g for g in cut_up if n.get(g, 0) > rows]
            for g in cut_up:
                size[g] = size[g] // 2 if g in over else min(most, 2 * size[g])
            if over:
                summary = summary.where(~F.col("gid").isin(over))
        for r in sorted(solve(summary, plan_b, budget, old_b, min_freq).toArrow().to_pylist(), key=lambda r: r["k"]):
            found[r["gid"]].append((r["l"], r["r"], r["freq"]))
        if held is not None:
            held.unpersist()
        orders: dict[int, dict] = {}
        for g, ms in found.items():
            order: dict[tuple, list] = {}
            for k, (a, b, _) in enumerate(ms):
                order.setdefault((a, b), []).append(k)
                if a + b not in made[g] and not rounds.may_be_a_start(a + b):
                    fresh[g].add(a + b)
            orders[g] = order
            learned[g] += ms
            if len(learned[g]) >= num_merges:
                live.discard(g)
        since += 1
        log.info("round %d: %d groups, forms %s, %d merges", store.n, len(plan), {r.form for r in plan.values()},
                 sum(map(len, found.values())))
        if orders and live:
            orders_b = send(orders)
            at = store.write(step(young, orders_b))
            store.drop([f"{young_at}/kind=0"])
            changes_at.append(at)
            young_at, young = at, store.read(at, WORDS, 0)
            if len(changes_at) >= PAIR_ROUNDS:
                new_pairs = store.write(pairs())
                store.drop([pairs_at, *(f"{c}/kind=1" for c in changes_at)])
                pairs_at = new_pairs
                changes_at.clear()
            orders_b.unpersist()
        plan_b.unpersist()
        old_b.unpersist()
    store.drop([store.root])
    return learned


def learn_from_types(types: DataFrame, group_cols: list[str] | None = None, num_merges: int = 10000,
                     min_frequency: int = 2, candidates: int = 999, rows: int = 100_000) -> DataFrame:
    """B1 on a type table ``(groups..., sym, freq)``. Returns ``(groups..., rank, left, right,
    freq)`` (at most ``num_merges`` rows per group). ``candidates``: pairs that a round takes up
    per group; ``rows``: bound of a group's summary."""
    spark = types.sparkSession
    g = list(group_cols or [])
    flat = F.array_join(symbols_array(F.col("sym")), " ").alias("sym")
    if g:
        types = cut_lineage(types)
        keys = sorted(types.select(*g).distinct().collect(), key=lambda r: tuple((v is None, str(v)) for v in r))
        if not keys:
            return spark.createDataFrame([], _merge_schema(types, g))
        ids = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], _schema_of(types, g) + ", __gid int").toDF(*[f"__k{i}" for i in range(len(g))], "__gid")
        same = F.lit(True)
        for i, c in enumerate(g):
            same &= types[c].eqNullSafe(ids[f"__k{i}"])
        words = types.join(F.broadcast(ids), same).select(F.col("__gid").alias("gid"), flat, "freq")  # a row per group
    else:
        keys = [()]
        words = types.select(F.lit(0).alias("gid"), flat, "freq")
    words = words.where(F.instr("sym", " ") > 0)
    out = None
    for lo in range(0, len(keys), GROUPS_AT_ONCE):
        some = list(range(lo, min(lo + GROUPS_AT_ONCE, len(keys))))
        part = words.where(F.col("gid").isin(some)) if len(some) < len(keys) else words
        got = _learn(part, some, num_merges, min_frequency, candidates, rows)
        df = spark.createDataFrame([(*keys[i], n, a, b, c) for i, ms in got.items() for n, (a, b, c) in enumerate(ms)],
                                   _merge_schema(types, g))
        out = df if out is None else out.unionByName(df)
    return out


def _schema_of(types: DataFrame, g: list[str]) -> str:
    return ", ".join(f"`{c}` {types.schema[c].dataType.simpleString()}" for c in g)


def _merge_schema(types: DataFrame, g: list[str]) -> str:
    return f"{_schema_of(types, g)}, {MERGE_SCHEMA}" if g else MERGE_SCHEMA


def learn_bpe(df: DataFrame, col: str = "text", num_merges: int = 10000, min_frequency: int = 2,
              group_cols: list[str] | None = None, candidates: int = 999) -> DataFrame:
    """B1 (and B4 with ``group_cols``): learn merges from the whitespace tokens of ``col``.
    An empty corpus or one with only one-letter words gives zero rows (the reference raises)."""
    g = list(group_cols or [])
    types = word_types(word_counts(df, col, g), g)
    return learn_from_types(types, g, num_merges, min_frequency, candidates)


def learn_bpe_from_counts(counts: DataFrame, num_merges: int = 10000, min_frequency: int = 2,
                          group_cols: list[str] | None = None, word: str = "word", freq: str = "freq",
                          candidates: int = 999) -> DataFrame:
    """Learn from a ``(word, freq)`` dictionary instead of raw text."""
    g = list(group_cols or [])
    return learn_from_types(word_types(counts, g, word, freq), g, num_merges, min_frequency, candidates)


def merge_trace(merges: DataFrame) -> DataFrame:
    """The verbose trace ``(rank, left, right, new_symbol, freq)``."""
    return merges.withColumn("new_symbol", F.concat("left", "right"))
