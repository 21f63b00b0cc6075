"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves with a codebook each; a row's cell is its pair of codewords. For an
anchor ``a`` every codeword bounds its rows' half score: ``a . centre + |a| * radius``. The two
bounds of a cell add up to a bound of the scores in it, and a heap over the two sorted half lists
(the multi-sequence walk) gives the cells in falling order of that bound. A walk ends when what it
looks for is certified: the rows it holds are better than the bound of the next cell.

Every partition of the rows is indexed on its own, with its own radii, under the shared codebooks,
which are fitted on about ``FIT_ROWS`` rows, chosen by the hash of their id and at most twice as many. Anchors
are the stated query set: they meet all rows in blocks of at most ``BLOCK_BYTES``, broadcast one
after the other. A block takes two passes: the first finds each anchor's positives, the second,
knowing the windows that the positives open, the negatives. Each partition returns its best few
per anchor or window, and the best of those are the answer, so results are exact.

Components are integers and scores are summed in doubles, exactly while below 2^53.

Defined results: rows with a NULL id, label or vector, or a NULL or non-finite component, take no
part; an id stands for one row, so of rows that share one the smallest (label, vector) counts, and a
repeated row counts once; only vectors of equal length are compared; an anchor without any other
row of its label gives no rows, nor does a positive without a negative in its window; empty tables
give no rows. Columns other than ``vec_id``, ``embedding`` and ``label`` are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import fixed, map_rows
from corpusprep.session import shuffle_partitions

CODEWORDS = 8
FIT_ROWS = 4096
#: Bytes of anchor vectors that are broadcast at a time.
BLOCK_BYTES = 1 << 25
ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: The window of a negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95


def usable(df: DataFrame) -> DataFrame:
    """``(vec_id, label, vec)``: the rows that take part, labels changed where the rule says so,
    components as floor(256 x)."""
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() \
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = df.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                                 F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vec"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def fit_codebook(x, words: int = CODEWORDS, rounds: int = 8):
    """At most ``words`` centres of the rows of ``x`` (Lloyd's rounds from rows spread evenly)."""
    import numpy as np

    centres = x[np.unique(np.linspace(0, len(x) - 1, min(words, len(x))).astype(int))]
    for _ in range(rounds):
        at = nearest(x, centres)
        for k in range(len(centres)):
            mine = x[at == k]
            if len(mine):
                centres[k] = mine.mean(axis=0)
    return centres


def nearest(x, centres):
    import numpy as np

    return np.argmin((centres ** 2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


class CellIndex:
    """Rows of one partition, sorted by cell, with the radius of every codeword."""

    def __init__(self, ids, labels, x, books):
        import numpy as np

        half = len(books[0][0]) if len(books[0]) else 0
        parts = x[:, :half], x[:, half:]
        words = [nearest(p, b) for p, b in zip(parts, books)]
        self.books, self.half = books, half
        self.radii = []
        for p, b, w in zip(parts, books, words):
            r = np.zeros(len(b))
            np.maximum.at(r, w, np.sqrt(((p - b[w]) ** 2).sum(axis=1)))
            self.radii.append(r)
        cell = words[0] * len(books[1]) + words[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.x = ids[order], labels[order], np.ascontiguousarray(x[order])
        self.starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))

    def walk(self, a):
        """(bound, start, end) of the cells with rows, bounds falling."""
        import numpy as np

        sides = []
        for part, b, r in zip((a[:self.half], a[self.half:]), self.books, self.radii):
            s = b @ part + np.sqrt(part @ part) * r
            s += 1e-9 * (np.abs(s) + 1)  # above any rounding
            o = np.argsort(-s)
            sides.append((s[o].tolist(), o.tolist()))
        (u, left), (v, right) = sides
        starts, width = self.starts, len(v)
        heap, seen = [(-(u[0] + v[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            for n in ((i + 1, j), (i, j + 1)):
                if n not in seen and n[0] < len(u) and n[1] < width:
                    seen.add(n)
                    heapq.heappush(heap, (-(u[n[0]] + v[n[1]]), *n))
            cell = left[i] * width + right[j]
            if starts[cell] < starts[cell + 1]:
                yield -bound, starts[cell], starts[cell + 1]

    def batches(self, a):
        """(bound of what is left, positions, scores): the walk in growing batches; a bound of
        None after the last."""
        import numpy as np

        held, n, most = [], 0, 256
        for bound, lo, hi in self.walk(a):
            if n >= most:
                at = np.concatenate(held)
                yield bound, at, self.x[at] @ a
                held, n, most = [], 0, 2 * most
            held.append(np.arange(lo, hi))
            n += hi - lo
        if held:
            at = np.concatenate(held)
            yield None, at, self.x[at] @ a

    def _best(self, at, scores, k):
        """The first ``k`` (score, id) of the rows at ``at``: scores falling, ids rising."""
        import numpy as np

        if len(at) > 4 * k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= floor
            at, scores = at[keep], scores[keep]
        ids = self.ids[at]
        o = np.lexsort((ids, -scores))[:k]
        return list(zip(scores[o].tolist(), ids[o].tolist()))

    def positives(self, anchor: int, label: int, a, k: int):
        """The first ``k`` other rows of the label, as (score, id)."""
        best: list = []
        for bound, at, scores in self.batches(a):
            mine = (self.labels[at] == label) & (self.ids[at] != anchor)
            if mine.any():
                best = sorted(best + self._best(at[mine], scores[mine], k), key=lambda r: (-r[0], r[1]))[:k]
            if bound is not None and len(best) == k and best[-1][0] > bound:
                break
        return best

    def windows(self, label: int, a, spans: list, k: int):
        """For each (lowest, highest) score of ``spans`` the first ``k`` rows of other labels
        inside, as (score, id)."""
        found: list[list] = [[] for _ in spans]
        open_ = [i for i, (lo, hi) in enumerate(spans) if lo <= hi]
        least = min((spans[i][0] for i in open_), default=None)
        for bound, at, scores in self.batches(a) if open_ else ():
            other = (self.labels[at] != label) & (scores >= least)
            at, scores = at[other], scores[other]
            for i in open_:
                lo, hi = spans[i]
                inside = (scores >= lo) & (scores <= hi)
                if inside.any():
                    found[i] = sorted(found[i] + self._best(at[inside], scores[inside], k), key=lambda r: (-r[0], r[1]))[:k]
            if bound is not None:
                open_ = [i for i in open_ if bound >= spans[i][0] and not (len(found[i]) == k and found[i][-1][0] > bound)]
                if not open_:
                    break
        return found


def window(positive: int) -> tuple[int, int]:
    """The least and the greatest integer score n with LOW p <= 100 n <= HIGH p."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def _indexed(rows: DataFrame, sent, todo, schema: str) -> DataFrame:
    """``todo(index, anchors)`` over the cell index of every partition."""

    def run(stream):
        import numpy as np

        ids, labels, vecs = [], [], []
        for i, y, v in stream:
            ids.append(i)
            labels.append(y)
            vecs.append(np.array(v))
        if ids:
            index = CellIndex(np.array(ids), np.array(labels), np.stack(vecs), sent.value["books"])
            del vecs
            yield from todo(index, sent.value)

    return map_rows(rows, run, schema)


def _mine_block(rows: DataFrame, anchors: list, books) -> DataFrame:
    """Positives and negatives of one block of anchors ``(id, label, vector)``."""
    import numpy as np

    sc = rows.sparkSession.sparkContext
    matrix = np.array([v for _, _, v in anchors])
    names = [(i, y) for i, y, _ in anchors]
    sent = sc.broadcast({"books": books, "names": names, "matrix": matrix})

    def first(index, got):
        for (i, y), a in zip(got["names"], got["matrix"]):
            for s, p in index.positives(i, y, a, POSITIVES):
                yield i, int(s), p

    found = _indexed(rows, sent, first, "anchor_id long, score long, id long")
    best = found.groupBy("anchor_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, POSITIVES).alias("b"))
    # at most POSITIVES numbers for each anchor of the block
    positives = {r["anchor_id"]: [(-x["s"], x["id"]) for x in r["b"]] for r in best.toLocalIterator()}
    sent2 = sc.broadcast({"books": books, "names": names, "matrix": matrix, "positives": positives})

    def second(index, got):
        for (i, y), a in zip(got["names"], got["matrix"]):
            pos = got["positives"].get(i)
            if pos:
                for (s, p), negs in zip(pos, index.windows(y, a, [window(s) for s, _ in pos], NEGATIVES)):
                    for n, q in negs:
                        yield i, p, s, int(n), q

    hits = _indexed(rows, sent2, second, "anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    top = hits.groupBy("anchor_id", "positive_id", "positive_score") \
        .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("negative_score")).alias("s"), "negative_id"))), 1, NEGATIVES).alias("b"))
    return top.select("anchor_id", "positive_id", "positive_score", F.posexplode("b").alias("at", "n")) \
        .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.negative_id").alias("negative_id"),
                "positive_score", (-F.col("n.s")).alias("negative_score"))


def mine(df: DataFrame) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``."""
    import numpy as np

    spark = df.sparkSession
    rows = fixed(usable(df).repartition(shuffle_partitions(spark), "vec_id").withColumn("dim", F.size("vec")))
    out = None
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        same = rows.where(F.col("dim") == dim).select("vec_id", "label", "vec")
        share = int((1 << 20) * min(1.0, FIT_ROWS / max(1, same.count())))  # by hash, so that few rows come from each task
        sample = np.array([r["vec"] for r in same.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).limit(2 * FIT_ROWS)
                           .select("vec").collect()] or [r["vec"] for r in same.limit(1).collect()])
        half = dim // 2
        books = fit_codebook(sample[:, :half]), fit_codebook(sample[:, half:])
        asked = same.where(F.col("vec_id") % ANCHOR_EVERY == 0).orderBy("vec_id")
        most, block = max(1, BLOCK_BYTES // (8 * max(dim, 1))), []
        blocks = []
        for r in asked.toLocalIterator():  # one block at a time is in memory
            block.append((r["vec_id"], r["label"], r["vec"]))
            if len(block) == most:
                blocks.append(fixed(_mine_block(same, block, books)))
                block = []
        if block:
            blocks.append(fixed(_mine_block(same, block, books)))
        for b in blocks:
            out = b if out is None else out.unionByName(b)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
