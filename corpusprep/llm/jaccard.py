"""N-gram Jaccard join: documents whose shingle sets overlap by ``threshold`` or more.

The join is a product of the (document x shingle) incidence matrix with its transpose, in blocks:

1. Rows. Documents with equal texts are one row (grouped by a 128-bit hash of the text).
2. Column blocks. For a range of row sizes the shingles are dealt into somewhat more blocks than
   two linked rows of that size can differ in. The size bound: linked rows x, y differ in at
   most (1-t)/(1+t) * (|x|+|y|) shingles, so they agree on a whole block. Pairs that agree on no
   block are below the bound and never formed. A block of a row is one 64-bit key.
3. Products. Rows that share a key meet the smallest and the largest row under that key (not each
   other), and the overlap is counted for these pairs: the rows that share a partner form a block
   of the matrix, and their shingles are its columns.
4. Links give components. Rows under one key that are still in different components are compared
   again, so that no link between different components is lost: those that share one of their rarest
   shingles (so many of each that linked rows must), block of rows by block of rows.
5. Before texts are read, rows meet as parity sketches: each shingle flips one bit of a vector
   about as long as the set. Two vectors differ in no more bits than the sets in shingles, so a
   pair whose vectors differ in more bits than linked rows of these sizes can is discarded.

A group of copies or near copies of any size therefore costs work in proportion to its rows; only
groups that share whole blocks yet do not link are compared pairwise, in blocks of bounded size.

Edge cases: NULL, empty and word-less texts have the empty set and link with nothing; a text with
fewer words than a shingle is one shingle of all its words; rows with equal ids are one node, a
row with NULL id is returned with its set size and a NULL component and links with nothing. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import fixed, free_name, map_rows, small_side, text_key
from corpusprep.llm.components import components

#: Ratio between the smallest and the largest row of a size range.
RANGE = 0.7
#: Rows of a block in the products.
BLOCK = 256
SEEDS = 4
#: Hash buckets in which the rarity of shingles is counted.
RARITY = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    with np.errstate(over="ignore"):
        x = (x + _GOLD).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, n: int, cache_words: int = 100_000):
        self.n, self.limit = n, cache_words

        class Words(dict):
            def __missing__(self, w):
                h = xxhash.xxh3_64_intdigest(w)
                if len(w) <= 40:
                    self[w] = h
                return h

        self.cache = Words()

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes: lower() changes A-Z only, split() splits at space and tab to carriage return
        w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not w:
            return np.zeros(0, np.uint64)
        if len(self.cache) > self.limit:
            self.cache.clear()
        h = np.fromiter(map(self.cache.__getitem__, w), np.uint64, len(w))
        k = min(self.n, len(w))
        m = len(h) - k + 1
        with np.errstate(over="ignore"):
            out = np.full(m, np.uint64(k))
            for j in range(k):
                out = mix(out * _GOLD + h[j:j + m])
        return np.unique(out)


class Blocks:
    """The size ranges of rows, and the keys of a row's column blocks."""

    def __init__(self, threshold: float):
        self.t = threshold
        self.tops = [1]
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] / RANGE)))
        self._blocks: dict[int, int] = {}

    def ranges(self, size: int) -> list[int]:
        """The range of ``size``, and those above in which a linked row can lie."""
        out = [int(np.searchsorted(self.tops, size, "left"))]
        while size / self.t + 1e-9 >= self.tops[out[-1]] + 1:
            out.append(out[-1] + 1)
        return out

    def differ(self, c: int) -> int:
        """Shingles in which two linked rows compared in range ``c`` can differ at most."""
        return int((1 - self.t) / (1 + self.t) * 2 * self.tops[c] + 1e-9)

    def blocks(self, c: int) -> int:
        """Blocks of range ``c``: so many more than linked rows can differ in that the smallest
        row, for which most blocks come out empty, still fills more than that, but for chance."""
        m = self._blocks.get(c)
        if m is None:
            k = self.differ(c)
            m = k + 2 if k else 1
            least = self.t * (self.tops[c - 1] + 1) if c else 1
            while k:
                empty = m * np.exp(-least / m)
                if m - k - 1 >= empty + 3 * np.sqrt(empty) or m >= 2 * k + 8:
                    break
                m += max(1, k // 64)
            self._blocks[c] = m
        return m

    def keys(self, row: np.ndarray) -> np.ndarray:
        out = []
        for c in self.ranges(len(row)):
            k = self.differ(c)
            m = self.blocks(c)
            for seed in range(SEEDS):
                with np.errstate(over="ignore"):
                    tag = mix(np.uint64([c * 1000 + seed]))[0]
                    x = mix(row ^ tag)
                    block = (x >> np.uint64(32)) % np.uint64(m)
                    order = np.argsort(block, kind="stable")
                    b = block[order]
                    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                    sums = np.add.reduceat(mix(x)[order], first)
                    out.append(mix(sums + b[first] * _GOLD + tag))
                if m - len(first) < m - k:  # linked rows agree on a block that is not empty
                    break
            else:  # so uneven in every way of dealing that only empty blocks may agree
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), b)
                with np.errstate(over="ignore"):
                    out.append(mix(empty * _M2 + tag + _GOLD))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch(row: np.ndarray) -> bytes:
    """The parity sketch of a row: as many bits as shingles, rounded up to a power of two, 64 at
    least; each shingle flips one."""
    bits = max(64, 1 << max(0, len(row) - 1).bit_length())
    place = mix(row ^ _M1) & np.uint64(bits - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1).tobytes()


def fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (last axis: bytes) as they would be with ``width`` bytes."""
    while sketches.shape[-1] > width:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def may_link(n: int, a: np.ndarray, sizes, b: np.ndarray, num: int, den: int):
    """Whether rows of these sizes and sketches can be linked: linked rows differ in at most
    (1-t)/(1+t) of the sum of their sizes, and sketches in no more bits than the rows in shingles.
    ``sizes`` and ``b`` may hold many rows."""
    width = min(a.shape[-1], b.shape[-1])
    bits = np.bitwise_count(fold(a, width) ^ fold(b, width)).sum(axis=-1, dtype=np.int64)
    return (den * np.minimum(n, sizes) >= num * np.maximum(n, sizes)) & ((den + num) * bits <= (den - num) * (n + sizes))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b| for sorted distinct arrays."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return den * both >= num * (len(a) + len(b) - both)


def products(left: list, right: list, num: int, den: int):
    """Pairs (i, j) of linked rows: overlaps counted as a product of two incidence blocks."""
    rows = [*left, *right]
    sizes = np.array([len(x) for x in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    cols, col = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    shared = np.bincount(col, minlength=len(cols)) > 1  # a column of one row adds to no overlap
    number = np.cumsum(shared) - 1
    ok = shared[col]
    col, row = number[col[ok]], row[ok]
    overlap = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for c in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [c, c + width])
        block = np.zeros((len(rows), width), np.float32)
        block[row[lo:hi], col[lo:hi] - c] = 1
        overlap += block[:len(left)] @ block[len(left):].T
    both = overlap.astype(np.int64)
    union = sizes[:len(left), None] + sizes[None, len(left):] - both
    return np.argwhere((den * both >= num * union) & (both > 0))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5,
                       threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id
    reachable by links, its own if there is none). ``threshold``: numerator and denominator."""
    num, den = threshold
    key = text_key(text)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), key["a"].alias("a"), key["b"].alias("b"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def rows_of(rows):
        shingle, blocks = Shingler(n), Blocks(num / den)
        for i, t, a, b in rows:
            s = shingle(t)
            node = len(s) and i is not None
            yield i, a, b, len(s), blocks.keys(s).view(np.int64).tolist() if node else [], sketch(s) if node else None

    # of equal texts only the one of smallest id is a row; texts without an id are counted only
    first = fixed(d.groupBy("a", "b").agg(F.min("doc_id").alias("r")).select("r").where("r is not null").distinct())
    own = d.where("doc_id is null").unionByName(d.join(small_side(first), F.col("doc_id") == F.col("r"), "left_semi"))
    sets = fixed(map_rows(own.select("doc_id", "t", "a", "b"), rows_of, f"doc_id {kind}, a long, b long, n long, keys array<long>, sketch binary"))
    entry = sets.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("r"), "keys")
    # rows under one key, with the smallest and the largest of them
    by_key = entry.select("r", F.explode("keys").alias("k"))
    shared = fixed(by_key.groupBy("k").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("c"))
                   .where("c > 1 and lo < hi"))
    more = shared.where("c > 2").select(F.col("k").alias("key"), "lo", "hi")
    member = fixed(by_key.join(small_side(more), F.col("k") == F.col("key")).select("r", "key", "lo", "hi"))
    star = shared.where("c = 2").select(F.col("hi").alias("r"), F.col("lo").alias("p")) \
        .unionByName(member.select("r", F.col("lo").alias("p"))) \
        .unionByName(member.select("r", F.col("hi").alias("p"))) \
        .where("r <> p").select(F.greatest("r", "p").alias("r"), F.least("r", "p").alias("p")).distinct()
    sketches = sets.where("sketch is not null").select(F.col("doc_id").alias("i"), F.col("n").alias("size"), "sketch")
    close = fixed(_screened(star, sketches, num, den, kind))
    links = fixed(_star_links(close, _texts(d, close.select("r").unionByName(close.select(F.col("p").alias("r")))), n, num, den, kind))
    part = components(links)
    rest = _rest_links(member, part, sketches, d, n, num, den, kind)
    if rest is not None and rest.limit(1).count():
        part = components(links.unionByName(rest))

    whole = sets.groupBy("a", "b").agg(F.min("doc_id").alias("r"), F.max("n").alias("n"))
    whole = fixed(whole.join(part, F.col("r") == F.col("node"), "left")
                  .select(F.col("a").alias("x"), F.col("b").alias("y"), "n", F.coalesce("component", "r").alias("c")))
    out = d.select("doc_id", "a", "b").join(small_side(whole), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
    # a text without words links with nothing, not even with its copies; a row without id is in no component
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _texts(d: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids`` (column ``r``), each row of ``d`` once."""
    ids = fixed(ids.distinct())
    return fixed(d.where(F.col("doc_id").isNotNull()).join(small_side(ids), d["doc_id"] == F.col("r"), "left_semi").select("doc_id", "t"))


def _screened(star, sketches, num, den, kind):
    """Rows and partners whose sketches may be linked."""
    pairs = star.join(sketches.select(F.col("i").alias("r"), F.col("size").alias("n"), F.col("sketch").alias("s")), "r") \
        .join(sketches.select(F.col("i").alias("p"), F.col("size").alias("m"), F.col("sketch").alias("t")), "p")

    def screen(rows):
        for r, p, n, s, m, t in rows:
            if may_link(n, np.frombuffer(s, np.uint8), m, np.frombuffer(t, np.uint8), num, den):
                yield r, p
    return map_rows(pairs.select("r", "p", "n", "s", "m", "t"), screen, f"r {kind}, p {kind}").distinct()


def _star_links(star, texts, n, num, den, kind):
    """Links between rows and their partner: the rows of a partner are dealt into blocks, the
    partner goes to each of them."""
    count = star.groupBy("p").agg(F.count(F.lit(1)).alias("c")).withColumn("parts", F.ceil(F.col("c") / BLOCK)).select(F.col("p").alias("q"), "parts")
    dealt = star.join(count, F.col("p") == F.col("q")).withColumn("s", F.pmod(F.xxhash64("r"), F.col("parts"))).select("p", "s", "r")
    left = dealt.join(texts, F.col("r") == F.col("doc_id")).select("p", "s", F.col("r").alias("i"), "t", F.lit(0).alias("side"))
    hub = dealt.select("p", "s").distinct().join(texts, F.col("p") == F.col("doc_id")).select("p", "s", F.col("p").alias("i"), "t", F.lit(1).alias("side"))

    def compare(groups):
        shingle = Shingler(n)
        for (p, _), rows in groups:
            rows = list(rows)
            hubs = [shingle(t) for _, t, side in rows if side]
            for i, t, side in rows:
                if not side and any(linked(shingle(t), h, num, den) for h in hubs):
                    yield i, p

    both = left.unionByName(hub).repartition("p", "s").sortWithinPartitions("p", "s", F.col("side").desc())
    return map_rows(both.select("p", "s", "i", "t", "side"), _grouped(2, compare), f"a {kind}, b {kind}").distinct()


def _rest_links(member, part, sketches, d, n, num, den, kind):
    """Links between rows that share a key but are in different components so far. None: no such rows.

    Of these rows only those are compared that share a shingle among the first of each: with the
    shingles of all rows in one order, linked rows have one in common among the first
    (1-t) * size + 1 of each. The order is by falling rarity, so passages that many rows share come
    last and bring hardly any rows together. Rarity is counted in ``RARITY`` hash buckets, a table of
    fixed size; any order would give the same links."""
    at = member.join(part, F.col("r") == F.col("node"), "left").select("key", "r", F.coalesce("component", "r").alias("c"))
    mixed = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
    open_ = fixed(at.join(mixed, F.col("key") == F.col("k"), "left_semi").select("r", "c").distinct())
    if not open_.limit(1).count():
        return None
    own = d.where(F.col("doc_id").isNotNull()).join(small_side(open_), F.col("doc_id") == F.col("r")).select("r", "c", "t")

    def rarity(rows):
        shingle, total = Shingler(n), np.zeros(RARITY, np.int64)
        for _, _, t in rows:
            total += np.bincount((shingle(t) % np.uint64(RARITY)).astype(np.int64), minlength=RARITY)
        at = np.flatnonzero(total)
        yield from zip(at.tolist(), total[at].tolist())

    counted = map_rows(own, rarity, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    common = np.zeros(RARITY, np.int64)
    common[counted["b"].to_numpy()] = counted["c"].to_numpy()
    sent = d.sparkSession.sparkContext.broadcast(common)

    def first(rows):
        shingle, common = Shingler(n), sent.value
        for r, c, t in rows:
            s = shingle(t)
            m = len(s) - -(-num * len(s) // den) + 1
            order = np.lexsort((s, common[(s % np.uint64(RARITY)).astype(np.int64)]))
            yield r, c, len(s), s[order[:m]].view(np.int64).tolist()

    lists = fixed(map_rows(own, first, f"r {kind}, c {kind}, size long, firsts array<long>"))
    keys = lists.select("r", "c", "size", F.explode("firsts").alias("g"))
    shared = fixed(keys.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(F.col("g").alias("h")))
    # linked rows lie in one class of sizes or in neighbouring ones: a row goes to its own cell and the next
    cell = F.floor(F.log("size") / (np.log(den / num) + 1e-6)) if num < den else F.col("size")
    rows = keys.join(small_side(shared), F.col("g") == F.col("h"), "left_semi").select("g", F.explode(F.array(cell, cell + 1)).alias("q"), "r", "c")
    near = _in_blocks(rows, ["g", "q"]).join(sketches, F.col("r") == F.col("i")) \
        .select("g", "q", "x", "y", "own", "r", "c", "size", "sketch").repartition("g", "q", "x", "y").sortWithinPartitions("g", "q", "x", "y")
    near = fixed(map_rows(near, _grouped(4, lambda groups: _screened_blocks(groups, num, den)),
                          f"g long, q long, x long, y long, own long, r {kind}, c {kind}"))
    if not near.limit(1).count():
        return None
    # the same rows pass under many shingles: what passes together is one group, whose texts are read once
    star = near.groupBy("g", "q", "x", "y").agg(F.min("r").alias("lo")).withColumnsRenamed({"g": "g2", "q": "q2", "x": "x2", "y": "y2"})
    same = (F.col("g") == F.col("g2")) & (F.col("q") == F.col("q2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
    group = components(near.join(star, same).select("r", "lo").distinct(), "r", "lo")
    left = near.select("r", "c").distinct().join(group, F.col("r") == F.col("node")).select(F.col("component").alias("g"), "r", "c")
    texts = _texts(d, left.select("r"))
    full = _in_blocks(left, ["g"]).join(texts, F.col("r") == F.col("doc_id")).select("g", F.lit(0).alias("q"), "x", "y", "own", "r", "c", "t")

    def multiply(groups):
        shingle = Shingler(n)
        for (_, _, x, y), rows in groups:
            sides = {x: [], y: []}
            for own, r, c, t in rows:
                sides[own].append((r, c, shingle(t)))
            a, b = sides[x], sides[y]
            joined = set()
            for i, j in products([z[2] for z in a], [z[2] for z in b], num, den):
                (r, c, _), (q, e, _) = a[i], b[j]
                if c != e and (c, e) not in joined:  # one link between two components is enough
                    joined.add((c, e))
                    yield r, q

    both = full.repartition("g", "q", "x", "y").sortWithinPartitions("g", "q", "x", "y")
    return fixed(map_rows(both, _grouped(4, multiply), f"a {kind}, b {kind}"))


def _in_blocks(rows, keys: list[str]):
    """Rows of the groups with several components, dealt into blocks of about ``BLOCK``; a row is there
    once for each block that its own (``own``) meets: ``x <= y`` are the two."""
    names = {k: f"{k}_" for k in keys}
    count = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"), F.min("c").alias("lo"), F.max("c").alias("hi")) \
        .where("lo < hi").select(*keys, "parts").withColumnsRenamed(names)
    same = F.lit(True)
    for k, v in names.items():
        same &= F.col(k) == F.col(v)
    dealt = rows.join(count, same).withColumn("own", F.pmod(F.xxhash64("r"), F.col("parts")))
    # a block is copied once for each block that it meets, not for each of their rows
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select(*keys, F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), "own", "r", "c")


def _screened_blocks(groups, num, den):
    """The rows of two blocks that may be linked to a row of the other block and another component."""
    for (g, q, x, y), rows in groups:
        sides = {x: [], y: []}
        for own, r, c, size, bits in rows:
            sides[own].append((r, c, size, np.frombuffer(bits, np.uint8)))
        a, b = sides[x], sides[y]
        number = {c: k for k, c in enumerate({z[1] for z in (*a, *b)})}
        by_width = {}
        for j, z in enumerate(b):
            by_width.setdefault(len(z[3]), []).append(j)
        classes = [(w, np.array(js), np.array([number[b[j][1]] for j in js]), np.array([b[j][2] for j in js]), np.stack([b[j][3] for j in js]))
                   for w, js in by_width.items()]
        mine, other = set(), set()
        for i, (_, c, size, bits) in enumerate(a):
            for w, js, comps, sizes, matrix in classes:
                hit = js[may_link(size, bits, sizes, matrix, num, den) & (comps != number[c])]
                if len(hit):
                    mine.add(i)
                    other.update(hit.tolist())
        if x == y:
            mine, other = mine | other, set()
        for side, rows_of_side, own in ((mine, a, x), (other, b, y)):
            for i in sorted(side):
                yield g, q, x, y, own, rows_of_side[i][0], rows_of_side[i][1]


def _grouped(keys: int, fn):
    """``fn`` over (key, rows) of sorted rows whose first ``keys`` columns are the key."""
    from itertools import groupby

    def run(rows):
        return fn((k, (r[keys:] for r in g)) for k, g in groupby(rows, key=lambda r: r[:keys]))
    return run


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are not the smallest id of their component. Rows with
    NULL id stay; of rows with the same id all stay or go."""
    part = jaccard_components(docs, doc_id, text, **options)
    name = free_name(docs, "__gone")
    gone = fixed(part.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(small_side(gone), docs[doc_id] == F.col(name), "left_anti")
