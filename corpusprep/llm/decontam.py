"""Benchmark decontamination by greedy string tiling.

A test item and a document are compared as word sequences. Shared 5-word seeds find the pairs;
for each pair running Karp-Rabin searches mark the longest matches that do not overlap, long
ones first, and the share of the item's words under tiles is its coverage. Moved or reordered
passages keep their tiles, so they keep their coverage.

The benchmark is the stated query set: it is read in blocks of bounded size (``BLOCK_WORDS``
words) and each block scans the documents once, without a shuffle; nothing about the documents
reaches the driver. A pair whose seeds cannot reach the threshold is not tiled (exact bound:
every tile consists of seeds).

Words of scripts that are written without spaces (Chinese, Japanese, Thai and others) are their single
characters. An item with fewer words than a seed is its own seed and matches only where a document
holds the whole item, word for word.

Edge cases: NULL or empty texts match nothing; repeated rows and repeated items are reported each; an empty benchmark gives no
row. Only the named id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import fixed, free_name, map_rows, small_side

WORD = re.compile(r"\w+")
# Scripts without spaces between words (Thai, Lao, Myanmar, Khmer, kana, bopomofo, Han).
_RUN = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
        "\uff66-\uff9f\U00020000-\U0003ffff")
_UNSPACED = re.compile(f"[{_RUN}]")
_WORD_OR_CHARACTER = re.compile(rf"[^\W{_RUN}]+|(?=\w)[{_RUN}]")
MIN_MATCH = 5
FIRST_LENGTH = 32
BLOCK_WORDS = 1_000_000
THRESHOLD = 0.5

_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return (WORD if low.isascii() or not _UNSPACED.search(low) else _WORD_OR_CHARACTER).findall(low)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin values (modulo 2**64) of all windows of ``n`` ids."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * _BASE + ids[k:k + m]
    return h


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH,
                 first: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length) by running Karp-Rabin greedy string tiling."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(min_match, min(first, len(item), len(doc)))
    while True:
        found = [(-n, i, d) for i, d, n in _maximal(item, doc, free_i, free_d, length)]
        longest = -min(found)[0] if found else 0
        if longest > 2 * length:  # much longer matches exist: search at their length first
            length = longest
            continue
        heapq.heapify(found)
        while found:
            n, i, d = heapq.heappop(found)
            n = -n
            free = free_i[i:i + n] & free_d[d:d + n]
            if free.all():
                free_i[i:i + n] = False
                free_d[d:d + n] = False
                tiles.append((i, d, n))
                continue
            # partly taken by longer tiles: what is left of it takes its place by length
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if hi - lo >= length:
                    heapq.heappush(found, (lo - hi, i + lo, d + lo))
        if length == min_match:
            return sorted(tiles)
        length = max(min_match, length // 2)


def _maximal(item, doc, free_i, free_d, length) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``length`` unmarked words."""
    def starts(free):
        run = np.convolve(free.astype(np.int32), np.ones(length, np.int32), "valid") if len(free) >= length else np.zeros(0, np.int32)
        return np.flatnonzero(run == length)
    at_i, at_d = starts(free_i), starts(free_d)
    if not len(at_i) or not len(at_d):
        return []
    hi, hd = rolling(item, length), rolling(doc, length)
    at_d = at_d[np.isin(hd[at_d], hi[at_i])]
    order = np.argsort(hd[at_d], kind="stable")
    at_d, keys = at_d[order], hd[at_d][order]
    # words before which a match of theirs would have begun earlier: an id that nothing equals at the edges
    before_i = np.concatenate([[-1], np.where(free_i[:-1], item[:-1].astype(np.int64), -1)])
    before_d = np.concatenate([[-2], np.where(free_d[:-1], doc[:-1].astype(np.int64), -2)])
    out = []
    for i in at_i.tolist():
        lo, up = np.searchsorted(keys, hi[i], "left"), np.searchsorted(keys, hi[i], "right")
        places = at_d[lo:up]
        for d in places[before_d[places] != before_i[i]].tolist():
            if not np.array_equal(item[i:i + length], doc[d:d + length]):
                continue  # equal hash, different words
            n = length
            while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                n += 1
            out.append((i, d, n))
    return out


class _Seeds:
    """Sorted Karp-Rabin values of ``length`` words, with the items and places they come from."""

    def __init__(self, ids: list[tuple[int, np.ndarray]], length: int):
        self.length = length
        seeds = [rolling(x, length) for _, x in ids]
        h = np.concatenate(seeds)
        item = np.repeat(np.array([n for n, _ in ids]), [len(s) for s in seeds])
        at = np.concatenate([np.arange(len(s)) for s in seeds])
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order], at[order]
        # one bit for each low half of a seed: most words of a document stop here
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.hash >> np.uint64(40)).astype(np.int64) & 0xFFFF] = True

    def find(self, doc: np.ndarray) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """By item: (places in the item, places in the document) of each of its seeds that are in
        ``doc``. Items share the arrays, so a seed that repeats on both sides is no product."""
        seen: dict[int, list] = defaultdict(list)
        if len(doc) < self.length:
            return seen
        h = rolling(doc, self.length)
        maybe = np.flatnonzero(self.sieve[(h >> np.uint64(40)).astype(np.int64) & 0xFFFF])
        lo = np.searchsorted(self.hash, h[maybe], "left")
        hi = np.searchsorted(self.hash, h[maybe], "right")
        hit = np.flatnonzero(hi > lo)
        order = hit[np.argsort(lo[hit], kind="stable")]
        for group in np.split(order, np.flatnonzero(np.diff(lo[order])) + 1) if len(order) else ():
            a, b = lo[group[0]], hi[group[0]]
            places, items = maybe[group], self.item[a:b]
            for item in np.unique(items).tolist():
                seen[item].append((self.at[a:b][items == item], places))
        return seen


class _Block:
    """Seeds of some test items; items shorter than a seed are seeds of their own length."""

    def __init__(self, items: list[tuple], min_match: int):
        self.vocab: dict[str, int] = {}
        self.ids, self.keys, self.min_match = [], [], min_match
        by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for key, text in items:
            w = words(text)
            if w:
                ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.uint64)
                by_length[min(len(w), min_match)].append((len(self.ids), ids))
                self.keys.append(key)
                self.ids.append(ids)
        self.seeds = [_Seeds(ids, n) for n, ids in sorted(by_length.items())]

    def matches(self, text: str | None, threshold: float):
        """(item key, item words, covered words, tiles) for each item covered enough."""
        get = self.vocab.get
        doc = np.array([get(w, 0) for w in words(text)], np.uint64)
        k = self.min_match
        seen: dict[int, list] = {}
        for seeds in self.seeds:
            seen.update(seeds.find(doc))
        for item, pairs in sorted(seen.items()):
            ids = self.ids[item]
            if len(ids) < k:  # the whole item, at its first place
                d = next((d for _, places in pairs for d in places.tolist() if np.array_equal(ids, doc[d:d + len(ids)])), None)
                if d is not None:
                    yield self.keys[item], len(ids), len(ids), [(0, d, len(ids))]
                continue
            can, near = np.zeros(len(ids) + 1, np.int64), np.zeros(len(doc) + 1, np.int64)
            for own, places in pairs:
                for side, at in ((can, own), (near, places)):
                    side[at] += 1
                    np.subtract.at(side, at + k, 1)
            can, near = np.cumsum(can[:-1]) > 0, np.cumsum(near[:-1]) > 0
            if can.sum() < threshold * len(ids):
                continue
            # the parts of the document under seeds of this item; a 0 keeps them apart
            cut = np.flatnonzero(near)
            breaks = np.flatnonzero(np.diff(cut) > 1) + 1
            part = np.insert(doc[cut], breaks, 0)
            place = np.insert(cut, breaks, -1)
            tiles = greedy_tiles(ids, part, k)
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(ids):
                yield self.keys[item], len(ids), covered, [(i, int(place[d]), n) for i, d, n in tiles]


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
                       min_match: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and test item whose coverage reaches ``threshold``: the two ids,
    ``item_words``, ``covered_words``, ``coverage`` and ``tiles`` (item start, document start,
    length, in words)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.when(F.octet_length("t") > F.length("t"), F.length("t")).otherwise(F.length("t") / 2 + 1)), F.lit(0))).first()[0]  # no text has more words
    blocks = max(1, -(-int(total) // block_words))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    id_type, key_type = d.schema["doc_id"].dataType.simpleString(), items.schema["k"].dataType.simpleString()
    schema = (f"doc_id {id_type}, item_id {key_type}, item_words int, covered_words int, coverage double, "
              "tiles array<struct<item_start:int,doc_start:int,length:int>>")
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r["k"], r["t"]) for r in own.collect()])
        part = map_rows(d, _scanner(sent, threshold, min_match), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _scanner(sent, threshold: float, min_match: int):
    def scan(rows):
        block = _Block(sent.value, min_match)
        for i, t in rows:
            for key, n, c, tiles in block.matches(t, threshold):
                yield i, key, n, c, c / n, [{"item_start": a, "doc_start": z, "length": m} for a, z, m in tiles]
    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item: the scan's verdicts are one narrow
    row per contaminated document, joined back on the id (NULL ids compare equal)."""
    key = options.get("doc_id", "doc_id")
    name = free_name(docs, "__bad")
    bad = fixed(contaminated_pairs(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(small_side(bad), docs[key].eqNullSafe(F.col(name)), "left_anti")
