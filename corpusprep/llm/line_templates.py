"""Line dedup with a log-template tree.

Lines are parsed by a tree of fixed depth: token count, then the leading ``DEPTH`` tokens, with
tokens that hold a digit read as the variable field ``<*>``. Under a leaf, lines that agree in
``SIMILAR`` of their tokens (and in ``MIN_CONSTANT`` at least) share a template; the tokens in
which they differ become variable fields. A template that recurs across documents is dropped,
with all its lines.

Recurrence is counted in hosts: documents with equal text count once, and near copies count as one
host, whatever their number, so that the lines of copied documents are not taken for boilerplate and
adding copies changes no verdict. Near copies agree in ``COPY`` of the minimum hashes of their
``SHINGLE``-word shingles, and a host is a component of such texts; every other text is a host of its
own. So texts that share boilerplate lines are no copies, however many of their lines that is, as
long as their own words make up a good part of them. A template is dropped if it has ``min_hosts``
hosts.

Distribution: a document becomes arrays of 64-bit hashes (lines, leaves) and a sketch. Counting is by
``groupBy`` with map-side combine; only lines of leaves that hold several different lines and
enough hosts are read again as text and merged, leaf by leaf, in sorted order. A leaf of more than
``LEAF_LINES`` lines is dealt out by the connected components of the blocks of tokens that its
lines share; lines of different components cannot merge, so the result is that of the whole leaf.
Nothing is broadcast without a size check and nothing is collected.

Edge cases: NULL and empty texts have no lines and come back as they are; blank lines are never
dropped; ids are not read, so NULL ids, repeated ids and repeated rows are kept row by row; extra
columns pass through (output columns replace columns of the same name).
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import fixed, free_name, map_rows, small_side, text_key, text_of
from corpusprep.llm.components import components

DEPTH = 3
SIMILAR = 0.8
MIN_CONSTANT = 5
LEAF_LINES = 2000
MIN_HOSTS = 3
#: Words of a shingle, minimum hashes of a sketch, those that a band joins, and how many of them near
#: copies agree in (0.7; copies that share 0.8 of their five-word shingles share 0.87 of three words).
SHINGLE, MINIMA, BAND, COPY = 3, 64, 4, 45
#: Bytes of a text that are hashed at a time (up to the next white space).
CHUNK = 1 << 20

FIELD = "<*>"
_DIGIT = re.compile(r"\S*[0-9]\S*")


def _long(x: str) -> int:
    h = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def parse(line: str) -> list[str]:
    """Tokens with variable fields masked."""
    return (_DIGIT.sub(FIELD, line) if any(c in line for c in "0123456789") else line).split()


def document_lines(text: str):
    """(line hashes, leaf hashes): one entry for each line of ``text``, NULL if blank."""
    lines, leaves = [], []
    for line in text.split("\n"):
        tokens = parse(line)
        if not tokens:
            lines.append(None)
            leaves.append(None)
            continue
        lines.append(_long(" ".join(tokens)))
        leaves.append(_long(f"{len(tokens)} {' '.join(tokens[:DEPTH])}"))
    return lines, leaves


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    #: A number for each byte (A-Z as a-z) and for each place in a word; a word is the sum of the products.
    _BYTE = _mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) * _MIX[0] + _MIX[3])
    _PLACE = _mixed(np.arange(256, dtype=np.uint64) * _MIX[3] + _MIX[0]) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of UTF-8 bytes, in order."""
    inside = ~_IS_SPACE[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])  # where in ``at`` a word begins
    place = np.minimum(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))), 255)
    with np.errstate(over="ignore"):
        return np.add.reduceat(_BYTE[data[at]] * _PLACE[place], first)


def sketch(text: str | None) -> np.ndarray | None:
    """The least shingle hash in each of ``MINIMA`` bins of the hash range (lower halves); an empty bin
    takes that of the next one. Two texts agree in a bin with a chance of the Jaccard similarity of
    their sets of ``SHINGLE``-word shingles. None for a text without words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    least, at, any_word = np.full(MINIMA, np.uint64(2**64 - 1)), 0, False
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        w = _word_hashes(data[at:end])
        at = end
        if len(w):
            any_word = True
            n = min(SHINGLE, len(w))
            m = len(w) - n + 1
            with np.errstate(over="ignore"):
                h = _mixed(sum(w[k:k + m] * _MIX[k] for k in range(n)))
            np.minimum.at(least, (h >> np.uint64(64 - MINIMA.bit_length() + 1)).astype(np.int64), h)
    if not any_word:
        return None
    full = np.flatnonzero(least != np.uint64(2**64 - 1))
    return least[full[np.searchsorted(full, np.arange(MINIMA)) % len(full)]].astype(np.uint32)


def bands(least: np.ndarray) -> list[int]:
    """Hashes of ``BAND`` minima at a time, each with its number."""
    out = [xxhash.xxh3_64_intdigest(least[i:i + BAND].tobytes(), seed=i) for i in range(0, MINIMA, BAND)]
    return [h - (1 << 64) if h >> 63 else h for h in out]


def _parsed(rows):
    for key, text in rows:
        lines, leaves = document_lines(text)
        least = sketch(text)
        yield key, lines, leaves, None if least is None else least.tobytes(), [] if least is None else bands(least)


def block_keys(tokens: list[str]) -> list[tuple[int, str]]:
    """Blocks of the tokens after the leading ones, without variable fields: as many blocks as tokens
    may differ, and one more, so lines (or a line and a template) that merge have one in common."""
    n = len(tokens)
    may_differ = n - math.ceil(max(MIN_CONSTANT, SIMILAR * n)) - tokens[:DEPTH].count(FIELD)
    if may_differ <= 0:  # only a line with the same tokens could merge
        return []
    cuts = [DEPTH + (n - DEPTH) * k // (may_differ + 1) for k in range(may_differ + 2)]
    blocks = enumerate(tokens[i:j] for i, j in zip(cuts, cuts[1:]))
    return [(k, " ".join(x)) for k, x in blocks if FIELD not in x]


def merge_leaf(lines) -> list[tuple[int, int, str]]:
    """(line hash, template hash, template) for the lines of one leaf that share a template. A line
    goes to the template that it agrees with most, the first of several; only templates with one of
    its blocks can agree enough, so only these are compared."""
    groups: list[tuple[list, list[int]]] = []
    index: dict[tuple[int, str], dict[int, None]] = {}
    for h, tokens in lines:
        keys = block_keys(tokens)
        best, most = None, -1
        for at in sorted({g for k in keys for g in index.get(k, ())}):
            same = sum(a == b for a, b in zip(groups[at][0], tokens) if a != FIELD)
            if same > most:
                best, most = at, same
        if best is not None and most >= max(MIN_CONSTANT, SIMILAR * len(tokens)):
            template, members = groups[best]
            if most < len(tokens) - template.count(FIELD):
                old = block_keys(template)
                template[:] = [a if a == b else FIELD for a, b in zip(template, tokens)]
                for k in set(old).difference(block_keys(template)):
                    index[k].pop(best, None)
            members.append(h)
        elif keys:
            for k in keys:
                index.setdefault(k, {})[len(groups)] = None
            groups.append((list(tokens), [h]))
    out = []
    for template, members in groups:
        if len(members) > 1:
            name = " ".join(template)
            out += [(h, _long("template " + name), name) for h in members]
    return out


def _merged(rows):
    from itertools import groupby

    for _, same in groupby(rows, key=lambda r: r[:2]):
        yield from merge_leaf((h, parse(line)) for _, _, h, line in same)


def _line_keys(rows):
    for leaf, line, text in rows:
        for k, block in block_keys(parse(text)):
            yield line, _long(f"{leaf} {k} {block}")


def copy_hosts(parsed: DataFrame) -> DataFrame:
    """``(copy, host)`` for the texts (by ``text_id``) that have near copies. A text is compared with
    the smallest id of each of its bands, so it meets few others however large the group is."""
    rows = parsed.select(text_id().alias("id"), F.explode("bands").alias("band"))
    first = rows.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("rep")).where("c > 1").select(F.col("band").alias("b"), "rep")
    met = fixed(rows.join(first, F.col("band") == F.col("b")).where("id <> rep").select("id", "rep").distinct())
    if not met.limit(1).count():
        return met.select(F.col("id").alias("copy"), F.col("rep").alias("host"))
    sketches = parsed.select(text_id().alias("s"), "sketch")
    mine = sketches.join(small_side(met), F.col("s") == F.col("id")).select("id", "rep", F.col("sketch").alias("a"))
    reps = fixed(sketches.join(small_side(met.select(F.col("rep").alias("r")).distinct()), F.col("s") == F.col("r"), "left_semi"))
    both = mine.join(small_side(reps), F.col("rep") == F.col("s")).select("id", "rep", "a", F.col("sketch").alias("b"))

    def agree(rows):
        for i, rep, x, y in rows:
            if (np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum() >= COPY:
                yield i, rep

    links = fixed(map_rows(both, agree, "id long, rep long"))
    if not links.limit(1).count():
        return links.select(F.col("id").alias("copy"), F.col("rep").alias("host"))
    return components(links, "id", "rep").select(F.col("node").alias("copy"), F.col("component").alias("host"))


def text_id() -> Column:
    return F.xxhash64("key.a", "key.b")


def recurring(parsed: DataFrame, texts: DataFrame, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """``(line, template)``: the line hashes that are dropped. ``parsed``: distinct texts
    (``key lines leaves sketch bands``); ``texts``: ``key text``, at least one row for each."""
    # a text that is no copy is a host of its own
    hosts = copy_hosts(parsed)
    parsed = parsed.drop("sketch", "bands").withColumn("id", text_id()).join(small_side(hosts), F.col("id") == F.col("copy"), "left") \
        .withColumn("host", F.coalesce("host", "id"))
    each = parsed.select("key", "host", F.posexplode(F.arrays_zip("lines", "leaves")).alias("pos", "x")) \
        .select("key", "host", "pos", F.col("x.lines").alias("line"), F.col("x.leaves").alias("leaf")).where("line is not null")
    counted = fixed(each.groupBy("line", "leaf", "host").agg(F.min(F.struct("key", "pos")).alias("at")))
    # the hosts of a line are combined before lines meet by leaf
    lines = counted.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("hosts"), F.min("at").alias("at"))
    leaf = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("hosts").alias("hosts")) \
        .where((F.col("n_lines") > 1) & (F.col("hosts") >= min_hosts)).select(F.col("leaf").alias("lf"), "n_lines")
    # one place for each line of these leaves, and its text
    places = lines.join(leaf, F.col("leaf") == F.col("lf"))
    wanted = fixed(places.select("line", "leaf", "n_lines", F.col("at.key").alias("k"), F.col("at.pos").alias("pos"))
                   .groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "leaf", F.col("n_lines").alias("n")))).alias("want"),
                                     F.collect_list("pos").alias("at")))
    found = texts.join(small_side(wanted, 100_000), F.col("key") == F.col("k")) \
        .select("want", F.filter(F.split("text", "\n"), lambda x, i: F.array_contains(F.col("at"), i)).alias("text")) \
        .select(F.explode(F.arrays_zip("want", "text")).alias("x")).select("x.want.line", "x.want.leaf", "x.want.n", "x.text") \
        .groupBy("line", "leaf", "n").agg(F.min("text").alias("text"))
    # an over-full leaf is dealt by components of shared blocks: lines of one template are in one
    # component, so the templates are those of the whole leaf
    leaves = found.select("leaf", F.lit(0).cast("long").alias("deal"), "line", "text", "n")
    if wanted.where(F.exists("want", lambda x: x["n"] > LEAF_LINES)).limit(1).count():
        full = fixed(found.where(F.col("n") > LEAF_LINES).select("leaf", "line", "text"))
        keys = fixed(map_rows(full, _line_keys, "line long, key long"))
        shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
        deal = components(keys.join(shared, "key", "left_semi"), "line", "key")
        dealt = full.join(deal, F.col("line") == F.col("node")).select("leaf", F.col("component").alias("deal"), "line", "text")
        leaves = leaves.where(F.col("n") <= LEAF_LINES).drop("n").unionByName(dealt)
    leaves = leaves.select("leaf", "deal", "line", "text").repartition("leaf", "deal").sortWithinPartitions("leaf", "deal", "text", "line")
    merged = fixed(map_rows(leaves, _merged, "line long, template long, pattern string"))
    names = merged.select(F.col("line").alias("m"), "template")
    rows = counted.join(small_side(names), F.col("line") == F.col("m"), "left") \
        .withColumn("template", F.coalesce("template", "line"))
    drop = rows.select("template", "host").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("hosts")) \
        .where(F.col("hosts") >= min_hosts).select(F.col("template").alias("tp"))
    direct = drop.select(F.col("tp").alias("line"), F.col("tp").alias("template"))
    by_merge = merged.select("line", "template").join(drop, F.col("template") == F.col("tp"), "left_semi")
    # a merged line is judged by its template only
    return direct.join(merged.select(F.col("line").alias("m")), F.col("line") == F.col("m"), "left_anti").unionByName(by_merge)


def _verdicts(docs: DataFrame, text: str, min_hosts: int) -> DataFrame:
    """``(k, dropped)``: for each text that loses lines, their numbers (from 0)."""
    own = docs.select(text_key(text).alias("key"), text_of(text).alias("text"))
    parsed = map_rows(own, _parsed, "key struct<a:long,b:long>, lines array<long>, leaves array<long>, sketch binary, bands array<long>")
    # equal texts count once
    parsed = fixed(parsed.groupBy("key").agg(F.first("lines").alias("lines"), F.first("leaves").alias("leaves"),
                                              F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    drop = fixed(recurring(parsed, own, min_hosts).select(F.col("line").alias("gone")).distinct())
    each = parsed.select("key", F.posexplode("lines").alias("pos", "line")).where("line is not null")
    return each.join(small_side(drop), F.col("line") == F.col("gone"), "left_semi") \
        .groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("dropped")).select(F.col("key").alias("k"), "dropped")


def drop_templates(docs: DataFrame, text: str = "text", min_hosts: int = MIN_HOSTS) -> DataFrame:
    """``docs`` with the lines of recurring templates gone from ``text``, plus ``n_lines`` (with a
    token, before), ``n_dropped`` and ``dropped`` (their numbers, from 0)."""
    key, k, gone = (free_name(docs, n) for n in ("__key", "__k", "__dropped"))
    verdict = _verdicts(docs, text, min_hosts).select(F.col("k").alias(k), F.col("dropped").alias(gone))
    d = docs.withColumn(key, text_key(text)).join(verdict, F.col(key) == F.col(k), "left")
    dropped: Column = F.col(gone)
    lines = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(dropped, i)), "\n")
    return d.withColumns({
        "n_lines": F.size(F.filter(F.split(text_of(text), "\n"), lambda x: x.rlike(r"\S"))).cast("long"),
        text: F.when(dropped.isNotNull(), kept).otherwise(F.col(text)),
        "n_dropped": F.when(dropped.isNotNull(), F.size(dropped)).otherwise(0).cast("long"),
        "dropped": F.coalesce(dropped, F.array().cast("array<int>")),
    }).drop(key, k, gone)
