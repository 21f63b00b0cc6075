"""One round of BPE learning inside one group, as plain functions that the Spark job of
``bpe_learn`` calls inside its tasks.

A round takes up the pairs that come first by ``(count, left, right)``, the *hot* pairs, and
performs every merge of which it can prove that one merge at a time would perform it too. What it
has to see of the words is a summary of bounded size, in one of two forms:

* **whole words**: the words that hold a hot pair. Every symbol made in the round lies in these
  words, so the count of a pair with a new symbol is exact. Pairs that were not taken up are at
  most the *floor*, the first pair left out, and only fall; the round stops at the floor.
* **runs**: the longest runs of hot pairs, equal runs added up. Pairs cut away have at most the
  floor's count. What becomes of a cut pair ``(u, v)`` is a pair ``(x, y)`` where ``u`` ends ``x``
  and ``v`` starts ``y``: at most the floor's count for each such ``(u, v)``. So the round stops
  at the floor's count times the most ways in which a symbol of it can end and start.

Counts never rise but where one string is made in two ways (``ab + c`` and ``a + bc``). A pair
that this can concern has only an upper bound; the round stops when such a pair comes first.
The next round knows all counts again.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from typing import NamedTuple

from corpusprep.functions.text import END_OF_WORD

#: Whole words are taken where they allow this many hot pairs.
WHOLE_PAIRS = 64


class Round(NamedTuple):
    """``hot``: pair -> count; ``floor``: (count, left, right) of the first pair left out, or
    None; ``form``: 'whole', 'runs', or 'first' (the first pair alone, no summary needed)."""
    hot: dict
    floor: tuple | None
    form: str


def plan_round(cands: list[tuple], most: int, size: int, rows: int, min_freq: int) -> Round | None:
    """The next round from the first ``most + 1`` pairs ``(count, left, right, places)`` in
    falling order; None where no pair reaches ``min_freq``. ``size``: pairs of a round in runs;
    0 asks for the first pair alone. ``rows`` bounds the words of a round in whole words, since
    a pair's places (occurrences in word types) bound the words that hold it."""
    n = 0
    while n < min(len(cands), most) and cands[n][0] >= min_freq:
        n += 1
    if not n:
        return None

    def first(k: int, form: str) -> Round:
        return Round({(l, r): c for c, l, r, _ in cands[:k]}, tuple(cands[k][:3]) if k < len(cands) else None, form)

    whole, places = 0, 0
    while whole < n and places + cands[whole][3] <= rows:
        places += cands[whole][3]
        whole += 1
    if whole == n or whole >= WHOLE_PAIRS:
        return first(whole, "whole")
    k = min(size, n)
    while 0 < k < len(cands) and cands[k][0] == cands[0][0]:
        k += 1  # pairs of equal count are cut nowhere else than below them
    if 0 < k <= n and (k == len(cands) or cands[k][0] < cands[0][0]):
        return first(k, "runs")
    return first(whole, "whole") if whole else first(1, "first")


def cut(syms: list[str], hot, form: str) -> list[list[str]]:
    """The summary rows of one word: itself if it holds a hot pair, or its runs of hot pairs."""
    at = [i for i in range(len(syms) - 1) if (syms[i], syms[i + 1]) in hot]
    if not at:
        return []
    if form == "whole":
        return [syms]
    out, start = [], at[0]
    for i, nxt in zip(at, at[1:] + [-1]):
        if nxt != i + 1:
            out.append(syms[start:i + 2])
            start = nxt
    return out


def joined(syms: list[str], left: str, right: str) -> list[str]:
    """``syms`` with ``left right`` merged, left to right, not overlapping."""
    out, i, n = [], 0, len(syms)
    while i < n:
        if i + 1 < n and syms[i] == left and syms[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def replay(syms: list[str], order: dict) -> list[str]:
    """``syms`` after the merges of a round in their order; ``order``: pair -> its positions in
    the round, rising (a pair can be merged again after its string was made anew)."""
    done = -1
    while len(syms) > 1:
        best, pair = None, None
        for p in zip(syms, syms[1:]):
            for k in order.get(p, ()):
                if k > done:
                    if best is None or k < best:
                        best, pair = k, p
                    break
        if best is None:
            break
        done = best
        syms = joined(syms, *pair)
    return syms


def may_be_a_start(s: str) -> bool:
    """Whether a string made by merges can also be a symbol that words start with: a character with
    the end-of-word marker, in texts that hold the marker itself."""
    return len(s) == 1 + len(END_OF_WORD) and s.endswith(END_OF_WORD)


class _Falling:
    """Sort keys under which the greater string comes first (code points)."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def __call__(self, s: str) -> tuple:
        k = self.known.get(s)
        if k is None:
            k = self.known[s] = tuple(-ord(c) for c in s) + (1,)
        return k


def solve(items: list[tuple[list[str], int]], rnd: Round, budget: int, min_freq: int, old: set) -> list[tuple[str, str, int]]:
    """The merges ``(left, right, count)`` of the round, at most ``budget``. ``items``: the
    summary with its frequencies; ``old``: the symbols made in earlier rounds."""
    hot, floor, form = rnd
    if form == "first":
        (l, r), c = next(iter(hot.items()))
        return [(l, r, c)]
    whole = form == "whole"
    floor_count = floor[0] if floor else 0
    counts = dict(hot)
    where: dict[tuple, set] = defaultdict(set)
    items = [[s, f] for s, f in items]
    for i, (s, _) in enumerate(items):
        for p in zip(s, s[1:]):
            if p in hot:
                where[p].add(i)
    made: set[str] = set()      # made in this round
    fresh: set[str] = set()     # ... and nowhere before
    ends: dict[str, int] = {}   # symbols at the start of the round that can end / start it
    starts: dict[str, int] = {}
    widest = 1
    falling = _Falling()

    def before(s: str) -> bool:
        return s in old or may_be_a_start(s)

    def bound(p: tuple) -> tuple[int, bool]:
        c = counts.get(p, 0)
        if whole:
            sure = p in hot or p[0] in fresh or p[1] in fresh
            return (c, True) if sure else (c + floor_count, False)
        ways = ends.get(p[0], 1) * starts.get(p[1], 1)
        return (c, True) if ways == 1 else (c + floor_count * ways, False)

    def entry(p: tuple) -> tuple:
        return (-bound(p)[0], falling(p[0]), falling(p[1]), p)

    heap = [entry(p) for p in counts]
    heapq.heapify(heap)
    out: list[tuple[str, str, int]] = []
    while heap and len(out) < budget:
        neg, _, _, p = heapq.heappop(heap)
        most, sure = bound(p)
        if most != -neg:
            if most < -neg and most >= min_freq:
                heapq.heappush(heap, entry(p))
            continue
        if most < min_freq or most <= 0:
            break
        if floor and ((most, *p) <= floor if whole else most <= floor_count * widest):
            break
        if not sure:
            break
        left, right = p
        new = left + right
        out.append((left, right, most))
        change: dict[tuple, int] = defaultdict(int)
        for i in where.pop(p, ()):
            s, f = items[i]
            t = joined(s, left, right)
            if len(t) == len(s):
                continue
            for q in zip(s, s[1:]):
                change[q] -= f
            for q in zip(t, t[1:]):
                change[q] += f
                if new in q:
                    where[q].add(i)
            items[i][0] = t
        again = new in made or before(new)
        if whole:
            if not again:
                fresh.add(new)
        else:
            here = 1 if new not in made and before(new) else 0
            ends[new] = ends.get(new, here) + ends.get(right, 1)
            starts[new] = starts.get(new, here) + starts.get(left, 1)
            widest = max(ends.values()) * max(starts.values())
        made.add(new)
        for q, v in change.items():
            if v:
                counts[q] = counts.get(q, 0) + v
        touched = [q for q, v in change.items() if v > 0]
        if again and not whole:
            touched = [q for q in counts if new in q]  # their bounds have changed
        for q in touched:
            if bound(q)[0] >= min_freq:
                heapq.heappush(heap, entry(q))
    return out
