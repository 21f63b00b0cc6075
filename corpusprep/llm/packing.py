"""Cost-balanced packing of tokenised documents into sequences.

A task tokenises its documents and packs them in groups of ``GROUP`` full sequences. In a group,
whole sequences' worth of a long document go out as they are; the remaining pieces are taken by
descending cost and each goes to the sequence of lowest cost that has room. The cost of a piece
of n tokens is ``linear * n + quadratic * n**2`` (attention inside a document). Pieces that fit
nowhere whole are cut to fill the gaps, so full sequences have no padding. What is left of a
task's last group fills sequences whose lengths are powers of two (these need no padding either).

Nothing is shuffled and no group grows with the data: memory per task is one group of tokens
and one block of texts (or the longest document). ``sequence_id`` is the input partition in the
upper bits and a counter below, so ids are unique without coordination and a lost task is simply
run again.

A block of texts is split into white-space chunks, and each distinct one is encoded once, many in
one call. Words of plain Latin letters with trailing marks, for which the normaliser lower-cases and
the pre-tokenizer splits off the marks, go straight to the tokenizer's model; every other chunk goes
through the whole tokenizer. Tests compare the ids with those of the tokenizer on whole texts.

Edge cases: a NULL or empty text is the single end id; NULL ids stay NULL and repeated rows are
packed each; an empty table gives no row. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import map_rows

MAX_TOKENS = 2048
GROUP = 512
END_ID = 1
#: Attention: 12 * width**2 against 2 * width per pair of tokens, for a width of 1,024.
LINEAR, QUADRATIC = 1.0, 2 * 1024 / (12 * 1024**2)
#: Characters of the texts that are looked at together, of the longest word that is remembered for
#: the next block, and of the words in one call of the tokenizer.
BLOCK_CHARS = 8 << 20
CACHE_CHARS = 40
ENCODE_CHARS = 1 << 17

_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_MARKS = ".,!?;:"
_PLAIN = rf"^[{_LETTERS}]+[{_MARKS}]*$"


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level tokenizers write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit numbers; a block of texts has each word
    encoded once, and the next block takes over the words that both have."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.full = Tokenizer.from_file(path)
        self.model = Tokenizer(self.full.model)  # without normaliser: for plain words in byte letters
        self.model.pre_tokenizer = WhitespaceSplit()
        self.letters = _byte_letters()
        self.known = {"": b""}

    def _plain(self, words: list[str]):
        text = " ".join(words)
        if not text.isascii():
            text = " ".join(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words)
        return self.model.encode(text, add_special_tokens=False)

    def _whole(self, chunks: list[str]):
        return self.full.encode(chunks, is_pretokenized=True, add_special_tokens=False)

    def _learn(self, items: list[str], encode) -> None:
        """Takes up the ids of those of ``items`` that are new; ``encode`` gets some of them at a time."""
        new, some, size = [x for x in items if x not in self.known], [], 0
        for k, item in enumerate(new, 1):
            some.append(item)
            size += len(item)
            if size >= ENCODE_CHARS or k == len(new):
                e = encode(some)
                ids = np.array(e.ids, "<u4").tobytes()
                ends = (4 * np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)).cumsum()).tolist()
                self.known.update(zip(some, [ids[i:j] for i, j in zip([0, *ends], ends)]))
                some, size = [], 0

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.large_string()
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, kind), "\n", " "), " ")
        ends = lists.offsets.to_numpy()
        found = lists.values.dictionary_encode()
        chunk_of, chunks = found.indices.to_numpy(), found.dictionary
        del lists, found

        # a plain chunk is a word and its marks, any other one a piece by itself
        is_plain = pc.match_substring_regex(chunks, _PLAIN)
        plain, odd = chunks.filter(is_plain), _strings(chunks.filter(pc.invert(is_plain)))
        words, marks = pc.utf8_lower(pc.utf8_rtrim(plain, _MARKS)), pc.utf8_ltrim(plain, _LETTERS)
        pieces = pa.concat_arrays([words, marks]).dictionary_encode()
        piece_of, plain = pieces.indices.to_numpy(), _strings(pieces.dictionary)
        self._learn(plain, self._plain)
        self._learn(odd, self._whole)
        names = [*plain, *odd, ""]
        pool = [self.known[x] for x in names]
        self.known = {x: ids for x, ids in zip(names, pool) if len(x) <= CACHE_CHARS}
        counts = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        starts, counts = np.cumsum(counts) - counts, counts.astype(np.int32)
        pool = np.frombuffer(b"".join(pool), "<u4")
        pair = np.full((len(chunks), 2), len(counts) - 1, np.int32)
        mask = is_plain.to_numpy(zero_copy_only=False)
        pair[mask, 0], pair[mask, 1] = piece_of[:len(words)], piece_of[len(words):]
        pair[~mask, 0] = np.arange(len(plain), len(plain) + len(odd))

        # the ids of all texts in a row
        at = pair[chunk_of].ravel()
        n = counts[at]
        after = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        narrow = np.int32 if after[-1] < 1 << 31 else np.int64
        place = np.repeat((starts[at] - after[:-1]).astype(narrow), n)
        place += np.arange(len(place), dtype=narrow)
        ids, cuts = pool[place], after[2 * ends].tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


def _strings(a) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def _blocks(rows):
    """The rows (document id, text) in lists of about ``BLOCK_CHARS`` characters."""
    block, size = [], 0
    for doc, t in rows:
        block.append((doc, t or ""))
        size += 1 + len(t or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def assign(lengths: np.ndarray, room: np.ndarray, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Pieces of ``lengths`` (each at most the largest room; in total exactly the rooms) to
    sequences: (piece, start in piece, length, sequence, offset), in order of assignment."""
    left, cost = room.astype(np.int64).copy(), np.zeros(len(room))
    out, cut = [], []

    def put(piece, start, n, s):
        out.append((piece, start, n, s, int(room[s] - left[s])))
        left[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        s = int(np.argmin(np.where(left >= n, cost, np.inf)))
        if left[s] >= n:
            put(piece, 0, n, s)
        else:
            cut.append(piece)
    for piece in cut:  # the largest gaps first, so that there are few cuts
        start, n = 0, int(lengths[piece])
        while n:
            s = int(np.argmax(left))
            part = min(n, int(left[s]))
            put(piece, start, part, s)
            start, n = start + part, n - part
    return out


def powers(n: int) -> list[int]:
    """``n`` as a sum of different powers of two, descending."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


SCHEMA_TAIL = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
         max_tokens: int = MAX_TOKENS, end_id: int = END_ID, group: int = GROUP,
         linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` in the document, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence and its ``padded_length``; with
    ``with_ids`` the token ids too (for writing the training files)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {SCHEMA_TAIL}" + ", ids array<int>" * with_ids

    def run(docs_in):
        from pyspark import TaskContext

        tok = WordTokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 33
        state = {"next": 0}
        full_group = group * max_tokens
        held: list[tuple] = []  # (doc id, start, ids, tokens of the document), below one sequence each

        def row(doc, start, ids, total, seq, offset, padded):
            r = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + seq, offset, padded)
            return (*r, ids.tolist()) if with_ids else r

        def flush(last: bool):
            lengths = np.array([len(x[2]) for x in held], np.int64)
            total = int(lengths.sum())
            room = [max_tokens] * (total // max_tokens) + (powers(total % max_tokens) if last else [])
            own = total if last else total - total % max_tokens
            # pieces beyond the full sequences wait for the next group
            n, take = 0, []
            for k, size in enumerate(lengths.tolist()):
                if n == own:
                    break
                part = min(size, own - n)
                take.append((k, part))
                n += part
            pieces = []
            for k, part in take:
                doc, start, ids, tokens = held[k]
                pieces.append((doc, start, ids[:part], tokens))
            rest = []
            if take:
                k, part = take[-1]
                doc, start, ids, tokens = held[k]
                if part < len(ids):
                    rest = [(doc, start + part, ids[part:], tokens)]
                rest += held[k + 1:]
            rows = []
            if pieces:
                rooms = np.array(room, np.int64)
                for p, at, n, s, off in assign(np.array([len(x[2]) for x in pieces]), rooms, linear, quadratic):
                    doc, start, ids, tokens = pieces[p]
                    rows.append(row(doc, start + at, ids[at:at + n], tokens, state["next"] + s, off, int(rooms[s])))
                state["next"] += len(rooms)
            held[:] = rest
            return rows

        def tokenised():
            for block in _blocks(docs_in):
                yield from zip((doc for doc, _ in block), tok.many([t for _, t in block]))

        waiting = 0
        end = np.array([end_id], "<u4")
        for doc, ids in tokenised():
            ids = np.concatenate([ids, end])
            at, total = 0, len(ids)
            while total - at >= max_tokens:
                yield row(doc, at, ids[at:at + max_tokens], total, state["next"], 0, max_tokens)
                state["next"] += 1
                at += max_tokens
            if at < total:
                held.append((doc, at, ids[at:].copy(), total))
                waiting += total - at
            if waiting >= full_group:
                yield from flush(False)
                waiting = sum(len(x[2]) for x in held)
        yield from flush(True)

    return map_rows(d, run, schema)
