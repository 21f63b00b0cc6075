import zlib
from collections import defaultdict

import numpy as np
from edge_rows import SMALL, edge  # noqa: F401

from corpusprep.llm import queries as Q
from corpusprep.llm.packing import WordTokenizer, assign, pack, powers


def check(rows, texts, max_tokens=2048):
    """Every id in exactly one piece, sequences gapless and within their padded length."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= max_tokens
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    return padding


def test_query_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check(Q.op9_cost_balanced_packing(spark, SMALL).collect(), texts) == 0


def test_edge_rows(spark, edge):
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    rows = pack(edge.dropDuplicates(["doc_id"]).repartition(3), Q.tokenizer_path(), group=2).collect()
    assert check(rows, texts) == 0
    assert pack(edge.limit(0), Q.tokenizer_path()).count() == 0
    assert pack(edge, Q.tokenizer_path()).where("doc_id = 6").count() == 2  # repeated rows are packed each


def test_ids_of_odd_texts():
    from tokenizers import Tokenizer

    full, fast = Tokenizer.from_file(Q.tokenizer_path()), WordTokenizer(Q.tokenizer_path())
    for t in ["", " ", "Don't we'LL I'd x's", "A1b2 3.14 --- ...!?", "ÀÉÎ ß ŒUVRE ſ İ Σας ΣΑΣ", "é ́x a b c\td\x85e\x1cf",
              "<|startoftext|> <|endoftext|>,", "漢字 かな 한국어 🙂🙂", "Tschüß, naïve! word.!!;", "\n\n a \r\n b", "Ünï,cödé;x:y", "À,!! É.??"]:
        assert fast.ids(t).tolist() == full.encode(t, add_special_tokens=False).ids, t


def test_new_words_are_encoded_once_and_together():
    from tokenizers import Tokenizer

    full, fast = Tokenizer.from_file(Q.tokenizer_path()), WordTokenizer(Q.tokenizer_path())
    texts = [" ".join(f"{a}{b}" for a in ("Wo", "ré", "x") for b in ("rd", "lo,", f"ab{'c' * (k % 7)}.", f"n{k % 9}-z")) for k in range(300)]
    asked, calls = [], []
    for name in ("_plain", "_whole"):
        def counted(words, real=getattr(fast, name)):
            asked.extend(words)
            calls.append(len(words))
            return real(words)
        setattr(fast, name, counted)
    for block in (texts[:150], texts[150:]):
        for ids, t in zip(fast.many(block), block):
            assert ids.tolist() == full.encode(t, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) > 40 and len(calls) <= 4


def test_ids_of_random_texts_in_small_calls(monkeypatch):
    from tokenizers import Tokenizer

    from corpusprep.llm import packing

    monkeypatch.setattr(packing, "ENCODE_CHARS", 30)
    full, fast = Tokenizer.from_file(Q.tokenizer_path()), WordTokenizer(Q.tokenizer_path())
    rng = np.random.default_rng(5)
    alphabet = [*"abcdeABCÀÉÿß×÷'.,!?;:-_0123 <|>  \n\t\r\x1c\x85\xa0\u0301\u03a3\u03c3\u0130漢字🙂", "<|endoftext|>", "'ll", "</w>", "a" * 50]
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 400)]
    for k in range(0, 400, 16):
        for ids, t in zip(fast.many(texts[k:k + 16]), texts[k:k + 16]):
            assert ids.tolist() == full.encode(t, add_special_tokens=False).ids, t
        assert len(fast.known) < 16 * 60 and max(map(len, fast.known)) <= packing.CACHE_CHARS


def test_blocks_hold_all_rows_in_order(monkeypatch):
    from corpusprep.llm import packing

    monkeypatch.setattr(packing, "BLOCK_CHARS", 20)
    rows = [(k, None if k % 5 == 0 else "ab " * (k % 11)) for k in range(60)] + [(None, "x" * 90), (7, "")]
    blocks = list(packing._blocks(iter(rows)))
    assert [r for b in blocks for r in b] == [(k, t or "") for k, t in rows]
    assert len(blocks) > 5 and list(packing._blocks(iter([]))) == []


def test_balance():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1500, 900)
    total = int(lengths.sum())
    room = np.array([2048] * (total // 2048) + powers(total % 2048))
    out = assign(lengths, room)
    assert sum(x[2] for x in out) == total
    cost = np.zeros(len(room))
    for _, _, n, s, _ in out:
        cost[s] += n + n * n / 6144
    full = cost[:total // 2048]
    # against packing in the given order
    plain, at = np.zeros(total // 2048 + 1), 0
    for n in lengths.tolist():
        while n:
            part = min(n, 2048 - at % 2048)
            plain[at // 2048] += part + part * part / 6144
            at, n = at + part, n - part
    assert full.std() < plain[:-1].std()
