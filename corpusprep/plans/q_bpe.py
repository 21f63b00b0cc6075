"""Registered BPE queries (A2-A4, B1-B6, B10) and their DuckDB oracles.

The learn oracle is the one-merge-per-step definition unrolled into CTEs: step i takes the
``max({c, l, r})`` pair of the current types and rewrites the types with one ``replace``; so
Spark's multi-merge rounds are checked against plain one-at-a-time learning.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators import bpe_apply as ba
from corpusprep.operators import bpe_learn as bl
from corpusprep.operators.stats import to_symbols, word_counts
from corpusprep.plans import fixtures as fx
from corpusprep.plans.flagship import NUM_MERGES, flagship
from corpusprep.plans.q_text import d_t1, d_tok
from corpusprep.plans.registry import register
from corpusprep.session import cut_lineage

K = 8  # merges learned by the oracle-checked queries


def d_sym(w: str) -> str:
    return (f"' ' || array_to_string(list_transform(range(1, length({w}) + 1), lambda i: substring({w}, i, 1)), '  ')"
            " || '</w> '")


def d_pairs(src: str, g: str = "g") -> str:
    return f"""SELECT {g}, s[i] AS l, s[i + 1] AS r, freq FROM (
                 SELECT {g}, freq, s, unnest(range(1, len(s))) AS i FROM (
                   SELECT {g}, freq, string_split(substring(sym, 2, length(sym) - 2), '  ') AS s FROM {src}))"""


def d_learn(types_sql: str, k: int, min_freq: int = 2) -> list[tuple[str, str]]:
    """CTEs ``w0..wk`` (types per step), ``p0..p{k-1}`` (best pair per step) and ``merges``
    ``(g, rank, left, right, freq)`` cut at the first step below ``min_freq``."""
    ctes = [("w0", types_sql)]
    for i in range(k):
        ctes.append((f"p{i}", f"""
            SELECT g, max({{'c': c, 'l': l, 'r': r}}) AS m FROM (
              SELECT g, l, r, sum(freq) AS c FROM ({d_pairs(f'w{i}')}) GROUP BY g, l, r) GROUP BY g"""))
        ctes.append((f"w{i + 1}", f"""
            SELECT w.g, replace(w.sym, ' ' || p.m.l || '  ' || p.m.r || ' ', ' ' || p.m.l || p.m.r || ' ') AS sym, w.freq
            FROM w{i} w JOIN p{i} p USING (g)"""))
    steps = " UNION ALL ".join(f"SELECT g, {i} AS rank, m FROM p{i}" for i in range(k))
    ctes.append(("merges", f"""
        SELECT g, CAST(rank AS BIGINT) AS rank, m.l AS "left", m.r AS "right", CAST(m.c AS BIGINT) AS freq
        FROM (SELECT *, min(m.c) OVER (PARTITION BY g ORDER BY rank) AS run_min FROM ({steps}))
        WHERE run_min >= {min_freq}"""))
    return ctes


def _doc_types(group: str | None = None) -> str:
    g = group or "0"
    return f"""SELECT g, {d_sym('word')} AS sym, CAST(count(*) AS BIGINT) AS freq
               FROM (SELECT {g} AS g, unnest({d_tok('text')}) AS word FROM documents) GROUP BY g, word"""


def _spark_doc_words(spark, d):
    return word_counts(fx.table(spark, d, "documents"), "text")


# --- A2 / A3 / A4 / B2 -------------------------------------------------------------------------------

@register("symbols", oracle=f"""
    SELECT word, CAST(count(*) AS BIGINT) AS freq, {d_sym('word')} AS sym
    FROM (SELECT unnest({d_tok('text')}) AS word FROM documents) GROUP BY word""")
def q_symbols(spark, d):
    return _spark_doc_words(spark, d).withColumn("sym", to_symbols("word"))


@register("pair_counts", oracle=fx.oracle([], """
    SELECT l, r, CAST(sum(freq) AS BIGINT) AS freq FROM pairs GROUP BY l, r""",
    [("w0", _doc_types()), ("pairs", d_pairs("w0"))]))
def q_pair_counts(spark, d):
    return bl.pair_counts(bl.word_types(_spark_doc_words(spark, d)))


@register("best_pair", oracle=fx.oracle([], """
    SELECT m.l AS l, m.r AS r, CAST(m.c AS BIGINT) AS freq FROM p0""", [("w0", _doc_types())] + d_learn(_doc_types(), 1)[1:2]))
def q_best_pair(spark, d):
    return bl.best_pair(bl.pair_counts(bl.word_types(_spark_doc_words(spark, d))))


@register("merge_pair", oracle=fx.oracle([], """
    SELECT w.sym AS sym, w.freq AS freq FROM w1 w""", d_learn(_doc_types(), 1)[:3]))
def q_merge_pair(spark, d):
    types = bl.word_types(_spark_doc_words(spark, d))
    best = bl.best_pair(bl.pair_counts(types)).first()  # one row by construction
    return types.select(bl.merge_pair(F.col("sym"), best["l"], best["r"]).alias("sym"), "freq")


# --- B1 / B3 / B4 / B5 -------------------------------------------------------------------------------

@register("learn_bpe", oracle=fx.oracle([], 'SELECT rank, "left", "right", freq FROM merges', d_learn(_doc_types(), K)))
def q_learn_bpe(spark, d):
    return bl.learn_bpe(fx.table(spark, d, "documents"), "text", num_merges=K)


@register("merge_trace", oracle=fx.oracle([], """
    SELECT rank, "left", "right", "left" || "right" AS new_symbol, freq FROM merges""", d_learn(_doc_types(), K)))
def q_merge_trace(spark, d):
    return bl.merge_trace(bl.learn_bpe(fx.table(spark, d, "documents"), "text", num_merges=K))


_CONV_TYPES = f"""SELECT 0 AS g, {d_sym('word')} AS sym, CAST(count(*) AS BIGINT) AS freq
                  FROM (SELECT unnest({d_tok('lower(text)')}) AS word FROM conversations) GROUP BY word"""


@register("learn_bpe_counts", oracle=fx.oracle([], 'SELECT rank, "left", "right", freq FROM merges', d_learn(_CONV_TYPES, K)))
def q_learn_bpe_counts(spark, d):
    conv = fx.table(spark, d, "conversations")
    counts = word_counts(conv.select(tx.lowercase("text").alias("text")), "text")
    return bl.learn_bpe_from_counts(counts, num_merges=K)


@register("learn_bpe_groups", oracle=fx.oracle([], 'SELECT g AS lang, rank, "left", "right", freq FROM merges',
                                               d_learn(_doc_types("lang"), K)))
def q_learn_bpe_groups(spark, d):
    return bl.learn_bpe(fx.table(spark, d, "documents"), "text", num_merges=K, group_cols=["lang"])


# --- B6 / B8 / B9 / B10 --------------------------------------------------------------------------------

def _d_chain(k: int, sym: str = "sym") -> str:
    """The first ``k`` merges applied to a symbol string one after the other."""
    for i in range(k):
        sym = f"replace({sym}, (SELECT ' ' || m.l || '  ' || m.r || ' ' FROM p{i}), (SELECT ' ' || m.l || m.r || ' ' FROM p{i}))"
    return sym


def _d_encoded_lines(k: int) -> list[tuple[str, str]]:
    """DuckDB: segment every document line with the first ``k`` learned merges applied in
    rank order (equal to the lowest-rank loop while no string has two derivations)."""
    chain = _d_chain(k)
    return d_learn(_doc_types(), k) + [
        ("tok", f"""SELECT doc_id, line_no, unnest(range(len(t))) AS pos, unnest(t) AS w
                    FROM (SELECT doc_id, line_no, {d_tok('text')} AS t FROM lines)"""),
        ("enc", f"""SELECT doc_id, line_no, pos,
                           CASE WHEN length(w) = 1 THEN w
                                ELSE replace(trim(replace({chain}, '</w>', '')), '  ', '@@ ') END AS piece
                    FROM (SELECT doc_id, line_no, pos, w, {d_sym('w')} AS sym FROM tok)"""),
        ("seg", """SELECT l.doc_id, l.line_no, l.text AS raw,
                          coalesce((SELECT string_agg(piece, ' ' ORDER BY pos) FROM enc e
                                    WHERE e.doc_id = l.doc_id AND e.line_no = l.line_no), '') AS text
                   FROM lines l"""),
    ]


def _spark_encoded_lines(spark, d):
    merges = bl.learn_bpe(fx.table(spark, d, "documents"), "text", num_merges=K)
    return ba.apply_bpe(fx.lines(spark, d), "text", merges, out_col="enc")


@register("apply_bpe", oracle=fx.oracle(["lines"], "SELECT doc_id, line_no, text FROM seg", _d_encoded_lines(K)))
def q_apply_bpe(spark, d):
    return _spark_encoded_lines(spark, d).select("doc_id", "line_no", F.col("enc").alias("text"))


@register("bpe_stats", oracle=fx.oracle(["lines"], """
    SELECT lang, CAST(sum(len(rt)) AS BIGINT) AS words, CAST(sum(len(et)) AS BIGINT) AS pieces,
           CAST(sum(len(list_filter(et, lambda x, i: NOT ends_with(x, '@@')
                AND (i = 1 OR NOT ends_with(et[i - 1], '@@'))))) AS BIGINT) AS whole_words,
           round(sum(len(et)) / sum(len(rt)), 4) AS pieces_per_word,
           round(sum(len(list_filter(et, lambda x, i: NOT ends_with(x, '@@')
                AND (i = 1 OR NOT ends_with(et[i - 1], '@@'))))) / sum(len(rt)), 4) AS whole_share
    FROM st GROUP BY lang""", _d_encoded_lines(K) + [("st", f"""
    SELECT d.lang, {d_tok('s.raw')} AS rt, {d_tok('s.text')} AS et FROM seg s JOIN documents d USING (doc_id)""")]))
def q_bpe_stats(spark, d):
    enc = _spark_encoded_lines(spark, d)
    docs = fx.table(spark, d, "documents").select("doc_id", "lang")
    return ba.bpe_stats(enc.join(docs, "doc_id"), "text", "enc", ["lang"])


def _d_word_lines(of_word: str) -> str:
    """Every line with its words replaced by ``of_word(w, enc)``."""
    return f"""SELECT l.doc_id, l.line_no, coalesce(string_agg(o.enc, ' ' ORDER BY t.pos), '') AS text
               FROM lines l LEFT JOIN (SELECT doc_id, line_no, unnest(range(len(t))) AS pos, unnest(t) AS w
                                       FROM (SELECT doc_id, line_no, {d_tok('text')} AS t FROM lines)) t
                    ON l.doc_id = t.doc_id AND l.line_no = t.line_no
               LEFT JOIN {of_word} o ON o.w = t.w GROUP BY l.doc_id, l.line_no"""


_D_TYPES = ("types", f"SELECT w, count(*) AS freq, {d_sym('w')} AS sym FROM (SELECT unnest({d_tok('text')}) AS w FROM documents) GROUP BY w")
VOCAB_K, VOCAB_MIN, GLOSSARY = 64, 50, ["tion", "ment"]


@register("apply_bpe_vocab", oracle=fx.oracle(["lines"], "SELECT * FROM result", d_learn(_doc_types(), VOCAB_K) + [
    _D_TYPES,
    ("pieces", f"""SELECT w, freq, unnest(range(len(u))) AS pos, unnest(u) AS unit, len(u) AS n FROM (
        SELECT w, freq, CASE WHEN length(w) = 1 THEN [w] ELSE string_split(replace(trim(replace({_d_chain(VOCAB_K)}, '</w>', '')), '  ', '@@ '), ' ') END AS u
        FROM types)"""),
    ("vocab", f"SELECT unit FROM pieces GROUP BY unit HAVING sum(freq) >= {VOCAB_MIN}"),
    ("made", 'SELECT "left" || "right" AS s, arg_min("left", rank) AS a, arg_min("right", rank) AS b FROM merges GROUP BY 1'),
    # a unit that the vocabulary lacks falls back to the halves of its merge, until none is left
    ("back(w, path, s, fin, known)", """
        SELECT w, printf('%06d', pos), CASE WHEN pos < n - 1 THEN left(unit, length(unit) - 2) ELSE unit END, pos = n - 1,
               n = 1 AND length(w) = 1 OR unit IN (SELECT unit FROM vocab) FROM pieces
        UNION ALL
        SELECT w, path || h.side, h.s, h.fin, CASE WHEN h.fin THEN h.s ELSE h.s || '@@' END IN (SELECT unit FROM vocab)
        FROM (SELECT b.w, b.path, unnest([{'side': '0', 's': m.a, 'fin': false},
                                          {'side': '1', 's': CASE WHEN b.fin THEN left(m.b, length(m.b) - 4) ELSE m.b END, 'fin': b.fin}]) AS h
              FROM back b JOIN made m ON m.s = CASE WHEN b.fin THEN b.s || '</w>' ELSE b.s END WHERE NOT b.known)"""),
    ("words", """SELECT w, string_agg(CASE WHEN fin THEN s ELSE s || '@@' END, ' ' ORDER BY path) AS enc FROM back b
                 WHERE known OR NOT EXISTS (SELECT 1 FROM made m WHERE m.s = CASE WHEN b.fin THEN b.s || '</w>' ELSE b.s END) GROUP BY w"""),
    ("result", _d_word_lines("words"))]))
def q_apply_bpe_vocab(spark, d):
    """Segment with a vocabulary built from the segmented documents; rare pieces back off to
    smaller known units."""
    words = cut_lineage(_spark_doc_words(spark, d))  # each is segmented once and counts as often as it occurs
    merges = bl.learn_bpe_from_counts(words, num_merges=VOCAB_K)
    enc = ba.apply_bpe(words, "word", merges, out_col="enc")
    vocab = ba.subword_vocab(enc, "enc", times="freq").filter(F.col("freq") >= VOCAB_MIN)
    return ba.apply_bpe(fx.lines(spark, d), "text", merges, vocab=vocab, out_col="enc") \
        .select("doc_id", "line_no", F.col("enc").alias("text"))


def _d_around(w: str) -> str:
    """A word cut around the glossary strings."""
    for g in GLOSSARY:
        w = f"replace({w}, '{g}', chr(1) || '{g}' || chr(1))"
    return f"list_filter(string_split({w}, chr(1)), lambda x: x <> '')"


@register("apply_bpe_glossary", oracle=fx.oracle(["lines"], "SELECT * FROM result", d_learn(_doc_types(), K) + [
    _D_TYPES,
    ("parts", f"SELECT w, unnest(range(len(p))) AS pos, unnest(p) AS part FROM (SELECT w, {_d_around('w')} AS p FROM types)"),
    ("coded", f"""SELECT w, pos, CASE WHEN length(part) = 1 OR part IN ({", ".join(f"'{g}'" for g in GLOSSARY)}) THEN part
        ELSE replace(trim(replace({_d_chain(K)}, '</w>', '')), '  ', '@@ ') END AS piece
        FROM (SELECT w, pos, part, {d_sym('part')} AS sym FROM parts)"""),
    ("words", "SELECT w, string_agg(piece, '@@ ' ORDER BY pos) AS enc FROM coded GROUP BY w"),
    ("result", _d_word_lines("words"))]))
def q_apply_bpe_glossary(spark, d):
    """Segmentation that keeps glossary strings whole inside words."""
    merges = bl.learn_bpe(fx.table(spark, d, "documents"), "text", num_merges=K)
    return ba.apply_bpe(fx.lines(spark, d), "text", merges, glossaries=GLOSSARY, out_col="enc") \
        .select("doc_id", "line_no", F.col("enc").alias("text"))


# --- E1: the whole preparation pipeline (flagship) ------------------------------------------------------


FLOORS = (2000, 500, 200, 100, 60, 40, 25, 15, 10, 7, 5, 4, 3)  # least counts of the stages of d_learn_staged


def d_learn_staged(types_sql: str, k: int, min_freq: int = 2) -> list[tuple[str, str]]:
    """``merges (g, rank, left, right, freq)`` of one merge at a time, up to ``k`` of each group, where
    these are too many to unroll. A stage makes every merge of at least its floor's count.

    A pair that reaches the floor forms a string that occurs as often, or more, as a span of whole
    symbols when the stage starts (``hot``; merges only join symbols). So words are cut where no hot
    span lies across, equal runs become one, and runs without a common hot span (``comp``) cannot
    touch each other's counts: each component goes through its own merges one at a time (``st``).
    Of all components the one whose next pair comes first goes on, that is, merges follow each other
    by the least pair that their component has come to, then by their step (``merges``)."""
    ctes, floors = [("v0", types_sql)], [f for f in FLOORS if f > min_freq] + [min_freq]
    for n, floor in enumerate(floors):
        ctes += [
            (f"s{n}", f"SELECT g, sym, freq, string_split(substring(sym, 2, length(sym) - 2), '  ') AS s FROM v{n} WHERE contains(sym, '  ')"),
            (f"span{n}", f"""
                SELECT g, sym, freq, i, j, array_to_string(s[i:j], '') AS x
                FROM (SELECT *, unnest(range(i + 1, len(s) + 1)) AS j FROM (SELECT *, unnest(range(1, len(s))) AS i FROM s{n}))"""),
            (f"hot{n}", f"SELECT g, x FROM span{n} GROUP BY g, x HAVING sum(freq) >= {floor}"),
            (f"in_hot{n}", f"SELECT g, sym, i, j, x FROM span{n} JOIN hot{n} USING (g, x)"),
            (f"open{n}", f"SELECT g, sym, list(DISTINCT b) AS o FROM (SELECT g, sym, unnest(range(i, j)) AS b FROM in_hot{n}) GROUP BY g, sym"),
            (f"cut{n}", f"""
                SELECT g, sym, freq, s, list_prepend(0, list_append(list_filter(range(1, len(s)), lambda b: NOT list_contains(o, b)), len(s))) AS c
                FROM s{n} JOIN open{n} USING (g, sym)"""),
            (f"part{n}", f"""
                SELECT g, sym, freq, no, c[no] + 1 AS a, c[no + 1] AS b, ' ' || array_to_string(s[c[no] + 1:c[no + 1]], '  ') || ' ' AS run
                FROM (SELECT *, unnest(range(1, len(c))) AS no FROM cut{n})"""),
            (f"run{n}", f"SELECT g, run, CAST(sum(freq) AS BIGINT) AS freq FROM part{n} WHERE b > a GROUP BY g, run"),
            (f"link{n}", f"""SELECT DISTINCT g, p.run, h.x FROM part{n} p JOIN in_hot{n} h USING (g, sym) WHERE h.i >= p.a AND h.j <= p.b"""),
            # the least run that a run is linked with, by way of others too
            (f"comp{n}(g, run, comp) USING KEY (g, run)", f"""
                SELECT g, run, run FROM run{n}
                UNION
                SELECT g, run, least FROM (
                  SELECT l.g, l.run, min(m.least) AS least
                  FROM link{n} l JOIN (SELECT g, l.x, min(c.comp) AS least FROM comp{n} c JOIN link{n} l USING (g, run) GROUP BY g, l.x) m
                       ON m.g = l.g AND m.x = l.x GROUP BY l.g, l.run) t
                JOIN recurring.comp{n} r USING (g, run) WHERE t.least < r.comp"""),
            (f"start{n}", f"SELECT g, comp, run, freq FROM comp{n} JOIN run{n} USING (g, run)"),
            (f"st{n}(step, g, comp, run, sym, freq, m)", f"""
                SELECT 0, g, comp, run, run, freq, CAST(NULL AS STRUCT(c HUGEINT, l VARCHAR, r VARCHAR)) FROM start{n}
                UNION ALL
                SELECT w.step + 1, w.g, w.comp, w.run, replace(w.sym, ' ' || b.m.l || '  ' || b.m.r || ' ', ' ' || b.m.l || b.m.r || ' '), w.freq, b.m
                FROM st{n} w JOIN (
                  SELECT g, comp, max({{'c': c, 'l': l, 'r': r}}) AS m FROM (
                    SELECT g, comp, l, r, sum(freq) AS c FROM ({d_pairs(f'st{n}', 'g, comp')}) GROUP BY g, comp, l, r)
                  WHERE c >= {floor} GROUP BY g, comp) b ON b.g = w.g AND b.comp = w.comp"""),
            (f"done{n}", f"SELECT * FROM st{n}"),
            (f"end{n}", f"SELECT g, run, arg_max(sym, step) AS new FROM done{n} GROUP BY g, run"),
            (f"v{n + 1}", f"""
                SELECT g, string_agg(coalesce(e.new, p.run), '' ORDER BY p.no) AS sym, any_value(p.freq) AS freq
                FROM part{n} p LEFT JOIN end{n} e USING (g, run) GROUP BY g, p.sym
                UNION ALL SELECT g, sym, freq FROM s{n} ANTI JOIN open{n} USING (g, sym)"""),
        ]
    found = " UNION ALL ".join(f"SELECT DISTINCT {n} AS stage, g, comp, step, m FROM done{n} WHERE step > 0" for n in range(len(floors)))
    ctes.append(("merges", f"""
        SELECT g, CAST(rank AS BIGINT) AS rank, m.l AS "left", m.r AS "right", CAST(m.c AS BIGINT) AS freq
        FROM (SELECT g, m, row_number() OVER (PARTITION BY g ORDER BY stage, lowest DESC, step) - 1 AS rank
              FROM (SELECT *, min(m) OVER (PARTITION BY g, stage, comp ORDER BY step) AS lowest FROM ({found})))
        WHERE rank < {k}"""))
    return ctes


def d_encode(words_sql: str) -> list[tuple[str, str]]:
    """``coded (g, w, sym)``: the words segmented with the ``merges`` of their group, every time all
    occurrences of the pair of lowest rank."""
    return [
        ("ranks", 'SELECT g, "left" AS l, "right" AS r, min(rank) AS rank FROM merges GROUP BY ALL'),
        ("todo", f"SELECT g, w, {d_sym('w')} AS sym FROM ({words_sql})"),
        ("loop(n, g, w, sym)", f"""
            SELECT 0, g, w, sym FROM todo
            UNION ALL
            SELECT n + 1, g, w, replace(sym, ' ' || m.l || '  ' || m.r || ' ', ' ' || m.l || m.r || ' ') FROM (
              SELECT n, p.g, w, sym, min({{'k': rank, 'l': p.l, 'r': p.r}}) AS m FROM (
                SELECT n, g, w, sym, s[i] AS l, s[i + 1] AS r FROM (
                  SELECT *, unnest(range(1, len(s))) AS i FROM (
                    SELECT *, string_split(substring(sym, 2, length(sym) - 2), '  ') AS s FROM loop))) p
              JOIN ranks k ON k.g = p.g AND k.l = p.l AND k.r = p.r GROUP BY n, p.g, w, sym)"""),
        ("coded", "SELECT g, w, arg_max(sym, n) AS sym FROM loop GROUP BY g, w"),
    ]


def _d_prepare(k: int) -> list[tuple[str, str]]:
    variants = f"""
        SELECT r.variant, c.corpus, c.split, c.line_no,
               CASE WHEN c.corpus = 'A' THEN {d_t1('c.src')} ELSE c.src END AS src,
               CASE WHEN c.corpus = 'A' THEN {d_t1('c.tgt')} ELSE c.tgt END AS tgt
        FROM corpora c JOIN recipe r ON c.corpus = r.corpus
        WHERE c.split = 'train' OR c.corpus = 'A'"""
    recipe = """SELECT * FROM (VALUES ('original', 'A'), ('bible', 'A'), ('bible', 'B'), ('backtranslated', 'A'),
        ('backtranslated', 'C'), ('all', 'A'), ('all', 'B'), ('all', 'C')) t(variant, corpus)"""
    sides = """SELECT variant, 'src' AS side, split, corpus, line_no, src AS text FROM variants
               UNION ALL SELECT variant, 'tgt', split, corpus, line_no, tgt FROM variants"""
    types = f"""SELECT g, {d_sym('word')} AS sym, CAST(count(*) AS BIGINT) AS freq FROM (
                  SELECT variant || '|' || side AS g, unnest({d_tok('text')}) AS word FROM sides WHERE split = 'train')
                GROUP BY g, word"""
    return [("recipe", recipe), ("variants", variants), ("sides", sides)] + d_learn_staged(types, k) + [
        ("rows", "SELECT row_number() OVER () AS rid, variant, side, split, variant || '|' || side AS g, text FROM sides"),
        ("tok", f"""SELECT rid, g, unnest(range(len(t))) AS pos, unnest(t) AS w
                    FROM (SELECT rid, g, {d_tok('text')} AS t FROM rows)"""),
        *d_encode("SELECT DISTINCT g, w FROM tok"),
        ("enc", """SELECT rid, pos, CASE WHEN length(w) = 1 THEN w
                                        ELSE replace(trim(replace(sym, '</w>', '')), '  ', '@@ ') END AS piece
                    FROM tok JOIN coded USING (g, w)"""),
        ("seg", """SELECT r.variant, r.side, r.split,
                          coalesce((SELECT string_agg(piece, ' ' ORDER BY pos) FROM enc e WHERE e.rid = r.rid), '') AS enc
                   FROM rows r"""),
        ("t", f"SELECT variant, side, split, {d_tok('enc')} AS tk FROM seg"),
        ("per", """SELECT variant, side, split, CAST(count(*) AS BIGINT) AS lines, CAST(sum(len(tk)) AS BIGINT) AS tokens,
                          CAST(max(len(tk)) AS BIGINT) AS max_len, round(avg(len(tk)), 4) AS mean_len
                   FROM t GROUP BY variant, side, split"""),
        ("dist", """SELECT variant, side, split, CAST(count(DISTINCT w) AS BIGINT) AS distinct_words
                    FROM (SELECT variant, side, split, unnest(tk) AS w FROM t) GROUP BY variant, side, split"""),
    ]


@register("prepare_dataset", oracle=fx.oracle(["corpora"], """
    SELECT per.*, coalesce(dist.distinct_words, 0) AS distinct_words,
           CAST(ceil(per.tokens / 4096) AS BIGINT) AS steps_per_epoch
    FROM per LEFT JOIN dist USING (variant, side, split)""", _d_prepare(NUM_MERGES)))
def q_prepare_dataset(spark, d):
    return flagship(spark, d)
