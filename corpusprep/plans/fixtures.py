"""Derived input views over the driver tables, one text per dialect.

The reference reads line files (MOSES pairs, keyed TSV, record lines, prediction files,
training logs). These views derive inputs of those shapes from the driver's ``documents``,
``conversations`` and ``events`` tables so that every registered query reads whole tables and
its work grows with them. The Spark builders and the DuckDB CTE texts define the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions.text import WS_CLASS

# Metric labels of the training log (case-sensitive) keyed by the event type
# that stands for them in the derived log view.
LOG_LABELS = [
    ("click", "validation BLEU"),
    ("view", "Validation perplexity"),
    ("purchase", "Validation accuracy"),
    ("signup", "Train perplexity"),
    ("error", "Train accuracy"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A caller whose files are too few for the cluster (one small file cannot be split)
    sets ``corpusprep.scan.partitions``; by default a scan is as Spark plans it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.conf.get("corpusprep.scan.partitions", None)
    return df.repartition(int(n)) if n else df


# ----------------------------------------------------------------------------------------------
# Spark builders
# ----------------------------------------------------------------------------------------------

def lines(spark, d) -> DataFrame:
    """``documents.text`` split at newline: (doc_id, line_no, text), line_no 0-based."""
    doc = table(spark, d, "documents")
    return doc.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")) \
        .select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


def turn_pairs(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("pair_id"), "src", "tgt")


def keyed_src(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").filter(F.col("role") == "user")
    return c.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("line_no"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") < 2), F.lit("")).otherwise(F.col("text")).alias("text"))


def keyed_tgt(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    base = c.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("line_no"), key.alias("key"),
        F.when(F.col("conv_id") % 11 == 0, F.lit("")).otherwise(F.col("text")).alias("text"))
    dup = c.filter(F.col("conv_id") % 5 == 0).select(
        (F.col("conv_id") * 1000000 + F.col("turn") + 500000).alias("line_no"), key.alias("key"),
        F.concat(F.col("text"), F.lit(" again")).alias("text"))
    return base.unionByName(dup)


def raw_pairs(spark, d) -> DataFrame:
    """``turn_pairs`` with blank sides (empty or whitespace-only) for the empty-pair filter."""
    tp = turn_pairs(spark, d)
    conv = F.expr("pair_id div 1000000")
    return tp.select(
        "pair_id",
        F.when(conv % 7 == 0, F.lit("")).otherwise(F.col("src")).alias("src"),
        F.when(conv % 11 == 0, F.lit(" \n")).otherwise(F.col("tgt")).alias("tgt"))


def log_lines(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    label = F.lit(None).cast("string")
    for et, lab in reversed(LOG_LABELS):
        label = F.when(F.col("event_type") == et, F.lit(lab)).otherwise(label)
    v = F.round(F.col("value") * 100).cast("long")
    num = F.concat((v / 100).cast("long").cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))
    num = F.when(F.col("event_id") % 97 == 0, F.lit("nan")).otherwise(num)
    text = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("[DEBUG] step "), F.col("event_id").cast("string"))) \
        .otherwise(F.concat(F.lit("[INFO] "), label, F.lit(": "), num))
    return e.select(F.concat(F.lit("output_"), (F.col("user_id") % 4).cast("string")).alias("run"),
                    F.col("event_id").alias("line_no"), text.alias("text"))


def pred_lines(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    step = (F.lit(128) * (F.lit(1) + F.expr("(doc_id div 4) % 3"))).cast("string")
    path = F.concat(F.lit("results/output_"), (F.col("doc_id") % 4).cast("string"),
                    F.lit("/preds_model_nyn_eng_step_"), step, F.lit(".txt"))
    text = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("ti"), F.lit("ti@@ "))
    return doc.select(path.alias("path"), F.col("doc_id").alias("line_no"), text.alias("text"))


def references(spark, d) -> DataFrame:
    """Reference side for scoring prediction files: one line per document."""
    doc = table(spark, d, "documents")
    return doc.select(F.col("doc_id").alias("line_no"),
                      F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("text"))


def hyp_ref(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    hyp = F.array_join(F.filter(F.split("text", " ", -1), lambda x, i: (i + 1) % 7 != 0), " ")
    return doc.select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("grp"),
                      hyp.alias("hyp"), F.col("text").alias("ref"))


def records(spark, d) -> DataFrame:
    tp = turn_pairs(spark, d)
    return tp.select(F.col("pair_id").alias("line_no"),
                     F.to_json(F.struct(F.col("src").alias("nyn_text"), F.col("tgt").alias("eng_text"))).alias("line"))


def tsv_lines(spark, d) -> DataFrame:
    """Keyed-TSV text lines: comments, good ``key<TAB>text`` rows and rows of wrong arity."""
    c = table(spark, d, "conversations")
    body = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    extra = F.when(F.col("conv_id") % 13 == 0, F.lit("\textra")).otherwise(F.lit(""))
    line = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("# "), F.col("role"))) \
        .otherwise(F.concat(key, F.lit("\t"), body, extra))
    return c.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("line_no"), line.alias("line"))


def corpora(spark, d) -> DataFrame:
    from corpusprep.operators.align import align_by_key
    tp = turn_pairs(spark, d)
    conv = F.expr("pair_id div 1000000")
    split = F.when(conv % 10 == 0, "dev").when(conv % 10 == 1, "test").otherwise("train")
    a = tp.select(F.lit("A").alias("corpus"), F.col("pair_id").alias("line_no"), split.alias("split"), "src", "tgt")
    b = align_by_key(keyed_src(spark, d), keyed_tgt(spark, d)).select(
        F.lit("B").alias("corpus"), F.col("pair_id").alias("line_no"), F.lit("train").alias("split"), "src", "tgt")
    c = a.filter(F.col("split") == "train").select(
        F.lit("C").alias("corpus"), "line_no", "split", F.concat("src", F.lit(" bt")).alias("src"), "tgt")
    return a.unionByName(b).unionByName(c)


SPARK_VIEWS = {
    "lines": lines, "turn_pairs": turn_pairs, "keyed_src": keyed_src, "keyed_tgt": keyed_tgt,
    "raw_pairs": raw_pairs, "log_lines": log_lines, "pred_lines": pred_lines, "references": references,
    "hyp_ref": hyp_ref, "records": records, "tsv_lines": tsv_lines, "corpora": corpora,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in SPARK_VIEWS:
        return SPARK_VIEWS[name](spark, sf_dir)
    return table(spark, sf_dir, name)


# ----------------------------------------------------------------------------------------------
# DuckDB texts (the driver pre-registers the base tables as views)
# ----------------------------------------------------------------------------------------------

WS = WS_CLASS

_label_case = "CASE " + " ".join(f"WHEN event_type = '{et}' THEN '{lab}'" for et, lab in LOG_LABELS) + " END"

DUCK_VIEWS: dict[str, tuple[list[str], str]] = {
    "lines": ([], """
        SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS line_no, unnest(l) AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""),
    "turn_pairs": ([], """
        SELECT u.conv_id * 1000000 + u.turn AS pair_id, u.text AS src, a.text AS tgt
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'"""),
    "keyed_src": ([], """
        SELECT conv_id * 1000000 + turn AS line_no, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS key,
               CASE WHEN conv_id % 7 = 0 AND turn < 2 THEN '' ELSE text END AS text
        FROM conversations WHERE role = 'user'"""),
    "keyed_tgt": ([], """
        SELECT conv_id * 1000000 + turn AS line_no, CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) AS key,
               CASE WHEN conv_id % 11 = 0 THEN '' ELSE text END AS text
        FROM conversations WHERE role = 'assistant'
        UNION ALL
        SELECT conv_id * 1000000 + turn + 500000, CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR),
               text || ' again'
        FROM conversations WHERE role = 'assistant' AND conv_id % 5 = 0"""),
    "raw_pairs": (["turn_pairs"], """
        SELECT pair_id, CASE WHEN (pair_id // 1000000) % 7 = 0 THEN '' ELSE src END AS src,
               CASE WHEN (pair_id // 1000000) % 11 = 0 THEN ' ' || chr(10) ELSE tgt END AS tgt
        FROM turn_pairs"""),
    "log_lines": ([], f"""
        SELECT 'output_' || CAST(user_id % 4 AS VARCHAR) AS run, event_id AS line_no,
               CASE WHEN event_id % 13 = 0 THEN '[DEBUG] step ' || CAST(event_id AS VARCHAR)
                    ELSE '[INFO] ' || ({_label_case}) || ': ' ||
                         CASE WHEN event_id % 97 = 0 THEN 'nan'
                              ELSE CAST(v // 100 AS VARCHAR) || '.' || lpad(CAST(v % 100 AS VARCHAR), 2, '0') END
               END AS text
        FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events)"""),
    "pred_lines": ([], """
        SELECT 'results/output_' || CAST(doc_id % 4 AS VARCHAR) || '/preds_model_nyn_eng_step_'
               || CAST(128 * (1 + (doc_id // 4) % 3) AS VARCHAR) || '.txt' AS path,
               doc_id AS line_no, replace(replace(text, chr(10), ' '), 'ti', 'ti@@ ') AS text
        FROM documents"""),
    "ref_lines": ([], """
        SELECT doc_id AS line_no, replace(text, chr(10), ' ') AS text FROM documents"""),
    "hyp_ref": ([], """
        SELECT doc_id AS pair_id, lang AS grp,
               array_to_string(list_filter(string_split(text, ' '), lambda x, i: i % 7 <> 0), ' ') AS hyp,
               text AS ref
        FROM documents"""),
    "tsv_lines": ([], """
        SELECT conv_id * 1000000 + turn AS line_no,
               CASE WHEN turn % 5 = 4 THEN '# ' || role
                    ELSE CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || chr(9) || replace(text, chr(10), ' ')
                         || CASE WHEN conv_id % 13 = 0 THEN chr(9) || 'extra' ELSE '' END END AS line
        FROM conversations"""),
    "tgt_last": (["keyed_tgt"], """
        SELECT key, arg_max(text, line_no) AS text FROM keyed_tgt GROUP BY key"""),
    "aligned": (["keyed_src", "tgt_last"], """
        SELECT s.line_no AS pair_id, s.key, s.text AS src, t.text AS tgt
        FROM keyed_src s JOIN tgt_last t ON s.key = t.key
        WHERE s.text <> '' AND t.text <> ''"""),
    "corpora": (["turn_pairs", "aligned"], """
        SELECT 'A' AS corpus, pair_id AS line_no,
               CASE WHEN (pair_id // 1000000) % 10 = 0 THEN 'dev' WHEN (pair_id // 1000000) % 10 = 1 THEN 'test' ELSE 'train' END AS split,
               src, tgt FROM turn_pairs
        UNION ALL
        SELECT 'B', pair_id, 'train', src, tgt FROM aligned
        UNION ALL
        SELECT 'C', pair_id, 'train', src || ' bt', tgt FROM turn_pairs
        WHERE (pair_id // 1000000) % 10 NOT IN (0, 1)"""),
}


def duck_with(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named views (dependencies first) plus ``extra`` CTEs; one named
    with its columns is recursive."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        deps, _ = DUCK_VIEWS[n]
        for dep in deps:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({DUCK_VIEWS[n][1]})" for n in order]
    # materialised: many of them are read more than once
    parts += [f"{n} AS ({body})" if "(" in n else f"{n} AS MATERIALIZED ({body})" for n, body in (extra or [])]
    word = "WITH RECURSIVE " if any("(" in n for n, _ in (extra or [])) else "WITH "
    return (word + ",\n".join(parts)) if parts else ""


def oracle(views: list[str], select: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """One DuckDB statement: the fixture views, extra CTEs, then the final SELECT."""
    head = duck_with(*views, extra=ctes)
    return f"{head}\n{select}"
