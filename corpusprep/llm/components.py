"""Connected components as Spark joins.

Every node keeps the smallest label seen; each round takes the minimum over its neighbours and
then jumps to its label's label, so chains halve. Aggregations combine before the shuffle, so a
node with very many neighbours is no hot task. Labels are written as Parquet to the shared
checkpoint folder each round, two generations in turn. A written table is planned by its real
size; a checkpoint would keep the size estimate of the joins it came from, and estimates
multiplied round by round soon have millions of digits. Only whether a label changed reaches the
driver.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import fixed
from corpusprep.session import ensure_checkpoint_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``: the smallest node reachable."""
    base = f"{ensure_checkpoint_dir(edges.sparkSession).rstrip('/')}/components-{uuid4().hex}"
    step = 0

    def written(df: DataFrame) -> DataFrame:
        nonlocal step
        path = f"{base}/{step % 2}"
        step += 1
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    ways = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))
    both = fixed(edges.select(ways.alias("e")).select("e.u", "e.v").distinct())
    label = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        # the smallest label among the neighbours
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("component").alias("m"))
        best = label.join(near, label["node"] == near["u"]) \
            .select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        # jump: a label is itself a node, whose label may be smaller
        roots = label.select(F.col("node").alias("r"), F.col("component").alias("rc"))
        new = written(best.join(roots, best["c"] == roots["r"], "left")
                      .select("node", F.least("c", "rc").alias("component"), (F.least("c", "rc") < F.col("was")).alias("changed")))
        moved = new.where("changed").limit(1).count()
        label = new.select("node", "component")
        if not moved:
            return label
