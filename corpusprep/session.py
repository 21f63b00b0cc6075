"""Session helpers: building a session for tests/bench and cutting lineage safely.

Library code never invents storage on a cluster. Lineage is cut with ``DataFrame.checkpoint``
into the directory the cluster names in ``spark.checkpoint.dir``; only a local-mode session
without that setting (tests, bench) gets a fresh scratch directory of its own.
"""

from __future__ import annotations

import logging
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def get_spark(master: str | None = None, app: str = "corpusprep", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Session with AQE (coalescing + skew join) on and the web UI off."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.default.parallelism", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only where the session has none.

    On a cluster ``spark.checkpoint.dir`` must name shared storage; a missing setting there is
    an error, never a silent machine-local folder.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage (HDFS/S3/ABFS)")
    path = tempfile.mkdtemp(prefix="corpusprep-ckpt-")
    log.warning("spark.checkpoint.dir unset in local mode; using %s", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint directory (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has ``path`` (a relative path is the default file system's)."""
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI with its scheme."""
    p, fs = _hadoop(spark, path)
    uri = fs.makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def make_dirs(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.mkdirs(p)


def move_path(spark: SparkSession, src: str, dst: str) -> None:
    """Rename ``src`` to ``dst``, which must not exist; an error if the file system refuses."""
    a, fs = _hadoop(spark, src)
    b, _ = _hadoop(spark, dst)
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(f"{src} was not renamed to {dst}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what this library wrote at ``path``, on whatever file system the path names."""
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusprep`` importable on every executor (UDFs are pickled by reference):
    zip the package once and ``addPyFile`` it to the session's SparkContext."""
    sc = spark.sparkContext
    key = f"{sc.applicationId}"
    if key in _SHIPPED:
        return
    import corpusprep
    import zipfile
    pkg = os.path.dirname(os.path.abspath(corpusprep.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="corpusprep-pkg-"), "corpusprep.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
