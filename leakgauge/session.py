"""What a job needs from its session: tables, the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where nothing is set (local tests) a temporary folder is made, which on
    a single machine is shared by definition. It is never made on a cluster.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="leakgauge-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Used where several branches read one costly result. The files survive the
    loss of executors, unlike a cached block.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` with at least as many partitions as the cluster has cores.

    For narrow frames (a scan, a projection) that feed much work per byte. A table
    large enough to give every core its own split is left as it is, so nothing is
    shuffled at scale; only a few files too small to split are dealt out.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files:
        return df  # no scan below, its partitions are those of the step before
    # Splits of a scan are some megabytes each; only a few small files give fewer than cores.
    room = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if len(files) >= cores or _size(spark, files) >= cores * room:
        return df
    return df.repartition(cores)


def _bytes(text: str) -> int:
    """Bytes of a setting such as 128MB or 134217728b."""
    digits = "".join(c for c in text if c.isdigit())
    unit = text[len(digits) :].strip().lower()[:1]
    return int(digits) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(unit, 1)


def _size(spark: SparkSession, files: list[str]) -> int:
    """Bytes of fewer files than there are cores."""
    conf = spark._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)
