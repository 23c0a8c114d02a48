"""Spark session helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "packetspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster ``master`` stays None and the launcher decides; tests pass
    ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            conf["spark.driver.memory"] = os.environ.get("PACKETSPARK_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cutting lineage.

    The cluster names it in ``spark.checkpoint.dir``; that value always wins.
    Only when it is unset on a local master (tests) a scratch folder is
    created and registered; elsewhere a machine-local folder would not be
    shared, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="packetspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Writer's options for values of many KB: a reader holds a row group at once, which else has 100 rows at least and 128 MB.
LARGE_VALUES = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 4}

_WRITTEN: dict[str, list[str]] = {}


def written(df, name: str):
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage like ``cut_lineage`` but stays columnar, so every later
    reader scans only the columns it needs.  Nothing is cached: a lost executor
    costs the tasks that were reading.  ``drop_written`` removes the tables.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/packetspark-{name}-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_VALUES if any(kind == "binary" for _, kind in df.dtypes) else {})).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Remove the tables that ``written`` made in this application, once their
    results have been used; returns how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs whose results are written: it
    does so once the driver has no reference to them any more."""
    gc.collect()
    spark._jvm.System.gc()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``packetspark`` importable on executors (pandas UDFs, grouped
    maps and the streaming state function run there): zip the package once
    per SparkContext and register it with ``addPyFile``, as ``--py-files``
    would."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="packetspark-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "packetspark"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="packetspark")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
