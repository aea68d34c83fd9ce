"""SparkSession construction and lineage cutting.

On a cluster the session is created by the platform; ``configure`` only fills what is unset.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "slicewatch",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; invent one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="slicewatch-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    A written table survives executor loss (recovery restarts from it, not from the raw scan)
    and, unlike an RDD checkpoint, keeps column pruning and filter pushdown on every re-read.
    """
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _tables_dir(spark: SparkSession) -> str:
    """Lineage-cut tables of this application live under one folder, so they can be released."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def release_tables(spark: SparkSession) -> bool:
    """Delete every lineage-cut table this application wrote. DataFrames read from them must not
    be used afterwards (cached query results in ``plans.catalog`` are dropped too)."""
    from slicewatch.plans import catalog
    catalog.forget(spark)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(hpath, True)) if fs.exists(hpath) else False


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``slicewatch`` importable in the Python workers of every executor (the ``--py-files``
    route), once per application. Needed where Python code of the package runs in tasks. The zip is
    written into the shared checkpoint folder through the Hadoop file system, not a machine-local
    folder, and added with ``addPyFile``."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    if "slicewatch" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(sc.applicationId)
        return
    import slicewatch
    pkg = os.path.dirname(os.path.abspath(slicewatch.__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    data = buf.getvalue()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pyfiles/{hashlib.sha1(data).hexdigest()[:16]}/slicewatch.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        out = fs.create(hpath, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
