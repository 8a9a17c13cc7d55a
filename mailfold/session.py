"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Container

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # a scan is judged by its compressed files: a broadcast of repeated names holds several times that
    "spark.sql.sources.fileCompressionFactor": "4",
    # the JVM never compiles a longer method: texts and patterns of a message make one unless they are split
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "mailfold", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the library relies on; cluster settings win elsewhere."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this run's intermediate tables, removed when the session's JVM ends.

    A cluster names the shared folder it lies in by ``spark.checkpoint.dir``; a local session
    that names none gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = _own_folder()
        spark.conf.set("spark.checkpoint.dir", shared)
    return _run_folder(spark, shared.rstrip("/"), spark.sparkContext.applicationId)


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    """One folder for all local sessions of this process."""
    path = tempfile.mkdtemp(prefix="mailfold-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


@functools.lru_cache(maxsize=None)
def _run_folder(spark: SparkSession, shared: str, application: str) -> str:
    """``shared/mailfold-<application>``; its file system deletes it on exit."""
    path = f"{shared}/mailfold-{application}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this content unless one of that name exists; False if it does.

    The content is written under another name first and renamed without overwriting, so no
    reader sees half a file and of several writers one wins.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.draft")
    files = target.getFileSystem(conf)
    files.mkdirs(target.getParent())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    never = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(draft, target, never)
    except Py4JJavaError as failure:
        if "FileAlreadyExists" not in failure.java_exception.getClass().getName():
            raise
        files.delete(draft, False)
        return False
    return True


def small_files(spark: SparkSession, folder: str, skip: Container[str] = ()) -> dict[str, str]:
    """Names and contents of the small text files of a folder, but for those of names in ``skip``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    names = [f.getPath().getName() for f in files.listStatus(path)]
    out = {}
    for name in names:
        if name not in skip and not name.startswith((".", "_")):
            stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(path, name))
            out[name] = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            stream.close()
    return out


def path_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def together(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """``df`` dealt so that rows of equal keys share a task, for Python that streams over sorted rows.

    Dealt by a hash of the keys: an exchange by the keys themselves is dropped where a join has
    dealt its rows alike, and the adaptive planner, which sees no need of Python for it, may then
    read that join's shuffle locally or split its skewed partitions, and a key's rows part.
    """
    return df.repartition(partitions, F.xxhash64(*keys))


def settle_measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, tuple]:
    """:func:`settle` that also returns aggregates, computed while the rows are written."""
    seen = Observation()
    written = settle(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), label)
    return written, tuple(seen.get[k] for k in measures)


def settle(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder, with the writer's ``options``, and read it back.

    Cuts the lineage and fixes the rows: an executor lost later re-reads files instead
    of recomputing, and every later reader sees the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
