"""Written tables that cut lineage, in the folder that all executors share; and the layout of small scans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session gets a folder that goes with the process; a cluster can't do without."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    made = getattr(spark, "_maskwright_scratch", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        made = spark._maskwright_scratch = "file://" + folder
    return made


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def note(path: str) -> str:
    """``path``, which goes with the innermost ``cleared`` that is open, if any."""
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end; what shall stay must be written elsewhere or collected by then."""
    _made.append([])
    try:
        yield
    finally:
        delete(spark, _made.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once and read back; survives lost executors."""
    spark = df.sparkSession
    path = note(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_file(uri: str):
    """(file system, path) of a file in the shared folder, for readers and writers of single bytes."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


def row_groups(spark: SparkSession, files: list[str]) -> int:
    """How many tasks can read Parquet files, from their footers."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for f in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)), conf))
        try:
            total += reader.getRowGroups().size()
        finally:
            reader.close()
    return total


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if its Parquet files hold fewer row groups than there are cores, as most cores would idle.

    What is moved then is a few row groups; with as many as cores the scan stays as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores or not all(f.endswith(".parquet") for f in files) or row_groups(spark, files) >= cores:
        return df
    return df.repartition(cores)
