"""Written tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where one machine runs all and none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            named = jvm.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            named = LOCAL_FOLDER
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, store = _path(spark, name)
    return store.exists(path)


def stamp(spark: SparkSession, name: str) -> str:
    """Size and time of a file or folder, which change when it is written again."""
    path, store = _path(spark, name)
    return f"{store.getContentSummary(path).getLength()}@{store.getFileStatus(path).getModificationTime()}"


def delete(spark: SparkSession, name: str) -> None:
    path, store = _path(spark, name)
    store.delete(path, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; an error if the file system refuses."""
    path, store = _path(spark, source)
    to, _ = _path(spark, target)
    store.mkdirs(to.getParent())
    if not store.rename(path, to):
        raise OSError(f"can't move {source} to {target}")


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """A small text file, moved into place when it is whole."""
    path, store = _path(spark, name)
    part, _ = _path(spark, f"{name}.part-{uuid.uuid4().hex}")
    stream = store.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    store.delete(path, False)
    if not store.rename(part, path):
        raise OSError(f"can't write {name}")


def read_text(spark: SparkSession, name: str) -> str:
    path, store = _path(spark, name)
    stream = store.open(path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


class Scratch:
    """Tables of one run, written as Parquet under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/tallyforge-{name}-{uuid.uuid4().hex}"
        self.sent: list = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write now, read back: later plans start at the files."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def send(self, value):
        """A broadcast of a value of bounded size, until ``release``."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def release(self) -> None:
        """Free the broadcasts on the driver and the executors. Only for results that have been written."""
        for one in self.sent:
            one.destroy()
        self.sent.clear()
