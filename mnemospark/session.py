"""Session helpers: reading tables, cutting lineage in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mnemospark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MNEMOSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Our own is a folder of this machine, so it is only made for a local master; on a cluster each
    executor would write to a disk of its own, and that is refused.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mnemospark-"))
    return jsc.getCheckpointDir().get()


class Folder:
    """A folder on any Hadoop file system, with small text files that are written once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def names(self, prefix: str = "") -> list[str]:
        if not self.fs.exists(self.at()):
            return []
        return sorted(n for n in (f.getPath().getName() for f in self.fs.listStatus(self.at())) if n.startswith(prefix))

    def put(self, name: str, text: str) -> None:
        """Write a new file in full under another name, then rename; fails if the name is taken."""
        part = f"_{name}-{uuid.uuid4().hex}"
        out = self.fs.create(self.at(part))
        out.write(text.encode())
        out.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(self.at(part), self.at(name)):
            self.fs.delete(self.at(part), False)
            raise FileExistsError(f"{self.root}/{name} was written by somebody else")

    def text(self, name: str) -> str:
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)


class Scratch:
    """Tables written into the shared folder to cut lineage; drop() removes one that is done with.

    Results are lazy and read from here, so the folder lives as long as the Spark application, at whose end it is removed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/mnemospark-{uuid.uuid4().hex}"
        self.folder = Folder(spark, self.root)
        self.folder.fs.deleteOnExit(self.folder.at())
        self.count = 0

    def save(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = str(self.count)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if getattr(df, "_scratch_path", None):
                self.folder.delete(df._scratch_path)
