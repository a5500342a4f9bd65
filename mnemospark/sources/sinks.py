"""Sinks: versioned tables with all-or-nothing imports, exports and snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import Folder


class Versioned:
    """A table as immutable parts and numbered manifests, of which the highest one counts.

    A version is a list of parts. It becomes visible when its manifest is renamed into place, and no file
    is ever replaced, so a write that breaks off at any point leaves the table as it was; of two writers of
    one number one fails. append() adds a part and copies nothing. Works on any Hadoop file system.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, root)

    def _manifests(self) -> list[str]:
        return self.folder.names("manifest-")

    def versions(self) -> list[str]:
        """Names of the complete versions, oldest first."""
        return self._manifests()

    def parts(self, back: int = 0) -> list[str]:
        known = self._manifests()
        return json.loads(self.folder.text(known[-1 - back]))["parts"] if len(known) > back else []

    def _publish(self, parts: list[str]) -> str:
        known = self._manifests()
        name = f"manifest-{int(known[-1].rsplit('-', 1)[1]) + 1 if known else 1:012d}"
        self.folder.put(name, json.dumps({"parts": parts}))
        return name

    def _part(self, df: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def read(self, back: int = 0) -> DataFrame | None:
        """The current version, or the one `back` steps before; None if there is none."""
        parts = self.parts(back)
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{p}" for p in parts]) if parts else None

    def append(self, df: DataFrame, most_parts: int = 64) -> str:
        """Publish the current rows and df as the new version; beyond `most_parts` parts they are written as one."""
        parts = self.parts()
        if len(parts) >= most_parts:
            return self.write(self.read().unionByName(df, allowMissingColumns=True))
        return self._publish([*parts, self._part(df)])

    def write(self, df: DataFrame, keep: int = 0) -> str:
        """Publish df as the new version and drop all but the newest `keep` (0 keeps all)."""
        name = self._publish([self._part(df)])
        known = self._manifests()
        gone = known[:-keep] if keep > 0 else []
        if gone:
            used = {p for m in known[len(gone) :] for p in json.loads(self.folder.text(m))["parts"]}
            old = {p for m in gone for p in json.loads(self.folder.text(m))["parts"]} - used
            for m in gone:
                self.folder.delete(m)
            for p in old:
                self.folder.delete(p)
        return name


def conflicts(new: DataFrame, old: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys of `new` that `old` holds with other values; null equals null."""
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"n.{v}").eqNullSafe(F.col(f"o.{v}"))
    on = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in key]
    return new.alias("n").join(old.alias("o"), on).where(differ).select(*[F.col(f"n.{k}").alias(k) for k in key])


def import_rows(table: Versioned, new: DataFrame, key: list[str], values: list[str]) -> int:
    """Add the rows whose key is new; refuse the whole import if a known key comes with other values, or twice with different ones."""
    inside = new.groupBy(*key).agg(F.count_distinct(F.xxhash64(*values)).alias("_forms")).where("_forms > 1")
    if inside.limit(1).count():
        raise ValueError("the import contradicts itself")
    new, old = new.dropDuplicates(key), table.read()
    if old is None:
        table.write(new)
        return new.count()
    if conflicts(new, old, key, values).limit(1).count():
        raise ValueError("the import contradicts what is stored")
    added = new.join(old.select(*key), key, "left_anti")
    n = added.count()
    if n:
        table.append(added)
    return n


def export(tables: dict[str, DataFrame], path: str, kind: str = "all") -> list[str]:
    """Write the tables of a kind ('all', or one name) as JSON lines below path; returns the names."""
    names = list(tables) if kind == "all" else [kind]
    for name in names:
        tables[name].write.mode("overwrite").json(f"{path}/{name}")
    return names


def verify(stored: DataFrame, parsed: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row (stored, parsed, missing, extra, differing): stored rows against rows parsed again."""
    s, p = stored.dropDuplicates(key).withColumn("_s", F.lit(1)), parsed.dropDuplicates(key).withColumn("_p", F.lit(1))
    both = s.alias("s").join(p.alias("p"), key, "full")
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"s.{v}").eqNullSafe(F.col(f"p.{v}"))
    return both.agg(
        F.count("_s").alias("stored"), F.count("_p").alias("parsed"), F.count_if(F.col("_s").isNull()).alias("missing"), F.count_if(F.col("_p").isNull()).alias("extra"), F.count_if(F.col("_s").isNotNull() & F.col("_p").isNotNull() & differ).alias("differing")
    )
