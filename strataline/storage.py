"""Tables in the cluster's shared folder: how intermediate results cut lineage and survive lost executors."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .model import EngineError

#: Tables that this driver has written and not deleted.
_WRITTEN: dict[str, SparkSession] = {}

#: Spark setting: shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Only a single local process, as in tests, gets a folder of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise EngineError("SharedFolder", "set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/strataline-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffles behind it are of no use afterwards; Spark removes them when the write ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _WRITTEN[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._strataline_path = path
    return table


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """materialize, with the number of rows as the write saw them."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get.get("n", 0)


def numbered(rows: DataFrame, name: str, column: str = "_n") -> tuple[DataFrame, int]:
    """(a written table with the place of each row in df's order as `column`, from 0; the number of rows).

    Places are row numbers within the partitions as written, plus the sizes of the partitions before: no row moves.
    """
    table = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = dict(tuple(r) for r in table.groupBy(part.alias("p")).count().collect())  # one row per partition
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(str(total))
        total += sizes.get(p, 0)
    start = F.element_at(F.split(F.lit(",".join(before)), ","), (part + 1).cast("int")).cast("long")
    return table.withColumn(column, start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"), total


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.pop(name, None)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._strataline_path)


def sweep() -> int:
    """Delete every table that this driver has written: for callers whose results are consumed.  Returns how many."""
    left = list(_WRITTEN.items())
    for name, spark in left:
        _remove(spark, name)
    return len(left)


class Documents:
    """Small JSON documents by folder and name under a path that Spark can reach: receipts and records, never rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def all(self, folder: str) -> list[dict]:
        """The documents of a folder, by name."""
        path, fs = self._at(folder)
        if not fs.exists(path):
            return []
        files = [f"{self.path}/{folder}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")]
        lines = self.spark.read.text(files, wholetext=True).select("value", F.input_file_name().alias("name")).collect() if files else []
        return [json.loads(r["value"]) for r in sorted(lines, key=lambda r: r["name"])]

    def put(self, folder: str, name: str, document: dict) -> bool:
        """Put a document in place under a name that is free; False if it is taken.  A rename makes it whole at once."""
        draft, fs = self._at(f"{folder}/.draft-{uuid.uuid4().hex}")
        final, _ = self._at(f"{folder}/{name}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, final, none)  # fails where the name is taken
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(final):
                return False
            raise error
        return True

    def delete(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, True)
