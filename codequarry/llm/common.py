"""Settings and small helpers that the operators of this folder share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import new_path, shared_dir, stored  # noqa: F401

# Batches sent to Python stay small although single texts may be long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, units: int, per_task: int) -> int:
    """Tasks for ``units`` of work: at least the session's shuffle partitions, more as the data grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // per_task))


def bitmap(places: DataFrame, bits: int) -> bytes:
    """``bits`` bits, of which those at the numbers of the only column of ``places``, from 0, are set: as many bytes, whatever the data."""
    out = bytearray(bits // 8)
    at = places.toDF("b").select((F.col("b") + 1).alias("b"))
    for bucket, piece in at.groupBy(F.expr("bitmap_bucket_number(b)")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))")).collect():
        out[(bucket - 1) * 4096:bucket * 4096] = piece
    return bytes(out)


def memo(name: str) -> dict:
    """A dict of this process, kept from task to task of a reused Python worker; functions reach workers by value, and
    so their modules' globals do not last."""
    holder = sys.modules.setdefault("codequarry_memo", types.ModuleType("codequarry_memo"))
    return holder.__dict__.setdefault(name, {})


class Scratch:
    """Stored tables of one operator that are deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self._spark, name)
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if held := self._paths.pop(id(t), None):
                path = self._spark._jvm.org.apache.hadoop.fs.Path(held[1])
                path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        self.drop(*(df for df, _ in list(self._paths.values())))
