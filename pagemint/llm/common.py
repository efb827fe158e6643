"""What the operators share: reading tables, scratch tables in the cluster's shared folder, internal column names."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemint.session import shared_folder

#: A-Z and a-z: contracts lower-case ASCII letters only, so ``lower`` (all of Unicode) is not used.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: On bytes: every byte that is no word byte (ASCII other than digits and letters) becomes a space, A-Z becomes a-z.
WORD_BYTES = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32
    for c in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8: runs of anything but ASCII punctuation, controls and spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


#: Scratch tables that this driver has written. They outlive the DataFrames made from them and go when the driver ends.
WRITTEN: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)


def remove_scratch() -> None:
    """Delete the scratch tables; a driver whose JVM has gone already leaves them to whoever cleans the shared folder."""
    while WRITTEN:
        try:
            delete(*WRITTEN.pop())
        except Exception:
            return


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; others are left alone."""
    for table in tables:
        for found in [w for w in WRITTEN if w[1] == getattr(table, "scratch_path", None)]:
            WRITTEN.remove(found)
            delete(*found)


atexit.register(remove_scratch)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, and what was lost is not recomputed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.scratch_path = path
    return read


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: what a Python worker holds at once."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def columns_but(df: DataFrame, *drop: str) -> Iterable[str]:
    return [c for c in df.columns if c not in drop]
