"""What the corpus operators share: the shared folder, file access from workers, small column helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path, shared_dir, written  # noqa: F401


def filesystem(uri: str):
    """pyarrow's filesystem for a URI or a plain path, and the path in it."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def importable(spark: SparkSession) -> None:
    """Python workers must find this package. Where neither the working folder nor PYTHONPATH leads to it, a zip of it goes to the executors, as --py-files does."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    if getattr(spark.sparkContext, "_factlens_shipped", False) or any(p and os.path.isdir(os.path.join(p, "factlens", "llm")) for p in paths):
        return
    import zipfile

    out = os.path.join(tempfile.mkdtemp(prefix="factlens-"), "factlens.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(os.path.join(top, "factlens")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), top))
    spark.sparkContext.addPyFile(out)
    spark.sparkContext._factlens_shipped = True


ONE_TASK = 8192


def hot_keys(rows: DataFrame, key: str | list[str], *, counts: DataFrame | None = None) -> DataFrame | None:
    """The keys with over 1 / (4 * partitions) of all rows, and over how many tasks (__parts) their rows are dealt; None where there are none, or where all rows are no load for one task."""
    keys = [key] if isinstance(key, str) else key
    n = rows.count() if counts is None else counts.agg(F.sum("many")).first()[0] or 0
    if n <= ONE_TASK:
        return None
    limit = max(1, n // (4 * n_partitions(rows.sparkSession)))
    many = rows.groupBy(*keys).agg(F.count("*").alias("many")) if counts is None else counts
    hot = written(many.where(F.col("many") > limit).select(*keys, F.ceil(F.col("many") / limit).alias("__parts")).coalesce(1), "hot-keys")
    return None if hot.isEmpty() else hot


def dealt_join(rows: DataFrame, side: DataFrame, key: str | list[str], how: str = "inner", *, counts: DataFrame | None = None, hot: DataFrame | None | bool = True) -> DataFrame:
    """rows joined to side, which has one row a key at most, where any share of rows may have one key.

    A key with over 1 / (4 * partitions) of all rows is hot: there are fewer than 4 * partitions of them, so their table is
    broadcast, their rows are dealt over as many tasks as they would fill, and side's row goes to each. Up to ONE_TASK rows
    in all are no load for any task and are joined as they are. rows should be a table, as it is counted first. counts: key,
    many (rows of the key, in these rows or in a larger table of them), where that is known. hot: what hot_keys gave for
    these rows or a larger table of them, where that is known.
    """
    keys = [key] if isinstance(key, str) else key
    if hot is True:
        hot = hot_keys(rows, keys, counts=counts)
    if hot is None:
        return rows.join(side, keys, how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.col("__parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__s", F.coalesce(salt, F.lit(0).cast("long"))).drop("__parts")
    copied = side.join(F.broadcast(hot), keys, "left").withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1).cast("long")) - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__s"], how).drop("__s")


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of an id as text; of an empty text where it is null."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
