"""State without updates in place: writes are pure functions of frames, published as new versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def patch(df: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the patch's non-null fields in place of their own; patches of unknown keys do nothing.

    Of patches with one key, the one that is largest in the order of its fields counts, whole.
    """
    fields = [c for c in patches.columns if c != key]
    one = patches.groupBy(F.col(key).alias("patch_key")).agg(F.max(F.struct(*fields)).alias("patch"))
    new = one.select("patch_key", *[F.col(f"patch.{c}").alias(f"patch_{c}") for c in fields])
    joined = df.join(new, df[key] == new["patch_key"], "left")
    return joined.select(*[F.coalesce(F.col(f"patch_{c}"), df[c]).alias(c) if c in fields else df[c] for c in df.columns])


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def rename_document(documents: DataFrame, key, owner, name: str) -> DataFrame:
    if not name or not name.strip():
        raise ValueError("Document name is required.")
    return update_where(documents, (F.col("id") == F.lit(key)) & (F.col("user_id") == F.lit(owner)) & ~F.col("status").eqNullSafe("deleted"), name=F.lit(name.strip()))


def delete_by_ids(df: DataFrame, ids: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """The rows whose column isn't among the ids; null stays."""
    gone = ids.select(F.col(id_column).alias("gone_id"))
    return df.join(gone, df[column] == gone["gone_id"], "left_anti")


def delete_document(documents: DataFrame, parents: DataFrame, children: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, parents, children) after documents (id) are deleted: marked themselves, their parts removed."""
    marked = gone.select(F.col("id").alias("marked_id")).distinct()
    joined = documents.join(marked, documents["id"] == marked["marked_id"], "left")
    status = F.when(F.col("marked_id").isNotNull(), F.lit("deleted")).otherwise(documents["status"])
    kept = joined.select(*[status.alias(c) if c == "status" else documents[c] for c in documents.columns])
    return kept, delete_by_ids(parents, gone, "document_id"), delete_by_ids(children, gone, "document_id")


def replace_file(documents: DataFrame, key, mime_type: str | None, size: int | None, path: str | None) -> DataFrame:
    """New metadata of a document's file, old values where none is given; the name stays."""
    hit = F.col("id") == F.lit(key)
    given = {"mime_type": mime_type, "size": size, "path": path}
    return update_where(documents, hit, **{c: F.lit(v) for c, v in given.items() if v is not None}, status=F.lit("completed"))


class VersionedTable:
    """Parquet versions ``path/v=<n>`` of a table.

    A version is written whole under a number of its own and counts once Spark has put its _SUCCESS file there, so a
    lost executor or a failed job leaves the version before as it was, and no path is overwritten while it is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Published versions, by Hadoop's file system, so that any store will do."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        names = [s.getPath().getName() for s in system.listStatus(root)]
        numbers = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        return sorted(n for n in numbers if system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        found = self.versions()
        if not found:
            return None
        return self.spark.read.parquet(f"{self.path}/v={found[-1] if version is None else version}")

    def publish(self, df: DataFrame, cluster_by: str | None = None) -> int:
        """Writes the next version; rows of one key stand together where ``cluster_by`` names it."""
        version = (self.versions() or [0])[-1] + 1
        if cluster_by:
            df = df.repartition(cluster_by).sortWithinPartitions(cluster_by)
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return version
