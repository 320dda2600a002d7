"""Document intake: hashing, deduplication, sheets, dimension rows and append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redliner.functions.text import content_hash, sheet_key, stable_id
from redliner.operators.keyed import new_rows


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as rows with their SHA-256; bytes stay on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.col("path").alias("uri"), "length", "modificationTime", content_hash(F.col("content")).alias("content_hash")
    )


def dedupe_ledger(incoming: DataFrame, registry: DataFrame | None, row_id: str, hash_col: str = "content_hash") -> DataFrame:
    """Per distinct hash: the document kept, the number of copies, and whether it was known before.

    Hashes are counted map-side, so a text copied a billion times is still one
    row per task in the shuffle.
    """
    seen = incoming.groupBy(hash_col).agg(F.min(row_id).alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    if registry is None:
        return seen.withColumn("skipped", F.lit(False))
    known = registry.select(hash_col).distinct().withColumn("__known", F.lit(True))
    return seen.join(known, hash_col, "left").select(
        hash_col, "kept_id", "copies", F.coalesce("__known", F.lit(False)).alias("skipped")
    )


def build_sheets(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per page, numbered from 1; sheets that exist already are left out.

    ``documents`` has document_id and pages, an array of (width, height).
    """
    rows = documents.select("document_id", F.posexplode("pages").alias("pos", "dims")).select(
        "document_id",
        (F.col("pos") + 1).alias("page"),
        sheet_key(F.col("document_id"), F.col("pos") + 1).alias("sheet_id"),
        F.col("dims")["width"].alias("page_width_pts"),
        F.col("dims")["height"].alias("page_height_pts"),
    )
    return rows if known is None else new_rows(rows, known, ["sheet_id"])


def ensure_dim(rows: DataFrame, existing: DataFrame, natural_key: Sequence[str], kind: str, id_col: str) -> DataFrame:
    """Existing rows plus one new row, with a deterministic id, per unknown natural key.

    Of several rows of a key the whole row that is least in column order is taken.
    """
    others = [c for c in rows.columns if c not in natural_key]
    if others:
        least = rows.groupBy(*natural_key).agg(F.min(F.struct(*others)).alias("__row"))
        firsts = least.select(*natural_key, "__row.*").select(*rows.columns)
    else:
        firsts = rows.select(*natural_key).distinct()
    fresh = new_rows(firsts, existing, natural_key).withColumn(
        id_col, stable_id(kind, *[F.col(c) for c in natural_key])
    )
    return existing.unionByName(fresh, allowMissingColumns=True)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, in whatever store, and holds anything."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(place) and len(store.listStatus(place)) > 0


def append_versioned(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append rows whose key the table does not hold yet; nothing is overwritten.

    Of several new rows of a key the whole row that is least in column order is
    taken. A folder that does not exist or is empty is a new table; any other
    error while reading it is the caller's.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c not in keys]
    unique = df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__row")).select(*keys, "__row.*").select(*df.columns) if others else df.distinct()
    if has_files(spark, path):
        unique = new_rows(unique, spark.read.parquet(path), keys)
    unique.write.mode("append").partitionBy(*partition_by).parquet(path)


def rerun_entities(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("content_hash", "extractor_version")) -> DataFrame:
    """Old entities kept, entities of a new extractor version added."""
    return old.unionByName(new_rows(new, old, keys), allowMissingColumns=True)


def payload_column(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def retention_due(projects: DataFrame, as_of: Column, months: int = 84, hard_after_months: int = 12) -> DataFrame:
    """Projects past the retention period after closing: soft delete first, hard delete a year later."""
    closed = F.col("closed_at")
    return projects.filter(closed.isNotNull() & (F.add_months(closed, months) <= as_of)).withColumn(
        "stage", F.when(F.add_months(closed, months + hard_after_months) <= as_of, "hard").otherwise("soft")
    )


def cold_index(projects: DataFrame) -> DataFrame:
    """Thin index of archived projects: one row per jurisdiction and closing year."""
    return projects.groupBy("jurisdiction", F.year("closed_at").alias("year")).agg(
        F.count(F.lit(1)).alias("projects"), F.min("project_id").alias("first_project"), F.max("closed_at").alias("last_closed")
    )


def archive_cold(projects: DataFrame, path: str) -> DataFrame:
    """Write closed projects by jurisdiction and year; returns the index."""
    closed = projects.filter(F.col("closed_at").isNotNull()).withColumn("year", F.year("closed_at"))
    closed.repartition("jurisdiction", "year", F.pmod(F.hash("project_id"), F.lit(16))).write.mode("append").partitionBy(
        "jurisdiction", "year"
    ).parquet(path)
    return cold_index(closed)


def export_few_shot(edits: DataFrame, path: str) -> None:
    """Approved findings with large edits as JSON examples."""
    edits.select("rule_id", "draft_comment_text", "final_comment_text").write.mode("append").json(path)
