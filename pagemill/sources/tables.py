"""Parquet sources: one folder holds one table per name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of the data set in `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def norm_key(c: Column | str) -> Column:
    """An exam id or path as it is compared: no surrounding blanks, no leading slash, lower case.

    Null stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^\s*/*\s*|\s+$", ""))


def latest_exams(exams: DataFrame) -> DataFrame:
    """One row per exam id, the one with the latest updated_at (ties: any full-row order).

    Exact repeats and older versions go; a null id is kept as one group.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("updated_at"), *[F.col(c) for c in exams.columns if c not in ("id", "updated_at")])
    return exams.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row per page id; repeats are unchanged copies, so any of them will do."""
    return pages.dropDuplicates(["id"])


def blocks(pages: DataFrame) -> DataFrame:
    """The block fact table: one row per non-null layout block of a page, keyed (page_id, block_idx).

    x1, y1, x2, y2 are null when the box doesn't have four numbers.
    """
    b = F.col("b")
    corner = lambda i: F.when(F.size(b["bbox"]) == 4, b["bbox"][i])
    src = pages.select(
        norm_key("exam_id").alias("exam_id"), F.col("id").alias("page_id"), F.col("page_order").cast("int").alias("page_order"),
        F.col("ocr_text.origin_width").alias("ow"), F.col("ocr_text.origin_height").alias("oh"),
        F.col("ocr_text.input_width").alias("iw"), F.col("ocr_text.input_height").alias("ih"),
        F.posexplode("ocr_text.layouts").alias("block_idx", "b"),
    ).where(b.isNotNull())
    return src.select(
        "exam_id", "page_id", "page_order", "ow", "oh", "iw", "ih", "block_idx", b["category"].alias("category"), b["text"].alias("text"),
        b["level"].alias("level"), F.size(b["bbox"]).alias("n_box"), corner(0).alias("x1"), corner(1).alias("y1"), corner(2).alias("x2"), corner(3).alias("y2"),
    )


def json_previews(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Staged previews, one JSON file each (or one a line); unreadable ones are skipped, a missing folder gives no row."""
    ddl = "previewId string, title string, createdAt string, pages array<struct<id:string,`order`:int,source:string,file:string>>, _corrupt_record string"
    try:
        df = spark.read.schema(ddl).option("multiLine", not lines).option("mode", "PERMISSIVE").json(folder)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ddl).drop("_corrupt_record")
        raise
    return df.where("_corrupt_record is null and previewId is not null").drop("_corrupt_record")


def preview_pages(previews: DataFrame) -> DataFrame:
    """One row per page of every preview."""
    return previews.select("previewId", F.explode("pages").alias("p")).select("previewId", F.col("p.id").alias("page_id"), F.col("p.order").alias("page_order"), F.col("p.file").alias("file"))


def object_files(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """Stored objects of a folder: path, length, modificationTime (and content)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return df if with_content else df.drop("content")
