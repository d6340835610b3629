"""Images of documents: which to describe, what kind they are, and texts that they have already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# First bytes of image files, in hex; others count as PNG.
MAGIC = {"89504E470D0A1A0A": "image/png", "FFD8": "image/jpeg", "47494638": "image/gif", "424D": "image/bmp"}


def mime(content: Column) -> Column:
    """MIME type of an image by its first bytes."""
    start, out = F.hex(F.substring(content, 1, 8)), F.lit("image/png")
    for magic, kind in MAGIC.items():
        out = F.when(start.startswith(magic), kind).otherwise(out)
    return F.coalesce(out, F.lit("image/png"))


def to_describe(images: DataFrame, least: int = 50) -> DataFrame:
    """Images (doc_id, page, idx, width, height, content) of at least ``least`` pixels each way; of equal ones in a document the first."""
    first = Window.partitionBy("doc_id", "digest").orderBy("page", "idx")
    big = images.filter((F.col("width") >= least) & (F.col("height") >= least) & (F.length("content") > 0)).withColumn("digest", F.md5("content"))
    return big.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def with_existing(images: DataFrame, texts: DataFrame) -> DataFrame:
    """``images`` with ``existing_alt`` from ``texts`` (doc_id, page, ord, alt).

    The image at place ``idx`` of a page takes the page's text at that place. Those without one take, in
    reading order, the document's texts that have no page.
    """
    on_page = texts.filter("page is not null").select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")) - 1).alias("idx"), F.struct("alt").alias("own"))
    loose = texts.filter("page is null").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("turn"), F.col("alt").alias("spare"))
    rows = images.join(on_page, ["doc_id", "page", "idx"], "left")
    # places among the images without a text of their page; null for the others, which so match no loose text
    turn = F.when(F.col("own").isNull(), F.count_if(F.col("own").isNull()).over(Window.partitionBy("doc_id").orderBy("page", "idx").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("turn", turn.cast("int")).join(loose, ["doc_id", "turn"], "left")
    return rows.withColumn("existing_alt", F.when(F.col("own").isNotNull(), F.col("own.alt")).otherwise(F.col("spare"))).drop("own", "turn", "spare")
