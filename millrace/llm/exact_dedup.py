"""Exact dedup by content sort.

Every row is range-partitioned at sampled splitters of its normalised text and sorted there, so that
equal texts become neighbours; neighbours are compared in full and each run of equals names its
keeper. Splitters would send whole texts to the driver, so they are drawn from a short beginning of
the text and its hash; inside a range the order goes on by the whole text.

A text that occurs very often would fill one range. Such texts are found first by an exact count
of their hashes; their rows get a salt as a last splitting key, so splitters also fall inside the
run. The sub-runs' winners, at most ``salts`` for each of fewer than ``1 / hot_share`` texts, are
then compared with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, staged


#: Characters of a text that splitters may have.
SPLITTER = 16


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, hot_share: float = 0.0001, hot_least: int = 256, salts: int = 256) -> DataFrame:
    """One row for each input row: ``row`` (its columns, or those of carry), keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. Of equals the row with the most
    code points stays, then the smallest id (null after all others). Null text counts as empty;
    empty texts equal each other. Of rows repeated with the same id and text one is kept. Extra
    columns travel inside ``row`` and so cannot clash. An empty table gives an empty result.
    """
    normal = lambda text: F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")
    own_hash = F.xxhash64(normal(F.col(text_col)))
    hot_rows = max(hot_least, int(docs.count() * hot_share))
    # Fewer than 1 / hot_share hashes can be that frequent, however large the table.
    hot = [r.h for r in docs.select(own_hash.alias("h")).groupBy("h").count().filter(F.col("count") > hot_rows).select("h").collect()]
    salt = F.lit(0)
    if hot:
        spread = F.pmod(F.xxhash64(F.col(id_col)) + F.monotonically_increasing_id(), F.lit(salts))
        salt = F.when(own_hash.isin(hot), spread + 1).otherwise(F.lit(0)).cast("int")

    keyed = docs.select(F.struct("*").alias("row"), F.substring(normal(F.col(text_col)), 1, SPLITTER).alias("beginning"), own_hash.alias("hash"), salt.alias("salt"))
    dealt = keyed.repartitionByRange("beginning", "hash", "salt")
    text, row_id = F.col("row").getField(text_col), F.col("row").getField(id_col)
    placed = dealt.select("row", "beginning", "hash", "salt", normal(text).alias("norm"), F.length(F.coalesce(text, F.lit(""))).alias("chars"), row_id.alias("id"))
    run = Window.partitionBy("beginning", "hash", "salt", "norm")
    order = run.orderBy(F.col("chars").desc(), F.col("id").asc_nulls_last())
    head = F.first(F.struct("chars", "id")).over(order)
    row = F.col("row") if carry is None else F.struct(*(F.col("row").getField(c).alias(c) for c in carry))
    runs = placed.select(row.alias("row"), F.sha2("norm", 256).alias("text_sha256"), "salt", head.alias("head"), F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(run).alias("size"))
    if not hot:
        return runs.select("row", F.col("head.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256")

    runs = staged(runs, "content-sort")
    best = F.min(F.struct((-F.col("head.chars")).alias("less"), F.col("head.id").isNull().alias("no_id"), F.col("head.id").alias("id"), F.col("salt").alias("salt")))
    merged = runs.filter((F.col("salt") > 0) & (F.col("place") == 1)).groupBy("text_sha256").agg(best.alias("best"), F.sum("size").alias("all_rows"))
    # One row for each hot text: fewer than 1 / hot_share.
    joined = runs.join(F.broadcast(merged), "text_sha256", "left")
    is_hot = F.col("best").isNotNull()
    return joined.select(
        "row",
        F.when(is_hot, F.col("best.id")).otherwise(F.col("head.id")).alias("keep_id"),
        F.coalesce("all_rows", "size").alias("group_size"),
        ((F.col("place") == 1) & (~is_hot | (F.col("best.salt") == F.col("salt")))).alias("kept"),
        "text_sha256",
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The verdict on each row: id, keep_id, group_size, kept, text_sha256."""
    marked = content_sort(docs.select(id_col, text_col), id_col, text_col, carry=[id_col], **options)
    return marked.select(F.col(f"row.{id_col}").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns."""
    return content_sort(docs, id_col, text_col, **options).filter("kept").select("row.*")
