"""The opN_ queries over whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extraction, media_copies, mixing, packing, simhash, substring_dedup, token_files, toxicity, url_filter
from .common import read
from .tokenizing import public_path

#: The id that ends each document (a fixed value).
END_ID = 2

#: The rules that op3 applies (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


#: Side of the pictures that stand for vectors, and of the squares that they are drawn with.
SIDE, SQUARE = 96, 3


def pictures(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, edited, image: each vector as a grey picture, and edited copies of every twentieth.

    There is no table of images. A vector's picture is the sum of fixed random patterns, one for
    each component, weighted by it, so near vectors have near pictures. Ids divisible by 20 give a
    second row: the picture cropped on all sides, with less contrast and more light. Null vectors
    give null images.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = np.zeros((0, SIDE * SIDE), np.float32)
        for batch in batches:
            images: list[bytes | None] = []
            for vector, edited in zip(batch.column("vector"), batch.column("edited").to_pylist()):
                v = np.nan_to_num(np.array(vector.as_py() or [], np.float32))
                if not len(v):
                    images.append(None)
                    continue
                while len(patterns) < len(v):
                    squares = np.random.default_rng(len(patterns)).normal(0, 1, (SIDE // SQUARE, SIDE // SQUARE)).astype(np.float32)
                    patterns = np.concatenate([patterns, squares.repeat(SQUARE, 0).repeat(SQUARE, 1).reshape(1, -1)])
                grey = v @ patterns[: len(v)]
                grey = np.clip(128 + 45 * grey.reshape(SIDE, SIDE) / max(float(grey.std()), 1e-9), 0, 255)
                if edited:
                    grey = np.clip(grey[5:-9, 8:-4] * 0.75 + 50, 0, 255)
                images.append(b"P5 %d %d 255\n" % grey.shape[::-1] + grey.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("edited"), pa.array(images, pa.binary())], ["id", "edited", "image"])

    twentieth = F.coalesce(F.col(id_col) % 20 == 0, F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.explode(F.when(twentieth, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("edited"))
    return rows.mapInArrow(draw, f"id {id_type}, edited boolean, image binary")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all vectors, those of every twentieth also edited: which are copies of which."""
    drawn = pictures(read(spark, sf_dir, "embeddings"))
    named = drawn.select(F.struct(F.col("id").alias("vec_id"), "edited").alias("row"), "image")
    found = media_copies.find_image_copies(named, "row")
    return found.select("row.vec_id", "row.edited", "n_features", F.col("component_id.vec_id").alias("component_id"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, and checksums of what is read back from them."""
    path = token_files.new_path(spark)
    token_files.write_token_files(read(spark, sf_dir, "documents"), path, public_path(), END_ID)
    return token_files.token_file_digests(spark, path)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), rules)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group and keeper of every document."""
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document repeated passages take, and a digest of the rest."""
    return substring_dedup.drop_repeats(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    mixed = mixing.pareto_mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "expected", "taken", "copies")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 4096 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_path(), END_ID)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extraction.extract_main_text(read(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a network learned from labels that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    marked = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_media_copies": op1_media_copies,
    "op2_token_files": op2_token_files,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL = {
    "op3_url_filter": rf"""
        WITH rules(h, p, v) AS (VALUES {_RULE_ROWS}),
        judged AS (
            SELECT row_number() OVER () AS n, page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        fits AS (
            SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, v = 'block' DESC) AS k
            FROM judged JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
        FROM judged LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
    """,
    "op4_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
        placed AS (
            SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY t) AS group_size
            FROM normal WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id ASC NULLS LAST))
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM placed
    """,
    "op6_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS draw
            FROM documents),
        totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        weighed AS (SELECT *, 3 * source_size AS ceiling, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight FROM totals),
        filling AS (SELECT *, ceiling::DOUBLE / weight AS fills_at FROM weighed),
        levels AS (
            SELECT *, (sum(source_size) OVER ()::BIGINT - coalesce(sum(ceiling) OVER b, 0)::BIGINT)::DOUBLE / (sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT)::DOUBLE AS level
            FROM filling WINDOW b AS (ORDER BY fills_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        water AS (SELECT max(level) AS level FROM levels),
        wanted AS (
            SELECT source, source_size, CASE WHEN fills_at <= water.level THEN ceiling::DOUBLE ELSE weight * water.level END AS target
            FROM levels, water),
        digits AS (SELECT *, length(bin(size)) AS digits FROM sized),
        classes AS (SELECT source, digits, sum(size)::BIGINT AS words FROM digits GROUP BY ALL),
        -- the factor of a source, were all classes of more digits than each at three copies
        factors AS (
            SELECT a.source, any_value(w.source_size) AS source_size, any_value(w.target) AS target, a.digits,
                   (any_value(w.target) - coalesce(sum(3 * b.words) FILTER (b.digits > a.digits), 0)::DOUBLE)
                     / nullif(sum(b.digits * b.words) FILTER (b.digits <= a.digits), 0)::DOUBLE AS factor
            FROM classes a JOIN classes b ON a.source IS NOT DISTINCT FROM b.source JOIN wanted w ON a.source IS NOT DISTINCT FROM w.source
            GROUP BY a.source, a.digits),
        best AS (SELECT source, any_value(source_size) AS source_size, any_value(target) AS target, coalesce(max(factor), 0) AS factor FROM factors GROUP BY source),
        hoped AS (
            SELECT doc_id, d.source, size, draw, source_size, target, least(3.0::DOUBLE, greatest(0::DOUBLE, factor * digits)) AS expected
            FROM digits d JOIN best b ON d.source IS NOT DISTINCT FROM b.source),
        ranked AS (
            SELECT *, target - (sum(floor(expected)::BIGINT * size) OVER (PARTITION BY source))::DOUBLE AS missing,
                   CASE WHEN expected > floor(expected) THEN draw / (1 - draw) * (1 - (expected - floor(expected))) / (expected - floor(expected)) END AS rank
            FROM hoped),
        running AS (
            SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, size DESC, doc_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS reached FROM ranked),
        copied AS (
            SELECT *, floor(expected)::BIGINT + CASE WHEN rank IS NOT NULL AND missing > 0 AND reached - size < missing AND (reached <= missing OR reached - missing < missing - (reached - size)) THEN 1 ELSE 0 END AS copies FROM running)
        SELECT doc_id, size, source_size, target, expected, copies * size AS taken, copies FROM copied
    """,
}
