"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .brands import has_sign, mapped_names
from .entities import pairs_of, same_items
from .language import language_segments, wrongly_labelled
from .mixing import mixture, share_report
from .packing import container_report, packed
from .survivors import CUT, GARBLED, NO_PICTURE, SIZED, describes, names_in_full, picture_address, surviving_values
from .tokens import token_count
from .vectors import most_similar


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Brands of parsed titles and products that aren't a reference name, with the entry meant or 0."""
    reference = table(spark, data_dir, "brand_reference")
    parsed = table(spark, data_dir, "parsed_title").select(F.lit("parsed_title").alias("record_type"), F.col("seq").alias("record_id"), "brand")
    products = table(spark, data_dir, "product").select(F.lit("product").alias("record_type"), F.col("id").alias("record_id"), "brand")
    typed = parsed.unionByName(products).filter(has_sign(F.col("brand")))
    exact = F.broadcast(reference.select(F.col("brand_name").alias("brand")).distinct())  # a fixed table
    return mapped_names(typed.join(exact, "brand", "left_anti"), "brand", reference).select("record_type", "record_id", "brand_id")


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs of listings that offer the same item."""
    names = ("listing", "raw_listing", "parsed_title", "product", "unit_reference", "brand_reference")
    return pairs_of(same_items(*[table(spark, data_dir, name) for name in names]))


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs of products of which one is among the five most similar of the other, at a cosine of 0.8 or more."""
    near = most_similar(table(spark, data_dir, "product"))
    return near.select(F.least("id", "neighbour").alias("product_id_a"), F.greatest("id", "neighbour").alias("product_id_b")).distinct()


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """The row whose title, description and picture survive, for every key of two or more products."""
    columns = ["canonical_key", "id", "title", "description", "image_url", "source_merchant", "updated_at"]
    ranks = table(spark, data_dir, "merchant").select(F.col("slug").alias("source_merchant"), "trust_rank")
    products = table(spark, data_dir, "product").select(*columns).join(F.broadcast(ranks.dropDuplicates(["source_merchant"])), "source_merchant", "left")
    usable = {
        "title": names_in_full(F.col("title"), F.col("canonical_key")),
        "description": describes(F.col("description"), F.col("canonical_key")),
        "image_url": picture_address(F.col("image_url")),
    }
    found = surviving_values(products, "canonical_key", "id", usable, F.col("trust_rank"), "updated_at")
    return found.select("canonical_key", "field_name", F.col("id").alias("product_id"))


def p8_containers(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document's pieces in containers of every kind."""
    items = table(spark, data_dir, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    return packed(items, table(spark, data_dir, "pack_limit"))


def p8_unused(spark: SparkSession, data_dir: str) -> DataFrame:
    """How much of the containers' room stays unused."""
    return container_report(p8_containers(spark, data_dir), table(spark, data_dir, "pack_limit"))


def p9_mixture(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document with its copies in the mixture."""
    return mixture(table(spark, data_dir, "documents"), table(spark, data_dir, "mix_target"))


def p9_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    """The shares that the mixture reaches beside those aimed at."""
    return share_report(p9_mixture(spark, data_dir), table(spark, data_dir, "mix_target"))


def p10_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """The segments of documents that are mixed or whose label is missing or wrong."""
    segments = language_segments(spark, table(spark, data_dir, "documents"))
    return wrongly_labelled(segments).select("doc_id", "seg_no", "lang")


P6_SQL = """
WITH p AS (
  SELECT id, canonical_key, title, description, image_url, updated_at, m.trust_rank,
         replace(regexp_extract(canonical_key, '([a-z]+)-?([0-9][0-9a-z]*)', 0), '-', '') AS code,
         regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_letters, regexp_replace(lower(description), '[^a-z0-9]', '', 'g') AS text_letters,
         lower(regexp_extract(trim(image_url), '^https://[^/\\s]+/(\\S+)$', 1)) AS path
  FROM product LEFT JOIN (SELECT slug, any_value(trust_rank) AS trust_rank FROM merchant GROUP BY slug) m ON m.slug = source_merchant
  WHERE canonical_key IS NOT NULL),
usable AS (
  SELECT canonical_key, 'title' AS field_name, id, trust_rank, updated_at FROM p
  WHERE NOT regexp_matches(title, '{garbled}') AND NOT regexp_matches(title, '{cut}') AND regexp_matches(title, '{sized}')
    AND CASE WHEN code <> '' THEN contains(title_letters, code) ELSE regexp_matches(title_letters, '[a-z]+[0-9]{{3}}') END
    AND len(regexp_split_to_array(trim(title), '\\s+')) >= 4
  UNION ALL SELECT canonical_key, 'description', id, trust_rank, updated_at FROM p
  WHERE NOT regexp_matches(description, '{garbled}') AND NOT regexp_matches(description, '{cut}')
    AND CASE WHEN code <> '' THEN contains(text_letters, code) ELSE len(regexp_split_to_array(trim(description), '\\s+')) >= 5 END
    AND regexp_matches(trim(description), '[.!?。！？؟]["''”’»)]*$')
  UNION ALL SELECT canonical_key, 'image_url', id, trust_rank, updated_at FROM p
  WHERE path <> '' AND NOT regexp_matches(path, '{no_picture}') AND NOT regexp_matches(path, '\\.(svg|gif|ico)(\\?.*)?$')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY canonical_key, field_name ORDER BY trust_rank NULLS LAST, updated_at DESC NULLS LAST, id) AS place FROM usable
  WHERE canonical_key IN (SELECT canonical_key FROM product GROUP BY 1 HAVING count(*) > 1))
SELECT canonical_key, field_name, id AS product_id FROM ranked WHERE place = 1""".replace("\\\\", "\\").format(
    garbled=GARBLED, cut=CUT.replace("(?i)read more", "(?i:read more)").replace("(?i)show more", "(?i:show more)"), sized=SIZED, no_picture=NO_PICTURE
)
QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p6_found": p6_found,
    "p8_containers": p8_containers,
    "p8_unused": p8_unused,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}
ORACLES = {"p6_found": P6_SQL}
