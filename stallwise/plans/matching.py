"""Queries that match offers to products and merge products, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import maintenance, resolution
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


@query("""
WITH o AS (SELECT seq, canonical_key AS key, regexp_replace(regexp_replace(translate(lower(display_title), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM parsed_title),
k AS (SELECT canonical_key AS key, min(id) AS product_id FROM product WHERE canonical_key IS NOT NULL GROUP BY 1),
h AS (SELECT o.*, k.product_id FROM o LEFT JOIN k USING (key) WHERE o.key IS NOT NULL),
f AS (SELECT key, min(seq) AS first_seq, arg_min(slug, seq) AS new_slug FROM h WHERE product_id IS NULL GROUP BY key),
m AS (SELECT *, new_slug IS NULL OR (new_slug NOT IN (SELECT slug FROM product WHERE slug IS NOT NULL) AND first_seq = min(first_seq) OVER (PARTITION BY new_slug)) AS free FROM f)
SELECT h.seq, h.key, CASE WHEN product_id IS NOT NULL THEN 'matched' WHEN NOT free THEN 'rejected' WHEN seq = first_seq THEN 'created' ELSE 'joined' END AS status, product_id,
  CASE WHEN product_id IS NULL AND free THEN new_slug END AS new_slug FROM h LEFT JOIN m USING (key)
UNION ALL SELECT seq, NULL, 'unparsed', NULL, NULL FROM o WHERE key IS NULL""")
def match_or_create(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every parsed title: matched to a product, the first or a further offer of a new one, or turned away."""
    offers = table(spark, d, "parsed_title").select("seq", F.col("canonical_key").alias("key"), text.slug(F.col("display_title")).alias("slug"))
    products = table(spark, d, "product").select("id", F.col("canonical_key").alias("key"), "slug")
    return resolution.match_or_create(offers, products)


_NUMBERS = "storage_gb ram_gb screen_mm volume_ml mass_g power_w battery_mah energy_wh length_mm".split()
_CONFLICT = " OR ".join(f"coalesce(TRY_CAST(json_extract_string(a.specs, '$.{n}') AS DOUBLE) <> TRY_CAST(json_extract_string(b.specs, '$.{n}') AS DOUBLE), false)" for n in _NUMBERS)
_PAIRS = """
WITH e AS (SELECT id, category_slug, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM product WHERE len(embedding) = 384),
u AS (SELECT id, category_slug, list_transform(v, lambda x: x / len) AS unit FROM e WHERE len > 0 AND isfinite(len)),
s AS (SELECT a.id, b.id AS other, round(list_dot_product(a.unit, b.unit), 4) AS similarity FROM u a JOIN u b ON b.category_slug = a.category_slug AND b.id <> a.id WHERE a.id % 20 = 0),
n AS (SELECT id, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS nth FROM s) WHERE nth = 1),
w AS (SELECT n.*, a.canonical_key AS ka, b.canonical_key AS kb, """ + _CONFLICT + """ AS numbers_differ,
  len(list_filter(list_zip(string_split(a.canonical_key, '|'), string_split(b.canonical_key, '|')), lambda p: coalesce(
    (regexp_matches(p[1], '^[0-9]+$') AND regexp_matches(p[2], '^[0-9]+$') AND p[1] <> p[2]) OR (regexp_matches(p[1], '[a-z]') AND regexp_matches(p[1], '[0-9]') AND regexp_matches(p[2], '[a-z]') AND regexp_matches(p[2], '[0-9]')
     AND array_to_string(regexp_extract_all(p[1], '[0-9]+'), '-') <> array_to_string(regexp_extract_all(p[2], '[0-9]+'), '-')), false))) > 0 AS places_differ
  FROM n JOIN product a ON a.id = n.id JOIN product b ON b.id = n.other),
c AS (SELECT id, other, similarity, CASE WHEN numbers_differ OR places_differ OR similarity < 0.9 THEN 'none'
  WHEN similarity >= 0.95 AND regexp_replace(ka, '[- ]', '', 'g') = regexp_replace(kb, '[- ]', '', 'g') THEN 'merge' ELSE 'queue' END AS decision FROM w)"""


@query(_PAIRS + " SELECT * FROM c")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The most similar product of the category, and whether to merge, for the products whose id 20 divides."""
    products = table(spark, d, "product")
    vectors = products.filter(F.size("embedding") == 384).select("id", "category_slug", F.col("embedding").alias("vector"))
    near = resolution.best_neighbour(vectors, vectors.filter("id % 20 = 0"), "category_slug")
    known = products.select("id", "canonical_key", "specs")
    both = near.join(known, "id").join(known.select(F.col("id").alias("other"), F.col("canonical_key").alias("other_key"), F.col("specs").alias("other_specs")), "other")
    decision = resolution.merge_decision(F.col("similarity"), F.col("canonical_key"), F.col("specs"), F.col("other_key"), F.col("other_specs"))
    return both.select("id", "other", "similarity", decision.alias("decision"))


@query(_PAIRS + """, q AS (SELECT * FROM c WHERE decision = 'queue' ORDER BY similarity DESC, id, other LIMIT 200)
SELECT q.similarity, a.slug AS slug, b.slug AS other_slug FROM q JOIN product a ON a.id = q.id JOIN product b ON b.id = q.other""")
def merge_queue(spark: SparkSession, d: str) -> DataFrame:
    """The 200 most similar pairs that wait for a reviewer; both products are joined after the limit."""
    queue = merge_candidates(spark, d).filter("decision = 'queue'").orderBy(F.col("similarity").desc(), "id", "other").limit(200)
    slugs = table(spark, d, "product").select("id", "slug")
    return queue.join(slugs, "id").join(slugs.select(F.col("id").alias("other"), F.col("slug").alias("other_slug")), "other").select("similarity", "slug", "other_slug")


_WINNERS = """
WITH p AS (SELECT id, created_at, split_part(canonical_key, '|', 1) || '|' || split_part(canonical_key, '|', 2) AS coarse FROM product),
n AS (SELECT product_id, count(*) AS offers FROM listing WHERE product_id IS NOT NULL GROUP BY 1),
r AS (SELECT p.id, p.coarse, row_number() OVER (PARTITION BY p.coarse ORDER BY coalesce(n.offers, 0) DESC, p.created_at, p.id) AS place FROM p LEFT JOIN n ON n.product_id = p.id),
w AS (SELECT a.id AS product_id, b.id AS winner FROM r a JOIN r b ON b.coarse = a.coarse AND b.place = 1)"""


def _winners(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("canonical_key", r"\|")
    coarse = F.concat_ws("|", F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("coarse")
    offers = table(spark, d, "listing").filter("product_id IS NOT NULL").groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias("offers"))
    counted = table(spark, d, "product").select("id", "created_at", coarse).join(offers, "id", "left").fillna(0, ["offers"])
    return maintenance.winners(counted, "coarse", "id", [F.col("offers").desc(), F.col("created_at")]).withColumnRenamed("id", "product_id")


@query(_WINNERS + """,
l AS (SELECT l.id, l.merchant_id, l.product_id, coalesce(w.winner, l.product_id) AS target FROM listing l LEFT JOIN w USING (product_id)),
m AS (SELECT *, target IS NOT DISTINCT FROM product_id AS own, row_number() OVER (PARTITION BY target, merchant_id ORDER BY (target IS NOT DISTINCT FROM product_id) DESC, id) = 1 AS first_of FROM l),
a AS (SELECT id, target, CASE WHEN own THEN 'kept' WHEN first_of THEN 'moved' ELSE 'dropped' END AS action FROM m)
SELECT id, CASE WHEN action <> 'dropped' THEN target END AS product_id, action FROM a""")
def coarsen_offers(spark: SparkSession, d: str) -> DataFrame:
    """Every offer after products are merged by a coarser key: kept, moved, or dropped where the merchant is there already."""
    return resolution.moved_offers(table(spark, d, "listing").select("id", "product_id", "merchant_id"), _winners(spark, d))


@query(_WINNERS + " SELECT a.slug AS old, b.slug AS new FROM w JOIN product a ON a.id = w.product_id JOIN product b ON b.id = w.winner WHERE w.product_id <> w.winner")
def coarsen_redirects(spark: SparkSession, d: str) -> DataFrame:
    """The forwardings that merging by a coarser key leaves behind."""
    slugs = table(spark, d, "product").select("id", "slug")
    merged = _winners(spark, d).filter("product_id <> winner")
    return merged.join(slugs.select(F.col("id").alias("product_id"), F.col("slug").alias("old")), "product_id").join(slugs.select(F.col("id").alias("winner"), F.col("slug").alias("new")), "winner").select("old", "new")


@query("""
WITH o AS (SELECT id, product_id, price_kes, row_number() OVER w AS place, min(price_kes) OVER (PARTITION BY product_id) AS low, max(price_kes) OVER (PARTITION BY product_id) AS high, count(*) OVER (PARTITION BY product_id) AS n
  FROM listing WHERE in_stock AND product_id IS NOT NULL WINDOW w AS (PARTITION BY product_id ORDER BY price_kes, id))
SELECT id, product_id, place, price_kes = low AND NOT (low = high AND n > 1) AS is_best FROM o WHERE place <= 10""")
def offers_by_price(spark: SparkSession, d: str) -> DataFrame:
    """The ten cheapest offers in stock of every product, in order, with the best marked unless all are equal."""
    offers = table(spark, d, "listing").filter(F.col("in_stock") & F.col("product_id").isNotNull()).select("id", "product_id", "price_kes")
    spans = offers.groupBy("product_id").agg(F.min("price_kes").alias("low"), F.max("price_kes").alias("high"), F.count(F.lit(1)).alias("n"))
    ranked = offers.withColumn("place", F.row_number().over(W.partitionBy("product_id").orderBy("price_kes", "id"))).filter("place <= 10")
    best = (F.col("price_kes") == F.col("low")) & ~((F.col("low") == F.col("high")) & (F.col("n") > 1))
    return ranked.join(spans, "product_id").select("id", "product_id", "place", best.alias("is_best"))


@query("""
WITH o AS (SELECT product_id, price_kes, row_number() OVER (PARTITION BY product_id ORDER BY price_kes, id) AS place FROM listing WHERE in_stock AND product_id IS NOT NULL)
SELECT product_id, CASE WHEN count(*) > 1 THEN max(price_kes) - min(price_kes) END AS savings_abs,
  CASE WHEN count(*) > 1 AND max(price_kes) <> 0 THEN round_even((max(price_kes) - min(price_kes))::DOUBLE / max(price_kes)::DOUBLE * 100, 0)::BIGINT END AS savings_pct FROM o WHERE place <= 5 GROUP BY product_id""")
def savings(spark: SparkSession, d: str) -> DataFrame:
    """What the cheapest of the five offers shown saves against the dearest of them; null with fewer than two."""
    offers = table(spark, d, "listing").filter(F.col("in_stock") & F.col("product_id").isNotNull()).select("id", "product_id", "price_kes")
    shown = offers.withColumn("place", F.row_number().over(W.partitionBy("product_id").orderBy("price_kes", "id"))).filter("place <= 5")
    spans = shown.groupBy("product_id").agg(F.min("price_kes").alias("low"), F.max("price_kes").alias("high"), F.count(F.lit(1)).alias("n"))
    gap = F.when(F.col("n") > 1, F.col("high") - F.col("low"))
    share = F.when(F.col("high") != 0, gap.cast("double") / F.col("high").cast("double") * 100)
    return spans.select("product_id", gap.alias("savings_abs"), F.bround(share, 0).cast("long").alias("savings_pct"))
