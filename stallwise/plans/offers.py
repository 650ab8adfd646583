"""Queries on offers: what products cost where, categories, merchants, clicks, and the upkeep of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, numbers, text, titles
from ..operators import facets, maintenance, ranking, tree
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _one(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of exactly one row."""
    return df.crossJoin(F.broadcast(one))


@query("""
SELECT product_id, min(price_kes) AS min_price, count(*) AS offer_count, count(DISTINCT merchant_id) AS merchant_count
FROM listing WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(DISTINCT merchant_id) >= 2
ORDER BY offer_count DESC, min_price, product_id LIMIT 48""")
def offers_by_product(spark: SparkSession, d: str) -> DataFrame:
    """The 48 products with most offers among those that at least two merchants sell."""
    grouped = table(spark, d, "listing").filter("product_id IS NOT NULL").groupBy("product_id")
    offers = grouped.agg(F.min("price_kes").alias("min_price"), F.count(F.lit(1)).alias("offer_count"), F.countDistinct("merchant_id").alias("merchant_count"))
    return offers.filter("merchant_count >= 2").orderBy(F.col("offer_count").desc(), "min_price", "product_id").limit(48)


@query("""
WITH l AS (SELECT product_id, price_kes, last_checked_at, min(price_kes) OVER (PARTITION BY product_id) AS lowest FROM listing WHERE in_stock AND product_id IS NOT NULL)
SELECT product_id, min(price_kes) AS min_price, max(price_kes) AS max_price, max(last_checked_at) AS last_updated,
       count(*) FILTER (price_kes = lowest) AS best_count, min(price_kes) = max(price_kes) AND count(*) > 1 AS all_tied
FROM l GROUP BY product_id""")
def product_offer_stats(spark: SparkSession, d: str) -> DataFrame:
    """Price range, freshness and ties of every product's offers in stock."""
    offers = table(spark, d, "listing").filter(F.col("in_stock") & F.col("product_id").isNotNull())
    by_price = offers.groupBy("product_id", "price_kes").agg(F.count(F.lit(1)).alias("n"), F.max("last_checked_at").alias("at"))
    grouped = by_price.groupBy("product_id").agg(
        F.min("price_kes").alias("min_price"), F.max("price_kes").alias("max_price"), F.max("at").alias("last_updated"), F.min_by("n", "price_kes").alias("best_count"), F.sum("n").alias("all")
    )
    return grouped.withColumn("all_tied", (F.col("min_price") == F.col("max_price")) & (F.col("all") > 1)).drop("all")


@query("""
WITH m AS (SELECT p.category_slug, p.id, min(l.price_kes) AS price FROM product p JOIN listing l ON l.product_id = p.id GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY category_slug ORDER BY price, id) AS pos FROM m),
g AS (SELECT a.id, b.id AS neighbour, abs(a.price - b.price) AS gap, 2 * abs(a.pos - b.pos) + (b.pos > a.pos)::INT AS near
      FROM o a JOIN o b ON a.category_slug = b.category_slug AND b.pos BETWEEN a.pos - 6 AND a.pos + 6 AND a.pos <> b.pos)
SELECT id, neighbour, gap, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, near) AS place FROM g) WHERE place <= 6""")
def related_products(spark: SparkSession, d: str) -> DataFrame:
    """The six products of a category whose lowest price is nearest, for every product with offers."""
    lowest = table(spark, d, "listing").filter("product_id IS NOT NULL").groupBy(F.col("product_id").alias("id")).agg(F.min("price_kes").alias("price"))
    priced = table(spark, d, "product").select("id", "category_slug").join(lowest, "id")
    return ranking.nearest_values(priced, "category_slug", "id", "price", 6).select("id", "neighbour", "gap", "place")


@query("""
WITH RECURSIVE c AS (SELECT id AS ancestor, id AS descendant FROM category
  UNION SELECT c.ancestor, k.id FROM c JOIN category k ON k.parent_id = c.descendant),
o AS (SELECT p.id, p.category_slug, count(DISTINCT l.merchant_id) AS merchants FROM product p JOIN listing l ON l.product_id = p.id GROUP BY 1, 2),
m AS (SELECT DISTINCT p.category_slug, l.merchant_id FROM product p JOIN listing l ON l.product_id = p.id)
SELECT a.slug, count(o.id) AS products, count(o.id) FILTER (o.merchants >= 2) AS compared,
  (SELECT count(DISTINCT m.merchant_id) FROM c c2 JOIN category k2 ON k2.id = c2.descendant JOIN m ON m.category_slug = k2.slug WHERE c2.ancestor = a.id) AS merchants
FROM category a JOIN c ON c.ancestor = a.id JOIN category k ON k.id = c.descendant LEFT JOIN o ON o.category_slug = k.slug GROUP BY a.id, a.slug""")
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Products, merchants and compared products of every category with all below it."""
    categories, listings = table(spark, d, "category"), table(spark, d, "listing").filter("product_id IS NOT NULL")
    leaf = table(spark, d, "product").select(F.col("id").alias("product_id"), "category_slug")
    pairs = listings.select("product_id", "merchant_id").distinct()
    offered = pairs.groupBy("product_id").agg(F.count("merchant_id").alias("n")).join(leaf, "product_id")
    by_leaf = offered.groupBy("category_slug").agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("n") >= 2).alias("compared"))
    sellers = pairs.join(leaf, "product_id").select("category_slug", "merchant_id").distinct()
    down = tree.closure(categories).join(categories.select(F.col("id").alias("descendant"), F.col("slug").alias("category_slug")), "descendant").select("ancestor", "category_slug")
    counts = down.join(by_leaf, "category_slug", "left").groupBy("ancestor").agg(F.coalesce(F.sum("products"), F.lit(0)).alias("products"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    merchants = down.join(sellers, "category_slug").groupBy("ancestor").agg(F.countDistinct("merchant_id").alias("merchants"))
    whole = counts.join(merchants, "ancestor", "left").join(categories.select(F.col("id").alias("ancestor"), "slug"), "ancestor")
    return whole.select("slug", "products", "compared", F.coalesce("merchants", F.lit(0)).alias("merchants"))


@query("""
WITH RECURSIVE up AS (SELECT id, parent_id FROM category WHERE slug IN (SELECT category_slug FROM product)
  UNION SELECT k.id, k.parent_id FROM up JOIN category k ON k.id = up.parent_id)
SELECT DISTINCT c.slug FROM up JOIN category c ON c.id = up.id""")
def category_ancestor_nonempty(spark: SparkSession, d: str) -> DataFrame:
    """Categories that hold a product or have one below."""
    categories = table(spark, d, "category")
    held = table(spark, d, "product").select(F.col("category_slug").alias("slug")).distinct()
    full = categories.join(held, "slug", "left_semi").select(F.col("id").alias("descendant"))
    return tree.closure(categories).join(full, "descendant", "left_semi").select(F.col("ancestor").alias("id")).distinct().join(categories.select("id", "slug"), "id").select("slug")


def _facet(spark: SparkSession, d: str, category: str, wanted: dict) -> DataFrame:
    products = table(spark, d, "product").filter(F.col("category_slug") == category)
    found = facets.filtered_offers(products, table(spark, d, "listing"), wanted, facets.facets_for(category))
    return found.select("id", "min_price", "offer_count")


_OFFERS = "SELECT p.id, min(l.price_kes) AS min_price, count(*) AS offer_count FROM product p JOIN listing l ON l.product_id = p.id WHERE p.category_slug = "


@query(_OFFERS + "'phones' AND json_extract_string(p.specs, '$.storage_gb') IN ('128', '256') AND json_extract_string(p.specs, '$.ram_gb') IN ('8') GROUP BY p.id")
def facet_filter_enum(spark: SparkSession, d: str) -> DataFrame:
    """Phones of two storage sizes and one memory size."""
    return _facet(spark, d, "phones", {"storage_gb": ["128", "256"], "ram_gb": ["8"], "unheard_of": ["1"]})


@query(_OFFERS + "'tvs' AND l.in_stock GROUP BY p.id")
def facet_filter_instock(spark: SparkSession, d: str) -> DataFrame:
    """TVs in stock; the flag also changes price and count."""
    return _facet(spark, d, "tvs", {"in_stock": ["1"]})


@query(_OFFERS + "'laptops' GROUP BY p.id HAVING min(l.price_kes) <= 60000")
def facet_price_max(spark: SparkSession, d: str) -> DataFrame:
    """Laptops whose lowest price is within a bound."""
    return _facet(spark, d, "laptops", {"price_max": [" 60000 "]})


@query("""
SELECT 'brand' AS facet, list_sort(list(DISTINCT brand)) AS choices FROM product WHERE category_slug = 'phones' AND brand IS NOT NULL AND lower(brand) NOT IN ('', 'null', 'unknown')
UNION ALL SELECT 'storage_gb', list_transform(list_sort(list(DISTINCT json_extract_string(specs, '$.storage_gb')::BIGINT)), lambda x: x::VARCHAR) FROM product WHERE category_slug = 'phones' AND json_extract_string(specs, '$.storage_gb') IS NOT NULL
UNION ALL SELECT 'ram_gb', list_transform(list_sort(list(DISTINCT json_extract_string(specs, '$.ram_gb')::BIGINT)), lambda x: x::VARCHAR) FROM product WHERE category_slug = 'phones' AND json_extract_string(specs, '$.ram_gb') IS NOT NULL""")
def facet_available_values(spark: SparkSession, d: str) -> DataFrame:
    """What phones can be filtered by."""
    return facets.available_values(table(spark, d, "product").filter("category_slug = 'phones'"), facets.facets_for("phones"))


@query("SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IN ('3', '7', '42')")
def json_spec_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events by the text of a value in JSON."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").filter(k.isin("3", "7", "42")).select("event_id", "user_id", k.alias("k"))


@query("""
WITH o AS (SELECT p.id, p.created_at, count(*) AS offer_count, max(l.last_checked_at) AS checked FROM product p JOIN listing l ON l.product_id = p.id GROUP BY p.id, p.created_at),
r AS (SELECT *, row_number() OVER (ORDER BY offer_count DESC, created_at DESC, checked DESC, id) AS place, count(*) OVER () AS n FROM o)
SELECT id, offer_count, checked FROM r WHERE (place - 1) // 48 = least(3, (n + 47) // 48) - 1""")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    """The third page of the products by offers, age and freshness."""
    offers = table(spark, d, "listing").filter("product_id IS NOT NULL").groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias("offer_count"), F.max("last_checked_at").alias("checked"))
    ranked = table(spark, d, "product").select("id", "created_at").join(offers, "id")
    order = [F.col("offer_count").desc(), F.col("created_at").desc(), F.col("checked").desc(), F.col("id")]
    return ranking.page_of(ranked, order, 3).select("id", "offer_count", "checked")


@query(r"SELECT id, title FROM product WHERE lower(title) LIKE '%pro%' ESCAPE '\' OR lower(title) LIKE '%100\%%' ESCAPE '\'")
def search_title_like(spark: SparkSession, d: str) -> DataFrame:
    """Titles that hold a text, signs with a meaning in patterns taken as they are."""
    lowered = F.lower("title")
    return table(spark, d, "product").filter(lowered.contains("pro") | lowered.like(r"%100\%%")).select("id", "title")


@query("SELECT id, brand FROM product WHERE brand ILIKE '%audio%'")
def search_ilike_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """Brands that hold a text in any case, pattern signs removed from it."""
    needle = "%au_dio".replace("%", "").replace("_", "")
    return table(spark, d, "product").filter(F.col("brand").ilike(f"%{needle}%")).select("id", "brand")


_CLICKS = "clicks AS (SELECT user_id AS listing_id, ts FROM events WHERE event_type = 'click'), cut AS (SELECT max(ts) AS now FROM events)"


def _clicks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Clicks as (listing_id, ts), and the time of the last event as one row."""
    events = table(spark, d, "events")
    return events.filter("event_type = 'click'").select(F.col("user_id").alias("listing_id"), "ts"), events.agg(F.max("ts").alias("now"))


_POOL = f"""WITH {_CLICKS},
c AS (SELECT l.product_id, count(*) AS clicks FROM clicks JOIN listing l ON l.id = clicks.listing_id, cut WHERE ts >= now - INTERVAL 7 DAY GROUP BY 1),
o AS (SELECT product_id, count(*) AS offer_count, min(price_kes) AS min_price, max(last_checked_at) AS checked FROM listing WHERE product_id IS NOT NULL GROUP BY 1),
pool AS (SELECT p.id, p.category_slug, o.offer_count, o.min_price, coalesce(c.clicks, 0) AS clicks FROM product p JOIN o ON o.product_id = p.id LEFT JOIN c ON c.product_id = p.id
ORDER BY o.offer_count DESC, coalesce(c.clicks, 0) DESC, o.checked DESC, p.id LIMIT 150)"""


@query(_POOL + " SELECT * FROM pool")
def home_pool(spark: SparkSession, d: str) -> DataFrame:
    """The 150 products with most offers, then clicks of a week, then freshness. Clicks are counted before the join."""
    clicks, last = _clicks(spark, d)
    listings = table(spark, d, "listing").filter("product_id IS NOT NULL")
    recent = _one(clicks, last).filter(F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS"))
    clicked = recent.join(listings.select(F.col("id").alias("listing_id"), "product_id"), "listing_id").groupBy("product_id").agg(F.count(F.lit(1)).alias("clicks"))
    offers = listings.groupBy("product_id").agg(F.count(F.lit(1)).alias("offer_count"), F.min("price_kes").alias("min_price"), F.max("last_checked_at").alias("checked"))
    pool = offers.join(clicked, "product_id", "left").fillna(0, ["clicks"]).join(table(spark, d, "product").select(F.col("id").alias("product_id"), "category_slug"), "product_id")
    best = pool.orderBy(F.col("offer_count").desc(), F.col("clicks").desc(), F.col("checked").desc(), "product_id").limit(150)
    return best.select(F.col("product_id").alias("id"), "category_slug", "offer_count", "min_price", "clicks")


@query(_POOL + """ SELECT id, category_slug FROM (SELECT *, md5('17:' || id) AS h, row_number() OVER (PARTITION BY category_slug ORDER BY md5('17:' || id), id) AS n FROM pool)
WHERE n <= 4 ORDER BY h, id LIMIT 24""")
def home_rotation(spark: SparkSession, d: str) -> DataFrame:
    """24 products of the pool in a seed's order, four of a category at most."""
    return ranking.capped(home_pool(spark, d), "category_slug", "17", "id", 4, 24).select("id", "category_slug")


@query(_POOL + " SELECT id, min_price FROM (SELECT *, row_number() OVER (ORDER BY offer_count DESC, clicks DESC, id) AS n FROM pool) WHERE n = 17 % 30 + 1")
def featured_pick(spark: SparkSession, d: str) -> DataFrame:
    """One of the pool's first 30, by the seed."""
    return home_pool(spark, d).orderBy(F.col("offer_count").desc(), F.col("clicks").desc(), "id").offset(17 % 30).limit(1).select("id", "min_price")


@query("""
SELECT m.slug, count(l.id) AS listings, count(l.id) FILTER (l.in_stock) AS in_stock, max(l.last_checked_at) AS last_checked,
  floor(date_diff('second', max(l.last_checked_at), (SELECT max(last_checked_at) FROM listing)) / 3600)::BIGINT AS hours_stale
FROM merchant m LEFT JOIN listing l ON l.merchant_id = m.id GROUP BY m.id, m.slug""")
def merchant_health(spark: SparkSession, d: str) -> DataFrame:
    """Offers, stock and staleness of every merchant in one pass, those without offers included."""
    listings = table(spark, d, "listing")
    counted = listings.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("listings"), F.count_if("in_stock").alias("in_stock"), F.max("last_checked_at").alias("last_checked"))
    now = listings.agg(F.max("last_checked_at").alias("now"))
    whole = _one(table(spark, d, "merchant").select(F.col("id").alias("merchant_id"), "slug").join(counted, "merchant_id", "left"), now)
    stale = F.floor(F.timestamp_diff("SECOND", F.col("last_checked").cast("timestamp_ntz").cast("timestamp"), F.col("now")) / 3600)
    return whole.select("slug", F.coalesce("listings", F.lit(0)).alias("listings"), F.coalesce("in_stock", F.lit(0)).alias("in_stock"), "last_checked", stale.alias("hours_stale"))


@query(f"""WITH {_CLICKS}
SELECT l.merchant_id, count(*) FILTER (ts >= now - INTERVAL 1 DAY) AS d1, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS d7, count(*) FILTER (ts >= now - INTERVAL 30 DAY) AS d30
FROM clicks JOIN listing l ON l.id = clicks.listing_id, cut GROUP BY ROLLUP (l.merchant_id)""")
def click_windows(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of three spans by merchant, and in all, in one pass."""
    clicks, last = _clicks(spark, d)
    joined = _one(clicks.join(table(spark, d, "listing").select(F.col("id").alias("listing_id"), "merchant_id"), "listing_id"), last)
    spans = [F.count_if(F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {n} DAYS")).alias(f"d{n}") for n in (1, 7, 30)]
    return joined.rollup("merchant_id").agg(*spans)


@query(f"""WITH {_CLICKS}, c AS (SELECT l.merchant_id, l.id AS listing_id, l.product_id, count(*) AS n FROM clicks JOIN listing l ON l.id = clicks.listing_id GROUP BY 1, 2, 3)
SELECT merchant_id, listing_id, product_id, n FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY n DESC, listing_id) AS place FROM c) WHERE place = 1""")
def top_click_per_merchant(spark: SparkSession, d: str) -> DataFrame:
    """Every merchant's offer with most clicks."""
    clicks, _ = _clicks(spark, d)
    counted = clicks.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(table(spark, d, "listing").select(F.col("id").alias("listing_id"), "merchant_id", "product_id"), "listing_id")
    return ranking.top_per_group(joined, ["merchant_id"], [F.col("n").desc(), F.col("listing_id")]).select("merchant_id", "listing_id", "product_id", "n")


@query("""
SELECT (SELECT count(*) FROM product) AS products, (SELECT count(DISTINCT merchant_id) FROM listing) AS merchants, (SELECT max(last_checked_at) FROM listing) AS checked,
  (SELECT count(*) FROM listing WHERE product_id IS NULL) AS unmatched, (SELECT count(*) FROM product WHERE description IS NULL OR description = '') AS undescribed""")
def catalogue_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the whole catalogue, one pass over each table."""
    products = table(spark, d, "product").agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("description").isNull() | (F.col("description") == "")).alias("undescribed"))
    listings = table(spark, d, "listing").agg(F.countDistinct("merchant_id").alias("merchants"), F.max("last_checked_at").alias("checked"), F.count_if(F.col("product_id").isNull()).alias("unmatched"))
    return _one(products, listings).select("products", "merchants", "checked", "unmatched", "undescribed")


@query("""
SELECT p.slug, max(l.last_checked_at) AS checked FROM product p JOIN listing l ON l.product_id = p.id
WHERE l.in_stock AND p.image_url IS NOT NULL GROUP BY p.id, p.slug
HAVING count(DISTINCT l.merchant_id) >= 2 AND max(l.last_checked_at) >= (SELECT max(last_checked_at) FROM listing) - INTERVAL 180 DAY""")
def fresh_compared_products(spark: SparkSession, d: str) -> DataFrame:
    """Pictured products that two merchants have in stock and that were checked within 180 days."""
    listings = table(spark, d, "listing")
    offers = listings.filter(F.col("in_stock") & F.col("product_id").isNotNull()).groupBy(F.col("product_id").alias("id")).agg(F.countDistinct("merchant_id").alias("n"), F.max("last_checked_at").alias("checked"))
    fresh = _one(offers.filter("n >= 2"), listings.agg(F.max("last_checked_at").alias("now"))).filter(F.col("checked") >= F.col("now") - F.expr("INTERVAL 180 DAYS"))
    return table(spark, d, "product").filter("image_url IS NOT NULL").select("id", "slug").join(fresh, "id").select("slug", "checked")


@query("""
WITH o AS (SELECT product_id, min(price_kes) AS lowest FROM listing WHERE product_id IS NOT NULL GROUP BY 1), n AS (SELECT max(id) AS top FROM product)
SELECT c.c_custkey, o.product_id, o.lowest FROM customer c, n JOIN o ON o.product_id = c.c_custkey % n.top + 1
WHERE c.c_acctbal IS NULL OR o.lowest <= c.c_acctbal * 20""")
def thresholds_reached(spark: SparkSession, d: str) -> DataFrame:
    """Watched products whose lowest price is at or below what the watcher set."""
    lowest = table(spark, d, "listing").filter("product_id IS NOT NULL").groupBy("product_id").agg(F.min("price_kes").alias("lowest"))
    watched = _one(table(spark, d, "customer"), table(spark, d, "product").agg(F.max("id").alias("top"))).withColumn("product_id", F.col("c_custkey") % F.col("top") + 1)
    hit = watched.join(lowest, "product_id").filter(F.col("c_acctbal").isNull() | (F.col("lowest").cast("double") <= F.col("c_acctbal") * 20))
    return hit.select("c_custkey", "product_id", "lowest")


@query("""
WITH o AS (SELECT product_id, min(price_kes) AS lowest FROM listing WHERE in_stock GROUP BY 1), n AS (SELECT max(id) AS top FROM product)
SELECT c.c_custkey, p.slug, o.lowest FROM customer c, n JOIN product p ON p.id = c.c_custkey % n.top + 1 LEFT JOIN o ON o.product_id = p.id""")
def watched_products(spark: SparkSession, d: str) -> DataFrame:
    """Watched products with their lowest price in stock, null where there is none."""
    lowest = table(spark, d, "listing").filter(F.col("in_stock") & F.col("product_id").isNotNull()).groupBy(F.col("product_id").alias("id")).agg(F.min("price_kes").alias("lowest"))
    watched = _one(table(spark, d, "customer"), table(spark, d, "product").agg(F.max("id").alias("top"))).withColumn("id", F.col("c_custkey") % F.col("top") + 1)
    return watched.join(table(spark, d, "product").select("id", "slug"), "id").join(lowest, "id", "left").select("c_custkey", "slug", "lowest")


@query("""
SELECT o_custkey, count(*) AS ratings, round_even(avg(substr(o_orderpriority, 1, 1)::INT), 1) AS average FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1""")
def rating_summary(spark: SparkSession, d: str) -> DataFrame:
    """Number and mean of the visible ratings, to one place, halves to the even side."""
    rating = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, d, "orders").filter("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("ratings"), F.bround(F.avg(rating), 1).alias("average"))


@query("SELECT id, price_kes FROM (SELECT * FROM listing ORDER BY last_checked_at DESC, id LIMIT 300) WHERE NOT in_stock")
def queue_limit_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """Of the 300 newest offers those out of stock: the limit comes first."""
    return table(spark, d, "listing").orderBy(F.col("last_checked_at").desc(), "id").limit(300).filter(~F.col("in_stock")).select("id", "price_kes")


@query("SELECT id, price_kes FROM listing WHERE NOT in_stock ORDER BY last_checked_at DESC, id LIMIT 300")
def queue_filter_then_limit(spark: SparkSession, d: str) -> DataFrame:
    """The 300 newest offers out of stock: the filter comes first."""
    return table(spark, d, "listing").filter(~F.col("in_stock")).orderBy(F.col("last_checked_at").desc(), "id").limit(300).select("id", "price_kes")


@query("SELECT id FROM product WHERE id NOT IN (SELECT product_id FROM listing WHERE product_id IS NOT NULL)")
def orphan_products(spark: SparkSession, d: str) -> DataFrame:
    """Products that no offer refers to."""
    return maintenance.orphans(table(spark, d, "product").select("id"), "id", table(spark, d, "listing"), "product_id")


@query("""
SELECT id, product_id, merchant_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id, merchant_id ORDER BY last_checked_at DESC, id DESC) AS n FROM listing WHERE product_id IS NOT NULL) WHERE n = 1""")
def latest_per_merchant(spark: SparkSession, d: str) -> DataFrame:
    """The newest offer of each product and merchant."""
    offers = table(spark, d, "listing").filter("product_id IS NOT NULL").select("id", "product_id", "merchant_id", "last_checked_at")
    return maintenance.keep_latest(offers, ["product_id", "merchant_id"], "last_checked_at", "id").select("id", "product_id", "merchant_id")


_COARSE = "p AS (SELECT id, created_at, split_part(canonical_key, '|', 1) || '|' || split_part(canonical_key, '|', 2) AS coarse FROM product)"


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("canonical_key", r"\|")
    return table(spark, d, "product").select("id", "created_at", F.concat_ws("|", F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("coarse"))


@query(f"""WITH {_COARSE}, n AS (SELECT product_id, count(*) AS offers FROM listing WHERE product_id IS NOT NULL GROUP BY 1),
w AS (SELECT p.id, p.coarse, row_number() OVER (PARTITION BY p.coarse ORDER BY coalesce(n.offers, 0) DESC, p.created_at, p.id) AS place FROM p LEFT JOIN n ON n.product_id = p.id)
SELECT a.id, b.id AS winner FROM w a JOIN w b ON b.coarse = a.coarse AND b.place = 1""")
def merge_winner(spark: SparkSession, d: str) -> DataFrame:
    """For every product the one of its coarser key that it would be merged into: most offers, then oldest."""
    offers = table(spark, d, "listing").filter("product_id IS NOT NULL").groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias("offers"))
    counted = _coarse(spark, d).join(offers, "id", "left").fillna(0, ["offers"])
    return maintenance.winners(counted, "coarse", "id", [F.col("offers").desc(), F.col("created_at")])


@query(f"WITH {_COARSE} SELECT count(*) AS groups, count(*) FILTER (n > 1) AS merging, sum(n - 1)::BIGINT AS merged FROM (SELECT coarse, count(*) AS n FROM p GROUP BY 1)")
def coarse_groups(spark: SparkSession, d: str) -> DataFrame:
    """How many groups a coarser key makes and how many products it would merge."""
    sizes = _coarse(spark, d).groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("merging"), F.sum(F.col("n") - 1).alias("merged"))


@query("""
WITH RECURSIVE r AS (SELECT s_suppkey AS old, s_suppkey // 2 AS new FROM supplier WHERE s_suppkey > 1),
f AS (SELECT old, new, 1 AS n FROM r UNION ALL SELECT f.old, r.new, f.n + 1 FROM f JOIN r ON r.old = f.new)
SELECT old, arg_max(new, n) AS new FROM f GROUP BY old""")
def redirect_compress(spark: SparkSession, d: str) -> DataFrame:
    """Chains of forwardings cut to one step."""
    links = table(spark, d, "supplier").filter("s_suppkey > 1").select(F.col("s_suppkey").alias("old"), F.floor(F.col("s_suppkey") / 2).alias("new"))
    return maintenance.compressed_redirects(links)


@query("""
WITH r AS (SELECT listing_id, last_checked_at, arg_max(price_kes, struct_pack(l := loaded_at, i := snap_id)) AS price FROM listing_snapshot WHERE last_checked_at IS NOT NULL AND price_kes IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY last_checked_at) AS before FROM r)
SELECT listing_id, last_checked_at, price FROM c WHERE price IS DISTINCT FROM before""")
def price_history_changes(spark: SparkSession, d: str) -> DataFrame:
    """Readings whose price differs from the one before."""
    known = table(spark, d, "listing_snapshot").filter("last_checked_at IS NOT NULL AND price_kes IS NOT NULL")
    readings = known.groupBy("listing_id", "last_checked_at").agg(F.max_by("price_kes", F.struct("loaded_at", "snap_id")).alias("price"))
    return maintenance.changes_in_time(readings, "listing_id", "last_checked_at", "price").select("listing_id", "last_checked_at", "price")


_PAGE = "regexp_replace(url, '[?#].*$', '')"


@query(f"""
WITH i AS (SELECT {_PAGE} AS page, arg_max(struct_pack(price_kes, in_stock, title), seq) AS v FROM raw_listing GROUP BY 1)
SELECT coalesce(l.url, i.page) AS page, CASE WHEN i.page IS NOT NULL THEN i.v.price_kes ELSE l.price_kes END AS price_kes, CASE WHEN i.page IS NOT NULL THEN i.v.in_stock ELSE l.in_stock END AS in_stock,
  CASE WHEN i.page IS NULL THEN 'kept' WHEN l.url IS NULL THEN 'new' ELSE 'updated' END AS status
FROM (SELECT url, any_value(price_kes) AS price_kes, any_value(in_stock) AS in_stock FROM listing GROUP BY url) l FULL JOIN i ON i.page = l.url""")
def upsert_current_state(spark: SparkSession, d: str) -> DataFrame:
    """The offers after the deliveries: of an offer's deliveries the last one counts."""
    current = table(spark, d, "listing").select(F.col("url").alias("page"), "price_kes", "in_stock").dropDuplicates(["page"])
    incoming = table(spark, d, "raw_listing").select(F.regexp_replace("url", "[?#].*$", "").alias("page"), "price_kes", "in_stock", "seq")
    return maintenance.merged_offers(current, incoming, ["page"], "seq", ["price_kes", "in_stock"])


@query("""
SELECT id, in_stock AND last_checked_at >= (SELECT max(last_checked_at) FROM listing) - INTERVAL 30 DAY AS in_stock, last_checked_at < (SELECT max(last_checked_at) FROM listing) - INTERVAL 30 DAY AND in_stock AS taken_down FROM listing""")
def stale_taken_down(spark: SparkSession, d: str) -> DataFrame:
    """Offers not seen for 30 days set out of stock."""
    listings = table(spark, d, "listing")
    marked = _one(listings, listings.agg(F.max("last_checked_at").alias("now"))).withColumn("stale", F.col("last_checked_at") < F.col("now") - F.expr("INTERVAL 30 DAYS"))
    return marked.select("id", (F.col("in_stock") & ~F.col("stale")).alias("in_stock"), (F.col("stale") & F.col("in_stock")).alias("taken_down"))


@query("SELECT merchant_id, count(*) FILTER (price_kes > 1000000) AS repaired, count(*) FILTER (price_kes <= 1000000) AS kept, max(CASE WHEN price_kes > 1000000 THEN round(price_kes / 100, 2) ELSE price_kes END)::DOUBLE AS highest FROM listing GROUP BY 1")
def unit_repair(spark: SparkSession, d: str) -> DataFrame:
    """Amounts recorded in hundredths put right, by merchant; done twice it changes nothing more."""
    wrong = F.col("price_kes") > 1_000_000
    fixed = F.when(wrong, F.round(F.col("price_kes") / 100, 2)).otherwise(F.col("price_kes"))
    return table(spark, d, "listing").groupBy("merchant_id").agg(F.count_if(wrong).alias("repaired"), F.count_if(~wrong).alias("kept"), F.max(fixed).cast("double").alias("highest"))


@query(r"""
SELECT seq, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS cleaned,
  regexp_replace(regexp_replace(translate(lower(title), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM raw_listing""")
def title_clean_slug(spark: SparkSession, d: str) -> DataFrame:
    """Titles cleaned, and as part of an address."""
    return table(spark, d, "raw_listing").select("seq", text.clean_title(F.col("title")).alias("cleaned"), text.slug(F.col("title")).alias("slug"))


@query("""
SELECT seq, CASE WHEN contains(lower(title), 'refurb') OR contains(lower(title), 'renewed') THEN 'refurbished' WHEN contains(lower(title), 'used') OR contains(lower(title), 'second hand') THEN 'used' ELSE 'new' END AS condition FROM raw_listing""")
def condition_map(spark: SparkSession, d: str) -> DataFrame:
    """The condition that a title tells."""
    return table(spark, d, "raw_listing").select("seq", text.condition(F.col("title")).alias("condition"))


@query("SELECT seq, TRY_CAST(replace(regexp_extract(title, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS DECIMAL(12,2)) AS amount FROM raw_listing")
def price_parse(spark: SparkSession, d: str) -> DataFrame:
    """The first amount in a text."""
    return table(spark, d, "raw_listing").select("seq", numbers.parse_amount(F.col("title")).alias("amount"))


@query("SELECT seq, substr(sha256(category_slug || chr(0) || title), 1, 16) AS title_hash FROM raw_listing")
def title_hash(spark: SparkSession, d: str) -> DataFrame:
    """A short hash of category and title."""
    return table(spark, d, "raw_listing").select("seq", text.title_hash(F.col("category_slug"), F.col("title")).alias("title_hash"))


@query("""
SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents""")
def xml_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with the signs escaped that mark up XML."""
    return table(spark, d, "documents").select("doc_id", text.xml_escape(F.col("text")).alias("escaped"))


@query("""
SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ago' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h ago' ELSE (s // 86400)::VARCHAR || 'd ago' END AS checked
FROM (SELECT id, date_diff('second', date_trunc('second', last_checked_at), date_trunc('second', (SELECT max(last_checked_at) FROM listing))) AS s FROM listing)""")
def checked_ago(spark: SparkSession, d: str) -> DataFrame:
    """How long ago offers were checked, in words."""
    listings = table(spark, d, "listing")
    timed = _one(listings, listings.agg(F.max("last_checked_at").alias("now")))
    seconds = F.unix_seconds("now") - F.unix_seconds("last_checked_at")
    return timed.select("id", text.ago(seconds).alias("checked"))


@query("""
WITH k AS (SELECT l.id, p.canonical_key AS old_key, t.canonical_key AS new_key FROM listing l LEFT JOIN product p ON p.id = l.product_id
  JOIN (SELECT regexp_replace(r.url, '[?#].*$', '') AS page, arg_max(t.canonical_key, t.seq) AS canonical_key FROM parsed_title t JOIN raw_listing r USING (seq) WHERE t.canonical_key IS NOT NULL GROUP BY 1) t ON t.page = l.url)
SELECT id, old_key, new_key, CASE WHEN new_key IS NULL THEN 'leave' WHEN new_key IS NOT DISTINCT FROM old_key THEN 'keep'
  WHEN new_key IN (SELECT old_key FROM k WHERE old_key IS NOT NULL) THEN 'move' ELSE 'create' END AS action FROM k""")
def rekey_plan(spark: SparkSession, d: str) -> DataFrame:
    """What the parsers' latest keys ask for: offers to keep, to move and to make products for."""
    pages = table(spark, d, "raw_listing").select("seq", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    parsed = table(spark, d, "parsed_title").filter("canonical_key IS NOT NULL").select("seq", "canonical_key").join(pages, "seq")
    newest = parsed.groupBy("url").agg(F.max_by("canonical_key", "seq").alias("new_key"))
    known = table(spark, d, "product").select(F.col("id").alias("product_id"), F.col("canonical_key").alias("old_key"))
    offers = table(spark, d, "listing").select("id", "url", "product_id").join(newest, "url").join(known, "product_id", "left")
    return maintenance.rekey_plan(offers, "id", "old_key", "new_key")


@query("""
SELECT id, canonical_key, len(string_split(canonical_key, '|')) - 1 AS depth, regexp_replace(canonical_key, '[- ]', '', 'g') AS loose FROM product""")
def key_forms(spark: SparkSession, d: str) -> DataFrame:
    """Depth and loose form of every key."""
    return table(spark, d, "product").select("id", "canonical_key", keys.depth(F.col("canonical_key")).cast("long").alias("depth"), F.regexp_replace("canonical_key", "[- ]", "").alias("loose"))


@query("""
WITH g AS (SELECT *, first_value(id) OVER w AS eldest, first_value(specs) OVER w AS eldest_specs FROM product WINDOW w AS (PARTITION BY canonical_key ORDER BY id))
SELECT id, eldest, coalesce(json_extract_string(specs, '$.storage_gb')::DOUBLE <> json_extract_string(eldest_specs, '$.storage_gb')::DOUBLE, false) OR coalesce(json_extract_string(specs, '$.ram_gb')::DOUBLE <> json_extract_string(eldest_specs, '$.ram_gb')::DOUBLE, false)
 OR coalesce(json_extract_string(specs, '$.screen_mm')::DOUBLE <> json_extract_string(eldest_specs, '$.screen_mm')::DOUBLE, false) OR coalesce(json_extract_string(specs, '$.volume_ml')::DOUBLE <> json_extract_string(eldest_specs, '$.volume_ml')::DOUBLE, false)
 OR coalesce(json_extract_string(specs, '$.mass_g')::DOUBLE <> json_extract_string(eldest_specs, '$.mass_g')::DOUBLE, false) OR coalesce(json_extract_string(specs, '$.power_w')::DOUBLE <> json_extract_string(eldest_specs, '$.power_w')::DOUBLE, false)
 OR coalesce(json_extract_string(specs, '$.battery_mah')::DOUBLE <> json_extract_string(eldest_specs, '$.battery_mah')::DOUBLE, false) OR coalesce(json_extract_string(specs, '$.energy_wh')::DOUBLE <> json_extract_string(eldest_specs, '$.energy_wh')::DOUBLE, false)
 OR coalesce(json_extract_string(specs, '$.length_mm')::DOUBLE <> json_extract_string(eldest_specs, '$.length_mm')::DOUBLE, false) AS conflict FROM g WHERE id <> eldest""")
def spec_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a product's numeric specs contradict those of the eldest product of its key."""
    products = table(spark, d, "product").select("id", "canonical_key", "specs")
    eldest = products.groupBy("canonical_key").agg(F.min("id").alias("eldest"), F.min_by("specs", "id").alias("eldest_specs"))
    return products.join(eldest, "canonical_key").filter("id <> eldest").select("id", "eldest", keys.numeric_conflict(F.col("specs"), F.col("eldest_specs")).alias("conflict"))


@query("""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id, e.vec_id AS neighbour, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 4) AS similarity
      FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id)
SELECT vec_id, neighbour, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS n FROM s) WHERE n <= 8""")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight most similar vectors of the same label, exactly, for the vectors whose id 20 divides."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select("vec_id", "label", F.col("embedding").alias("asked"))
    met = vectors.select(F.col("vec_id").alias("neighbour"), "label", "embedding").join(asked, "label").filter("vec_id <> neighbour")
    scored = met.select("vec_id", "neighbour", F.round(keys.cosine(F.col("asked"), F.col("embedding")), 4).alias("similarity"))
    return ranking.top_per_group(scored, ["vec_id"], [F.col("similarity").desc(), F.col("neighbour")], 8).drop("place")


@query("""
SELECT 'region' AS part, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'category', count(*) FROM category""")
def sources_together(spark: SparkSession, d: str) -> DataFrame:
    """Counts of several sources put together by column name."""
    parts = [table(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n in ("region", "nation", "category")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 1")
def daily_caps(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and kind, the count that a daily cap is held against."""
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH b AS (SELECT user_id, ts, event_id, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum((before IS NULL OR ts - before > INTERVAL 6 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b)
SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS opened, max(ts) AS closed FROM s GROUP BY 1, 2""")
def visits_by_gap(spark: SparkSession, d: str) -> DataFrame:
    """An extension: events of a user cut into visits by gaps of more than six hours."""
    return maintenance.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 6 * 3600 * 1_000_000)


@query()
def titles_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the categories that have a grammar, read with the brands of the reference list, a fixed table."""
    brands = [r[0] for r in table(spark, d, "brand_reference").select("brand_name").limit(1001).collect()]
    if len(brands) > 1000:
        raise ValueError("more than 1000 reference brands; titles would be read without the rest")
    leaves = ["audio", "blenders", "inverters", "kettles", "laptops", "phone-tablet-accessories", "phones", "refrigerators", "solar-batteries", "tablets", "tvs", "washers-dryers"]
    grammar = F.create_map(F.lit("washers"), F.lit("washers-dryers"), F.lit("phone-covers"), F.lit("phone-tablet-accessories"))[F.col("category_slug")]
    raw = table(spark, d, "raw_listing").select("seq", F.coalesce(grammar, "category_slug").alias("category_slug"), "title", "description")
    return titles.parsed_offers(raw, "title", leaves, brands, "description").select("seq", "category_slug", "parsed.brand", "parsed.canonical_key")


@query("""
WITH l AS (SELECT product_id, count(*) AS offer_count, min(price_kes)::DOUBLE AS low FROM listing WHERE product_id IS NOT NULL GROUP BY 1)
SELECT p.id, p.slug, l.offer_count, l.low FROM product p LEFT JOIN l ON l.product_id = p.id""")
def product_offers_left(spark: SparkSession, d: str) -> DataFrame:
    """Products with their offers, those without any included; offers are counted before the join."""
    offers = table(spark, d, "listing").filter("product_id IS NOT NULL").groupBy("product_id").agg(F.count(F.lit(1)).alias("offer_count"), F.min("price_kes").cast("double").alias("low"))
    products = table(spark, d, "product").select("id", "slug")
    return products.join(offers, products["id"] == offers["product_id"], "left").select("id", "slug", "offer_count", "low")


@query("""
WITH a AS (SELECT id, product_id, url FROM listing), r AS (SELECT id AS old, id - 1 AS new FROM product WHERE id % 3 = 0)
SELECT a.id, coalesce(r.new, a.product_id) AS product_id FROM a LEFT JOIN r ON r.old = a.product_id""")
def redirect_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Offers led to the product that a forwarding names, or left where they are. Every third product forwards, for want of a table of forwardings."""
    offers = table(spark, d, "listing").select("id", F.col("product_id").alias("old"))
    forward = table(spark, d, "product").filter("id % 3 = 0").select(F.col("id").alias("old"), (F.col("id") - 1).alias("new"))
    return offers.join(forward, "old", "left").select("id", F.coalesce("new", "old").alias("product_id"))


@query("SELECT seq, merchant_slug FROM (SELECT *, row_number() OVER (PARTITION BY merchant_slug ORDER BY observed_at DESC, seq DESC) AS n FROM raw_listing) WHERE n = 1")
def newest_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Every merchant's newest delivery."""
    return maintenance.keep_latest(table(spark, d, "raw_listing").select("seq", "merchant_slug", "observed_at"), ["merchant_slug"], "observed_at", "seq").select("seq", "merchant_slug")
