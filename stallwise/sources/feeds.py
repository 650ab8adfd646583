"""Catalogue feeds in JSON: pages landed as text, turned into offers.

A page is a row with ``merchant_slug``, ``base_url``, ``page_no`` and ``body``. Fetching is left to whatever lands the
pages; these readers do what a crawler would decide on their contents: unwrap, stop at the first page that brings
nothing new, drop repeated items, route items to categories and price them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import from_minor_units
from ..functions.text import first_picture, strip_html
from ..schemas import SHOP_PRODUCTS, STORE_PRODUCTS


def unwrapped(body: Column) -> Column:
    """JSON as it is, or the text of the element that a browser wraps it in."""
    inner = F.regexp_extract(body, r"(?is)<pre[^>]*>(.*?)</pre>", 1)
    return F.when(F.trim(body).rlike(r"^[\[{]"), F.trim(body)).otherwise(F.replace(F.replace(inner, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))


def until_nothing_new(items: DataFrame, source: str, page: str, key: str) -> DataFrame:
    """Each key once, from the page where it came first; pages after one that brought nothing new are left out."""
    first = items.withColumn("nth", F.row_number().over(W.partitionBy(source, key).orderBy(page, "position"))).filter("nth = 1").drop("nth")
    pages = items.select(source, page).distinct().join(first.groupBy(source, page).agg(F.count(F.lit(1)).alias("fresh")), [source, page], "left")
    barren = pages.filter(F.coalesce("fresh", F.lit(0)) == 0).groupBy(source).agg(F.min(page).alias("barren"))
    return first.join(barren, source, "left").filter(F.col("barren").isNull() | (F.col(page) < F.col("barren"))).drop("barren")


def routed(slugs: Column, routes: Mapping[str, str], by_route: bool = False) -> Column:
    """The category of the first slug that has a route; with ``by_route`` of the first route that any slug takes."""
    pairs = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    if by_route:
        return F.coalesce(*[F.when(F.array_contains(slugs, s), F.lit(c)) for s, c in routes.items()])
    return F.get(F.filter(F.transform(slugs, lambda s: F.try_element_at(pairs, s)), lambda c: c.isNotNull()), F.lit(0))


def by_longest_word(texts: Sequence[Column], words: Mapping[str, str]) -> Column:
    """The category whose word is the longest that a text holds; the first text that holds any decides."""
    choices = F.array(*[F.struct(F.lit(len(w)).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c"), F.lit(w).alias("w")) for i, (w, c) in enumerate(words.items())])

    def longest(text: Column) -> Column:
        return F.array_max(F.filter(choices, lambda s: F.lower(text).contains(s["w"])))["c"]

    found = [longest(text) for text in texts]
    return F.coalesce(*found)


def store_offers(pages: DataFrame, routes: Mapping[str, str], by_route: bool = False) -> DataFrame:
    """Offers of a store interface: an array of products a page, prices in smallest units, a product once by its id."""
    parsed = pages.select("merchant_slug", "page_no", F.posexplode(F.from_json(unwrapped(F.col("body")), STORE_PRODUCTS)).alias("position", "p"))
    items = until_nothing_new(parsed.withColumn("item", F.col("p.id")).filter("item IS NOT NULL"), "merchant_slug", "page_no", "item")
    special = F.when(F.col("p.prices.price") != "", F.col("p.prices.price"))
    price = from_minor_units(F.coalesce(special, F.col("p.prices.regular_price")), F.coalesce("p.prices.currency_minor_unit", F.lit(2)))
    return items.select(
        "merchant_slug",
        F.col("p.sku").alias("merchant_sku"),
        F.col("p.permalink").alias("url"),
        F.col("p.name").alias("title"),
        price.alias("price_kes"),
        F.coalesce("p.is_in_stock", F.lit(True)).alias("in_stock"),
        first_picture(F.get("p.images.src", F.lit(0)), F.get("p.images.src", F.lit(1))).alias("image_url"),
        routed(F.col("p.categories.slug"), routes, by_route).alias("category_slug"),
        strip_html(F.col("p.description")).alias("description"),
    ).filter("category_slug IS NOT NULL AND price_kes > 0")


def shop_offers(pages: DataFrame, words: Mapping[str, str]) -> DataFrame:
    """Offers of a shop's product list: the cheapest variant's price, in stock if any variant is, category by its words."""
    parsed = pages.select("merchant_slug", "base_url", "page_no", F.posexplode(F.from_json(unwrapped(F.col("body")), SHOP_PRODUCTS)["products"]).alias("position", "p"))
    items = until_nothing_new(parsed.withColumn("item", F.col("p.id")).filter("item IS NOT NULL"), "merchant_slug", "page_no", "item")
    prices = F.filter(F.transform("p.variants", lambda v: v["price"].try_cast("decimal(12,2)")), lambda x: x > 0)
    return items.select(
        "merchant_slug",
        F.get("p.variants.sku", F.lit(0)).alias("merchant_sku"),
        F.concat("base_url", F.lit("/products/"), "p.handle").alias("url"),
        F.col("p.title").alias("title"),
        F.array_min(prices).alias("price_kes"),
        F.exists("p.variants", lambda v: v["available"]).alias("in_stock"),
        first_picture(F.get("p.images.src", F.lit(0))).alias("image_url"),
        by_longest_word([F.col("p.product_type"), F.col("p.title")], words).alias("category_slug"),
        strip_html(F.col("p.body_html")).alias("description"),
    ).filter("category_slug IS NOT NULL AND price_kes IS NOT NULL")
