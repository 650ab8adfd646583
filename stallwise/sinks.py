"""Outputs: text documents built from rows, files, and stored results with an age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sources.tables import stored

from .functions.text import xml_escape


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, flags as 1 and 0, null as nothing."""
    flags = [f.name for f in df.schema if f.dataType.typeName() == "boolean"]
    df.withColumns({c: F.col(c).cast("int") for c in flags}).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sitemap_parts(df: DataFrame, address: Column, changed: Column, per_file: int = 50_000) -> DataFrame:
    """``part``, ``urls`` and ``xml`` of a site map, in files of at most about ``per_file`` addresses, by a hash of the address."""
    parts = max(1, -(-df.count() // per_file))
    entry = F.concat(F.lit("<url><loc>"), xml_escape(address), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format(changed, "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    rows = df.select(F.pmod(F.xxhash64(address), F.lit(parts)).alias("part"), entry.alias("entry")).filter("entry IS NOT NULL")
    body = F.array_join(F.array_sort(F.collect_list("entry")), "")
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("urls"), F.concat(F.lit(head), body, F.lit("</urlset>")).alias("xml"))


def product_documents(products: DataFrame, offers: DataFrame, ratings: DataFrame, most_reviews: int = 10) -> DataFrame:
    """A nested document for each product: its offers by price, its mean rating, and its first reviews.

    ``offers``: product_id, merchant, url, price, in_stock; ``ratings``: product_id, rating, body, written_at.
    """
    offer = F.struct("price", "merchant", "url", "in_stock")
    sold = offers.groupBy("product_id").agg(F.array_sort(F.collect_list(offer)).alias("offers"), F.min("price").alias("low_price"), F.count(F.lit(1)).alias("offer_count"))
    review = F.struct("written_at", "rating", "body")
    rated = ratings.groupBy("product_id").agg(
        F.round(F.avg("rating"), 1).alias("rating"), F.count(F.lit(1)).alias("rating_count"), F.slice(F.reverse(F.array_sort(F.collect_list(review))), 1, most_reviews).alias("reviews")
    )
    whole = products.join(sold, products["id"] == sold["product_id"], "left").drop("product_id")
    whole = whole.join(rated, whole["id"] == rated["product_id"], "left").drop("product_id")
    return whole.select("id", F.to_json(F.struct("title", "brand", "low_price", "offer_count", "offers", "rating", "rating_count", "reviews")).alias("document"))


def stored_result(spark, path: str, build, now, longest_s: float = 86_400, least_s: float | None = None) -> DataFrame:
    """A result kept at ``path`` with its time; built anew if it is missing or ``longest_s`` old.

    With ``least_s`` it is also built anew if it is older than that, for runs that refresh ahead of readers.
    """
    kept = stored(spark, path)
    age = None if kept is None else kept.agg(F.max("generated_at")).first()[0]
    age_s = (now - age).total_seconds() if age else None
    limit = longest_s if least_s is None else min(longest_s, least_s)
    if age_s is None or age_s >= limit:
        build().withColumn("generated_at", F.lit(now)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
