"""Schemas of the records that sources deliver and operators return."""

from __future__ import annotations

OFFER = (
    "seq BIGINT, merchant_slug STRING, merchant_sku STRING, url STRING, title STRING, price_kes DECIMAL(12,2), in_stock BOOLEAN, "
    "image_url STRING, category_slug STRING, description STRING, observed_at TIMESTAMP"
)
PARSED_TITLE = "brand STRING, model STRING, canonical_key STRING, specs MAP<STRING,STRING>, display_title STRING"
STORE_PRODUCTS = (
    "ARRAY<STRUCT<id: BIGINT, name: STRING, sku: STRING, permalink: STRING, is_in_stock: BOOLEAN, description: STRING, "
    "categories: ARRAY<STRUCT<slug: STRING>>, images: ARRAY<STRUCT<src: STRING>>, "
    "prices: STRUCT<price: STRING, regular_price: STRING, currency_minor_unit: INT>>>"
)
SHOP_PRODUCTS = (
    "STRUCT<products: ARRAY<STRUCT<id: BIGINT, title: STRING, handle: STRING, product_type: STRING, body_html: STRING, "
    "variants: ARRAY<STRUCT<price: STRING, available: BOOLEAN, sku: STRING>>, images: ARRAY<STRUCT<src: STRING>>>>>"
)
