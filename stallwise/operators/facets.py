"""Filters of a category page: a registry of facets, turned into predicates before or after grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import sorted_values

# The numeric specs by which a category's items are filtered.
FILTERED_SPECS = """
phones tablets laptops: storage_gb ram_gb
tvs: screen_mm
refrigerators kettles: volume_ml
washers: mass_g
blenders: volume_ml power_w
audio: power_w
inverters: power_w
solar-batteries: energy_wh
"""


class Filters(NamedTuple):
    """What a category's page can be filtered by: names in the address, and what of the data they are held against."""

    choices: dict[str, Column]  #: of products; one of several values
    switches: dict[str, Column]  #: of offers; on or off
    ceilings: dict[str, str]  #: aggregates with an upper bound


def facets_for(category: str) -> Filters:
    """The filters of a category: its brand and specs, stock, and price."""
    lines = (line.split(":") for line in FILTERED_SPECS.split("\n") if line)
    specs = [name for categories, names in lines if category in categories.split() for name in names.split()]
    choices = {"brand": F.col("brand")} | {name: F.get_json_object("specs", f"$.{name}") for name in specs}
    return Filters(choices, {"in_stock": F.col("in_stock")}, {"price_max": "min_price"})


def asked(query: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """What a query string asks for; values of blanks ask for nothing."""
    stated = {key: [v for v in values if v.strip()] for key, values in query.items()}
    return {key: values for key, values in stated.items() if values}


def filtered_offers(products: DataFrame, listings: DataFrame, query: Mapping[str, Sequence[str]], filters: Filters) -> DataFrame:
    """Products with ``min_price`` and ``offer_count`` under the filters that the query names; unknown names are ignored.

    Choices and switches filter rows before grouping, so they also change the aggregates; values of one choice are
    alternatives, and a switch of 0 or false is off. Ceilings filter the aggregates; they are trimmed, and ignored unless
    they are whole numbers.
    """
    wanted = asked(query)
    for name in filters.choices.keys() & wanted.keys():
        products = products.filter(filters.choices[name].isin(wanted[name]))
    for name in filters.switches.keys() & wanted.keys():
        if wanted[name][0].strip().lower() not in ("0", "false"):
            listings = listings.filter(filters.switches[name])
    offers = listings.groupBy("product_id").agg(F.min("price_kes").alias("min_price"), F.count(F.lit(1)).alias("offer_count"))
    found = products.join(offers, products["id"] == offers["product_id"]).drop("product_id")
    for name in filters.ceilings.keys() & wanted.keys():
        if (most := wanted[name][0].strip()).isdigit():
            found = found.filter(F.col(filters.ceilings[name]) <= F.lit(int(most)))
    return found


def available_values(products: DataFrame, filters: Filters) -> DataFrame:
    """``facet`` and its ``choices`` in order, whatever filters are active; placeholders are no values.

    One pass over the products: each row yields its value of every choice, and equal ones are combined before the shuffle.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("facet"), value.alias("value")) for name, value in filters.choices.items()])).alias("e")
    known = products.select(each).select("e.*").filter(F.col("value").isNotNull() & ~F.lower("value").isin("", "null", "unknown")).distinct()
    return known.groupBy("facet").agg(sorted_values(F.collect_set("value")).alias("choices"))
