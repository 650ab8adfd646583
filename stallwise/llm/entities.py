"""Listings of the same item, by generic merge resolution.

Every listing starts as a profile of what its visits tell: model code, variant, size, category, brand. Profiles that
match are merged; the merged profile holds the attributes and listings of both and takes their place. Richer profiles
are blocked and matched again, until no profile changes. A round either leaves fewer profiles, or fewer unknown values,
or changes nothing, so the rounds end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_below
from ..operators.units import common_quantities
from ..session import durable
from .brands import mapped_names

# Words that tell variants of one model apart.
VARIANTS = "pro max plus lite neo ultra mini air se fe prime go slim edge".split()
# Signs read or typed for a figure.
CONFUSED = str.maketrans({"O": "0", "Q": "0", "D": "0", "I": "1", "l": "1", "Z": "2", "S": "5", "G": "6", "B": "8"})
MAX_BROADCAST_ROWS = 200_000
ATTRIBUTES = ("code", "variant", "size", "category", "brand_id")
HOT_ITEM = 2_000  #: listings of one item that are paired in one place; those of larger ones are dealt to several
#: Sizes within this share of each other are one size, rounded or converted differently.
SAME_SIZE = 0.02

_UNIT = r"(?:gb|tb|mb|mm|cms?|in|inch(?:es)?|ml|l|lt?rs?|lit(?:re|er)s?|gal(?:lons?)?|g|grams?|kgs?|lbs?|pounds?|oz|w|watts?|kw|hp|m?ah|k?wh|ft|feet|m|mtrs?|met(?:re|er)s?|cu\.?\s?ft|mp|hz|v|\"|″)"
_CODE = re.compile(
    rf"(?<![A-Za-z0-9])(?P<letters>[A-Za-z]{{1,4}})(?P<gap>[\s-]?)(?P<figures>\d{{2,4}}(?:[.-]\d{{2,3}})?)(?![A-Za-z0-9]|\s?{_UNIT}(?![A-Za-z])|[.,]\d)(?P<plus>\+(?!\d))?(?:[\s(-]*\b(?P<variant>{'|'.join(VARIANTS)})\b)?", re.I
)
_TYPED = re.compile(rf"(?<![A-Za-z0-9])(?P<token>[A-Za-z]{{1,4}}[0-9OQDIlZSGB]{{3,6}})(?![A-Za-z0-9])(?P<plus>\+(?!\d))?(?:[\s(-]*\b(?P<variant>(?i:{'|'.join(VARIANTS)}))\b)?")
_FITS = re.compile(r"\b(?:fits|for|compatible with|suitable for|suits)\b(?P<of>[^|,;]*)", re.I)


def own_text(text: str) -> str:
    """The text without the models that an accessory is said to fit."""

    def cut(m: re.Match) -> str:
        codes = list(_CODE.finditer(m["of"])) or list(_TYPED.finditer(m["of"]))
        return f" {m['of'][codes[0].end():]}" if codes else m[0]

    return _FITS.sub(cut, text)


def codes_in(text: str) -> list[tuple[str, str, int, int]]:
    """(code, variant, doubt, place) of each reading of each model code, places numbered in text order.

    Doubt is 0 for a code as typed in one piece, 1 with signs inside, 2 with a blank, 3 with letters read as figures.
    """
    text, found = own_text(" ".join(text.split())), []
    for m in _CODE.finditer(text):
        letters, figures = m["letters"].lower(), re.sub(r"\D", "", m["figures"])
        if len(figures) >= 3 and not (m["gap"] and letters in VARIANTS and len(letters) > 2):
            doubt = 2 if m["gap"].isspace() else 0 if not m["gap"] and m["figures"].isdigit() else 1
            found.append((letters + figures, _variant(m), doubt, m.start()))
    for m in _TYPED.finditer(text):
        token = m["token"]
        for cut in range(1, 5):
            letters, figures = token[:cut], token[cut:].translate(CONFUSED)
            if letters.isalpha() and 3 <= len(figures) <= 6 and figures.isdigit() and not token[cut:].isdigit():
                found.append((letters.lower() + figures, _variant(m), 3, m.start()))
    places = {start: i for i, start in enumerate(sorted({f[3] for f in found}))}
    return [(*f[:3], places[f[3]]) for f in found]


def _variant(m: re.Match) -> str:
    return (m["variant"] or "").lower() or ("plus" if m["plus"] else "")


def _codes(rows: DataFrame) -> DataFrame:
    """``listing_id``, ``code``, ``variant``, ``doubt``, ``place`` of every code in the texts, titles first."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for listing, title, description in zip(batch["listing_id"], batch["title"], batch["description"]):
                for place, text in enumerate((title, description)):
                    if isinstance(text, str):
                        out += [(listing, code, variant, doubt, 1000 * place + at) for code, variant, doubt, at in codes_in(plain_width(text))]
            yield pd.DataFrame(out, columns=["listing_id", "code", "variant", "doubt", "place"])

    return rows.select("listing_id", "title", "description").mapInPandas(work, "listing_id long, code string, variant string, doubt long, place long")


def plain_width(text: str) -> str:
    """Compatible forms of full-width letters; case stays, as it tells an l from an I."""
    return unicodedata.normalize("NFKC", text)


def page(url: Column) -> Column:
    """The address without what a visit appended to it."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"/+$", "")


def _key_codes(listing: DataFrame, products: DataFrame) -> DataFrame:
    """The code and variant in the key of the product that a listing is linked to, as the last resort: links can be wrong."""
    key = F.regexp_extract("canonical_key", rf"([a-z]+)-?([0-9]{{3,}})(?:-({'|'.join(VARIANTS)})\b)?", 0)
    linked = listing.select(F.col("id").alias("listing_id"), "product_id").join(products.select(F.col("id").alias("product_id"), "canonical_key"), "product_id")
    parts = linked.filter(key != "").select(
        "listing_id",
        F.regexp_replace(F.regexp_extract(key, r"^([a-z]+-?[0-9]+)", 1), "-", "").alias("code"),
        F.regexp_extract(key, r"[0-9]-([a-z]+)$", 1).alias("variant"),
    )
    return parts.withColumns({"doubt": F.lit(4).cast("long"), "place": F.lit(9000).cast("long")})


def _chosen_codes(codes: DataFrame) -> DataFrame:
    """One code and variant a listing.

    A reading is known if another listing has it without a blank or doubtful figure. Known readings go first, then those that come first
    in titles, then those that more listings have, that are less in doubt, and that more visits have.
    """
    known = codes.filter("doubt <= 1").groupBy("code").agg(F.countDistinct("listing_id").alias("seen"))
    read = codes.groupBy("listing_id", "code", "variant").agg(F.min("doubt").alias("doubt"), F.min("place").alias("place"), F.count(F.lit(1)).alias("times"))
    elsewhere = F.coalesce("seen", F.lit(0)) - (F.col("doubt") <= 1).cast("int")
    order = W.partitionBy("listing_id").orderBy(
        F.col("elsewhere") <= 0, "place", F.col("elsewhere").desc(), "doubt", F.col("times").desc(), "code", F.col("variant").desc()
    )
    ranked = read.join(known, "code", "left").withColumn("elsewhere", elsewhere).withColumn("nth", F.row_number().over(order))
    return ranked.filter("nth = 1").select("listing_id", "code", "variant")


def _main_quantities(quantities: DataFrame, products: DataFrame, reference: DataFrame) -> DataFrame:
    """The quantity by which sellers tell a category's items apart: the one that ends its product keys.

    A key's size has a common unit; of the quantities with that unit the one whose values agree with keys most often.
    """
    size = F.regexp_extract("canonical_key", r"\|([0-9]+)([a-z]+)$", 1).try_cast("long")
    unit = F.regexp_extract("canonical_key", r"\|([0-9]+)([a-z]+)$", 2)
    sizes = products.select(F.col("category_slug").alias("category"), unit.alias("common_unit"), size.alias("common_value")).filter("common_value IS NOT NULL")
    sizes = sizes.groupBy("category", "common_unit", "common_value").agg(F.count(F.lit(1)).alias("keys"))
    units = F.broadcast(reference.select("quantity", "common_unit").distinct())
    stated = quantities.groupBy("category", "quantity", "common_value").agg(F.count(F.lit(1)).alias("times")).join(units, "quantity")
    agreeing = stated.join(sizes, ["category", "common_unit", "common_value"]).groupBy("category", "quantity").agg(F.sum(F.least("times", "keys")).alias("weight"))
    best = W.partitionBy("category").orderBy(F.col("weight").desc(), "quantity")
    return agreeing.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("category", "quantity")


def _settled_sizes(values: DataFrame) -> DataFrame:
    """``category``, ``common_value`` and ``size``: the commonest value within ``SAME_SIZE``, larger first on ties."""
    counts = durable(values.groupBy("category", "common_value").agg(F.count(F.lit(1)).alias("times")).filter("common_value > 0"))
    step = F.floor(F.log("common_value") / SAME_SIZE)
    near = counts.select("category", F.col("common_value").alias("size"), F.col("times").alias("weight"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    close = F.abs(F.log(F.col("size") / F.col("common_value"))) <= SAME_SIZE
    best = W.partitionBy("category", "common_value").orderBy(F.col("weight").desc(), F.col("size").desc())
    return (
        counts.withColumn("step", step)
        .join(near, ["category", "step"])
        .filter(close)
        .withColumn("nth", F.row_number().over(best))
        .filter("nth = 1")
        .select("category", "common_value", "size")
    )


def _listing_sizes(visits: DataFrame, parsed: DataFrame, products: DataFrame, reference: DataFrame) -> DataFrame:
    """``listing_id`` and ``size``, the value of its category's main quantity that most of its visits state."""
    texts = visits.select("seq", F.concat_ws(" | ", "title", "description").alias("title"), "category_slug", "merchant_slug")
    quantities = common_quantities(parsed, texts, reference).select("seq", "quantity", "common_value")
    told = durable(quantities.join(visits.select("seq", "listing_id", F.col("category_slug").alias("category")), "seq"))
    main = broadcast_below(durable(_main_quantities(told, products, reference)), MAX_BROADCAST_ROWS)
    values = told.join(main, ["category", "quantity"])
    settled = broadcast_below(durable(_settled_sizes(values)), MAX_BROADCAST_ROWS)
    sized = values.join(settled, ["category", "common_value"]).groupBy("listing_id", "size").agg(F.count(F.lit(1)).alias("times"))
    order = W.partitionBy("listing_id").orderBy(F.col("times").desc(), "size")
    return sized.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("listing_id", "size")


def profiles(listing: DataFrame, raw: DataFrame, parsed: DataFrame, products: DataFrame, reference: DataFrame, brands: DataFrame) -> DataFrame:
    """A profile for each listing: ``listing_id``, ``category``, ``code``, ``variant``, ``size``, ``brand_id``.

    Visits belong to a listing by the address of its page. A listing without visits is judged by its own title, and its
    category and brand are those of the product it is linked to. What nothing tells is null ('' for the variant, which a
    base model lacks).
    """
    offers = listing.select(F.col("id").alias("listing_id"), page(F.col("url")).alias("page"), "title_on_merchant").filter(F.col("listing_id").isNotNull())
    columns = ["seq", "listing_id", "title", "description", "category_slug", "merchant_slug"]
    seen = raw.select("seq", page(F.col("url")).alias("page"), *columns[2:]).join(offers.select("page", "listing_id"), "page").select(*columns)
    pages = raw.select(page(F.col("url")).alias("page")).distinct()
    maker = (F.col("brand") if "brand" in products.columns else F.lit(None).cast("string")).alias("brand")
    links = listing.select(F.col("id").alias("listing_id"), "product_id").join(products.select(F.col("id").alias("product_id"), "category_slug", maker), "product_id", "left")
    unseen = durable(offers.join(pages, "page", "left_anti").join(links.groupBy("listing_id").agg(F.min("category_slug").alias("category_slug"), F.min("brand").alias("brand")), "listing_id", "left"))
    own_visit = unseen.select((-1 - F.col("listing_id")).alias("seq"), "listing_id", F.col("title_on_merchant").alias("title"), F.lit(None).cast("string").alias("description"), "category_slug", F.lit(None).cast("string").alias("merchant_slug"))
    visits = durable(seen.unionByName(own_visit))
    own = offers.select("listing_id", F.col("title_on_merchant").alias("title"), F.lit(None).cast("string").alias("description"))
    told = _codes(visits.select("listing_id", "title", "description").unionByName(own))
    codes = durable(told.unionByName(_key_codes(listing, products)))
    typed = visits.join(parsed.select("seq", "brand"), "seq").select("listing_id", "brand").unionByName(unseen.select("listing_id", "brand"))
    named = mapped_names(typed, "brand", brands).filter("brand_id > 0").groupBy("listing_id", "brand_id").agg(F.count(F.lit(1)).alias("times"))
    brand = named.groupBy("listing_id").agg(F.max_by("brand_id", F.struct("times", -F.col("brand_id"))).alias("brand_id"))
    category = visits.groupBy("listing_id").agg(F.mode("category_slug", True).alias("category"))
    return (
        offers.select("listing_id")
        .distinct()
        .join(_chosen_codes(codes), "listing_id", "left")
        .join(_listing_sizes(visits, parsed, products, reference), "listing_id", "left")
        .join(category, "listing_id", "left")
        .join(brand, "listing_id", "left")
        .fillna("", ["variant"])
    )


def _only_value(profiles: DataFrame, wanted: str, block: list[str]) -> DataFrame:
    """``profiles`` with an unknown ``wanted`` taken from the profiles of the block, if all that know it agree."""
    known = profiles.filter(F.col(wanted).isNotNull()).groupBy(*[F.col(c).alias(f"block_{c}") for c in block]).agg(F.min(wanted).alias("least"), F.max(wanted).alias("most"))
    agreed = known.filter("least = most").drop("most")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"block_{c}")) for c in block])
    open_ones = profiles.filter(F.col(wanted).isNull()).join(agreed, same, "left").withColumn(wanted, F.col("least")).select(*profiles.columns)
    return profiles.filter(F.col(wanted).isNotNull()).unionByName(open_ones)


def _one_sign_off(code: Column) -> Column:
    """The forms of a code with one sign left open: codes that differ in one sign share one."""
    return F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.concat(F.substring(code, F.lit(1), i - 1), F.lit("*"), F.substring(code, i + 1, F.length(code))))


def _renamed(profiles: DataFrame) -> DataFrame:
    """``profile`` and ``new_code`` for listings whose code no one else has, where the profiles of their brand, category,
    variant and size have one code alone that differs from it in one sign."""
    kind = ["brand_id", "category", "variant", "size"]
    held = profiles.groupBy("code", "variant").agg(F.sum("held").alias("block_held"))
    whole = profiles.filter("brand_id IS NOT NULL AND size IS NOT NULL").join(held, ["code", "variant"])
    lone = whole.filter("block_held = 1").select("profile", *kind, "code", F.explode(_one_sign_off(F.col("code"))).alias("form"))
    others = whole.filter("block_held > 1").select(*kind, F.col("code").alias("new_code"), F.explode(_one_sign_off(F.col("code"))).alias("form")).distinct()
    choices = lone.join(others, [*kind, "form"]).filter("code != new_code").groupBy("profile").agg(F.min("new_code").alias("new_code"), F.max("new_code").alias("last"))
    return choices.filter("new_code = last").select("profile", "new_code")


def merged_once(profiles: DataFrame) -> DataFrame:
    """One round: ``profile``, what it knows now, and ``into``, the profile that it is merged into (itself, mostly).

    Profiles of one code and variant are a block; they match unless category, brand or size contradict each other, and
    what a profile doesn't know it takes from those it matches if these agree. Then profiles whose code no one else has
    are blocked by what else they know. Profiles that have become equal are one.
    """
    richer = _only_value(profiles, "category", ["code", "variant"])
    richer = _only_value(richer, "brand_id", ["code", "variant", "category"])
    richer = durable(_only_value(richer, "size", ["code", "variant", "category", "brand_id"]))
    named = richer.join(_renamed(richer), "profile", "left").withColumn("code", F.coalesce("new_code", "code")).drop("new_code")
    # Equal ones are few at a time: profiles that were equal before are one already.
    return named.withColumn("into", F.min("profile").over(W.partitionBy(*ATTRIBUTES)))


def resolved(state: DataFrame) -> DataFrame:
    """``listing_id`` and ``item``: the profiles merged until none changes.

    ``state`` has listing_id and the attributes. Profiles without code stay alone; what stays unknown keeps a profile
    apart from those that know.
    """
    state = durable(state)
    coded = state.filter("code IS NOT NULL")
    profiles = durable(coded.groupBy(*ATTRIBUTES).agg(F.min("listing_id").alias("profile"), F.count(F.lit(1)).alias("held")))
    first = profiles.select(*[F.col(c).alias(f"profile_{c}") for c in ATTRIBUTES], "profile")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"profile_{c}")) for c in ATTRIBUTES])
    members = coded.join(first, same).select("listing_id", "profile")
    while True:
        judged = durable(merged_once(profiles))
        before = profiles.select(F.col("profile").alias("into"), *[F.col(c).alias(f"old_{c}") for c in ATTRIBUTES])
        following = durable(judged.groupBy(F.col("into").alias("profile"), *ATTRIBUTES).agg(F.sum("held").cast("long").alias("held")))
        settled = following.count() == profiles.count() and judged.join(before, "into").filter(" OR ".join(f"NOT ({c} <=> old_{c})" for c in ATTRIBUTES)).isEmpty()
        if settled:
            break
        moved = judged.filter("profile != into").select("profile", "into")
        members = durable(members.join(moved, "profile", "left").select("listing_id", F.coalesce("into", "profile").alias("profile")))
        profiles = following
    alone = state.filter("code IS NULL").select("listing_id", F.concat(F.lit("listing "), F.col("listing_id").cast("string")).alias("item"))
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("brand_id", "category", "code", "variant", "size")])
    return members.join(profiles.select("profile", name.alias("item")), "profile").select("listing_id", "item").unionByName(alone)


def same_items(listing: DataFrame, raw: DataFrame, parsed: DataFrame, products: DataFrame, reference: DataFrame, brands: DataFrame) -> DataFrame:
    """``listing_id`` and ``item`` for every listing; listings of one item share the value.

    Listings without visits are judged by their own title; those that tell no model stay alone. Null ids are left out,
    repeated rows count once. Null and empty texts tell nothing.
    """
    return resolved(profiles(listing, raw, parsed, products, reference, brands))


def pairs_of(items: DataFrame, hot_item: int = HOT_ITEM) -> DataFrame:
    """``listing_id_a`` < ``listing_id_b`` of each item, by an equi-join on the item.

    The listings of an item of more than ``hot_item`` are dealt to several places by hash; each place holds them against
    all of the item, in batches that stream by.
    """
    items = durable(items)
    hot = durable(items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_item).select("item", F.ceil(F.col("n") / F.lit(hot_item)).cast("int").alias("places")))
    a, b, by = items.select("item", F.col("listing_id").alias("listing_id_a")), items.select("item", F.col("listing_id").alias("listing_id_b")), ["item"]
    if not hot.isEmpty():
        a, b = (side.join(hot, "item", "left").fillna(1, ["places"]) for side in (a, b))
        a = a.withColumn("place", F.pmod(F.xxhash64("listing_id_a"), F.col("places")).cast("int"))
        b = b.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
        by = ["item", "place"]
    return a.join(b, by).filter("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")
