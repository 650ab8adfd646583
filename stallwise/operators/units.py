"""Quantities stated in free notation, converted to the common unit of a reference table.

The steps are relational: extract number and unit by pattern, normalise the unit's spelling by a join with the aliases,
coalesce the unit in the value's text, the unit in the field's name and the usual unit of the source, then apply factor
and offset. As an extension, a unit that only a field's name gives, or that is missing, is held against what rows of the
same category state in words: a figure of 6.8 under ``screen_mm`` is 6.8 inches where phones are known to have 173 mm,
not 7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable
from .sizes import broadcast_below

# Spellings of the units, each with the symbol of the reference table.
UNIT_ALIASES = {
    "gb": "gb gig gigs gigabyte gigabytes",
    "tb": "tb terabyte terabytes",
    "mb": "mb megabyte megabytes",
    "mm": "mm mms millimetre millimetres millimeter millimeters",
    "cm": "cm cms centimetre centimetres centimeter centimeters",
    "in": "in inch inches \" ″ ” '' ins",
    "m": "m mtr mtrs metre metres meter meters",
    "ft": "ft feet foot",
    "ml": "ml mls millilitre millilitres milliliter milliliters cc",
    "l": "l lt lts ltr ltrs litre litres liter liters",
    "cuft": "cuft cu.ft cu.ft. ft3 ft³ cubicfeet cubicfoot",
    "gal": "gal gals gallon gallons",
    "g": "g gm gms gram grams gramme grammes",
    "kg": "kg kgs kilo kilos kilogram kilograms",
    "lb": "lb lbs pound pounds",
    "oz": "oz ozs ounce ounces",
    "w": "w watt watts",
    "kw": "kw kilowatt kilowatts",
    "hp": "hp horsepower",
    "mah": "mah milliamphour milliamphours",
    "ah": "ah amphour amphours",
    "wh": "wh watthour watthours",
    "kwh": "kwh kilowatthour kilowatthours",
}
# Words beside a data size, each with the quantity it shows.
SIZE_WORDS = {"ram": "ram", "memory": "ram", "rom": "storage", "storage": "storage", "ssd": "storage", "hdd": "storage", "internal": "storage", "emmc": "storage", "disk": "storage"}

NUMBER = r"\d+(?:[.,]\d+)*"
#: A specs entry in JSON or a sloppier notation: the name, then a quoted text or a bare value.
ENTRY = r"""["']?([A-Za-z][A-Za-z0-9_ ]*)["']?\s*[:=]\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^,;{}"'\s][^,;{}"']*)"""
MARK = "\u0001"  #: parts groups; no title holds it
#: Widths of the value bins and their reach, in logarithms: values within about 1 % support each other.
BIN, REACH = 0.005, 2
#: Stated values are at most this many bins for every category and quantity, so the table is small; above, it isn't broadcast.
MAX_BROADCAST_ROWS = 200_000


def _spellings() -> list[str]:
    words = {w for line in UNIT_ALIASES.values() for w in line.split()}
    return sorted(words, key=lambda w: (-len(w), w))


def _quote(word: str) -> str:
    return "".join(rf"\{c}" if c in ".+*?()[]{}|^$" else c for c in word)


def _unit_pattern() -> str:
    """Any spelling, longest first; inner spaces and hyphens of the compound ones are free."""
    loose = {"cubicfeet": r"cubic[\s-]*feet", "cubicfoot": r"cubic[\s-]*foot", "cuft": r"cu\.?[\s-]*ft\.?", "watthours": r"watt[\s-]*hours", "watthour": r"watt[\s-]*hour"}
    return "|".join(loose.get(w, _quote(w)) for w in _spellings())


def mention_pattern() -> str:
    """A number with its unit. Groups: word before, number without a unit of its own (as in 8/256GB), number, unit, word after."""
    words = "|".join(SIZE_WORDS)
    return (
        rf"(?iu)(?<![\p{{L}}\p{{N}}.,])(?:({words})[\s:]+)?(?:({NUMBER})(?:[+/]|\s+[+/]\s+)(?={NUMBER}\s*(?:gb|tb|mb)\b))?"
        rf"({NUMBER})[\s-]*({_unit_pattern()})(?![\p{{L}}\p{{N}}])(?:[\s-]+({words})\b)?"
    )


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The pattern's groups in a text that it matches as a whole, from one evaluation; '' for groups without part in it."""
    return F.split(F.regexp_replace(text, pattern, MARK.join(f"${i}" for i in range(1, n + 1))), MARK)


def parse_number(text: Column) -> Column:
    """DOUBLE of a number with decimal point or comma, or with thousands marks; null if it is none.

    The later of two kinds of mark is the decimal one. Commas before groups of exactly three digits mark thousands,
    except after a leading zero; every other comma, and a single point, is a decimal mark.
    """
    plain = F.trim(text)
    thousands = plain.rlike(r"^[1-9]\d{0,2}(,\d{3})+(\.\d+)?$")
    points = plain.rlike(r"^\d{1,3}(\.\d{3})+,\d+$") | plain.rlike(r"^\d{1,3}(\.\d{3}){2,}$")
    cleaned = (
        F.when(thousands, F.regexp_replace(plain, ",", ""))
        .when(points, F.regexp_replace(F.regexp_replace(plain, r"\.", ""), ",", "."))
        .otherwise(F.regexp_replace(plain, ",", "."))
    )
    return cleaned.try_cast("double")


def alias_rows() -> list[tuple[str, str]]:
    """(spelling, symbol) of every unit, spellings without blanks and hyphens."""
    return [(word, symbol) for symbol, line in UNIT_ALIASES.items() for word in line.split()]


def _with_symbol(df: DataFrame, text: str, symbol: str, how: str = "left") -> DataFrame:
    """``df`` with the reference symbol of the spelling in the column ``text``, by a join with the table of aliases."""
    aliases = F.broadcast(df.sparkSession.createDataFrame(alias_rows(), f"alias_key string, {symbol} string"))  # of fixed size
    return df.withColumn("alias_key", F.regexp_replace(F.lower(F.trim(text)), r"[\s-]", "")).join(aliases, "alias_key", how).drop("alias_key")


def spec_mentions(df: DataFrame, reference: DataFrame) -> DataFrame:
    """One row for each entry of ``specs`` that names a quantity: figure, the text's unit and the name's unit."""
    listed = F.transform(F.regexp_extract_all("specs", F.lit(ENTRY), F.lit(0)), lambda entry: _groups(entry, ENTRY, 2))
    entries = df.filter(F.col("specs").isNotNull()).select("seq", "category", "source", F.posexplode(listed).alias("place", "parts"))
    name, value = F.regexp_replace(F.lower(F.trim(F.col("parts")[0])), " ", "_"), F.col("parts")[1]
    quoted = value.rlike(r"""^["']""")
    inner = F.when(quoted, F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"\\(.)", "$1")).otherwise(F.trim(value))
    stated = rf"^\s*({NUMBER})[\s-]*(\D*?)\s*$"
    # Each explode of one struct keeps its expressions from being computed again by filters pushed below them.
    read = F.struct(F.regexp_replace(name, r"_[a-z]+$", "").alias("quantity"), F.regexp_extract(name, r"_([a-z]+)$", 1).alias("suffix"), quoted.alias("quoted"), inner.alias("inner"))
    rows = entries.select("seq", "category", "source", "place", F.explode(F.array(read)).alias("e")).select("seq", "category", "source", "place", "e.*")
    rows = rows.join(F.broadcast(reference.select("quantity").distinct()), "quantity", "left_semi")  # a table of units
    parts = _groups(F.col("inner"), stated, 2)
    split = rows.select("seq", "category", "source", "place", "quantity", "suffix", "quoted", F.explode(F.array(parts)).alias("stated"))
    named = split.select(
        "seq", "category", "source", "place", "quantity", "suffix", "quoted", parse_number(F.get("stated", F.lit(0))).alias("figure"), F.get("stated", F.lit(1)).alias("unit_text")
    ).filter(F.col("unit_text").isNotNull() & (F.col("figure") > 0))
    return _with_symbol(_with_symbol(named, "unit_text", "text_unit"), "suffix", "name_unit").select(
        "seq", "category", "source", "place", "quantity", "figure", "text_unit", "name_unit", (~F.col("quoted") & (F.col("unit_text") == "")).alias("plain")
    )


def title_mentions(df: DataFrame) -> DataFrame:
    """Each number with a unit in the title, in text order, with the words beside data sizes."""
    found = df.filter(F.col("title").isNotNull()).select("seq", "category", "source", F.posexplode(F.regexp_extract_all("title", F.lit(mention_pattern()), F.lit(0))).alias("place", "whole"))
    network = F.col("whole").rlike(r"^[2-6]G$")  # a mobile network's generation, not grams
    parts = _groups(F.col("whole"), mention_pattern(), 5)
    split = found.filter(~network).select("seq", "category", "source", "place", parts.alias("parts"))
    split = split.select("seq", "category", "source", "place", *[F.col("parts")[i].alias(n) for i, n in enumerate(("before", "bare", "number", "unit", "after"))])
    each = F.array(F.struct(F.col("number").alias("n"), F.lit(0).alias("k")), F.struct(F.col("bare").alias("n"), F.lit(1).alias("k")))
    word = F.create_map(*[F.lit(x) for p in SIZE_WORDS.items() for x in p])
    hint = F.coalesce(word[F.lower(F.col("before"))], word[F.lower(F.col("after"))])
    numbers = split.select("seq", "category", "source", "place", "unit", hint.alias("hint"), F.explode(each).alias("e")).filter("e.n != ''")
    read = numbers.select(
        "seq", "category", "source", (F.col("place") * 2 + F.col("e.k")).alias("place"), parse_number(F.col("e.n")).alias("figure"), "unit", F.when(F.col("e.k") == 0, F.col("hint")).alias("hint")
    )
    return _with_symbol(read.filter(F.col("figure").isNotNull()), "unit", "text_unit", "inner").drop("unit")


def _in_common() -> Column:
    return F.col("figure") * F.col("factor_to_common") + F.col("offset_to_common")


def _bin(value: Column) -> Column:
    return F.round(F.log(value) / BIN).cast("int")


def _title_quantities(titles: DataFrame, specs: DataFrame, reference: DataFrame, known: DataFrame) -> DataFrame:
    """Title mentions with the quantity each states.

    Data sizes: by the word beside them; of several without a word the smallest is memory and the rest storage; a single
    one is what the title lacks, or what the category knows such a size to be. Lengths and screens: whichever the
    category's specs name more often. Every other unit belongs to one quantity.
    """
    sized = titles.join(F.broadcast(reference.withColumnRenamed("unit_symbol", "text_unit").drop("common_unit")), "text_unit")
    sized = durable(sized.withColumn("common", _in_common()).filter(F.col("common") > 0).drop("factor_to_common", "offset_to_common"))
    data, others = sized.filter(F.col("quantity").isin("ram", "storage")), sized.filter(~F.col("quantity").isin("ram", "storage"))
    named = broadcast_below(durable(specs.groupBy("category", "quantity").agg(F.count(F.lit(1)).alias("named"))), MAX_BROADCAST_ROWS)
    most = W.partitionBy("seq", "place").orderBy(F.col("named").desc_nulls_last(), "quantity")
    others = others.join(named, ["category", "quantity"], "left").withColumn("nth", F.row_number().over(most)).filter("nth = 1").drop("nth", "named")
    support = known.filter(F.col("quantity").isin("ram", "storage"))
    scored = data.withColumn("bin", _bin(F.col("common"))).join(support, ["category", "quantity", "bin"], "left")
    one = scored.groupBy("seq", "place").agg(
        F.first("category").alias("category"),
        F.first("source").alias("source"),
        F.first("figure").alias("figure"),
        F.first("text_unit").alias("text_unit"),
        F.first("hint").alias("hint"),
        F.first("common").alias("common"),
        F.max(F.when(F.col("quantity") == "ram", F.col("seen"))).alias("as_ram"),
        F.max(F.when(F.col("quantity") == "storage", F.col("seen"))).alias("as_storage"),
    )
    title = W.partitionBy("seq")
    open_size = F.when(F.col("hint").isNull(), F.col("common"))
    has = {q: F.max((F.col("hint") == q).cast("int")).over(title) == 1 for q in ("ram", "storage")}
    one = one.withColumns({"least": F.min(open_size).over(title), "most": F.max(open_size).over(title)} | {f"has_{q}": F.coalesce(c, F.lit(False)) for q, c in has.items()})
    likelier = F.coalesce("as_ram", F.lit(0)) > F.coalesce("as_storage", F.lit(0))
    several = F.col("least") < F.col("most")
    quantity = (
        F.when(F.col("hint").isNotNull(), F.col("hint"))
        .when(F.col("has_ram") & ~F.col("has_storage"), "storage")
        .when(F.col("has_storage") & ~F.col("has_ram"), "ram")
        .when(several, F.when(F.col("common") == F.col("least"), "ram").otherwise("storage"))
        .when(F.coalesce("as_ram", "as_storage").isNull(), F.when(F.col("common") < 16, "ram").otherwise("storage"))
        .otherwise(F.when(likelier, "ram").otherwise("storage"))
    )
    columns = ["seq", "category", "source", "place", "figure", "text_unit", "common"]
    return others.select(*columns, "quantity", F.lit(True).alias("sure")).unionByName(
        one.select(*columns, quantity.alias("quantity"), F.col("hint").isNotNull().alias("sure"))
    )


def _known_values(stated: DataFrame) -> DataFrame:
    """How often each category states about this value of a quantity: category, quantity, bin, ``seen``."""
    counts = stated.filter(F.col("common") > 0).groupBy("category", "quantity", _bin(F.col("common")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    near = F.explode(F.sequence(F.col("at") - REACH, F.col("at") + REACH)).alias("bin")
    return durable(counts.select("category", "quantity", "n", near).groupBy("category", "quantity", "bin").agg(F.sum("n").alias("seen")))


def common_quantities(parsed: DataFrame, raw: DataFrame, reference: DataFrame) -> DataFrame:
    """Every quantity that specs or title state: ``seq``, ``quantity``, ``common_value`` (BIGINT) and ``in_order``.

    ``parsed`` has ``seq`` and ``specs``; ``raw`` has ``seq``, ``title``, ``category_slug`` and ``merchant_slug``;
    ``reference`` has the units with their factors, perhaps offsets (``offset_to_common``), and is small. The figure in specs counts, else the title's first.
    ``in_order`` says that specs hold the value as a plain number under ``<quantity>_<common unit>``. Entries without a
    number, with a number of no known unit or quantity, and figures of zero give no row. A seq in only one of the tables
    is taken from that; of repeated seqs one row comes out. Null or empty specs and titles state nothing.
    """
    offset = F.col("offset_to_common") if "offset_to_common" in reference.columns else F.lit(0.0)
    units = reference.select("quantity", "unit_symbol", "factor_to_common", "common_unit", F.coalesce(offset, F.lit(0.0)).alias("offset_to_common")).dropDuplicates(["quantity", "unit_symbol"])
    offers = raw.filter(F.col("seq").isNotNull()).select("seq", "title", F.coalesce("category_slug", F.lit("")).alias("category"), F.coalesce("merchant_slug", F.lit("")).alias("source"))
    fields = parsed.filter(F.col("seq").isNotNull() & F.col("specs").isNotNull()).select("seq", "specs").join(offers.drop("title"), "seq", "left").fillna("", ["category", "source"])
    specs = durable(spec_mentions(fields, units))
    factor = F.broadcast(units.select("quantity", F.col("unit_symbol").alias("stated_unit"), "factor_to_common", "offset_to_common"))
    in_words = (
        specs.withColumn("stated_unit", F.coalesce("text_unit", "name_unit"))
        .join(F.broadcast(units.select("quantity", "common_unit").distinct()), "quantity")
        .filter(F.col("text_unit").isNotNull() | (F.col("name_unit") != F.col("common_unit")))
        .join(factor, ["quantity", "stated_unit"])
        .withColumn("common", _in_common())
    )
    first_known = broadcast_below(_known_values(in_words), MAX_BROADCAST_ROWS)
    titled = durable(_title_quantities(title_mentions(offers), specs, units, first_known))
    stated = in_words.select("category", "quantity", "common").unionByName(titled.filter("sure").select("category", "quantity", "common"))
    known = broadcast_below(_known_values(stated), MAX_BROADCAST_ROWS)
    habit = in_words.select("source", "quantity", "stated_unit").unionByName(titled.select("source", "quantity", F.col("text_unit").alias("stated_unit")))
    usual = broadcast_below(durable(habit.groupBy("source", "quantity", F.col("stated_unit").alias("unit_symbol")).agg(F.count(F.lit(1)).alias("used"))), MAX_BROADCAST_ROWS)

    merged = specs.select(
        "seq", "quantity", "category", "source", "figure", "text_unit", "name_unit", "plain", F.col("place"), F.lit(None).cast("double").alias("common")
    ).unionByName(titled.select("seq", "quantity", "category", "source", "place", "common"), allowMissingColumns=True)
    from_specs = F.col("figure").isNotNull()
    held = F.struct("category", "source", "figure", "text_unit", "name_unit", "plain")
    cases = (
        merged.join(F.broadcast(units.select("quantity", "common_unit").distinct()), "quantity")
        .groupBy("seq", "quantity")
        .agg(
            F.min_by(held, F.when(from_specs, F.struct(~(F.col("plain") & (F.coalesce("name_unit", F.lit("")) == F.col("common_unit"))), F.col("place")))).alias("held"),
            F.min_by("common", F.when(~from_specs, F.col("place"))).alias("in_title"),
        )
        .select("seq", "quantity", "in_title", "held.*")
    )
    choices = cases.join(F.broadcast(units), "quantity").withColumn("value", _in_common())
    choices = choices.withColumn("bin", F.when(F.col("value") > 0, _bin(F.col("value")))).join(known, ["category", "quantity", "bin"], "left").join(usual, ["source", "quantity", "unit_symbol"], "left")
    seen, named = F.coalesce("seen", F.lit(0)), F.coalesce(F.col("unit_symbol") == F.col("name_unit"), F.lit(False))
    agrees = F.coalesce(F.abs(F.log(F.col("value") / F.col("in_title"))) < 0.015, F.lit(False))
    rank = F.struct(
        F.coalesce(F.col("unit_symbol") == F.col("text_unit"), F.lit(False)),
        (seen > 0) & named,
        agrees,
        seen,
        named,
        F.coalesce("used", F.lit(0)),
        -F.col("factor_to_common"),
    )
    best = F.struct("unit_symbol", "common_unit", "value", "in_title", "name_unit", "plain", "figure")
    chosen = choices.groupBy("seq", "quantity").agg(F.max_by(best, rank).alias("best")).select("seq", "quantity", "best.*")
    value = F.when(F.col("figure").isNotNull(), F.col("value")).otherwise(F.col("in_title"))
    in_order = F.col("plain") & (F.col("name_unit") == F.col("common_unit")) & (F.col("unit_symbol") == F.col("common_unit"))
    return chosen.select("seq", "quantity", F.floor(value + 0.5).alias("common_value"), F.coalesce(in_order, F.lit(False)).alias("in_order")).filter(
        F.col("common_value").isNotNull()
    )
