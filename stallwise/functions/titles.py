"""Free-text titles read into brand, specs and a canonical key, driven by one table of grammars.

A grammar says what a category's key is made of. The same table drives both sides: reading a title and composing a key
from structured pieces, so the two cannot drift apart. Everything is a column expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import first_within, short_number
from .text import clean_title, condition, slug

_N = r"([0-9]+(?:\.[0-9]+)?)"


@dataclass(frozen=True)
class Number:
    """The first number within bounds that a pattern finds."""

    pattern: str
    low: float
    high: float
    scale: float = 1.0


@dataclass(frozen=True)
class Grammar:
    """``key``: pieces in order, each a name and how it is written; ``needs``: pieces without which nothing is read."""

    key: tuple[tuple[str, str], ...]
    needs: tuple[str, ...] = ("brand",)
    any_of: tuple[str, ...] = ()
    words: Mapping[str, tuple[tuple[str, tuple[str, ...]], ...]] = field(default_factory=dict)
    numbers: Mapping[str, Number] = field(default_factory=dict)
    markers: tuple[str, ...] = ()
    vetoes: tuple[str, ...] = ()
    model: bool = False
    code: bool = False
    sizes: bool = False
    tail: bool = False
    fixed: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, str] = field(default_factory=dict)


def _w(**choices: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Names with their phrases, alternatives after a bar; a name's underscores are hyphens in the key."""
    return tuple((name.strip("_").replace("_", "-"), tuple(p.strip() for p in phrases.split("|"))) for name, phrases in choices.items())


LITRES = Number(rf"{_N}\s?(?:l|lt|ltr|ltrs|litres?|liters?)\b", 0.3, 900)
WATTS = Number(rf"{_N}\s?(?:w|watts?)\b", 5, 15_000)
INCHES = Number(rf"{_N}\s?(?:inch(?:es)?|in\b|\"|″|”)", 15, 120)
COVERS = ("case", "cover", "screen protector", "tempered glass", "charger", "cable", "pouch", "holder", "strap")
_COND = ("condition", "{}")
_SMALL = dict(needs=("brand", "type"), code=True)

# The categories, what their keys hold and the words that tell types apart.
GRAMMARS: dict[str, Grammar] = {
    "phones": Grammar((("brand", "{}"), ("model", "{}")), ("brand", "model"), vetoes=COVERS, model=True, sizes=True),
    "tablets": Grammar((("brand", "{}"), ("model", "{}"), ("inches", "{}in"), ("storage_gb", "{}gb"), ("ram_gb", "{}gb-ram")), ("brand", "model"), markers=("tablet", "tab", "pad", "ipad"), vetoes=COVERS, model=True, sizes=True, numbers={"inches": Number(INCHES.pattern, 5, 15)}),
    "laptops": Grammar((("brand", "{}"), ("model", "{}"), ("cpu", "{}"), ("ram_gb", "{}gb"), ("storage_gb", "{}gb"), ("disk", "{}"), _COND), ("brand", "model"), vetoes=("bag", "sleeve", "charger", "adapter", "stand", "keyboard for", "battery for"), model=True, sizes=True, words={"cpu": _w(i3="core i3| i3", i5="core i5| i5", i7="core i7| i7", i9="core i9| i9", ryzen_3="ryzen 3", ryzen_5="ryzen 5", ryzen_7="ryzen 7", celeron="celeron", m1=" m1", m2=" m2", m3=" m3"), "disk": _w(ssd="ssd|nvme", hdd="hdd|hard disk", emmc="emmc")}),
    "tvs": Grammar((("brand", "{}"), ("inches", "{}"), ("resolution", "{}"), ("panel", "{}"), ("smart", "{}"), _COND), ("brand", "inches"), vetoes=("mount", "bracket", "remote", "stand only", "tv box"), numbers={"inches": INCHES}, words={"resolution": _w(_8k="8k", _4k="4k|uhd|ultra hd", fhd="full hd|fhd|1080p"), "panel": _w(oled="oled", qled="qled", nanocell="nanocell", miniled="mini led|miniled"), "smart": _w(smart="smart|android|google tv|webos|tizen|vidaa")}, defaults={"smart": "basic"}),
    "refrigerators": Grammar((("brand", "{}"), ("litres", "{}l"), ("code", "{}"), ("doors", "{}"), _COND), ("brand", "litres"), vetoes=("fridge guard", "water filter"), code=True, numbers={"litres": Number(LITRES.pattern, 40, 900)}, words={"doors": _w(side_by_side="side by side|side-by-side", french_door="french door", double_door="double door|2 door|two door", single_door="single door|1 door")}),
    "washers-dryers": Grammar((("brand", "{}"), ("kg", "{}kg"), ("load", "{}"), ("automation", "{}"), ("dryer", "{}"), _COND), ("brand", "kg", "load"), numbers={"kg": Number(rf"{_N}\s?kgs?\b", 1, 25)}, words={"load": _w(twin_tub="twin tub|twin-tub", front_load="front load|front-load|frontload", top_load="top load|top-load|topload"), "automation": _w(semi_auto="semi auto|semi-auto|twin tub", auto="fully auto|automatic|full auto"), "dryer": _w(with_dryer="washer dryer|washer-dryer|with dryer|wash & dry")}),
    "cooking": Grammar((("brand", "{}"), ("type", "{}"), ("burners", "{}burner"), ("litres", "{}l"), ("fuel", "{}"), ("control", "{}"), _COND), ("brand", "type"), numbers={"burners": Number(r"([0-9])\s?(?:burners?|gas burner|plates?)", 1, 8), "litres": Number(LITRES.pattern, 5, 120)}, words={"type": _w(microwave="microwave", hood="hood|extractor", hob="hob|cooktop", air_fryer="air fryer|airfryer", oven="oven", cooker="cooker|cooking range|standing cooker"), "fuel": _w(induction="induction", gas_electric="gas + electric|gas+electric|3+1|2+2", gas="gas", electric="electric"), "control": _w(digital="digital", manual="manual|mechanical|knob")}),
    "audio": Grammar((("brand", "{}"), ("type", "{}"), ("code", "{}"), ("channels", "{}ch"), ("link", "{}"), _COND), ("brand", "type"), code=True, numbers={"channels": Number(r"\b([2-9]\.[0-9])\s?(?:ch\b|channel)?", 2, 9.9)}, words={"type": _w(soundbar="soundbar|sound bar", subwoofer="subwoofer|woofer", home_theatre="home theatre|home theater", party_speaker="party speaker|partybox", earbuds="earbuds|buds|airpods|earphones", headphones="headphones|headset", speaker="speaker"), "link": _w(wireless="wireless|bluetooth|tws", wired="wired|3.5mm")}),
    "cameras": Grammar((("brand", "{}"), ("type", "{}"), ("code", "{}"), ("resolution", "{}"), ("megapixels", "{}mp")), ("type",), any_of=("brand", "code", "resolution", "megapixels"), code=True, numbers={"megapixels": Number(rf"{_N}\s?mp\b", 1, 200)}, words={"type": _w(action="action cam|gopro|hero", dash="dash cam|dashcam", security="cctv|security camera|ip camera|bullet camera|dome camera", instant="instant camera|instax", mirrorless="mirrorless", dslr="dslr", camcorder="camcorder", webcam="webcam"), "resolution": _w(_8k="8k", _4k="4k", _2k="2k", _1080p="1080p|full hd", _720p="720p")}, defaults={"brand": "generic"}),
    "blenders": Grammar((("brand", "{}"), ("type", "{}"), ("code", "{}"), ("litres", "{}l"), ("material", "{}")), words={"type": _w(hand_blender="hand blender|stick blender", blender="blender|smoothie maker"), "material": _w(glass="glass", plastic="plastic", stainless="stainless|steel")}, numbers={"litres": Number(LITRES.pattern, 0.3, 5), "watts": Number(WATTS.pattern, 100, 3500)}, **_SMALL),
    "toasters": Grammar((("brand", "{}"), ("type", "{}"), ("code", "{}"), ("slots", "{}slot"), ("litres", "{}l")), words={"type": _w(toaster_oven="toaster oven|oven toaster", sandwich_maker="sandwich maker", toaster="toaster")}, numbers={"slots": Number(r"([2-6])\s?(?:slices?|slots?)", 2, 6), "litres": Number(LITRES.pattern, 5, 60), "watts": Number(WATTS.pattern, 100, 3500)}, **_SMALL),
    "kettles": Grammar((("brand", "{}"), ("type", "{}"), ("code", "{}"), ("litres", "{}l"), ("material", "{}")), words={"type": _w(kettle="kettle"), "material": _w(glass="glass", plastic="plastic", stainless="stainless|steel")}, numbers={"litres": Number(LITRES.pattern, 0.3, 5), "watts": Number(WATTS.pattern, 100, 3500)}, **_SMALL),
    "ironing-laundry": Grammar((("brand", "{}"), ("type", "{}"), ("code", "{}")), words={"type": _w(steam_iron="steam iron", garment_steamer="garment steamer|steamer", dry_iron="dry iron|flat iron", ironing_board="ironing board", iron="iron")}, numbers={"watts": Number(WATTS.pattern, 100, 3500)}, **_SMALL),
    "inverters": Grammar((("brand", "{}"), ("watts", "{}w"), ("topology", "{}")), ("brand", "watts"), vetoes=(" kit", "full system", "complete solar"), numbers={"watts": Number(WATTS.pattern, 50, 15_000), "kilowatts": Number(rf"{_N}\s?kw\b", 0.05, 15, 1000), "kva": Number(rf"{_N}\s?kva\b", 0.05, 19, 800)}, words={"topology": _w(hybrid="hybrid", pure_sine="pure sine|pure-sine", modified_sine="modified sine", grid_tie="grid tie|on-grid|on grid", off_grid="off grid|off-grid")}),
    "solar-panels": Grammar((("brand", "{}"), ("watts", "{}w"), ("cell", "{}")), ("brand", "watts"), vetoes=(" kit", "full system", "complete solar"), numbers={"watts": Number(WATTS.pattern, 5, 1000)}, words={"cell": _w(bifacial="bifacial", mono="mono", poly="poly")}),
    "solar-batteries": Grammar((("brand", "{}"), ("ah", "{}ah"), ("chemistry", "{}"), ("volts", "{}v")), ("brand",), any_of=("ah", "chemistry"), vetoes=(" kit", "full system", "complete solar"), numbers={"ah": Number(rf"{_N}\s?ah\b", 5, 1000), "volts": Number(rf"{_N}\s?v(?:dc|olts?)?\b", 2, 96)}, words={"chemistry": _w(lithium="lithium|lifepo4|li-ion", gel="gel", agm="agm", lead_acid="lead acid|lead-acid|tubular")}),
    "phone-tablet-accessories": Grammar((("brand", "{}"), ("type", "{}"), ("watts", "{}w"), ("mah", "{}mah"), ("variant", "{}"), ("code", "{}")), ("brand", "type"), any_of=("watts", "mah", "variant", "code"), code=True, numbers={"watts": Number(WATTS.pattern, 5, 240), "mah": Number(r"([0-9][0-9,]*)\s?mah\b", 1000, 50_000)}, words={"type": _w(power_bank="power bank|powerbank", charger="charger|adapter", cable="cable", smartwatch="smart watch|smartwatch|watch", stylus="pencil|stylus|s pen", case="case|cover"), "variant": _w(usb_c_lightning="usb-c to lightning|type-c to lightning", usb_c="usb-c|type-c|usb c", lightning="lightning", micro_usb="micro usb|micro-usb")}),
    "peripherals-accessories": Grammar((("brand", "{}"), ("type", "{}"), ("code", "{}"), ("link", "{}")), ("brand", "type"), any_of=("code", "link"), code=True, words={"type": _w(keyboard_mouse="keyboard and mouse|keyboard & mouse|combo", keyboard="keyboard", mouse="mouse", monitor="monitor", flash_disk="flash disk|flash drive|usb drive", hard_drive="external hard|hard drive|portable ssd", printer="printer", router="router"), "link": _w(wireless="wireless|bluetooth", wired="wired|usb")}),
    "console-accessories": Grammar((("brand", "{}"), ("type", "{}"), ("variant", "{}"), ("code", "{}")), ("brand", "type"), code=True, words={"type": _w(controller="controller|gamepad|dualsense|joy-con", headset="headset|headphone", charging_dock="charging dock|charging station", stand="stand", steering_wheel="steering wheel"), "variant": _w(ps5="ps5|playstation 5", ps4="ps4|playstation 4", xbox="xbox", switch="switch")}),
    "playstation-5": Grammar((("brand", "{}"), ("family", "{}"), ("revision", "{}"), ("edition", "{}"), ("storage_gb", "{}gb")), ("family",), sizes=True, fixed={"brand": "sony"}, vetoes=("controller", "headset", "stand", "game ", "games", "cable", "cover", "ps4", "ps3", "xbox", "switch", "retro"), words={"family": _w(ps5="ps5|playstation 5|playstation5"), "revision": _w(pro=" pro", slim="slim"), "edition": _w(digital="digital", disc="disc|disk|standard")}),
    "xbox-series": Grammar((("brand", "{}"), ("family", "{}"), ("storage_gb", "{}gb")), ("family",), sizes=True, fixed={"brand": "microsoft"}, vetoes=("controller", "headset", "game ", "games", "cable", "ps5", "playstation", "switch", "retro"), words={"family": _w(series_x="series x", series_s="series s")}),
    "nintendo-switch": Grammar((("brand", "{}"), ("family", "{}")), ("family",), fixed={"brand": "nintendo"}, vetoes=("game ", "games", "case", "ps5", "xbox", "retro", "light switch"), words={"family": _w(switch_2="switch 2", switch_oled="oled", switch_lite="switch lite", switch="switch console|nintendo switch|joy-con")}),
    "dishwashers": Grammar((("brand", "{}"), ("type", "{}"), ("config", "{}"), ("settings", "{}ps"), _COND), ("brand", "type"), numbers={"settings": Number(r"([0-9]+)\s?(?:place|settings?)", 4, 20)}, words={"type": _w(dishwasher="dishwasher|dish washer"), "config": _w(built_in="built-in|built in|integrated", tabletop="tabletop|countertop", freestanding="freestanding|free standing")}),
    "coffee-machines": Grammar((("brand", "{}"), ("type", "{}"), ("cups", "{}cups"), ("ml", "{}ml"), ("watts", "{}w"), ("tail", "{}")), ("brand", "type"), tail=True, numbers={"cups": Number(r"([0-9]+)\s?cups?", 1, 20), "ml": Number(rf"{_N}\s?ml\b", 100, 3000), "watts": Number(WATTS.pattern, 100, 3500)}, words={"type": _w(espresso="espresso", capsule="capsule|nespresso|pod", french_press="french press", grinder="grinder", drip="drip|filter coffee|coffee maker|coffee machine")}),
    "freezers": Grammar((("brand", "{}"), ("litres", "{}l"), ("config", "{}"), _COND), ("brand", "litres"), numbers={"litres": Number(LITRES.pattern, 40, 900)}, words={"config": _w(chest="chest", upright="upright")}),
    "water-dispensers": Grammar((("brand", "{}"), ("type", "{}"), ("taps", "{}taps"), ("loading", "{}"), _COND), ("brand", "type"), numbers={"taps": Number(r"([1-5])\s?taps?", 1, 5)}, words={"type": _w(dispenser="dispenser|water cooler"), "loading": _w(bottom_load="bottom load|bottom-load", top_load="top load|top-load")}),
} | {
    leaf: Grammar((("brand", "{}"), ("leaf", "{}"), ("cm", "{}cm"), ("mm", "{}mm"), ("tail", "{}"), _COND), ("brand", "type"), tail=True, fixed={"leaf": leaf}, numbers={"cm": Number(rf"{_N}\s?cm\b", 20, 300), "mm": Number(rf"{_N}\s?mm\b", 5, 100)}, words={"type": _w(**{leaf.replace("-", "_"): phrases})})
    for leaf, phrases in {
        "kitchen-sinks-taps": "sink|tap|faucet|mixer",
        "countertops": "countertop|worktop|granite|quartz",
        "splashbacks": "splashback|backsplash",
        "kitchen-hardware": "hinge|handle|drawer|rail|basket",
        "utensils": "pan|pot|sufuria|knife|spoon|cookware",
        "toilets": "toilet|water closet|wc |cistern",
    }.items()
}
STORAGE, RAM = (16, 8192), (1, 128)


def first_phrase(cleaned: Column, choices: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first name of which any phrase is in the text."""
    found = F.lit(None).cast("string")
    for name, phrases in reversed(choices):
        held = F.lit(False)
        for phrase in phrases:
            held = held | cleaned.contains(phrase)
        found = F.when(held, F.lit(name)).otherwise(found)
    return found


def find_brand(cleaned: Column, brands: Sequence[str]) -> Column:
    """A brand of several words if the text holds it, else the first word that is a brand."""
    compound = first_phrase(cleaned, [(slug_text(b), (b.lower(),)) for b in brands if " " in b])
    single = F.array(*[F.lit(b.lower()) for b in brands if " " not in b]) if any(" " not in b for b in brands) else F.array().cast("array<string>")
    return F.coalesce(compound, F.get(F.filter(F.split(cleaned, "[^a-z0-9&+]+"), lambda t: F.array_contains(single, t)), F.lit(0)))


def slug_text(text: str) -> str:
    return "-".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def sizes_of(cleaned: Column) -> tuple[Column, Column]:
    """(storage, memory) in GB: a pair joined by + or /, else the largest plausible size and the smallest."""
    number = r"(?<![.0-9a-z])([0-9]+)\s?(?:gb|g)?\s?[+/]\s?([0-9]+)\s?gb"
    pair = F.transform(F.array(F.regexp_extract(cleaned, number, 1), F.regexp_extract(cleaned, number, 2)), lambda x: x.try_cast("int"))
    one = lambda unit: F.transform(F.regexp_extract_all(cleaned, F.lit(rf"([0-9]+)\s?{unit}\b"), F.lit(1)), lambda x: x.try_cast("int"))
    all_sizes = F.concat(one("gb"), F.transform(one("tb"), lambda t: t * 1024))
    storage = F.array_max(F.filter(all_sizes, lambda x: x.between(*STORAGE)))
    ram = F.array_min(F.filter(all_sizes, lambda x: x.between(*RAM)))
    paired = F.get(pair, F.lit(1)).isNotNull() & F.get(pair, F.lit(0)).isNotNull()
    storage = F.when(paired, F.array_max(pair)).otherwise(storage)
    return storage, F.when(paired, F.array_min(pair)).when(ram < storage, ram)


def model_code(cleaned: Column, brand: Column) -> Column:
    """The first word of letters and figures that isn't a size: three signs or more, hyphens squeezed."""
    without = F.replace(cleaned, F.coalesce(brand, F.lit(" ")), F.lit(" "))
    size = r"^[0-9.]+(gb|tb|mb|mah|ah|w|kw|kva|v|l|ml|kg|g|cm|mm|mp|hz|in|k|p|ch|pcs)$|^(4k|8k|1080p|720p|usb[0-9.]*)$"
    words = F.filter(F.regexp_extract_all(without, F.lit(r"[a-z0-9][a-z0-9-]+"), F.lit(0)), lambda t: t.rlike("[a-z]") & t.rlike("[0-9]") & ~t.rlike(size) & (F.length(t) >= 3) & ~t.rlike("^[a-z]{4,}[0-9]$"))
    return F.replace(F.get(words, F.lit(0)), F.lit("-"), F.lit(""))


def model_words(cleaned: Column, brand: Column) -> Column:
    """The words after the brand up to a size, a colour or a selling word; a + after a word is plus."""
    plus = F.regexp_replace(cleaned, r"([a-z0-9])\+(?![0-9])", "$1 plus")
    after = F.regexp_replace(plus, F.concat(F.lit(r"^.*?\b\Q"), brand, F.lit(r"\E\b")), "")
    stop = r"\b([0-9]+\s?(gb|tb|mb|mah|mp|inch|in|w|hz)\b|[0-9]+\s?[+/]\s?[0-9]+|dual|single|smartphone|phone|laptop|notebook|tablet|with|new|refurbished|used|original|free|black|white|blue|red|green|gold|silver|grey|gray|4g|5g|intel|core|ryzen)|[(,|]"
    head = F.get(F.split(after, stop), F.lit(0))
    return F.nullif(slug(F.substring(head, 1, 40)), F.lit(""))


def compose_key(leaf: str, pieces: Mapping[str, Column]) -> Column:
    """The key of a category from its pieces; null if a needed one is missing. A new item's condition isn't written."""
    g = GRAMMARS[leaf]
    have = {**{n: F.lit(v) for n, v in g.fixed.items()}, **pieces}
    value = lambda n: F.coalesce(have.get(n, F.lit(None)), F.lit(g.defaults[n])) if n in g.defaults else have.get(n, F.lit(None))
    parts = []
    for name, shape in g.key:
        text = value(name).cast("string")
        text = F.nullif(F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-"), F.lit(""))
        text = F.when(text != "new", text) if name == "condition" else text
        before, after = shape.split("{}")
        parts.append(F.when(text.isNotNull(), F.concat(F.lit(before), text, F.lit(after))))
    complete = F.lit(True)
    for name in g.needs:
        complete = complete & have.get(name, F.lit(None)).isNotNull()
    if g.any_of:
        some = F.lit(False)
        for name in g.any_of:
            some = some | have.get(name, F.lit(None)).isNotNull()
        complete = complete & some
    return F.when(complete, F.concat_ws("|", *parts))


def composed(leaf: str, pieces: Column) -> Column:
    """The key from pieces in JSON."""
    names = {n for n, _ in GRAMMARS[leaf].key} | set(GRAMMARS[leaf].needs) | set(GRAMMARS[leaf].any_of)
    return compose_key(leaf, {n: F.get_json_object(pieces, f"$.{n}") for n in names if n not in GRAMMARS[leaf].fixed})


def with_parsed(df: DataFrame, leaf: str, title: str, brands: Sequence[str], description: str | None = None) -> DataFrame:
    """``df`` with ``parsed``, a struct of brand, model, canonical_key, specs (a map of texts) and display_title.

    All of it is null if the title can't be read as the category's. Built in steps, so that what several pieces need is
    computed once. Only phones look at the description, for sizes.
    """
    g = GRAMMARS[leaf]
    mine = lambda n: f"__{n}"
    text = df.withColumn(mine("text"), F.coalesce(clean_title(F.col(title)), F.lit("")))
    text = text.withColumn(mine("brand"), F.lit(g.fixed["brand"]) if "brand" in g.fixed else find_brand(F.col(mine("text")), brands))
    cleaned, brand = F.col(mine("text")), F.col(mine("brand"))
    pieces: dict[str, Column] = {"condition": condition(cleaned)}
    pieces |= {name: first_phrase(cleaned, choices) for name, choices in g.words.items()}
    numbers = {name: first_within(cleaned, n.pattern, n.low, n.high) * n.scale for name, n in g.numbers.items()}
    if "kilowatts" in numbers:
        numbers["watts"] = F.coalesce(numbers["kilowatts"], numbers["kva"], numbers["watts"])
    pieces |= {name: short_number(n) for name, n in numbers.items()}
    if g.sizes:
        sized = F.concat_ws(" ", cleaned, clean_title(F.col(description))) if description and leaf == "phones" else cleaned
        storage, ram = sizes_of(sized)
        pieces |= {"storage_gb": storage.cast("string"), "ram_gb": ram.cast("string")}
    if g.model:
        pieces["model"] = model_words(cleaned, brand)
    if g.code:
        pieces["code"] = model_code(cleaned, brand)
    if g.tail:
        pieces["tail"] = F.nullif(F.substring(slug(F.replace(cleaned, F.coalesce(brand, F.lit(" ")), F.lit(" "))), 1, 40), F.lit(""))
    text = text.withColumn(mine("pieces"), F.struct(brand.alias("brand"), *[c.alias(n) for n, c in pieces.items()]))
    have = {n: F.col(f"{mine('pieces')}.{n}") for n in ("brand", *pieces)}
    refused = F.exists(F.array(*[F.lit(v) for v in g.vetoes]), lambda v: cleaned.contains(v)) if g.vetoes else F.lit(False)
    if leaf == "phones":
        refused = refused & have["storage_gb"].isNull() & have["ram_gb"].isNull()  # an accessory has neither
    if g.markers:
        refused = refused | ~F.exists(F.array(*[F.lit(m) for m in g.markers]), lambda m: cleaned.contains(m))
    if leaf == "cooking":  # a cooker or hob is told by its burners, an oven by its room
        bare = (have["type"].isin("cooker", "hob") & have["burners"].isNull()) | (have["type"].isin("oven", "microwave") & have["litres"].isNull())
        refused = refused | F.coalesce(bare, F.lit(False))
    text = text.withColumn(mine("key"), F.when(~refused, compose_key(leaf, have)))
    key = F.col(mine("key"))
    kept = [n for n in pieces if n not in ("model", "tail")]
    specs = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in kept]), F.array(*[have[n] for n in kept])), lambda _, v: v.isNotNull())
    named = [have[n] for n in ("model", "code", "type", "family") if n in have]
    parsed = F.struct(
        have["brand"].alias("brand"),
        (F.coalesce(*named) if named else F.lit(None).cast("string")).alias("model"),
        key.alias("canonical_key"),
        specs.alias("specs"),
        F.initcap(F.regexp_replace(key, "[|-]", " ")).alias("display_title"),
    )
    return text.withColumn("parsed", F.when(key.isNotNull(), parsed)).drop(*[mine(n) for n in ("text", "brand", "pieces", "key")])


def parsed_offers(df: DataFrame, title: str, leaves: Sequence[str], brands: Sequence[str], description: str | None = None, category: str = "category_slug") -> DataFrame:
    """The rows of the given categories, each with ``parsed`` as its category's grammar reads the title.

    A category is a filter that reaches the scan; tables partitioned by category are read once.
    """
    parts = [with_parsed(df.filter(F.col(category) == leaf), leaf, title, brands, description) for leaf in leaves]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
