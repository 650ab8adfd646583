"""Offers in web pages landed as text."""

from __future__ import annotations

import html
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_unescape

# Elements that have no end.
VOID = set("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Cards:
    """Where a page keeps its offers: each as an element's class, or a class with an attribute after ``@``."""

    card: str
    title: str
    price: str
    link: str = "@href"
    image: str = "@src"
    sold_out: str = ""


class _Tree(HTMLParser):
    """A tolerant tree: elements left open are closed by their parent's end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: dict = {"tag": "", "at": {}, "below": []}
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = {"tag": tag, "at": {k: v or "" for k, v in attrs}, "below": []}
        self.open[-1]["below"].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1]["below"].append(data)


def _walk(node: dict) -> Iterator[dict]:
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack += [b for b in reversed(at["below"]) if isinstance(b, dict)]


def _text(node: dict) -> str:
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            stack += reversed(at["below"])
    return " ".join("".join(out).split())


def _find(card: dict, place: str) -> str | None:
    name, _, attribute = place.partition("@")
    for node in _walk(card):
        if (not name or name in node["at"].get("class", "").split()) and (not attribute or attribute in node["at"]):
            return node["at"][attribute] if attribute else _text(node)
    return None


def cards_of(page: str, places: Cards, base: str) -> list[tuple]:
    """(title, price text, address, picture, in stock) of every card."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    out = []
    for node in _walk(tree.root):
        if places.card in node["at"].get("class", "").split():
            link, image = _find(node, places.link), _find(node, places.image)
            sold_out = bool(places.sold_out) and _find(node, places.sold_out) is not None
            out.append((_find(node, places.title), _find(node, places.price), link and urljoin(base, link), image and urljoin(base, image), not sold_out))
    return out


def card_offers(pages: DataFrame, places: Cards) -> DataFrame:
    """``page_id``, ``position``, ``title``, ``price_text``, ``url``, ``image_url``, ``in_stock`` of every card of every page.

    ``pages`` has page_id, url and html. A null or broken page gives the cards that can be read, or none.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, i, *card)
                for page, url, body in zip(batch["page_id"], batch["url"], batch["html"])
                if isinstance(body, str)
                for i, card in enumerate(cards_of(body, places, url or ""))
            ]
            yield pd.DataFrame(rows, columns=["page_id", "position", "title", "price_text", "url", "image_url", "in_stock"])

    schema = "page_id long, position long, title string, price_text string, url string, image_url string, in_stock boolean"
    return pages.select("page_id", "url", "html").mapInPandas(work, schema)


def between_markers(pages: DataFrame, marker: str, longest: int, patterns: Mapping[str, str]) -> DataFrame:
    """Pages cut where the marker occurs, and of each part, up to ``longest`` signs, what the patterns' groups find."""
    parts = pages.select("page_id", F.posexplode(F.split("html", marker)).alias("position", "part")).filter("position > 0")
    part = F.substring("part", 1, longest)
    return parts.select("page_id", F.col("position").cast("long"), *[F.nullif(F.regexp_extract(part, p, 1), F.lit("")).alias(n) for n, p in patterns.items()])


def embedded_json(page: Column, script: str, schema: str) -> Column:
    """The value of the JSON in the script element whose attributes match."""
    body = F.regexp_extract(page, rf"(?is)<script[^>]*{script}[^>]*>(.*?)</script>", 1)
    return F.from_json(F.nullif(body, F.lit("")), schema)


def side_map(page: Column, pattern: str) -> Column:
    """A map of what the pattern's two groups find all over the page; the first value of a key stays."""
    entries = F.arrays_zip(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(page, F.lit(pattern), F.lit(2)).alias("v"))
    firsts = F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))),
    )
    return firsts


def escaped_payload(page: Column, pattern: str) -> Column:
    """What a pattern's first group finds in a script's escaped text, unescaped."""
    return js_unescape(F.regexp_extract(page, pattern, 1))


def page_picture(page: Column) -> Column:
    """The picture that a page names for sharing."""
    either = [r'(?is)<meta[^>]+property=["\']og:image(?::secure_url)?["\'][^>]+content=["\']([^"\']+)', r'(?is)<meta[^>]+content=["\']([^"\']+)["\'][^>]+property=["\']og:image', r'(?is)<meta[^>]+name=["\']twitter:image["\'][^>]+content=["\']([^"\']+)']
    return F.coalesce(*[F.nullif(F.regexp_extract(page, p, 1), F.lit("")) for p in either])


def is_refresh_shell(page: Column) -> Column:
    """A short page that only reloads itself by script."""
    return (F.length(page) < 20_000) & F.lower(page).contains("location.reload") & ~F.lower(page).contains("<article")


def unescape_entities(text: Column) -> Column:
    """All character entities decoded."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else html.unescape(v))

    return decode(text)
