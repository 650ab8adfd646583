"""Queries on the catalogue's own tables: quantities in common units, price spikes, and attribute history."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import attribute_history
from ..operators.spikes import impossible_readings
from ..operators.units import BIN, ENTRY, NUMBER, REACH, SIZE_WORDS, alias_rows, common_quantities
from ..sources.tables import table


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Quantities of every offer in common units, where specs don't hold them in order."""
    tables = [table(spark, data_dir, name) for name in ("parsed_title", "raw_listing", "unit_reference")]
    return common_quantities(*tables).filter(~F.col("in_order")).select("seq", "quantity", "common_value")


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Readings whose price cannot have been asked."""
    return impossible_readings(table(spark, data_dir, "listing_snapshot"))


def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Versions of every listing's price and stock, from all its visits."""
    visits = table(spark, data_dir, "listing_snapshot")
    groups = {"price": ["price_kes"], "stock": ["in_stock"]}
    return attribute_history(visits, "listing_id", "last_checked_at", "loaded_at", "snap_id", groups).select(
        "listing_id", "valid_from_us", "valid_to_us"
    )


P7_SQL = """
WITH latest AS (
  SELECT listing_id, last_checked_at AS read_at,
         arg_max(struct_pack(p := price_kes, s := in_stock), struct_pack(l := loaded_at, i := snap_id)) AS kept
  FROM listing_snapshot WHERE last_checked_at IS NOT NULL AND listing_id IS NOT NULL GROUP BY 1, 2),
filled AS (
  SELECT listing_id, read_at, last_value(kept.p IGNORE NULLS) OVER so_far AS p, last_value(kept.s IGNORE NULLS) OVER so_far AS s,
         row_number() OVER (PARTITION BY listing_id ORDER BY read_at) AS nth
  FROM latest WINDOW so_far AS (PARTITION BY listing_id ORDER BY read_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
compared AS (
  SELECT *, lag(p) OVER w AS p0, lag(s) OVER w AS s0 FROM filled WINDOW w AS (PARTITION BY listing_id ORDER BY read_at)),
versions AS (
  SELECT listing_id, read_at FROM compared WHERE nth = 1 OR p IS DISTINCT FROM p0 OR s IS DISTINCT FROM s0)
SELECT listing_id, epoch_us(read_at) AS valid_from_us,
       coalesce(lead(epoch_us(read_at)) OVER (PARTITION BY listing_id ORDER BY read_at), -1) AS valid_to_us
FROM versions"""

def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_mention() -> str:
    """A number with its unit in a text whose separators were doubled, as the database's patterns cannot look around."""
    words = "|".join(SIZE_WORDS)
    units = "|".join(re.escape(w).replace('"', '""').replace("''", "''''") for w in sorted((w for w, _ in alias_rows()), key=lambda w: (-len(w), w)))
    for plain, loose in (("cubicfeet", r"cubic[\s-]*feet"), ("cubicfoot", r"cubic[\s-]*foot"), ("cuft", r"cu\.?[\s-]*ft\.?"), ("watthours", r"watt[\s-]*hours"), ("watthour", r"watt[\s-]*hour")):
        units = f"|{units}|".replace(f"|{plain}|", f"|{loose}|")[1:-1]
    return (
        rf"(?i)(?:^|[^\p{{L}}\p{{N}}.,])(?:({words})[\s:]+)?(?:({NUMBER})(?:\+\+|//|\s+(?:\+\+|//)\s+)({NUMBER})\s*(gb|tb|mb)|({NUMBER})[\s-]*({units}))"
        rf"(?:[\s-]+({words})\b|[^\p{{L}}\p{{N}}]|$)"
    )


def _sql_number(text: str) -> str:
    return (
        f"TRY_CAST(CASE WHEN regexp_matches({text}, '^[1-9][0-9]{{0,2}}(,[0-9]{{3}})+(\\.[0-9]+)?$') THEN replace({text}, ',', '')"
        f" WHEN regexp_matches({text}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]+$') OR regexp_matches({text}, '^[0-9]{{1,3}}(\\.[0-9]{{3}}){{2,}}$') THEN replace(replace({text}, '.', ''), ',', '.')"
        f" ELSE replace({text}, ',', '.') END AS DOUBLE)"
    )


def _sql_bin(value: str) -> str:
    return f"CAST(round(ln({value}) / {BIN}) AS INTEGER)"


def _sql_known(source: str) -> str:
    return (
        f"SELECT category, quantity, unnest(range(step - {REACH}, step + {REACH + 1})) AS bin, n FROM"
        f" (SELECT category, quantity, {_sql_bin('common')} AS step, count(*) AS n FROM {source} WHERE common > 0 GROUP BY ALL)"
    )


STATED = rf"^\s*({NUMBER})[\s-]*(\D*?)\s*$"
P4_SQL = rf"""
WITH aliases(spelling, symbol) AS (VALUES {", ".join(f"({_sql_text(w)}, {_sql_text(u)})" for w, u in alias_rows())}),
words(word, meaning) AS (VALUES {", ".join(f"({_sql_text(w)}, {_sql_text(q)})" for w, q in SIZE_WORDS.items())}),
units AS (SELECT quantity, unit_symbol, min(factor_to_common) AS factor, min(common_unit) AS common_unit FROM unit_reference GROUP BY ALL),
commons AS (SELECT DISTINCT quantity, common_unit FROM units),
offers AS (SELECT seq, title, coalesce(category_slug, '') AS category, coalesce(merchant_slug, '') AS source FROM raw_listing WHERE seq IS NOT NULL),
fields AS (SELECT p.seq, p.specs, coalesce(o.category, '') AS category, coalesce(o.source, '') AS source FROM parsed_title p LEFT JOIN offers o USING (seq) WHERE p.seq IS NOT NULL),
listed AS (SELECT seq, category, source, regexp_extract_all(specs, {_sql_text(ENTRY)}) AS entries FROM fields WHERE specs IS NOT NULL),
entries AS (SELECT seq, category, source, unnest(entries) AS entry, generate_subscripts(entries, 1) - 1 AS place FROM listed),
parts AS (SELECT *, replace(lower(trim(regexp_extract(entry, {_sql_text(ENTRY)}, 1))), ' ', '_') AS name, regexp_extract(entry, {_sql_text(ENTRY)}, 2) AS value FROM entries),
inside AS (SELECT *, regexp_matches(value, '^["'']') AS quoted,
  CASE WHEN regexp_matches(value, '^["'']') THEN regexp_replace(substr(value, 2, length(value) - 2), '\\(.)', '\1', 'g') ELSE trim(value) END AS inner_text FROM parts),
said AS (SELECT seq, category, source, place, regexp_replace(name, '_[a-z]+$', '') AS quantity, quoted, regexp_extract(inner_text, {_sql_text(STATED)}, 1) AS number,
  regexp_extract(inner_text, {_sql_text(STATED)}, 2) AS unit_text, regexp_extract(name, '_([a-z]+)$', 1) AS suffix FROM inside WHERE regexp_matches(inner_text, {_sql_text(STATED)})),
specs AS (SELECT seq, category, source, place, quantity, {_sql_number("number")} AS figure, a.symbol AS text_unit, b.symbol AS name_unit, NOT quoted AND unit_text = '' AS plain
  FROM said LEFT JOIN aliases a ON a.spelling = regexp_replace(lower(unit_text), '[\s-]', '', 'g') LEFT JOIN aliases b ON b.spelling = suffix
  WHERE quantity IN (SELECT quantity FROM units) AND {_sql_number("number")} > 0),
found AS (SELECT seq, category, source, regexp_extract_all(regexp_replace(title, '([^\p{{L}}\p{{N}}.,])', '\1\1', 'g'), {_sql_text(_sql_mention())}) AS texts FROM offers WHERE title IS NOT NULL),
matches AS (SELECT seq, category, source, unnest(texts) AS whole, generate_subscripts(texts, 1) - 1 AS place FROM found),
grouped AS (SELECT seq, category, source, place, regexp_extract(whole, {_sql_text(_sql_mention())}, ['before', 'bare', 'second', 'second_unit', 'number', 'unit', 'after']) AS g, whole FROM matches),
numbers AS (
  SELECT seq, category, source, place * 2 AS place, CASE WHEN g.bare <> '' THEN g.second ELSE g.number END AS number, CASE WHEN g.bare <> '' THEN g.second_unit ELSE g.unit END AS unit,
    coalesce((SELECT meaning FROM words WHERE word = lower(g.before)), (SELECT meaning FROM words WHERE word = lower(g.after))) AS hint
  FROM grouped WHERE NOT (g.bare = '' AND g.before = '' AND g.after = '' AND g.unit = 'G' AND regexp_matches(g.number, '^[2-6]$') AND regexp_matches(whole, '[2-6]G'))
  UNION ALL SELECT seq, category, source, place * 2 + 1, g.bare, g.second_unit, NULL FROM grouped WHERE g.bare <> ''),
mentions AS (SELECT seq, category, source, place, {_sql_number("number")} AS figure, symbol AS text_unit, hint
  FROM numbers JOIN aliases ON spelling = replace(regexp_replace(lower(unit), '[\s-]', '', 'g'), '""', '"') OR spelling = replace(unit, '''''', '''')),
sized AS (SELECT m.*, u.quantity, m.figure * u.factor AS common FROM mentions m JOIN units u ON u.unit_symbol = m.text_unit WHERE m.figure * u.factor > 0),
named AS (SELECT category, quantity, count(*) AS named FROM specs GROUP BY ALL),
others AS (SELECT seq, category, source, place, figure, text_unit, common, quantity, true AS sure FROM (
  SELECT s.*, row_number() OVER (PARTITION BY seq, place ORDER BY named DESC NULLS LAST, quantity) AS nth FROM sized s LEFT JOIN named USING (category, quantity) WHERE quantity NOT IN ('ram', 'storage')) WHERE nth = 1),
in_words AS (SELECT s.seq, s.category, s.source, s.quantity, u.unit_symbol, figure * factor AS common FROM specs s JOIN units u ON u.quantity = s.quantity AND u.unit_symbol = coalesce(text_unit, name_unit)
  WHERE text_unit IS NOT NULL OR name_unit <> common_unit),
first_known AS (SELECT category, quantity, bin, sum(n) AS seen FROM ({_sql_known("in_words")}) GROUP BY ALL),
one AS (SELECT seq, place, min(s.category) AS category, min(source) AS source, min(figure) AS figure, min(text_unit) AS text_unit, min(hint) AS hint, min(common) AS common,
  coalesce(max(seen) FILTER (s.quantity = 'ram'), 0) AS as_ram, coalesce(max(seen) FILTER (s.quantity = 'storage'), 0) AS as_storage
  FROM sized s LEFT JOIN first_known k ON k.category = s.category AND k.quantity = s.quantity AND k.bin = {_sql_bin("common")} WHERE s.quantity IN ('ram', 'storage') GROUP BY seq, place),
spread AS (SELECT *, min(common) FILTER (hint IS NULL) OVER t AS least, max(common) FILTER (hint IS NULL) OVER t AS most,
  coalesce(bool_or(hint = 'ram') OVER t, false) AS has_ram, coalesce(bool_or(hint = 'storage') OVER t, false) AS has_storage FROM one WINDOW t AS (PARTITION BY seq)),
titled AS (SELECT * FROM others UNION ALL SELECT seq, category, source, place, figure, text_unit, common, CASE WHEN hint IS NOT NULL THEN hint WHEN has_ram AND NOT has_storage THEN 'storage'
  WHEN has_storage AND NOT has_ram THEN 'ram' WHEN least < most THEN CASE WHEN common = least THEN 'ram' ELSE 'storage' END
  WHEN as_ram = 0 AND as_storage = 0 THEN CASE WHEN common < 16 THEN 'ram' ELSE 'storage' END WHEN as_ram > as_storage THEN 'ram' ELSE 'storage' END, hint IS NOT NULL FROM spread),
all_stated AS (SELECT category, quantity, common FROM in_words UNION ALL SELECT category, quantity, common FROM titled WHERE sure),
known AS (SELECT category, quantity, bin, sum(n) AS seen FROM ({_sql_known("all_stated")}) GROUP BY ALL),
usual AS (SELECT source, quantity, unit_symbol, count(*) AS used FROM (SELECT source, quantity, unit_symbol FROM in_words UNION ALL SELECT source, quantity, text_unit FROM titled) GROUP BY ALL),
held AS (SELECT seq, quantity, arg_min(struct_pack(category, source, figure, text_unit, name_unit, plain), (NOT (plain AND coalesce(name_unit, '') = common_unit))::BIGINT * 1000000000 + place) AS h
  FROM specs JOIN commons USING (quantity) GROUP BY ALL),
in_title AS (SELECT seq, quantity, arg_min(common, place) AS in_title FROM titled JOIN commons USING (quantity) GROUP BY ALL),
cases AS (SELECT seq, quantity, in_title, h.category, h.source, h.figure, h.text_unit, h.name_unit, coalesce(h.plain, false) AS plain FROM held FULL JOIN in_title USING (seq, quantity)),
choices AS (SELECT c.*, u.unit_symbol, u.common_unit, u.factor, figure * factor AS value FROM cases c JOIN units u USING (quantity)),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY c.seq, c.quantity ORDER BY coalesce(c.unit_symbol = text_unit, false) DESC, coalesce(seen, 0) > 0 AND coalesce(c.unit_symbol = name_unit, false) DESC,
  coalesce(abs(ln(value / in_title)) < 0.015, false) DESC, coalesce(seen, 0) DESC, coalesce(c.unit_symbol = name_unit, false) DESC, coalesce(used, 0) DESC, factor) AS nth
  FROM choices c LEFT JOIN known k ON k.category = c.category AND k.quantity = c.quantity AND k.bin = CASE WHEN value > 0 THEN {_sql_bin("value")} END
  LEFT JOIN usual u ON u.source = c.source AND u.quantity = c.quantity AND u.unit_symbol = c.unit_symbol)
SELECT seq, quantity, CAST(floor(coalesce(value, in_title) + 0.5) AS BIGINT) AS common_value FROM ranked
WHERE nth = 1 AND coalesce(value, in_title) IS NOT NULL AND NOT (plain AND coalesce(name_unit = common_unit, false) AND unit_symbol = common_unit)"""


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found}
ORACLES = {"p4_found": P4_SQL, "p7_found": P7_SQL}
