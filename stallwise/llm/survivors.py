"""One surviving value a field for every group of duplicate records.

Records are ranked by completeness (whether the field's value is usable), then trust, then recency, with the id as the
last, deterministic key; the top record a group and field survives. The ranking is a window whose limit of one row the
planner also applies before the shuffle, so a group that holds a third of all rows reaches its task as one row from
every map task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Text decoded with the wrong character set, or with lost characters.
GARBLED = "[ÂÃâðÅ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[\u0080-\u009f]|�|â$|â[^a-zA-ZÀ-ÿ]"
#: Text that was cut: an ellipsis or a link to the rest at its end.
CUT = r"(…|\.\.+|\[\s*(…|\.\.\.)\s*\]|(?i)read more|(?i)show more)\s*$"
#: A model code within a key: letters, perhaps a hyphen, then figures.
CODE_IN_KEY = "([a-z]+)-?([0-9][0-9a-z]*)"
#: A figure with a unit, the size that completes a name.
SIZED = r"(?i)[0-9]\s*(gb|tb|mb|mm|cm|in|inch|inches|m|ft|ml|l|ltr|litre|litres|cuft|gal|g|kg|lb|oz|w|kw|hp|mah|ah|wh|kwh|\")\W*(\W.*)?$"
# Parts of paths under which shops keep pictures of nothing.
NO_PICTURE = "placeholder|no[-_]?image|noimage|no[-_]?photo|coming[-_]?soon|loading|spinner|default[-_]|blank|dummy|missing|not[-_]?available|pixel|spacer"


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _code(key: Column) -> Column:
    """The model code in a key, letters and figures alone; '' if it has none."""
    return F.regexp_replace(F.regexp_extract(key, CODE_IN_KEY, 0), "-", "")


def readable(text: Column) -> Column:
    return text.isNotNull() & ~text.rlike(GARBLED) & ~text.rlike(CUT)


def names_in_full(title: Column, key: Column) -> Column:
    """A readable title with the key's model code (any code, if the key has none), a size and a brand beside them."""
    code, letters = _code(key), _letters(title)
    coded = F.when(code != "", letters.contains(code)).otherwise(letters.rlike("[a-z]+[0-9]{3}"))
    return readable(title) & coded & title.rlike(SIZED) & (F.size(F.split(F.trim(title), r"\s+")) >= 4)


def describes(text: Column, key: Column) -> Column:
    """A readable text of whole sentences that names the key's model code (with a key without one: five words or more)."""
    code = _code(key)
    own = F.when(code != "", _letters(text).contains(code)).otherwise(F.size(F.split(F.trim(text), r"\s+")) >= 5)
    return readable(text) & own & F.trim(text).rlike(r"[.!?。！？؟][\"'”’»)]*$")


def picture_address(url: Column) -> Column:
    """An absolute https address with a path that isn't a stand-in's, nor a drawing or animation as those are."""
    path = F.lower(F.regexp_extract(F.trim(url), r"^https://[^/\s]+/(\S+)$", 1))
    return url.isNotNull() & (path != "") & ~path.rlike(NO_PICTURE) & ~path.rlike(r"\.(svg|gif|ico)(\?.*)?$")


def surviving_values(
    df: DataFrame, group: str, record: str, usable: Mapping[str, Column], trust: Column, updated: str
) -> DataFrame:
    """``group``, ``field_name`` and ``record`` of the surviving value, for groups of two or more rows.

    ``usable`` maps a field to whether a row's value is complete and sound; ``trust`` is a number, smaller is better,
    null last. Then the latest ``updated`` counts (null last), then the smallest ``record``. No row comes out where
    nothing is usable, nor for rows without group; repeated rows count as rows of their group, but the result is the
    same record.
    """
    rows = df.filter(F.col(group).isNotNull())
    several = rows.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows")).filter("group_rows > 1").select(group)
    fields = F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in usable.items()]), lambda f: f.isNotNull())
    offered = rows.select(group, record, trust.alias("trust"), F.col(updated).alias("updated"), F.explode(fields).alias("field_name"))
    best = W.partitionBy(group, "field_name").orderBy(F.col("trust").asc_nulls_last(), F.col("updated").desc_nulls_last(), record)
    return (
        offered.withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .join(several, group, "left_semi")
        .select(group, "field_name", record)
    )
