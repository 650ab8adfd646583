"""Functions and operators on small tables, against plain Python."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stallwise.functions import keys, numbers, signing, text, titles
from stallwise.operators import facets, maintenance, ranking, tree
from stallwise.session import durable


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "column, value",
    [
        (lambda: text.clean_title(F.lit("  A  B\tc ")), "a b c"),
        (lambda: text.slug(F.lit("Añejo -- 5,000 Watts!")), "anejo-5-000-watts"),
        (lambda: text.title_case(F.lit("macbook-pro 2nd gEN")), "Macbook-Pro 2Nd Gen"),
        (lambda: text.condition(F.lit("Renewed phone, used once")), "refurbished"),
        (lambda: text.strip_html(F.lit("<p>a&nbsp;b</p><script>x<y</script> &amp; c")), "a b & c"),
        (lambda: text.url_quote(F.lit("a b/ç")), "a%20b/%C3%A7"),
        (lambda: text.with_parameters(F.lit("http://x/?a=1"), F.lit("b=2")), "http://x/?a=1&b=2"),
        (lambda: text.with_parameters(F.lit("http://x/"), F.lit(None).cast("string")), "http://x/"),
        (lambda: text.ago(F.lit(7199)), "1h ago"),
        (lambda: text.first_picture(F.lit(""), F.lit("https://x/placeholder.png"), F.lit("https://x/a.jpg")), "https://x/a.jpg"),
        (lambda: text.js_unescape(F.lit('a\\u0026b\\/c\\"')), 'a&b/c"'),
        (lambda: numbers.shown_amount(F.lit(12345.9)), "KSh 12,345"),
        (lambda: numbers.shown_amount(F.lit(None).cast("double")), "—"),
        (lambda: numbers.short_number(F.lit(55.0)), "55"),
        (lambda: keys.depth(F.lit("a|b|c")), 2),
        (lambda: keys.loosely_equal(F.lit("a b|c-d"), F.lit("ab|cd")), True),
        (lambda: keys.positional_conflict(F.lit("a|55|x1"), F.lit("a|65|x1")), True),
        (lambda: keys.positional_conflict(F.lit("a|q60b"), F.lit("a|q70b")), True),
        (lambda: keys.positional_conflict(F.lit("a|pro"), F.lit("a|max")), False),
        (lambda: keys.numeric_conflict(F.lit('{"ram_gb": 8}'), F.lit('{"ram_gb": 8.0, "storage_gb": 1}')), False),
        (lambda: keys.numeric_conflict(F.lit('{"ram_gb": 8}'), F.lit('{"ram_gb": 6}')), True),
    ],
)
def test_functions(spark, column, value):
    assert one(spark, column()) == value


def test_amounts(spark):
    assert str(one(spark, numbers.parse_amount(F.lit("KSh 12,345.00 was 1")))) == "12345.00"
    assert str(one(spark, numbers.from_minor_units(F.lit("123456"), F.lit(2)))) == "1234.56"
    assert one(spark, numbers.parse_amount(F.lit("none"))) is None


def test_signed_tokens(spark):
    df = spark.createDataFrame([(7,), (None,)], "id long").select(signing.signed("s", "alert", F.col("id")).alias("t"))
    back = df.select(signing.verified("s", "alert", F.col("t")).alias("a"), signing.verified("s", "review", F.col("t")).alias("b"))
    assert [tuple(r) for r in back.collect()] == [("7", None), (None, None)]


def test_capped_equals_a_greedy_walk(spark):
    rows = [(i, "abc"[i % 3] if i % 5 else "a") for i in range(60)]
    got = [r.id for r in ranking.capped(spark.createDataFrame(rows, "id long, c string"), "c", "9", "id", 4, 10).collect()]
    held, walked = {}, []
    for i, c in sorted(rows, key=lambda r: (hashlib.md5(f"9:{r[0]}".encode()).hexdigest(), r[0])):
        if held.get(c, 0) < 4 and len(walked) < 10:
            held[c] = held.get(c, 0) + 1
            walked.append(i)
    assert sorted(got) == sorted(walked)


def test_pages_are_clamped(spark):
    df = spark.range(10)
    assert [r.id for r in ranking.page_of(df, [F.col("id")], 9, 4).collect()] == [8, 9]
    assert [r.id for r in ranking.page_of(df, [F.col("id")], 0, 4).collect()] == [0, 1, 2, 3]
    assert ranking.page_of(df.limit(0), [F.col("id")], 3, 4).count() == 0


def test_values_sort_as_numbers_if_all_are(spark):
    assert one(spark, ranking.sorted_values(F.array(F.lit("10"), F.lit("9.0"), F.lit("2.5")))) == ["2.5", "9", "10"]
    assert one(spark, ranking.sorted_values(F.array(F.lit("10"), F.lit("9"), F.lit("x")))) == ["10", "9", "x"]


def test_closure_survives_a_cycle(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id long, parent_id long")
    pairs = {(r.ancestor, r.descendant) for r in tree.closure(links).collect()}
    assert {(1, 3), (2, 3), (3, 3), (8, 9), (9, 8)} <= pairs and len(pairs) == 10


def test_redirects(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x"), ("p", "q"), ("q", "p")], "old string, new string")
    assert {tuple(r) for r in maintenance.compressed_redirects(links).collect()} == {("a", "c"), ("b", "c")}


def test_upsert_and_history_fold(spark):
    r = random.Random(1)
    stored = {"a": 1, "b": 2}
    rows = [(i, r.choice("abc"), r.choice([1, 2, 3])) for i in range(30)]
    incoming = spark.createDataFrame(rows, "seq long, k string, price long")
    current = spark.createDataFrame(list(stored.items()), "k string, price long")
    history, state = [], dict(stored)
    for seq, k, price in rows:
        if state.get(k) != price:
            history.append(seq)
        state[k] = price
    assert sorted(x.seq for x in maintenance.changes_only(incoming, ["k"], ["seq"], "price", current).collect()) == history
    merged = maintenance.merged_offers(current, incoming, ["k"], "seq", ["price"])
    assert {x.k: x.price for x in merged.collect()} == state
    again = maintenance.merged_offers(merged.select("k", "price"), incoming, ["k"], "seq", ["price"])
    assert {x.k: x.price for x in again.collect()} == state
    assert maintenance.inserted_if_absent(current, incoming.select("k", "price"), ["k"]).count() == (1 if "c" in state else 0)


def test_filters(spark):
    products = spark.createDataFrame([(1, "A", "phones", '{"storage_gb": 128}'), (2, "B", "phones", '{"storage_gb": 256}'), (3, "B", "phones", '{"storage_gb": 256}')], "id long, brand string, category_slug string, specs string")
    listings = spark.createDataFrame([(1, 38000, True), (2, 52000, True), (3, 28000, False)], "product_id long, price_kes int, in_stock boolean")
    count = lambda **q: facets.filtered_offers(products, listings, {k: v if isinstance(v, list) else [v] for k, v in q.items()}, facets.facets_for("phones")).count()
    assert [count(), count(brand="A"), count(storage_gb="256"), count(price_max="40000"), count(in_stock="1"), count(in_stock="false"), count(storage_gb=["128", "256"]), count(price_max="x")] == [3, 1, 2, 2, 2, 3, 3, 3]


BRANDS = ["samsung", "hisense", "hp", "jbl", "von hotpoint", "growatt", "philips", "ramtons"]


@pytest.mark.parametrize(
    "leaf, title, key",
    [
        ("phones", "Samsung Galaxy A15 8GB+256GB Dual SIM", "samsung|galaxy-a15"),
        ("phones", "Samsung Galaxy S24+ 256GB", "samsung|galaxy-s24-plus"),
        ("phones", "Samsung Galaxy A15 case", None),
        ("laptops", "HP Elitebook 840 G5 Core i5 8GB RAM 256GB SSD refurbished", "hp|elitebook-840-g5|i5|8gb|256gb|ssd|refurbished"),
        ("tvs", "Hisense 55 inch 4K UHD Smart TV", "hisense|55|4k|smart"),
        ("tvs", "Hisense TV wall mount 55 inch", None),
        ("refrigerators", "Von Hotpoint 213L Double Door Fridge HRD-213", "von-hotpoint|213l|hrd213|double-door"),
        ("washers-dryers", "Samsung 7.5kg Twin Tub washing machine", "samsung|7.5kg|twin-tub|semi-auto"),
        ("cooking", "Ramtons oven", None),
        ("audio", "JBL 2.1 ch soundbar wireless", "jbl|soundbar|2.1ch|wireless"),
        ("inverters", "Growatt 3.5kVA off grid", "growatt|2800w|off-grid"),
        ("kettles", "", None),
        ("kettles", None, None),
    ],
)
def test_titles(spark, leaf, title, key):
    df = spark.createDataFrame([(leaf, title, "clash")], "category_slug string, title string, text string")
    assert titles.with_parsed(df, leaf, "title", BRANDS).first().parsed == key if key is None else titles.with_parsed(df, leaf, "title", BRANDS).first().parsed.canonical_key == key


def test_every_grammar_composes_what_it_reads(spark):
    for leaf, g in titles.GRAMMARS.items():
        need = {n: "7" for n in (*g.needs, *g.any_of[:1]) if n not in g.fixed}
        import json

        row = spark.createDataFrame([(json.dumps(need),)], "p string").select(titles.composed(leaf, F.col("p")).alias("k"), titles.composed(leaf, F.lit("{}")).alias("none")).first()
        assert row.k and (row.none is None or not set(g.needs) - set(g.fixed))


def test_durable_is_written(spark):
    df = durable(spark.range(5))
    assert df.count() == 5 and "Scan ExistingRDD" in df._jdf.queryExecution().toString()


def test_stored_result(spark, tmp_path):
    from stallwise.sinks import stored_result

    calls = []
    build = lambda: calls.append(1) or spark.range(2)
    now = datetime.datetime(2025, 1, 1)
    for hours in (0, 1, 30):
        assert stored_result(spark, str(tmp_path / "r"), build, now + datetime.timedelta(hours=hours)).count() == 2
    assert len(calls) == 2


def test_too_many_brands_are_not_cut(spark, tmp_path):
    from stallwise.plans.offers import titles_parsed

    spark.range(1001).selectExpr("concat('brand ', id) AS brand_name").write.parquet(str(tmp_path / "brand_reference.parquet"))
    spark.createDataFrame([], "seq long, category_slug string, title string, description string").write.parquet(str(tmp_path / "raw_listing.parquet"))
    with pytest.raises(ValueError, match="1000"):
        titles_parsed(spark, str(tmp_path))
