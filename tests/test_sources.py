import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stallwise import sinks
from stallwise.sources import feeds, html
from stallwise.streaming.ingest import Offers, healthy_yield, ingest


def test_store_feed(spark):
    item = lambda i, price="123450", slug="tv": {"id": i, "name": f"n{i}", "sku": "s", "permalink": f"u{i}", "is_in_stock": True, "description": "<b>d</b>", "categories": [{"slug": "x"}, {"slug": slug}], "images": [{"src": "https://x/placeholder.png"}, {"src": "https://x/a.jpg"}], "prices": {"price": price, "regular_price": "200000", "currency_minor_unit": 2}}
    pages = [("m", "b", 1, json.dumps([item(1), item(2, price="")])), ("m", "b", 2, f"<html><pre>{json.dumps([item(1)])}</pre>"), ("m", "b", 3, json.dumps([item(3)])), ("m", "b", 4, "broken"), ("m", "b", 5, None)]
    df = spark.createDataFrame(pages, "merchant_slug string, base_url string, page_no int, body string")
    got = {r.title: (r.price_kes, r.image_url, r.category_slug, r.description) for r in feeds.store_offers(df, {"tv": "tvs"}).collect()}
    assert got == {"n1": (Decimal("1234.50"), "https://x/a.jpg", "tvs", "d"), "n2": (Decimal("2000.00"), "https://x/a.jpg", "tvs", "d")}


def test_shop_feed(spark):
    body = json.dumps({"products": [{"id": 1, "title": "Big TV", "handle": "h", "product_type": "Smart TV sets", "body_html": "", "variants": [{"price": "9.50", "available": False, "sku": "k"}, {"price": "8.00", "available": True, "sku": "l"}], "images": []}]})
    df = spark.createDataFrame([("m", "https://x", 1, body)], "merchant_slug string, base_url string, page_no int, body string")
    row = feeds.shop_offers(df, {"tv": "tvs", "smart tv": "smart-tvs"}).first()
    assert (row.price_kes, row.in_stock, row.category_slug, row.url, row.image_url) == (Decimal("8.00"), True, "smart-tvs", "https://x/products/h", None)


PAGE = '<div class="card a"><a href="/p/1"><img src="i.jpg"><h2 class="t">One &amp; two</h2><span class="p">KSh 1,200</a></div><div class="card"><h2 class="t">Three<span class="p">5</span><b class="out">x</b>'


def test_cards(spark):
    df = spark.createDataFrame([(1, "https://x/l/", PAGE, 0), (2, None, None, 0), (3, "", "", 0)], "page_id long, url string, html string, position int")
    got = [tuple(r)[1:] for r in html.card_offers(df, html.Cards("card", "t", "p", sold_out="out")).orderBy("position").collect()]
    assert got[0] == (0, "One & two", "KSh 1,200", "https://x/p/1", "https://x/l/i.jpg", True)
    assert got[1][4:] == (None, False) and len(got) == 2


def test_text_in_pages(spark):
    page = '<script type="application/json" id="data">{"a": {"b": 3}}</script>{id:1,image:"x"}{id:1,image:"y"}{id:2,image:"z"}##t1|5##t2|6<meta property="og:image" content="https://x/o.jpg">'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert df.select(html.embedded_json(F.col("html"), 'id="data"', "a struct<b: int>").alias("v")).first().v.a.b == 3
    assert df.select(html.side_map(F.col("html"), r'id:(\d+),image:"(\w+)"').alias("m")).first().m == {"1": "x", "2": "z"}
    assert df.select(html.page_picture(F.col("html")).alias("v")).first().v == "https://x/o.jpg"
    assert [(r.position, r.t, r.p) for r in html.between_markers(df, "##", 5, {"t": r"^(\w+)", "p": r"\|(\d)"}).collect()] == [(1, "t1", "5"), (2, "t2", "6")]
    assert spark.range(1).select(html.unescape_entities(F.lit("&eacute;&#39;")).alias("v")).first().v == "é'"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, None), (2, False, "a&b")], "id long, ok boolean, name string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted({r.value for r in spark.read.text(str(tmp_path / "c")).collect()}) == ["1,1,", "2,0,a&b", "id,ok,name"]
    part = sinks.sitemap_parts(df, F.concat(F.lit("https://x/"), F.col("name")), F.lit(None).cast("timestamp")).first()
    assert part.urls == 1 and "<loc>https://x/a&amp;b</loc>" in part.xml
    offers = spark.createDataFrame([(1, "m", "u", 5, True), (1, "n", "v", 4, True)], "product_id long, merchant string, url string, price int, in_stock boolean")
    ratings = spark.createDataFrame([(1, 4, "b", 1), (1, 5, "c", 2)], "product_id long, rating int, body string, written_at int")
    products = spark.createDataFrame([(1, "t", "b"), (2, "u", None)], "id long, title string, brand string")
    docs = {r.id: json.loads(r.document) for r in sinks.product_documents(products, offers, ratings).collect()}
    assert [o["price"] for o in docs[1]["offers"]] == [4, 5] and docs[1]["rating"] == 4.5 and "offers" not in docs[2]
    assert json.loads(sinks.json_lines(df).orderBy("value").first().value)["id"] == 1


def test_stream_equals_batch(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1)
    rows = [(i, "m", f"https://x/{i % 3}" + ("?ref=1" if i % 2 else ""), f"t{i}", Decimal(10 + (i // 4) % 3), True, at) for i in range(24)]
    schema = "seq long, merchant_slug string, url string, title string, price_kes decimal(12,2), in_stock boolean, observed_at timestamp"
    for n in range(3):
        spark.createDataFrame(rows[n * 8 : n * 8 + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    offers = Offers(spark, str(tmp_path / "out"))
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, offers, str(tmp_path / "check"), seen.append)
    state, history = {}, []
    for seq, _, url, title, price, *_ in rows:
        page = url.split("?")[0]
        if state.get(page, (None,))[0] != price:
            history.append(seq)
        state[page] = (price, title)
    assert seen == [8, 8, 8]
    assert {r.page: (r.price_kes, r.title) for r in offers.current().collect()} == state
    assert sorted(r.seq for r in offers.history().collect()) == history
    offers.take(spark.createDataFrame(rows[16:], schema), 2)  # a repeated batch changes nothing
    assert sorted(r.seq for r in offers.history().collect()) == history


def test_yield_guard():
    healthy_yield(4, 0)
    healthy_yield(50, 1)
    with pytest.raises(RuntimeError):
        healthy_yield(5, 0)
