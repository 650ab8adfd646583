import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import entities, language, mixing, packing, survivors


# surviving values


def test_survivors_equal_a_plain_ranking(spark):
    r = random.Random(2)
    at = datetime.datetime(2025, 1, 1)
    rows = [(r.choice(["a", "b", "c", None]), i, r.choice([None, "x", "y", "bad"]), r.choice([None, 1, 2, 3]), r.choice([None, at, at + datetime.timedelta(days=1)]), i) for i in range(80)] + [("lonely", 99, "x", 1, at, 0)]
    df = spark.createDataFrame(rows, "k string, id long, v string, t int, u timestamp, place int")
    got = {(x.k, x.field_name): x.id for x in survivors.surviving_values(df, "k", "id", {"v": F.col("v").isin("x", "y"), "none": F.lit(None).cast("boolean")}, F.col("t"), "u").collect()}
    want = {}
    for k, group in itertools.groupby(sorted((x for x in rows if x[0]), key=lambda x: x[0]), key=lambda x: x[0]):
        group = list(group)
        best = min((x for x in group if x[2] in ("x", "y")), key=lambda x: (x[3] is None, x[3] or 0, x[4] is None, -(x[4] or at).timestamp(), x[1]), default=None)
        if len(group) > 1 and best:
            want[k, "v"] = best[1]
    assert got == want
    assert survivors.surviving_values(df.limit(0), "k", "id", {"v": F.lit(True)}, F.col("t"), "u").count() == 0


@pytest.mark.parametrize(
    "title, ok",
    [("Brand Lumo AB1234 Pro (128 gb)", True), ("Lumo AB1234 Pro 128 gb – Brand", True), ("Brand Lumo AB1…", False), ("SKU-12345", False), ("Untitled", False), ("", False), (None, False), ("Brand â€“ Lumo AB1234 Pro â€œ128 gbâ€", False), ("Brand Lumo XY9999 Pro (128 gb)", False)],
)
def test_titles_in_full(spark, title, ok):
    df = spark.createDataFrame([(title, "brand|lumo-ab-1234-pro|128gb")], "t string, k string")
    assert bool(df.select(survivors.names_in_full(F.col("t"), F.col("k")).alias("v")).first().v) is ok


@pytest.mark.parametrize("text, ok", [("Lumo AB1234 by Brand. Runs quietly.", True), ("Lumo AB1234 by Brand. Runs qui", False), ("Lumo AB1234 by... Read more", False), ("Free delivery on all orders.", False), ("<p>&nbsp;</p>", False), (None, False)])
def test_descriptions(spark, text, ok):
    df = spark.createDataFrame([(text, "brand|lumo-ab1234|128gb")], "t string, k string")
    assert bool(df.select(survivors.describes(F.col("t"), F.col("k")).alias("v")).first().v) is ok


@pytest.mark.parametrize("url, ok", [("https://x.y/p/1.jpg", True), ("http://x.y/p/1.jpg", False), ("https://x.y/placeholder.png", False), ("https://", False), ("https://x.y/", False), ("image.jpg", False), ("https://x.y/a.svg", False), ("data:image/gif;base64,", False), (None, False)])
def test_pictures(spark, url, ok):
    assert bool(spark.createDataFrame([(url,)], "u string").select(survivors.picture_address(F.col("u")).alias("v")).first().v) is ok


# packing


def test_fill_is_the_best_multiset():
    r = random.Random(7)
    for _ in range(200):
        items = [r.randrange(1, 12) for _ in range(r.randrange(0, 9))]
        room = r.randrange(0, 30)
        counts = {n: items.count(n) for n in set(items)}
        chosen = packing.fill(dict(counts), room)
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        assert sum(n * k for n, k in chosen.items()) == best and all(k <= counts[n] for n, k in chosen.items())


def test_containers(spark):
    r = random.Random(8)
    rows = [(i, r.choice([None, 0, *range(1, 60)] + [250]), i) for i in range(600)] + [(5, 7, 5), (None, 3, 0)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, container int")
    limits = spark.createDataFrame([("s", 100), ("l", 1000), ("none", 0), (None, 5)], "container_kind string, capacity_tokens int")
    out = packing.packed(items, limits, window=250).collect()
    for kind, capacity in (("s", 100), ("l", 1000)):
        mine = [x for x in out if x.container_kind == kind]
        rooms = {}
        for x in mine:
            rooms[x.container] = rooms.get(x.container, 0) + x.tokens
        assert max(rooms.values()) <= capacity
        assert sum(x.tokens for x in mine) == sum(n or 0 for _, n, _ in rows)
        split = {x.doc_id for x in mine if x.piece_no > 0}
        assert split == ({d for d, n, _ in rows if n == 250} if capacity == 100 else set())
    report = {x.container_kind: x.unused_share for x in packing.container_report(packing.packed(items, limits), limits).collect()}
    assert report["s"] < 0.01 and set(report) == {"s", "l"}
    assert packing.packed(items.limit(0), limits).count() == 0


def test_tokens(spark):
    from stallwise.llm.tokens import count_tokens, token_count

    df = spark.createDataFrame([("hello world",), (None,), ("",), ("habari " * 3000,)], "text string")
    got = [x.n for x in df.select(token_count(F.col("text")).alias("n")).collect()]
    assert got[1:3] == [0, 0] and got[0] == count_tokens("hello world") and got[3] >= 3000


# mixing


def test_shares_are_reached_within_repeats(spark):
    r = random.Random(4)
    words = {"a": "phone screen battery", "b": "fridge cold litre", "C_c": "solar panel watt"}
    rows = [(i, " ".join(r.choice(words[s].split()) for _ in range(30)), s) for i in range(900) for s in [("a" if i % 10 else "C_c") if i % 3 else "b"]]
    rows += [(1000 + i, " ".join(r.choice(words["b"].split()) for _ in range(30)), None) for i in range(50)] + [(2000, None, "a"), (2001, "", "a"), (2002, "x y z", "unwanted"), (2003, "fridge " * 3, "  ")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit(1))
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 1), ("c-c", 0.2, 5), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(documents, targets)
    limits = {"a": 1, "b": 1, "c-c": 5, "": 0}
    out = mixed.collect()
    assert len(out) == len(rows) and all(0 <= x.copies <= limits[x.source] for x in out)
    assert {x.source for x in out if 1000 <= x.doc_id < 1050} == {"b"}
    reached = {x.source: x.reached_share for x in mixing.share_report(mixed, targets).collect()}
    assert reached["gone"] == 0 and all(abs(reached[s] - t / 0.9) < 0.03 for s, t in (("a", 0.4), ("b", 0.3), ("c-c", 0.2)))
    assert mixing.mixture(documents.limit(0), targets).count() == 0


def test_documents_without_label_keep_the_repeats_of_their_source(spark):
    r = random.Random(9)
    words = "phone fridge panel screen cold watt".split()  # the texts don't tell the sources apart
    rows = [(i, " ".join(r.choice(words) for _ in range(20)), s) for i in range(600) for s in ["a" if i % 6 else "b"]] + [(1000 + i, " ".join(r.choice(words) for _ in range(20)), None) for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 5)], "source string, target_share double, max_repeats int")
    out = mixing.mixture(documents, targets).collect()
    limits = {"a": 1, "b": 5}
    assert len(out) == len(rows) and all(x.copies <= limits[x.source] and x.rate <= limits[x.source] for x in out)
    assert {x.source for x in out if x.doc_id >= 1000} == {"a", "b"} and max(x.copies for x in out) > 1


def test_a_fit_that_does_not_settle_warns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    documents = spark.createDataFrame([(i, "phone " * (i % 7), "a" if i % 2 else "b") for i in range(100)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 9)], "source string, target_share double, max_repeats int")
    with pytest.warns(UserWarning, match="still changed"):
        mixing.mixture(documents, targets)


# language

TEXTS = {
    "en": "The seller told me that this phone would be replaced but nobody has called back yet. The price was the reason I sent it back to the shop. You should read the label carefully before you buy this machine.",
    "fr": "Le vendeur m'a dit que ce téléphone serait remplacé mais personne ne m'a rappelé depuis. Le prix m'a poussé à tout renvoyer au magasin. Lisez bien l'étiquette avant d'acheter cette machine.",
    "sw": "Muuzaji aliniambia kwamba simu hii itabadilishwa lakini hadi leo hakuna aliyenipigia. Bei yake ndiyo sababu niliirudisha dukani. Soma maelezo kwa makini kabla ya kununua mashine hii.",
    "zh": "卖家告诉我这部手机会更换，但是到现在还没有人给我回电话。价格是我把它退回商店的原因。购买这台机器之前请仔细阅读标签。",
}


@pytest.fixture(scope="module")
def segments(spark):
    r = random.Random(6)
    rows = []
    for i in range(160):
        lang = list(TEXTS)[i % 4]
        parts = [p for p in TEXTS[lang].replace("。", "。|").replace(". ", ".|").split("|") if p]
        r.shuffle(parts)
        label = {"en": "English", "fr": "fr-FR", "sw": "swa", "zh": "ZH"}[lang] if i >= 8 else "en"
        rows.append((i, "".join(parts) if lang == "zh" else " ".join(parts), label, 0))
    en, fr = (TEXTS[x].split(". ") for x in ("en", "fr"))
    rows += [
        (500, f"{en[0]}. {en[1]}. {fr[0]}. {fr[1]}.\n<br/> 5/5 ★★ {en[2]}", "en", 0),
        (501, "SKU QJ417; 619 W; 42 V\n738 / 580", "und", 0),
        (502, "SKU QJ417; 619 W; 42 V\n738 / 580", "fr", 0),
        (503, "  \n ", "en", 0), (504, None, None, 0), (505, "", "xx", 0),
        (506, en[0] * 1 + ". " + " ".join(["The price was fine."] * 9000), "en", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence int")
    return language.language_segments(spark, df)


def test_languages(segments):
    out = {}
    for x in segments.orderBy("doc_id", "seg_no").collect():
        assert 0 <= x.confidence <= 1
        out.setdefault(x.doc_id, []).append(x.lang)
    assert all(out[i] == [list(TEXTS)[i % 4]] for i in range(160))
    assert out[500] == ["en", "fr", "en"] and out[501] == ["und"] and out[506] == ["en"]
    assert not {503, 504, 505} & set(out)


def test_only_wrong_or_mixed(segments):
    listed = {x.doc_id for x in language.wrongly_labelled(segments).collect()}
    assert listed == {1, 2, 3, 5, 6, 7, 500, 502}


def test_no_documents(spark):
    assert language.language_segments(spark, spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_vectors_are_counts():
    v = language.count_ngrams(["aba", "", "b"])
    assert v.n == 3 and set(v.rows) == {0, 2} and v.counts.sum() == 3 + 2 + 1 + 1
    assert np.isfinite(v.counts).all()


# entities


@pytest.mark.parametrize(
    "text, code",
    [("Brand LED TV Vista QY2542 Pro 60W", ("qy2542", "pro")), ("Akila EM-81.87 Max", ("em8187", "max")), ("Lumo FT0934+ 256GB", ("ft0934", "plus")), ("Cover Grip PZ1562 for Brand Lumo ZZ1403 Max Mint", ("pz1562", "")), ("8GB+256GB phone", None), ("", None)],
)
def test_codes(text, code):
    found = entities.codes_in(text)
    assert (found[0][:2] if found else None) == code


def test_same_items(spark):
    listing = [(1, "Acme Phone Lumo AB1234 Pro 128GB", "u1", None), (2, "Lumo AB 1234 PRO 128 gb phone new", "u2", None), (3, "Acme Lumo AB1234 Pro", "u3", None), (4, "Acme Lumo ABl234 Pro 128GB", "u4", None), (5, "Acme Lumo AB1234 128GB", "u5", None), (6, "Acme Lumo AB1234 Pro 256GB", "u6", None), (7, "Cover for Acme Lumo AB1234 Pro", "u7", None), (8, None, None, None), (None, "x", "u9", None), (1, "Acme Phone Lumo AB1234 Pro 128GB", "u1", None), (10, "", "u10", 77)]
    listing = spark.createDataFrame(listing, "id long, title_on_merchant string, url string, product_id long").withColumn("item", F.lit("clash"))
    raw = [(i, f"u{i}?ref=1", t, d, "phones", "m") for i, (t, d) in enumerate([("Acme Phone Lumo AB1234 Pro 128GB", None), ("Lumo AB 1234 PRO 128 gb phone", None), ("Acme Lumo AB1234 Pro", "Size 128 GB"), ("Acme Lumo ABl234 Pro 128GB", ""), ("Acme Lumo AB1234 128GB", None), ("Acme Lumo AB1234 Pro 256GB", None)], 1)]
    raw = spark.createDataFrame(raw, "seq long, url string, title string, description string, category_slug string, merchant_slug string")
    parsed = spark.createDataFrame([(i, "Acme", '{"storage_gb": 128}' if i < 3 else None) for i in range(1, 7)], "seq long, brand string, specs string")
    products = spark.createDataFrame([(70 + i, f"acme|lumo-ab1234-pro|{128 if i else 256}gb", "phones") for i in range(3)], "id long, canonical_key string, category_slug string")
    reference = spark.createDataFrame([("storage", "gb", 1.0, "gb"), ("ram", "gb", 1.0, "gb")], "quantity string, unit_symbol string, factor_to_common double, common_unit string")
    brands = spark.createDataFrame([(1, "Acme", None)], "brand_id long, brand_name string, also_sold_as string")
    pairs = {tuple(x) for x in entities.pairs_of(entities.same_items(listing, raw, parsed, products, reference, brands)).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}


def test_survivors_equal_sql(spark):
    import os

    import duckdb

    from stallwise.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in ("product", "merchant"):
        con.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    got = sorted(tuple(r) for r in queries.p6_found(spark, data).collect())
    assert got == sorted(con.sql(queries.P6_SQL).fetchall())


def test_sentences_far_into_a_text_are_sampled(spark):
    text = "1 2. " * 1000 + "The river runs slowly past the old village church. Nobody remembers who built the wooden bridge."
    df = spark.createDataFrame([(i, text, "en") for i in range(6)], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model is not None and set(model.languages) == {"en"}


PROFILE = "listing_id long, code string, variant string, size long, category string, brand_id long"


def merged(spark, rows):
    groups = {}
    for r in entities.resolved(spark.createDataFrame(rows, PROFILE)).collect():
        groups.setdefault(r.item, set()).add(r.listing_id)
    return sorted(map(sorted, groups.values()))


def test_a_merged_profile_matches_what_its_parts_do_not(spark):
    brand_only, size_only, typed_wrong = (1, "ab123", "", None, "phones", 1), (2, "ab123", "", 64, "phones", None), (3, "ab128", "", 64, "phones", 1)
    assert merged(spark, [brand_only, typed_wrong]) == [[1], [3]]
    assert merged(spark, [size_only, typed_wrong]) == [[2], [3]]
    assert merged(spark, [brand_only, size_only, typed_wrong]) == [[1, 2, 3]]


def test_contradicting_profiles_stay_apart(spark):
    rows = [
        (1, "ab123", "", 64, "phones", 1), (2, "ab123", "", 64, "phones", 1), (3, "ab123", "", 64, "kettles", 7), (4, "ab123", "", 64, "phones", 2),  # other category, other maker
        (5, "ab123", "pro", 64, "phones", 1), (6, "ab123", "", 128, "phones", 1),  # other variant, other size
        (7, "cd456", "", None, "phones", 1), (8, "cd456", "", None, "kettles", 1), (9, "cd456", "", None, "phones", 1),  # size unknown to all
        (10, None, "", 64, "phones", 1), (11, None, "", 64, "phones", 1), (12, "ab123", "", 64, None, None),  # no code; two makers to choose from
    ]
    assert merged(spark, rows) == [[1, 2], [3], [4], [5], [6], [7, 9], [8], [10], [11], [12]]


def test_rounds_follow_a_chain_to_its_end(spark):
    # Each listing's code is one sign off from the next pair's, and only the merged pair can draw it in.
    rows = [(1, "ab111", "", 64, "phones", 1), (2, "ab112", "", 64, "phones", 1), (3, "ab112", "", 64, None, 1), (4, "ab122", "", None, "phones", 1)]
    assert merged(spark, rows) == [[1, 2, 3], [4]]
    assert merged(spark, []) == []


def test_pairs_of_a_hot_item(spark):
    items = spark.createDataFrame([(i, "hot") for i in range(60)] + [(100, "x"), (101, "x"), (102, "y")], "listing_id long, item string")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60)} | {(100, 101)}
    got = [tuple(r) for r in entities.pairs_of(items, hot_item=10).collect()]
    assert len(got) == len(want) and set(got) == want


def test_listings_without_visits(spark):
    listing = spark.createDataFrame([(1, "https://a/1", "Maker Lumo AB1234 64GB", 5), (2, "https://b/1", "Lumo AB-1234 64 gb Maker", 5), (3, "https://c/1", "Lumo AB1234 128GB", 5)], "id long, url string, title_on_merchant string, product_id long")
    raw = spark.createDataFrame([], "seq long, url string, title string, description string, category_slug string, merchant_slug string")
    parsed = spark.createDataFrame([], "seq long, specs string, brand string")
    products = spark.createDataFrame([(5, "maker|lumo-ab1234|64gb", "phones", "Maker"), (6, "maker|lumo-ab1235|128gb", "phones", "Maker")], "id long, canonical_key string, category_slug string, brand string")
    reference = spark.createDataFrame([("storage", "gb", 1.0, "gb"), ("ram", "gb", 1.0, "gb")], "quantity string, unit_symbol string, factor_to_common double, common_unit string")
    brands = spark.createDataFrame([(1, "Maker", None)], "brand_id long, brand_name string, also_sold_as string")
    assert {tuple(x) for x in entities.pairs_of(entities.same_items(listing, raw, parsed, products, reference, brands)).collect()} == {(1, 2)}
