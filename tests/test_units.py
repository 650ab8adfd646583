import pytest
from pyspark.sql import functions as F

from stallwise.operators.units import common_quantities, parse_number

REFERENCE = [
    ("storage", "gb", 1.0, "gb"), ("storage", "tb", 1024.0, "gb"), ("storage", "mb", 0.0009765625, "gb"), ("ram", "gb", 1.0, "gb"), ("ram", "mb", 0.0009765625, "gb"),
    ("screen", "mm", 1.0, "mm"), ("screen", "in", 25.4, "mm"), ("screen", "cm", 10.0, "mm"), ("volume", "ml", 1.0, "ml"), ("volume", "l", 1000.0, "ml"),
    ("mass", "g", 1.0, "g"), ("mass", "kg", 1000.0, "g"), ("mass", "lb", 453.592, "g"),
]


def quantities(spark, parsed, raw):
    reference = spark.createDataFrame(REFERENCE, "quantity string, unit_symbol string, factor_to_common double, common_unit string")
    parsed = spark.createDataFrame(parsed, "seq long, specs string, title string")
    raw = spark.createDataFrame(raw, "seq long, title string, category_slug string, merchant_slug string, specs string")
    return {(r.seq, r.quantity): (r.common_value, r.in_order) for r in common_quantities(parsed, raw, reference).collect()}


@pytest.mark.parametrize("text, value", [("3,000", 3000.0), ("2,1", 2.1), ("0,065", 0.065), ("1.5", 1.5), ("1.234,5", 1234.5), ("12,345.5", 12345.5), ("x", None), ("", None), (None, None)])
def test_numbers(spark, text, value):
    assert spark.range(1).select(parse_number(F.lit(text).cast("string")).alias("n")).first().n == value


def test_fixture(spark):
    known = [(i, '{"screen": "6.8 in", "storage": "256 GB", "ram": "8GB"}', None) for i in range(100, 130)]
    titles = [(i, "Phone 6.8in 256GB Storage 8GB RAM", "phones", "m", None) for i in range(100, 130)]
    parsed = [
        (1, '{"screen_mm": 6.8}', None),  # inches under the wrong name
        (2, "{'storage_gb': 256, 'ram': 8192}", None),  # sloppy notation; memory in MB
        (3, '{"screen_mm": 173}', None),  # in order
        (4, None, None),
        (5, "", None),
        (6, '{"screen": "17,3 cm", "colour": "5 in"}', None),
        (8, '{"storage": "n/a"}', None),
        (9, '{"storage_gb": 0}', None),
    ]
    raw = [(i, None, "phones", "m", "clash") for i in (1, 2, 3, 6, 9)]
    raw += [(4, "5G phone 8/256GB + 1 year " + "x" * 20_000, "phones", None, None), (7, "Phone 0.25 TB", "phones", "m", None), (8, "512GB", None, None, None), (7, "Phone 0.25 TB", "phones", "m", None)]
    got = quantities(spark, parsed + known, raw + titles)
    assert got[1, "screen"] == (173, False)
    assert got[2, "storage"] == (256, True) and got[2, "ram"] == (8, False)
    assert got[3, "screen"] == (173, True)
    assert got[4, "storage"] == (256, False) and got[4, "ram"] == (8, False) and (4, "mass") not in got
    assert got[6, "screen"] == (173, False)
    assert got[7, "storage"] == (256, False)
    assert got[8, "storage"] == (512, False)
    assert not [k for k in got if k[0] in (5, 9)]
    assert got[100, "screen"] == (173, False)


def test_empty(spark):
    assert quantities(spark, [], []) == {}


def test_memory_is_no_network(spark):
    raw = [(1, "Phone 4GB RAM 64GB 5G", "phones", "m", None), (2, "Router 5G 300 g", "phones", "m", None)]
    got = quantities(spark, [], raw)
    assert got == {(1, "ram"): (4, False), (1, "storage"): (64, False), (2, "mass"): (300, False)}
