import random

import pytest
from pyspark.sql import functions as F

from stallwise.llm.brands import NameTrie, allowed_distance, mapped_names, match_name
from stallwise.llm.folding import compact


def distance(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours, by the plain table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_brute_force():
    r = random.Random(3)
    names = [(i, "".join(r.choice("abc") for _ in range(r.randrange(1, 9)))) for i in range(120)]
    trie = NameTrie(names)
    for _ in range(150):
        word = "".join(r.choice("abcd") for _ in range(r.randrange(0, 9)))
        for most in (0, 1, 2, 3):
            want = {i: distance(word, n) for i, n in names if distance(word, n) <= most}
            assert trie.within(word, most) == want


@pytest.mark.parametrize(
    "name, entry",
    [
        ("Moamirin", 1), (" MOAMIRIN ", 1), ("Ｍｏａｍｉｒｉｎ", 1), ("Mоamirin", 1), ("M0amirin", 1), ("Moamirn", 1), ("Maomirin", 1), ("New Moamirin", 1), ("Moamirin Ltd", 1), ("Moamirin Juva A13", 1),
        ("Quouzidor", 2), ("Audio Sakivik", 3), ("S. Audio", 3), ("Sakivi", 3), ("Fidreovik", 4), ("TQM™", 5), ("TQN", 0), ("Unbranded", 0), ("", 0), ("---", 0), ("x" * 5000, 0),
    ],
)
def test_names(name, entry):
    trie = NameTrie([(1, "Moamirin"), (2, "Quöuzidor"), (3, "Sakivik Audio"), (4, "Teneon"), (4, "Fidreovik"), (5, "TQM"), (6, "")])
    assert match_name(trie, name) == entry


def test_table(spark):
    reference = spark.createDataFrame([(1, "Moamirin", None, "x"), (2, "Teneon", "Fidreovik; ;Abc", "y"), (3, None, None, "z")], "brand_id long, brand_name string, also_sold_as string, brand string")
    df = spark.createDataFrame([("moamirin", 9), ("moamirin", 9), (None, 8), ("fidreovik", 7)], "brand string, brand_name int")
    assert sorted((r.brand or "", r.brand_id) for r in mapped_names(df, "brand", reference).collect()) == [("", 0), ("fidreovik", 2), ("moamirin", 1), ("moamirin", 1)]
    assert mapped_names(df.limit(0), "brand", reference).count() == 0
    assert {r.brand_id for r in mapped_names(df, "brand", reference.limit(0)).collect()} == {0}
    assert df.filter(F.col("brand").isNotNull()).count() == 3 and allowed_distance(3) == 0 and compact("A-b 1") == "ab1"
