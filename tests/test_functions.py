"""Values of the scalar functions, on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import measures as m
from larkspur.functions import similarity as s
from larkspur.functions import text as t


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "total", "unit", "want"),
    [
        ("2 x 500g", True, True, [(500.0, "weight", 1), (1000.0, "weight", 2)]),
        ("270 Gms x 20 Pkts", False, True, [(270.0, "weight", 1)]),
        ("1,5kg", True, True, [(15000.0, "weight", 1)]),
        ("750g + 250g", True, True, [(250.0, "weight", 1), (750.0, "weight", 1)]),
        ("500g x 12.5kg", True, True, [(500.0, "weight", 1), (6000.0, "weight", 12), (12500.0, "weight", 1)]),
        ("1L", True, True, [(1000.0, "volume", 1)]),
        ("250/500 g", True, True, [(250.0, "weight", 1), (500.0, "weight", 1)]),
        (None, True, True, []),
        ("40000 g", True, True, []),
    ],
)
def test_measures(text, total, unit, want):
    assert m.measures_of(text, total, unit) == want


def test_packs(spark):
    def flags(a, b):
        sizes = spark.range(1).select(m.offer_measures(F.lit(a)).alias("a"), m.master_measures(F.lit(b)).alias("b"))
        return tuple(sizes.select(m.pack_compatible(m.simple(F.col("a")), m.simple(F.col("b"))), m.pack_structure(F.col("a"), F.col("b"))).first())

    assert flags("400g", "400 Gms x 20 Pkts") == (True, True)
    assert flags("400g", "1 kg x 10 Pkts") == (False, None)
    assert flags("2 x 500g", "1kg") == (True, False)
    assert flags("1L", "1kg") == (False, None)
    assert flags("", "1kg") == (None, None)


def test_numbers_in_texts(spark):
    assert one(spark, m.piece_count(F.lit("Nuggets 20 pcs"))) == 20
    assert one(spark, m.piece_count(F.lit("Nuggets x 20"))) == 20
    assert one(spark, m.piece_count(F.lit("2 x 500 g"))) is None
    for text, want in [("2 x 500 g", None), ("2 x 500g", None), ("2 x 12.5kg", 12), ("30's box", 30), ("6 Pieces", 6), ("x 20 pc", 20), ("x20", 20), ("x 20abc", None), ("box 20", None), ("x 5 x 500 g", 5), ("a1’s", None), ("12PCS x 3", 12), (None, None)]:
        assert one(spark, m.piece_count(F.lit(text).cast("string"))) == want, text
    for text, want in [("1.5 kg + 1,000 g", None), ("2lb+1 oz", 28.3495), ("250g+", None), ("+250g", None), ("1kg+2kg+3g", 2000)]:
        assert one(spark, m.bonus_weight(F.lit(text))) == want, text
    for text, want in [("20 x 270 g", 20), ("1,200g × 6", 6), ("6 * 1.5l", 6), ("20 x 5 g x 3", 3), ("20 pkts", None)]:
        assert one(spark, m.units_per_carton(F.lit(text))) == want, text
    assert one(spark, m.bonus_weight(F.lit("Nuggets 750g + 250g"))) == 250
    assert one(spark, m.bonus_weight(F.lit("1l + 250ml"))) is None
    assert one(spark, m.units_per_carton(F.lit("270 Gms x 20 Pkts"))) == 20
    assert one(spark, m.unit_count(m.offer_measures(F.lit("2 x 500g")))) == 2
    assert one(spark, m.total_weight(m.offer_measures(F.lit("2 x 500g")))) == 1000
    assert one(spark, m.retail_weight(m.offer_measures(F.lit("2 x 500g")))) == 500
    assert one(spark, m.retail_weight(m.offer_measures(F.lit("")))) is None


def test_texts(spark):
    assert one(spark, t.normalized_brand(F.lit(" North-Star Foods! "))) == "north star foods"
    assert one(spark, t.clean_offer(F.lit("North-Star New Chicken Nuggets 400 Gms Offer"), r"north[\s\-]?star")) == "chicken nuggets"
    assert one(spark, t.clean_offer(F.lit(None))) == ""
    assert one(spark, t.category(F.lit("corned beef"))) == "Meat"
    assert one(spark, t.category(F.lit("veg spring rolls"))) == "Dough"
    assert one(spark, t.category(F.lit("cornflakes"))) == "Other"
    assert one(spark, t.master_category(F.lit("Seafood-ZING"))) == "Seafood"
    assert one(spark, t.product_family(F.lit("Chicken Nugget-Frozen"))) == "chicken nuggets"
    assert one(spark, t.itemcode(F.lit(" 001.0 "))) == "001"
    assert one(spark, t.itemcode(F.lit("  "))) is None
    assert [one(spark, t.training_flag(F.lit(x))) for x in ("1.0", "TRUE", "no", "maybe")] == [1, 1, 0, None]
    assert [one(spark, t.pair_label(F.lit(x))) for x in ("1.0", " -1 ", "0.5", "positive")] == [1, -1, None, None]
    assert one(spark, t.offer_display(F.lit("A\nb"), F.lit("R"), F.lit(10.0))) == "A b — R — SAR 10"
    assert one(spark, t.offer_display(F.lit("A"), F.lit("R"), F.lit(None).cast("double"))) == "A — R — N/A"


def test_semantics(spark):
    assert set(one(spark, t.families(F.lit("Spicy chicken nuggets")))) == {"chicken nuggets", "nuggets"}
    assert set(one(spark, t.variants(F.lit("Non-spicy chicken")))) == {"non spicy", "spicy"}
    assert one(spark, t.agree(t.proteins(F.lit("chicken")), t.proteins(F.lit("beef")))) == 0
    assert one(spark, t.agree(t.proteins(F.lit("")), t.proteins(F.lit("beef")))) == 1
    assert one(spark, t.expected_matches(F.lit("Chicken nuggets / beef burger"))) == 2
    assert one(spark, t.expected_matches(F.lit("750g+250g"))) == 1


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_similarity():
    pairs = [("", ""), ("", "a"), ("chicken nuggets", "nuggets chicken"), ("beef burger", "beef burgers 400"), ("abcde" * 20, "badce" * 17)]
    for a, b in pairs:
        assert s.common(a, b) == slow_common(a, b)
    assert s.ratio("", "") == 100
    assert s.token_sort("chicken nuggets", "nuggets chicken") == 100
    assert s.token_set("chicken nuggets", "spicy chicken nuggets") == 100
    assert s.token_set("", "a") == 0
    assert s.weighted("nuggets", "nuggets") == 100
    assert s.partial("nugget", "chicken nuggets") == 100
