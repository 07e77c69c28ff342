"""Tables whose rows repeat a few texts and sizes: few rows are met, and results are as by brute force."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import candidates, competitors, features, training
from larkspur.plans import binding, catalogue, pipeline
from larkspur.sources import scratch

from .test_engine import master, offers


def test_offers_meet_a_few_rows_of_each_text_and_size(spark):
    m = master(spark, *((f"R{i}", f"CHICKEN {('NUGGETS', 'STRIPS')[i % 2]}", "Chicken", f"{(400, 900)[i // 2 % 2]}g") for i in range(400)))
    o = offers(spark, *(("Chicken Nuggets", "Chicken", "b", pack) for pack in ("400g", "410g", "900g", "5kg", "")))
    met = candidates.fits(o.select("category", "offer_measures"), m.withColumnRenamed("match_text", "master_match_text"), 3)
    assert met.groupBy("__category", "__sizes", "__text", "pack_status").count().agg(F.max("count")).first()[0] == 3
    assert met.count() <= 5 * 2 * 2 * 3  # sizes of offers, texts, packs that fit or don't
    got = {(r["offer_ord"], r["candidate_rank"]): r["itemcode"] for r in candidates.candidates(o, m, 3).collect()}
    assert got == {(i, k + 1): f"R{code}" for i, codes in enumerate(((0, 4, 8), (0, 4, 8), (2, 6, 10), (0, 2, 4), (0, 2, 4))) for k, code in enumerate(codes)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Line items with equal numbers: the same line twice, and one whose part number carries into another's."""
    d = str(tmp_path_factory.mktemp("lines"))
    put = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{d}/{name}.parquet")
    put("part", [(1, "red bolt", "Brand#1", "SMALL", 7), (2, "blue ring", "Brand#2", "SMALL", 20), (1000001, "old plate", "Brand#9", "LARGE", 30)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    lines = [(5, 2, 1, 1, 10.0), (5, 2, 1, 2, 10.0), (5, 1, 1000001, 1, 12.5), (6, 1, 2, 1, 3.0), (7, 1, 2, 2, 4.0), (7, 2, 1000001, 2, 1.0)]
    put("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double")
    put("supplier", [(1, "Shop 1", 0), (2, "Shop 2", 1)], "s_suppkey long, s_name string, s_nationkey int")
    put("nation", [(0, "FR"), (1, "DE")], "n_nationkey int, n_name string")
    return d


def test_features_of_offers_with_equal_numbers(spark, tables):
    """The SQL joins a key's first number with all offers that bear it."""
    rows = [(r["offer_ord"], r["Itemcode"], r["unit_pack_weight_g"]) for r in catalogue.pair_features(spark, tables).collect()]
    assert sorted(rows) == [(52000001, "1", 7.0)] * 3 + [(61000002, "2", 20.0)]


def test_mapping_of_offers_is_neither_stored_nor_shuffled(spark, tables):
    """Few keys are sent to the offers; a run of one result writes no table of all offers."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mapped = catalogue.engine_run(spark, tables).mapped
        assert not hasattr(mapped, "_larkspur_path")
        joined = mapped._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [knownfloatingpointnormalized" in joined or "LeftOuter, BuildRight" in joined
        assert mapped.count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_features_are_made_once_for_equal_pairs(spark, monkeypatch):
    row = ("Chicken Nuggets 400g", "Chicken", None, "", "CHICKEN NUGGETS", "", "", "400g x 20", None)
    kind = "`Offer Name` string, Product string, Variant string, `Base Packsize` string, Itemname string, `Item-Cat-4` string, `Item Description` string, `Item-Spec` string, master_measures_detailed array<struct<v: double, d: string, c: int>>"
    joined = spark.createDataFrame([row] * 50 + [("Fish Fillet", *row[1:])], kind).withColumn("record_id", F.monotonically_increasing_id())
    counted = []
    monkeypatch.setattr(training, "add_features", lambda df, own=None: counted.append(df.count()) or features.add_features(df, own))
    got = training.featured_once(joined).select("record_id", *features.FEATURES)
    assert counted == [2]
    assert sorted(map(str, got.collect())) == sorted(map(str, features.add_features(joined).select("record_id", *features.FEATURES).collect()))


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Line items of parts that repeat three texts of own and other brands, in two countries."""
    d = str(tmp_path_factory.mktemp("repeated"))
    put = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{d}/{name}.parquet")
    texts = [("red bolt", "Brand#1", "SMALL", 7), ("red bolt", "Brand#5", "SMALL", 7), ("old red bolt", "Brand#6", "SMALL", 7), (None, "Brand#6", "SMALL", 7)]
    put("part", [(i, *texts[i % 4]) for i in range(40)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    put("lineitem", [(900 - i, i % 7, i * 11 % 40, i % 3, float(i)) for i in range(600)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double")
    put("supplier", [(i, f"Shop {i}", i % 2) for i in range(3)], "s_suppkey long, s_name string, s_nationkey int")
    put("nation", [(0, "FR"), (1, "DE")], "n_nationkey int, n_name string")
    return d


def rows_of(df, *without):
    return sorted(str({k: v for k, v in r.asDict().items() if k not in without}) for r in df.collect())


def test_first_offers_are_the_first_of_each_text_and_country(spark, repeated):
    everything, few = binding.offers(spark, repeated), binding.first_offers(spark, repeated)
    key = ["Country", "Offer Name", "Product", "Brand Name", "Variant", "Base Packsize"]
    first = {tuple(r[k] for k in key): r["offer_ord"] for r in everything.groupBy(*(f"`{k}`" for k in key)).agg(F.min("offer_ord").alias("offer_ord")).collect()}
    assert everything.count() == 600
    assert {tuple(r[k] for k in key): r["offer_ord"] for r in few.collect()} == first and few.count() == len(first) == 8
    assert rows_of(few, "offer_ord") == rows_of(everything.select(few.columns).drop("offer_ord").distinct())
    own = binding.first_offers(spark, repeated, own=True)
    assert rows_of(own) == rows_of(few.where("is_own")) and own.count() == 2


@pytest.mark.parametrize("sent", [(0, 0), (0, 40_000), (2_500_000, 40_000)])
def test_offers_are_the_same_however_texts_come_to_line_items(spark, repeated, monkeypatch, sent):
    plain = binding.with_lines(binding.prepare_offers(binding.offer_texts(spark, repeated), binding.OWN).withColumn("category", F.col("Product")), repeated)
    monkeypatch.setattr(binding, "PARTS_SENT", sent[0])
    monkeypatch.setattr(binding, "TEXTS_SENT", sent[1])
    assert rows_of(binding.offers(spark, repeated).select(plain.columns)) == rows_of(plain)
    assert binding.first_offers(spark, repeated).count() == 8


@pytest.mark.parametrize("name", ["competitor_offers", "competitor_long", "competitor_export", "detailed_mapping", "top_candidates"])
def test_no_table_of_all_offers_is_stored(spark, repeated, monkeypatch, name):
    rows, store = [], scratch.stored

    def counted(df, *more):
        out = store(df, *more)
        rows.append(out.count())
        return out

    for module in (binding, candidates, competitors, pipeline, scratch):
        if hasattr(module, "stored"):
            monkeypatch.setattr(module, "stored", counted)
    got = catalogue.QUERIES[name](spark, repeated).count()
    assert got == {"competitor_offers": 4, "competitor_long": 4, "competitor_export": 40, "detailed_mapping": 600, "top_candidates": 3}[name]
    assert rows and max(rows) <= 64  # 40 parts, 8 first offers, and pairs of these


def test_keys_of_own_offers_come_from_first_offers(spark, repeated, monkeypatch):
    """Not from a table of all own offers."""
    seen = []
    monkeypatch.setattr(catalogue.c, "unique_keys", lambda offers: seen.append(offers.count()) or candidates.stored(offers.limit(1)))
    catalogue.top_candidates(spark, repeated)
    assert seen == [2]


def test_competitors_among_first_offers_are_those_among_all(spark, repeated):
    assert rows_of(catalogue.engine_run(spark, repeated, firsts=True).competitors) == rows_of(catalogue.engine_run(spark, repeated).competitors)
    one, other = catalogue.engine_run(spark, repeated, firsts=True), catalogue.engine_run(spark, repeated)
    assert rows_of(one.mapping) == rows_of(other.mapping)


def test_summaries_come_to_offers_without_a_shuffle(spark, repeated):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.detailed_mapping(spark, repeated)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin [") == 1 and plan.count("BroadcastHashJoin") >= 4  # shops with their countries
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
