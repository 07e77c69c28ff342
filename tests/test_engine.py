"""Candidates, tiers, competitors, exports, training and sources on small tables."""

import io
import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larkspur.functions import similarity
from larkspur.operators import audit, candidates, exports, features, rules, scoring, training, validate
from larkspur.operators.prepare import OwnBrand, prepare_master, prepare_offers
from larkspur.plans import binding, catalogue, config, pipeline
from larkspur.sources import readers, scratch, sinks, xlsx
from larkspur.streaming.scoring import match_stream

OWN = OwnBrand(("north star",), r"north[\s\-]?star")
OFFER = ["offer_ord", "Offer Name", "Product", "Brand Name", "Variant", "Base Packsize", "Country", "Retailer Name", "Offer Price"]
MASTER = ["master_ord", "Itemcode", "Itemname", "Item-Cat-2", "Item-Cat-4", "Item Description", "Item-Spec"]


def offers(spark, *rows):
    data = [(i, name, product, brand, "No Variant", pack, "SA", "Shop", 10.0) for i, (name, product, brand, pack) in enumerate(rows)]
    return prepare_offers(spark.createDataFrame(data, OFFER), OWN)


def master(spark, *rows):
    return prepare_master(spark.createDataFrame([(i, code, name, group, "", name, spec) for i, (code, name, group, spec) in enumerate(rows)], MASTER))


def best(spark, o, m):
    return {r["offer_ord"]: r for r in pipeline.match(o, m).collect()}


def test_exact_match_and_category_gate(spark):
    m = master(spark, ("CH-400", "CHICKEN NUGGETS", "Chicken", "400g x 20"), ("CH-750", "CHICKEN STRIPS", "Chicken", "750g x 20"), ("BF", "CHICKEN NUGGETS", "Meat", "400g"))
    r = best(spark, offers(spark, ("North Star Chicken Nuggets 400g", "Chicken Nuggets-Frozen", "North-Star", "400g"), ("x", "Chicken", "b", "1kg"), ("Fish Fillet", "Fish", "b", "")), m)
    assert r[0]["itemcode"] == "CH-400" and r[0]["adjusted_score"] == r[0]["text_score"] + 4 and r[0]["pack_structure_status"] is True
    assert r[2]["itemcode"] == "NO_MATCH" and r[2]["confidence_tier"] == "no_match_category"


def test_ties_packs_and_fallback(spark):
    two = master(spark, ("FIRST", "CHICKEN NUGGETS", "Chicken", "400g"), ("SECOND", "CHICKEN NUGGETS", "Chicken", "400g"))
    r = best(spark, offers(spark, ("Chicken Nuggets", "Chicken", "b", "400g"), ("Chicken Nuggets", "Chicken", "b", ""), ("Chicken Nuggets", "Chicken", "b", "1kg"), ("Mystery Snack", "Snack", "b", "")), two)
    assert r[0]["itemcode"] == "FIRST" and r[0]["margin"] == 0
    assert r[1]["pack_status"] is None and r[1]["adjusted_score"] == r[1]["text_score"] - 3
    assert r[2]["all_candidates_incompatible"] and r[2]["adjusted_score"] == r[2]["text_score"]
    assert r[2]["confidence_tier"] == "low_pack_conflict"
    assert r[3]["category"] == "Other" and r[3]["confidence_tier"] == "no_match"
    short = best(spark, offers(spark, ("Nuggets", "", "b", "")), master(spark, ("A", "SNACK BAR", "Other", "")))
    assert short[0]["confidence_tier"] == "no_match_empty_text"
    with pytest.raises(ValueError):
        candidates.candidates(offers(spark, ("a b", "c", "d", "")), two, 0)


def test_rules(spark):
    base = {"itemcode": "A", "itemname": "a", "text_score": 90.0, "adjusted_score": 94.0, "margin": 10.0, "raw_margin": 10.0, "pack_status": True, "pack_structure_status": True, "category": "Chicken", "all_candidates_incompatible": False, "confidence_tier": None, "master_match_text": "", "master_measures": []}
    kind = "itemcode string, itemname string, text_score double, adjusted_score double, margin double, raw_margin double, pack_status boolean, pack_structure_status boolean, category string, all_candidates_incompatible boolean, confidence_tier string, master_match_text string, master_measures array<struct<v: double, d: string>>"
    cases = [
        ({}, "high"), ({"margin": 0.0}, "medium"), ({"category": "Other", "text_score": 84.0, "margin": 20.0}, "no_match"), ({"category": "Other"}, "no_match"),
        ({"pack_structure_status": False}, "low_structure_conflict"), ({"all_candidates_incompatible": True}, "low_pack_conflict"), ({"pack_status": None, "margin": 20.0}, "medium"),
        ({"text_score": 54.996}, "no_match"), ({"itemcode": "NO_MATCH", "confidence_tier": "no_match_category"}, "no_match_category"),
    ]
    df = spark.createDataFrame([base | x for x, _ in cases], kind)
    assert [r["confidence_tier"] for r in rules.tiers(df).collect()] == [want for _, want in cases]


def test_features(spark):
    row = spark.createDataFrame([("Chicken Nuggets 20 pcs 750g + 250g", "Chicken", "", "2 x 500g", "CHICKEN NUGGETS", "", "", "270 Gms x 20 Pkts")], ["Offer Name", "Product", "Variant", "Base Packsize", "Itemname", "Item-Cat-4", "Item Description", "Item-Spec"])
    r = features.add_features(row).first()
    assert [r[c] for c in ("unit_pack_weight_g", "number_of_units", "bonus_weight_g", "total_offer_weight_g", "piece_count", "master_unit_weight_g", "master_units_per_carton")] == [250, 2, 250, 1000, 20, 270, 20]
    assert (r["protein_match"], r["family_match"], r["expected_match_count"]) == (1, 1, 2)


def test_whole_run(spark):
    m = master(spark, ("1", "CHICKEN NUGGETS", "Chicken", "400g"), ("2", "BEEF BURGER", "Meat", "500g"))
    o = offers(spark, ("North Star Chicken Nuggets", "Chicken Nuggets", "North Star", "400g"), ("Chicken Nuggets Crispy", "Chicken Nuggets", "Rival", "400g"), ("Chicken Nuggets", "Chicken Nuggets", "Other Rival", "1kg"))
    done = pipeline.run_prepared(o, m, lambda df: df.withColumn("ml_probability", F.lit(0.99)), own=OWN)
    rows = {r["offer_ord"]: r for r in done.mapped.collect()}
    assert rows[0]["matched_itemcode"] == "1" and rows[0]["confidence_tier"] == "high (ml)"
    assert rows[1]["confidence_tier"] == "n/a" and rows[1]["ml_decision"] == "N/A"
    assert [(r["Competitor Brand"], r["Rank"], r["Own Retail Unit"]) for r in done.long_table.collect()] == [("Rival", 1, "400g")]
    exports.validate_offer_export(done.offer_export, m)
    assert done.offer_export.collect()[0]["Confirmed Matched Offers"] == "1. North Star Chicken Nuggets — Shop — SAR 10"
    assert done.competitor_export.collect()[0]["Competitor Offers"] == "1. Chicken Nuggets Crispy (400g)"
    assert {r["competitor_matches"][:6] for r in done.mapping.collect()} == {"Rival:", "Not co"}


GOLD = "record_id string, offer_group_id string, offer_text string, master_itemcode string, pair_label string, use_for_binary_pair_training string, source_dataset string, recommended_split string"


def gold(spark):
    return spark.createDataFrame(
        [
            ("1", "g1", "Chicken Nuggets 400g", "001.0", "1", "1", "manual", "train"), ("2", "g1", "Chicken Nuggets 400g", "001", "0", "true", "manual", "test"),
            ("3", "g2", None, "001", "bad", "1", "SYNTHETIC", ""), ("4", "g3", "Same", "UNKNOWN", "-1", "0", "SYNTHETIC", "train"),
            ("5", "g4", " same ", None, "1", "maybe", "synthetic v2", "train"),
        ],
        GOLD,
    )


def raw_master(spark):
    return spark.createDataFrame([(0, " 001 ", "CHICKEN NUGGETS", "Chicken", "", "", "400g")], MASTER)


def test_training_and_audit(spark, tmp_path):
    built = training.build(gold(spark), raw_master(spark))
    assert built.eligible_binary_rows == 2 and built.accepted.columns[-19:] == features.FEATURES
    assert {r["record_id"]: r["rejection_reason"] for r in built.rejected.collect()} == {
        "3": "invalid_pair_label;null_offer_text", "4": "use_for_binary_pair_training_not_1;abstain_pair_label;unknown_master_itemcode", "5": "invalid_use_for_binary_pair_training;missing_master_itemcode",
    }
    found = built.audit
    assert found["duplicate_offer_master_pairs"]["row_count"] == 2 and found["conflicting_labels"]["pair_count"] == 1
    assert found["offer_groups_across_recommended_splits"]["group_count"] == 1 and found["invalid_labels"]["row_count"] == 1
    assert found["unknown_master_skus"]["unique_codes"] == ["UNKNOWN"] and found["null_offer_text"]["row_count"] == 1
    assert found["repeated_synthetic_templates"]["template_count"] == 1
    paths = sinks.write_training(built, str(tmp_path))
    assert open(paths["rejected"], "rb").read(3) == b"\xef\xbb\xbf" and json.load(open(paths["manifest"]))["accepted_rows"] == 2
    again = spark.read.options(header=True).csv(paths["csv"])
    assert again.columns == built.accepted.columns and {r["record_id"] for r in again.collect()} == {"1", "2"}
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        sinks.write_training(built, str(tmp_path))
    sinks.write_training(built, str(tmp_path), overwrite=True)


def test_exact_offers_enrich_gold(spark):
    known = spark.createDataFrame([("chicken  NUGGETS 400g", "Chicken", "Hot", "400g")], training.OFFER_COLUMNS)
    assert training.build(gold(spark), raw_master(spark), known).offer_reconstruction_counts == {"exact_offer": 2, "synthetic_or_text_fallback": 0}
    twice = known.unionAll(known.withColumn("Variant", F.lit("Mild")))
    assert training.build(gold(spark), raw_master(spark), twice).offer_reconstruction_counts["exact_offer"] == 0


def test_validation(spark):
    with pytest.raises(validate.InputValidationError, match="Itemname"):
        validate.validate_master(spark.createDataFrame([("1",)], ["Itemcode"]))
    two = spark.createDataFrame([(i, c, "a", "b", "c", "d", "e") for i, c in enumerate(["001.0", "001"])], MASTER)
    with pytest.raises(validate.DuplicateItemCodeError, match="duplicate Itemcode: 001"):
        validate.validate_master(two)
    with pytest.raises(validate.EmptyInputError):
        validate.validate_master(two.limit(0))
    with pytest.raises(validate.InputValidationError, match="pair_label"):
        validate.validate_gold(gold(spark))
    good = validate.validate_gold(gold(spark).where("record_id in ('1', '2')"))
    assert [tuple(r) for r in good.select("pair_label", "use_for_binary_pair_training", "master_itemcode").orderBy("record_id").collect()] == [(1, 1, "001"), (0, 1, "001")]
    assert audit.empty_texts(audit.normalized(gold(spark))).count() == 1


def workbook() -> bytes:
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Itemcode</t></si><si><t>Itemname</t></si><si><t>001</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c></row><row r="3"><c r="A3"><v>12345.0</v></c><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "m.xlsx").write_bytes(workbook())
    assert [tuple(r) for r in xlsx.read_xlsx(spark, str(tmp_path / "m.xlsx")).orderBy("__row").collect()] == [("001", None, 1), ("12345", "x", 2)]
    with pytest.raises(FileNotFoundError, match="Input file not found"):
        readers.load_offers(spark, str(tmp_path / "none.csv"))
    with pytest.raises(readers.UnsupportedFileTypeError):
        readers.load_master(spark, str(tmp_path / "m.txt"))
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(validate.EmptyInputError):
        readers.load_offers(spark, str(tmp_path / "e.csv"))
    header = "Offer Name,Product,Brand Name,Variant,Base Packsize,Country,Retailer Name,Flyer Name,offerid,Offer Price,Regular Price\n"
    (tmp_path / "o.csv").write_text("﻿" + header + '"two\nlines",P,B,V,1kg,C,R,F,001,10.5,\n')
    row = readers.load_offers(spark, str(tmp_path / "o.csv")).first()
    assert (row["Offer Name"], row["offerid"], row["Offer Price"], row["Regular Price"]) == ("two\nlines", "001", 10.5, None)


SETTINGS = """
data: {offers_path: o.csv, master_path: m.csv, gold_pairs_path: g.csv}
model: {}
output: {output_dir: out}
matching: {category_other_min_score: 85, category_other_min_margin: 12, normal_min_score: 55, pack_compatible_bonus: 4, pack_unknown_penalty: -3, high_score_threshold: 80,
  high_margin_threshold: 8, medium_score_threshold: 65, medium_margin_threshold: 6, auto_match_threshold: 0.95, manual_review_threshold: 0.7}
competitors: {raw_score_floor: 60, adjusted_score_floor: 65, max_per_target: 5}
runtime: {random_seed: 42, log_level: INFO, output_encoding: utf-8-sig}
"""


@pytest.mark.parametrize(("old", "new"), [("threshold: 0.95", "threshold: 0.7"), ("threshold: 0.95", "threshold: 1.5"), ("o.csv", "' '"), ("seed: 42", "seed: 1.5"), ("INFO", "LOUD"), ("utf-8-sig", "no-such"), ("model: {}", "")])
def test_bad_settings(tmp_path, old, new):
    (tmp_path / "c.yaml").write_text(SETTINGS)
    assert config.load_config(str(tmp_path / "c.yaml")).offers_path == str(tmp_path / "o.csv")
    (tmp_path / "c.yaml").write_text(SETTINGS.replace(old, new))
    with pytest.raises(config.ConfigError):
        config.load_config(str(tmp_path / "c.yaml"))


def test_unknown_codes_are_those_of_no_part(spark, tmp_path):
    """The whole catalogue is looked up, whatever its size."""
    part = [(i, f"part {i}", "Brand#1", "STEEL", 5, 1.0) for i in range(300)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, i % 9) for i in range(600)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    held = {str(p[0]) for p in part}
    codes = {r["record_id"]: r["code"] for r in audit.normalized(binding.gold(spark, str(tmp_path))).collect()}
    unknown = {k for k, c in codes.items() if c is not None and c not in held}
    assert unknown and {k for k, c in codes.items() if c in held}
    reasons = {r["record_id"]: r["reasons"] for r in catalogue.rejection_reasons(spark, str(tmp_path)).collect()}
    assert {k for k, r in reasons.items() if "unknown_master_itemcode" in r} == unknown
    assert {r["record_id"] for r in catalogue.audit_unknown_codes(spark, str(tmp_path)).collect()} == unknown | {k for k, c in codes.items() if c is None}


def test_one_offer(spark):
    m = master(spark, ("A", "CHICKEN NUGGETS", "Chicken", "400g"), ("B", "CHICKEN STRIPS", "Chicken", "400g"), ("C", "CHICKEN WINGS", "Chicken", "2kg"))
    one = offers(spark, ("Chicken Strips", "Chicken", "b", "400g")).drop("offer_ord")
    assert [r["itemcode"] for r in candidates.top_candidates(one, m, 5).collect()] == ["B", "A"]
    assert candidates.best_candidate(one, m)["itemcode"] == "B"
    with pytest.raises(ValueError, match="one offer"):
        candidates.best_candidate(offers(spark, ("a b", "c", "d", ""), ("e f", "g", "h", "")), m)


def fits(a, b):
    near = any(x["d"] == y["d"] and abs(x["v"] - y["v"]) / max(x["v"], y["v"]) <= 0.1 for x in a for y in b)
    return near if a and b else None


def test_candidates_of_mixed_packs(spark):
    """Rows that may fit and rows that don't are ranked apart, and only one of the two lists is used:
    against all pairs, one by one."""
    m = master(spark, *((f"S{i}", f"CHICKEN NUGGETS {'EXTRA ' * i}", "Chicken", "400g" if i % 2 else "2kg") for i in range(9)), ("U", "CHICKEN NUGGETS BOX", "Chicken", ""))
    o = offers(spark, ("Chicken Nuggets", "Chicken", "b", "400g"), ("Chicken Nuggets", "Chicken", "b", "2kg"), ("Chicken Nuggets Extra", "Chicken", "b", "9kg"), ("Chicken Nuggets", "Chicken", "b", ""))
    for items in (m, m.where("Itemcode <> 'U'")):
        for k in (1, 2, 4):
            want = {}
            for x in o.collect():
                rows = [(similarity.words(x["match_text"], y["match_text"]), fits(x["offer_measures"], y["master_measures"]), y) for y in items.collect()]
                rows = [r for r in rows if r[1] is not False] or rows
                ranked = sorted((-(score + {True: 4, False: 0, None: -3}[ok]), y["master_ord"], y["Itemcode"], score) for score, ok, y in rows)
                for i, (adjusted, _, code, score) in enumerate(ranked[:k]):
                    after = ranked[i + 1 : i + 2]
                    want[x["offer_ord"], i + 1] = (code, pytest.approx(-adjusted), pytest.approx(after[0][0] - adjusted if after else 100), pytest.approx(score - after[0][3] if after else 100))
            got = {(r["offer_ord"], r["candidate_rank"]): (r["itemcode"], r["adjusted_score"], r["margin"], r["raw_margin"]) for r in candidates.candidates(o, items, k).collect()}
            assert got == want


def test_exports_keep_catalogue_order(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") * 7 % 50).alias("k")).repartition(6)
    assert [r["k"] for r in exports.in_order(df.orderBy("k")).orderBy("at").collect()] == list(range(50))
    assert sorted(r["at"] for r in exports.in_order(df).collect()) == list(range(50))
    m = master(spark, ("1", "B", "Meat", ""), ("2", "A", "Meat", ""))
    table = m.select(F.concat_ws(" - ", "Itemcode", "Itemname").alias(exports.OFFER_EXPORT[0]), *(F.lit("").alias(c) for c in exports.OFFER_EXPORT[1:]), "master_ord")
    exports.validate_offer_export(table.orderBy("master_ord").drop("master_ord"), m)
    for bad in (table.orderBy(F.desc("master_ord")), table.where("master_ord = 0"), table.unionAll(table)):
        with pytest.raises(ValueError, match="order or content"):
            exports.validate_offer_export(bad.drop("master_ord"), m)
    with pytest.raises(ValueError, match="line breaks"):
        exports.validate_offer_export(table.orderBy("master_ord").drop("master_ord").withColumn(exports.OFFER_EXPORT[2], F.lit("a\nb")), m)


def test_metrics_by_hand(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.3, 1), (None, 1), (1.0, 0)]
    df = spark.createDataFrame(rows, "ml_probability double, pair_label int")
    r = scoring.metrics(df).first()
    assert (r["positives"], r["negatives"], r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 3, 2, 2, 1, 1)
    assert r["roc_auc"] == pytest.approx((2 + 1.5 + 0) / 9)
    assert r["pr_auc"] == pytest.approx((1 / 2 + 2 / 4 + 3 / 6) / 3)
    assert r["f1"] == pytest.approx(4 / 7)
    bins = {x["bin"]: (x["n"], x["share"]) for x in scoring.calibration(df).collect()}
    assert bins == {9: (2, 0.5), 8: (2, 0.5), 4: (1, 0.0), 3: (1, 1.0)}


def test_weights_and_bad_numbers(spark):
    df = spark.createDataFrame([(1, "manual"), (1, "weak"), (0, "Weak "), (0, None)], "pair_label int, label_provenance string")
    weights = [r["weight"] for r in scoring.class_weights(df, by_source={"weak": 0.5}).collect()]
    assert weights == pytest.approx([1, 0.5, 0.5, 1])
    assert sum(weights[:2]) == pytest.approx(sum(weights[2:]))
    odd = spark.createDataFrame([("1", "bad", float("nan"))], "protein_match string, family_match string, variant_match double")
    r = scoring.numbers(odd).first()
    assert (r["protein_match__n"], r["family_match__n"], r["variant_match__n"], r["size_match__n"]) == (1.0, -1.0, -1.0, -1.0)


def test_trained_scorer_decides(spark, tmp_path):
    """A classifier trained on the features tells fitting packs, and is the same after it is saved."""
    rows = []
    for i in range(120):
        good = i % 2 == 0
        rows.append((f"Chicken Nuggets {400 if good else 900}g", "Chicken", "", "", "CHICKEN NUGGETS", "", "", "400g", int(good)))
    df = features.add_features(spark.createDataFrame(rows, ["Offer Name", "Product", "Variant", "Base Packsize", "Itemname", "Item-Cat-4", "Item Description", "Item-Spec", "pair_label"]))
    scorer = scoring.model_scorer(model := scoring.train(df, trees=2))
    got = {(r["pair_label"], r["ml_probability"] > 0.5) for r in scorer(df).collect()}
    assert got == {(0, False), (1, True)}
    scoring.save(model, str(tmp_path / "m"), version=3)
    again, about = scoring.load(spark, str(tmp_path / "m"))
    assert about["version"] == 3 and {(r["pair_label"], r["ml_probability"] > 0.5) for r in again(df).collect()} == got
    with pytest.raises(Exception, match="already exists"):
        scoring.save(model, str(tmp_path / "m"))


OFFERS_CSV = """Offer Name,Product,Brand Name,Variant,Base Packsize,Country,Retailer Name,Flyer Name,offerid,Offer Price,Regular Price
Acme Chicken Nuggets,Chicken Nuggets,Acme,No Variant,400g,SA,Shop,F,1,10,12
Chicken Nuggets,Chicken Nuggets,Rival,No Variant,400g,SA,Shop,F,2,11,12
Acme Beef Burger,Beef Burger,Acme,Spicy,1kg,SA,Mart,F,3,20,
"""
MASTER_CSV = """Itemcode,Itemname,Item-Cat-2,Item-Cat-4,Item Description,Item-Spec
7,CHICKEN NUGGETS,Chicken,,,400g x 20
8,BEEF BURGER,Meat,,,500g x 10
"""
GOLD_CSV = """record_id,offer_group_id,offer_text,master_itemcode,pair_label,use_for_binary_pair_training,source_dataset,label_provenance,label_confidence,recommended_split,split_group,product_class_offer,variant_offer
a,g1,Acme Chicken Nuggets,7,1,1,manual,manual,1,train,g1,,
b,g2,Acme Beef Burger,7,0,1,manual,manual,1,test,g2,,
c,g3,,9,1,1,manual,manual,1,train,g3,,
"""


def test_run_from_files(spark, tmp_path):
    for name, text in (("o", OFFERS_CSV), ("m", MASTER_CSV), ("g", GOLD_CSV), ("c", SETTINGS)):
        (tmp_path / f"{name}.{'yaml' if name == 'c' else 'csv'}").write_text(text + ("own_brand: {aliases: [acme], pattern: acme}\n" if name == "c" else ""))
    settings = config.load_config(str(tmp_path / "c.yaml"))
    paths = pipeline.run_config(spark, settings, "r1")
    report = json.load(open(paths["summary"]))
    assert report["run_id"] == "r1" and report["offers"] == 3 and report["own_offers"] == 2 and sum(report["confidence_tiers"].values()) == 3
    assert set(report["output_hashes"]) == {"offers", "competitors_csv"} and report["thresholds"]["auto_match"] == 0.95
    assert {r["run_id"] for r in spark.read.parquet(paths["mapping"]).collect()} == {"r1"}
    waiting = spark.read.parquet(paths["review_queue"])
    assert waiting.count() == report["decisions"].get("MANUAL_REVIEW", 0)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        pipeline.run_config(spark, settings, "r1")
    assert "r1" not in pipeline.run_config(spark, settings)["summary"].split("/")
    built = training.build_from_paths(spark, settings.gold_pairs_path, settings.master_path, settings.offers_path, str(tmp_path / "t"), "acme")
    manifest = json.load(open(built.output_paths["manifest"]))
    assert (manifest["accepted_rows"], manifest["rejected_rows"], manifest["offer_reconstruction"]["exact_offer"]) == (2, 1, 2)
    assert manifest["exclusion_reasons"] == {"null_offer_text": 1, "unknown_master_itemcode": 1}
    assert manifest["class_distribution"] == {"0": 1, "1": 1} and manifest["source_distribution"] == manifest["provenance_distribution"] == {"manual": 2}
    assert set(manifest["input_hashes"]) == {"gold", "master", "offers"} and set(manifest["output_hashes"]) == {"rejected", "audit"}


def test_queue_and_long_table_order(spark):
    rows = [(1, True, "MANUAL_REVIEW", 0.7), (2, True, "MANUAL_REVIEW", 0.9), (3, False, "MANUAL_REVIEW", 0.8), (4, True, "AUTO_MATCH", 0.99)]
    df = spark.createDataFrame(rows, "offer_ord long, is_own boolean, ml_decision string, ml_probability double")
    assert [r["offer_ord"] for r in pipeline.review_queue(df).collect()] == [2, 1]
    m = master(spark, ("2", "CHICKEN NUGGETS", "Chicken", "400g"), ("1", "BEEF BURGER", "Meat", "500g"))
    own = [("North Star Chicken Nuggets", "Chicken Nuggets", "North Star", "400g"), ("North Star Beef Burger", "Beef Burger", "North Star", "500g")]
    other = [(f"{name} Nr {x}", name, f"R{x}", pack) for name, pack in (("Chicken Nuggets", "400g"), ("Beef Burger", "500g")) for x in "abc"]
    done = pipeline.run_prepared(offers(spark, *own, *other), m, lambda df: df.withColumn("ml_probability", F.lit(0.99)), own=OWN)
    table = [(r["Own Itemcode"], r["Rank"]) for r in done.long_table.collect()]
    assert table == sorted(table) and len(table) == 6


@pytest.mark.parametrize(("offer", "item", "flags"), [
    (("Chicken Burger", "500g"), ("BEEF BURGER", "500g"), {"protein_match": 0, "size_match": 1}),
    (("Chicken Fillet", "500g"), ("FISH FILLET", "500g"), {"protein_match": 0}),
    (("Nuggets", "2x500g"), ("NUGGETS", "1kg"), {"size_match": 1, "pack_format_match": 0}),
    (("Nuggets", "270g"), ("NUGGETS", "270g x 20 Pkts"), {"size_match": 1, "master_units_per_carton": 20, "master_unit_weight_g": 270}),
    (("Juice", "1L"), ("JUICE", "1kg"), {"size_match": 0}),
])
def test_confusions(spark, offer, item, flags):
    row = spark.createDataFrame([(offer[0], "", "", offer[1], item[0], "", "", item[1])], ["Offer Name", "Product", "Variant", "Base Packsize", "Itemname", "Item-Cat-4", "Item Description", "Item-Spec"])
    r = features.add_features(row).first()
    assert {k: r[k] for k in flags} == flags


def test_stream_of_offers(spark, tmp_path):
    """Files of offers that come one after the other: each batch gets its best candidates once."""
    header, *rows = OFFERS_CSV.strip().splitlines()
    (tmp_path / "in").mkdir()
    m = master(spark, ("7", "CHICKEN NUGGETS", "Chicken", "400g"), ("8", "BEEF BURGER", "Meat", "500g"))
    schema = ", ".join(f"`{c}` string" for c in header.split(","))
    for i, row in enumerate(rows):
        (tmp_path / "in" / f"{i}.csv").write_text(f"{header}\n{row}\n")
        offers_ = spark.readStream.schema(schema).option("header", True).csv(str(tmp_path / "in"))
        match_stream(offers_, m, str(tmp_path / "out"), str(tmp_path / "checkpoint"), own=OWN).awaitTermination()
    got = {r["offerid"]: r["itemcode"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 3 and got["1"] == got["2"] == "7" and spark.read.parquet(str(tmp_path / "out")).count() == 3


class Named:
    """As much of a session as the choice of a folder asks for."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = self, self
        self.master, self.folder = master, folder

    def get(self, name, default):
        return self.folder or default


def test_shared_folder():
    assert scratch.shared_dir(Named("spark://h:1", "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch.shared_dir(Named("local[4]")).endswith("larkspur-checkpoints")
    for cluster in ("spark://h:1", "yarn", "local-cluster[3,2,1000]", "k8s://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(Named(cluster))


def test_stored_tables(spark):
    df = scratch.stored(spark.range(1000).repartition(8), 1000)
    assert df.count() == 1000 and len(df.inputFiles()) == 1
    both = df.groupBy("id").count().join(scratch.again(df), "id")
    assert both.count() == 1000
    scratch.dropped(df)
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT"):
        scratch.stored(scratch.again(df))
