"""The whole run: offers and catalogue to mapping, competitors and exports. Keys of offers and their results
are written to the folder that the cluster shares, and so is the mapping of all offers if many results
are asked for; the rest is lazy."""

from __future__ import annotations

import logging
import os
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as c
from ..operators import competitors, exports, rules, scoring
from ..operators.features import FEATURES, add_features
from ..operators.prepare import OwnBrand, prepare_master, prepare_offers
from ..sources import readers, sinks
from ..sources.scratch import few, stored
from .config import Config

log = logging.getLogger(__name__)
MATCHED = ["suggested_itemcode", "suggested_itemname", "match_score", "adjusted_score", "margin", "raw_margin", "pack_status", "pack_structure_status", "confidence_tier", "master_match_text", "ml_probability", "ml_decision", "ml_features", "matched_itemcode", "matched_itemname"]
#: Keys with their results, about 1 KB each, that may be sent to all executors: offers then stay where they are.
KEYS_SENT = 40_000
KEY = ["match_text", "offer_measures", "category"]


@dataclass
class Run:
    """The mapping of all offers, and the results made from it when they are first asked for. firsts: the
    mapping of the first offers alone, where these are at hand; competitors are found among them."""

    mapped: DataFrame
    master: DataFrame
    settings: dict
    firsts: DataFrame | None = None

    @cached_property
    def competitors(self) -> DataFrame:
        return competitors.find_competitors(self.mapped if self.firsts is None else self.firsts, **self.settings)

    @cached_property
    def mapping(self) -> DataFrame:
        return exports.mapping(competitors.with_summary(self.mapped, self.competitors, self.firsts))

    @cached_property
    def long_table(self) -> DataFrame:
        return competitors.long_table(self.competitors)

    @cached_property
    def offer_export(self) -> DataFrame:
        return exports.offer_export(self.master, self.mapped)

    @cached_property
    def competitor_export(self) -> DataFrame:
        return exports.competitor_export(self.master, self.competitors)


def match(offers: DataFrame, master: DataFrame, at: rules.Thresholds = rules.Thresholds(), bonus: float = 4.0, unknown: float = -3.0) -> DataFrame:
    """Best candidate and tier of each prepared offer."""
    return rules.tiers(c.candidates(offers, master, 1, bonus, unknown), at)


def scored_keys(keys: DataFrame, matched: DataFrame, master: DataFrame, scorer: scoring.Scorer, at: rules.Thresholds, own_brand: str | None = None) -> DataFrame:
    """Distinct keys of own offers with their candidate, features, probability and decision."""
    found = matched.select(
        "offer_ord", F.col("itemcode").alias("suggested_itemcode"), F.col("itemname").alias("suggested_itemname"), F.bround("text_score", 2).alias("match_score"),
        F.bround("adjusted_score", 2).alias("adjusted_score"), F.bround("margin", 2).alias("margin"), F.bround("raw_margin", 2).alias("raw_margin"),
        "pack_status", "pack_structure_status", "confidence_tier", "master_match_text",
    )
    items = master.select(F.col("Itemcode").alias("suggested_itemcode"), "Itemname", "Item-Cat-4", "Item Description", "Item-Spec", "master_measures_detailed", F.lit(True).alias("__known"))
    pairs = keys.join(found, "offer_ord").join(items, "suggested_itemcode", "left")
    known = F.coalesce("__known", F.lit(False))
    scored = scorer(add_features(pairs, own_brand)).withColumn("ml_decision", rules.decision(F.col("suggested_itemcode"), known, F.col("ml_probability"), at))
    scored = scored.withColumn("ml_probability", F.when(known, F.col("ml_probability"))).withColumn("ml_features", F.when(known, F.to_json(F.struct(*FEATURES))))
    return rules.decided(scored).select(*KEY, *MATCHED)


def map_offers(offers: DataFrame, keyed: DataFrame) -> DataFrame:
    """Every offer with its key's result; other brands' offers get marks instead."""
    right = keyed.select(*(F.col(k).alias(f"__{k}") for k in KEY), *MATCHED)
    right = F.broadcast(right) if few(keyed, KEYS_SENT) else right
    joined = offers.join(right, [offers[k].eqNullSafe(right[f"__{k}"]) for k in KEY] + [offers["is_own"]], "left")
    # What stands in the columns of other brands' offers.
    mark = {
        "matched_itemcode": "N/A - competitor brand row", "matched_itemname": "N/A", "suggested_itemcode": "N/A", "suggested_itemname": "N/A",
        "confidence_tier": "n/a", "master_match_text": "", "ml_decision": "N/A", "ml_features": "",
    }
    kinds = dict(joined.dtypes)
    return joined.select(*offers.columns, *(F.when(~F.col("is_own"), F.lit(mark.get(m)).cast(kinds[m])).otherwise(F.col(m)).alias(m) for m in MATCHED))


def run(offers: DataFrame, master: DataFrame, scorer: scoring.Scorer = scoring.rule_scorer, config: Config | None = None, own: OwnBrand = OwnBrand()) -> Run:
    """Raw tables (with offer_ord and master_ord) to all results."""
    at, own = (config.thresholds, config.own_brand) if config else (rules.Thresholds(), own)
    offers, master = prepare_offers(offers, own), prepare_master(master)
    return run_prepared(offers, master, scorer, config, at, own, keep=config is not None)


def run_prepared(offers: DataFrame, master: DataFrame, scorer: scoring.Scorer, config: Config | None = None, at: rules.Thresholds = rules.Thresholds(), own: OwnBrand = OwnBrand(), keep: bool = False, firsts: DataFrame | None = None) -> Run:
    """keep: store the mapping of all offers, for runs that read it for many results; it takes as much
    disk as the offers. Else it is made anew for each result that reads it. firsts: the first offers of
    each country, brand, clean text and key, stored; keys and competitors then don't read all offers."""
    keys = c.unique_keys((offers if firsts is None else firsts).where("is_own"))
    matched = match(keys, master, at, *((config.pack_bonus, config.pack_unknown) if config else ()))
    keyed = stored(scored_keys(keys, matched, master, scorer, at, own.pattern))
    mapped = map_offers(offers, keyed)
    settings = {"raw_floor": config.raw_score_floor, "adjusted_floor": config.adjusted_score_floor, "most": config.max_per_target} if config else {}
    return Run(stored(mapped) if keep else mapped, master, settings, None if firsts is None else map_offers(firsts, keyed))


def review_queue(mapped: DataFrame) -> DataFrame:
    """Own offers that a person must decide, the most probable first."""
    return mapped.where("is_own and ml_decision = 'MANUAL_REVIEW'").orderBy(F.desc("ml_probability"), "offer_ord")


def summary(mapped: DataFrame, found: DataFrame) -> dict:
    """Numbers of a run: offers, tiers, decisions, mean probability of accepted ones, competitor rows."""
    counts = lambda c: {r[0]: r["n"] for r in mapped.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).collect()}  # noqa: E731  of a few fixed values
    total = mapped.agg(F.count("*").alias("offers"), F.count_if("is_own").alias("own_offers"), F.avg(F.when(F.col("ml_decision") == "AUTO_MATCH", F.col("ml_probability"))).alias("mean_accepted_probability")).first()
    return total.asDict() | {"confidence_tiers": counts("confidence_tier"), "decisions": counts("ml_decision"), "competitor_rows": found.count()}


def run_config(spark: SparkSession, config: Config, run_id: str | None = None) -> dict[str, str]:
    """Read, run, write to a folder of the run's own, and read again. The folder is new: results of other
    runs are never overwritten. The summary has the run's id, its settings and the files' hashes."""
    run_id = run_id or datetime.now(UTC).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    folder = f"{config.output_dir}/{run_id}"
    scorer, model = scoring.load(spark, config.model_path) if config.model_path else (scoring.rule_scorer, {"scorer": "rules"})
    offers, master = readers.load_offers(spark, config.offers_path), readers.load_master(spark, config.master_path)
    done = run(offers, master, scorer, config)
    prepared = prepare_master(master)
    stamped = lambda df: df.withColumn("run_id", F.lit(run_id))
    paths = {name: f"{folder}/{name}.parquet" for name in ("mapping", "competitors", "review_queue")}
    stamped(done.mapping).write.parquet(paths["mapping"])
    done.long_table.write.parquet(paths["competitors"])
    stamped(exports.mapping(review_queue(done.mapped))).write.parquet(paths["review_queue"])
    exports.validate_offer_export(done.offer_export, prepared)
    paths |= {"offers": sinks.write_csv(done.offer_export, f"{folder}/offers.csv", config.output_encoding), "competitors_csv": sinks.write_csv(done.competitor_export, f"{folder}/competitors.csv", config.output_encoding)}
    again = spark.read.options(header=True, multiLine=True, escape='"', emptyValue="", nullValue="\x00").csv(paths["offers"])
    exports.validate_offer_export(again.na.fill(""), prepared)
    hashes = {k: sinks.file_sha256(p) for k, p in paths.items() if os.path.isfile(p)}
    report = summary(done.mapped, done.competitors) | {"run_id": run_id, "model": model, "thresholds": asdict(config.thresholds), "output_paths": paths, "output_hashes": hashes}
    paths["summary"] = sinks.write_json(report, f"{folder}/summary.json")
    log.info("wrote %s", paths)
    return paths
