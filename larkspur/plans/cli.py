"""Commands: match, build-features, train, evaluate."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from ..operators import scoring, training
from .config import load_config
from .pipeline import run_config


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="larkspur")
    parser.add_argument("command", choices=["match", "build-features", "train", "evaluate"])
    parser.add_argument("--config", required=True)
    parser.add_argument("--output")
    parser.add_argument("--run-id")
    parser.add_argument("--overwrite", action="store_true")
    given = parser.parse_args(args)
    config = load_config(given.config)
    spark = SparkSession.builder.appName("larkspur").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    out = given.output or config.output_dir
    if given.command == "match":
        paths = run_config(spark, config, given.run_id)
        with open(paths["summary"], encoding="utf-8") as file:
            print(file.read())
        return
    if given.command == "build-features":
        built = training.build_from_paths(spark, config.gold_pairs_path, config.master_path, config.offers_path, out, config.own_brand.pattern, config.output_encoding, given.overwrite)
        shown = {k: built.manifest[k] for k in ("total_rows", "eligible_binary_rows", "accepted_rows", "rejected_rows", "exclusion_reasons", "class_distribution", "source_distribution", "offer_reconstruction")}
        print(json.dumps({"paths": built.output_paths} | shown, indent=2))
        return
    accepted = training.build_from_paths(spark, config.gold_pairs_path, config.master_path, config.offers_path, own_brand=config.own_brand.pattern).accepted
    split = scoring.with_split(accepted, seed=config.random_seed)
    if given.command == "train":
        scoring.save(scoring.train(split.where("split = 'train'"), seed=config.random_seed), out, thresholds={"auto_match": config.thresholds.auto_match, "manual_review": config.thresholds.manual_review})
    else:
        scorer, _ = scoring.load(spark, config.model_path)
        scored = scorer(split)
        scoring.metrics(scored, by=["split"]).show(truncate=False)
        scoring.calibration(scored.where("split = 'test'")).orderBy("bin").show()
        scoring.threshold_sweep(scored.where("split = 'test'")).orderBy("threshold").show(100)


if __name__ == "__main__":
    main()
