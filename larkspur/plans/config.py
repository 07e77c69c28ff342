"""Settings from YAML: sections and values are checked, paths count from the file's folder."""

from __future__ import annotations

import codecs
import logging
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from ..operators.prepare import OwnBrand
from ..operators.rules import Thresholds


class ConfigError(ValueError):
    """A setting is missing or has a value that makes no sense."""


@dataclass(frozen=True)
class Config:
    offers_path: str
    master_path: str
    gold_pairs_path: str
    output_dir: str
    model_path: str | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)
    pack_bonus: float = 4.0
    pack_unknown: float = -3.0
    raw_score_floor: float = 60.0
    adjusted_score_floor: float = 65.0
    max_per_target: int = 5
    own_brand: OwnBrand = field(default_factory=OwnBrand)
    random_seed: int = 42
    log_level: str = "INFO"
    output_encoding: str = "utf-8-sig"


#: Names of the matching section, and those of Thresholds or Config that they set.
MATCHING = {
    "category_other_min_score": "other_score", "category_other_min_margin": "other_margin", "normal_min_score": "least_score",
    "high_score_threshold": "high_score", "high_margin_threshold": "high_margin", "medium_score_threshold": "medium_score",
    "medium_margin_threshold": "medium_margin", "auto_match_threshold": "auto_match", "manual_review_threshold": "manual_review",
}


def load_config(path: str) -> Config:
    with open(path, encoding="utf-8") as file:
        raw = yaml.safe_load(file)
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    section = {}
    for name in ("data", "model", "output", "matching", "competitors", "runtime"):
        if not isinstance(raw.get(name), dict):
            raise ConfigError(f"section {name} is missing")
        section[name] = raw[name]

    def value(where: str, name: str):
        if section[where].get(name) is None:
            raise ConfigError(f"{where}.{name} is missing")
        return section[where][name]

    def number(where: str, name: str, kind: type = float):
        x = value(where, name)
        if isinstance(x, bool) or not isinstance(x, (int, float)) or kind is int and int(x) != x:
            raise ConfigError(f"{where}.{name} must be a number{' without a fraction' if kind is int else ''}")
        return kind(x)

    def place(where: str, name: str) -> str:
        x = value(where, name)
        if not isinstance(x, str) or not x.strip():
            raise ConfigError(f"{where}.{name} must be a path")
        return x if "://" in x else str((Path(path).resolve().parent / x).resolve())

    at = Thresholds(**{own: number("matching", name) for name, own in MATCHING.items()})
    if not 0 <= at.manual_review < at.auto_match <= 1:
        raise ConfigError("thresholds must fulfil 0 <= manual_review_threshold < auto_match_threshold <= 1")
    most = number("competitors", "max_per_target", int)
    if most < 1:
        raise ConfigError("competitors.max_per_target must be at least 1")
    level, encoding = value("runtime", "log_level"), value("runtime", "output_encoding")
    if level not in logging.getLevelNamesMapping():
        raise ConfigError(f"runtime.log_level {level} is unknown")
    try:
        codecs.lookup(encoding)
    except LookupError as error:
        raise ConfigError(f"runtime.output_encoding {encoding} is unknown") from error
    own = raw.get("own_brand") or {}
    return Config(
        place("data", "offers_path"), place("data", "master_path"), place("data", "gold_pairs_path"), place("output", "output_dir"),
        place("model", "model_path") if section["model"].get("model_path") else None, at,
        number("matching", "pack_compatible_bonus"), number("matching", "pack_unknown_penalty"),
        number("competitors", "raw_score_floor"), number("competitors", "adjusted_score_floor"), most,
        OwnBrand(tuple(own.get("aliases") or ()), own.get("pattern")), number("runtime", "random_seed", int), level, encoding,
    )
