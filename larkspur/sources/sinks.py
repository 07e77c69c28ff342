"""Sinks: CSV with a byte-order mark in one file, Parquet, JSON, hashes, and the training artifacts.

Final reports have one row for each catalogue row; they are streamed to the driver partition by
partition and written line by line. Tables of data are written by the executors as Parquet."""

from __future__ import annotations

import csv
import hashlib
import json
import os
from collections.abc import Callable
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from ..operators.training import Built

BLOCK = 1 << 20


def _whole(path: str, write: Callable, overwrite: bool) -> str:
    """Write beside the target, then rename: a reader never sees half a file."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    write(f"{path}.part")
    os.replace(f"{path}.part", path)
    return path


def write_csv(df: DataFrame, path: str, encoding: str = "utf-8-sig", overwrite: bool = False) -> str:
    def write(to: str) -> None:
        with open(to, "w", encoding=encoding, newline="") as file:
            out = csv.writer(file, lineterminator="\n")
            out.writerow(df.columns)
            for row in df.toLocalIterator(prefetchPartitions=True):
                out.writerow(["" if v is None else v for v in row])

    return _whole(path, write, overwrite)


def write_json(value, path: str, overwrite: bool = False) -> str:
    """Sorted keys, two blanks of indent, characters as they are, a line break at the end."""
    text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n"
    return _whole(path, lambda to: Path(to).write_text(text, encoding="utf-8"), overwrite)


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def write_training(built: Built, folder: str, encoding: str = "utf-8-sig", overwrite: bool = False) -> dict[str, str]:
    """Accepted rows as Parquet and as CSV parts (both grow with the data: executors write them), rejected
    rows as one CSV, audit and manifest as JSON. What is there already is kept, unless it may be
    overwritten."""
    at = lambda name: f"{folder}/{name}"
    mode = "overwrite" if overwrite else "errorifexists"
    built.accepted.write.mode(mode).parquet(at("training_features.parquet"))
    accepted = built.accepted.sparkSession.read.parquet(at("training_features.parquet"))
    accepted.write.mode(mode).options(header=True, escape='"', encoding="UTF-8").csv(at("training_features.csv"))
    paths = {"parquet": at("training_features.parquet"), "csv": at("training_features.csv"), "rejected": write_csv(built.rejected, at("rejected_training_rows.csv"), encoding, overwrite), "audit": write_json(built.audit, at("data_audit.json"), overwrite)}
    hashes = {k: file_sha256(p) for k, p in paths.items() if os.path.isfile(p)}
    paths["manifest"] = write_json(built.manifest | {"output_hashes": hashes, "output_paths": paths}, at("feature_manifest.json"), overwrite)
    built.output_paths = paths
    return paths
