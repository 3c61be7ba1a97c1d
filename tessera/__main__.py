"""python -m tessera doctor|build RECIPE [--out DIR] [--shards N] [section.key=value ...]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessera import config as C
from tessera import pipeline
from tessera.functions.template import CODE_POINTS, Template
from tessera.operators.encode import supervised
from tessera.sources import corpora


def doctor(spark: SparkSession, config: dict, template: Template = CODE_POINTS) -> list[str]:
    """Every fault that the recipe's files, settings and a probe show, not only the first."""
    faults = []
    dataset, training = config["dataset"], config["training"]
    if dataset.get("data_files") is not None and corpora.matching(spark, dataset["data_files"]) == 0:
        faults.append(f"dataset.data_files matches no file: {dataset['data_files']}")
    asked = [name for name in ("wandb", "transcripts") if (training.get(name) or {}).get("enabled")]
    if asked and not training.get("metrics_log_dir"):
        faults.append(f"training.metrics_log_dir is needed for {' and '.join(asked)}")
    try:
        row = pipeline.probe(spark, config, template).withColumn("supervised", supervised("spans")).first()
    except Exception as e:
        return [*faults, f"the probe cannot be encoded: {e}"]
    if row["drop_reason"] is not None:
        return [*faults, f"the probe is rejected: {row['drop_reason']}"]
    if not row["supervised"]:
        faults.append("no token of the probe is supervised")
    if row["prompt_length"] >= row["unpadded_length"]:
        faults.append("the probe's prompt fills its window")
    return faults


def _recipe(text: str) -> str:
    if not Path(text).expanduser().is_file():
        raise argparse.ArgumentTypeError(f"no such file: {text}")
    return str(Path(text).expanduser())


def _positive(text: str) -> int:
    if not text.isdecimal() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"not a positive whole number: {text}")
    return int(text)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("command", choices=("doctor", "build"))
    parser.add_argument("recipe", type=_recipe)
    parser.add_argument("overrides", nargs="*")
    parser.add_argument("--out", help="folder for the windows or padded rows of build")
    parser.add_argument("--key", default="id", help="the column that orders the corpus")
    parser.add_argument("--shards", type=_positive, help="ranges of the rows that are packed apart")
    got = parser.parse_args(args)
    if got.command == "build" and not got.out:
        parser.error("build needs --out")
    config = C.load(got.recipe, got.overrides)
    if got.shards:
        config["dataset"]["pack_shards"] = got.shards
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    faults = doctor(spark, config)
    if got.command == "doctor" or faults:
        print("\n".join(faults) or "no fault found")
        return int(bool(faults))
    built = pipeline.load(spark, config, key=got.key)
    built.train.write.parquet(f"{got.out}/train")
    if built.eval is not None:
        built.eval.write.parquet(f"{got.out}/eval")
    return 0


if __name__ == "__main__":
    sys.exit(main())
