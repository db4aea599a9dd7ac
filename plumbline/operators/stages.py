"""Stages that are run once: a state file says which are complete, so that a run after a failure goes on from there."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.writers import read_text_file, write_text_file

Stage = tuple[str, Callable[[SparkSession, DataFrame | None], DataFrame]]


def run_stages(spark: SparkSession, folder: str, stages: list[Stage]) -> tuple[DataFrame, list[dict]]:
    """Run stages in order, each on its predecessor's table, and write each to ``folder``; complete ones are read instead.

    Returns the last table, and for each stage its name, seconds and whether it was run. A stage is complete once the state
    file names it, which is replaced as a whole after the stage's table is written.
    """
    state_path = f"{folder}/state.json"
    done = json.loads(read_text_file(spark, state_path) or "{}")
    table, report = None, []
    for name, stage in stages:
        start = time.monotonic()
        ran = name not in done
        if ran:
            stage(spark, table).write.mode("overwrite").parquet(f"{folder}/{name}")
            done[name] = round(time.monotonic() - start, 3)
            write_text_file(spark, state_path, json.dumps(done))
        table = spark.read.parquet(f"{folder}/{name}")
        report.append({"stage": name, "seconds": done[name], "ran": ran})
    return table, report
