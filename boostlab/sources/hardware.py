"""The hardware block of a result document, from the output of the host's own tools.

Tools are run on the driver's host. One that is missing, fails or hangs has no output, and
what it would have told is left out.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.sources.texts import first_release_line, parse_inventory, parse_key_values

SECONDS = 10
# The tools, and the fields asked of the inventory.
TOOLS = {
    "processor": ["lscpu"],
    "devices": ["nvidia-smi", "--query-gpu=name,memory.total,driver_version",
                "--format=csv,noheader"],
    "toolkit": ["nvcc", "--version"],
}


def outputs() -> dict[str, str]:
    """What each tool prints."""
    texts = {}
    for name, command in TOOLS.items():
        try:
            done = subprocess.run(command, capture_output=True, text=True, timeout=SECONDS)
            texts[name] = done.stdout if done.returncode == 0 else ""
        except (OSError, subprocess.TimeoutExpired):
            texts[name] = ""
    return texts


def _lines(spark: SparkSession, text: str) -> DataFrame:
    rows = [(0, i, line) for i, line in enumerate(text.strip().splitlines()) if line.strip()]
    return spark.createDataFrame(rows, "doc int, line_no int, line string")


def columns(spark: SparkSession, texts: dict[str, str] | None = None) -> dict[str, Column]:
    """The fields of the block as literals; tool output has some lines whatever the data."""
    texts = outputs() if texts is None else texts
    told = {r["key"]: r["value"] for r in
            parse_key_values(_lines(spark, texts["processor"])).orderBy("line_no").collect()}
    devices = parse_inventory(_lines(spark, texts["devices"])).orderBy("line_no").collect()
    release = first_release_line(_lines(spark, texts["toolkit"]), "doc", "line_no").first()
    made = [F.struct(F.lit(d["name"]).alias("name"), F.lit(d["memory_mb"]).alias("memory_mb"),
                     F.lit(d["driver"]).alias("driver")) for d in devices]
    kind = "array<struct<name: string, memory_mb: int, driver: string>>"
    found = {
        "cpu_model": told.get("cpu_model"),
        "cuda_version": release["cuda_version"] if release else None,
    }
    return {**{k: F.lit(v).cast("string") for k, v in found.items()},
            "gpus": F.array(*made).cast(kind), "gpu_count": F.lit(len(devices))}
