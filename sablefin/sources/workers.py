"""Python workers that find this library."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

import sablefin


def reach_package(spark: SparkSession) -> None:
    """Let Python workers started from now on import this library from where the driver has it.

    Where executors don't share that folder, the library has to be shipped with ``--py-files``; this changes nothing then.
    """
    root = str(Path(sablefin.__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
