"""Python workers that can import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def find_package(spark: SparkSession) -> None:
    """Put the folder of this package on the path of Python workers started from now on.

    Functions sent to workers name their modules; a worker whose working folder is another one would not
    find them. On a cluster the folder must be there on every machine, or the package be installed.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
