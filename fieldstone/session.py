"""A session with the settings that the results rely on."""

from __future__ import annotations

import os
import sys

import tempfile
import uuid

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; Python workers find this package where the driver does."""
    if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, [os.environ.get("PYTHONPATH", "")])])
    if _ROOT not in sys.path:
        sys.path.insert(0, _ROOT)
    builder = SparkSession.builder if master is None else SparkSession.builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}
    return builder.config(map=settings).getOrCreate()


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for the files of one run, in spark.checkpoint.dir; where none is set, a temporary one if all runs on one machine, and else an error."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = os.path.join(tempfile.gettempdir(), "fieldstone-runs")
    return f"{named}/{name}-{uuid.uuid4().hex}"
