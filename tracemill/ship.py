"""Sends this package to the workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once for each application.

    Functions that run in workers are sent by reference, so that their caches
    live as long as the worker; the workers need the package for that.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    made = os.path.join(tempfile.mkdtemp(prefix="tracemill-"), "tracemill.zip")
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.join("tracemill", os.path.relpath(path, here)))
    context.addPyFile(made)
    _SENT.add(context.applicationId)
