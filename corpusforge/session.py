"""Sessions: sending this package to the executors."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that it needs no shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusforge_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="corpusforge-")
    target = os.path.join(folder, "corpusforge.zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("corpusforge", os.path.relpath(full, root)))
    with open(target, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(target)
    sc._corpusforge_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local master, whose executors are the driver's own, may do without the setting; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="corpusforge-")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
