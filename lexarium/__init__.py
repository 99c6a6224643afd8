"""Keyed text collections and training-data operators on Spark DataFrames."""

from __future__ import annotations

import os
import sys
from pathlib import Path

_ROOT = str(Path(__file__).resolve().parent.parent)
# Python workers of a local session import this package from the same place.
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, os.environ.get("PYTHONPATH")]))
if _ROOT not in sys.path:
    sys.path.append(_ROOT)


def ship(spark) -> None:
    """Send this package to the executors of a cluster that does not have it installed."""
    import shutil
    import tempfile

    archive = shutil.make_archive(tempfile.mkdtemp() + "/lexarium", "zip", _ROOT, "lexarium")
    spark.sparkContext.addPyFile(archive)
