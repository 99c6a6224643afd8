"""Places for files that jobs of one session share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from lexarium.errors import Unsupported


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; that is set to a temporary one only where it is unset, as in tests.

    On a cluster it has to be set: a folder of one machine would not be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise Unsupported("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexarium-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
