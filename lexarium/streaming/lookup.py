"""Keys that arrive as a stream, looked up in a lexicon at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.operators.lookup import latest


def get_stream(lex: DataFrame, keys: DataFrame) -> DataFrame:
    """A stream with a column key, with entry, text and error: a stream-static join, without state."""
    found = latest(lex).select("key", "entry", "text")
    return keys.join(found, "key", "left").withColumn("error", F.when(F.col("entry").isNull(), F.lit("Key not found")))
