"""The operators that SQL can call by name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources import tables
from . import tags

_PLACE = "struct<start:int,end:int,ratio:double>"


def best_fuzzy(text: pa.Array, segment: pa.Array, hint: pa.Array) -> pa.Array:
    """The stretch of text most similar to segment around hint (anywhere if null)."""
    rows = [kernels.best_fuzzy(t or "", s or "", h) for t, s, h in zip(text.to_pylist(), segment.to_pylist(), hint.to_pylist(), strict=True)]
    return pa.array([{"start": a, "end": b, "ratio": r} for a, b, r in rows], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))


def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """How alike two strings are by their matching blocks; 0 if one is empty or null."""
    return pa.array([kernels.sequence_ratio(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def register(spark: SparkSession, prefix: str = "spanframe_") -> list[str]:
    """Register the functions, and parse_tags as a table function for LATERAL; the names."""
    found = {"tokens": tables.tokens(), "best_fuzzy": F.arrow_udf(best_fuzzy, _PLACE), "sequence_ratio": F.arrow_udf(sequence_ratio, "double")}
    for name, f in found.items():
        spark.udf.register(prefix + name, f)
    tags.register_parse_tags(spark, f"{prefix}parse_tags")
    return [prefix + n for n in (*found, "parse_tags")]
