"""Reports: tables of unlike columns, canonical JSON and digests."""

from __future__ import annotations

import functools
import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows, with the columns of all; what a table lacks is null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header (nested cells as JSON), or JSON lines."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
        return
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def canonical_json(value) -> bytes:
    """Sorted keys, no spaces; numbers that aren't finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False).encode()


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()
