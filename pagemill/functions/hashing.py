"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(source_url: Column, chunk_idx: Column) -> Column:
    """Id of a retrieval chunk: SHA-256 of ``url-ordinal``."""
    return F.sha2(F.concat_ws("-", source_url, chunk_idx.cast("string")), 256)


def graph_chunk_id(source_url: Column, chunk_idx: Column, header: Column) -> Column:
    """Id of a graph chunk: SHA-256 of ``url-ordinal-header``."""
    return F.sha2(F.concat_ws("-", source_url, chunk_idx.cast("string"), header), 256)


def version_stamp(ts: Column | None = None) -> Column:
    """``yyyy.MM.dd`` of a timestamp in UTC (now by default)."""
    moment = F.current_timestamp() if ts is None else ts
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy.MM.dd")
