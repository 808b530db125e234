"""Content-addressed ids: the SHA-256 of the parts joined by a NUL byte, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*parts: str | Column) -> Column:
    """Null parts count as empty text."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)), 256)


def chunk_id(document: str, text_hash: str, occurrence: str) -> Column:
    return content_id(document, text_hash, occurrence)


def mention_id(entity: str, chunk: str, start: str) -> Column:
    return content_id(entity, chunk, start)


def edge_key(origin: str, file: str, source: str, relation: str, target: str) -> Column:
    return content_id(origin, file, source, relation, target)
