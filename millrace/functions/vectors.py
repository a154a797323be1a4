"""Vector and id expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col

#: The space of point ids.
POINTS = uuid.uuid5(uuid.NAMESPACE_URL, "millrace:points")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def mock_embedding(text: Column | str, dim: int = 64) -> Column:
    """A vector made from the bytes of SHA-256 (used again from the start beyond 32), unit length, 6 decimals."""
    digest = F.sha2(F.coalesce(col(text), F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)
    bound = F.transform(F.array(raw), lambda v: F.transform(v, lambda x: F.round(x / F.sqrt(dot(v, v)), 6)))
    return F.get(bound, F.lit(0))


def quantize(vector: Column, low: Column, high: Column) -> Column:
    """8-bit values of a vector between two bounds; what lies outside is clipped."""
    return F.transform(vector, lambda x: F.round(F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255 - 128).cast("tinyint"))


def document_id(path: Column | str) -> Column:
    return F.substring(F.sha2(F.lower(col(path)), 256), 1, 32)


def point_id(document: Column | str, chunk: Column | str) -> Column:
    """The version 5 UUID of document and chunk, so that writing a chunk again replaces it."""
    name = F.encode(F.concat_ws(":", col(document), col(chunk)), "UTF-8")
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(POINTS.hex)), name)), 1, 32)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    fixed = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    return F.concat_ws("-", *(F.substring(fixed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
