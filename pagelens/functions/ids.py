"""Content hashes, box signatures and the stable record ids built from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOX_SIDES = ("x0", "y0", "x1", "y1")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(doc_hash: Column) -> Column:
    """The part of a content hash that record ids carry."""
    return F.substring(doc_hash, 1, 16)


def image_hash(content: Column) -> Column:
    return F.substring(F.sha1(content), 1, 12)


def bbox_sig(bbox: Column) -> Column:
    """Four coordinates rounded half to even and joined by ``_``; ``none`` without a box."""
    sides = [F.bround(bbox[s], 0).try_cast("bigint").cast("string") for s in BOX_SIDES]
    return F.when(bbox.isNull(), "none").otherwise(F.concat_ws("_", *sides))


def bbox_fields(bbox: Column) -> list[Column]:
    return [bbox[s].cast("double").alias(f"bbox_{s}") for s in BOX_SIDES]


def text_id(doc_hash: Column, page: Column, position: Column) -> Column:
    return F.format_string("%s:text:p%04d:c%04d", short_hash(doc_hash), page, position)


def table_id(doc_hash: Column, page: Column, sig: Column, position: Column) -> Column:
    return F.format_string("%s:table:p%04d:%s:%02d", short_hash(doc_hash), page, sig, position)


def image_id(doc_hash: Column, page: Column, image_sha: Column) -> Column:
    return F.format_string("%s:image:p%04d:%s", short_hash(doc_hash), page, image_sha)
