"""Record layouts: pages, tables, images, collection records, log lines."""

from __future__ import annotations

from pyspark.sql import types as T

COLLECTIONS = ("pdf_text", "pdf_tables", "pdf_images")

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def layout(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


BBOX = layout(x0=_D, y0=_D, x1=_D, y1=_D)

PAGES = layout(pdf_path=_S, page0=_I, page_label=_S, text=_S)

# One row per extracted table row. A record never holds a whole table: one table may be
# larger than a task's memory, so its rows stay in this long form.
TABLE_CELLS = layout(pdf_path=_S, page=_I, table_no=_I, row_no=_I, cells=T.ArrayType(_S), bbox=BBOX)

IMAGES = layout(
    image_id=_S, pdf_path=_S, page=_I, bbox=BBOX, png_path=_S, caption=_S, ocr_text=_S, content=T.BinaryType()
)

# All modalities share one table, partitioned by collection; a column that a modality
# does not have is null there.
RECORDS = layout(
    collection=_S, id=_S, text=_S, type=_S, pdf_path=_S, file_name=_S, page=_I, page_label=_S, doc_tag=_S,
    doc_hash=_S, table_id=_S, csv_path=_S, json_path=_S, image_id=_S, png_path=_S, bbox_sig=_S,
    bbox_x0=_D, bbox_y0=_D, bbox_x1=_D, bbox_y1=_D, has_caption=_B, has_ocr=_B,
    embedding=T.ArrayType(T.FloatType()),
)

# A stored record knows the batch that wrote it; a replaced one is listed by id and its batch.
STORED = T.StructType([*RECORDS.fields, T.StructField("batch", _L)])
REPLACED = layout(id=_S, old_batch=_L, batch=_L)
HASHES = layout(doc_hash=_S, prefix=_S, batch=_L)
BATCHES = layout(n_records=_L, batch=_L)
