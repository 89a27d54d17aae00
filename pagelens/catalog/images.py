"""Images: records from file names, bodies, ids, message parts, captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.catalog import roles as R
from pagelens.catalog.registry import query, table
from pagelens.functions.media import image_part, media_type
from pagelens.functions.meta import clean_meta
from pagelens.functions.text import ocr_clean
from pagelens.operators.inference import generate_vision
from pagelens.plans.ingest import describe_images, image_rows


@query("image_records", f"WITH {R.IMAGES_SQL} SELECT image_id, pdf_path, page, kind, CAST(image_no AS VARCHAR) AS image_no, png_path FROM image_rows")
def image_records_query(spark, sf_dir):
    return R.images(spark, sf_dir).select("image_id", "pdf_path", "page", "kind", F.col("image_no").cast("string").alias("image_no"), "png_path")


@query("image_body", f"""WITH {R.IMAGES_SQL} SELECT image_id, body, length(caption) > 0 AS has_caption,
  coalesce(length(ocr_text) > 0, false) AS has_ocr FROM image_rows""")
def image_body_query(spark, sf_dir):
    from pagelens.functions.text import has_text, image_body

    return R.images(spark, sf_dir).select(
        "image_id", image_body(F.col("caption"), F.col("ocr_text"), F.col("page"), F.col("pdf_path")).alias("body"),
        has_text(F.col("caption")).alias("has_caption"), has_text(F.col("ocr_text")).alias("has_ocr"))


@query("image_ids", f"""WITH {R.IMAGES_SQL}
SELECT printf('%s:image:p%04d:%s', sha256(pdf_path)[1:16], page, sha1(content)[1:12]) AS id, image_id, pdf_path, page, body AS text,
       bbox_sig, bbox_x1 FROM image_rows
QUALIFY row_number() OVER (PARTITION BY pdf_path, page, content ORDER BY image_id) = 1""")
def image_ids(spark, sf_dir):
    pictures = R.images(spark, sf_dir)
    return image_rows(pictures, R.picture_files(spark, sf_dir)).select(
        "id", "image_id", "pdf_path", "page", "text", "bbox_sig", "bbox_x1")


@query("mime_base64", f"""WITH {R.IMAGES_SQL} SELECT image_id,
  CASE WHEN suffix = 'JPG' THEN 'image/jpeg' ELSE 'image/png' END AS mime_type, 'image' AS type, 'base64' AS source_type,
  base64(encode(repeat(content, 12))) AS data FROM images""")
def mime_base64(spark, sf_dir):
    suffix = F.regexp_extract("png_path", r"(\.[^./]*)$", 1)
    content = F.encode(F.repeat(F.decode("content", "UTF-8"), F.lit(12)), "UTF-8")
    return R.images(spark, sf_dir).select("image_id", image_part(content, media_type(suffix)).alias("p")).select(
        "image_id", "p.mime_type", "p.type", "p.source_type", "p.data")


@query("clean_meta", """SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day,
  concat('["', event_type, '",', CASE WHEN user_id % 2 = 0 THEN 'null' ELSE concat('"', user_id, '"') END, ']') AS tags,
  concat('{"user":', user_id, ',"kind":"', event_type, '"}') AS origin, user_id % 2 = 0 AS even FROM events""")
def clean_meta_query(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", F.to_date("ts").alias("day"),
        F.array("event_type", F.when(F.col("user_id") % 2 != 0, F.col("user_id").cast("string"))).alias("tags"),
        F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("origin"),
        (F.col("user_id") % 2 == 0).alias("even"))
    return clean_meta(rows)


def _size_captioner(content: bytes, *, mime: str) -> str:
    if content.startswith(b"small"):
        raise RuntimeError("refused")
    return f" {mime} of {len(content)} bytes "


@query("caption_images", f"""WITH {R.IMAGES_SQL} SELECT image_id, CASE WHEN starts_with(content, 'small') THEN '' ELSE
  concat(CASE WHEN suffix = 'JPG' THEN 'image/jpeg' ELSE 'image/png' END, ' of ', strlen(content), ' bytes') END AS caption,
  concat('seen ', content) AS ocr_text FROM images""")
def caption_images(spark, sf_dir):
    pictures = R.images(spark, sf_dir).drop("caption", "ocr_text")
    return describe_images(pictures, _size_captioner, lambda content: f"  seen {content.decode()} \n").select(
        "image_id", "caption", "ocr_text")


@query("ocr_clean", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g')[1:2000] AS ocr_text FROM documents")
def ocr_clean_query(spark, sf_dir):
    padded = F.concat(F.lit(" \n"), "text", F.lit("\t "))
    return table(spark, sf_dir, "documents").select("doc_id", ocr_clean(padded).alias("ocr_text"))


@query("generate_vision", f"""WITH {R.IMAGES_SQL} SELECT image_id, concat('Describe ', image_id, ': ',
  CASE WHEN suffix = 'JPG' THEN 'image/jpeg' ELSE 'image/png' END, ' ', strlen(base64(encode(content)))) AS answer, true AS ok FROM images""")
def generate_vision_query(spark, sf_dir):
    suffix = F.regexp_extract("png_path", r"(\.[^./]*)$", 1)
    asked = R.images(spark, sf_dir).select(
        "image_id", F.concat(F.lit("Describe "), "image_id").alias("prompt"),
        F.array(image_part(F.col("content"), media_type(suffix))).alias("images"))
    model = lambda prompt, parts: f"{prompt}: {parts[0]['mime_type']} {len(parts[0]['data'])}"
    return generate_vision(asked, model).select("image_id", "answer", "ok")
