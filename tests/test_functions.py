"""Edge rows of the scalar functions."""

from __future__ import annotations

import base64

import pytest
from pyspark.sql import functions as F, types as T

from pagelens.functions import ids as I, text as X
from pagelens.functions.media import image_part, media_type
from pagelens.functions.meta import clean_meta
from pagelens.functions.prompts import context_block, question_prompt
from pagelens.functions.responses import checked_response


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_strip_like_python(spark):
    texts = ["  a b \n", "\x85\xa0x　", "\t\x1c\x1f", "", " q  ", "plain", None]
    got = values(spark, X.strip(F.col("t")), [(t,) for t in texts], "t string")
    assert got == [t.strip() if t is not None else None for t in texts]


def test_names(spark):
    paths = ["a/b/report.v2.pdf", "report.pdf", ".hidden", "x/noext", "a.b/c"]
    assert values(spark, X.file_name(F.col("p")), [(p,) for p in paths], "p string") == [
        "report.v2.pdf", "report.pdf", ".hidden", "noext", "c"]
    assert values(spark, X.file_stem(F.col("p")), [(p,) for p in paths], "p string") == [
        "report.v2", "report", ".hidden", "noext", "c"]


def test_page_number(spark):
    assert values(spark, X.page_number(F.col("p")), [(0,), (None,), (4,)], "p int") == [1, 1, 5]


def test_table_preview(spark):
    schema = "title string, h array<string>, a array<string>, b array<string>"
    rows = [
        (None, ["x", "y"], ["1", "2"], ["3", ""]), ("Sales", ["x"], None, None), ("", ["x"], ["1"], None),
        (None, [], [], []), (None, ["x"], [], ["z"]),
    ]
    got = values(spark, X.table_preview(F.col("title"), F.col("h"), F.col("a"), F.col("b")), rows, schema)
    assert got == [
        "Table. Headers: x | y. Example rows: 1 | 2 ; 3 | ", "Table: Sales. Headers: x",
        "Table. Headers: x. Example rows: 1", "Table. Headers: ", "Table. Headers: x ; z"]


def test_image_body(spark):
    rows = [(" a cat ", " text "), ("", "text"), (None, None), ("cat", ""), ("cat", "  "), ("  ", None)]
    got = values(spark, X.image_body(F.col("c"), F.col("o"), F.lit(3), F.lit("d/f.pdf")), rows, "c string, o string")
    place = "Image on page 3 of f.pdf"
    assert got == ["a cat\nOCR: text", "OCR: text", place, "cat", "cat\nOCR:", place]


def test_table_body(spark):
    assert values(spark, X.table_body(F.col("t"), F.lit(2)), [(" x ",), ("  ",), (None,)], "t string") == [
        "x", "Table on page 2", "Table on page 2"]


def test_bbox(spark):
    rows = [((0.5, 1.5, 2.5, 3.49),), ((-0.4, 10.0, 1e6 + 0.5, 7.5),), (None,)]
    schema = "b struct<x0: double, y0: double, x1: double, y1: double>"
    assert values(spark, I.bbox_sig(F.col("b")), rows, schema) == ["0_2_2_3", "0_10_1000000_8", "none"]
    flat = spark.createDataFrame(rows, schema).select(*I.bbox_fields(F.col("b"))).collect()
    assert tuple(flat[2]) == (None,) * 4 and flat[0].bbox_y0 == 1.5


def test_ids_carry_sixteen_digits(spark):
    row = spark.range(1).select(
        I.text_id(F.lit("ab" * 32), F.lit(3), F.lit(12)).alias("t"),
        I.table_id(F.lit("ab" * 32), F.lit(3), F.lit("none"), F.lit(123)).alias("b"),
        I.image_id(F.lit("ab" * 32), F.lit(12345), F.lit("c0ffee")).alias("i")).first()
    assert tuple(row) == (
        "abababababababab:text:p0003:c0012", "abababababababab:table:p0003:none:123", "abababababababab:image:p12345:c0ffee")


def test_media(spark):
    exts = [".JPG", "jpeg", "tif", "..gif", "weird", "", None]
    assert values(spark, media_type(F.col("e")), [(e,) for e in exts], "e string") == [
        "image/jpeg", "image/jpeg", "image/tiff", "image/gif", "image/png", "image/png", "image/png"]
    blob = bytes(range(256)) * 3
    part = spark.createDataFrame([(bytearray(blob),)], "c binary").select(
        image_part(F.col("c"), F.lit("image/png")).alias("p")).first().p
    assert part.data == base64.b64encode(blob).decode() and part.mime_type == "image/png"


def test_clean_meta(spark):
    df = spark.sql("select 1 as a, 'x' as b, true as c, date'2024-01-02' as d, array(1, 2) as e, map('k', 1) as f, "
                   "named_struct('p', 1) as g, cast(null as string) as h, array(1.0f) as v")
    row = clean_meta(df, keep=("v",)).first()
    assert row[:8] == (1, "x", True, "2024-01-02", "[1,2]", '{"k":1}', '{"p":1}', None) and list(row.v) == [1.0]


def test_context_block(spark):
    schema = "page int, text string, f string, p string"
    rows = [(1, "  " + "x" * 12 + " ", "f.pdf", "a/f.pdf"), (None, None, "", "a/f.pdf"), (2, "short", None, None)]
    block = context_block(F.lit("pdf_text"), F.col("page"), F.col("text"), F.col("f"), F.col("p"), max_chars=10)
    assert values(spark, block, rows, schema) == [
        "[pdf_text p1] xxxxxxxxxx …\n(Source: f.pdf)", "[pdf_text p?] \n(Source: a/f.pdf)", "[pdf_text p2] short\n(Source: )"]
    whole = context_block(F.lit("c"), F.col("page"), F.col("text"), F.col("f"), F.col("p"), max_chars=0)
    assert values(spark, whole, rows, schema)[0] == "[c p1] xxxxxxxxxxxx\n(Source: f.pdf)"


def test_prompt(spark):
    got = values(spark, question_prompt(F.lit("Why?"), F.col("b")), [(["one", "two"],), ([],)], "b array<string>")
    assert got == [" Question: Why?\n\nContext:\none\n\ntwo   ", " Question: Why?\n\nContext:\n   "]


@pytest.mark.parametrize("raw, valid", [
    ('{"k": 3, "note": "x"}', True), ('{"k": 3}', True), (' {"k": 3} ', True), ('{"note": "x"}', False), ('{"k": "three"}', False),
    ('{"k": 3', False), ('Sure: {"k": 3}', False), ('{"k": 3} and more', False), ("", False), (None, False), ("[1]", False),
])
def test_checked_response(spark, raw, valid):
    schema = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("note", T.StringType(), True)])
    got = spark.createDataFrame([(raw,)], "r string").select(checked_response(F.col("r"), schema).alias("c")).first().c
    assert got.valid is valid
    assert got.response == ('{"k":3,"note":"x"}' if raw and "note" in raw else '{"k":3}') if valid else got.response == raw
