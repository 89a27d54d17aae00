"""Scalar column functions over text and paths. All of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that counts as white space when a cell, caption or chunk is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def non_empty(text: Column) -> Column:
    """The text, or null when it is null or ``''``."""
    return F.nullif(text, F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*[non_empty(t) for t in texts], F.lit(""))


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def char_count(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def shorten(text: Column, limit: int, marker: str) -> Column:
    """Cut at ``limit`` characters and add ``marker``, only where the text is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def page_number(page0: Column) -> Column:
    """0-based, possibly missing page index to 1-based page number."""
    return (F.coalesce(page0, F.lit(0)) + 1).cast("int")


def ocr_clean(text: Column, limit: int = 2000) -> Column:
    return F.substring(strip(text), 1, limit)


def preview(text: Column, limit: int = 400) -> Column:
    return F.substring(text, 1, limit)


def clean_cells(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.coalesce(strip(c), F.lit("")))


def table_preview(title: Column, headers: Column, first: Column, second: Column) -> Column:
    """``Table[: title]. Headers: a | b[. Example rows: r1][ ; r2]``; an absent or empty row adds nothing."""

    def example(lead: str, row: Column) -> Column:
        return F.when(F.size(row) > 0, F.concat(F.lit(lead), F.array_join(row, " | "))).otherwise("")

    label = F.when(has_text(title), F.concat(F.lit("Table: "), title, F.lit("."))).otherwise("Table.")
    return F.concat(
        label, F.lit(" Headers: "), F.array_join(headers, " | "),
        example(". Example rows: ", first), example(" ; ", second),
    )


def table_body(preview_text: Column, page: Column) -> Column:
    return F.coalesce(non_empty(strip(preview_text)), F.concat(F.lit("Table on page "), page.cast("string")))


def image_body(caption: Column, ocr: Column, page: Column, pdf_path: Column) -> Column:
    """Caption, then the recognised text on a line of its own; a place note when both are missing."""
    said = F.coalesce(strip(caption), F.lit(""))
    seen = F.when(has_text(ocr), F.concat(F.lit("OCR: "), strip(ocr)))
    body = strip(F.concat_ws("\n", non_empty(said), seen))
    place = F.concat(F.lit("Image on page "), page.cast("string"), F.lit(" of "), file_name(pdf_path))
    return F.coalesce(non_empty(body), place)
