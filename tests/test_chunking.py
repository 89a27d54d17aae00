"""The recursive splitter against its contract and against a plain string version of it."""

from __future__ import annotations

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SF
from pagelens.operators.chunking import (
    chunk_rows, chunk_table, explode_chunks, page_chunks, recursive_chunks, split_page, window_chunks,
)


def naive(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Strings only, no offsets: cut at the coarsest separator present, recurse into long pieces,
    join short ones greedily, keep a tail."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, finer = separators[at], separators[at + 1:]
    if separator == "":
        pieces = list(text)
    else:
        head, *rest = text.split(separator)
        pieces = [p for p in [head, *(separator + r for r in rest)] if p]
    out, short = [], []

    def flush():
        window = []
        for piece in short:
            if window and sum(map(len, window)) + len(piece) > size:
                out.append("".join(window))
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size):
                    window.pop(0)
            window.append(piece)
        if window:
            out.append("".join(window))
        short.clear()

    for piece in pieces:
        if len(piece) < size or not finer:
            short.append(piece)
        else:
            flush()
            out.extend(naive(piece, size, overlap, finer))
    flush()
    return out


def stripped(chunks):
    return [c.strip() for c in chunks if c.strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(3, 40), st.integers(0, 2))
def test_equals_naive(text, size, overlap):
    got = [c["chunk"] for c in split_page(text, size, overlap)]
    assert got == (stripped(naive(text, size, overlap)) if text else [])


def check_contract(text, chunks, size, overlap):
    covered = [False] * len(text)
    last_start = -1
    for c in chunks:
        assert 0 < len(c["chunk"]) <= size
        assert text[c["start"]:c["end"]] == c["chunk"]
        assert c["start"] > last_start
        last_start = c["start"]
        covered[c["start"]:c["end"]] = [True] * (c["end"] - c["start"])
    assert all(seen or ch.isspace() for seen, ch in zip(covered, text))
    for a, b in zip(chunks, chunks[1:]):
        assert a["end"] - b["start"] <= overlap


def test_contract_on_documents_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    pages = [r.text for r in docs] + [
        "x" * 1200, "x" * 1201, "x" * 5000, ("word " * 900) + "\n\n" + "y" * 3000, "a\n\nb", " \n \n ",
        ("para " * 100 + "\n\n") * 9,
    ]
    for page in pages:
        check_contract(page, split_page(page), 1200, 150)


def test_edges():
    assert split_page(None) == [] and split_page("") == [] and split_page("  \n\n ") == []
    assert len(split_page("x" * 1200)) == 1
    assert [len(c["chunk"]) for c in split_page("x" * 1201)] == [1200, 151]
    assert [len(c["chunk"]) for c in split_page("x" * 5000)] == [1200, 1200, 1200, 1200, 800]


def test_same_chunks_whatever_the_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one = explode_chunks(docs.coalesce(1), recursive_chunks()(F.col("text")))
    many = explode_chunks(docs.repartition(7), recursive_chunks()(F.col("text")))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_window_chunks(spark):
    rows = [(1, "abcdefghij"), (2, ""), (3, None), (4, "abc"), (5, "abcd"), (6, "éü" * 700), (7, "x" * 193), (8, "y" * 192)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = explode_chunks(df, window_chunks(F.col("text"), 4, 1)).orderBy("id", "chunk_no").collect()
    want = [
        (key, at, start, min(start + 4, len(text)), text[start:start + 4])
        for key, text in rows for at, start in enumerate(range(0, len(text or ""), 3))]
    assert [(r.id, r.chunk_no, r.start, r.end, r.text) for r in got] == want


def test_rows_equal_arrays(spark):
    texts = [None, "", "  \n ", "one", "para one\n\npara two " * 300, "x" * 5000, "a b " * 60_000, "é😀 " * 2000]
    pages = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "page int, text string, chunk string").repartition(3)
    rows = chunk_rows(pages.withColumnRenamed("chunk", "other"), "page", "other", size=200, overlap=30)
    got = {}
    for r in rows.collect():
        assert r.other == "c"
        got.setdefault(r.page, []).append((r.chunk_no, r.start, r.end, r.chunk))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == [(n, c["start"], c["end"], c["chunk"]) for n, c in enumerate(split_page(text, 200, 30))]
    spark.udtf.register("cut_text", chunk_table(200, 30))
    pages.createOrReplaceTempView("some_pages")
    assert spark.sql("select page, c.chunk_no from some_pages, lateral cut_text(text) c").count() == rows.count()


def test_a_large_page_is_cut_in_flat_memory():
    """100 MB with paragraphs shorter and longer than a chunk: beside the text itself, next to nothing is held."""
    import tracemalloc

    text = ("A short paragraph of words.\n\n" * 40 + "word " * 900 + "\n\n" + "z" * 3000 + "\n") * (100 * 2 ** 20 // 8700)
    assert len(text) > 90 * 2 ** 20
    tracemalloc.start()
    n, covered = 0, 0
    for start, end, chunk in page_chunks(text):
        n += 1
        covered = max(covered, end)
        if n == 20_000:
            break
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert covered > 10 ** 7 and held < 2 ** 20
