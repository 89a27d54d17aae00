"""Content identity of page tables, and keeping one row per identity or id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagelens.functions.ids import content_hash

# Pages per node of the hash tree; three levels cover 4096**3 pages of one file.
TREE_WIDTH = 4096
TREE_LEVELS = 3


def document_hashes(pages: DataFrame, width: int = TREE_WIDTH, levels: int = TREE_LEVELS) -> DataFrame:
    """(pdf_path, doc_hash) for files given as page rows.

    A file's bytes are not at hand here, and joining all its pages in one task would not scale.
    So hashes are folded as a tree: every node hashes at most ``width`` child hashes in page order.
    """
    nodes = pages.select("pdf_path", F.col("page0").cast("bigint").alias("at"),
                         content_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    for level in range(levels):
        above = F.lit(0).cast("bigint") if level == levels - 1 else F.expr(f"at div {width}")
        ordered = F.array_sort(F.collect_list(F.struct("at", "hash")))
        nodes = (
            nodes.groupBy("pdf_path", above.alias("parent")).agg(ordered.alias("kids"))
            .select("pdf_path", F.col("parent").alias("at"),
                    content_hash(F.array_join(F.col("kids.hash"), "")).alias("hash"))
        )
    return nodes.select("pdf_path", F.col("hash").alias("doc_hash"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first by ``order``.

    ``row_number() = 1`` lets Spark drop all but one candidate per key and task before the shuffle,
    so a key with very many rows costs nothing extra.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def not_indexed(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Only rows whose ``doc_hash`` is not among the stored ones. ``stored`` is anything with that column, best a store's
    ``known_hashes``; a document of very many records is one hash per task before the shuffle."""
    return incoming if force else incoming.join(stored.select("doc_hash").distinct(), "doc_hash", "left_anti")


def indexed_flags(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct incoming hashes with ``already_indexed``."""
    wanted = incoming.select("doc_hash").distinct()
    known = wanted.join(stored.select("doc_hash").distinct(), "doc_hash", "left_semi").withColumn("_known", F.lit(True))
    return (
        wanted.join(known, "doc_hash", "left")
        .select("doc_hash", F.coalesce("_known", F.lit(False)).alias("already_indexed"))
    )


def upsert(stored: DataFrame, incoming: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Stored records with the incoming ones laid over them by ``id``.

    Inside the incoming batch the first by ``order`` wins. Stored rows are only probed by id and
    otherwise pass through: with a small batch the probe is a broadcast and the store is not shuffled.
    """
    fresh = keep_first(incoming, ["id"], order)
    kept = stored.join(incoming.select("id"), "id", "left_anti")
    return kept.select(*stored.columns).unionByName(fresh, allowMissingColumns=True)


def replace_documents(stored: DataFrame, incoming: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """As :func:`upsert`, and ids that vanished from a re-ingested file go too."""
    gone = stored.join(
        incoming.select(F.col("pdf_path")).distinct(), "pdf_path", "left_anti"
    ).select(*stored.columns)
    return upsert(gone, incoming, order)
