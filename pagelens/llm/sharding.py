"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first, exactly as a uniform permutation of all rows
would have it (a multivariate hypergeometric draw for each partition from what is left of every shard). Then each
partition permutes its rows and deals them out by its line of the matrix, the rows are exchanged, and each
shard permutes what it received. Shard sizes are fixed beforehand, so counts are at most one apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from pagelens.operators.numbering import running_number
from pagelens.session import materialize

SHARDS = 40
SEED = 20_240_601
# Rows of one input partition or of one slice of a shard that a task orders.
PART_ROWS = 131_072
LAW = "rows"


def communication_matrix(partitions: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows of partition p for shard s. Column sums are the shard sizes, at most one apart."""
    total = sum(partitions)
    left = np.full(shards, total // shards, np.int64)
    left[:total % shards] += 1
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(partitions), shards), np.int64)
    for p, n in enumerate(partitions):
        # The marginal method draws binomially split counts one shard at a time; its memory is one line.
        matrix[p] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= matrix[p]
    return matrix


def shard(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard) to every row.

    Rows are dealt by their place in the stored input and not by their content, so equal rows, null keys and hot
    groups are spread like any others, and a lost executor recomputes the same answer. What reaches the driver
    is one count per input partition of about PART_ROWS rows, which is also the number of lines drawn.
    """
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    stored = materialize(numbered, "rows")
    # A partition is a stretch of PART_ROWS rows of one task's output.
    part = F.concat_ws(":", F.shiftright("_at", 33), F.shiftright("_at", PART_ROWS.bit_length() - 1))
    keyed = stored.withColumn("_part", part)
    sizes = sorted((r["_part"], r["count"]) for r in keyed.groupBy("_part").count().collect())
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    ends = matrix.cumsum(axis=1)
    plan = rows.sparkSession.createDataFrame(
        [(p, ends[i].tolist()) for i, (p, _) in enumerate(sizes)], "_part string, _ends array<bigint>")
    local = Window.partitionBy("_part").orderBy(F.xxhash64("_at", F.lit(seed)), "_at")
    dealt = (
        keyed.withColumn("_n", F.row_number().over(local))
        .join(plan, "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda end: end < F.col("_n"))))
    )
    # The second permutation: order by a fresh random key, ranked slice by slice of the key's range.
    dealt = materialize(dealt.select(*rows.columns, "_at", "shard"), "exchanged")
    slices = max(1, -(-sum(n for _, n in sizes) // (shards * PART_ROWS)))
    key = F.xxhash64("_at", F.lit(seed + 1))
    keyed = dealt.withColumn("_key", key)
    bucket = F.pmod(F.shiftright("_key", 20), F.lit(slices))
    return running_number(keyed, ["shard"], ["_key", "_at"], bucket, "slot").select(
        *rows.columns, "shard", F.col("slot").cast("bigint").alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document. Size: UTF-8 bytes of the text
    (null: none) plus 16. The crc of a null text is that of no bytes, 0."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(facts, shards).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
