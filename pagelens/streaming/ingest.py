"""Incremental ingest: new files in a stream, each content stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pagelens.operators.identity import keep_first, not_indexed
from pagelens.session import scratch_path
from pagelens.sources.store import RecordStore


def run_ingest(
    files: DataFrame, store: RecordStore, to_records: Callable[[DataFrame], DataFrame], *,
    order: str = "pdf_path", checkpoint: str | None = None,
) -> RecordStore:
    """Stream of (pdf_path, doc_hash, ...) into ``store``.

    Inside a micro-batch the first file of each content counts; against the store an anti join with the stored hashes
    of the batch's own prefixes skips what earlier batches hold. ``to_records`` must give every record an id of its own. There is no streaming state to grow: the stored hashes
    are the state. A batch that runs again sees the store as it was before it and replaces its own folder.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        first = keep_first(batch, ["doc_hash"], [order]).persist()
        fresh = not_indexed(first, store.known_hashes(first, before=batch_id)).persist()
        try:
            store.append(to_records(fresh), batch_id, unique=True)
        finally:
            fresh.unpersist()
            first.unpersist()

    query = (
        files.writeStream.foreachBatch(absorb).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or scratch_path(files.sparkSession, "progress")).start()
    )
    query.awaitTermination()
    return store
