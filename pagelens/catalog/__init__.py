from pagelens.catalog import (  # noqa: F401  each import registers its queries
    documents, images, quality, retrieval, service_logs, storage, streams, tables,
)
from pagelens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
