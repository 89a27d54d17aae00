"""What no plan may contain, over all registered queries."""

from __future__ import annotations

import pytest
from conftest import SF

from pagelens.catalog import QUERIES

# Queries that call Python on purpose: splitters, embedders, models, matrix search.
PYTHON = {
    "chunk_recursive", "chunk_recursive_spans", "embed_hash", "caption_images", "generate_vision", "generate_answers",
    "knn_per_collection", "retrieve_multi", "retrieve_two_each", "retrieve_cosine", "retrieve_ip", "knn_by_cells", "knn_probed",
    "ip_by_cells", "knn_stored_cells",
    "chunk_contract", "chunk_rows", "generate_schema", "hit_records", "format_context", "build_prompt", "answer_questions", "search_text", "ask_documents", "context_list",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, plan_of, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_the_splitter_runs_once(spark, plan_of):
    for name in ("chunk_contract", "chunk_recursive_spans"):
        assert plan_of(QUERIES[name](spark, SF)).count("ArrowEvalPython") == 1
