from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagelens.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def plan_of():
    def plan(df) -> str:
        return df._jdf.queryExecution().executedPlan().toString()

    return plan


# One run of the service: (minute, seconds of retrieval, generation, whole answer, evaluation, relevancy).
# A run without evaluation has None there; one whose evaluation failed has no relevancy.
RUNS = [
    ("12:01", 1.17, 2.14, 3.31, None, None),
    ("12:03", 1.20, 1.63, 2.84, 11.07, None),
    ("12:07", 1.31, 1.45, 2.76, 11.58, 0.8098),
    ("12:08", 1.24, 1.65, 2.90, 12.88, 0.8066),
    ("14:19", 1.29, 1.80, 3.09, 12.65, 0.8513),
]


def service_log(runs=RUNS) -> list[str]:
    """A day's log: 10 lines for a run without evaluation, 17 with it."""
    lines = []
    for minute, retrieval, generation, whole, evaluation, relevancy in runs:
        def say(level, module, message):
            lines.append(f"2025-10-19 {minute}:00 | {level:<8} | {module} | {message}")

        say("INFO", "__main__", "Starting retrieval")
        say("INFO", "__main__", "Loading the embedder")
        say("INFO", "app.search", "Opening collections: ('pdf_text', 'pdf_tables', 'pdf_images')")
        say("INFO", "app.model", "Opening the model")
        say("INFO", "app.search", "Answering a question")
        say("INFO", "app.search", "Retrieving context (k_each=4, top_n=6)")
        say("INFO", "app.search", f"Retrieved 6 documents in {retrieval:.2f}s (from 7 total hits)")
        say("INFO", "app.model", "Starting text generation (prompt length: 5255 chars)")
        say("INFO", "app.model", f"Generation completed in {generation:.2f}s (response: 588 chars)")
        say("INFO", "app.search", f"Answer generated in {whole:.2f}s (answer length: 588 chars)")
        if evaluation is not None:
            say("INFO", "__main__", "Starting evaluation...")
            say("INFO", "app.quality", "Starting evaluation of one answer")
            say("INFO", "app.quality", "Prepared 6 context chunks")
            say("INFO", "app.quality", "Running the judge")
            say("INFO", "app.quality", f"Evaluation completed in {evaluation:.2f}s (judge: {evaluation - .02:.2f}s)")
            if relevancy is None:
                say("ERROR", "app.quality", f"Evaluation failed after {evaluation:.2f}s: unsupported format string")
            else:
                say("INFO", "app.quality", f"Results - Faithfulness: 1.0000, Answer Relevancy: {relevancy:.4f}")
            say("INFO", "__main__", "Retrieval completed successfully")
    return lines


@pytest.fixture
def log_lines(spark):
    def build(lines, file="rag_20251019.log"):
        rows = [(file, i, line) for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "file string, line_no bigint, value string")

    return build
