"""Following growing, rotating logs: every whole line once, over restarts."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import service_log

from pagelens.sources.tail import LineRange, TailReader, tail_logs, write_logs
from pagelens.streaming import monitors as M


@pytest.fixture
def live(spark, tmp_path):
    """A service's folder and a follower of it, which runs until all that is there is read."""
    folder = tmp_path / "logs"
    folder.mkdir()

    def follow(**options):
        rows = M.run_append(tail_logs(spark, str(folder), **options), str(tmp_path / "out"), str(tmp_path / "progress"))
        return Counter((r.file, r.start, r.value) for r in rows.collect())

    return folder, follow


def starts(name, text):
    out, at = [], 0
    for line in text.encode().split(b"\n")[:-1]:
        out.append((name, at, line.decode()))
        at += len(line) + 1
    return out


def test_growing_and_rotating(live):
    folder, follow = live
    log, other = folder / "rag_1.log", folder / "rag_2.log"
    first = "one é\ntwo\n"
    log.write_text(first + "not yet whole")
    assert follow() == Counter(starts("rag_1.log", first))
    assert follow() == Counter(starts("rag_1.log", first))  # nothing new, nothing twice
    whole = first + "not yet whole, but now\n\nfive\n"
    log.write_text(whole + "unfinished")
    other.write_text("a\n")
    (folder / "other.txt").write_text("no log\n")
    want = Counter(starts("rag_1.log", whole) + starts("rag_2.log", "a\n"))
    assert follow() == want
    # The log is finished, rotated, and a new one begins under its name.
    old = whole + "unfinished no more\n"
    log.write_text(old)
    log.rename(folder / "rag_1.log.1")
    log.write_text("fresh\n")
    want = Counter(starts("rag_1.log", old) + starts("rag_1.log", "fresh\n") + starts("rag_2.log", "a\n"))
    assert follow() == want
    # A second rotation shifts both.
    (folder / "rag_1.log.1").rename(folder / "rag_1.log.2")
    log.rename(folder / "rag_1.log.1")
    log.write_text("newest\r\nline\n")
    other.write_text("a\nb\n")
    want += Counter([("rag_1.log", 0, "newest"), ("rag_1.log", 8, "line"), ("rag_2.log", 2, "b")])
    assert follow() == want and max(want.values()) == 1


def test_equal_first_lines(live):
    """Two files of one log that begin alike are told apart by their age."""
    folder, follow = live
    (folder / "rag_1.log.1").write_text("same\nx\n")
    (folder / "rag_1.log").write_text("same\ny\n")
    assert follow() == Counter(starts("rag_1.log", "same\nx\n") + starts("rag_1.log", "same\ny\n"))
    (folder / "rag_1.log").write_text("same\ny\nz\n")
    assert follow()["rag_1.log", 7, "z"] == 1


def test_ranges(tmp_path):
    """However a file is cut into ranges, each line is read by one of them."""
    lines = ["", "a", "bb", "é" * 700, "", "last"] * 3
    text = "\n".join(lines) + "\nopen end"
    (tmp_path / "rag_1.log").write_text(text)
    for size in (1, 2, 3, 7, 64, 1000, 10 ** 6):
        reader = TailReader(str(tmp_path), "*.log", size, "fail")
        end = reader.latestOffset()
        rows = [r for p in reader.partitions({}, end) for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert rows == starts("rag_1.log", text), size
        half = {k: v // 2 for k, v in end.items()}
        key, = end
        behind = text.encode()[:half[key]].rfind(b"\n") + 1
        part = [r for p in reader.partitions({key: behind}, end) for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert part == [r for r in starts("rag_1.log", text) if r[1] >= behind]


def test_lost_files(tmp_path):
    gone = LineRange("rag_1.log/0000000000000000/0", 0, 10)
    with pytest.raises(FileNotFoundError, match="is gone"):
        list(TailReader(str(tmp_path), "*.log", 10, "fail").read(gone))
    assert list(TailReader(str(tmp_path), "*.log", 10, "ignore").read(gone)) == []
    assert TailReader(str(tmp_path / "none"), "*.log", 10, "fail").latestOffset() == {}


def test_monitors_see_appended_lines(spark, tmp_path):
    """An error that is appended to a log already read raises an alert."""
    folder, out, progress = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()
    log = folder / "rag_20251019.log"
    log.write_text("\n".join(service_log()) + "\n")

    def alerts():
        return M.run_append(M.error_alerts(tail_logs(spark, str(folder))), out, progress).count()

    assert alerts() == 1
    with log.open("a") as file:
        file.write("2025-10-19 16:00:00 | ERROR    | app.x | late\n2025-10-19 16:00:01 | ERROR    | app.x | half")
    assert alerts() == 2
    with log.open("a") as file:
        file.write(" a line\n")
    assert alerts() == 3


def test_write_logs(spark, tmp_path):
    rows = [(f"rag_{i % 3}.log", i, f"line {i}") for i in range(1000)]
    write_logs(spark.createDataFrame(rows, "file string, line_no bigint, value string").repartition(7), str(tmp_path / "logs"))
    for n in range(3):
        assert (tmp_path / "logs" / f"rag_{n}.log").read_text() == "".join(f"line {i}\n" for i in range(n, 1000, 3))
    assert len(list((tmp_path / "logs").iterdir())) == 3
