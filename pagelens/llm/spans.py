"""Positions of regular-expression matches, from built-in functions alone.

Spark returns the matched strings but not where they stand. ``split`` by the same pattern returns the
text between the matches, so lengths of gaps and matches, summed up in turn, give every position in code
points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string,found:string>"


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")

# Sums run inside slices of this many matches and over slices, so n matches cost n * 64 steps, not n * n.
SLICE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def running_sums(values: Column) -> Column:
    """Sums of the first 1, 2, ... elements of an array of int; it must not be empty."""

    def over_slices(slices: Column) -> Column:
        return let(
            F.transform(slices, _sum),
            lambda sums: F.flatten(F.transform(
                slices,
                lambda part, i: let(
                    _sum(F.slice(sums, 1, i)),
                    lambda before: F.transform(part, lambda _, j: before + _sum(F.slice(part, 1, j + 1))),
                ),
            )),
        )

    return let(
        values,
        lambda v: let(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SLICE).cast("int")),
                lambda b: F.slice(v, b * SLICE + 1, SLICE),
            ),
            over_slices,
        ),
    )


def spans_of(
    text: Column, kind: str, rank: int, pattern: str, keep: Callable[[Column], Column] | None = None,
) -> Column:
    """All leftmost non-overlapping matches as structs (start, rank, end, kind, found), in text order.

    ``pattern`` must not match the empty string. Matches for which ``keep(found)`` is not true are left
    out after the search, so they still consume their characters. Null text is empty.
    """
    whole = F.coalesce(text, F.lit(""))

    def build(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
            return let(
                running_sums(steps),
                lambda ends: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (ends[i] - F.length(m)).alias("start"), F.lit(rank).alias("rank"), ends[i].alias("end"),
                        F.lit(kind).alias("kind"), m.alias("found"),
                    ),
                ),
            )

        all_spans = F.when(F.size(found) > 0, let(F.split(whole, pattern, -1), placed)).otherwise(no_spans())
        return F.filter(all_spans, lambda s: keep(s["found"])) if keep else all_spans

    return let(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), build)


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start and rank, comma-joined."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans), 256)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each span replaced. Of overlapping spans the earlier takes its characters and the
    later replaces what is left of its own. Null text stays null.

    Spans are treated in slices: a slice rewrites its own stretch of the text, so a text with n spans costs n steps over
    stretches of SLICE spans instead of n steps over the whole text.
    """

    def stretch(ordered: Column, reach: Column, k: Column) -> Column:
        """What becomes of the text from the end of the slices before to the end of slice k."""
        part = F.slice(ordered, k * SLICE + 1, SLICE)
        begin = F.coalesce(F.get(reach, k - 1), F.lit(0))
        end = reach[k]
        return let(F.struct(begin.alias("begin"), F.substring(text, begin + 1, end - begin).alias("own")), lambda at: _rewritten(
            at["own"], at["begin"], part, replacement))

    def whole(ordered: Column) -> Column:
        slices = F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / SLICE).cast("int"))
        tops = F.transform(slices, lambda k: F.array_max(F.transform(F.slice(ordered, k * SLICE + 1, SLICE), lambda s: s["end"])))
        # Spans of a slice may end before those of an earlier one.
        return let(running_max(tops), lambda reach: F.concat(
            F.array_join(F.transform(slices, lambda k: stretch(ordered, reach, k)), ""),
            F.substring(text, F.element_at(reach, -1) + 1, F.length(text))))

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), whole)).otherwise(text)


def _rewritten(own: Column, begin: Column, part: Column, replacement: Callable[[Column], Column]) -> Column:
    """The stretch ``own`` of a text, which starts at ``begin`` and ends with the last of its spans, with these replaced."""

    def step(state: Column, span: Column) -> Column:
        done = F.greatest(state["done"], span["start"])
        fresh = span["end"] > state["done"]
        return F.struct(
            F.greatest(state["done"], span["end"]).alias("done"),
            F.when(fresh, F.concat(
                state["out"],
                F.array(F.substring(own, state["done"] - begin + 1, done - state["done"]), replacement(span)),
            )).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(begin.alias("done"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(part, start, step, lambda state: F.array_join(state["out"], ""))


def running_max(values: Column) -> Column:
    """The greatest of the first 1, 2, ... elements of an array, by slices like running_sums."""
    return let(
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SLICE).cast("int")),
            lambda b: F.slice(values, b * SLICE + 1, SLICE)),
        lambda slices: let(
            F.transform(slices, F.array_max),
            lambda tops: F.flatten(F.transform(slices, lambda part, i: let(
                F.array_max(F.slice(tops, 1, i)),
                lambda before: F.transform(part, lambda _, j: F.greatest(before, F.array_max(F.slice(part, 1, j + 1)))))))))
