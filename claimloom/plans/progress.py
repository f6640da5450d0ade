"""Progress of a plan: row counts of its stages, observed while it runs, and the steps shown for an answer.

Each stage is an ``Observation``, so its count comes with the action that runs
the plan and no further pass is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as tx


class Progress:
    """``watched`` marks a stage; ``rows`` tells what is known of all of them, at any time."""

    def __init__(self):
        self.stages: list[tuple[str, Observation]] = []

    def watched(self, stage: str, df: DataFrame) -> DataFrame:
        seen = Observation(f"{stage}-{len(self.stages)}")
        self.stages.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[dict]:
        """stage, state (``done`` or ``open``) and rows of each stage in order; an open stage has no rows yet."""
        out = []
        for stage, seen in self.stages:
            known = self._known(seen)
            out.append({"stage": stage, "state": "open" if known is None else "done", "rows": None if known is None else known["rows"]})
        return out

    @staticmethod
    def _known(seen: Observation) -> dict | None:
        done = seen._jo.future().isCompleted()  # ``get`` would wait for the action
        return seen.get if done else None


# Labels of the steps of an answer.
RETRIEVAL, GENERATION, EXTRACTION, VERIFICATION = "Legal context retrieval", "Answer generation", "Claim extraction", "Claim verification"


def status_kind(status: Column) -> Column:
    """``done``, ``skipped``, ``error`` or ``waiting`` from the status text of a backend."""
    said = F.lower(tx.strip(F.coalesce(status, F.lit(""))))
    return (
        F.when(said.rlike("^error(?::|$)"), "error").when(said.rlike("^(?:skipped|disabled):"), "skipped")
        .when((said == "") | (said == "unknown"), "waiting").otherwise("done")
    )


def timing(ms: Column) -> Column:
    """Seconds with one decimal (halves go up) from 1,000 ms on, else whole milliseconds; nothing for null."""
    return F.when(ms >= 1000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s"))).otherwise(F.concat(F.format_string("%.0f", ms.cast("double")), F.lit("ms")))


def completed_steps(rows: DataFrame, *, by: str) -> DataFrame:
    """(by, step, label, state, meta): the four steps of each finished answer.

    ``rows``: by, retrieval_status, generation_status, verification_status, generation_mode,
    retrieval_count, claim_count and retrieval_ms, generation_ms, extraction_ms,
    verification_ms; all but ``by`` may be null.
    """
    told = lambda status: F.coalesce(F.nullif(F.col(status), F.lit("")), F.lit("unknown"))
    meta = lambda *parts: F.concat_ws(" | ", *parts)  # noqa: E731 nulls are left out
    claims = F.coalesce("claim_count", F.lit(0))
    extraction = F.when(claims > 0, "done").otherwise(status_kind(F.col("verification_status")))
    found = F.concat(F.col("retrieval_count").cast("string"), F.lit(" source chunk(s)"))
    steps = [
        (RETRIEVAL, status_kind(told("retrieval_status")), meta(told("retrieval_status"), found, timing(F.col("retrieval_ms")))),
        (GENERATION, status_kind(told("generation_status")), meta(told("generation_status"), F.nullif(F.col("generation_mode"), F.lit("")), timing(F.col("generation_ms")))),
        (EXTRACTION, extraction, F.when(extraction == "error", "Claim extraction did not complete.").otherwise(meta(F.concat(claims.cast("string"), F.lit(" claim(s) extracted")), timing(F.col("extraction_ms"))))),
        (VERIFICATION, status_kind(told("verification_status")), meta(told("verification_status"), timing(F.col("verification_ms")))),
    ]
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(label).alias("label"), state.alias("state"), said.alias("meta")) for i, (label, state, said) in enumerate(steps, 1)])
    return rows.select(by, F.inline(each))
