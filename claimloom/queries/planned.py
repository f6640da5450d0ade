"""Queries on whole plans."""

from pyspark.sql import functions as F

from ..plans import progress, verify
from . import query, searching, table
from .verification import LEVELS


def sources(spark, sf_dir):
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", level.alias("court_level"), F.lit("case").alias("doc_type"))


@query()
def verify_claims(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    return verify.verify_claims(sources(spark, sf_dir), asked, index=searching.index_of(spark, sf_dir)).drop("text")


@query()
def review_answers(spark, sf_dir):
    """The benchmark texts taken as answers, each split into its claims."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), "text")
    return verify.review_answers(sources(spark, sf_dir), texts, index=searching.index_of(spark, sf_dir))


_STATUS = "['ok', 'error:Timeout', 'warning:dense:ValueError', 'skipped:no_claims', 'applied:scoped', 'unknown', '', 'disabled:off', NULL]"


@query(f"""WITH r AS (SELECT 1000 + conv_id * 100 + turn AS id, {_STATUS}[turn % 9 + 1] AS rs, {_STATUS}[(turn + conv_id) % 9 + 1] AS gs, {_STATUS}[(2 * turn + conv_id) % 9 + 1] AS vs, CASE WHEN turn % 2 = 0 THEN role END AS mode, CASE WHEN turn % 3 <> 0 THEN turn END AS n,
        CASE WHEN conv_id % 4 <> 0 THEN length(text) % 3 END AS claims, CAST(length(text) * 20 + 3 AS DOUBLE) AS ms FROM conversations),
    k AS (SELECT *, coalesce(nullif(rs, ''), 'unknown') AS r1, coalesce(nullif(gs, ''), 'unknown') AS g1, coalesce(nullif(vs, ''), 'unknown') AS v1, CASE WHEN ms >= 1000 THEN printf('%.1fs', ms / 1000) ELSE printf('%.0fms', ms) END AS t FROM r),
    st AS (SELECT id, 1 AS step, 'Legal context retrieval' AS label, r1 AS s, concat_ws(' | ', r1, n || ' source chunk(s)', t) AS meta FROM k UNION ALL SELECT id, 2, 'Answer generation', g1, concat_ws(' | ', g1, mode, t) FROM k
        UNION ALL SELECT id, 3, 'Claim extraction', CASE WHEN coalesce(claims, 0) > 0 THEN 'ok' ELSE coalesce(vs, '') END, coalesce(claims, 0) || ' claim(s) extracted | ' || t FROM k UNION ALL SELECT id, 4, 'Claim verification', v1, concat_ws(' | ', v1, t) FROM k),
    z AS (SELECT *, CASE WHEN starts_with(s, 'error') THEN 'error' WHEN regexp_matches(s, '^(skipped|disabled):') THEN 'skipped' WHEN s IN ('', 'unknown') THEN 'waiting' ELSE 'done' END AS state FROM st)
    SELECT id, CAST(step AS BIGINT) AS step, label, state, CASE WHEN step = 3 AND state = 'error' THEN 'Claim extraction did not complete.' ELSE meta END AS meta FROM z""")
def progress_steps(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id")
    known = [F.lit(x) for x in ("ok", "error:Timeout", "warning:dense:ValueError", "skipped:no_claims", "applied:scoped", "unknown", "", "disabled:off", None)]
    status = lambda n: F.element_at(F.array(*known), (n % 9 + 1).cast("int"))
    ms = (F.length("text") * 20 + 3).cast("double")
    rows = table(spark, sf_dir, "conversations").select(
        (1000 + conv * 100 + turn).alias("id"), status(turn).alias("retrieval_status"), status(turn + conv).alias("generation_status"), status(2 * turn + conv).alias("verification_status"), F.when(turn % 2 == 0, F.col("role")).alias("generation_mode"),
        F.when(turn % 3 != 0, turn).alias("retrieval_count"), F.when(conv % 4 != 0, F.length("text") % 3).alias("claim_count"), *[ms.alias(f"{x}_ms") for x in ("retrieval", "generation", "extraction", "verification")],
    )
    return progress.completed_steps(rows, by="id")
