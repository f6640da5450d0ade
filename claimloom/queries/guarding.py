"""Queries on guards, answer modes and the place of claims in answers."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lexicon
from ..operators import guards
from . import answering, query, table
from .evidence import quoted
from .verification import ts

EV = lexicon.EVIDENCE_STOPWORDS
# id, claim, evidence, label, question, target, citation
ROWS = [
    ("Warrants need probable cause.", "A warrant issues on probable cause.", "VERIFIED", "use only retrieved sources on warrant and probable cause", "Smith v. Jones", None),
    ("Warrants need probable cause shown by oath.", "Unrelated text on tariffs.", "SUPPORTED", "If the retrieved sources do not mention maritime salvage, say that instead", None, None),
    ("Tariffs rose.", "Tariffs fell.", "POSSIBLE_SUPPORT", "do not guess about quasar nebula", "X v. Y", None),
    ("Based on related retrieved authorities the rule holds.", "The rule holds.", "SUPPORTED", "plain question", None, None),
    ("The rule applies to agencies here.", "The rule applies to agencies here and there.", "SUPPORTED", "", None, "999 U.S. 111"),
    ("Anything", None, "UNSUPPORTED", None, None, None),
]
_Q = lambda s: "NULL" if s is None else quoted(s)
_V = f"v(id, c, e, l, q, t, u) AS (VALUES {', '.join(f'({i}, {", ".join(map(_Q, r))})' for i, r in enumerate(ROWS))})"
#: Turns with the turn before them, as further rows.
SAID = "said AS (SELECT 1000 + conv_id * 100 + turn AS id, conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM conversations)"
_POS = "('VERIFIED', 'SUPPORTED', 'POSSIBLE_SUPPORT')"


def said(spark, sf_dir):
    """(id, conv_id, turn, role, text, earlier): all turns with the text of the turn before."""
    earlier = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumn("earlier", earlier)
    return talk.withColumn("id", 1000 + F.col("conv_id") * 100 + F.col("turn"))


@query(f"""WITH {_V.replace("v(", "v0(", 1)}, {SAID},
    v AS (SELECT * FROM v0 UNION ALL SELECT id, text, earlier, ['VERIFIED', 'SUPPORTED', 'POSSIBLE_SUPPORT', 'UNSUPPORTED'][turn % 4 + 1], CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 'use only retrieved sources on ' || text ELSE text END,
        CASE WHEN conv_id % 3 = 0 THEN 'Smith v. Jones' END, CASE WHEN turn % 5 = 0 THEN '999 U.S. 111' END FROM said),
    k AS (SELECT *, {ts("coalesce(c, '')", EV, 2)} AS ct, {ts("coalesce(e, '')", EV, 2)} AS et, {ts("concat_ws(' ', c, e)", EV, 2)} AS both_, list_filter({ts("coalesce(q, '')", EV + lexicon.SUBJECT_GENERIC, 2)}, lambda x: length(x) >= 4) AS su FROM v),
    n AS (SELECT *, len(list_intersect(ct, et)) AS o FROM k),
    s AS (SELECT id, l, CASE WHEN coalesce(t, '') = '' THEN 'not_applied:no_target_case' WHEN len(ct) = 0 OR len(et) = 0 THEN 'not_applied:no_alignment_tokens' WHEN o >= 2 THEN 'passed:token_overlap'
            WHEN len(ct) <= 5 AND o > 0 THEN 'passed:short_claim_overlap' ELSE 'blocked:low_target_evidence_overlap' END AS target,
        CASE WHEN l NOT IN {_POS} THEN 'not_applied:verdict_not_supported' WHEN coalesce(q, '') = '' THEN 'not_applied:no_query' WHEN NOT regexp_matches(q, {quoted(guards.BOUND_QUESTION)}) THEN 'not_applied:not_source_discipline_query'
            WHEN len(su) < 2 THEN 'not_applied:not_enough_subject_tokens' WHEN list_has_all(both_, su) THEN 'passed:query_subject_alignment' ELSE 'blocked:query_subject_mismatch' END AS subject,
        CASE WHEN l NOT IN {_POS} THEN 'not_applied:verdict_not_supported' WHEN coalesce(t, '') <> '' THEN 'not_applied:not_high_risk' WHEN regexp_matches(c, {quoted(guards.RELATED_CLAIM)}) THEN 'blocked:high_risk_related_authority_claim'
            WHEN u IS NOT NULL AND NOT contains(regexp_replace(lower(coalesce(e, '')), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(u), '[^a-z0-9]+', '', 'g')) THEN 'blocked:high_risk_unresolved_citation_mismatch'
            WHEN len(ct) = 0 OR len(et) = 0 THEN 'not_applied:no_alignment_tokens' WHEN o >= CASE WHEN len(ct) <= 6 THEN 2 ELSE 3 END THEN 'passed:high_risk_content_overlap' ELSE 'blocked:high_risk_low_source_alignment' END AS risk FROM n)
    SELECT CAST(id AS BIGINT) AS id, target, subject, risk, CASE WHEN target LIKE 'blocked%' OR subject LIKE 'blocked%' OR risk LIKE 'blocked%' THEN 'UNSUPPORTED' ELSE l END AS final_label FROM s""")
def support_guards(spark, sf_dir):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "id long, c string, e string, l string, q string, t string, u string")
    turn = F.col("turn")
    label = F.element_at(F.array(*[F.lit(x) for x in ("VERIFIED", "SUPPORTED", "POSSIBLE_SUPPORT", "UNSUPPORTED")]), (turn % 4 + 1).cast("int"))
    asked = F.when(turn % 3 == 1, F.concat(F.lit("use only retrieved sources on "), "text")).when(turn % 3 == 2, F.col("text"))
    more = said(spark, sf_dir).select("id", F.col("text").alias("c"), F.col("earlier").alias("e"), label.alias("l"), asked.alias("q"), F.when(F.col("conv_id") % 3 == 0, "Smith v. Jones").alias("t"), F.when(turn % 5 == 0, "999 U.S. 111").alias("u"))
    rows = rows.unionByName(more)
    no, none = F.lit(False), F.lit(None).cast("string")
    c, e, label = F.col("c"), F.col("e"), F.col("l")
    risky = guards.is_high_risk(target=F.col("t"), uploads=no, status=F.lit("not_resolved:no_signal"), source=F.lit("unresolved"), context=none, mode=none, missing_case=none)
    out = rows.withColumns({
        "target": guards.target_alignment(c, e, F.col("t")),
        "subject": guards.query_subject(c, e, label, F.col("q"), no),
        "risk": guards.high_risk(c, e, label, risky=risky, leads=no, unresolved_citation=F.col("u")),
    })
    return guards.apply_all(out, ["target", "subject", "risk"], label="l").select("id", "target", "subject", "risk", "final_label")


MODES = [("direct", False, False, False, False), ("direct", False, False, True, False), ("retrieval", True, True, True, True), ("retrieval", False, True, True, False), ("retrieval", False, False, True, True)]


@query(f"""WITH v0(id, g, f, r, u, l) AS (VALUES {', '.join(f"({i}, '{g}', {f}, {r}, {u}, {x})" for i, (g, f, r, u, x) in enumerate(MODES))}),
    v AS (SELECT * FROM v0 UNION ALL SELECT 1000 + conv_id * 100 + turn, CASE WHEN role = 'assistant' THEN 'direct' ELSE 'retrieval' END, turn % 5 = 4, turn % 3 = 2, length(text) % 2 = 0, conv_id % 4 = 0 FROM conversations)
    SELECT CAST(id AS BIGINT) AS id, CASE WHEN f THEN 'missing_case_topic_fallback' WHEN r THEN 'refusal' WHEN l THEN 'research_leads' WHEN g = 'direct' AND NOT u THEN 'direct' ELSE 'retrieval_grounded' END AS mode FROM v""")
def answer_modes(spark, sf_dir):
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(MODES)], "id long, g string, f boolean, r boolean, u boolean, l boolean")
    turn = F.col("turn")
    rows = rows.unionByName(said(spark, sf_dir).select("id", F.when(F.col("role") == "assistant", "direct").otherwise("retrieval").alias("g"), (turn % 5 == 4).alias("f"), (turn % 3 == 2).alias("r"), (F.length("text") % 2 == 0).alias("u"), (F.col("conv_id") % 4 == 0).alias("l")))
    return rows.select("id", guards.answer_mode(generation=F.col("g"), fallback=F.col("f"), refused=F.col("r"), retrieval=F.col("u"), leads=F.col("l")).alias("mode"))


TOPICS = [("In Smith v. Jones, what did the court hold about adverse possession?", "smith v. jones"), ("what did the Supreme Court decide in this case on standing", ""), ("In  , easements.", None)]


@query(rf"""WITH v0(id, q, m) AS (VALUES {', '.join(f'({i}, {quoted(q)}, {_Q(m)})' for i, (q, m) in enumerate(TOPICS))}),
    v AS (SELECT * FROM v0 UNION ALL SELECT 1000 + conv_id * 100 + turn, 'In ' || text || ' what did the court hold about ' || text, CASE WHEN conv_id % 2 = 0 THEN substr(text, 3, 8) END FROM conversations),
    a AS (SELECT id, CASE WHEN coalesce(m, '') <> '' AND strpos(lower(q), lower(m)) > 0 THEN substr(q, 1, strpos(lower(q), lower(m)) - 1) || ' ' || substr(q, strpos(lower(q), lower(m)) + length(m)) ELSE q END AS t FROM v)
    SELECT CAST(id AS BIGINT) AS id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)^\s*In\s*,?\s*', ' ', 'g'), '(?i)\bwhat\s+did\s+(?:the\s+)?(?:supreme\s+)?court\s+(?:hold|decide|do)\b', ' ', 'g'),
        '(?i)\b(?:that|this|the)\s+case\b', ' ', 'g'), '(?i)\b(?:hold|holding|held)\b', ' ', 'g'), '\s+', ' ', 'g')), '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS topic FROM a""")
def topic_questions(spark, sf_dir):
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TOPICS)], "id long, q string, m string")
    asked = F.concat(F.lit("In "), "text", F.lit(" what did the court hold about "), "text")
    rows = rows.unionByName(said(spark, sf_dir).select("id", asked.alias("q"), F.when(F.col("conv_id") % 2 == 0, F.substring("text", 3, 8)).alias("m")))
    return rows.select("id", guards.topic_question(F.col("q"), F.col("m")).alias("topic"))


def _near(needle, low=False):
    """SQL: where ``needle`` stands in the whole text nearest to ``start``, or null; the earlier one of equals."""
    hay, needle = ("lower(text)", f"lower({needle})") if low else ("text", needle)
    found = f"list_filter(range(length(text)), lambda i: substr({hay}, i + 1, length({needle})) = {needle})"
    return f"list_sort(list_transform({found}, lambda i: {{'d': abs(i - start), 'i': i}}))[1].i"


_BARE = r"regexp_replace(claim, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH a AS (SELECT conv_id, replace(string_agg(text, ' ' ORDER BY turn), 'ß', 'ss') AS text FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, text, k, CASE k WHEN 0 THEN substr(text, 11, 20) WHEN 1 THEN upper(substr(text, 11, 20)) WHEN 2 THEN ' ' || substr(text, 5, 8) || '  ' ELSE 'nowhere at all' END AS claim, [10, 300, 0, 0][k + 1] AS start FROM a, range(4) r(k)),
    f AS (SELECT conv_id, k, claim, CASE WHEN substr(text, CAST(start AS BIGINT) + 1, length(claim)) = claim THEN start END AS own,
        CASE WHEN contains(text, claim) THEN {_near("claim")} END AS e1, CASE WHEN contains(text, {_BARE}) THEN {_near(_BARE)} END AS e2,
        CASE WHEN contains(lower(text), lower(claim)) THEN {_near("claim", True)} END AS e3 FROM p)
    SELECT conv_id, k, CAST(coalesce(own, e1, e2, e3) AS BIGINT) AS start_at,
        CAST(coalesce(own, e1, e2, e3) + CASE WHEN coalesce(own, e1) IS NULL AND e2 IS NOT NULL THEN length({_BARE}) ELSE length(claim) END AS BIGINT) AS end_at FROM f""")
def claim_locations(spark, sf_dir):
    a = answering._answers(spark, sf_dir).select("conv_id", F.replace("text", F.lit("ß"), F.lit("ss")).alias("text"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    k = F.col("k")
    part = F.substring("text", 11, 20)
    claim = F.when(k == 0, part).when(k == 1, F.upper(part)).when(k == 2, F.concat(F.lit(" "), F.substring("text", 5, 8), F.lit("  "))).otherwise("nowhere at all")
    rows = a.withColumns({"claim": claim, "start": F.when(k == 0, 10).when(k == 1, 300).otherwise(0)})
    return guards.located(rows, answer="text", claim="claim", start="start").select("conv_id", "k", "start_at", "end_at")


