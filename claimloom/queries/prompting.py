"""Queries on names, posture, prompts and marked-up answers."""

from pyspark.sql import functions as F

from .. import lexicon
from ..functions import names
from ..operators import answers, posture, prompts
from . import answering, guarding, query, table
from .evidence import quoted
from .verification import ts

NAMES = ["J. P. Smith Co. v. U.S.", "Acme Corp. v. Jones", "United States v. A B C Inc", "Brown v. Board Revisions: 2", "", "Co. v. Inc."]


@query()
def case_name_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("A. B. Party "), F.col("doc_id").cast("string"), F.lit(" Co. v. "), "source").alias("name"))
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string").unionByName(docs)
    return rows.select("name", names.case_key("name").alias("key"), names.family_key("name").alias("family"))


CASES = [
    "The petition for a writ of certiorari is denied. JUSTICE ALITO, dissenting from the denial of certiorari.",
    "The petition for certiorari is granted, the judgment is vacated, and the case is remanded.",
    "The judgment of the court of appeals is reversed. THOMAS, J., concurring in the judgment.",
    "PER CURIAM. The decision below is affirmed.",
    "Nothing about it.",
]
_ROLE = " ".join(f"WHEN {' OR '.join(f'regexp_matches(t, {quoted(p)})' for p in ps)} THEN '{n}'" for n, ps in posture.HEADERS)
_WHO = ", ".join(f"nullif(regexp_extract(t, {quoted(p)}, 1), '')" for _, ps in posture.HEADERS for p in ps)
_V = f"v(id, t) AS (VALUES {', '.join(f'({i}, {quoted(t)})' for i, t in enumerate(CASES))})"
_POSTURE = f"""{_V}, a AS (SELECT CAST(id AS BIGINT) AS id, t FROM v UNION ALL SELECT 100 + doc_id, substr(text, 1, 1600) FROM documents),
    p AS (SELECT id, t, CASE {' '.join(f"WHEN regexp_matches(t, {quoted(p)}) THEN '{k}'" for p, k, _ in posture.DISPOSITIONS)} END AS decision_type,
        CASE {' '.join(f"WHEN regexp_matches(t, {quoted(p)}) THEN '{x}'" for p, _, x in posture.DISPOSITIONS)} END AS court_action, coalesce({_WHO}) AS who FROM a),
    po AS (SELECT id, t, decision_type, court_action, CASE {_ROLE} WHEN regexp_matches(t, '(?i)\\bPER CURIAM\\b') THEN 'per_curiam' WHEN court_action IS NOT NULL THEN 'majority' END AS opinion_role,
        upper(who[1]) || lower(who[2:]) AS author, who IS NOT NULL AS is_separate FROM p)"""


def _postures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), F.lit(0).alias("ord"), "text")
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(CASES)], "id long, ord int, text string").unionByName(docs)
    return rows, posture.of_cases(rows, case="id", order="ord")


@query(f"WITH {_POSTURE} SELECT id, decision_type, court_action, opinion_role, author, is_separate FROM po WHERE decision_type IS NOT NULL OR opinion_role IS NOT NULL")
def case_posture(spark, sf_dir):
    return _postures(spark, sf_dir)[1]


@query(f"""WITH {_POSTURE}, s AS (SELECT *, CASE WHEN decision_type IS NULL AND opinion_role IS NULL THEN 'not_applied:no_case_posture' WHEN decision_type IS DISTINCT FROM 'cert_denial' THEN 'not_applied:not_cert_denial'
        WHEN opinion_role NOT IN ('dissent_from_denial', 'dissent', 'concurrence') THEN 'not_applied:no_named_separate_opinion' WHEN author IS NULL THEN 'not_applied:no_author' ELSE 'applied:cert_denial_posture' END AS status FROM po)
    SELECT id, status, CASE WHEN status LIKE 'applied%' THEN 'The Supreme Court denied certiorari in Case ' || id || '.' || chr(10) || chr(10) || 'Justice ' || author || CASE opinion_role WHEN 'dissent_from_denial' THEN ' dissented from the denial of certiorari.'
        WHEN 'dissent' THEN ' dissented.' ELSE ' concurred in the disposition.' END ELSE 'draft' END AS answer_after FROM s""")
def posture_override(spark, sf_dir):
    rows, found = _postures(spark, sf_dir)
    asked = rows.select("id", F.lit("draft").alias("answer"), F.concat(F.lit("Case "), F.col("id").cast("string")).alias("case_name"), F.lit("posture").alias("intent")).join(found, "id", "left")
    return posture.denial_answer(asked, answer="answer", case="case_name", intent="intent").select("id", "status", "answer_after")


SAYINGS = [("The Court denied certiorari.", "x", "Held so."), ("The Court denied certiorari.", "The petition for certiorari is denied.", ""), ("The Court affirmed.", "x", ""), ("Certiorari was denied.", None, " ")]
_S = f"v(id, a, e, r) AS (VALUES {', '.join(f'({i}, {quoted(a)}, {quoted(e) if e else 'NULL'}, {quoted(r)})' for i, (a, e, r) in enumerate(SAYINGS))})"


@query(f"""WITH {_S.replace("v(", "v0(", 1)}, {guarding.SAID},
    v AS (SELECT * FROM v0 UNION ALL SELECT id, text || CASE WHEN turn % 2 = 0 THEN ' The Court denied certiorari.' ELSE '' END, earlier || CASE WHEN conv_id % 3 = 0 THEN ' The petition for certiorari is denied.' ELSE '' END, CASE WHEN turn % 3 = 0 THEN '' ELSE 'Held so.' END FROM said),
    s AS (SELECT *, CASE WHEN NOT regexp_matches(a, {quoted(posture.CERT_DENIED_SAID)}) THEN 'not_applied:no_cert_denial_language'
        WHEN regexp_matches(coalesce(e, ''), {quoted(posture.CERT_DENIED)}) THEN 'not_applied:authorized_by_prompt_evidence' ELSE 'applied:blocked_unauthorized_cert_denial' END AS guard FROM v)
    SELECT CAST(id AS BIGINT) AS id, guard, CASE WHEN guard LIKE 'applied%' THEN coalesce(nullif(trim(r), ''), {quoted(posture.NO_SUPPORT)}) ELSE a END AS guarded_answer FROM s""")
def denial_guard(spark, sf_dir):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(SAYINGS)], "id long, a string, e string, r string")
    turn, denied = F.col("turn"), F.when(F.col("conv_id") % 3 == 0, " The petition for certiorari is denied.").otherwise("")
    more = guarding.said(spark, sf_dir).select("id", F.concat("text", F.when(turn % 2 == 0, " The Court denied certiorari.").otherwise("")).alias("a"), F.concat("earlier", denied).alias("e"), F.when(turn % 3 == 0, "").otherwise("Held so.").alias("r"))
    rows = rows.unionByName(more).withColumn("decision_type", F.lit(None).cast("string"))
    return posture.denial_guard(rows, answer="a", evidence="e", replacement="r").select("id", "guard", "guarded_answer")


UPLOADED = [("What is the notice period in my uploaded memo?", "The notice period is ten days."), ("What is the arbitration seat in my draft?", "The fee is due monthly."), ("Compare my draft with prior cases", "x"), ("What is standing?", "x"), ("What is my document?", ""), ("my file", "x y z")]
_U = f"v(id, q, e) AS (VALUES {', '.join(f'({i}, {quoted(q)}, {quoted(e)})' for i, (q, e) in enumerate(UPLOADED))})"


@query(f"""WITH {_U.replace("v(", "v0(", 1)}, {guarding.SAID},
    v AS (SELECT * FROM v0 UNION ALL SELECT id, text || CASE WHEN turn % 5 <> 4 THEN ' in my uploaded memo' ELSE '' END || CASE WHEN conv_id % 4 = 0 THEN ' and prior cases' ELSE '' END, coalesce(earlier, '') FROM said),
    t AS (SELECT *, {ts('q', lexicon.EVIDENCE_STOPWORDS + posture.UPLOAD_GENERIC, 2)} AS core, {ts('e', lexicon.EVIDENCE_STOPWORDS, 2)} AS found FROM v)
    SELECT CAST(id AS BIGINT) AS id, CASE WHEN NOT regexp_matches(q, {quoted(posture.UPLOAD)}) THEN 'not_applied:not_upload_query' WHEN regexp_matches(q, {quoted(posture.COMPARING)}) THEN 'not_applied:comparison_query'
        WHEN trim(e) = '' THEN 'not_applied:no_upload_evidence_sentences' WHEN len(core) = 0 THEN 'not_applied:no_core_query_terms' WHEN list_has_any(core, found) THEN 'not_applied:upload_evidence_matches_query_terms'
        ELSE 'applied:user_upload_absence' END AS absence FROM t""")
def upload_absence(spark, sf_dir):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(UPLOADED)], "id long, q string, e string")
    asked = F.concat("text", F.when(F.col("turn") % 5 != 4, " in my uploaded memo").otherwise(""), F.when(F.col("conv_id") % 4 == 0, " and prior cases").otherwise(""))
    rows = rows.unionByName(guarding.said(spark, sf_dir).select("id", asked.alias("q"), F.coalesce("earlier", F.lit("")).alias("e")))
    return posture.upload_absence(rows, question="q", evidence="e").select("id", "absence")


@query(r"""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS l FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> '')
    SELECT conv_id, sha1(string_agg(l, chr(10) ORDER BY turn)) AS digest FROM l GROUP BY conv_id""")
def conversation_history(spark, sf_dir):
    return prompts.history(table(spark, sf_dir, "conversations"), by="conv_id", order="turn").select("conv_id", F.sha1("history").alias("digest"))


@query(r"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
    SELECT conv_id, sha1(string_agg('Context item ' || n || ':' || chr(10) || 'Evidence type: allowed answer fact' || chr(10) || 'Allowed answer fact: ' || t, chr(10) || chr(10) ORDER BY n)) AS digest FROM c GROUP BY conv_id""")
def prompt_context(spark, sf_dir):
    return prompts.context(table(spark, sf_dir, "conversations"), by="conv_id", order="turn").select("conv_id", F.sha1("context").alias("digest"))


@query()
def annotated_html(spark, sf_dir):
    whole = answering._answers(spark, sf_dir)
    blocks = answers.blocks(whole, answering._spans(spark, sf_dir), by="conv_id")
    return prompts.annotated(whole, blocks, by="conv_id").select("conv_id", F.length("html").cast("long").alias("n_chars"), F.sha1("html").alias("digest"))


REPORTERS = ["U. S.", "S. Ct.", "F. 3d", "F.Supp.2d", "Cal.  App."]


@query(f"""WITH r(i, r) AS (VALUES {', '.join(f'({i}, {quoted(r)})' for i, r in enumerate(REPORTERS))}),
    v AS (SELECT c_custkey, r || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '   ' || c_mktsegment END AS x FROM customer JOIN r ON i = c_custkey % {len(REPORTERS)})
    SELECT c_custkey, x, CASE upper(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) WHEN 'US' THEN 'U.S.' WHEN 'SCT' THEN 'S. Ct.' WHEN 'F3D' THEN 'F.3d' WHEN 'F2D' THEN 'F.2d'
    WHEN 'FSUPP' THEN 'F. Supp.' WHEN 'FSUPP2D' THEN 'F. Supp. 2d' WHEN 'FSUPP3D' THEN 'F. Supp. 3d' ELSE trim(regexp_replace(x, '\\s+', ' ', 'g')) END AS reporter FROM v""")
def reporter_names(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(r) for r in REPORTERS]), (F.col("c_custkey") % len(REPORTERS) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(said, F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("   "), "c_mktsegment"))).alias("x"))
    return rows.select("c_custkey", "x", names.reporter("x").alias("reporter"))


