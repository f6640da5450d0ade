"""Queries on citation verification, prompt blocks, replaced answers, uploads and evaluation."""

from pyspark.sql import functions as F

from .. import config, lexicon
from ..operators import answers, citations, drafting, grounding, metrics, posture, verification
from ..sources import index, uploads
from ..storage import written
from . import evidence, query, searching, table
from .evidence import quoted
from .verification import PAIRS, scored_pairs, ts

SEGMENT = "lower(c_mktsegment)"
CLAIM_SQL = f"""CASE c_custkey % 5 WHEN 0 THEN 'In Smith v. Jones, ' || (100 + c_nationkey) || ' U.S. ' || (c_custkey % 40 + 1) || ' (1990), the court held that ' || {SEGMENT} || ' orders are final.'
    WHEN 1 THEN 'Under 42 U.S.C. § ' || (1980 + c_nationkey) || ' a claim on ' || {SEGMENT} || ' may be heard; see also 28 U.S.C. 1331.'
    WHEN 2 THEN c_name || ' paid for ' || {SEGMENT} || '.' WHEN 3 THEN (c_nationkey + 1) || ' F. 3d ' || (c_custkey % 30 + 1)
    ELSE 'Compare Acme Corp. v. Doe, ' || (c_nationkey + 1) || ' S.Ct. ' || (c_custkey % 30 + 1) || ' with 42 U.S.C. § 1983' END"""
SOURCE_SQL = f"""(100 + c_nationkey) || ' U.S. ' || (c_custkey % 40 + 1) AS citation, CASE c_custkey % 3 WHEN 0 THEN 'The court held that ' || {SEGMENT} || ' orders are final.'
    WHEN 1 THEN 'A claim on ' || {SEGMENT} || ' may be heard under 42 U.S.C. § ' || (1980 + c_nationkey) || '.' ELSE 'Nothing on it, but see ' || (c_nationkey + 1) || ' F.3d ' || (c_custkey % 30 + 1) || '.' END AS text"""
_CASE, _CODE, _NAME = (quoted(p) for p in (citations.CASE_CITATION, citations.CODE_CITATION, citations.CITED_CASE))
_REPORTERS = "CASE upper(regexp_replace(r, '[^A-Za-z0-9]', '', 'g')) WHEN 'US' THEN 'U.S.' WHEN 'SCT' THEN 'S. Ct.' WHEN 'F3D' THEN 'F.3d' WHEN 'F2D' THEN 'F.2d' ELSE r END"
_FOUND = f"""t AS (SELECT c_custkey AS id, {CLAIM_SQL} AS text FROM customer),
    m AS (SELECT id, text, 'case' AS type, unnest(regexp_extract_all(text, {_CASE})) AS raw FROM t UNION ALL SELECT id, text, 'statute', unnest(regexp_extract_all(text, {_CODE})) FROM t),
    p AS (SELECT *, instr(text, raw) - 1 AS start_at, regexp_extract(raw, {_CASE}, 2) AS r FROM m),
    f AS (SELECT id, text, type, start_at, CASE WHEN type = 'case' THEN regexp_extract(raw, {_CASE}, 1) || ' ' || {_REPORTERS} || ' ' || regexp_extract(raw, {_CASE}, 3)
            ELSE regexp_extract(raw, {_CODE}, 1) || ' U.S.C. § ' || regexp_extract(raw, {_CODE}, 2) END AS raw_text,
        CASE WHEN type = 'case' THEN regexp_extract_all(substr(text, greatest(1, start_at - 119), least(start_at, 120)), {_NAME})[-1] END AS case_name FROM p),
    k AS (SELECT *, upper(regexp_replace(raw_text, '[^A-Za-z0-9]', '', 'g')) AS normalized_text, row_number() OVER (PARTITION BY id ORDER BY start_at) AS ord FROM f)"""


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim_id"), F.expr(CLAIM_SQL).alias("text"))


@query(f"WITH {_FOUND} SELECT id, ord, start_at, type, raw_text, normalized_text, case_name FROM k")
def citation_parse(spark, sf_dir):
    found = _claims(spark, sf_dir).select(F.col("claim_id").alias("id"), F.posexplode(citations.extracted("text")).alias("n", "c"))
    return found.select("id", (F.col("n") + 1).cast("long").alias("ord"), F.col("c.at").alias("start_at"), "c.type", "c.raw_text", "c.normalized_text", "c.case_name")


_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(rf"""WITH {_FOUND},
    g AS (SELECT id, list(struct_pack(c := case_name, r := raw_text) ORDER BY ord) AS cs, count(*) AS n_citations, arg_min(raw_text, ord) AS raw_text, arg_min(normalized_text, ord) AS citation_key FROM k GROUP BY id),
    b AS (SELECT t.id AS claim_id, coalesce(n_citations, 0) AS n_citations, g.raw_text, citation_key,
        replace(replace(replace(replace(t.text, coalesce(cs[1].c, '~'), ' '), coalesce(cs[1].r, '~'), ' '), coalesce(cs[2].c, '~'), ' '), coalesce(cs[2].r, '~'), ' ') AS x FROM t LEFT JOIN g USING (id)),
    q AS (SELECT *, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '\(\d{{4}}\)', ' ', 'g'), '(?i)\b(?:see|under|cf\.?|accord|citing)\b', ' ', 'g'), ',', ' '), '\s+', ' ', 'g'), '^[ .;:\-,]+|[ .;:\-,]+$', '', 'g') AS proposition FROM b),
    s AS (SELECT c_custkey AS chunk_id, {SOURCE_SQL} FROM customer),
    j AS (SELECT q.claim_id, chunk_id, q.proposition, s.text, CASE WHEN proposition = '' THEN 1.0 ELSE round(len(list_intersect({_TOKENS.format('proposition')}, {_TOKENS.format('text')})) / sqrt(greatest(len({_TOKENS.format('proposition')}) * len({_TOKENS.format('text')}), 1)), 6) END AS score
        FROM q JOIN s ON upper(regexp_replace(citation, '[^A-Za-z0-9]', '', 'g')) = citation_key OR contains(upper(regexp_replace(s.text, '[^A-Za-z0-9]', '', 'g')), citation_key)),
    w AS (SELECT *, count(*) OVER (PARTITION BY claim_id) AS n_candidates, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, chunk_id) AS r FROM j)
    SELECT q.claim_id, q.n_citations, q.raw_text, q.proposition, w.chunk_id, coalesce(w.n_candidates, 0) AS n_candidates, round(coalesce(w.score, 0), 3) AS confidence,
        CASE WHEN w.chunk_id IS NULL THEN 'CITATION_ERROR' WHEN q.proposition = '' THEN 'VERIFIED' WHEN w.score >= 0.75 THEN 'VERIFIED' WHEN w.score >= 0.55 THEN 'WEAK' ELSE 'UNSUPPORTED' END AS verdict
    FROM q LEFT JOIN w ON w.claim_id = q.claim_id AND w.r = 1""")
def citation_verify(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").selectExpr("c_custkey AS chunk_id", "c_custkey AS doc_id", *[x.strip() for x in (SOURCE_SQL[: SOURCE_SQL.index(", CASE")], SOURCE_SQL[SOURCE_SQL.index("CASE") :])])
    return citations.verify(_claims(spark, sf_dir), sources).select("claim_id", "n_citations", "raw_text", "proposition", "chunk_id", "n_candidates", "confidence", "verdict")


_TYPE = "CASE WHEN doc_id % 3 = 0 THEN 'user_upload' ELSE 'case' END"
_BLOCK = f"'Chunk ID: ' || doc_id || ':0; Document ID: ' || doc_id || '; Document type: ' || {_TYPE} || CASE WHEN coalesce(lang, '') <> '' THEN '; Court: ' || lang ELSE '' END || '; Source file: ' || source || chr(10) || coalesce(text, '')"


@query(f"""SELECT doc_id, sha1({_BLOCK}) AS chunk, sha1(CASE WHEN doc_id % 3 = 0 THEN {quoted(drafting.UPLOAD_RULES)} ELSE {quoted(drafting.AUTHORITY_RULES)} END || {_BLOCK}) AS upload FROM documents""")
def chunk_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.expr(_TYPE).alias("doc_type"), F.col("lang").alias("court"), F.col("source").alias("source_file"), "text")
    return docs.select("doc_id", F.sha1(drafting.chunk_block(docs.columns)).alias("chunk"), F.sha1(drafting.upload_block(docs.columns)).alias("upload"))


@query(rf"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q, CASE WHEN turn % 2 = 0 THEN 'Context item 1:' || chr(10) || role END AS ctx, CASE WHEN turn % 3 = 1 THEN 'User: ' || role END AS past FROM conversations)
    SELECT conv_id, turn, sha1({quoted(drafting.TEMPLATES['system'])} || chr(10) || chr(10) || CASE WHEN past IS NOT NULL THEN 'Recent conversation history:' || chr(10) || past || chr(10) || chr(10) ELSE '' END || 'Question: ' || q || chr(10) || chr(10)
        || 'Retrieved context:' || chr(10) || coalesce(ctx, '{drafting.NO_CONTEXT}') || chr(10) || chr(10) || CASE WHEN regexp_matches(q, {quoted(lexicon.NAMED_CASE)}) THEN {quoted(drafting.TEMPLATES['precision'])} ELSE '' END
        || CASE WHEN turn % 4 = 0 THEN {quoted(drafting.TEMPLATES['detailed'])} ELSE {quoted(drafting.TEMPLATES['concise'])} END) AS rag,
        sha1({quoted(drafting.TEMPLATES['general_system'])} || chr(10) || chr(10) || 'Question: ' || q) AS direct FROM c""")
def prompts_of_turns(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").withColumns({
        "context": F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Context item 1:\n"), "role")), "past": F.when(F.col("turn") % 3 == 1, F.concat(F.lit("User: "), "role")), "depth": F.when(F.col("turn") % 4 == 0, "detailed").otherwise("concise"),
    })
    return talk.select("conv_id", "turn", F.sha1(drafting.prompt("text", context="context", history="past", depth="depth")).alias("rag"), F.sha1(drafting.prompt("text")).alias("direct"))


_ASKED_CASE = "CASE WHEN turn % 3 = 0 THEN 'Party ' || conv_id || ' v. ' || role END"
_T = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH c AS (SELECT conv_id, turn, {_T} AS t, trim(regexp_replace(text, '\s+', ' ', 'g')) AS said, coalesce({_ASKED_CASE}, 'the named case') AS named FROM conversations)
    SELECT conv_id, turn, sha1('Evidence type: scope constraint' || chr(10) || 'Missing target case: ' || named || chr(10) || 'Related topic query: ' || CASE WHEN t = '' THEN 'the related legal issue' ELSE t END || chr(10) || {quoted(drafting.MISSING_CASE_RULE)}) AS scope,
        sha1('Evidence type: research-leads scope constraint' || chr(10) || 'Research query: ' || CASE WHEN t = '' THEN 'the user''s research query' ELSE t END || chr(10) || {quoted(drafting.LEADS_RULE)}) AS leads,
        sha1(CASE WHEN said = '' THEN n WHEN starts_with(lower(said), 'i do not have') THEN said ELSE n || chr(10) || chr(10) || 'Based on related retrieved authorities, ' || lower(said[1]) || said[2:] END) AS answer
    FROM (SELECT *, 'I do not have ' || named || ' in the retrieved database, so I cannot say what that case held.' AS n FROM c)""")
def missing_case_texts(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").withColumn("asked", F.expr(_ASKED_CASE))
    return talk.select("conv_id", "turn", F.sha1(drafting.missing_case_block("asked", "text")).alias("scope"), F.sha1(drafting.leads_block("text")).alias("leads"), F.sha1(drafting.missing_case_answer("text", "asked")).alias("answer"))


_SENTENCE = """CASE o_orderkey % 6 WHEN 0 THEN 'Held: the petition of customer ' || o_custkey || ' was refused by this court.' WHEN 1 THEN 'We hold that order ' || o_orderkey || ' must stand as it was made.'
    WHEN 2 THEN 'because order ' || o_orderkey || ' was late' WHEN 3 THEN 'The parties met on a day in May and nothing came of it.' WHEN 4 THEN 'The judgment in matter ' || o_custkey || ' is reversed and remanded.' ELSE 'It was argued by counsel in case No' END"""
_H = {k: quoted(getattr(lexicon, k)) for k in ("INCOMPLETE", "FRAGMENT_START", "TRUNCATED_END", "HOLDING_LEAD", "HOLDING_CONCLUSION")}
_INCOMPLETE = lambda x: f"""(regexp_matches({x}, {_H['INCOMPLETE']}) OR regexp_matches({x}, {_H['FRAGMENT_START']}) OR regexp_matches(regexp_replace({x}, '[.,;:!?"'']+$', ''), {_H['TRUNCATED_END']}))"""
_HOLDINGS = f"""s AS (SELECT o_custkey, o_orderkey, {_SENTENCE} AS s FROM orders), l AS (SELECT *, trim(substr(s, instr(lower(s), 'held:') + 5)) AS tail FROM s),
    h AS (SELECT o_custkey, o_orderkey, CASE WHEN {_INCOMPLETE('s')} THEN NULL WHEN instr(lower(s), 'held:') > 0 THEN CASE WHEN tail <> '' AND NOT {_INCOMPLETE('tail')} THEN tail END
        WHEN regexp_matches(s, {_H['HOLDING_LEAD']}) OR regexp_matches(s, {_H['HOLDING_CONCLUSION']}) THEN s END AS holding FROM l),
    b AS (SELECT o_custkey, arg_min(holding, o_orderkey) FILTER (holding IS NOT NULL) AS holding FROM h GROUP BY o_custkey)"""


def _best_holdings(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(_SENTENCE).alias("sentence"))
    return drafting.best_holding(rows, by="o_custkey", order="o_orderkey")


@query(f"WITH {_HOLDINGS} SELECT o_custkey, holding FROM b WHERE holding IS NOT NULL")
def explicit_holdings(spark, sf_dir):
    return _best_holdings(spark, sf_dir)


@query(f"""WITH {_HOLDINGS}, c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS target, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || ' stands.' ELSE ' ' END AS known, holding FROM customer LEFT JOIN b ON o_custkey = c_custkey),
    x AS (SELECT *, CASE WHEN target IS NULL THEN 'not_applied:no_target_case' WHEN trim(known) = '' AND holding IS NULL THEN 'not_applied:no_explicit_holding' WHEN trim(known) <> '' THEN 'applied:canonical_answer_fact' ELSE 'applied:explicit_holding_sentence' END AS status FROM c)
    SELECT c_custkey, status, CASE WHEN status LIKE 'applied%' THEN coalesce(nullif(trim(known), ''), holding) ELSE 'draft' END AS answer_after FROM x""")
def holding_override(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("draft").alias("draft"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("target"),
        F.when(F.col("c_custkey") % 7 == 0, F.concat("c_mktsegment", F.lit(" stands."))).otherwise(" ").alias("known"),
    ).join(_best_holdings(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    return drafting.holding_answer(rows, answer="draft", target="target", canonical="known", holding="holding").select("c_custkey", "status", "answer_after")


_ASK = """CASE p_partkey % 6 WHEN 0 THEN 'What is the ' || p_name || '?' WHEN 1 THEN 'In my file, what are ' || p_name || '?!' WHEN 2 THEN 'What does my memo say about ' || p_name WHEN 3 THEN 'what is in my uploaded draft, ' || p_type
    WHEN 4 THEN 'Find ' || p_name ELSE 'What is a ' || p_name || '.' END"""


@query(rf"""WITH a AS (SELECT p_partkey, regexp_replace(trim(regexp_replace({_ASK}, '\s+', ' ', 'g')), '[?.!]+$', '') AS q FROM part),
    s AS (SELECT p_partkey, coalesce({', '.join(f"nullif(trim(regexp_replace(trim(regexp_extract(q, {quoted(p)}, 1)), {quoted(drafting.SUBJECT_SCOPE)}, '')), '')" for p in drafting.SUBJECT_LEADS)}) AS f FROM a)
    SELECT p_partkey, CASE WHEN f IS NULL THEN 'the requested fact' WHEN regexp_matches(f, '(?i)^(?:a|an|the)\b') THEN f WHEN regexp_matches(f, '(?i)^[aeiou]') THEN 'an ' || f ELSE 'a ' || f END AS subject FROM s""")
def upload_subjects(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", drafting.absence_subject(F.expr(_ASK)).alias("subject"))


@query()
def fallback_answers(spark, sf_dir):
    """Parts of a brand as evidence sentences, every third brand in detail."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat("p_name", F.lit(" is a part of type "), F.lower("p_type")).alias("s"))
    rows = parts.groupBy("p_brand").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("p_partkey", "s"))), 1, 40), lambda x: x["s"]).alias("sentences"), F.min("s").alias("best"))
    return rows.select("p_brand", drafting.fallback_answer(["best"], "sentences", F.col("p_brand").rlike("[0369]$")).alias("answer"))


_TURNED = "coalesce(" + ", ".join(f"CASE WHEN instr(lower(p), '{a}') > 0 THEN substr(p, 1, instr(lower(p), '{a}') - 1) || '{b}' || substr(p, instr(lower(p), '{a}') + {len(a)}) END" for a, b in metrics.TURNS) + ")"
_SAID = "CASE o_orderkey % 5 WHEN 0 THEN 'The order was late' WHEN 1 THEN 'Customers do not pay for it.' WHEN 2 THEN 'Order ' || o_orderkey || ' is open!' WHEN 3 THEN 'Payment came on ' || o_orderpriority || '.' ELSE 'It has  been paid' END"


@query(rf"""WITH s AS (SELECT o_orderkey AS id, {_SAID} AS s FROM orders UNION ALL SELECT -1 - conv_id * 100 - turn, text FROM conversations),
    p AS (SELECT id, s, ' ' || regexp_replace(s, '^\s+|\s+$', '', 'g') || ' ' AS p FROM s), t AS (SELECT id, s, trim(regexp_replace({_TURNED}, '\s+', ' ', 'g')) AS t FROM p)
    SELECT id, sha1(CASE WHEN t IS NULL THEN 'It is not true that ' || lower(regexp_replace(s, '\.$', '')) || '.' WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END) AS inverted FROM t""")
def polarity_inverted(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_SAID).alias("s")).unionByName(table(spark, sf_dir, "conversations").select((-1 - F.col("conv_id") * 100 - F.col("turn")).alias("id"), F.col("text").alias("s")))
    return rows.select("id", F.sha1(metrics.inverted("s")).alias("inverted"))


@query()
def extractive_answers(spark, sf_dir):
    """The benchmark's items as questions, answered from their best chunks."""
    found = searching.bm25(spark, sf_dir, k=config.MERGED_LIMIT)
    hits = found.join(searching.hit_chunks(spark, sf_dir, found).select("chunk_id", "text"), "chunk_id").join(evidence._question_tokens(spark, sf_dir), "query_id")
    return metrics.extractive_answers(hits, query="query_id").select("query_id", "answer")


_RAW = "source || CASE doc_id % 3 WHEN 0 THEN '_cases.jsonl' WHEN 1 THEN '.jsonl' ELSE '.txt' END"


@query(f"""SELECT DISTINCT raw, CASE WHEN ends_with(raw, '_cases.jsonl') THEN replace(raw, '_cases.jsonl', '_chunks.jsonl') WHEN ends_with(raw, '.jsonl') THEN substr(raw, 1, length(raw) - 6) || '_chunks.jsonl' ELSE raw || '_chunks.jsonl' END AS name
    FROM (SELECT {_RAW} AS raw FROM documents)""")
def output_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.expr(_RAW).alias("raw")).distinct().withColumn("name", index.output_name("raw"))


_FILE = "CASE page_id % 6 WHEN 0 THEN 'brief ' || page_id || '.TXT' WHEN 1 THEN 'b.' || page_id || '.pdf' WHEN 2 THEN 'run.exe' WHEN 3 THEN '' WHEN 4 THEN 'none' ELSE 'notes.md' END"
_BYTES = "CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 13 = 0 THEN 30000000 ELSE length(html) END"
_ALLOWED = ", ".join(uploads.SUFFIXES)


@query(f"""WITH f AS (SELECT page_id, {_FILE} AS n, {_BYTES} AS b FROM pages), x AS (SELECT *, lower(regexp_extract(n, '[^/\\\\.](\\.[^./\\\\]+)$', 1)) AS s FROM f)
    SELECT page_id, CASE WHEN n = '' THEN 'Uploaded files must have a filename.' WHEN s NOT IN ('.docx', '.md', '.pdf', '.txt') THEN 'Unsupported file type ''' || CASE WHEN s = '' THEN '<none>' ELSE s END || '''. Allowed: {_ALLOWED}.'
        WHEN b = 0 THEN 'Uploaded file ''' || n || ''' is empty.' WHEN b > {uploads.MAX_BYTES} THEN 'Uploaded file ''' || n || ''' exceeds the {uploads.MAX_BYTES} byte limit.' END AS reason FROM x""")
def upload_rejections(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", uploads.rejection(F.expr(_FILE), F.expr(_BYTES)).alias("reason"))


@query("""WITH e AS (SELECT event_id, event_type AS p, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error:Timeout' ELSE 'unavailable:no_user_upload_index' END AS u, event_id % 6 = 0 AS h FROM events)
    SELECT event_id, CASE WHEN h OR starts_with(u, 'error:') THEN 'public:' || p || ';user:' || u ELSE p END AS status FROM e""")
def combined_statuses(spark, sf_dir):
    own = F.when(F.col("event_id") % 3 == 0, "ok").when(F.col("event_id") % 3 == 1, "error:Timeout").otherwise(uploads.NO_INDEX)
    return table(spark, sf_dir, "events").select("event_id", drafting.retrieval_status(F.col("event_type"), own, F.col("event_id") % 6 == 0).alias("status"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def router_answers(spark, sf_dir):
    """A struct from a router's answer: plain, in other text, or not there."""
    said = F.when(F.col("event_id") % 4 == 3, F.lit("no {json here")).when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("Sure. "), "props", F.lit(" is it")))
    return table(spark, sf_dir, "events").withColumn("said", said).select("event_id", grounding.route("said", "k long")["k"].alias("k"))


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rank, o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS source_label,
        CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 5 = 0 ELSE o_orderstatus = 'F' END AS used_in_prompt FROM orders""")
def citation_list(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("citation"), F.lit("").alias("source_file"),
        F.col("o_totalprice").alias("score"), F.when(F.col("o_custkey") % 2 == 0, F.when(F.col("o_orderkey") % 5 == 0, F.array(F.col("o_orderkey").cast("string"))).otherwise(F.array(F.lit("-")))).alias("ids"), (F.col("o_orderstatus") == "F").alias("used"),
    )
    return drafting.citation_rows(rows, by="o_custkey", order="o_orderdate", prompt_ids="ids", used=F.col("used")).select("o_custkey", "rank", "chunk_id", "source_label", "used_in_prompt")


@query("""SELECT o_custkey, o_orderstatus AS level, CAST(o_orderkey % 4 AS VARCHAR) AS doc_id, lower(trim(o_orderpriority)) AS source_label, max(o_totalprice) AS score, count(DISTINCT o_orderkey) AS n_claims FROM orders GROUP BY ALL""")
def evidence_cases(spark, sf_dir):
    """Orders as claims, their status as support level, their priority as source."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("level"), (F.col("o_orderkey") % 4).cast("string").alias("doc_id"), F.lit("").alias("chunk_id"), F.col("o_orderpriority").alias("source_label"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("claim_id"))
    found = answers.cases_by_level(rows, by=["o_custkey", "level"])
    return found.select("o_custkey", "level", "doc_id", "source_label", "score", F.size("claim_ids").cast("long").alias("n_claims"))


@query("""WITH c AS (SELECT lang, l.quality = 1 AS a, d.n_chars > 1000 AS p FROM documents d JOIN labels l USING (doc_id) WHERE lang IS NOT NULL)
    SELECT lang, count(*) FILTER (NOT a AND p) AS fp, round(CASE WHEN count(*) FILTER (NOT a) = 0 THEN 0 ELSE count(*) FILTER (NOT a AND p) / count(*) FILTER (NOT a) END, 6) AS fpr FROM c GROUP BY lang""")
def false_positive_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang is not null").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("actual"), (F.col("n_chars") > 1000).alias("predicted"))
    return metrics.false_positive_rate(metrics.confusion(rows, by="lang")).select("lang", "fp", "fpr")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(*) FILTER (o_orderkey % 9 = 0) AS canonical_hits,
        min(o_totalprice) AS score_min, round(avg(o_totalprice), 6) AS score_avg, max(o_totalprice) AS score_max FROM orders""")
def run_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("passed"), (F.col("o_orderkey") % 9 == 0).alias("canonical"))
    return metrics.run_summary(rows)


def _named_hits(spark, sf_dir):
    hits = evidence._named_hits(spark, sf_dir, "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("family"))
    name = F.concat(F.lit("Party "), F.col("doc_id").cast("string"), F.lit(" v. "), "family")
    hits = hits.join(docs, "doc_id").select("query_id", "doc_id", "rank", name.alias("case_name"), F.concat((F.col("doc_id") % 500).cast("string"), F.lit(" U.S. "), (F.col("rank")).cast("string")).alias("citation"), F.when(F.col("doc_id") % 97 == 0, "user_upload").otherwise("case").alias("doc_type"), "name_tokens", "query_tokens", "family")
    return written(hits, "named-cases")  # the ways of a resolution each read them


@query()
def query_grounding(spark, sf_dir):
    """What each item of the benchmark is about; some name a case or a citation, some have a router's answer."""
    i, t = F.col("item_id"), F.col("text")
    asked = F.when(i % 5 == 0, F.concat(F.lit("What did Party "), i.cast("string"), F.lit(" v. Doe hold? "), t)).when(i % 5 == 1, F.concat(F.lit("Explain "), (i % 500).cast("string"), F.lit(" U.S. 3. "), t)).otherwise(t)
    questions = table(spark, sf_dir, "benchmark").select(i.alias("query_id"), asked.alias("question"), F.lit(False).alias("mentions_upload"), F.when(i % 5 == 2, "research_leads").alias("route"), F.when(i % 5 == 2, 0.8).alias("confidence"))
    found = grounding.resolve(questions, _named_hits(spark, sf_dir))
    return found.withColumn("target_doc_ids", F.array_join("target_doc_ids", ","))


@query()
def public_questions(spark, sf_dir):
    """Turns taken as questions that compare an uploaded memo; the next turn of the conversation is the upload."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.array("text").alias("uploads"))
    asked = talk.join(nxt, ["conv_id", "turn"], "left").withColumn("q", F.concat(F.lit("Compare my uploaded memo with case law on expert methodology. "), "text"))
    found = drafting.public_question("q", "uploads", mentions=F.col("q").rlike(posture.UPLOAD), compares=F.col("q").rlike(posture.COMPARING), sources=F.array(F.lit("upload_memo_1.txt")))
    return asked.select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", "f.status", "f.public_query")


_PATS = [quoted(p) for p in (lexicon.CASE_NAME, lexicon.US_CITATION, lexicon.CONSTITUTIONAL)]
_SPEC = lambda x: f"list_filter({ts(x, lexicon.EVIDENCE_STOPWORDS + lexicon.LEADS_GENERIC, 2)}, lambda t: NOT regexp_full_match(t, '[0-9]+'))"
_COMPACT = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH {PAIRS}, v AS (SELECT claim_id, chunk_id, CASE WHEN e >= 0.4 THEN 'SUPPORTED' WHEN idx % 2 = 0 THEN 'POSSIBLE_SUPPORT' ELSE 'UNSUPPORTED' END AS label, 'In Party ' || (claim_id % 9) || ' v. Doe: ' || hypothesis AS claim, CASE WHEN idx % 3 = 0 THEN 'Party ' || (claim_id % 9) || ' v. Doe ' ELSE '' END || premise AS evidence FROM p4),
    n AS (SELECT *, list_filter({' || '.join(f'regexp_extract_all(claim, {p})' for p in _PATS)}, lambda x: NOT contains({_COMPACT('evidence')}, {_COMPACT('x')})) AS missing, len(list_intersect({_SPEC('claim')}, {_SPEC('evidence')})) AS shared FROM v)
    SELECT claim_id, chunk_id, CASE WHEN label = 'UNSUPPORTED' THEN 'not_applied:verdict_not_supported' WHEN len(missing) > 0 THEN 'blocked:missing_named_evidence' WHEN label <> 'POSSIBLE_SUPPORT' AND shared < 2 THEN 'demote:research_leads_weak_source_alignment' ELSE 'passed:research_leads_source_alignment' END AS guard_status FROM n""")
def consistency_guards_all(spark, sf_dir):
    """The consistency guards over every claim of the benchmark and its evidence."""
    rows = scored_pairs(spark, sf_dir)
    party = F.concat(F.lit("Party "), (F.col("claim_id") % 9).cast("string"), F.lit(" v. Doe"))
    made = rows.select(
        "claim_id", "chunk_id", F.when(F.col("e") >= 0.4, "SUPPORTED").when(F.col("idx") % 2 == 0, "POSSIBLE_SUPPORT").otherwise("UNSUPPORTED").alias("label"), F.concat(F.lit("In "), party, F.lit(": "), "hypothesis").alias("claim"),
        F.concat(F.when(F.col("idx") % 3 == 0, F.concat(party, F.lit(" "))).otherwise(""), "premise").alias("evidence"),
    )
    return verification.guarded(made, claim="claim", evidence="evidence", label="label").select("claim_id", "chunk_id", "guard_status")


_CONFLICTS = " OR ".join(f"(list_has_any(pc, {[*y]}) AND list_has_any(hc, {[*n]})) OR (list_has_any(pc, {[*n]}) AND list_has_any(hc, {[*y]}))" for y, n in lexicon.POLARITY)


@query(f"WITH {PAIRS} SELECT claim_id, chunk_id, list_has_any(pc, hc) AND ({_CONFLICTS}) AS conflict, (list_has_any(pc, hc) AND ({_CONFLICTS})) OR ov AS valid FROM p4")
def contradiction_overlap_all(spark, sf_dir):
    """Conflicts of meaning over every claim of the benchmark and its evidence, which hold no legal anchors."""
    rows = scored_pairs(spark, sf_dir)
    return rows.select("claim_id", "chunk_id", verification.polarity_conflict(verification.content("premise"), verification.content("hypothesis")).alias("conflict"), F.col("overlap_valid").alias("valid"))


