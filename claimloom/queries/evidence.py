"""Queries on grounding, expansion, evidence selection and claims."""

from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as tx
from ..operators import claims, evidence, expansion, grounding
from ..storage import written
from . import ORACLES, query, searching, table
from .verification import ts

ASKED = [
    "Find cases about standing for environmental plaintiffs",
    "What did Miranda v. Arizona say about suppression?",
    "   ",
    "Who wrote the opinion in Smith v. Jones?",
    "Explain why the agency's search needed a warrant",
    "Which authority addresses summary judgment and damages in 410 U.S. 113?",
    "identify authorities about penalties and sanctions for speech",
    "what happened below",
    "hello there",
    "List it",
]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def constants(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "id long, query string")


V = f"v(id, query) AS (VALUES {', '.join(f'({i}, {quoted(q)})' for i, q in enumerate(ASKED))})"
_L = {k: getattr(lexicon, k).replace("'", "''") for k in ("NAMED_CASE", "REPORTER", "AUTHORITY_SEEKING", "CASE_NAME", "US_CITATION", "FOLLOW_UP", "AUTHOR_QUESTION", "HOLDING_QUESTION", "POSTURE_QUESTION", "LEADS_QUESTION", "ISSUE_QUESTION", "DEPTH_QUESTION")}
_RULES = " || ".join(
    [f"[{', '.join(map(quoted, lexicon.AUTHORITY_TERMS))}]"]
    + [f"CASE WHEN {' OR '.join(f'contains(lower(q), {quoted(t)})' for t in a)} THEN [{', '.join(map(quoted, b))}] ELSE [] END" for a, b in lexicon.EXPANSIONS]
)


@query(rf"""WITH {V}, a AS (SELECT id, query FROM v UNION ALL SELECT 1000 + conv_id * 100 + turn, CASE WHEN turn % 3 = 0 THEN 'Find authority on damages and ' || text ELSE text END FROM conversations),
        n AS (SELECT id, trim(regexp_replace(query, '\s+', ' ', 'g')) AS q FROM a),
        s AS (SELECT *, CASE WHEN q = '' THEN 'not_applied:blank_query' WHEN regexp_matches(q, '{_L["NAMED_CASE"]}') OR regexp_matches(q, '{_L["REPORTER"]}') THEN 'not_applied:named_authority_query'
            WHEN len(regexp_extract_all(lower(q), '[a-z0-9][a-z0-9''-]*')) < 3 OR NOT regexp_matches(lower(q), '{_L["AUTHORITY_SEEKING"]}') THEN 'not_applied:not_broad_research_query' ELSE 'applied' END AS status FROM n),
        t AS (SELECT id, q, status, CASE WHEN status = 'applied' THEN {_RULES} ELSE [] END AS raw FROM s),
        u AS (SELECT id, q, status, unnest(raw) AS term, unnest(range(1, len(raw) + 1)) AS ord FROM t),
        d0 AS (SELECT id, q, term, min(ord) AS ord FROM u WHERE NOT contains(lower(q), term) GROUP BY ALL), d AS (SELECT * FROM d0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) <= 16),
        g AS (SELECT id, list(term ORDER BY ord) AS terms FROM d GROUP BY id)
        SELECT CAST(t.id AS BIGINT) AS id, CASE WHEN status = 'applied' AND terms IS NULL THEN 'not_applied:no_safe_expansions' ELSE status END AS status, coalesce(array_to_string(terms, '|'), '') AS terms,
            CAST(CASE WHEN terms IS NULL THEN 1 ELSE 1 + least(4, ceil(len(terms) / greatest(3, least(5, len(terms))))) END AS BIGINT) AS n_variants FROM t LEFT JOIN g USING (id)""")
def query_expansion(spark, sf_dir):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Find authority on damages and "), "text")).otherwise(F.col("text"))
    talk = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), said.alias("query"))
    plans = expansion.plans(constants(spark).unionByName(talk), mode="rule")
    return plans.select("id", "status", F.array_join("terms", "|").alias("terms"), F.size("variants").cast("long").alias("n_variants"))


def _questions(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("query"))
    return constants(spark).unionByName(talk)


@query(f"""WITH {V}, a AS (SELECT id, query FROM v UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations),
        e AS (SELECT id, query, nullif(regexp_extract(query, '{_L["CASE_NAME"]}', 1), '') AS target, nullif(regexp_extract(query, '{_L["US_CITATION"]}'), '') AS citation FROM a)
        SELECT CAST(id AS BIGINT) AS id, target, citation, CASE WHEN regexp_matches(query, '{_L["AUTHOR_QUESTION"]}') THEN 'author' WHEN regexp_matches(query, '{_L["HOLDING_QUESTION"]}') THEN 'holding'
            WHEN regexp_matches(query, '{_L["POSTURE_QUESTION"]}') THEN 'posture' WHEN regexp_matches(query, '{_L["LEADS_QUESTION"]}') THEN 'research_leads' WHEN regexp_matches(query, '{_L["ISSUE_QUESTION"]}') THEN 'issue_analysis'
            WHEN citation IS NOT NULL THEN 'citation_lookup' WHEN target IS NOT NULL THEN 'issue_analysis' ELSE 'off_target' END AS intent,
            CASE WHEN regexp_matches(query, '{_L["DEPTH_QUESTION"]}') THEN 'detailed' ELSE 'concise' END AS depth FROM e""")
def query_intent(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumns({"target": grounding.case_in("query"), "citation": grounding.citation_in("query")})
    return q.select("id", "target", "citation", grounding.intent("query", target=F.col("target"), citation=F.col("citation"), route=F.lit(None).cast("string")).alias("intent"), grounding.depth("query").alias("depth"))


@query(f"""WITH s AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Smith v. Jones' END AS last_target_case FROM conversations WHERE conv_id % 4 <> 0),
        j AS (SELECT c.conv_id, turn, text, s.conv_id AS k, last_target_case FROM conversations c LEFT JOIN s USING (conv_id)),
        t AS (SELECT *, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'not_applied:empty_query' WHEN regexp_matches(text, '{_L["CASE_NAME"]}') THEN 'not_applied:explicit_target' WHEN k IS NULL THEN 'not_applied:no_conversation_state'
            WHEN last_target_case IS NULL THEN 'not_applied:no_state_target' WHEN NOT regexp_matches(text, '{_L["FOLLOW_UP"]}') THEN 'not_applied:not_followup' ELSE 'applied:conversation_state' END AS status FROM j)
        SELECT conv_id, turn, status, sha1(CASE WHEN status LIKE 'applied%' THEN 'In ' || last_target_case || ', ' || lower(substr(text, 1, 1)) || substr(text, 2) ELSE text END) AS digest FROM t""")
def followup_grounding(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    state = talk.where("conv_id % 4 <> 0").select("conv_id").distinct().withColumn("last_target_case", F.when(F.col("conv_id") % 3 == 0, "Smith v. Jones"))
    return grounding.follow_ups(talk, state, key="conv_id", question="text").select("conv_id", "turn", "status", F.sha1("effective_query").alias("digest"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
    SELECT source, lang, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first, lang) = 1""")
def most_common_name(spark, sf_dir):
    return grounding.most_common_name(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


EV = lexicon.EVIDENCE_STOPWORDS
NAMED = f"""{searching.BM25}, qt AS (SELECT item_id AS query_id, {ts('text', EV, 2)} AS query_tokens FROM benchmark),
    h AS (SELECT query_id, c.doc_id, c.chunk_id, rank, {ts('c.text', EV, 2)} AS name_tokens, query_tokens FROM bm JOIN chunks c USING (chunk_id) JOIN qt USING (query_id))"""



def _named_hits(spark, sf_dir, names="text"):
    """Hits with the tokens of ``names``."""
    hits = searching.bm25(spark, sf_dir)
    text = searching.hit_chunks(spark, sf_dir, hits).select("chunk_id", "doc_id", tx.token_set(names, EV, 2).alias("name_tokens"))
    return written(hits.join(text, "chunk_id").join(_question_tokens(spark, sf_dir), "query_id"), "named-hits")


def _question_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.token_set("text", EV, 2).alias("query_tokens"))


@query(f"""WITH {NAMED}, o AS (SELECT query_id, doc_id, rank, len(list_intersect(name_tokens, query_tokens)) AS o FROM h),
    s AS (SELECT query_id, doc_id, round(sum(o * (1 + 1 / rank)), 6) AS score, min(rank) AS best_rank FROM o WHERE o > 0 GROUP BY ALL),
    rk AS (SELECT *, lead(score) OVER x AS second, row_number() OVER x AS r FROM s WINDOW x AS (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id))
    SELECT query_id, doc_id, score, best_rank FROM rk WHERE r = 1 AND (second IS NULL OR score > round(second * CAST(1.15 AS DOUBLE), 6))""")
def short_name_target(spark, sf_dir):
    return grounding.short_name_target(_named_hits(spark, sf_dir))


query(ORACLES["short_name_target"], name="short_name_target_all")(short_name_target)


@query(f"""WITH {NAMED}, f AS (SELECT query_id, d.source AS family, rank, list_intersect(name_tokens, query_tokens) AS shared FROM h JOIN documents d USING (doc_id) WHERE rank <= 8),
    s AS (SELECT query_id, family, round(sum(1 / rank + CAST(0.75 AS DOUBLE) * len(shared)), 6) AS score, count(*) AS n, min(rank) AS best_rank, len(list_distinct(flatten(list(shared)))) AS n_shared FROM f GROUP BY ALL),
    rk AS (SELECT *, lead(score) OVER x AS second, row_number() OVER x AS r FROM s WINDOW x AS (PARTITION BY query_id ORDER BY score DESC, n DESC, best_rank, family))
    SELECT query_id, family, score, n, best_rank, n_shared FROM rk WHERE r = 1 AND (second IS NULL OR score > round(second * CAST(1.35 AS DOUBLE), 6)) AND n >= 2 AND n_shared >= 2""")
def convergent_target(spark, sf_dir):
    return _convergent(spark, sf_dir, _named_hits(spark, sf_dir))


query(ORACLES["convergent_target"], name="convergent_target_all")(convergent_target)


def _convergent(spark, sf_dir, named):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("family"))
    hits = named.join(docs, "doc_id").withColumn("shared", F.array_intersect("name_tokens", "query_tokens"))
    return grounding.convergent_target(hits.select("query_id", "family", "rank", "shared"))


def _pattern(name: str) -> str:
    return getattr(lexicon, name).replace("'", "''")


_SPLIT = r"""list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9"(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')"""
_LEAD = f"(regexp_matches(sentence, '{_pattern('HOLDING_LEAD')}') OR regexp_matches(sentence, '{_pattern('HOLDING_CONCLUSION')}'))"


@query(f"""WITH {searching.BM25}, qt AS (SELECT item_id AS query_id, {ts('text', EV, 2)} AS tokens FROM benchmark),
    r AS (SELECT query_id, tokens, c.chunk_id, c.chunk_index, {_SPLIT.replace('text', 'c.text')} AS ss FROM bm JOIN chunks c USING (chunk_id) JOIN qt USING (query_id) WHERE rank <= 8),
    e AS (SELECT query_id, tokens, chunk_id, chunk_index, unnest(ss) AS sentence, unnest(range(len(ss))) AS sent FROM r),
    f AS (SELECT *, {_LEAD} AS lead_, len(list_intersect({ts('sentence', EV, 2)}, tokens)) AS shared FROM e),
    s AS (SELECT *, CASE WHEN length(sentence) < 24 OR regexp_matches(sentence, '{_pattern('INCOMPLETE')}') OR regexp_matches(sentence, '{_pattern('CAPTION')}') OR regexp_matches(sentence, '{_pattern('FRAGMENT_START')}')
            OR regexp_matches(regexp_replace(sentence, '[.,;:!?"'']+$', ''), '{_pattern('TRUNCATED_END')}') OR (contains(lower(sentence), 'question presented') AND NOT lead_) OR (shared = 0 AND NOT lead_) THEN 0
        ELSE round(shared * 4 + CASE WHEN len(tokens) > 0 THEN shared / len(tokens) ELSE 0 END + CASE WHEN lead_ THEN 10 ELSE 0 END - CASE WHEN regexp_matches(lower(sentence), '^(?:that court|the district court)\\b') THEN 12 ELSE 0 END
            - CASE WHEN regexp_matches(sentence, '{_pattern('LOWER_COURT')}') THEN 6 ELSE 0 END + CASE WHEN starts_with(lower(sentence), 'held:') THEN 4 ELSE 0 END + CASE WHEN sent = 0 AND lead_ THEN 1 ELSE 0 END
            - CASE WHEN length(sentence) > 320 THEN 1 ELSE 0 END - CASE WHEN contains(lower(sentence), 'justice') AND contains(lower(sentence), 'dissent') THEN 2 ELSE 0 END, 6) END AS score FROM f),
    d AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, lower(sentence) ORDER BY score DESC, chunk_index, sent, chunk_id) = 1)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, sent, chunk_id) AS rank, chunk_id, sha1(sentence) AS digest, score FROM d QUALIFY rank <= 3""")
def evidence_sentences_topk(spark, sf_dir):
    hits = searching.bm25(spark, sf_dir, k=8).drop("rank")
    text = searching.hit_chunks(spark, sf_dir, hits).select("chunk_id", "chunk_index", "text")
    rows = hits.join(text, "chunk_id").join(_question_tokens(spark, sf_dir).withColumnRenamed("query_tokens", "tokens"), "query_id").withColumn("named", F.lit(False))
    return evidence.best_sentences(rows, query="query_id").select("query_id", "rank", "chunk_id", F.sha1("sentence").alias("digest"), "score")


@query(f"""WITH {searching.BM25},
    t AS (SELECT query_id, chunk_id, CASE WHEN query_id % 3 = 0 AND rank <= 2 THEN 0 WHEN query_id % 3 = 0 AND rank <= 4 THEN 1 WHEN query_id % 3 <> 2 AND rank <= 8 THEN 2 + (rank % 3) ELSE 5 END AS r FROM bm
        UNION ALL SELECT query_id, chunk_id, 5 FROM bm),
    m AS (SELECT query_id, chunk_id, min(r) AS tier_rank FROM t GROUP BY ALL), l AS (SELECT *, min(tier_rank) OVER (PARTITION BY query_id) AS least FROM m)
    SELECT query_id, chunk_id, CAST(tier_rank AS INTEGER) AS tier_rank FROM l WHERE tier_rank <= CASE WHEN least <= 1 THEN 1 WHEN least <= 4 THEN 4 ELSE 5 END""")
def verification_scope(spark, sf_dir):
    q, r = F.col("query_id"), F.col("rank")
    names = F.array(*[F.lit(n) for n in ("prompt_scope", "target_doc", "target_case")])
    tier = F.when((q % 3 == 0) & (r <= 2), "sentence_evidence").when((q % 3 == 0) & (r <= 4), "generation_source").when((q % 3 != 2) & (r <= 8), F.element_at(names, (r % 3 + 1).cast("int"))).otherwise("retrieved")
    hits = searching.bm25(spark, sf_dir)
    tiers = hits.select("query_id", "chunk_id", tier.alias("tier")).unionByName(hits.select("query_id", "chunk_id", F.lit("retrieved").alias("tier")))
    return evidence.scope(tiers, query="query_id", key="chunk_id")


@query(f"""WITH {searching.BM25}, qt AS (SELECT item_id AS query_id, {ts('text', EV, 2)} AS tokens FROM benchmark),
    h AS (SELECT query_id, tokens, c.chunk_id, rank, substr(c.text, 1, 2400) AS head FROM bm JOIN chunks c USING (chunk_id) JOIN qt USING (query_id)),
    s AS (SELECT query_id, chunk_id, rank, len(list_intersect({ts('head', EV, 2)}, tokens)) AS shared, len(tokens) AS n, regexp_matches(head, '{_pattern('TOPIC')}') AS topic FROM h),
    p AS (SELECT query_id, chunk_id, rank, round(4 * shared + shared / greatest(n, 1) + CASE WHEN topic THEN 2 ELSE 0 END, 6) AS score FROM s WHERE shared > 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS place, chunk_id, score FROM p QUALIFY place <= 6""")
def topic_fallback(spark, sf_dir):
    hits = searching.bm25(spark, sf_dir)
    text = searching.hit_chunks(spark, sf_dir, hits).select("chunk_id", "text")
    return evidence.topic_fallback(hits.join(text, "chunk_id").join(_question_tokens(spark, sf_dir).withColumnRenamed("query_tokens", "tokens"), "query_id"), query="query_id")


@query()
def claim_decompose(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    return claims.decomposed(talk)


SAID = ["42 U.S.C. 1983 applies.", "See 410 U.S. 113 here.", "The court held so.", "It may rain.", "Plain fact."]


@query(f"""WITH v(id, text) AS (VALUES {', '.join(f'({i}, {quoted(t)})' for i, t in enumerate(SAID))}), a AS (SELECT id, text FROM v UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations)
    SELECT CAST(id AS BIGINT) AS id, CASE WHEN regexp_matches(text, '{_pattern('STATUTE')}') THEN 'statutory' WHEN regexp_matches(text, '{_pattern('CITED')}') THEN 'citation' WHEN regexp_matches(text, '{_pattern('HELD')}') THEN 'holding' ELSE 'fact' END AS claim_type,
        CASE WHEN regexp_matches(text, '{_pattern('HEDGED')}') THEN 'hedged' ELSE 'found' END AS certainty FROM a""")
def claim_types(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    rows = spark.createDataFrame(list(enumerate(SAID)), "id long, text string").unionByName(talk)
    return rows.select("id", claims.claim_type(F.col("text")).alias("claim_type"), claims.certainty(F.col("text")).alias("certainty"))


@query(r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM conversations),
    e AS (SELECT conv_id, turn, unnest(s) AS text, unnest(range(1, len(s) + 1)) AS n FROM s),
    o AS (SELECT *, turn * 10000 + n AS ord FROM e)
    SELECT conv_id, turn, n AS sent_id, 'clm_' || substr(sha1(concat_ws('|', conv_id, n, 0, length(text), lower(text))), 1, 12) AS claim_id FROM o
    QUALIFY row_number() OVER (PARTITION BY conv_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY ord) = 1""")
def claim_ids_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tx.sentences("text")).alias("i", "text")).withColumn("sent_id", (F.col("i") + 1).cast("long"))
    rows = rows.withColumn("ord", F.col("turn") * 10000 + F.col("sent_id"))
    kept = claims.first_of_each(rows, doc="conv_id", text="text", order="ord")
    return kept.select("conv_id", "turn", "sent_id", claims.claim_id(F.col("conv_id"), F.col("sent_id"), F.lit(0), F.length("text"), F.col("text")).alias("claim_id"))


SKIPPED = [
    "", "For these reasons.", "A. B.", "The court relied on Smith Inc.", "The court said this:", "The claim was filed by Mr. X.", "The court said that.", 'He said "the rule is this.', "Too short here.",
    '"Quoted" the court was held to be right.', "lowercase start of the sentence is here.", "Supported by allowed answer facts and it is so.", "Nothing verbal about these seven words.", "The court held that the rule applies to agencies.",
]


@query(rf"""WITH v(id, text) AS (VALUES {', '.join(f'({i}, {quoted(t)})' for i, t in enumerate(SKIPPED))}), a AS (SELECT id, text FROM v UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations),
    t AS (SELECT id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM a),
    c AS (SELECT id, t, regexp_replace(t, '[\x{{C0}}-\x{{24F}}]', 'z', 'g') AS b, length(t) - length(replace(t, '"', '')) AS q, length(replace(t, '“', '')) <> length(replace(t, '”', '')) OR length(replace(t, '‘', '')) <> length(replace(t, '’', '')) AS u FROM t)
    SELECT CAST(id AS BIGINT) AS id, CASE WHEN t = '' THEN 'empty_claim' WHEN regexp_matches(t, '{_pattern('LOW_VALUE')}') THEN 'low_value_rhetorical_or_connective' WHEN regexp_matches(t, '{_pattern('FRAGMENT')}') THEN 'malformed_fragment'
        WHEN regexp_matches(b, '{_pattern('TRAILING_ABBREVIATION')}') THEN 'malformed_trailing_abbreviation' WHEN regexp_matches(t, '(?:[,:;]|,[.])$') THEN 'malformed_trailing_punctuation'
        WHEN regexp_matches(b, '{_pattern('SINGLE_INITIAL')}') AND NOT regexp_matches(b, '{_pattern('INITIALS')}') THEN 'malformed_trailing_initial' WHEN regexp_matches(b, '{_pattern('DANGLING')}') THEN 'malformed_dangling_clause'
        WHEN q % 2 = 1 OR u THEN 'malformed_unbalanced_quote' WHEN len(regexp_extract_all(t, '[A-Za-z][A-Za-z''-]*')) < 4 THEN 'too_short' WHEN regexp_matches(t, '^[,.;:"'']') THEN 'malformed_leading_punctuation'
        WHEN regexp_matches(t, '^\p{{Ll}}') THEN 'malformed_lowercase_start' WHEN starts_with(lower(t), 'supported by allowed answer facts') THEN 'low_value_rhetorical_or_connective'
        WHEN NOT regexp_matches(b, '{_pattern('FINITE_VERB')}') THEN 'no_finite_verb' END AS reason FROM c""")
def claim_skip_reasons(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    rows = spark.createDataFrame(list(enumerate(SKIPPED)), "id long, text string").unionByName(talk)
    return rows.select("id", claims.skip_reason(F.col("text")).alias("reason"))
