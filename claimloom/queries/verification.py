"""Queries on claim verification, verdicts, guards and citations."""

from pyspark.sql import functions as F

from .. import config, lexicon
from ..functions import text as tx
from ..operators import verification as ver
from . import query, searching, table


def cw(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def ts(x: str, stop, least: int) -> str:
    return f"list_distinct(list_filter(string_split({cw(x)}, ' '), lambda t: length(t) >= {least} AND NOT list_contains({listed(stop)}, t)))"


def odd(x: str) -> str:
    """Parity of negations; a 'no' before a number is none."""
    return f"(len(list_filter(string_split(regexp_replace({x}, '(^| )no ([0-9])', '\\1nn \\2', 'g'), ' '), lambda t: list_contains({listed(lexicon.NEGATIONS)}, t))) % 2)"


LEVELS = ["scotus", "circuit", "district", "state_supreme", "state_appellate", "state_trial", "other"]
WEIGHT = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {config.AUTHORITY.get(x, config.AUTHORITY_UNKNOWN)}" for i, x in enumerate(LEVELS)) + " END"
PAIRS = f"""{searching.BM25},
    pr AS (SELECT b.query_id AS claim_id, b.chunk_id, b.rank - 1 AS idx, c.text AS premise, q.text AS hypothesis, c.doc_id,
        {WEIGHT.replace('doc_id', 'c.doc_id')} AS w, (b.rank - 1) % 6 AS tier
        FROM bm b JOIN chunks c USING (chunk_id) JOIN benchmark q ON q.item_id = b.query_id WHERE b.rank <= 8),
    p1 AS (SELECT *, {cw('premise')} AS p, {cw('hypothesis')} AS h, {ts('premise', lexicon.PAIR_STOPWORDS, 3)} AS pt, {ts('hypothesis', lexicon.PAIR_STOPWORDS, 3)} AS ht,
        {ts('premise', lexicon.CONTRADICTION_STOPWORDS, 3)} AS pc, {ts('hypothesis', lexicon.CONTRADICTION_STOPWORDS, 3)} AS hc FROM pr),
    p2 AS (SELECT *, len(list_intersect(pt, ht)) / greatest(len(ht), 1) AS cov, starts_with(h, 'it is not true that ') AS wr,
        len(list_intersect(pc, hc)) AS shared FROM p1),
    p3 AS (SELECT *, CASE WHEN len(pt) = 0 OR len(ht) = 0 THEN 'empty' WHEN contains(p, h) OR contains(h, p) THEN 'contained'
        WHEN (wr OR {odd('p')} <> {odd('h')}) AND (cov >= 0.72 OR (wr AND cov >= 0.58)) THEN 'negated' WHEN cov < 0.18 THEN 'apart' ELSE 'near' END AS br FROM p2),
    p4 AS (SELECT *, round(CAST(CASE WHEN br IN ('empty', 'negated') THEN 0.05 WHEN br = 'contained' THEN 0.96 WHEN br = 'apart' THEN 0.08 ELSE least(CAST(0.28 AS DOUBLE) + CAST(0.54 AS DOUBLE) * cov, 0.93) END AS DOUBLE), 6) AS e,
        round(CAST(CASE WHEN br IN ('empty', 'apart') THEN 0.05 WHEN br = 'contained' THEN 0.01 WHEN br = 'negated' THEN least(CAST(0.75 AS DOUBLE) + CAST(0.20 AS DOUBLE) * cov, 0.94) WHEN cov >= 0.45 THEN 0.03 ELSE 0.05 END AS DOUBLE), 6) AS c,
        len(hc) >= 4 AND shared >= 3 AND shared / len(hc) >= 0.30 AS ov FROM p3)"""
AGGREGATED = f"""{PAIRS},
    a1 AS (SELECT claim_id,
        max({{'s': e * w, 'i': -idx, 'e': e, 'c': c, 'tier': tier}}) AS p, max({{'s': c * w, 'i': -idx, 'e': e, 'c': c, 'tier': tier, 'ov': ov}}) AS n,
        avg(CASE WHEN e > 0.5 THEN 1.0 ELSE 0.0 END) AS sr, sum(e * w / (idx + 1)) / sum(w / (idx + 1)) AS awe FROM p4 GROUP BY claim_id),
    a2 AS (SELECT *, round(n.s - p.s, 6) AS m0 FROM a1),
    a3 AS (SELECT *, p.i = n.i AND p.e >= 0.7 AND n.c >= 0.6 AND m0 < 0.2 AS confused FROM a2),
    a4 AS (SELECT *, CASE WHEN confused THEN 0 ELSE n.s END AS contra, CASE WHEN confused THEN -p.s ELSE m0 END AS m, p.e >= 0.95 AND p.tier <= 2 AS np FROM a3),
    a5 AS (SELECT *, contra > 0.6 AND NOT ((p.e >= 0.9 AND (sr >= 0.35 OR awe >= 0.45) AND m < 0.1) OR (np AND n.tier > p.tier))
        AND CASE WHEN n.tier <= p.tier THEN CASE WHEN p.tier <= 1 AND p.e >= 0.85 THEN m >= 0.15 ELSE true END
            WHEN p.tier <= 2 AND p.e >= 0.85 THEN m >= 0.2 ELSE m >= 0.1 END AND n.ov AS is_contradicted FROM a4),
    ag AS (SELECT claim_id, round(greatest(0, least(1, CAST(0.4 AS DOUBLE) * p.s + CAST(0.2 AS DOUBLE) * sr + CAST(0.3 AS DOUBLE) * awe - CAST(0.2 AS DOUBLE) * CASE WHEN is_contradicted THEN contra ELSE 0 END)), 6) AS final_score,
        is_contradicted, -p.i AS best_idx, -n.i AS contra_idx, round(sr, 6) AS support_ratio, round(awe, 6) AS authority_weighted FROM a5),
    vd AS (SELECT b.item_id AS claim_id, ag.final_score, CASE WHEN ag.claim_id IS NULL THEN 'NO_EVIDENCE' WHEN is_contradicted THEN 'CONTRADICTED'
        WHEN final_score >= 0.7 THEN 'VERIFIED' WHEN final_score >= 0.55 THEN 'SUPPORTED' WHEN final_score >= 0.4 THEN 'POSSIBLE_SUPPORT' ELSE 'UNSUPPORTED' END AS verdict,
        best_idx, contra_idx, support_ratio FROM benchmark b LEFT JOIN ag ON b.item_id = ag.claim_id)"""


def evidence_pairs(spark, sf_dir, hits=None, chunks=None):
    """Claims of the benchmark with their eight best chunks, weights and tiers; hits and their chunks may be given."""
    hits = hits or searching.bm25(spark, sf_dir, k=config.MERGED_LIMIT)
    chunks = (chunks or searching.hit_chunks(spark, sf_dir, hits)).select("chunk_id", "doc_id", F.col("text").alias("premise"))
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("hypothesis"))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = hits.join(chunks, "chunk_id").join(claims, "query_id").withColumns({"idx": F.col("rank") - 1, "doc_type": F.lit("case"), "level": level})
    return rows.select(F.col("query_id").alias("claim_id"), "chunk_id", "doc_id", "idx", "premise", "hypothesis", ver.authority("doc_type", "level").alias("w"), ((F.col("rank") - 1) % 6).alias("tier"))


def scored_pairs(spark, sf_dir, hits=None, chunks=None):
    rows = ver.coverage_scores(evidence_pairs(spark, sf_dir, hits, chunks), "premise", "hypothesis")
    return rows.withColumns({"e": F.col("entailment"), "c": F.col("contradiction"), "overlap_valid": ver.overlap_valid("premise", "hypothesis"), "posture_valid": ver.posture_valid("premise", "hypothesis")})


def judged(spark, sf_dir, hits=None, chunks=None):
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    scored = ver.aggregate(scored_pairs(spark, sf_dir, hits, chunks))
    return claims.join(scored, "claim_id", "left").withColumn("verdict", ver.verdict("final_score", "is_contradicted", F.col("final_score").isNotNull()))


@query()
def pair_score_heuristic(spark, sf_dir):
    return ver.heuristic_scores(evidence_pairs(spark, sf_dir), "premise", "hypothesis").select("claim_id", "chunk_id", "entailment", "neutral", "contradiction")


@query(f"WITH {PAIRS} SELECT claim_id, chunk_id, e AS entailment, c AS contradiction FROM p4")
def pair_score_coverage(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("claim_id", "chunk_id", "entailment", "contradiction")


@query(f"WITH {AGGREGATED} SELECT claim_id, final_score, is_contradicted, best_idx, contra_idx, support_ratio, authority_weighted FROM ag")
def claim_aggregate(spark, sf_dir):
    return ver.aggregate(scored_pairs(spark, sf_dir))


@query(f"WITH {AGGREGATED} SELECT claim_id, final_score, verdict, CASE WHEN verdict IN ('VERIFIED', 'SUPPORTED') THEN 'supported' WHEN verdict = 'POSSIBLE_SUPPORT' THEN 'possibly_supported' ELSE 'unsupported' END AS support_level FROM vd")
def verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select("claim_id", "final_score", "verdict", ver.support_level(F.col("verdict")).alias("support_level"))


def _overlap_sql() -> str:
    parts = " OR ".join(f"(list_has_any(p, {listed(y)}) AND list_has_any(h, {listed(n)})) OR (list_has_any(p, {listed(n)}) AND list_has_any(h, {listed(y)}))" for y, n in lexicon.POLARITY)
    texts = ["'The court granted the petition for rehearing.'", "'The court denied the petition for rehearing.'", "'The lower ruling was affirmed on appeal.'", "'The statute is valid under the first amendment.'", "'The statute is invalid under the second amendment.'"]
    texts += ["'Article III standing requires a concrete injury and redress.'", "'A concrete injury and redress are required for article iii standing.'", "''"]
    rows = ", ".join(f"({i}, {t})" for i, t in enumerate(texts))
    phrases = listed(lexicon.ANCHOR_PHRASES)
    return f"""WITH v(id, text) AS (VALUES {rows}),
        t AS (SELECT CAST(id AS BIGINT) AS id, text, {ts('text', lexicon.CONTRADICTION_STOPWORDS, 3)} AS t, list_filter({phrases}, lambda a: contains(lower(text), a)) AS a FROM v),
        j AS (SELECT x.id AS premise_id, y.id AS hypothesis_id, x.t AS p, y.t AS h, x.a AS pa, y.a AS ha FROM t x, t y)
        SELECT premise_id, hypothesis_id, list_has_any(p, h) AND ({parts}) AS conflict,
            (list_has_any(p, h) AND ({parts})) OR ((len(ha) = 0 OR list_has_any(ha, pa)) AND len(h) >= 4 AND len(list_intersect(p, h)) >= 3 AND len(list_intersect(p, h)) / greatest(len(h), 1) >= 0.30) AS valid FROM j""", [t[1:-1] for t in texts]


_OVERLAP, _TEXTS = _overlap_sql()


@query(_OVERLAP)
def contradiction_overlap(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(_TEXTS)), "id long, text string")
    pairs = rows.select(F.col("id").alias("premise_id"), F.col("text").alias("p")).crossJoin(rows.select(F.col("id").alias("hypothesis_id"), F.col("text").alias("h")))  # eight constants
    return pairs.select("premise_id", "hypothesis_id", ver.polarity_conflict(ver.content("p"), ver.content("h")).alias("conflict"), ver.overlap_valid("p", "h").alias("valid"))


GUARDED = [
    ("VERIFIED", "In Smith v. Jones the court affirmed the judgment.", "Smith v. Jones: the judgment was affirmed by this court."),
    ("VERIFIED", "In Smith v. Jones the court affirmed the judgment.", "The judgment was affirmed by this court."),
    ("SUPPORTED", "The First Amendment protects pamphlets and leaflets.", "Pamphlets and leaflets are protected."),
    ("SUPPORTED", "Adverse possession needs hostile entry for years.", "Possession that is adverse needs entry."),
    ("SUPPORTED", "Tariff refunds were ordered quickly.", "Nothing in common."),
    ("POSSIBLE_SUPPORT", "See 410 U.S. 113 for the rule.", "410 U.S. 113 states the rule."),
    ("UNSUPPORTED", "Anything at all.", "Anything."),
    ("VERIFIED", "No evidence here.", None),
]


def _guard_sql() -> str:
    q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {q(a)}, {q(b)}, {q(c)})" for i, (a, b, c) in enumerate(GUARDED))
    compact = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
    spec = lambda x: f"list_filter({ts(x, lexicon.EVIDENCE_STOPWORDS + lexicon.LEADS_GENERIC, 2)}, lambda t: NOT regexp_full_match(t, '[0-9]+'))"
    pats = [p.replace("'", "''") for p in (lexicon.CASE_NAME, lexicon.US_CITATION, lexicon.CONSTITUTIONAL)]
    named = " || ".join(f"regexp_extract_all(claim, '{p}')" for p in pats)
    return f"""WITH v(id, label, claim, evidence) AS (VALUES {rows}),
        n AS (SELECT *, list_filter({named}, lambda x: NOT contains({compact('evidence')}, {compact('x')})) AS missing, len(list_intersect({spec('claim')}, {spec('evidence')})) AS shared FROM v),
        s AS (SELECT *, CASE WHEN label NOT IN ('VERIFIED', 'SUPPORTED', 'POSSIBLE_SUPPORT') THEN 'not_applied:verdict_not_supported' WHEN evidence IS NULL THEN 'not_applied:no_supporting_chunk'
            WHEN len(missing) > 0 THEN 'blocked:missing_named_evidence' WHEN label <> 'POSSIBLE_SUPPORT' AND shared < 2 THEN 'demote:research_leads_weak_source_alignment'
            ELSE 'passed:research_leads_source_alignment' END AS guard_status FROM n)
        SELECT CAST(id AS BIGINT) AS id, guard_status, CASE WHEN guard_status LIKE 'blocked%' THEN 'UNSUPPORTED' WHEN guard_status LIKE 'demote%' THEN 'POSSIBLE_SUPPORT' ELSE label END AS guarded_label FROM s"""


@query(_guard_sql())
def consistency_guards(spark, sf_dir):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(GUARDED)], "id long, label string, claim string, evidence string")
    return ver.guarded(rows, claim="claim", evidence="evidence", label="label").select("id", "guard_status", "guarded_label")


CITING = [
    "In Miranda v. Arizona, 384 U.S. 436 (1966), the Court held that warnings are required.",
    "Under 42 U.S.C. § 1983 a plaintiff may sue; see also 28 U.S.C. § 1331.",
    "Compare 410 U.S. 113 with Smith v. Jones, 12 F.3d 345.",
    "Nothing is cited here.",
]
_CITE = r"(?i)\b(\d+)\s+(U\.?\s*S\.?\s*C\.?|U\.?\s*S\.?|S\.?\s*Ct\.?|F\.?\s?[23]d|F\.?\s?Supp\.?\s?[23]?d?)\s+(?:§+\s*)?(\d+)"


@query(rf"""WITH v(id, text) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(CITING))}),
        d AS (SELECT id, text FROM v UNION ALL SELECT 100 + doc_id, text FROM documents),
        f AS (SELECT id, regexp_extract_all(text, '{_CITE}') AS c FROM d),
        x AS (SELECT id, unnest(c) AS raw, unnest(range(1, len(c) + 1)) AS ord FROM f)
        SELECT CAST(id AS BIGINT) AS id, ord, raw, upper(regexp_replace(raw, '[^A-Za-z0-9]+', '', 'g')) AS normalized,
            CASE WHEN regexp_matches(raw, '(?i)S\.?\s*C\.?\s') AND NOT regexp_matches(raw, '(?i)Ct') THEN 'statute' ELSE 'case' END AS type FROM x""")
def citation_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), "text")
    rows = spark.createDataFrame(list(enumerate(CITING)), "id long, text string").unionByName(docs)
    found = rows.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(_CITE), F.lit(0))).alias("ord", "raw"))
    statute = F.col("raw").rlike(r"(?i)S\.?\s*C\.?\s") & ~F.col("raw").rlike("(?i)Ct")
    return found.select("id", (F.col("ord") + 1).cast("long").alias("ord"), "raw", F.upper(F.regexp_replace("raw", "[^A-Za-z0-9]+", "")).alias("normalized"), F.when(statute, "statute").otherwise("case").alias("type"))


@query(f"""WITH {searching.DENSE},
        b AS (SELECT query_id, vec_id, score, CASE query_id % 3 WHEN 0 THEN 'alleged' WHEN 1 THEN 'found' ELSE 'stated' END AS certainty, CASE WHEN query_id % 40 = 0 THEN 'holding' ELSE 'fact' END AS claim_type FROM dt WHERE rank = 1),
        h AS (SELECT *, round(CAST(0.75 AS DOUBLE) + CASE certainty WHEN 'alleged' THEN -0.10 WHEN 'found' THEN 0.05 ELSE 0 END + CASE claim_type WHEN 'holding' THEN 0.05 ELSE 0 END, 4) AS high, round(CAST(0.55 AS DOUBLE) - CASE claim_type WHEN 'fact' THEN 0.05 ELSE 0 END, 4) AS mid FROM b)
        SELECT query_id, vec_id, score, high, mid, CASE WHEN score >= high THEN 'VERIFIED' WHEN score >= mid THEN 'WEAK' ELSE 'UNSUPPORTED' END AS label FROM h""")
def citation_support(spark, sf_dir):
    best = searching.dense(spark, sf_dir).where("rank = 1").withColumns({
        "certainty": F.when(F.col("query_id") % 3 == 0, "alleged").when(F.col("query_id") % 3 == 1, "found").otherwise("stated"),
        "claim_type": F.when(F.col("query_id") % 40 == 0, "holding").otherwise("fact"),
    })
    high, mid = ver.citation_thresholds("certainty", "claim_type")
    out = best.withColumns({"high": high, "mid": mid})
    return out.select("query_id", "vec_id", "score", "high", "mid", F.when(F.col("score") >= F.col("high"), "VERIFIED").when(F.col("score") >= F.col("mid"), "WEAK").otherwise("UNSUPPORTED").alias("label"))
