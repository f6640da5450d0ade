"""Queries on links, blocks, repair and evaluation."""

from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as tx
from ..operators import answers, metrics
from ..storage import written
from . import query, searching, table, verification
from .evidence import _pattern

VERDICTS = ["VERIFIED", "SUPPORTED", "POSSIBLE_SUPPORT", "UNSUPPORTED", "CONTRADICTED"]
_LEVEL = "CASE WHEN verdict IN ('VERIFIED', 'SUPPORTED') THEN 'supported' WHEN verdict = 'POSSIBLE_SUPPORT' THEN 'possibly_supported' ELSE 'unsupported' END"


def _linked(spark, sf_dir):
    """Judged claims of the benchmark with the ids of their best chunks, and the sources of those chunks."""
    found = searching.bm25(spark, sf_dir, k=8)
    chunks = searching.hit_chunks(spark, sf_dir, found)
    judged = written(verification.judged(spark, sf_dir, found, chunks), "judged")
    hits = found.select(F.col("query_id").alias("claim_id"), "chunk_id", (F.col("rank") - 1).alias("idx"))
    best = hits.select("claim_id", F.col("idx").alias("best_idx"), F.col("chunk_id").alias("supporting"))
    contra = hits.select("claim_id", F.col("idx").alias("contra_idx"), F.col("chunk_id").alias("contradicting"))
    rows = judged.join(best, ["claim_id", "best_idx"], "left").join(contra, ["claim_id", "contra_idx"], "left")
    rows = rows.withColumns({"supporting_score": F.col("final_score"), "contradicting_score": F.col("support_ratio"), "is_contradicted": F.coalesce("is_contradicted", F.lit(False))})
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_label"))
    return rows, chunks.select("chunk_id", "doc_id").join(docs, "doc_id")


_LINKS = f"""{verification.AGGREGATED},
    lk AS (SELECT vd.claim_id, 'supporting' AS relationship, b.chunk_id, vd.final_score AS score FROM vd JOIN bm b ON b.query_id = vd.claim_id AND b.rank - 1 = vd.best_idx
        UNION ALL SELECT vd.claim_id, 'contradicting', b.chunk_id, vd.support_ratio FROM vd JOIN bm b ON b.query_id = vd.claim_id AND b.rank - 1 = vd.contra_idx JOIN ag ON ag.claim_id = vd.claim_id WHERE ag.is_contradicted),
    ll AS (SELECT lk.*, d.source AS source_label FROM lk JOIN chunks USING (chunk_id) JOIN documents d USING (doc_id))"""


@query(f"WITH {_LINKS} SELECT claim_id, relationship, chunk_id, score, source_label FROM ll")
def claim_links(spark, sf_dir):
    return answers.links(*_linked(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT vd.claim_id, {_LEVEL} AS support_level, verdict, CAST(count(ll.claim_id) AS INTEGER) AS n_evidence FROM vd LEFT JOIN ll ON ll.claim_id = vd.claim_id GROUP BY ALL")
def claim_annotations(spark, sf_dir):
    rows, sources = _linked(spark, sf_dir)
    return answers.annotations(rows, answers.links(rows, sources)).drop("evidence")


def _claims(spark, sf_dir):
    """Sentences of conversations as claims with verdicts by turn and place."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tx.sentences("text")).alias("i", "text"))
    names = F.array(*[F.lit(v) for v in VERDICTS])
    return rows.withColumns({"verdict": F.element_at(names, ((F.col("turn") * 3 + F.col("i")) % 5 + 1).cast("int")), "start": F.col("turn") * 100000 + F.col("i")})


_CLAIMS = rf"""s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM conversations),
    e AS (SELECT conv_id, turn, unnest(s) AS text, unnest(range(len(s))) AS i FROM s),
    cl AS (SELECT conv_id, text, turn * 100000 + i AS start, ['VERIFIED', 'SUPPORTED', 'POSSIBLE_SUPPORT', 'UNSUPPORTED', 'CONTRADICTED'][(turn * 3 + i) % 5 + 1] AS verdict FROM e),
    su AS (SELECT conv_id, count(*) FILTER (NOT r) AS total, count(*) FILTER (NOT r AND l = 'supported') AS supported, count(*) FILTER (NOT r AND l = 'possibly_supported') AS possibly_supported,
        count(*) FILTER (NOT r AND l = 'unsupported') AS unsupported, count(*) FILTER (r) AS rhetorical FROM (SELECT conv_id, {_LEVEL} AS l, regexp_matches(text, '{_pattern('RHETORICAL')}') AS r FROM cl) GROUP BY conv_id),
    sr AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE round(unsupported / total, 3) END AS unsupported_ratio FROM su)"""


@query(f"WITH {_CLAIMS} SELECT *, total > 0 AND unsupported_ratio >= 0.5 AS show_warning FROM sr")
def support_summary(spark, sf_dir):
    return answers.support_summary(_claims(spark, sf_dir), by="conv_id")


@query(f"""WITH {_CLAIMS} SELECT conv_id, CASE WHEN total > 0 AND unsupported_ratio >= 0.5 THEN 'unsupported_majority' END AS warning_kind, CASE WHEN total > 0 AND unsupported_ratio >= 0.5 THEN
        CASE WHEN unsupported = total THEN 'This response is largely unsupported by retrieved evidence' ELSE 'A large share of this response is unsupported by retrieved evidence' END || ' (' || unsupported || ' of ' || total || ' claims unsupported).' END AS warning FROM sr""")
def answer_warnings(spark, sf_dir):
    return answers.warning(answers.support_summary(_claims(spark, sf_dir), by="conv_id")).select("conv_id", "warning_kind", "warning")


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey, CASE l_returnflag WHEN 'A' THEN 'supporting' WHEN 'R' THEN 'contradicting' ELSE 'other' END AS relationship, l_suppkey AS doc_id, l_partkey AS chunk_id, l_linestatus AS label, CAST(l_quantity AS DOUBLE) AS score FROM lineitem),
    b AS (SELECT claim_id, l_orderkey, unnest(['supporting', 'contradicting']) AS relationship, doc_id, chunk_id, 'best' AS label, score / 100 AS score FROM l WHERE claim_id % 3 = 0),
    u AS (SELECT *, 0 AS o FROM l WHERE relationship <> 'other' UNION ALL SELECT *, 1 FROM b),
    c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY claim_id, relationship ORDER BY o, score DESC, label DESC, CAST(chunk_id AS VARCHAR) DESC) = 1)
    SELECT l_orderkey AS interaction_id, CASE relationship WHEN 'supporting' THEN 'support' ELSE 'contradiction' END AS relation, CAST(doc_id AS VARCHAR) AS doc_id, CAST(chunk_id AS VARCHAR) AS chunk_id, label, max(score) AS score FROM c GROUP BY ALL""")
def interaction_cases(spark, sf_dir):
    """Order lines as claims with one link each; every third also has what its verification found best."""
    flag = F.when(F.col("l_returnflag") == "A", "supporting").when(F.col("l_returnflag") == "R", "contradicting").otherwise("other")
    links = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_orderkey").alias("interaction_id"), flag.alias("relationship"),
        F.col("l_suppkey").cast("string").alias("doc_id"), F.col("l_partkey").cast("string").alias("chunk_id"), F.col("l_linestatus").alias("source_label"), F.col("l_quantity").cast("double").alias("score"),
    )
    best = links.where("claim_id % 3 = 0").withColumns({"relationship": F.explode(F.array(F.lit("supporting"), F.lit("contradicting"))), "source_label": F.lit("best"), "score": F.col("score") / 100})
    return answers.cases_of_interactions(answers.cases_of_claims(links, best), links, by="interaction_id")



@query(rf"""WITH {_CLAIMS},
    g AS (SELECT conv_id, start, CASE WHEN regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS sentence FROM (SELECT conv_id, start, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM cl WHERE verdict IN ('VERIFIED', 'SUPPORTED') AND length(text) >= 18)),
    f AS (SELECT conv_id, lower(sentence) AS k, min({{'start': start, 'sentence': sentence}}) AS m FROM g GROUP BY ALL),
    p AS (SELECT conv_id, m.sentence AS sentence, row_number() OVER (PARTITION BY conv_id ORDER BY m.start, m.sentence) AS n FROM f QUALIFY n <= 3),
    x AS (SELECT conv_id, string_agg(sentence, ' ' ORDER BY n) AS repair FROM p GROUP BY conv_id),
    a AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    st AS (SELECT a.conv_id, a.text, repair, CASE WHEN coalesce(total, 0) = 0 THEN 'not_applied:no_claims' WHEN unsupported_ratio < 0.5 THEN 'not_applied:unsupported_ratio_below_threshold'
        WHEN repair IS NULL THEN 'not_applied:no_supported_or_evidence_fallback' WHEN repair = a.text THEN 'not_applied:repair_matches_response' ELSE 'applied:unsupported_claim_repair' END AS status
        FROM a LEFT JOIN sr USING (conv_id) LEFT JOIN x USING (conv_id))
    SELECT conv_id, status, sha1(CASE WHEN status LIKE 'applied%' THEN repair ELSE text END) AS digest FROM st""")
def response_repair(spark, sf_dir):
    return answers.repaired(_answers(spark, sf_dir), _claims(spark, sf_dir), by="conv_id").select("conv_id", "status", F.sha1("answer").alias("digest"))


def _answers(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return talk.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def _spans(spark, sf_dir):
    """Three spans in each answer: overlapping, touching and apart."""
    a = _answers(spark, sf_dir).select("conv_id", F.length("text").cast("long").alias("n"))
    names = F.array(*[F.lit(v) for v in VERDICTS])
    rows = a.select("conv_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    start = F.col("k") * 40 + F.col("conv_id") % 7
    end = F.least(F.col("n"), start + F.element_at(F.array(*[F.lit(x) for x in (45, 40, 10, 20)]), (F.col("k") + 1).cast("int")))
    return rows.select("conv_id", F.concat_ws("-", "conv_id", "k").alias("claim_id"), start.alias("start"), end.cast("long").alias("end"), F.element_at(names, ((F.col("conv_id") + F.col("k")) % 5 + 1).cast("int")).alias("verdict"))


_SPANS = """a AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    sp AS (SELECT conv_id, conv_id || '-' || k AS claim_id, k * 40 + conv_id % 7 AS start, least(length(text), k * 40 + conv_id % 7 + [45, 40, 10, 20][k + 1]) AS "end",
        ['VERIFIED', 'SUPPORTED', 'POSSIBLE_SUPPORT', 'UNSUPPORTED', 'CONTRADICTED'][(conv_id + k) % 5 + 1] AS verdict FROM a, range(4) r(k)),
    ok AS (SELECT *, max("end") OVER (PARTITION BY conv_id ORDER BY start, "end", claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp WHERE start < "end"),
    gr AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start, "end", claim_id) AS BIGINT) AS group_no FROM ok)"""


@query(f'WITH {_SPANS} SELECT conv_id, claim_id, start, "end", group_no FROM gr')
def answer_spans(spark, sf_dir):
    return answers.span_groups(_spans(spark, sf_dir), by="conv_id").select("conv_id", "claim_id", "start", "end", "group_no")


def _re(name, x="t"):
    return f"regexp_matches({x}, '{_pattern(name)}')"


_BLOCKS = rf"""{_SPANS},
    mg AS (SELECT conv_id, group_no, min(start) AS start, max("end") AS "end", count(*) AS claim_count,
        max(CASE verdict WHEN 'CONTRADICTED' THEN 3 WHEN 'UNSUPPORTED' THEN 2 WHEN 'POSSIBLE_SUPPORT' THEN 1 ELSE 0 END) AS worst FROM gr GROUP BY ALL),
    cb AS (SELECT conv_id, start, "end", claim_count, ['verified_claim', 'possibly_supported_claim', 'unsupported_claim', 'contradicted_claim'][worst + 1] AS type, ['supported', 'possibly_supported', 'unsupported', 'unsupported'][worst + 1] AS support_level FROM mg),
    ed AS (SELECT conv_id, length(text) AS start, length(text) AS "end" FROM a UNION ALL SELECT conv_id, start, "end" FROM mg),
    gp AS (SELECT conv_id, coalesce(lag("end") OVER (PARTITION BY conv_id ORDER BY start), 0) AS f, start AS t_ FROM ed),
    rw AS (SELECT conv_id, f, substr(text, f + 1, t_ - f) AS raw FROM gp JOIN a USING (conv_id) WHERE t_ > f),
    bd AS (SELECT conv_id, f + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS start, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS body FROM rw),
    tb AS (SELECT conv_id, start, start + length(body) AS "end", CAST(0 AS BIGINT) AS claim_count, trim(regexp_replace(body, '\s+', ' ', 'g')) AS t FROM bd WHERE body <> ''),
    ty AS (SELECT conv_id, start, "end", claim_count, CASE WHEN {_re('CAVEAT')} THEN 'caveat' WHEN {_re('LABEL')} THEN 'transition'
        WHEN length(t) >= 12 AND NOT regexp_matches(t, '\?$') AND {_re('FACT_ANCHOR', 'z')} AND {_re('ANSWER_VERB', 'z')} THEN 'unverified_claim_candidate' WHEN {_re('TRANSITION')} THEN 'transition' ELSE 'derived_explanation' END AS type
        FROM (SELECT *, regexp_replace(t, '[\x{{C0}}-\x{{24F}}]', 'z', 'g') AS z FROM tb)),
    al AS (SELECT * FROM cb UNION ALL SELECT *, CASE WHEN type = 'unverified_claim_candidate' THEN 'unsupported' END FROM ty),
    bl AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start) - 1 AS block_no FROM al)"""


@query(f'WITH {_BLOCKS} SELECT conv_id, block_no, type, support_level, start, "end", claim_count FROM bl')
def answer_blocks(spark, sf_dir):
    return answers.blocks(_answers(spark, sf_dir), _spans(spark, sf_dir), by="conv_id").select("conv_id", "block_no", "type", "support_level", "start", "end", "claim_count")


@query(f"""WITH {_BLOCKS} SELECT conv_id, count(*) AS total, count(*) FILTER (claim_count > 0) AS claim_blocks, count(*) FILTER (claim_count = 0) AS non_claim_blocks,
    count(*) FILTER (claim_count > 0 OR type = 'unverified_claim_candidate') AS verification_required_blocks, count(*) FILTER (type = 'unverified_claim_candidate') AS unverified_claim_candidates,
    count(*) FILTER (support_level = 'supported') AS supported_blocks, count(*) FILTER (support_level = 'possibly_supported') AS possibly_supported_blocks, count(*) FILTER (support_level = 'unsupported') AS unsupported_blocks FROM bl GROUP BY conv_id""")
def answer_block_summary(spark, sf_dir):
    return answers.block_summary(answers.blocks(_answers(spark, sf_dir), _spans(spark, sf_dir), by="conv_id"), by="conv_id")


@query()
def highlight_select(spark, sf_dir):
    spans = _spans(spark, sf_dir).withColumn("priority", (F.col("end") - F.col("start")).cast("long"))
    return answers.highlights(spans.select("conv_id", "start", "end", "priority"), by="conv_id")


@query("""WITH p AS (SELECT l.quality = 1 AS actual, d.n_chars % 3 <> 0 AS strict, d.n_chars % 7 <> 0 AS lenient FROM labels l JOIN documents d USING (doc_id)),
    m AS (SELECT 'strict' AS mode, actual, strict AS predicted FROM p UNION ALL SELECT 'lenient', actual, lenient FROM p),
    c AS (SELECT mode, count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND predicted) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn, count(*) FILTER (NOT actual AND NOT predicted) AS tn FROM m GROUP BY mode)
    SELECT mode, tp, fp, fn, tn, round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
        round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, 6) AS specificity, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select((F.col("quality") == 1).alias("actual"), (F.col("n_chars") % 3 != 0).alias("strict"), (F.col("n_chars") % 7 != 0).alias("lenient"))
    both = rows.select(F.lit("strict").alias("mode"), "actual", F.col("strict").alias("predicted")).unionByName(rows.select(F.lit("lenient").alias("mode"), "actual", F.col("lenient").alias("predicted")))
    return metrics.confusion(both, by="mode")


@query(f"""WITH {searching.BM25}, t AS (SELECT b.query_id, rank, contains(c.text, array_to_string(string_split(q.text, ' ')[1:5], ' ')) AS hit FROM bm b JOIN chunks c USING (chunk_id) JOIN benchmark q ON q.item_id = b.query_id),
    f AS (SELECT item_id, min(rank) FILTER (hit) AS first FROM benchmark LEFT JOIN t ON t.query_id = item_id GROUP BY item_id)
    SELECT count(*) AS queries, round(count(*) FILTER (first = 1) / count(*), 6) AS p_at_1, round(count(*) FILTER (first <= 5) / count(*), 6) AS hit_at_5, round(count(*) FILTER (first <= 20) / count(*), 6) AS hit_at_20,
        round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 / first END), 6) AS mrr FROM f""")
def hit_at_k(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("probe"))
    hits = searching.bm25(spark, sf_dir)
    hits = hits.join(searching.hit_chunks(spark, sf_dir, hits).select("chunk_id", "text"), "chunk_id").join(asked, "query_id")
    return metrics.hits(asked.select("query_id"), hits.withColumn("hit", F.contains("text", "probe")), query="query_id", cuts=(5, 20))


@query("""WITH e AS (SELECT doc_id, lang AS category, text, [['the', 'de'], ['of', 'la', 'und']] AS groups, ['license', 'password'] AS forbidden FROM documents),
    m AS (SELECT doc_id, category, len(list_filter(groups, lambda g: len(list_filter(g, lambda t: contains(lower(text), t))) = 0)) AS missing, len(list_filter(forbidden, lambda t: contains(lower(text), t))) AS forbidden_hits FROM e)
    SELECT category, count(*) AS items, count(*) FILTER (missing = 0 AND forbidden_hits = 0) AS passed, CAST(sum(missing) AS BIGINT) AS missing_groups, CAST(sum(forbidden_hits) AS BIGINT) AS forbidden_hits FROM m GROUP BY category""")
def expectation_checks(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), "text")
    groups = F.array(F.array(F.lit("the"), F.lit("de")), F.array(F.lit("of"), F.lit("la"), F.lit("und")))
    checked = metrics.expectations(items, text="text", groups=groups, forbidden=F.array(F.lit("license"), F.lit("password")))
    return metrics.by_category(checked, by="category")


@query("""SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS users, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY event_type""")
def status_histograms(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    return e.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.min("value"), 6).alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))
