"""Queries on ingestion, normalisation and chunking."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking
from ..sources import ingest
from . import query, table

LINES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
WORDS = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(rf"""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha1(t) AS digest
    FROM (SELECT doc_id, regexp_replace({LINES}, '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def normalize_text(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_lines("text").alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha1("t").alias("digest"))


def _windows_sql(size: int, step: int) -> str:
    return f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) > {size} THEN CAST(ceil((len(w) - {size}) / {step}.0) AS BIGINT) ELSE 0 END + 1)) AS i FROM w WHERE len(w) > 0)
        SELECT doc_id, i AS chunk_index, doc_id || ':' || i AS chunk_id, sha1(array_to_string(w[i * {step} + 1:i * {step} + {size}], ' ')) AS digest FROM i"""


def _digest(chunks):
    return chunks.select("doc_id", "chunk_index", "chunk_id", F.sha1("text").alias("digest"))


@query(_windows_sql(512, 448))
def chunk_words_512(spark, sf_dir):
    return _digest(chunking.word_windows(table(spark, sf_dir, "documents")))


@query(_windows_sql(200, 200))
def chunk_disjoint_200(spark, sf_dir):
    return _digest(chunking.disjoint_groups(table(spark, sf_dir, "documents")))


@query()
def paragraph_chunks(spark, sf_dir):
    return _digest(chunking.paragraph_chunks(table(spark, sf_dir, "documents")))


def _html_sql(c: str) -> str:
    out = rf"regexp_replace(regexp_replace({c}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(f"SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, sha1(t) AS digest FROM (SELECT page_id, {_html_sql('html')} AS t FROM pages)")
def html_to_text(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", tx.strip_html("html").alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha1("t").alias("digest"))


@query(f"""SELECT page_id, CASE WHEN trim(coalesce(plain, '')) <> '' THEN 'plain' WHEN t <> '' THEN 'html' END AS source,
        sha1(coalesce(nullif(trim(plain), ''), nullif(t, ''))) AS digest
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN '   ' END AS plain, {_html_sql('html')} AS t FROM pages)""")
def opinion_text_priority(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("plain", F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.lit("   ")))
    best = ingest.opinion_text({"plain": False, "html": True})
    source = F.when(tx.strip(F.coalesce("plain", F.lit(""))) != "", "plain").when(tx.strip_html("html") != "", "html")
    return pages.select("page_id", source.alias("source"), F.sha1(best).alias("digest"))


@query(r"""WITH p AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),
        e AS (SELECT source, doc_id, unnest(list_distinct([l[1], l[len(l)]])) AS line FROM p),
        t AS (SELECT source, count(DISTINCT doc_id) AS pages FROM p GROUP BY source),
        c AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM e WHERE length(line) BETWEEN 1 AND 80 GROUP BY source, line)
    SELECT source, line, n FROM c JOIN t USING (source) WHERE n >= greatest(2, CAST(floor(pages / 50) AS BIGINT) + 1)""")
def repeated_page_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "source", F.split("text", "\n").alias("lines"))
    # here a source stands for a document and each text for a page; one page in fifty is enough
    return ingest.repeated_lines(docs, doc="source", page="doc_id", lines="lines", one_in=50).select("source", "line", "n")


@query(r"""WITH p AS (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations WHERE text <> ''),
        e AS (SELECT conv_id, turn, unnest(list_distinct([l[1], l[len(l)]])) AS line FROM p),
        t AS (SELECT conv_id, count(DISTINCT turn) AS pages FROM p GROUP BY conv_id),
        c AS (SELECT conv_id, line, count(DISTINCT turn) AS n FROM e WHERE length(line) BETWEEN 1 AND 80 GROUP BY conv_id, line)
    SELECT conv_id, line, n FROM c JOIN t USING (conv_id) WHERE n >= greatest(2, CAST(floor(pages / 2) AS BIGINT) + 1)""")
def repeated_lines_half(spark, sf_dir):
    """Conversations as documents, turns as pages, words as lines: the rule of more than half of the pages."""
    talk = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", F.split("text", " ").alias("lines"))
    return ingest.repeated_lines(talk, doc="conv_id", page="turn", lines="lines")


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id, min(event_id) AS first_seen
    FROM events GROUP BY user_id""")
def upsert_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return ingest.latest(events, "user_id", "event_id")


@query("""WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS since FROM events),
        f AS (SELECT event_type, user_id, count(*) AS n FROM events, m WHERE ts >= since GROUP BY ALL),
        k AS (SELECT DISTINCT user_id FROM events, m WHERE ts < since)
    SELECT event_type, CAST(sum(n) AS BIGINT) AS fetched, count(*) FILTER (k.user_id IS NULL) AS new, count(*) FILTER (k.user_id IS NOT NULL) AS updated
    FROM f LEFT JOIN k USING (user_id) GROUP BY event_type""")
def sync_new_updated(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    span = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("since")).first()
    since = F.lit(span["since"])
    return ingest.sync_counts(events, events.where(F.col("ts") < since), key="user_id", modified="ts", since=since, by="event_type")


@query(f"""WITH w AS (SELECT doc_id, text, len({WORDS}) AS n FROM documents)
    SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS size,
        CAST(CASE WHEN n = 0 THEN 0 WHEN n > 512 THEN ceil((n - 512) / 448.0) + 1 ELSE 1 END AS BIGINT) AS chunk_count FROM w""")
def upload_listing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ingest.uploads(docs, chunking.word_windows(docs).drop("text"), key="doc_id")


@query(r"""SELECT doc_id, 'upload_' || regexp_replace(regexp_replace(lower(regexp_replace(source || ' File ' || doc_id || '.txt', '\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')
        || '_' || substr(sha1(substr(text, 1, 4000)), 1, 10) AS document_id,
        regexp_replace(source || '/a*b ' || doc_id || '..', '^.*[/\\]', '') AS base FROM documents""")
def document_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit(" File "), F.col("doc_id").cast("string"), F.lit(".txt"))
    base = F.regexp_replace(F.concat("source", F.lit("/a*b "), F.col("doc_id").cast("string"), F.lit("..")), r"^.*[/\\]", "")
    return docs.select("doc_id", tx.upload_id(name, "text").alias("document_id"), base.alias("base"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, sha1(array_to_string(s, '|')) AS digest FROM s""")
def sentence_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", tx.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.sha1(F.array_join("s", "|")).alias("digest"))


@query()
def sentence_split_guarded(spark, sf_dir):
    """With abbreviations kept whole. Word boundaries differ between the engines' patterns, so it is tested against the row form."""
    s = table(spark, sf_dir, "documents").select("doc_id", tx.guarded_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.sha1(F.array_join("s", "|")).alias("digest"))
