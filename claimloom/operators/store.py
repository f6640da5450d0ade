"""The relational store: merges, replacements, cascades and owned views.

Tables are DataFrames over Parquet folders; every change returns the new table,
which the caller writes (by partition where it replaces an interaction's rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..storage import written


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n.rstrip("#"), T.LongType() if n.endswith("#") else T.DoubleType() if n in ("score", "confidence") else T.StringType()) for n in text.split()])


# Tables and columns; # marks long ones.
TABLES = {
    "users": _schema("id# email username password_hash created_at"),
    "sessions": _schema("id# user_id# token_hash created_at expires_at"),
    "conversations": _schema("id# user_id# title created_at updated_at"),
    "conversation_state": _schema("conversation_id# summary state_json last_updated_at"),
    "interactions": _schema("id# conversation_id# query response created_at"),
    "messages": _schema("id# conversation_id# interaction_id# role content created_at metadata_json"),
    "verified_claims": _schema("id# interaction_id# claim_text verdict confidence source_citation created_at claim_id claim_type claim_source certainty doc_section span_json metadata_json"),
    "contradictions": _schema("id# interaction_id# chunk_i_id chunk_j_id score created_at metadata_json"),
    "interaction_citations": _schema("id# interaction_id# doc_id chunk_id source_label score used_in_prompt# created_at metadata_json"),
    "claim_citation_links": _schema("id# verified_claim_id# interaction_citation_id# relationship score created_at metadata_json"),
}
#: Which rows go with a deleted row: child table -> (column, parent table).
CASCADE = {
    "sessions": ("user_id", "users"),
    "conversations": ("user_id", "users"),
    "conversation_state": ("conversation_id", "conversations"),
    "interactions": ("conversation_id", "conversations"),
    "messages": ("conversation_id", "conversations"),
    "verified_claims": ("interaction_id", "interactions"),
    "contradictions": ("interaction_id", "interactions"),
    "interaction_citations": ("interaction_id", "interactions"),
    "claim_citation_links": ("verified_claim_id", "verified_claims"),
}

#: Columns that are unique together where none of them is null.
UNIQUE = {
    **{t: [("id",)] for t in TABLES},
    "users": [("id",), ("username",), ("email",)],
    "sessions": [("id",), ("token_hash",)],
    "conversation_state": [("conversation_id",)],
    "verified_claims": [("id",), ("interaction_id", "claim_id")],
    "interaction_citations": [("id",), ("interaction_id", "chunk_id")],
    "claim_citation_links": [("id",), ("verified_claim_id", "interaction_citation_id", "relationship")],
}
#: Columns that hold the id of a row of another table, or null: (child table, column, parent table),
#: and ``null`` where a deleted parent leaves a null and not a deleted child.
REFERENCES = [
    *[(child, column, parent) for child, (column, parent) in CASCADE.items()],
    ("messages", "interaction_id", "interactions", "null"),
    ("claim_citation_links", "interaction_citation_id", "interaction_citations"),
]


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, key, n): repeated unique keys and references to no row, over the tables that are given."""
    parts = []
    for name, df in tables.items():
        for columns in UNIQUE[name]:
            counted = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
            parts.append(counted.select(F.lit(name).alias("table_name"), F.lit(f"unique {', '.join(columns)}").alias("rule"), F.to_json(F.struct(*columns)).alias("key"), "n"))
    for child, column, parent, *_ in REFERENCES:
        if child in tables and parent in tables:
            counted = tables[child].dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("n"))
            lost = counted.join(tables[parent].select(F.col("id").alias(column)), column, "left_anti")
            parts.append(lost.select(F.lit(child).alias("table_name"), F.lit(f"{column} in {parent}").alias("rule"), F.to_json(F.struct(column)).alias("key"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def citation_links(claim_rows: DataFrame, citation_rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows of claim_citation_links, without id and time, that replace those of the claims.

    The n-th stored claim of an interaction (by id) goes with the n-th of
    ``claims`` (interaction_id, position, claim_id, verdict and, as chunk ids
    and scores, best_supporting_chunk, best_chunk, best_supporting_score,
    final_score, best_contradicting_chunk, best_contradiction_score). Of
    citations with the same chunk the last row counts; chunks that are not
    cited give no link.
    """
    place = lambda order: F.row_number().over(W.partitionBy("interaction_id").orderBy(order))
    stored = claim_rows.select("interaction_id", F.col("id").alias("verified_claim_id"), place("id").alias("n"))
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    links = F.array(
        F.struct(F.lit("supporting").alias("relationship"), F.coalesce(filled("best_supporting_chunk"), filled("best_chunk")).alias("chunk_id"), F.coalesce("best_supporting_score", "final_score").cast("double").alias("score")),
        F.struct(F.lit("contradicting").alias("relationship"), filled("best_contradicting_chunk").alias("chunk_id"), F.col("best_contradiction_score").cast("double").alias("score")),
    )
    said = claims.withColumn("n", place("position")).select("interaction_id", "n", "claim_id", "verdict", F.inline(links))
    cited = citation_rows.where(filled("chunk_id").isNotNull()).groupBy("interaction_id", F.col("chunk_id").cast("string").alias("chunk_id")).agg(F.max("id").alias("interaction_citation_id"))
    rows = said.join(stored, ["interaction_id", "n"]).join(cited, ["interaction_id", "chunk_id"])
    about = F.to_json(F.struct("claim_id", "chunk_id", "relationship", "verdict"), {"ignoreNullFields": "false"})
    return rows.select("verified_claim_id", "interaction_citation_id", "relationship", "score", about.alias("metadata_json"))


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order; missing ones (older data) are null, others go."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]])


def upsert(old: DataFrame, new: DataFrame, *, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those with their key; nulls of ``keep_old`` columns keep the old value."""
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.withColumn("new_", F.lit(True)).alias("n")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in keep_old else F.when(F.col("n.new_"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, key, "full_outer").select(key, *[pick(c).alias(c) for c in columns])


def replace(old: DataFrame, new: DataFrame, *, by: str) -> DataFrame:
    """All rows of the groups in ``new`` are replaced by it."""
    return old.join(new.select(by).distinct(), by, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def _closure(tables: dict[str, DataFrame], table: str, gone: DataFrame, references: list) -> dict[str, DataFrame]:
    """(id) of the rows of each table that go with rows of one: all that cascade from them, through any parent.

    Tables are taken after all of their parents; only those that hang on
    themselves, by a circle of references, are gone through again until no row
    is added.
    """
    doomed = {table: gone.select(F.col("id").cast("long").alias("id")).distinct()}
    links = [(c, x, p) for c, x, p, *action in references if action != ["null"] and c in tables and "id" in tables[c].columns]

    def grown(child: str) -> DataFrame | None:
        parts = [doomed[child]] if child in doomed else []
        parts += [tables[c].join(doomed[p].select(F.col("id").alias(x)), x, "left_semi").select("id") for c, x, p in links if c == child and p in doomed]
        whole = parts[0] if parts else None
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.distinct() if parts else None

    def above(child: str, seen: frozenset = frozenset()) -> set[str]:
        own = {p for c, _, p in links if c == child} - seen
        return own.union(*(above(p, seen | own) for p in own)) if own else own

    parents = {c: above(c) for c, _, _ in links}
    circle = [t for t in parents if t in parents[t]]
    for child in sorted(parents, key=lambda t: (len(parents[t]), t)):
        if child not in circle and not parents[child] & set(circle) and (more := grown(child)) is not None:
            doomed[child] = more
    while circle:
        size = {t: doomed[t].count() if t in doomed else 0 for t in circle}
        for t in circle:
            if (more := grown(t)) is not None:
                doomed[t] = written(more, "doomed")
        if all((doomed[t].count() if t in doomed else 0) == size[t] for t in circle):
            break
    for child in sorted(parents, key=lambda t: (len(parents[t]), t)):
        if child not in circle and parents[child] & set(circle) and (more := grown(child)) is not None:
            doomed[child] = more
    return doomed


def without(tables: dict[str, DataFrame], table: str, gone: DataFrame, references: list | None = None) -> dict[str, DataFrame]:
    """The tables after rows (by id) of one are deleted, with all that hangs on them.

    Rows that refer to a deleted row go too, through any of their references,
    or lose the reference where its action is ``null``.
    """
    references = REFERENCES if references is None else references
    doomed = _closure(tables, table, gone, references)
    out = dict(tables)
    for name in tables:
        rows, columns = tables[name], tables[name].columns
        if name in doomed:
            rows = rows.join(doomed[name], "id", "left_anti")
        for child, column, parent, *action in references:
            if child != name or parent not in doomed or parent not in tables:
                continue
            parents = doomed[parent].select(F.col("id").alias(column))
            if action == ["null"]:
                kind = tables[name].schema[column].dataType
                rows = rows.join(parents.withColumn("lost_", F.lit(True)), column, "left").withColumn(column, F.when(F.col("lost_"), F.lit(None).cast(kind)).otherwise(F.col(column))).drop("lost_")
            elif "id" not in columns:
                rows = rows.join(parents, column, "left_anti")
        out[name] = rows.select(*columns)
    return out


def owned(rows: DataFrame, parents: DataFrame, *, by: str, owner: str, user: Column) -> DataFrame:
    """Rows whose parent (by id) belongs to the user."""
    mine = parents.where(F.col(owner) == user).select(F.col("id").alias(by))
    return rows.join(mine, by, "left_semi")


def recent(messages: DataFrame, *, by: str, order: str, limit: int = config.CONTEXT_MESSAGES) -> DataFrame:
    """The last messages of each conversation, oldest first by ``position``."""
    w = W.partitionBy(by)
    last = messages.withColumn("r", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("r") <= limit)
    return last.withColumn("position", F.row_number().over(w.orderBy(order)).cast("long")).drop("r")


def live_sessions(sessions: DataFrame, users: DataFrame, *, now: Column, created: str = "created_at", hours: int = config.SESSION_HOURS) -> DataFrame:
    """Sessions that have not expired, with their user."""
    expires = F.col(created) + F.expr(f"interval {hours} hours")
    return sessions.withColumn("expires_at", expires).where(F.col("expires_at") > now).join(users, "user_id")


def history(parents: DataFrame, children: DataFrame, *, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array."""
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias(name))
    return parents.join(nested, key, "left")


def state_json(column: str, schema: str) -> Column:
    """A JSON column; what can't be read is empty."""
    return F.coalesce(F.from_json(column, schema), F.from_json(F.lit("{}"), schema))
