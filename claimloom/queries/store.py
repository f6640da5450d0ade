"""Queries on the relational store; customers stand for users, orders for conversations, lines for messages."""

from pyspark.sql import functions as F

from ..operators import store
from . import ORACLES, query, table


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations QUALIFY r <= 2)
    SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM r""")
def recent_messages(spark, sf_dir):
    return store.recent(table(spark, sf_dir, "conversations"), by="conv_id", order="turn").select("conv_id", "turn", "role", "position")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS lines FROM lineitem GROUP BY l_orderkey)
    SELECT c_custkey, o_orderkey, coalesce(n, 0) AS n_lines, coalesce(lines, '') AS lines FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN n ON l_orderkey = o_orderkey""")
def history_nested(spark, sf_dir):
    return _history(spark, sf_dir, table(spark, sf_dir, "customer"))


query(ORACLES["history_nested"], name="history_nested_all")(history_nested)


def _history(spark, sf_dir, customers):
    """Orders of the customers with their lines."""
    users = customers.select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(users, "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    nested = store.history(orders, lines, key="o_orderkey", order=["l_linenumber"], columns=["l_returnflag"], name="lines")
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"])), ",")
    return nested.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(text, F.lit("")).alias("lines"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events)
    SELECT event_id, user_id, c_name, ts + INTERVAL 24 HOUR AS expires_at, sha256(CAST(event_id AS VARCHAR)) AS token_hash FROM events JOIN customer ON c_custkey = user_id, m WHERE ts + INTERVAL 24 HOUR > now""")
def session_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("created_at"))
    now = events.agg(F.max("created_at").alias("now")).first()["now"]
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    live = store.live_sessions(events, users, now=F.lit(now))
    return live.select("event_id", "user_id", "c_name", "expires_at", F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"))


@query("""WITH n AS (SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 10000000 ELSE 0 END AS o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority || '!' END AS p, 'X' AS s FROM orders WHERE o_orderkey % 2 = 0)
    SELECT o_orderkey, CASE WHEN n.s IS NOT NULL THEN n.s ELSE o_orderstatus END AS o_orderstatus, coalesce(n.p, o_orderpriority) AS o_orderpriority FROM orders FULL JOIN n USING (o_orderkey)""")
def state_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 3 == 0, 10000000).otherwise(0)
    new = old.where("o_orderkey % 2 = 0").select(key.alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 4 != 0, F.concat("o_orderpriority", F.lit("!"))).alias("o_orderpriority"))
    return store.upsert(old, new, key="o_orderkey", keep_old=("o_orderpriority",))


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g)), d AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g))
    SELECT 'users' AS table_name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM g) UNION ALL SELECT 'conversations', count(*) FROM o
    UNION ALL SELECT 'interactions', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM d)""")
def cascade_delete(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    tables = {
        "users": users,
        "conversations": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")),
        "interactions": table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("conversation_id")),
    }
    left = store.without(tables, "users", users.where("c_acctbal < 0"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber <= 2
    UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE l_orderkey % 5 = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2)""")
def replace_artifacts(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = old.where("l_orderkey % 5 = 0 and l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 1)
    return store.replace(old, new, by="l_orderkey")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def owned_rows(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return store.owned(table(spark, sf_dir, "orders"), users, by="o_custkey", owner="c_mktsegment", user=F.lit("BUILDING")).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""SELECT event_id, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN props IS NULL THEN false ELSE json_valid(props) END AS readable FROM events""")
def state_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", store.state_json("props", "k long")["k"].alias("k"), F.coalesce(F.expr("try_parse_json(props) is not null"), F.lit(False)).alias("readable"))
