import random

from pyspark.sql import functions as F

from claimloom.operators import store
from claimloom.sources import tables, versions


def _random_store(spark, seed):
    """Tables of ids with references to existing rows (messages may have none)."""
    rng = random.Random(seed)
    ids = {t: list(range(1, rng.randint(3, 9))) for t in store.TABLES}
    out = {}
    for name, schema in store.TABLES.items():
        refs = {c: p for child, c, p, *_ in store.REFERENCES if child == name}
        rows = []
        for i in ids[name]:
            row = {f.name: None for f in schema.fields}
            row |= {c: rng.choice(ids[p]) for c, p in refs.items()}
            if "id" in row:
                row["id"] = i
            if name == "conversation_state":
                row["conversation_id"] = i if i in ids["conversations"] else ids["conversations"][0]
            if name == "messages" and rng.random() < 0.3:
                row["interaction_id"] = None
            rows.append(tuple(row[f.name] for f in schema.fields))
        out[name] = spark.createDataFrame(rows, schema)
    return out


def _plain(tables_, name, gone):
    data = {t: [r.asDict() for r in df.collect()] for t, df in tables_.items()}
    dead = {name: set(gone)}
    while True:
        size = sum(map(len, dead.values()))
        for child, column, parent, *action in store.REFERENCES:
            if not action and "id" in store.TABLES[child].fieldNames():
                dead.setdefault(child, set()).update(r["id"] for r in data[child] if r[column] in dead.get(parent, ()))
        if size == sum(map(len, dead.values())):
            break
    for t, rows in data.items():
        rows[:] = [r for r in rows if r.get("id") not in dead.get(t, ())]
        for child, column, parent, *action in store.REFERENCES:
            if child == t and action:
                for r in rows:
                    r[column] = None if r[column] in dead.get(parent, ()) else r[column]
            elif child == t:
                rows[:] = [r for r in rows if r[column] not in dead.get(parent, ())]
    return {t: sorted(map(str, rows)) for t, rows in data.items()}


def test_nothing_hangs_in_the_air_after_a_delete(spark):
    for seed, name in enumerate(["users", "interactions", "interaction_citations"]):
        given = _random_store(spark, seed)
        gone = spark.createDataFrame([(1,), (2,)], "id long")
        left = store.without(given, name, gone)
        assert {t: sorted(str(r.asDict()) for r in df.collect()) for t, df in left.items()} == _plain(given, name, [1, 2])
        assert store.violations(left).where(~F.col("rule").startswith("unique")).count() == 0


def test_a_circle_of_references_ends(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 5), (6, 9)], "id long, above long")
    left = store.without({"t": rows}, "t", spark.createDataFrame([(1,)], "id long"), [("t", "above", "t")])
    assert sorted(r.id for r in left["t"].collect()) == [5, 6]


def test_two_writers_share_no_id(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    tables.create(spark, path)
    users = lambda name, n: spark.range(n).select(F.concat(F.lit(name), F.col("id")).alias("username")).repartition(3)
    assert tables.insert(users("a", 7), path, "users") == (1, 7)
    commit, raced = versions.commit, []

    def late(*args):
        if not raced:  # another writer commits between this one's reading and its commit
            raced.append(1)
            assert tables.insert(users("b", 5), path, "users") == (8, 5)
        return commit(*args)

    monkeypatch.setattr(versions, "commit", late)
    assert tables.insert(users("c", 4), path, "users") == (13, 4)
    got = tables.read(spark, path, "users").collect()
    assert sorted(r.id for r in got) == list(range(1, 17)) and len({r.username for r in got}) == 16
    raced.clear()

    def changed(held):
        if not raced:
            raced.append(1)
            tables.insert(users("d", 2), path, "users")
        return {"users": held["users"].where("username not like 'a%'")}

    monkeypatch.setattr(versions, "commit", commit)
    tables.change(spark, path, ["users"], changed)
    assert sorted({r.username[0] for r in tables.read(spark, path, "users").collect()}) == ["b", "c", "d"]


def test_sessions_and_cascading_delete_on_disk(spark, tmp_path):
    path = str(tmp_path / "s")
    tables.create(spark, path)
    tables.insert(spark.createDataFrame([("ann",), ("bob",)], "username string").coalesce(1), path, "users")
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    tables.insert(tables.new_sessions(tables.read(spark, path, "users"), F.concat(F.lit("token-"), "id"), now), path, "sessions")
    found = tables.read(spark, path, "sessions").orderBy("user_id").collect()
    assert [r.expires_at for r in found] == ["2024-01-02 00:00:00"] * 2 and len(found[0].token_hash) == 64
    assert [r.user_id for r in tables.without_session(tables.read(spark, path, "sessions"), "token-1").collect()] == [2]
    tables.delete(spark, path, "users", spark.createDataFrame([(1,)], "id long"))
    assert [r.user_id for r in tables.read(spark, path, "sessions").collect()] == [2]
    assert tables.insert(spark.createDataFrame([("cy",)], "username string"), path, "users")[0] == 3
