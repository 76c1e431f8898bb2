import pytest
from pyspark.sql import functions as F
from texts import ODD, frame

from annealix.llm import shards
from annealix.llm.common import scratch


def rows(df):
    return sorted(map(repr, df.collect()))


def make(spark, **sizes):
    return shards.ShardStore(spark, scratch(spark, "store"), **({"target_bytes": 60_000, "smallest_bytes": 1000, "fanout": 3} | sizes))


def test_rows_survive_and_files_grow(spark):
    df = frame(spark, [*ODD, *[f"text {i} " * (i % 50) for i in range(3000)]], None).repartition(8)
    df = df.withColumn("_metadata", F.lit("own")).withColumn("path", F.lit(None).cast("string"))
    store = make(spark)
    assert store.version() == 0 and store.compact() == []
    for n in range(4):
        assert store.append(df.where(F.col("doc_id") % 4 == n)) == store.version()
    before = store.manifest().collect()
    made = store.compact()
    after = store.manifest().collect()
    assert made and len(after) < len(before)
    assert sum(r.rows for r in after) == df.count()
    assert all(r.bytes < 60_000 * 2.5 for r in after)
    tiers = [r.tier for r in after if r.bytes < 60_000 * 0.75]
    assert all(tiers.count(t) < 3 for t in tiers)
    assert rows(store.read().select(df.columns)) == rows(df)
    assert rows(store.read(made[0] - 1).select(df.columns)) == rows(df)
    store.vacuum()
    assert rows(store.read().select(df.columns)) == rows(df)


def test_commits_are_atomic(spark):
    store = make(spark)
    store.append(frame(spark, ["a"]))
    base = store.version()
    store.append(frame(spark, ["b"]))
    with pytest.raises(shards.Conflict):
        store._commit(base, store.manifest(base))
    assert store.version() == base + 1
    assert sorted(r.text for r in store.read().collect()) == ["a", "b"]
    # A crash before the move leaves no version.
    frame(spark, ["c"]).write.parquet(f"{store.root}/data/lost")
    assert sorted(r.text for r in store.read().collect()) == ["a", "b"]
    store.vacuum(grace_seconds=0)
    assert sorted(r.text for r in store.read().collect()) == ["a", "b"]
    assert not store._fs().exists(store._path("data", "lost"))


def test_vacuum_spares_a_writer_between_write_and_commit(spark):
    store, other = make(spark), None
    for t in "abc":
        store.append(frame(spark, [t]))
    other = shards.ShardStore(spark, store.root, target_bytes=60_000, smallest_bytes=1000, fanout=3)
    frame(spark, ["late"]).write.parquet(f"{store.root}/data/late")
    assert store.compact()
    store.vacuum()
    base = other.version()
    other._commit(base, other.manifest(base).unionByName(other._listed("late", base + 1)), "late")
    assert sorted(r.text for r in store.read().collect()) == ["a", "b", "c", "late"]
    with pytest.raises(FileNotFoundError):
        store._commit(base + 1, store.manifest(), "gone")


def test_writers_that_conflict_try_again(spark, monkeypatch):
    store, other = make(spark), make(spark)
    other.root = store.root
    plain, calls = store._commit, []

    def late(base, live, folder=None):
        if not calls:
            calls.append(other.append(frame(spark, ["first"])))
        return plain(base, live, folder)

    monkeypatch.setattr(store, "_commit", late)
    assert store.append(frame(spark, ["second"])) == 2
    assert sorted(r.text for r in store.read().collect()) == ["first", "second"]


def test_empty(spark):
    store = make(spark)
    df = frame(spark, ["a"])
    assert store.append(df.limit(0)) == 1
    assert store.read(schema=df.schema).count() == 0
    assert store.append(df) == 2
    assert store.read().count() == 1
