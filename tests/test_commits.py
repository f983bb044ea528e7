import os

import pytest
from pyspark.sql import functions as F

from quern.operators import recall, scope
from quern.sources.commits import ConflictError, Versions


def rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_version_has_all_tables_or_none(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    assert store.latest() == 0 and store.table("a") is None
    with store.begin() as change:
        change.append("a", rows(spark, 1))
        change.append("b", rows(spark, 2))
    assert store.latest() == 1 and ids(store.table("a")) == [1] and ids(store.table("b")) == [2]
    with pytest.raises(ZeroDivisionError), store.begin() as change:
        change.append("a", rows(spark, 9))
        change.append("b", rows(spark, 9).select((F.col("id") / 1).cast("long").alias("id")))
        raise ZeroDivisionError
    assert store.latest() == 1 and ids(store.table("a")) == [1]
    assert len(os.listdir(tmp_path / "s" / "a")) == 1  # what was staged is gone
    with store.begin() as change:
        change.append("a", rows(spark, 3))
        change.replace("b", rows(spark))
    assert ids(store.table("a")) == [1, 3] and ids(store.table("b")) == [] and ids(store.table("b", 1)) == [2] and ids(store.table("a", 1)) == [1]
    with store.begin():
        pass
    assert store.latest() == 2


def test_two_changes_at_once(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    one, two, three = store.begin(), store.begin(), store.begin()
    one.append("a", rows(spark, 1))
    two.append("a", rows(spark, 2))
    three.append("c", rows(spark, 3))
    assert one.commit() == 1
    with pytest.raises(ConflictError):
        two.commit()
    assert three.commit() == 2  # another table: taken along
    assert ids(store.table("a")) == [1] and ids(store.table("c")) == [3] and os.listdir(tmp_path / "s" / "a") == [one.id]
    reader, writer = store.begin(), store.begin()
    assert ids(reader.read("a")) == [1]
    writer.append("a", rows(spark, 5))
    writer.commit()
    reader.append("d", rows(spark, 6))
    with pytest.raises(ConflictError):
        reader.commit()
    assert not store._publish(3, {"version": 3, "tables": {}})  # the name is taken
    with pytest.raises(ValueError, match="schema"), store.begin() as change:
        change.append("a", rows(spark, 1).withColumn("more", F.lit(1)))


def scene(spark):
    docs = spark.createDataFrame([(k, f"alpha {'beta' if k % 2 else 'gamma'} word{k}", "x" if k % 5 else "y") for k in range(40)], "fragment_id long, text string, source_id string")
    members = docs.select("fragment_id", "source_id", F.lit("c").alias("collection_id"), F.lit("active").alias("state"))
    compiled = scope.compile_access(members, spark.createDataFrame([("c", "allow")], "collection_id string, effect string"), spark.createDataFrame([("y", "deny")], "source_id string, effect string"), ["c"])
    return docs, compiled


class Leaks:
    """A backend that answers with a fragment that it was not given."""

    def search(self, fragments, questions):
        return questions.select("query_id", F.lit(1).cast("long").alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(1.0).alias("score"))


def test_a_batch_is_stored_whole_or_not_at_all(spark, tmp_path):
    docs, compiled = scene(spark)
    ask = lambda *q: spark.createDataFrame(list(q), "query_id long, question string")
    store = Versions(spark, str(tmp_path / "s"))
    for bad, match in ((ask((1, "beta"), (2, " ")), "blank"), (ask((1, "beta"), (1, "gamma")), "repeated"), (ask((None, "beta")), "null_id"), (ask((1, "b" * 5000)), "too_long")):
        with pytest.raises(ValueError, match=match):
            recall.recall_batch(store, docs, compiled, bad, recall.Bm25())
    with pytest.raises(Exception, match="outside of the scope"):
        recall.recall_batch(store, docs, compiled, ask((1, "beta")), Leaks())
    assert store.latest() == 0 and store.table("requests") is None
    assert recall.recall_batch(store, docs, compiled, ask((1, "beta"), (2, "word7 gamma")), recall.Bm25(3)) == 1
    first = {r.request_id: r.packet_hash for r in store.table("packets").collect()}
    assert recall.recall_batch(store, docs, compiled, ask((2, "word7 gamma"), (3, "word11")), recall.Bm25(9)) == 2  # what is stored is not run again
    held = {r.request_id: r.packet_hash for r in store.table("packets").collect()}
    assert len(held) == 3 and first.items() <= held.items() and store.table("read_sets").count() == 1
    assert {r.read for r in store.table("receipts").collect()} == {32} and store.table("receipts").filter("policy_omission_present").count() == 3
    assert recall.replayed(store).count() == 0 and recall.replayed(store, 1).count() == 0
    assert recall.recall_batch(store, docs, compiled, ask((3, "word11")), recall.Bm25()) == 2  # nothing new, no version
    with store.begin() as change:
        change.replace("items", change.read("items").withColumn("score", F.when(F.col("query_id") == 3, 0.5).otherwise(F.col("score"))))
    assert [r.state for r in recall.replayed(store).collect()] == ["changed"] and recall.replayed(store, 2).count() == 0


def test_batches_over_one_scope_cut_its_texts_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"alpha word{k % 5} {'beta ' * (k % 3)}") for k in range(40)], "fragment_id int, text string")
    members = docs.select("fragment_id", F.lit("s").alias("source_id"), F.lit("all").alias("collection_id"), F.lit("active").alias("state"))
    compiled = scope.compile_access(members, spark.sql("SELECT 'all' AS collection_id, 'allow' AS effect"), spark.sql("SELECT 'x' AS source_id, 'deny' AS effect"), ["all"]).checkpoint()
    ask = lambda *n: spark.createDataFrame([(k, f"word{k} beta") for k in n], "query_id int, question string")
    found = {}
    for name, backend in (("plain", recall.Bm25()), ("kept", recall.Bm25(folder=str(tmp_path / "cut")))):
        store = Versions(spark, str(tmp_path / name))
        for batch in ((0, 2), (0, 1, 2, 3)):
            recall.recall_batch(store, docs, compiled, ask(*batch), backend)
        found[name] = sorted(map(tuple, store.table("packets").collect()))
    assert found["plain"] == found["kept"] and len(found["kept"]) == 4
    assert len(list((tmp_path / "cut").iterdir())) == 1
    other = recall.Bm25(folder=str(tmp_path / "other"))
    assert other.index(docs) is other.index(docs) and other.index(docs) is not other.index(docs.filter("fragment_id > 3"))
