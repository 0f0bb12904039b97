import threading

import pytest
from pyspark.sql import functions as F

from attesta.operators import publication
from attesta.sources.commits import CommitLog, Refused

ROWS = "id long, text string"


def tables(spark, *rows, more=()):
    return {"facts": (spark.createDataFrame(list(rows), ROWS), "id"), "changes": (spark.createDataFrame(list(more), ROWS), "id")}


def read(spark, path, name):
    schema = spark.createDataFrame([], ROWS).schema
    return sorted(map(tuple, publication.read_published(spark, path, name, schema).collect()))


def test_publication_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert publication.publish(spark, path, tables(spark, (1, "a"), more=[(7, "x")]))
    assert publication.publish(spark, path, tables(spark, (1, "a"), (2, "b"))) and publication.publish(spark, path, tables(spark, (2, "b"))) is None
    assert read(spark, path, "facts") == [(1, "a"), (2, "b")] and read(spark, path, "changes") == [(7, "x")]
    with pytest.raises(ValueError, match="facts: a stored id"):
        publication.publish(spark, path, tables(spark, (1, "other"), (3, "c"), more=[(8, "y")]))
    with pytest.raises(ValueError, match="stands twice"):
        publication.publish(spark, path, tables(spark, (4, "d"), (4, "d")))
    spark.createDataFrame([(9, "lost")], ROWS).write.parquet(f"{path}/facts/publication=half")
    assert read(spark, path, "facts") == [(1, "a"), (2, "b")] and read(spark, path, "changes") == [(7, "x")]


def test_second_writer_is_rebased_or_refused(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    first, second, third, fourth = (log.begin() for _ in range(4))
    first.stage(tables(spark, (1, "a"), (2, "b"), more=[(7, "x")]))
    second.stage(tables(spark, (2, "b"), (3, "c"), more=[(8, "y")]))
    third.stage(tables(spark, (2, "other"), (4, "d")))
    fourth.stage(tables(spark, (1, "a")))
    assert first.commit() == 1 and second.commit() == 2
    with pytest.raises(Refused, match="facts: a stored id"):
        third.commit()
    assert fourth.commit() is None and log.latest() == 2
    at = lambda version=None: sorted(map(tuple, log.read("facts", spark.createDataFrame([], ROWS).schema, version).collect()))
    assert at() == [(1, "a"), (2, "b"), (3, "c")] and at(1) == [(1, "a"), (2, "b")] and at(0) == []
    assert read(spark, log.path, "changes") == [(7, "x"), (8, "y")]


def test_only_one_writer_gets_a_number(spark, tmp_path):
    log, won = CommitLog(spark, str(tmp_path / "log")), []
    spark.range(1).write.parquet(f"{log.path}/_log/x")
    ready = threading.Barrier(6)

    def write(k):
        ready.wait()
        won.append(log._claim({"version": 1, "publication": str(k), "tables": []}))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 5 + [True] and [e["version"] for e in log.entries()] == [1]


def test_writers_at_once(spark, tmp_path):
    path, done = str(tmp_path / "log"), []

    def write(k):
        done.append(publication.publish(spark, path, tables(spark, *[(i, "same") for i in range(k, k + 3)], more=[(100 + k, "own")])))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done) == [1, 2, 3, 4] and read(spark, path, "facts") == [(i, "same") for i in range(6)] and len(read(spark, path, "changes")) == 4


def test_composite_keys_and_nulls(spark, tmp_path):
    rows = lambda *r: {"t": (spark.createDataFrame(list(r), "run string, org string, payload string"), ["run", "org"])}
    path = str(tmp_path / "log")
    assert publication.publish(spark, path, rows(("r", None, None), ("r", "1", "x"))) == 1
    assert publication.publish(spark, path, rows(("r", None, None))) is None
    with pytest.raises(Refused):
        publication.publish(spark, path, rows(("r", None, "y")))


def test_assertions(spark):
    rows = spark.createDataFrame([('"100"', "financials", "NOK"), ('"100.0"', "financials", "NOK"), ('"100"', "financials", "EUR"), ("1", "identity", None), ("1.0", "identity", None), ("false", "identity", None), (None, "identity", None)], "value string, category string, currency string")
    rows = rows.withColumns({k: F.lit(None).cast("string") for k in ("unit", "valid_from", "valid_to")})
    a = [r[0] for r in rows.select(publication.assertion()).collect()]
    assert a[0] == a[1] and len(set(a)) == 6
