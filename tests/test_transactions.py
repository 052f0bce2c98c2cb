"""The transactional JDBC sink against the embedded database that comes with Spark."""

import pytest

from tidewatch.sinks import transactions

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
TYPES = {"driver": DRIVER, "createTableColumnTypes": "service_id VARCHAR(50), note VARCHAR(50)"}


@pytest.fixture
def url(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true"


def table(spark, url, name):
    return sorted(map(tuple, spark.read.format("jdbc").options(url=url, dbtable=name, driver=DRIVER).load().collect()), key=str)


def rows(spark, *given):
    return spark.createDataFrame(given, "service_id string, value double, note string").repartition(3)


def test_batches_stand_once_whatever_is_run_again(spark, url, monkeypatch):
    a, b = rows(spark, ("x", 1.0, "p"), ("y", None, "n")), rows(spark, ("x", 1.0, "p"))
    one = transactions.jdbc_transactions(url, "metrics", "one", **TYPES)
    other = transactions.jdbc_transactions(url, "metrics", "other", **TYPES)
    one(a, 0)
    one(a, 0)
    other(b, 0)
    assert table(spark, url, "metrics") == [("x", 1.0, "p"), ("x", 1.0, "p"), ("y", None, "n")]
    assert table(spark, url, transactions.LOG) == [("one", 0), ("other", 0)]

    real = transactions._run

    def cut(connection, sql, *values):
        if sql.startswith(f"INSERT INTO {transactions.LOG}"):
            raise InterruptedError
        return real(connection, sql, *values)

    monkeypatch.setattr(transactions, "_run", cut)
    with pytest.raises(InterruptedError):
        one(b, 1)  # rows are moved, the log is not written: nothing of it stays
    assert len(table(spark, url, "metrics")) == 3
    monkeypatch.setattr(transactions, "_run", real)
    one(b, 1)
    one(b, 1)
    assert len(table(spark, url, "metrics")) == 4 and table(spark, url, transactions.LOG) == [("one", 0), ("one", 1), ("other", 0)]


def test_keys_replace_rows(spark, url):
    write = transactions.jdbc_transactions(url, "latest", "q", keys=("service_id",), **TYPES)
    write(rows(spark, ("x", 1.0, "a"), ("y", 2.0, "a")), 0)
    write(rows(spark, ("x", 3.0, "b"), ("z", 4.0, "b")), 1)
    write(rows(spark), 2)
    assert table(spark, url, "latest") == [("x", 3.0, "b"), ("y", 2.0, "a"), ("z", 4.0, "b")]


def test_names_are_plain(url):
    with pytest.raises(ValueError):
        transactions.jdbc_transactions(url, "t; drop table x", "q")
