"""Micro-batches into a JDBC table, each exactly once.

Executors write a micro-batch into a staging table of its own, in parallel and as often as they
must.  Then one transaction on the driver's connection moves the staged rows into the target and
puts (query, batch) into a log of commits; a batch that the log has is not moved again.  So a
batch that is run again, at whatever point it was cut off, leaves its rows once, and readers see
all of it or nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOG = "tidewatch_commits"


def _name(text: str) -> str:
    """A plain SQL identifier, with its schema if given."""
    if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", text):
        raise ValueError(f"not a plain table or column name: {text!r}")
    return text


@contextmanager
def _connection(spark: SparkSession, url: str, options: dict[str, str]) -> Iterator:
    """A JDBC connection without automatic commits; what is not committed is rolled back."""
    jvm = spark._jvm
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    given = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            given.setProperty(k, options[k])
    found = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        found.setAutoCommit(False)
        yield found
    finally:
        found.rollback()
        found.close()


def _run(connection, sql: str, *values: str | int) -> bool:
    """Execute a statement; of a query, whether it has a row."""
    statement = connection.prepareStatement(sql)
    try:
        for k, v in enumerate(values, 1):
            statement.setLong(k, v) if isinstance(v, int) else statement.setString(k, v)
        return statement.executeQuery().next() if sql.startswith("SELECT") else bool(statement.executeUpdate()) or True
    finally:
        statement.close()


def _exists(connection, table: str) -> bool:
    schema, _, name = table.rpartition(".")
    places = connection.getMetaData().getTables(None, None, None, None)
    try:
        while places.next():
            if places.getString("TABLE_NAME").lower() == name.lower() and (not schema or (places.getString("TABLE_SCHEM") or "").lower() == schema.lower()):
                return True
        return False
    finally:
        places.close()


def jdbc_transactions(url: str, target: str, query: str, keys: tuple[str, ...] = (), **options: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function.  `query` names the stream in the log.  With `keys`, rows of the
    target that have a staged row's keys are replaced by it (keys should be unique in a batch);
    without, rows are added.  `options` are the JDBC writer's (driver, user, password,
    createTableColumnTypes, ...).  The target is made as the first batch's staging table is."""
    target, keys = _name(target), tuple(map(_name, keys))
    staging = f"{target}_stage_{re.sub(r'\W', '_', query)}"

    def write(df: DataFrame, batch_id: int) -> None:
        spark, names = df.sparkSession, [_name(n) for n in df.columns]
        with _connection(spark, url, options) as c:
            if not _exists(c, LOG):
                _run(c, f"CREATE TABLE {LOG} (query VARCHAR(200) NOT NULL, batch_id BIGINT NOT NULL, PRIMARY KEY (query, batch_id))")
                c.commit()
            if _run(c, f"SELECT batch_id FROM {LOG} WHERE query = ? AND batch_id = ?", query, batch_id):
                return
        df.write.format("jdbc").options(**({"batchsize": "1000"} | options | {"url": url, "dbtable": staging})).mode("overwrite").save()
        with _connection(spark, url, options) as c:
            if not _exists(c, target):
                df.limit(0).write.format("jdbc").options(**(options | {"url": url, "dbtable": target})).mode("ignore").save()
            mark = c.getMetaData().getIdentifierQuoteString()  # Spark's writer quotes column names
            columns = ", ".join(f"{mark}{n}{mark}" for n in names)
            if keys:
                same = " AND ".join(f"{staging}.{mark}{k}{mark} = {target}.{mark}{k}{mark}" for k in keys)
                _run(c, f"DELETE FROM {target} WHERE EXISTS (SELECT 1 FROM {staging} WHERE {same})")
            _run(c, f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {staging}")
            _run(c, f"INSERT INTO {LOG} (query, batch_id) VALUES (?, ?)", query, batch_id)
            c.commit()
            _run(c, f"DROP TABLE {staging}")
            c.commit()

    return write
