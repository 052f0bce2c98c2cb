"""A dense window's rows lie in many tasks, and no plan joins those by compressed bytes."""

from pyspark.sql import functions as F

from tidewatch.operators import chain, numbering, zscore

METRICS = ("m",)


def _most(df, used):
    """Rows of the largest partition; `used` is read, so that it is computed."""
    return df.where(F.col(used).isNotNull()).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_a_dense_window_is_split_over_tasks(spark, monkeypatch):
    rows = spark.range(6000).select(F.when(F.col("id") >= 0, "k").alias("service_id"), F.col("id").alias("arrival_seq"), (F.col("id") * 37 % 5000).alias("timestamp_ms"), F.sin("id").alias("m"))
    monkeypatch.setattr(numbering, "ROWS", 500, raising=False)
    monkeypatch.setattr(zscore, "RANGE", 60, raising=False)
    out = zscore.trailing_z(rows, 10_000, 10, METRICS)
    assert _most(out.where("n > 0"), "n") < 2000
    got, want = (zscore.trailing_z(rows, w, 10, METRICS, by_prefix=p).orderBy("arrival_seq").select("n", "z_m").collect() for w, p in ((700, True), (700, False)))
    assert got == want


def test_a_long_key_of_the_chain_is_split_over_tasks(spark, monkeypatch):
    rows = spark.range(6000).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.col("id").alias("t"))
    monkeypatch.setattr(numbering, "ROWS", 500, raising=False)
    out = chain.greedy_chain(rows, "k", "o", "t", 100, most=1000, width=100, records=100)
    assert _most(out, "fired") < 2000
    assert out.where("fired").count() == 60
