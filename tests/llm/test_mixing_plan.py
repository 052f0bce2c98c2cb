"""The mixture's blocks and slots never go through the driver, however small the planner takes them for."""

from pyspark.sql import functions as F

from tidewatch.llm import mixing


def test_slots_and_pieces_are_not_broadcast(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), i))).alias("text"))
    documents, pieces, slots = mixing.mixture(docs)
    run = mixing.shard_pieces(pieces, slots)._jdf.queryExecution()
    assert run.toRdd().count() > 700
    plan = run.executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.split("\n") if "Join [source_no" in line]
    assert any("block_no" in line for line in joins) and all("SortMergeJoin" in line for line in joins), joins
