"""A training-corpus pipeline of five stages over `documents`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each one's rows are written
as Parquet and read again as the next one's docs.  All but the last return documents: the
columns of docs, whatever further ones it has and whatever they are named, with their values.

Defined results: a null doc_id is kept by every stage (nothing is compared by equal ids alone);
null and empty texts are scored, are one group of near duplicates, lose nothing to repeated
passages, have no words for a mixture and so leave there; repeated rows are one group of near
duplicates; an empty table gives no row at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, mixing, packing, simhash, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, learned from the labelled rows, scores below 0.5."""
    net = toxicity.train(toxicity.training_sample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")))
    rows, names = common.guarded(docs, ("doc_id", "text"))
    return common.restored(toxicity.scored(rows, net).where("score < 0.5").drop("score"), names, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash fingerprints (op2's, by its anchors) or similar five-word
    shingles link: that of smallest doc_id (null ones last), then of smallest SHA-256 of its text,
    then the first.  So a text without a like stays, whatever its doc_id, and of repeated rows one
    stays; all wordless texts are one group."""
    guarded, names = common.guarded(docs, ("doc_id", "text"))
    rows = simhash.numbered(guarded)
    text = common.text_or_empty()
    found = simhash.linked_rows(rows.select("row", F.col("doc_id").cast("long"), text.alias("text")))
    digests = rows.select("row", F.sha2(text, 256).alias("digest"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "row")
    first = found.join(digests, "row").groupBy("top").agg(F.min(order).alias("least")).select("least.row")
    return common.restored(rows.join(first, "row", "left_semi").drop("row"), names, docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id has; emptied ones go.
    n_chars is that of the text that is left (of an unchanged null text: 0)."""
    rows, names = common.guarded(docs.drop("n_chars"), ("doc_id", "text"))
    kept = substrings.deduplicated(rows).where("n_removed = 0 or n_removed < n_words")
    kept = kept.drop("n_words", "n_removed", "kept_sha256").withColumn("n_chars", F.char_length("text").cast("long"))
    return common.restored(kept, names, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, to whole documents: a document whose
    words are taken r times appears floor(r) times, and once more by the rest's chance."""
    return mixing.resampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents as pieces of sequences in curve order, with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A learned network and tokenizer ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
