"""Mixing sources to target weights.

The words of every source form one stream (documents in doc_id order), packed into blocks of
`block` words; only a source's last block may be short.  A mixture is a number of slots, each
of which takes one block of one source: a source's slots are as many as its target's words
fill, and its last slot takes the words that are left, so a source gives the whole part of its
target exactly.  Output shards get multinomial counts of each source's slots.  Slot q of a
source takes the block that a pseudorandom permutation of the source's full blocks (one for
each epoch, the short block last) gives for q, and slots are joined with blocks by that index:
the draw decides which shard has a block, and the slots of a shard stand in hashed order.  What
a document gives to the mixture is counted in these shards.

Defined results: null text has size 0; a null source is a source of its own, ordered last
and shown as null; documents of size 0 are never taken; repeated rows are mixed each, and
appear each; an empty table gives no row; other columns, whatever their names, are kept where
documents are returned (`resampled`).  Reruns give the same mixture: order is by source,
doc_id and a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import guarded, named, running_offsets, stage, table

CYCLE = (5.0, 2.0, 1.0)
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(col: str = "text") -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    joined = F.trim(F.regexp_replace(F.coalesce(F.col(col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(joined == "", F.lit(0)).otherwise(F.length(joined) - F.length(F.translate(joined, " ", "")) + 1).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source_no, source_key, source_size, weight, target) from (source_key, source_size).

    Sources in order of source_key weigh `cycle`, repeating.  Targets share `total` times all
    words by weight, at most `most` times a source's words; what is above goes to the others
    by weight until none is above: min(most * size, level * weight) for one level.  The level
    rises in rounds of one sum over the sources each, so any number of sources is distributed."""
    placed = running_offsets(sizes.withColumn("one", F.lit(1)), ["source_key"], "one", label="mix-places").withColumnRenamed("before", "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("source_no") % len(cycle) + 1).cast("int"))
    rows = stage(placed.drop("one").withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")), "mix-weights")
    level, held = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        at = rows.agg(F.sum("source_size").alias("words"), F.count_if(over).alias("over"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        if at["over"] == held or not at["weights"]:
            break
        held, level = at["over"], (float(total) * at["words"] - (at["caps"] or 0.0)) / at["weights"]
    return rows.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def dealt_slots(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, source_no, first, n): each source's `quota` slots, dealt to shards by a multinomial
    draw of its own; those of a shard follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, quota in zip(b.column("source_no").to_pylist(), b.column("quota").to_pylist()):
                rng = np.random.default_rng([seed, no])
                if quota < shards:
                    shard, n = np.unique(rng.integers(shards, size=quota), return_counts=True)
                else:
                    n = rng.multinomial(quota, np.full(shards, 1 / shards))
                    shard = np.flatnonzero(n)
                    n = n[shard]
                first = np.cumsum(n) - n
                for lo in range(0, len(n), 10_000):
                    part = slice(lo, lo + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(shard[part].astype(np.int64)), pa.array(np.full(len(n[part]), no, np.int64)), pa.array(first[part].astype(np.int64)), pa.array(n[part].astype(np.int64))], names=["shard", "source_no", "first", "n"])

    return quotas.select("source_no", "quota").where("quota > 0").mapInArrow(run, "shard long, source_no long, first long, n long")


def _mixed(x: Column, k: int, *salts: Column) -> Column:
    return F.xxhash64(x, F.lit(k), *salts)


def permuted(df: DataFrame, q: Column, n: Column, salts: list[Column], out: str) -> DataFrame:
    """df with `out`: a pseudorandom permutation of 0 .. n-1 at q, for each salt.

    Three Feistel-like rounds of modular additions on the digits (q div r, q mod r), r the root
    of n rounded up, permute 0 .. r*r-1; values from n on walk on until they fall below n.
    Rounds are columns of their own, so none is computed more than once."""

    def turn(x: Column, k: int) -> Column:
        root = F.col("_root")
        lo = x % root
        return lo * root + F.pmod(F.floor(x / root).cast("long") + F.pmod(_mixed(lo, k, *salts), root), root)

    df = df.withColumn("_root", F.ceil(F.sqrt(n)).cast("long")).withColumn("_x0", turn(q, 0))
    df = df.withColumn("_x1", turn(F.col("_x0"), 1)).withColumn("_x2", turn(F.col("_x1"), 2))
    # r*r - n < 2r: few values leave, and those walk on; all but the smallest n need few steps.
    again = lambda x: F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), x, lambda y, k: (y % F.col("_root")) * F.col("_root") + F.pmod(F.floor(y / F.col("_root")).cast("long") + F.pmod(F.xxhash64(y % F.col("_root"), k, *salts), F.col("_root")), F.col("_root")))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.col("_x2"), lambda x, _: F.when(x >= n, again(x)).otherwise(x))
    return df.withColumn(out, F.when(F.col("_x2") < n, F.col("_x2")).otherwise(walked)).drop("_root", "_x0", "_x1", "_x2")


def mixture(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, total: float = 1.5, most: float = 2.0, block: int = 128, shard_slots: int = 1 << 16, least_shards: int = 8, seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots), staged in part.

    documents: row, doc_id, source, size, tie (the text's hash), source_no, source_size, target.
    pieces: row, source_no, block_no, start, words, at - a document's words start ..
    start+words are the words from `at` on of that block.  slots: shard, source_no, slot,
    block_no, words - what the mixture takes: the whole block (null) or its first `words`.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", key.alias("source_key"), word_count().alias("size"), F.xxhash64("text").alias("tie"))
    base = stage(base, "mix-docs")
    sizes = base.groupBy("source_key").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes, cycle, total, most)
    # A round of all blocks is an epoch; after the whole ones, `rest` words of one more are taken.
    size, per = F.greatest("source_size", F.lit(1).cast("long")), F.lit(block).cast("long")
    targets = targets.withColumns({"full": F.expr(f"source_size div {block}"), "blocks": F.greatest(F.ceil(F.col("source_size") / per), F.lit(1)).cast("long"), "wanted": F.floor("target").cast("long")})
    targets = targets.withColumns({"epochs": F.floor(F.col("wanted") / size).cast("long"), "rest": F.col("wanted") % size})
    targets = targets.withColumn("more", F.least(F.ceil(F.col("rest") / per).cast("long"), F.col("full") + 1))
    targets = targets.withColumns({"quota": F.col("epochs") * F.col("blocks") + F.col("more"), "last": F.when(F.col("rest") > 0, F.col("rest") - (F.col("more") - 1) * per)})
    targets = stage(targets, "mix-targets")

    slots_ = targets.agg(F.sum("quota")).first()[0] or 0
    runs = dealt_slots(targets, max(least_shards, -(-int(slots_) // shard_slots)), seed)
    # Joined while they are few, and merged here and below: the planner sizes slots and pieces as the
    # rows that they are exploded from, and would send all of them through the driver.
    runs = runs.hint("merge").join(targets.select("source_no", "blocks", "full", "quota", "last"), "source_no")
    chunk = 1 << 14
    runs = runs.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {chunk}"))))
    # By number, as the few rows here become many slots: about 2**17 a task.
    runs = runs.repartition(max(1, min(50_000, int(slots_) >> 17)), "shard", "source_no", "c")
    lo = F.col("first") + F.col("c") * chunk
    runs = runs.select("shard", "source_no", "blocks", "full", "quota", "last", F.explode(F.sequence(lo, F.least(lo + chunk, F.col("first") + F.col("n")) - 1)).alias("slot"))
    epoch = F.expr("slot div blocks")
    runs = runs.withColumn("k", F.col("slot") % F.col("blocks"))
    runs = permuted(runs, F.least(F.col("k"), F.greatest(F.col("full") - 1, F.lit(0))), F.greatest(F.col("full"), F.lit(1)), [F.col("source_no"), epoch, F.lit(seed)], "place")
    slots = runs.select("shard", "source_no", "slot", F.when(F.col("k") < F.col("full"), F.col("place")).otherwise(F.col("full")).alias("block_no"), F.when(F.col("slot") == F.col("quota") - 1, F.col("last")).alias("words"))

    known = base.join(targets.select("source_key", "source_no", "source_size", "target"), "source_key").drop("source_key")
    narrow = known.select("row", "doc_id", "source_no", "size", "tie").where("size > 0")
    at = running_offsets(narrow, ["doc_id", "tie", "row"], "size", group="source_no", label="mix-order")
    at = at.withColumn("block_no", F.explode(F.sequence(F.expr(f"before div {block}"), F.expr(f"(before + size - 1) div {block}"))))
    begin = F.greatest("before", F.col("block_no") * per)
    end = F.least(F.col("before") + F.col("size"), (F.col("block_no") + 1) * per)
    pieces = at.select("row", "source_no", "block_no", (begin - F.col("before")).alias("start"), (end - begin).alias("words"), (begin - F.col("block_no") * per).alias("at"))
    return known, pieces, slots


def shard_pieces(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """(shard, source_no, slot, row, start, words, at): blocks joined to slots by index, as the
    pieces of documents that every slot takes.  A block has `block` pieces at most, and one
    slot in each epoch."""
    taken = F.when(F.col("upto").isNull(), F.col("words")).otherwise(F.least("words", F.col("upto") - F.col("at")))
    held = pieces.join(slots.withColumnRenamed("words", "upto").hint("merge"), ["source_no", "block_no"])
    return held.select("shard", "source_no", "slot", "row", "start", taken.alias("words"), "at").where("words > 0")


def output_shards(pieces: DataFrame, slots: DataFrame, seed: int = 11) -> DataFrame:
    """(shard, offset, source_no, slot, row, start, words): the mixture as its shards hold it.
    A shard's slots follow each other in hashed order and its words are numbered from 0; a
    shard has about `shard_slots` slots at most, whatever the corpus holds, and is ordered in a task."""
    order = [F.xxhash64("source_no", "slot", F.lit(seed)), "source_no", "slot", "at"]
    before = F.sum("words").over(Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    held = shard_pieces(pieces, slots).withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    return held.select("shard", "offset", "source_no", "slot", "row", "start", "words")


def taken_words(documents: DataFrame, pieces: DataFrame, slots: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """documents with `taken`: the words of it that the slots take, repeats counted; `shards`:
    the number of output shards that have any of them; `first_shard`: the least of these (null
    if none).  With `shards` (see output_shards) they are counted there."""
    held = shard_pieces(pieces, slots) if shards is None else shards
    by = held.groupBy("row", "shard").agg(F.sum("words").alias("words"))
    taken = by.groupBy("row").agg(F.sum("words").cast("long").alias("taken"), F.count("*").alias("shards"), F.min("shard").alias("first_shard"))
    zero = F.lit(0).cast("long")
    return documents.join(taken, "row", "left").withColumns({"taken": F.coalesce("taken", zero), "shards": F.coalesce("shards", zero)})


def resampled(docs: DataFrame, **how) -> DataFrame:
    """docs as whole documents in the mixture's proportions: a document of which the slots take
    `taken` of its `size` words appears floor(taken / size) times, and once more with the chance
    of the remainder, drawn from a hash of its id and text.  Rows equal in id, text and source
    share what is taken of them evenly, and draw each for itself by their place in docs."""
    given = docs.columns
    docs, names = guarded(docs, ("doc_id", "text", "source"))
    documents, pieces, slots = mixture(docs, **how)
    counted = taken_words(documents, pieces, slots).groupBy("doc_id", "tie", "source")
    counted = counted.agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.count("*").alias("copies")).where("taken > 0")
    counted = counted.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("source").alias("_source"), (F.col("taken") / F.col("size")).alias("_share"), (F.col("copies") > 1).alias("_repeated"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64("text") == F.col("_tie"))
    out = docs.withColumn("_at", F.monotonically_increasing_id()).join(counted, same)
    draw = F.pmod(F.xxhash64("doc_id", "_tie", F.lit(23), F.when(F.col("_repeated"), F.col("_at"))), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("_share") + F.when(draw < F.col("_share") - F.floor("_share"), 1).otherwise(0)
    out = out.withColumn("_times", times.cast("int")).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select("doc_id", "text", "source", *[F.col(k).alias(c) for k, c in names.items()]).select(*[named(c) for c in given])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces, slots = mixture(table(spark, sf_dir, "documents"))
    shards = stage(output_shards(pieces, slots), "mix-shards")
    mixed = taken_words(documents, pieces, slots, shards)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards", "first_shard")
