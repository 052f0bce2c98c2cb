"""Document fingerprints by winnowing, in DataFrame functions only.

Grams are `gram` consecutive lower-cased words (the whole sequence of a shorter text).  A
gram's hash is the rolling cyclic polynomial of its words' hashes: each word's 64-bit hash is
turned left by one bit for each word after it, and the turned hashes are XORed, so a gram's
hash is that of the gram before turned by one bit, less its first word and with the next.  In
every window of `window` consecutive grams the least hash is chosen (36 of its bits are
compared), the rightmost of equal ones, and its position is kept.  So any run of window +
gram - 1 words that two texts share gives them a common fingerprint, whose positions tell where.

Window minima are taken over (36 bits of the hash, place from the right) packed into one
long, with array functions that stay in the JVM; a place takes 27 bits, more words than the
largest text of a row can have.

Defined results: null text is empty; a wordless text has an empty fingerprint; the likeness
of two empty fingerprints is 1, of one empty and one not 0; rows of equal doc_id are ordered
by a hash of the text; rows equal in both are one document, with one follower; a null doc_id
comes last; a single document is its own next one; an empty table
gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, text_or_empty

GRAM, WINDOW = 3, 8
_PLACE_BITS = 27


KEY = ["doc_key", "tie"]


def _chain(docs: DataFrame) -> DataFrame:
    """doc_key, tie, half, next_key, next_tie, copies: each document's follower by descending
    doc_id, the last one's being the first.  Ranges are chained apart, so no task orders more
    than one; equal rows are one document here."""
    narrow = docs.groupBy(*KEY).agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_key").desc(), F.col("tie")]
    dealt = stage(narrow.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "winnow-order")
    me = F.struct(*KEY)
    inside = Window.partitionBy("range").orderBy(*order)
    rows = dealt.select(*KEY, "n_chars", "copies", "range", F.lead(me).over(inside).alias("next"), F.row_number().over(inside).alias("place"))
    # The first row of each range follows the range before; the very first follows the last.
    heads = rows.where("place = 1").select("range", me.alias("head"))
    ring = Window.partitionBy().orderBy("range")
    wrap = F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("range", F.coalesce(F.lead("head").over(ring), wrap).alias("after"))
    # `heads` has a row for each range: bounded by the number of shuffle partitions.
    out = rows.join(F.broadcast(heads), "range").withColumn("next", F.coalesce("next", "after"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return stage(out.select(*KEY, half.alias("half"), F.col("next.doc_key").alias("next_key"), F.col("next.tie").alias("next_tie"), "copies"), "winnow-next")


def fingerprints(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """df with `out`: array of (position, hash) that winnowing chooses in column `text`, by position.

    Each step is a column of its own that the next reads at several places, so the planner
    keeps the steps apart and computes each once."""
    blank = " \t\n\x0b\f\r"
    last = (1 << _PLACE_BITS) - 1
    stripped = F.btrim(F.lower(F.col(text)), F.lit(blank))
    df = df.withColumn("_words", F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"[\x20\x09-\x0D]+", -1)))
    df = df.withColumn("_n", F.size("_words"))
    df = df.withColumn("_each", F.transform("_words", lambda w: F.xxhash64(w)))
    # get() beyond the end is null, here 0: a text shorter than a gram has one gram.
    turned = lambda h, k: h if k == 0 else F.shiftleft(h, k).bitwiseOR(F.shiftrightunsigned(h, 64 - k))

    def rolled(h: Column, i: Column) -> Column:
        out = turned(h, gram - 1)
        for k in range(1, gram):
            out = out.bitwiseXOR(turned(F.coalesce(F.get(F.col("_each"), i + k), F.lit(0).cast("long")), gram - 1 - k))
        return out

    df = df.withColumn("_hashes", F.slice(F.transform("_each", rolled), F.lit(1), F.greatest(F.col("_n") - (gram - 1), F.lit(1))))
    packed = F.transform("_hashes", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 1 + _PLACE_BITS), _PLACE_BITS).bitwiseOR(F.lit(last) - i))
    df = df.withColumn("_packed", packed).withColumn("_m", F.size("_hashes"))
    # least() skips nulls too: a sequence shorter than a window has one.
    low = F.transform("_packed", lambda p, i: F.least(p, *[F.get(F.col("_packed"), i + k) for k in range(1, window)]))
    low = F.array_distinct(F.slice(low, F.lit(1), F.greatest(F.col("_m") - (window - 1), F.lit(1))))
    place = lambda p: (F.lit(last) - p.bitwiseAND(F.lit(last))).cast("int")
    chosen = F.transform(low, lambda p: F.struct(place(p).alias("position"), F.get(F.col("_hashes"), place(p)).alias("hash")))
    return df.withColumn(out, chosen).drop("_words", "_n", "_each", "_hashes", "_packed", "_m")


def digest(chosen: Column) -> Column:
    """A fingerprint as 64 hex digits: the SHA-256 of its positions and hashes."""
    return F.sha2(F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["position"], F.hex(s["hash"]))), ","), 256)


def hash_set(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda s: s["hash"]))


def likeness(both: Column, a: Column, b: Column) -> Column:
    """Jaccard likeness from the sizes of an intersection and its two sets."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(both / (a + b - both))


def with_edited(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited (text), chosen, edited_chosen, next_doc_id, next_n_chars, next_set
    for every document.

    Texts are shuffled once, by document; both sides below read that one exchange.  A follower
    then sends the head of its text and its hashes to the document before it.  Each side makes
    a text's own fingerprint anew: to carry it through the exchange took more disk (over 3
    times the input, against 2)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    own = own.withColumns({"n_chars": F.char_length("text").cast("long"), "tie": F.xxhash64("text"), "doc_key": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    chain = _chain(own)
    own = own.select(*KEY, "doc_id", "n_chars", "text")
    ahead = chain.select(F.col("doc_key").alias("for_key"), F.col("tie").alias("for_tie"), F.col("next_key").alias("doc_key"), F.col("next_tie").alias("tie"), "half")
    copies = chain.select(*KEY, "copies")
    sent = fingerprints(own.join(ahead.join(copies, KEY), KEY), "text", "chosen", gram, window)
    sent = sent.select(F.col("for_key").alias("doc_key"), F.col("for_tie").alias("tie"), "half", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"), hash_set(F.col("chosen")).alias("next_set"), F.col("doc_id").alias("next_doc_id"), F.col("n_chars").alias("next_n_chars"), "copies")
    # Of equal rows only one sends.
    sent = sent.where("copies = 1").unionByName(sent.where("copies > 1").dropDuplicates(KEY)).drop("copies")
    met = own.join(sent, KEY)
    met = met.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.col("head")))
    met = fingerprints(met, "text", "chosen", gram, window)
    met = fingerprints(met, "edited", "edited_chosen", gram, window)
    return met.select("doc_id", "n_chars", "edited", "chosen", "edited_chosen", "next_doc_id", "next_n_chars", "next_set")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_edited(table(spark, sf_dir, "documents"))
    found = found.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), digest(F.col("chosen")).alias("fingerprint"), digest(F.col("edited_chosen")).alias("edited_fingerprint"), hash_set(F.col("chosen")).alias("a"), hash_set(F.col("edited_chosen")).alias("b"), F.col("next_set").alias("c"), "next_doc_id", "next_n_chars")
    found = found.withColumns({"ab": F.size(F.array_intersect("a", "b")), "ac": F.size(F.array_intersect("a", "c"))})
    near = lambda both, other: likeness(F.col(both), F.size("a"), F.size(other))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("ab", "b").alias("near_edited"), near("ac", "c").alias("near_next"), "next_doc_id", "next_n_chars")
