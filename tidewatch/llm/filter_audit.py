"""How document filters act on each other, in every order that they could be applied.

Filters A to D look at one text; E fails a text that a document of smaller doc_id has too.  Rows
are routed by the XXH64 of their text.  A map task keeps chains of (text, smallest doc_id) for a
hash, so that of a text it has many times one row travels with the text, and rows of larger
doc_id, whose fate is known, travel without it, dealt evenly; chains are sent on when they hold
CHAIN_BYTES.  The other side sorts by hash (on disk if need be), compares the
whole texts of one hash, and gives out which rows are not of the smallest doc_id.

Each document then is a mask of failed filters.  combineByKey adds vectors of mask counts by part
in every task before the shuffle, and a part's 120 orders are computed from its 32 masks alone.

Defined results: a null text is empty; E compares by doc_id, null ones last: rows of equal text
and doc_id share one fate, and rows of null doc_id fail only beside a row with one; a document is
good (toxic) if any of its label rows says 1, so repeated and null labels change no count; null
and empty lang are one part; an empty table gives no row; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, permutations

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_or_empty

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
CHAIN_BYTES, PART_BYTES = 16 << 20, 32 << 20
_MARKS = re.compile(rb"[#$%&*|]")
_OTHERS = bytes(b for b in range(256) if not 65 <= b <= 90)
_SAME = 1 << FILTERS.index("E")

Settled = tuple[int | None, str, int, int]  # doc_id, part, mask, rows


def own_mask(text: str, raw: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    words = raw.split()
    few = len(words) < 200
    dull = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * len(raw.translate(None, _OTHERS)) > 3 * len(text)
    marked = _MARKS.search(raw) is not None
    return few | dull << 1 | loud << 2 | marked << 3


def _rank(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


class Chains:
    """For each hash the texts met, each with its smallest doc_id and the rows that have it."""

    def __init__(self):
        self.of, self.bytes = {}, 0

    def add(self, digest: int, text: bytes, doc_id: int | None, part: str, mask: int, rows: int = 1) -> list[Settled]:
        """Put a row in; rows now known to have a larger doc_id than another come out."""
        chain = self.of.setdefault(digest, [])
        for link in chain:
            if link[0] == text:
                if _rank(link[1]) < _rank(doc_id):
                    return [(doc_id, part, mask | _SAME, rows)]
                out = []
                if link[1] != doc_id:
                    out = self._fallen(link)
                    link[1], link[3] = doc_id, {}
                link[3][part] = link[3].get(part, 0) + rows
                return out
        chain.append([text, doc_id, mask, {part: rows}])
        self.bytes += len(text) + 200
        return []

    @staticmethod
    def _fallen(link: list) -> list[Settled]:
        return [(link[1], part, link[2] | _SAME, n) for part, n in link[3].items()]

    def least(self) -> Iterator[tuple[int, bytes, int | None, str, int, int]]:
        for digest, chain in self.of.items():
            for text, doc_id, mask, parts in chain:
                for part, n in parts.items():
                    yield digest, text, doc_id, part, mask, n


_SHUFFLED = tuple[int, tuple[bytes | None, int | None, str, int, int]]


def _sent(rows: Iterator) -> Iterator[_SHUFFLED]:
    """Rows of (doc_id, part, text) as (hash, (text or None, doc_id, part, mask, rows))."""
    chains, known = Chains(), 0

    def gone() -> Iterator[_SHUFFLED]:
        for digest, text, *rest in chains.least():
            yield digest, (text, *rest)

    for doc_id, part, text in rows:
        raw = text.encode()
        for done in chains.add(xxhash.xxh64_intdigest(raw), raw, doc_id, part, own_mask(text, raw)):
            known += 1  # these are compared no more: they are dealt evenly
            yield xxhash.xxh64_intdigest(str(known)), (None, *done)
        if chains.bytes > CHAIN_BYTES:
            yield from gone()
            chains = Chains()
    yield from gone()


def _settled(rows: Iterator[_SHUFFLED]) -> Iterator[Settled]:
    for digest, group in groupby(rows, key=lambda kv: kv[0]):
        chains = Chains()
        for _, (text, *row) in group:
            if text is None:
                yield tuple(row)
            else:
                yield from chains.add(digest, text, *row)
        for _, _, *row in chains.least():
            yield tuple(row)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, rows): the filters that documents fail, E included.

    The texts' bytes, summed first, say how many partitions they are routed to."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // PART_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rdd: RDD = chosen.rdd.map(tuple).mapPartitions(_sent)
    settled = rdd.repartitionAndSortWithinPartitions(n, lambda digest: digest).mapPartitions(_settled)
    return docs.sparkSession.createDataFrame(settled, "doc_id long, part string, mask int, rows long", verifySchema=False)


def _cell(row) -> tuple[str, tuple[int, int, int, int]]:
    return row.part, (row.mask, row.rows, row.rows * row.good, row.rows * row.toxic)


def _add(vector: list[int], cell: tuple[int, int, int, int]) -> list[int]:
    for k in range(3):
        vector[3 * cell[0] + k] += cell[1 + k]
    return vector


def _merge(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b)]


def orders(vector: list[int]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of
    every order, from one vector of (documents, good ones, toxic ones) by mask."""
    count = lambda k, test: sum(vector[3 * m + k] for m in range(MASKS) if test(m))
    removed = {}
    for order in permutations(range(len(FILTERS))):
        before = 0
        for f in order:
            removed[order, f] = count(0, lambda m: m >> f & 1 and not m & before)
            before |= 1 << f
    shapley = [sum(removed[order, f] for order in permutations(range(len(FILTERS)))) for f in range(len(FILTERS))]
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            here = lambda m: m & bit and not m & before  # noqa: B023, E731
            yield (
                "".join(FILTERS[i] for i in order), step,
                count(0, lambda m: not m & (before | bit)), removed[order, f],
                count(0, lambda m: m & bit and m & before), vector[3 * bit],
                count(1, here), count(2, here), shapley[f],
            )
            before |= bit


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = known.agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    found = stage(masks(docs), "filter-masks").join(flags, "doc_id", "left").na.fill(0, ["good", "toxic"])
    counts = found.rdd.map(_cell).combineByKey(lambda cell: _add([0] * (3 * MASKS), cell), _add, _merge)
    rows = counts.flatMap(lambda kv: ((kv[0], *row) for row in orders(kv[1])))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
             + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER)
             + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
             + 16 * CAST(least IS NOT NULL AND (w.doc_id IS NULL OR w.doc_id > least) AS INTEGER) AS mask
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
p AS (SELECT a.range AS a, b.range AS b, c.range AS c, d.range AS d, 10 - a.range - b.range - c.range - d.range AS e
      FROM range(5) a, range(5) b, range(5) c, range(5) d
      WHERE len(list_distinct([a.range, b.range, c.range, d.range])) = 4),
o AS (SELECT substr('ABCDE', CAST(a + 1 AS INTEGER), 1) || substr('ABCDE', CAST(b + 1 AS INTEGER), 1) || substr('ABCDE', CAST(c + 1 AS INTEGER), 1)
             || substr('ABCDE', CAST(d + 1 AS INTEGER), 1) || substr('ABCDE', CAST(e + 1 AS INTEGER), 1) AS filter_order,
             s AS step, CAST(1 << [a, b, c, d, e][s] AS BIGINT) AS bit,
             CAST(list_sum(list_transform([a, b, c, d, e][1 : s - 1], lambda x: 1 << x)) AS BIGINT) AS early
      FROM p, range(1, 6) t(s)),
r AS (SELECT c.part, o.filter_order, CAST(o.step AS INTEGER) AS step, o.bit,
             coalesce(sum(n) FILTER (mask & (coalesce(early, 0) | bit) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(early, 0) = 0), 0) AS removed,
             coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(early, 0) > 0), 0) AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(early, 0) = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(early, 0) = 0), 0) AS toxic_lost
      FROM c CROSS JOIN o GROUP BY c.part, o.filter_order, o.step, o.bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
