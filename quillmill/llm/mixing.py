"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a seeded hash and served in that order. A
document's virtual finish time is the tokens of its source up to and with it, divided by the
source's weight. All documents are range-sorted by finish time and cut where the total reaches
the budget, so every prefix of the result holds the sources in proportion to their weights for
as long as they last.

No source is ever gathered in one place. The hash is uniform, so its first digits split a source
into BUCKETS even, ordered parts; their sums (a small table) give each part's offset, and the
running sum within a part completes it. The cut is found in the same manner, in BUCKETS parts of
finish time, and parts of these parts. Only (source, key, tokens) move for all this; texts move for documents below the
cut alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import free_name, own, stash, table

SEED = "7"
DIGITS = 3
BUCKETS = 16**DIGITS
WEIGHTS = {"src0": 4.0, "src1": 2.0}
DEFAULT_WEIGHT = 1.0
BUDGET = 0.5
#: The most rows among which the cut's place is found by one sort.
FEW = 100_000


def token_count(text: Column | str = "text") -> Column:
    """Whitespace-separated tokens, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def shuffle_key(seed: str = SEED) -> Column:
    """Place in a source's shuffle: a hash of doc_id and text. Equal rows tie."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def _weight(weights: dict[str, float]) -> Column:
    w = F.lit(DEFAULT_WEIGHT)
    for source, weight in weights.items():
        w = F.when(F.col("m.source") == source, F.lit(float(weight))).otherwise(w)
    return w


def _finish(rows: DataFrame, offsets: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows (with struct m of source, key, bucket, tokens) and m's finish time.

    Peers of the window's range frame, rows of equal source and key, finish together.
    """
    w = Window.partitionBy("m.source", "m.bucket").orderBy("m.key")
    at = rows.join(offsets, F.col("m.source").eqNullSafe(F.col("o.source")) & (F.col("m.bucket") == F.col("o.bucket"))).withColumn("so_far", F.sum("m.tokens").over(w) + F.col("o.before"))
    return at.withColumn("finish", F.col("so_far").cast("double") / _weight(weights))


def mix_sources(docs: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float = BUDGET, seed: str = SEED, tokens: Column | None = None, few: int = FEW) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...) served within budget (a share of all tokens), by finish time.

    All columns, and tokens and virtual_finish (with underscores added if docs has such a
    column). Defined results: a null source is a source of its own with the default weight; a
    null or empty text has no tokens and costs nothing; rows equal in source, doc_id and text
    finish together, and rows equal in finish time and key are served or cut together; an empty
    table gives an empty result. Weights must be positive.
    """
    if min([DEFAULT_WEIGHT, *weights.values()]) <= 0:
        raise ValueError("weights must be positive")
    counted = tokens is None
    tokens = token_count() if counted else tokens
    key = shuffle_key(seed)
    member = lambda n: F.struct(F.col("source"), key.alias("key"), F.substring(key, 1, DIGITS).alias("bucket"), n.alias("tokens")).alias("m")
    keys = stash(docs.select(member(tokens)))
    sums = keys.groupBy("m.source", "m.bucket").agg(F.sum("m.tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stash(sums.select("source", "bucket", before.alias("before")))
    timed = stash(_finish(keys, offsets.alias("o"), weights).select("m", "finish"))
    total = timed.agg(F.coalesce(F.sum("m.tokens"), F.lit(0))).first()[0]
    served = _cut(timed, int(total * budget), few)
    # Within a source, time follows the key: what is served is a prefix of each.
    upto = stash(served.groupBy("m.source").agg(F.max("m.key").alias("upto")))
    times = served.groupBy(F.col("m.source").alias("source"), F.col("m.key").alias("key")).agg(F.min("finish").alias("finish"), F.min("m.tokens").alias("tokens"))
    names = [free_name(docs, "tokens"), free_name(docs, "virtual_finish")]
    m, tmp, n = free_name(docs, "m"), free_name(docs, "finish"), free_name(docs, "n")
    # Rows of one key are equal in text, so the default count is known from the first pass; any other Column may differ.
    rows = docs.select(*own(docs), key.alias(m), *([] if counted else [tokens.alias(n)])).alias("d")
    rows = rows.join(upto.alias("u"), F.col("d.source").eqNullSafe(F.col("u.source")) & (F.col(f"d.{m}") <= F.col("u.upto"))).select("d.*").alias("d")
    rows = rows.join(times.alias("t"), (F.col(f"d.{m}") == F.col("t.key")) & F.col("d.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("d.*", F.col("t.finish").alias(tmp), *([F.col("t.tokens").alias(n)] if counted else [])).orderBy(tmp, m)
    return rows.select(*own(docs), F.col(n).alias(names[0]), F.col(tmp).alias(names[1]))


def _cut(timed: DataFrame, limit: int, few: int = FEW) -> DataFrame:
    """The rows of timed (m, finish) whose running total by (finish, key) is within limit.

    The cut's place is narrowed part by part: an interval of time is cut into BUCKETS equal parts, and the
    part that the limit falls in is cut again, until it holds few rows. A single time that many rows share is
    narrowed by the digits of the key in the same way. So no task sorts more than few places, whatever the weights.
    """
    here, spent, digits = F.lit(True), 0, 0
    while True:
        n, first, last = timed.where(here).agg(F.count("*"), F.min("finish"), F.max("finish")).first()
        if n <= few or digits >= 32:
            break
        if first < last:  # both ends' parts hold rows, so the next part is narrower
            part = F.least(F.floor((F.col("finish") - first) / F.lit(last - first) * BUCKETS), F.lit(BUCKETS - 1))
        else:
            part = F.substring("m.key", digits + 1, DIGITS)
        found = timed.where(here).groupBy(part.alias("part")).agg(F.sum("m.tokens").alias("n"), F.min("finish").alias("a"), F.max("finish").alias("b"))
        for row in found.orderBy("part").collect():  # at most BUCKETS rows
            if spent + row.n > limit:
                break
            spent += row.n
        else:
            return timed  # all of it: a part that is cut again never fits
        if first < last:
            here = F.col("finish").between(row.a, row.b)
        else:
            here = here & (part == row.part)
            digits += DIGITS
    places = timed.where(here).groupBy("finish", "m.key").agg(F.sum("m.tokens").alias("n"))
    running = places.withColumn("total", F.sum("n").over(Window.orderBy("finish", "key")) + F.lit(spent))
    begin, end = running.agg(F.min(F.struct("finish", "key")), F.max(F.when(F.col("total") <= limit, F.struct("finish", "key")))).first()
    if begin is None:
        return timed
    at, last = (end or begin), F.col("m.key")
    return timed.where((F.col("finish") < at.finish) | (F.col("finish") == at.finish) & ((last <= at.key) if end else (last < at.key)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


_CASES = " ".join(f"WHEN source = '{s}' THEN {w!r}::DOUBLE" for s, w in WEIGHTS.items())
SQL = f"""
WITH keyed AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+'))::BIGINT AS tokens,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k,
         CASE {_CASES} ELSE {DEFAULT_WEIGHT!r}::DOUBLE END AS w
  FROM documents),
timed AS (SELECT *, (sum(tokens) OVER (PARTITION BY source ORDER BY k))::DOUBLE / w AS virtual_finish FROM keyed),
served AS (SELECT *, sum(tokens) OVER (ORDER BY virtual_finish, k) AS so_far, sum(tokens) OVER () AS total FROM timed)
SELECT doc_id, text, lang, source, n_chars, tokens, virtual_finish FROM served WHERE so_far <= floor(total * {BUDGET!r})
"""
