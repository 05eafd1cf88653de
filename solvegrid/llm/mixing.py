"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

1. Sources by code point, null last, have the weights given, repeating. Each target is its
   share of all words, at most ``most`` times what its source has; the excess goes to the
   others by weight until none is above.
2. All words make blocks of ``block`` words. Sources get whole numbers of blocks by the
   highest quotients target / (2 * seats + 1). Only quotients near the divisor are
   contested, about four for each source; all seats below them are given at once.
3. A source of N blocks is dealt by hash into about sqrt(N) shards, so neither the number of
   shards of a source nor the rows of a shard grow as the input does. The source's seats go
   to its shards in the same way.
4. In a shard, documents lie in a seeded order (md5 of seed and id). Its quota is whole
   passes over all its words, then a run of consecutive blocks from a seeded start, around
   the end if need be. As the order is a seeded permutation, the run is a seeded choice of
   blocks. What a document gives follows from prefix sums; blocks are never made as rows.

Cases: null text has size 0 and is taken 0 times; a null source is a source; repeated rows
are documents of their own; no words at all gives targets of 0; ids may be null; columns of
the caller with any name are untouched, as only the id, text and source are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK = 16
MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target: one row for each source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")).cast("long")
    weighed = by_source.select("source", "source_size", w.alias("weight"))
    # by how soon a source fills up: those before it are full, so the rest share what is left
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left / open_weight
    leveled = weighed.withColumn("level", level).withColumn("full", F.lit(most) * F.col("source_size") <= F.col("level") * F.col("weight"))
    # the level that holds is that of the first source, in this order, that doesn't fill up
    leveled = leveled.withColumn("nth", F.row_number().over(by_fill))
    leveled = leveled.withColumn("holds", F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(everything)["level"])
    capped = (F.lit(most) * F.col("source_size")).cast("double")
    return leveled.select("source", "source_size", "weight", F.least(capped, F.coalesce(F.col("holds") * F.col("weight"), capped)).alias("target"))


def seats(shares: DataFrame, group: list[str], key: list[str], share: str, total: str) -> DataFrame:
    """Sainte-Lague within each group: total seats among rows, by a share of at least 0.

    shares has the columns of group and key, share (double) and total (long, the same in a
    group). The result has group, key and seats. The divisor lies between sum / (total + rows / 2)
    and sum / (total - rows / 2), so a row's seats lie between the two roundings of its quota,
    and only seats between these compete.
    """
    names = [*group, *key]
    w = Window.partitionBy(*group)
    s = shares.withColumn("__sum", F.sum(share).over(w)).withColumn("__rows", F.count(F.lit(1)).over(w))
    unit = F.when(F.col("__sum") > 0, F.col(share) / F.col("__sum")).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.floor(unit * (F.col(total) - F.col("__rows") / 2)) - 1).cast("long")
    high = (F.floor(unit * (F.col(total) + F.col("__rows") / 2)) + 2).cast("long")
    s = s.withColumn("__low", low).withColumn("__high", high).withColumn("__left", F.col(total) - F.sum("__low").over(w))
    each = s.where(F.col(share) > 0).withColumn("__seat", F.explode(F.sequence("__low", "__high")))
    order = [(F.col(share) / (2 * F.col("__seat") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], F.col("__seat").asc()]
    won = each.withColumn("__rank", F.row_number().over(w.orderBy(*order))).where(F.col("__rank") <= F.col("__left")).select(*names, F.lit(1).alias("seats"))
    # rows that win no contested seat keep their sure ones
    return s.select(*names, F.col("__low").alias("seats")).unionByName(won.select(*names, F.col("seats").cast("long"))).groupBy(*names).agg(F.sum("seats").alias("seats"))


def _join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which null equals null; b's other columns follow a's."""
    right = b.select(*[F.col(c).alias(f"__r_{c}" if c in on else c) for c in b.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return a.join(right, cond).drop(*[f"__r_{c}" for c in on])


def mix(docs: DataFrame, *, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each document."""
    sized = C.settle(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    goal = targets(sized, weights, most)
    everything = Window.partitionBy()
    goal = goal.withColumn("__blocks", F.floor((F.sum("target").over(everything) + F.lit(block / 2)) / F.lit(block)).cast("long"))
    goal = C.settle(goal.withColumn("__shards", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("source_size") / F.lit(block)))).cast("long")))
    plan = _join(goal, seats(goal, [], ["source"], "target", "__blocks").withColumnRenamed("seats", "__seats"), ["source"])
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    dealt = _join(sized, plan.select("source", "source_size", "target", "__seats", "__shards"), ["source"])
    dealt = dealt.withColumn("__key", key).withColumn("__shard", F.pmod(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"), F.col("__shards")))
    cells = dealt.groupBy("source", "__shard").agg(F.sum("size").cast("double").alias("__share"), F.max("__seats").alias("__seats"))
    quotas = seats(cells, ["source"], ["__shard"], "__share", "__seats")
    joined = _join(dealt, quotas, ["source", "__shard"])
    cell = Window.partitionBy("source", "__shard")
    stream = cell.orderBy("__key", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    words = F.sum("size").over(cell)
    start = F.coalesce(F.sum("size").over(stream), F.lit(0))
    rows = joined.withColumn("__n", words).withColumn("__a", start).withColumn("__take", F.least(F.col("seats") * block, F.lit(most) * F.col("__n")))
    # whole passes, and the rest from a block that the seed and the shard choose
    passes = F.when(F.col("__n") > 0, F.floor(F.col("__take") / F.col("__n"))).otherwise(F.lit(0))
    spot = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("source"), F.lit("")), F.lit("/"), F.col("__shard").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__passes", passes.cast("long")).withColumn("__rest", F.col("__take") - F.col("__passes") * F.col("__n"))
    rows = rows.withColumn("__from", F.when(F.col("__n") > 0, F.pmod(spot * block, F.col("__n"))).otherwise(F.lit(0)))
    upto = F.col("__from") + F.col("__rest")
    a, b = F.col("__a"), F.col("__a") + F.col("size")
    run = F.greatest(F.lit(0), F.least(b, upto) - F.greatest(a, F.col("__from"))) + F.greatest(F.lit(0), F.least(b, upto - F.col("__n")) - a)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("__passes") * F.col("size") + run).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs as the mix takes them: a row for each whole pass, and one more where half of it or more is in the run.

    The columns are those of docs. Rows without words aren't taken. Rows that share an id are
    all taken as often as the one of them that the mix takes most often; an empty table gives
    no rows.
    """
    taken = mix(docs, id_col=id_col, **options)
    times = taken.where("size > 0").groupBy("doc_id").agg(F.max(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).cast("int").alias("__times")).where("__times > 0").withColumnRenamed("doc_id", "__id")
    times = C.settle(times)
    # the same join at every size: the ids grow as the texts do
    return docs.join(times.hint("merge"), docs[id_col].eqNullSafe(times["__id"])).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])


#: DuckDB SQL for mix() over the table documents, with the default parameters.
SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM by_source),
leveled AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM weighed WINDOW b AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST) AS nth FROM leveled),
held AS (SELECT *, (SELECT level FROM numbered WHERE NOT (3 * source_size <= level * weight) ORDER BY nth LIMIT 1) AS holds FROM numbered),
goal AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(holds * weight, (3 * source_size)::DOUBLE)) AS target FROM held),
goal2 AS (
  SELECT *, floor((sum(target) OVER () + 8) / 16)::BIGINT AS blocks, greatest(1, floor(sqrt(source_size::DOUBLE / 16))::BIGINT) AS shards,
    count(*) OVER () AS n_rows, sum(target) OVER () AS total FROM goal),
low AS (SELECT *, greatest(0, floor(CASE WHEN total > 0 THEN target / total ELSE 0 END * (blocks - n_rows / 2.0::DOUBLE))::BIGINT - 1) AS low,
  floor(CASE WHEN total > 0 THEN target / total ELSE 0 END * (blocks + n_rows / 2.0::DOUBLE))::BIGINT + 2 AS high FROM goal2),
contest AS (
  SELECT source, seat, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, source NULLS LAST, seat) AS rank, blocks - (SELECT sum(low) FROM low) AS seats_left
  FROM (SELECT *, unnest(range(low, high + 1)) AS seat FROM low WHERE target > 0)),
plan AS (
  SELECT l.source, l.source_size, l.target, l.shards, l.low + (SELECT count(*) FROM contest c WHERE c.source IS NOT DISTINCT FROM l.source AND c.rank <= c.seats_left) AS seats FROM low l),
dealt AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.seats, md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.size::VARCHAR) AS key,
    ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.size::VARCHAR), 1, 8))::BIGINT % p.shards AS shard
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
cells AS (SELECT source, shard, sum(size)::DOUBLE AS share, any_value(seats) AS seats FROM dealt GROUP BY ALL),
cells2 AS (SELECT *, sum(share) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n_rows FROM cells),
cells3 AS (SELECT *, greatest(0, floor(CASE WHEN total > 0 THEN share / total ELSE 0 END * (seats - n_rows / 2.0::DOUBLE))::BIGINT - 1) AS low,
  floor(CASE WHEN total > 0 THEN share / total ELSE 0 END * (seats + n_rows / 2.0::DOUBLE))::BIGINT + 2 AS high FROM cells2),
cells4 AS (SELECT *, seats - sum(low) OVER (PARTITION BY source) AS seats_left FROM cells3),
won AS (
  SELECT source, shard, count(*) AS won FROM (
    SELECT source, shard, seats_left, row_number() OVER (PARTITION BY source ORDER BY share / (2 * seat + 1) DESC, shard, seat) AS rank
    FROM (SELECT *, unnest(range(low, high + 1)) AS seat FROM cells4 WHERE share > 0))
  WHERE rank <= seats_left GROUP BY ALL),
quota AS (SELECT c.source, c.shard, c.low + coalesce(w.won, 0) AS seats FROM cells4 c LEFT JOIN won w ON c.source IS NOT DISTINCT FROM w.source AND c.shard = w.shard),
stream AS (
  SELECT d.doc_id, d.source, d.size, d.source_size, d.target, d.shard, q.seats, sum(d.size) OVER (PARTITION BY d.source, d.shard) AS n,
    coalesce(sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY d.key, d.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM dealt d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard),
take AS (SELECT *, least(seats * 16, 3 * n) AS take, ('0x' || substr(md5('mix-1/' || coalesce(source, '') || '/' || shard::VARCHAR), 1, 8))::BIGINT * 16 AS spot FROM stream),
pass AS (SELECT *, CASE WHEN n > 0 THEN take // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN spot % n ELSE 0 END AS start FROM take),
rest AS (SELECT *, start + take - passes * n AS upto FROM pass)
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(a + size, upto) - greatest(a, start)) + greatest(0, least(a + size, upto - n) - a))::BIGINT AS taken
FROM rest
"""
