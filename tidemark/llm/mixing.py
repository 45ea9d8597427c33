"""Operator 6: mixing sources to target weights by Sainte-Laguë apportionment.

All sizes together are cut into BLOCKS blocks of equal tokens, or more of them where a block would be over
1 / LEAST_BLOCKS of the share that some shard has of its source's target: rounding to whole blocks moves no source and
no shard by more than a small part of its target, whatever the size of the others. Targets are divided by water filling: a source gets
its weight's share, at most MOST times its own size, and the excess is shared again by weight. Sainte-Laguë (quotients
target / (2 s + 1)) turns targets into whole blocks per source, and again a source's blocks into whole blocks per shard
by the shards' sizes. A shard holds a bounded number of documents in a seeded order, laid end to end as a ring of
tokens; its quota takes whole turns, then a run of blocks from a seeded start. So a document's part is the overlap of
two intervals, and no block is listed.

Only totals by source and by shard are grouped; sources are few, so their windows may stand in one task. A window over
documents sees one shard.

Defined cases: a null text has no words; a null source is a source of its own, last; sources without words get nothing;
repeated rows take turns in the order of their id and text; an empty table gives an empty table; other columns don't
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCKS = 1 << 16
#: Blocks that the least shard's share of its source's target has at least, if it has so many words.
LEAST_BLOCKS = 16
SHARD_ROWS = 2_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n_docs, source_size, target of sources given as source, n_docs, source_size.

    The level at which min(most * size, level * weight) sums to the total is found from the running sums in the order
    of most * size / weight: below it sources are full, above it they share what is left.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), F.col("place") + 1)).withColumn("cap", most * F.col("source_size"))
    # cap_a / weight_a < cap_b / weight_b as whole numbers would need products, which may overflow: doubles order them well enough, and ties don't matter
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "source", "n_docs", "source_size", "weight", "cap",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    open_level = F.min(F.when(F.col("cap") > level * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("at"), level.alias("level")))).over(everything)["level"]
    return ranked.withColumn("level", open_level).select(
        "source", "n_docs", "source_size",
        F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"),
    )


def apportion(votes: DataFrame, group: list[str], party: list[str], votes_name: str, seats: Column, out: str) -> DataFrame:
    """votes with ``out``, the seats of each party: Sainte-Laguë within each group.

    With S parties and H seats a party's seats differ from its share q by at most q S / 2H + 1/2, so that many are
    certain, and only the quotients of about S + 2 q S / H further seats, 4 S in all, are ranked.
    """
    whole = Window.partitionBy(*group).orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = votes.withColumn("_seats", seats).withColumn("_all", F.sum(votes_name).over(whole)).withColumn("_parties", F.count(F.lit(1)).over(whole))
    share = F.when(F.col("_all") > 0, F.col(votes_name) * F.col("_seats") / F.col("_all")).otherwise(F.lit(0.0))
    slack = F.when(F.col("_seats") > 0, F.col("_share") * F.col("_parties") / (2 * F.col("_seats"))).otherwise(F.lit(0.0))
    v = v.withColumn("_share", share).withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_share") - slack - 0.5)).cast("long"))
    v = v.withColumn("_left", F.col("_seats") - F.sum("_sure").over(whole))
    more = F.sequence(F.lit(0), F.ceil(2 * slack).cast("int") + 2)
    wanted = v.filter(F.col(votes_name) > 0).select("*", F.explode(more).alias("_k"))
    quotient = F.col(votes_name) / (2 * (F.col("_sure") + F.col("_k")) + 1)
    order = Window.partitionBy(*group).orderBy(quotient.desc(), *(F.col(p).asc_nulls_last() for p in party))
    won = wanted.withColumn("_rank", F.row_number().over(order)).groupBy(*group, *party).agg(F.sum((F.col("_rank") <= F.col("_left")).cast("long")).alias("_won"))
    a, b = v.alias("a"), won.alias("b")
    same = F.lit(True)
    for k in [*group, *party]:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return a.join(b, same, "left").select(*(F.col(f"a.`{c}`") for c in votes.columns), (F.col("a._sure") + F.coalesce(F.col("b._won"), F.lit(0))).alias(out))


def _draw(*parts: Column) -> Column:
    """A number below 2^52 that depends on the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def mix(docs: DataFrame, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, row_key, source, size, source_size, target, taken of docs with doc_id, row_key, source, size.

    row_key orders rows of the same doc_id; rows equal in both share an order but each has its own place.
    """
    by_source = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    aims = targets(by_source)
    aims = aims.withColumn("shards", F.ceil(F.col("n_docs") / shard_rows).cast("long")).withColumn("everyone", F.lit(1))

    # every source of the table is in aims, and sources are few: their number is that of the groups above
    a, d = aims.drop("n_docs").alias("a"), docs.withColumn("draw", _draw(F.col("doc_id").cast("string"), F.col("row_key"))).alias("d")
    placed = d.join(a, F.col("a.source").eqNullSafe(F.col("d.source")), "left").select("d.*", "source_size", "target", (F.col("draw") % F.col("shards")).alias("shard"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("_size"), F.first("target").alias("_target"))
    least = shards.filter("shard_size > 0").agg(F.min(F.col("_target") * F.col("shard_size") / F.col("_size")).alias("_least"))

    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = F.ceil(F.sum("source_size").over(everything) / blocks)
    aims = aims.crossJoin(F.broadcast(least)).withColumn("block", F.greatest(F.lit(1), F.least(wide, F.floor(F.col("_least") / LEAST_BLOCKS))).cast("long")).drop("_least")
    whole = F.round(F.sum("target").over(everything) / F.col("block")).cast("long")
    aims = apportion(aims, ["everyone"], ["source"], "target", whole, "quota")

    a, s = aims.select("source", "block", "quota").alias("a"), shards.alias("s")
    shards = s.join(a, F.col("a.source").eqNullSafe(F.col("s.source")), "left").select("s.source", "shard", "shard_size", "block", "quota")
    shards = apportion(shards, ["source"], ["shard"], "shard_size", F.col("quota"), "shard_quota").drop("quota")

    p, s = placed.alias("p"), shards.alias("s")
    rows = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.shard") == F.col("s.shard")), "left").select("p.*", "shard_size", "block", "shard_quota")
    line = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    ring = F.col("shard_size")
    tokens = F.least(F.col("shard_quota") * F.col("block"), MOST * ring)
    rows = rows.withColumn("turns", F.when(ring > 0, F.floor(tokens / ring)).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.when(ring > 0, tokens - F.col("turns") * ring).otherwise(F.lit(0)))
    n_blocks = F.greatest(F.lit(1), F.ceil(ring / F.col("block"))).cast("long")
    rows = rows.withColumn("from", (_draw(F.lit("start"), F.coalesce("source", F.lit("\x00null")), F.col("shard").cast("string")) % n_blocks) * F.col("block"))
    upto = F.col("from") + F.col("rest")
    overlap = lambda low, high: F.greatest(F.lit(0), F.least(F.col("end"), high) - F.greatest(F.col("begin"), low))
    part = overlap(F.col("from"), F.least(upto, ring)) + overlap(F.lit(0), upto - ring)
    return rows.select("doc_id", "row_key", "source", "size", "source_size", "target", (F.col("turns") * F.col("size") + part).cast("long").alias("taken"))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("row_key"), word_count(F.col("text")).alias("size"), *more)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, source and any others), each as often as the mix takes its text, rounded.

    Only ids, digests and sizes go through the apportionment; texts meet their numbers of copies in one join.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("row_key")).cast("binary"))
    taken = mix(checkpointed(sized(docs)))
    copies = taken.groupBy(key.alias("_key")).agg(F.sum(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)).cast("int").alias("_copies")).filter("_copies > 0")
    row_key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", row_key.alias("row_key")).select(key.alias("_key"), "_row")
    met = rows.join(copies, "_key").dropDuplicates(["_key"])  # repeated rows were summed
    return met.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes are used for totals, shards and rows: without the checkpoint every text would be read and counted three times
    docs = checkpointed(sized(table(spark, sf_dir, "documents")))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
