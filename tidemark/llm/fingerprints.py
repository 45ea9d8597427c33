"""Operator 10: document fingerprints as invertible Bloom lookup sketches, in Spark's own functions only.

A text's paragraphs (lines; long ones are cut after the first sentence that ends PIECE characters or more on) become a set of 64-bit digests. A sketch of it has three
subtables; each digest falls into one cell of each, and a cell holds the number of its digests, their XOR and the XOR
of check values. Sketches subtract cell by cell: equal paragraphs vanish, and peeling recovers the digests that differ,
one pure cell (count 1 or -1, fitting check) after another. The fingerprint is the sketch of 2 ** SLOT_BITS cells a subtable. If its
difference doesn't peel, a larger sketch of the whole set is made: its cells are dealt into blocks by other bits of the
digests, one of 24 cells for about GROUP digests, and the blocks are subtracted and peeled one by one. A block that
fails is sketched anew with other cells, larger each time (GROWN). What fails all sizes (chance: below 1e-12 for a
block) counts as wholly different. No set difference is taken: the likeness is the Jaccard similarity that the number of
recovered digests gives.

All work on a row stays in the row, on arrays; blocks keep it linear in the length of the text (times a square root
for dealing them). Finding the next document needs one shuffle: ids are cut into ranges of about RANGE_ROWS rows at
quantiles, each range is one group of a window, and the first row of each range is also sent to the range before. There
are at most RANGES ranges, whose first rows are known to the driver; beyond RANGES * RANGE_ROWS rows ranges grow (at 3e10
documents to half a million rows), which windows sort and spill.

Defined cases: a null text counts as empty; two texts without paragraphs have likeness 1; rows without an id come
first, in one range; rows of equal ids follow by their text; a single document is its own next; very long texts are
sketched whole; repeated paragraphs count once; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

PIECE = 100
PARAGRAPH = rf"[^\n]{{{PIECE},}}?[.!?](?= )|[^\n]+"
SLOT_BITS = 3
GROUP = 6
#: Bits of the cells of a subtable in the sketches that a block gets one after another.
GROWN = (SLOT_BITS, 4, 5, 7, 10)
RANGE_ROWS, RANGES = 2_000, 65_536
#: Which bits of a digest deal it into groups; its lowest 3 * SLOT_BITS bits (more in larger sketches) choose cells.
GROUP_AT, INNER_AT = 48, 36

CELL = "struct<n:int,key:bigint,check:bigint>"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    parts = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def _slot(key: Column, subtable: int, bits: int) -> Column:
    return F.shiftrightunsigned(key, subtable * bits).bitwiseAND(F.lit((1 << bits) - 1))


def sketch(keys: Column, bits: int = SLOT_BITS) -> Column:
    """The cells of a set of digests, subtable by subtable."""
    xor = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    cell = lambda own: F.struct(F.size(own).alias("n"), xor(own).alias("key"), xor(F.transform(own, check)).alias("check"))

    def cells(all_keys: Column) -> Column:
        def subtable(t: int) -> Column:
            return F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << bits) - 1).cast("long")), lambda s: let(F.filter(all_keys, lambda k: _slot(k, t, bits) == s), cell))

        return F.concat(*map(subtable, range(3)))

    return let(keys, cells)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(cells: Column, steps: Column, bits: int = SLOT_BITS) -> Column:
    """The digests that a difference of sketches holds; null if it can't be emptied. steps: at least their number."""
    size = 1 << bits
    state = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"))

    def step(s: Column, _: Column) -> Column:
        pure = F.get(F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (check(c["key"]) == c["check"])), F.lit(0))

        def out(p: Column) -> Column:
            places = F.array(*((_slot(p["key"], t, bits) + t * size).cast("int") for t in range(3)))
            less = lambda at: F.transform(
                s["cells"],
                lambda c, i: F.when(
                    (i == at[0]) | (i == at[1]) | (i == at[2]),
                    F.struct((c["n"] - p["n"]).alias("n"), c["key"].bitwiseXOR(p["key"]).alias("key"), c["check"].bitwiseXOR(p["check"]).alias("check")),
                ).otherwise(c),
            )
            return F.when(p.isNull(), s).otherwise(F.struct(let(places, less).alias("cells"), F.array_append(s["found"], p["key"]).alias("found")))

        return let(pure, out)

    empty = lambda s: ~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0))
    turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, state, step, lambda s: F.when(empty(s), s["found"]))


def dealt(keys: Column, power: Column) -> Column:
    """keys in 2 ** power groups: first into about the square root of as many, then each of these."""
    wide = F.floor(power / 2).cast("int")

    def deal(xs: Column, at: int, n: Column) -> Column:
        last = F.pow(F.lit(2.0), n).cast("long") - 1
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda g: F.filter(xs, lambda k: F.shiftrightunsigned(k, at).bitwiseAND(last) == g))

    return F.flatten(F.transform(let(keys, lambda xs: deal(xs, GROUP_AT, wide)), lambda xs: deal(xs, INNER_AT, power - wide)))


def different(a: Column, b: Column) -> Column:
    """How many digests only one of two small sets has, from sketches of growing size, each with cells of its own."""

    def attempt(n: int, bits: int) -> Column:
        """The first sketch has the digests' own cells; later ones those of another hash of them."""
        other = (lambda keys: keys) if not n else (lambda keys: F.transform(keys, lambda k: F.xxhash64(k, F.lit(n + 1))))
        return F.array_size(peel(subtract(sketch(other(a), bits), sketch(other(b), bits)), F.size(a) + F.size(b), bits))

    return F.coalesce(*(attempt(n, bits) for n, bits in enumerate(GROWN)), F.size(a) + F.size(b))


def recovered(a: Column, b: Column, a_sketch: Column, b_sketch: Column) -> Column:
    """How many digests only one of two sets has, by the fingerprints and, where they don't peel, by larger sketches."""
    most = 3 * (1 << SLOT_BITS)
    unlike = F.abs(F.size(a) - F.size(b)) > most
    first = F.when(~unlike, F.array_size(peel(subtract(a_sketch, b_sketch), F.least(F.size(a) + F.size(b), F.lit(most)))))
    power = F.ceil(F.log2(F.greatest(F.lit(1.0), F.greatest(F.size(a), F.size(b)) / GROUP))).cast("int")
    groups = F.zip_with(dealt(a, power), dealt(b, power), different)
    return F.coalesce(first, F.aggregate(groups, F.lit(0), lambda n, x: n + x))


def likeness(a: Column, b: Column, difference: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise((total - difference) / (total + difference).cast("double"))


def written(cells: Column) -> Column:
    """A sketch as a string: count, key and check of each cell in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", F.hex(c["n"].cast("long")), F.hex(c["key"]), F.hex(F.shiftrightunsigned(c["check"], 32)))), ",")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text, the text of the row that follows by id and text, cyclically."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    ranges = min(RANGES, -(-n // RANGE_ROWS))
    if ranges > 1:
        cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], min(20 * ranges, 1 << 20)).alias("cuts")).first()["cuts"]
    else:
        cuts = []
    cuts = sorted(set(cuts or []))
    # literals, folded once; two levels of cuts, so that a row is held against about twice the root of their number
    coarse = max(1, round(len(cuts) ** 0.5))
    lots = [cuts[i : i + coarse] for i in range(0, len(cuts), coarse)]
    if cuts:
        tops = F.from_json(F.lit(str([lot[0] for lot in lots])), "array<long>")
        lists = F.from_json(F.lit(str(lots)), "array<array<long>>")
        lot = F.size(F.filter(tops, lambda c: c <= F.col("doc_id"))) - 1
        place = F.when(F.col("doc_id").isNull() | (F.col("doc_id") < cuts[0]), 0).otherwise(lot * coarse + F.size(F.filter(F.get(lists, lot), lambda c: c <= F.col("doc_id"))))
    else:
        place = F.lit(0)
    placed = docs.withColumn("range", place.cast("int"))
    # at most RANGES rows: the first id of each range
    firsts = sorted(placed.groupBy("range").agg(F.min("doc_id").alias("id"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).collect(), key=lambda r: r["range"])
    if not firsts:
        return placed.select("doc_id", "text", F.col("text").alias("next_text"))
    heads = [(None if r["nameless"] else r["id"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)]
    known = docs.sparkSession.createDataFrame(heads, "head long, range int")
    ends = docs.join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "range", F.lit(1).alias("end"))
    # of rows that share a first id only the least text follows; the others are dropped again below
    both = placed.select("doc_id", "text", "range", F.lit(0).alias("end")).unionByName(ends)
    line = Window.partitionBy("range").orderBy("end", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("next_text", F.lead("text").over(line)).filter("end = 0").select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprinted(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, text, next_text) with the edited text, fingerprints and likenesses."""
    d = pairs.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    d = d.withColumns({"a": digests(F.col("text")), "e": digests(F.col("edited_text")), "x": digests(F.col("next_text"))})
    d = d.withColumns({f"{k}_sketch": sketch(F.col(k)) for k in "aex"})
    col = F.col
    d = d.withColumns({"d_edited": recovered(col("a"), col("e"), col("a_sketch"), col("e_sketch")), "d_next": recovered(col("a"), col("x"), col("a_sketch"), col("x_sketch"))})
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        written(col("a_sketch")).alias("fingerprint"),
        written(col("e_sketch")).alias("edited_fingerprint"),
        likeness(col("a"), col("e"), col("d_edited")).alias("near_edited"),
        likeness(col("a"), col("x"), col("d_next")).alias("near_next"),
        F.size("a").alias("n_paragraphs"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(with_next(table(spark, sf_dir, "documents").select("doc_id", "text")))
