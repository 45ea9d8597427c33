"""Operator 2: quality rules by distribution divergence, in Spark's own functions only.

A document's histograms of character classes and of common words are compared with the references of the languages by
Jensen-Shannon distance (root of the divergence in bits, 0 to 1). References are pooled counts of the corpus itself:
of the documents of a language that pass the base rules, have GUARD_WORDS words and are plain prose (few symbols, few
capitals). A document is kept if its two distances to its own language, or to one of the LARGEST languages with most
words, sum to little enough. The comparison counts only from a length on (GUARD_CHARS, GUARD_WORDS), and only for
documents that a reference speaks for: their language has one of REFERENCE_WORDS words, or, where the language is null,
one of the LARGEST is in the same script (mostly a to z, or mostly other letters). Documents of other languages are
judged by the base rules alone, as short ones are.

Repeated words are found within the row: each 8-word window gets a 64-bit hash; if all differ the document has none,
else hashes are sorted with their places, and runs mark the windows. Two windows of one text that share a hash by
chance would count as equal, which 64 bits leave out of account.

Defined cases: null and empty texts have no words and fail the base rules; a null language is used in no reference;
repeated rows give equal results; very long texts are measured whole, within their row; a distance equal to the limit
keeps; languages of equally many words are ordered by name; an empty table gives an empty table; other columns don't
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, let, table, word_list

#: Fixed by the contract of the query.
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = r"[#*$%&|<>]"

GUARD_CHARS, GUARD_WORDS, REFERENCE_WORDS = 100, 40, 2_000
#: The two distances may sum to FAR, and as short texts scatter more, to FAR_BY_LENGTH / n_words above it.
FAR, FAR_BY_LENGTH = 0.38, 7.0
#: Languages that every document is compared with: those with the most words. Others speak for their own documents.
LARGEST = 200
#: References of more languages than these two arrays each are joined by a shuffle, fewer are sent to all tasks.
SENT = 10_000
#: Of the characters of a reference document's words, at most so many in a hundred are symbols, and capitals.
PLAIN_SYMBOLS, PLAIN_CAPITALS = 1, 25

#: Frequent function words of English, German, French and Spanish.
COMMON = (
    "the of and to in a is that it for on was as with be by are this at from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "de la le et les en un du une que est pour qui dans par pas au sur "
    "el y los se del las por con no su para es al lo"
).split()
#: A common word becomes one character, so that a text's common words are a short string.
MARKS = [chr(0x21 + i) for i in range(len(COMMON))]
CLASSES = ("gap", "lower", "upper", "letter", "digit", "mark", "symbol")


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of WINDOW words that the text has twice or more."""

    def covered(places: Column) -> Column:
        n = F.size(places)
        return F.aggregate(F.transform(places, lambda x, i: F.when(i + 1 < n, F.least(F.lit(WINDOW), F.get(places, i + 1) - x)).otherwise(WINDOW)), F.lit(0), lambda a, x: a + x)

    def runs(pairs: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(pairs, i)["h"] == e["h"], F.lit(False))
        found = F.filter(pairs, lambda e, i: same(e, i + 1) | (F.when(i > 0, same(e, i - 1)).otherwise(False)))
        return let(F.sort_array(F.transform(found, lambda e: e["i"])), covered)

    def some(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, runs))

    def of(words: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
        return F.when(F.size(words) < WINDOW, 0).otherwise(let(hashes, some))

    return let(words, of).cast("long")  # else the optimizer may put what makes the words inside the lambda


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` with base figures and histograms: ``classes`` and ``common`` (the last cell: all other words)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*keep, text.alias("_text"), word_list(F.col("text")).alias("_words"))
    d = d.select("*", F.array_join("_words", "").alias("_solid"))
    d = d.select("*", F.regexp_replace("_solid", "[a-z]+", "").alias("_rest"))
    mark = F.create_map(*(x for w, m in zip(COMMON, MARKS, strict=True) for x in (F.lit(w), F.lit(m))))
    marked = F.array_join(F.transform(F.filter("_words", lambda w: w.isin(*COMMON)), lambda w: mark[w]), "")
    solid, rest = F.length("_solid"), F.length("_rest")
    kinds = {"upper": r"\p{Lu}", "letter": r"[\p{L}\p{M}&&[^a-z\p{Lu}]]", "digit": r"\p{Nd}", "mark": r"""[.,;:!?'"()\[\]\-–—’“”«»¿¡]"""}
    d = d.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        solid.cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("_rest", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        dup_lines(F.col("_text")).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        (F.length("_text") - solid).alias("gap"), (solid - rest).alias("lower"), rest.alias("_left"),
        *(F.regexp_count("_rest", F.lit(r)).alias(k) for k, r in kinds.items()),
        let(marked, lambda s: F.transform(F.array(*map(F.lit, MARKS)), lambda m: F.length(s) - F.length(F.replace(s, m, F.lit(""))))).alias("_common"),
    )
    symbol = F.col("_left") - sum(F.col(k) for k in kinds)
    rare = F.col("n_words").cast("int") - F.aggregate("_common", F.lit(0), lambda a, x: a + x)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.array(*(F.col(k) for k in CLASSES[:-1]), symbol).alias("classes"), F.concat("_common", F.array(rare)).alias("common"),
    )


def references(figures: DataFrame) -> tuple[dict[str, tuple[list[float], list[float]]], DataFrame | None]:
    """Shares of the classes and of the common words by language: of the LARGEST, and of the others (lang, chars, words), if any."""
    plain = (100 * F.col("n_symbols") <= PLAIN_SYMBOLS * F.col("word_chars")) & (100 * F.col("classes")[CLASSES.index("upper")] <= PLAIN_CAPITALS * F.col("word_chars"))
    fit = F.col("lang").isNotNull() & ~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS) & plain
    # explode, not filter: a filter is pushed below the figures, which are then computed for it and once more for the sums
    cells = figures.select("lang", F.posexplode(F.when(fit, F.concat("classes", "common"))).alias("cell", "k")).groupBy("lang", "cell").agg(F.sum("k").alias("k"))
    by_lang = cells.groupBy("lang").agg(F.sum(F.when(F.col("cell") >= len(CLASSES), F.col("k"))).alias("n"), F.sort_array(F.collect_list(F.struct("cell", "k")))["k"].alias("counts"))
    by_lang = checkpointed(by_lang.filter(F.col("n") >= REFERENCE_WORDS))
    rows = by_lang.orderBy(F.col("n").desc(), "lang").limit(LARGEST).collect()
    share = lambda x: [v / sum(x) for v in x]
    largest = {r["lang"]: (share(r["counts"][: len(CLASSES)]), share(r["counts"][len(CLASSES) :])) for r in rows}
    n_more = by_lang.count() - len(rows)
    if not n_more:
        return largest, None
    shares = lambda x: let(x, lambda v: F.transform(v, lambda k: k / F.aggregate(v, F.lit(0).cast("long"), lambda a, y: a + y)))
    more = by_lang.filter(~F.col("lang").isin(*largest)).select("lang", shares(F.slice("counts", 1, len(CLASSES))).alias("chars"), shares(F.slice("counts", len(CLASSES) + 1, len(COMMON) + 1)).alias("words"))
    return largest, F.broadcast(more) if n_more <= SENT else more


def distance(counts: Column, reference: list[float] | Column) -> Column:
    """Jensen-Shannon distance of a histogram from a reference; 0 if the histogram is empty."""
    shares = reference if isinstance(reference, Column) else F.array(*map(F.lit, reference))

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(p) + part(q)) / 2

    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    of = lambda n: F.aggregate(F.zip_with(counts, shares, lambda c, q: term(c / n, q)), F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda n: F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), of(n)))).otherwise(0.0))


def _other_script(shares: list[float]) -> bool:
    cells = dict(zip(CLASSES, shares, strict=True))
    return cells["letter"] > cells["lower"] + cells["upper"]


def other_script(classes: Column) -> Column:
    """Whether most letters of a histogram are neither a to z nor capitals."""
    cell = lambda k: classes[CLASSES.index(k)]
    return cell("letter") > cell("lower") + cell("upper")


def verdicts(figures: DataFrame, known: tuple[dict[str, tuple[list[float], list[float]]], DataFrame | None], *keep: str) -> DataFrame:
    """Columns ``keep`` of what ``measured`` gives (lang among its own) with the base figures, the least distances and ``kept``."""
    short = (F.col("word_chars") < GUARD_CHARS) | (F.col("n_words") < GUARD_WORDS)
    largest, more = known
    far = lambda a, b: F.struct(distance(F.col("classes"), a).alias("chars"), distance(F.col("common"), b).alias("words"))
    if largest:
        pairs = F.array(*(far(a, b) for a, b in largest.values()))
        limit = FAR + FAR_BY_LENGTH / F.greatest(F.col("n_words"), F.lit(1))
        spoken_for = F.col("lang").isin(*largest)
        if more is not None:
            figures = figures.join(more.select(F.col("lang").alias("_lang"), F.col("chars").alias("_chars"), F.col("words").alias("_words")), F.col("lang") == F.col("_lang"), "left")
            own = F.col("_lang").isNotNull()
            pairs = F.when(own, F.array_append(pairs, far(F.col("_chars"), F.col("_words")))).otherwise(pairs)
            spoken_for = spoken_for | own
        alien = F.coalesce(~spoken_for, ~other_script(F.col("classes")).isin(*{_other_script(a) for a, _ in largest.values()}))
        near = short | alien | F.exists("_far", lambda d: d["chars"] + d["words"] <= limit)
        figures = figures.withColumn("_far", pairs).withColumn("_near", near)
    else:
        figures = figures.withColumn("_far", F.array(F.struct(F.lit(0.0).alias("chars"), F.lit(0.0).alias("words")))).withColumn("_near", F.lit(True))
    least = lambda k: F.array_min(F.transform("_far", lambda d: d[k])).alias(f"far_{k}")
    return figures.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("_near")).alias("kept"), least("chars"), least("words"))


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """Verdicts on docs (text, lang and the columns ``keep``, which should be short: they are checkpointed)."""
    figures = checkpointed(measured(docs, *dict.fromkeys([*keep, "lang"])))  # for the references and the verdicts
    return verdicts(figures, references(figures), *keep)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs (text, lang and any others) that the rules keep, unchanged.

    The texts are measured twice, for the references and for the verdicts: that costs no disk and no shuffle of texts.
    """
    known = references(measured(docs.select("text", "lang"), "lang"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text", "lang")
    judged = verdicts(measured(rows, "_row", "lang"), known, "_row")
    # explode, not filter, for the same reason as above
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return judged.withColumns({c: F.round(c, 4) for c in ("far_chars", "far_words")})
