"""Operator 13: URL filters whose block decisions follow redirects and canonical links. No Python workers anywhere.

A rule names a host and the beginning of a path. It fits that host and all its subdomains; of the rules that fit an
address the longest decides (of equally long ones that which allows). Addresses that redirects or canonical links join
are aliases: connected components over these links, found by contraction. An address without a rule of its own is blocked
if an alias is blocked by a rule and none is allowed by one; an explicit allow so takes precedence, on the address itself
and among its aliases. All other addresses are allowed.

Links come out of the pages (``<link rel=canonical>``, ``<meta http-equiv=refresh>``, outside comments, scripts and the
like; a tag ends at its first ``>``) and, where given, out of a table of redirects. Targets needn't be pages themselves.
Addresses are compared without their fragment, scheme and host in lower case; relative ones are resolved against the
page. ``<base>`` isn't followed.

Components: every address hooks to the least of its neighbours and itself, hooks are followed twice, and links are
rewritten to where their ends lead. At least half of the addresses with links are gone after each round, so rounds grow
with the logarithm of a component's size; each round's links are stored. A third of all links at one address is a skewed
join, which adaptive execution splits, and minima that are combined before the shuffle.

Defined cases: a null address or one without ``://`` has an empty host and path, no rule and no aliases, and is allowed;
a null page has no links; links to the page itself, to other schemes and without a target count for nothing; repeated
rows get the same verdict; ``page_id`` may be null or repeated; very long pages and addresses go whole; empty tables give
empty tables; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rules given as a sequence become one expression; more than these come as a table.
MOST_IN_ONE = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIDDEN = r"(?is)<!--.*?(?:-->|\z)" + "".join(rf"|<{t}\b.*?(?:</{t}\s*>|\z)" for t in "script style template noscript textarea title xmp iframe".split())
TAGS = r"(?is)<(?:link|meta)\s[^>]*>"


def address(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """What stands for an address among its aliases; null for none."""
    head, host = F.regexp_extract(url, r"(?s)^(.*?)://", 1), address(url)[0]
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.translate(head, UPPER, LOWER), F.lit("://"), host, rest))


def key(text: Column) -> Column:
    """128 bits of an address's digest: links are compared by it."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def by_list(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MOST_IN_ONE:
        raise ValueError("give this many rules as a table")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    found = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path) with ``fits``: (rule, verdict) of the longest that fits, else null. rules: host, path, verdict.

    An address meets the rules' hosts by its own host's ends, then the rules themselves by the beginnings of its path
    that are as long as a path of such a rule, so it never meets rules that don't fit. Works on different (host, path).
    """
    rules = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict").distinct()
    lengths = rules.groupBy("h").agg(F.collect_set(F.length("p")).alias("lengths"))  # a path's length is bounded, so is the set
    host_ends = F.expr(r"transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    different = urls.select("host", "path").distinct()
    ends = different.select("*", F.explode(host_ends).alias("h"))
    begun = ends.join(lengths, "h").select("host", "path", "h", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("path")).withColumn("p", F.expr("left(path, n)"))
    found = begun.join(rules, ["h", "p"]).groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("h", "p")), (F.col("verdict") == "allow"), F.concat("h", "p").alias("rule"), "verdict")).alias("x"))
    return urls.join(found.select("host", "path", F.struct("x.rule", "x.verdict").alias("fits")), ["host", "path"], "left")


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag; the empty string if it has none."""
    parts = [F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", i) for i in (1, 2, 3)]
    return F.concat(*parts)


def unescaped(value: Column) -> Column:
    """The few character references that addresses are written with."""
    for name, char in (("&quot;|&#34;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;|&#38;|&#x26;", "&")):
        value = F.regexp_replace(value, name, char)
    return F.trim(value)


def resolved(target: Column, url: Column) -> Column:
    """An address, relative to that of its page; null if it leads nowhere."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = address(url)[1]
    folder = F.concat(root, F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1)))
    full = (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target)).when(target.startswith("?"), F.concat(root, path, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (target == "") | target.startswith("#"), F.lit(None)).otherwise(F.concat(folder, target))
    )
    before, way, after = (F.regexp_extract(full, r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3))
    steps = F.aggregate(
        F.split(way, "/"), F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)).otherwise(F.concat(done, F.array(x))),
    )
    plain = F.concat(before, F.array_join(steps, "/"), F.when(way.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")), after)
    return F.when(F.concat(F.lit("/"), way, F.lit("/")).rlike(r"/\.\.?/"), plain).otherwise(full)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """source, target: addresses that pages say are theirs or lead to, as nodes."""
    marked = pages.filter(F.col(url).contains("://") & F.col(html).rlike(r"(?i)canonical|refresh"))
    tags = marked.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(F.regexp_replace(F.col(html), HIDDEN, " "), F.lit(TAGS), 0)).alias("tag"))
    canonical = F.col("tag").rlike(r"(?i)^<link\s") & F.array_contains(F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    refresh = F.col("tag").rlike(r"(?i)^<meta\s") & (F.lower(F.trim(attribute(F.col("tag"), "http-equiv"))) == "refresh")
    goes_to = F.regexp_extract(attribute(F.col("tag"), "content"), r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    target = unescaped(F.when(canonical, attribute(F.col("tag"), "href")).when(refresh, goes_to))
    return tags.select(node(F.col("url")).alias("source"), node(resolved(target, F.col("url"))).alias("target")).filter("target is not null")


def components(pairs: DataFrame) -> DataFrame:
    """node, label for every end of the pairs (a, b): the same label within a component. Contraction, see above."""
    both = lambda df: df.filter("a <> b").select("a", "b").unionByName(df.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left = checkpointed(both(pairs))
    names = left.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while not left.isEmpty():
        hook = checkpointed(left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to")))
        next_hook = hook.select(F.col("from").alias("to"), F.col("to").alias("then"))
        hook = checkpointed(hook.join(next_hook, "to").select("from", F.col("then").alias("to")))
        to = lambda c: hook.select(F.col("from").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        names = checkpointed(names.join(to("label"), "label", "left").select("node", F.coalesce("label_to", "label").alias("label")))
        left = checkpointed(both(left.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))))
    return names


def alias_verdicts(found: DataFrame, fits: DataFrame) -> DataFrame:
    """node, verdict of every address with aliases. found: source, target; fits: node, verdict (of rules, or null)."""
    pairs = checkpointed(found.filter("source <> target").select(key(F.col("source")).alias("a"), key(F.col("target")).alias("b")).distinct())
    of = components(pairs)
    says = fits.filter("verdict is not null").select(key(F.col("node")).alias("node"), "verdict").distinct()
    told = of.join(says, "node").groupBy("label").agg(F.bool_or(F.col("verdict") == "allow").alias("allowed"), F.bool_or(F.col("verdict") == "block").alias("blocked"))
    return of.join(told, "label").select("node", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url, html). redirects: source, target (addresses)."""

    def ruled(df: DataFrame, url: str) -> DataFrame:
        host, path = address(F.col(url))
        df = df.withColumns({"host": host, "path": path})
        return by_table(df, rules) if isinstance(rules, DataFrame) else df.withColumn("fits", by_list(F.col("host"), F.col("path"), rules))

    found = links(pages)
    if redirects is not None:
        found = found.unionByName(redirects.select(node(F.col("source")).alias("source"), node(F.col("target")).alias("target")).dropna())
    found = checkpointed(found)
    rows = ruled(pages.select("page_id", "url"), "url")
    out = lambda other: ["page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce(F.col("fits.verdict"), other, F.lit("allow")).alias("verdict")]
    if found.isEmpty():
        return rows.select(*out(F.lit(None).cast("string")))
    ends = found.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    aliases = alias_verdicts(found, ruled(ends, "node").select("node", F.col("fits.verdict").alias("verdict")))
    aliases = aliases.select(F.col("node").alias("_node"), F.col("verdict").alias("alias"))
    return rows.withColumn("_node", key(node(F.col("url")))).join(aliases, "_node", "left").select(*out(F.col("alias")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
