"""Operator 4: secret scans with multipart credential linking.

Base spans (password assignments, access keys, long hex runs) are always reported. Parts that mean nothing alone
(user or key names, random-looking strings, endpoints) are candidates: an interval join within a text links each to
the parts of the other roles whose scopes it meets, and only those with a complement are reported:

* an identifier or an endpoint needs a secret in its scope; an endpoint needs an identifier there too;
* a random-looking string needs an identifier or an endpoint in its scope.

A scope is the paragraph (between blank lines) around a part, at most SCOPE code points to either side. The join is a
search in the sorted starts of a role, so a text with p parts takes O(p log p), and no pairs are listed.

Defined cases: a null text counts as empty (no spans); very long texts are searched whole; spans that begin together are
all reported, in the order of KINDS; other columns and clashing names don't matter, as only ``text``
and the kept columns are read; equal rows give equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Fixed by the contract of the query: kinds in order, and what their base spans are.
KINDS = ("assign", "access", "hex", "user", "random", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ of 24 or more is the same: runs can't begin inside a run
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Candidates of the method.
SCOPE = 240
USER = re.compile(r"""\b(?:user(?:_?name)?|login|account|client_?id|(?:access_?)?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
USER_WORDS = ("user", "login", "account", "clientid", "client_id", "keyid", "key_id")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{3,}(?::\d{2,5})?)""", re.I | re.A)
ENDPOINT_WORDS = ("://", "host", "endpoint", "server")
LEAST_BITS = 3.5

SPAN = "array<struct<kind:string,start:int,end:int>>"


def _upper_random(value: str) -> bool:
    """Whether a string mixes upper case, lower case and digits and its characters carry LEAST_BITS each."""
    if not (any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value) and any("0" <= c <= "9" for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LEAST_BITS


def base_spans(text: str, lower: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans; lower is the text in lower case, to skip searches that can't find any."""
    found = []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def linked_spans(text: str, lower: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The candidates that have their complements in scope."""
    users = [(m.start(), m.end()) for m in USER.finditer(text)] if any(w in lower for w in USER_WORDS) else []
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if any(w in lower for w in ENDPOINT_WORDS) else []
    if not users and not ends and not any(k == 1 for _, k, _ in base):
        return []
    covered = sorted((a, b) for a, _, b in base) + [(len(text) + 1, len(text) + 1)]
    taken = sorted([*covered, *users, *ends])
    starts, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else b))
    meets = lambda a, b: (i := bisect_left(starts, b)) > 0 and reach[i - 1] > a
    randoms = [(m.start(), m.end()) for m in RANDOM.finditer(text) if not meets(m.start(), m.end()) and _upper_random(m[0])]
    names = sorted([*users, *((a, b) for a, k, b in base if k == 1)])
    secrets = sorted([*randoms, *((a, b) for a, k, b in base if k != 1)])
    ends.sort()
    paragraphs = [0, *(m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)), len(text) + 1]

    ends_before = {id(role): list(accumulate((b for _, b in role), max)) for role in (names, secrets, ends)}

    def scope(a: int, b: int) -> tuple[int, int]:
        i = bisect_left(paragraphs, a + 1) - 1
        j = bisect_left(paragraphs, b)
        return max(a - SCOPE, paragraphs[i]), min(b + SCOPE, paragraphs[j] if j < len(paragraphs) else b + SCOPE)

    def joined(role: list[tuple[int, int]], a: int, b: int) -> bool:
        """Whether a part of the role, other than (a, b), lies in the scope of (a, b) or reaches into it."""
        low, high = scope(a, b)
        i, j = bisect_left(role, (low,)), bisect_left(role, (high,))
        if i and ends_before[id(role)][i - 1] > low:
            return True
        return j - i > ((a, b) in role[i : i + 1] or (j - i <= 2 and (a, b) in role[i:j]))

    found = [(a, 3, b) for a, b in users if joined(secrets, a, b)]
    found += [(a, 4, b) for a, b in randoms if joined(names, a, b) or joined(ends, a, b)]
    found += [(a, 5, b) for a, b in ends if joined(secrets, a, b) and joined(names, a, b)]
    return found


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span of a text, in that order."""
    lower = text.lower()
    base = base_spans(text, lower)
    return sorted(base + linked_spans(text, lower, base))


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of df and ``spans``, an array of (kind, start, end): code points, end exclusive."""
    kinds = dict(df.dtypes)

    def start() -> Callable[..., tuple]:
        return lambda value, *kept: (*kept, [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(value or "")])

    return map_rows(df.select(text, *keep), ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"spans {SPAN}"]), start)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every span of its text replaced by a mark; overlapping spans get one. Null texts stay null."""
    names = df.columns
    kinds = dict(df.dtypes)

    def start() -> Callable[..., tuple]:
        def row(*values: object) -> tuple:
            at = names.index(text)
            value = values[at]
            if not value:
                return values
            out, done = [], 0
            for a, _, b in all_spans(value):
                if a >= done:
                    out += [value[done:a], mark]
                done = max(done, b)
            return (*values[:at], "".join(out) + value[done:], *values[at + 1 :])

        return row

    return map_rows(df, ", ".join(f"`{n}` {kinds[n]}" for n in names), start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

