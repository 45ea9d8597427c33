"""DuckDB SQL for the queries that SQL can express; the others are tested in tests/llm."""

from __future__ import annotations

from . import importance, mixing, prefix_trie, quality, url_filter

WORDS = r"'[^\x20\x09-\x0D]+'"


def quality_sql() -> str:
    """Base figures by grouping windows of words; histograms as rows; references pooled from them; distances by cells."""
    common = ", ".join(f"('{w}', {i})" for i, w in enumerate(quality.COMMON))
    rest = len(quality.COMMON)
    classes = ("gap", "lower", "upper", "letter", "digit", "mark", "symbol")
    marks = r"""[.,;:!?''"()\[\]\-–—’“”«»¿¡]"""
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents),
w AS (SELECT *, len(words) AS n_words, array_to_string(words, '') AS solid, regexp_replace(array_to_string(words, ''), '[a-z]+', '', 'g') AS left_over FROM t),
wi AS (SELECT doc_id, unnest(range(1, n_words - 6)) AS i, words FROM w WHERE n_words >= 8),
wk AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], ' ')) AS k FROM wi),
rp AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM wk, (SELECT unnest(range(0, 8)) AS o) WHERE k > 1 GROUP BY 1),
li AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, {WORDS}) GROUP BY 1),
f AS (SELECT w.doc_id, lang, n_words, words, length(solid) AS word_chars, len(regexp_extract_all(left_over, '{quality.SYMBOLS}')) AS n_symbols, coalesce(li.n, 0) AS n_dup_lines, coalesce(rp.n, 0) AS n_repeat_words,
  length(text) - length(solid) AS gap, length(solid) - length(left_over) AS lower, length(left_over) AS lo, len(regexp_extract_all(left_over, '\p{{Lu}}')) AS upper, len(regexp_extract_all(left_over, '[\p{{L}}\p{{M}}]')) AS any_letter,
  len(regexp_extract_all(left_over, '\p{{Nd}}')) AS digit, len(regexp_extract_all(left_over, '{marks}')) AS mark FROM w LEFT JOIN rp USING (doc_id) LEFT JOIN li USING (doc_id)),
g AS (SELECT *, any_letter - upper AS letter, lo - any_letter - digit - mark AS symbol, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEATED_PERCENT} * n_words AS base_failed FROM f),
co AS (SELECT word, k FROM (VALUES {common}) v(word, k)),
cw AS (SELECT doc_id, coalesce(k, {rest}) AS k, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM g) LEFT JOIN co USING (word) GROUP BY 1, 2),
cc AS (SELECT doc_id, unnest(['{"', '".join(classes)}']) AS k, unnest([{", ".join(classes)}]) AS n FROM g),
fit AS (SELECT doc_id, lang, n_words FROM g WHERE lang IS NOT NULL AND NOT base_failed AND n_words >= {quality.GUARD_WORDS} AND 100 * n_symbols <= {quality.PLAIN_SYMBOLS} * word_chars AND 100 * upper <= {quality.PLAIN_CAPITALS} * word_chars),
la AS (SELECT lang FROM fit GROUP BY 1 HAVING sum(n_words) >= {quality.REFERENCE_WORDS}),
ks AS (SELECT unnest(range(0, {rest + 1})) AS k), kc AS (SELECT unnest(['{"', '".join(classes)}']) AS k),
rw AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM (SELECT la.lang, ks.k, coalesce(sum(cw.n), 0) AS n FROM la CROSS JOIN ks LEFT JOIN fit ON fit.lang = la.lang LEFT JOIN cw ON cw.doc_id = fit.doc_id AND cw.k = ks.k GROUP BY 1, 2)),
rc AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM (SELECT fit.lang, cc.k, sum(cc.n) AS n FROM fit JOIN cc USING (doc_id) JOIN la ON la.lang = fit.lang GROUP BY 1, 2)),
pw AS (SELECT g.doc_id, rw.lang, coalesce(cw.n, 0) / nullif(g.n_words, 0)::DOUBLE AS p, q FROM g CROSS JOIN rw LEFT JOIN cw ON cw.doc_id = g.doc_id AND cw.k = rw.k),
pc AS (SELECT doc_id, lang, p / nullif(s, 0)::DOUBLE AS p, q FROM (SELECT cc.doc_id, rc.lang, cc.n AS p, sum(cc.n) OVER (PARTITION BY cc.doc_id, rc.lang) AS s, q FROM cc JOIN rc USING (k))),
js AS (SELECT doc_id, lang, kind, coalesce(sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))), 0) AS d
  FROM (SELECT *, 'w' AS kind FROM pw UNION ALL SELECT *, 'c' FROM pc) WHERE p IS NOT NULL GROUP BY 1, 2, 3),
dl AS (SELECT g.doc_id, la.lang, coalesce((SELECT d FROM js WHERE js.doc_id = g.doc_id AND js.lang = la.lang AND kind = 'c'), 0) AS c, coalesce((SELECT d FROM js WHERE js.doc_id = g.doc_id AND js.lang = la.lang AND kind = 'w'), 0) AS w FROM g CROSS JOIN la),
dm AS (SELECT doc_id, min(c) AS c, min(w) AS w, min(c + w) AS s FROM dl GROUP BY 1)
SELECT g.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (word_chars < {quality.GUARD_CHARS} OR n_words < {quality.GUARD_WORDS} OR coalesce(s, 0) <= {quality.FAR} + {quality.FAR_BY_LENGTH} / greatest(n_words, 1)) AS kept,
  round(coalesce(c, 0), 4) AS far_chars, round(coalesce(w, 0), 4) AS far_words FROM g LEFT JOIN dm USING (doc_id)"""


def mixing_sql() -> str:
    """All quotients of the divisor method are listed and ranked; the ring of a shard is cut by the same seeded numbers."""
    draw = lambda x: f"CAST('0x' || substr(md5({x}), 1, 13) AS BIGINT)"
    weights = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    return rf"""
WITH sz AS (SELECT doc_id, source, md5(coalesce(text, '')) AS rk, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS ss FROM sz GROUP BY 1),
s1 AS (SELECT *, {weights}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS INT)] AS wt, {mixing.MOST} * ss AS cap FROM s0),
s2 AS (SELECT *, CAST(sum(ss) OVER () AS BIGINT) AS total, CAST(sum(wt) OVER () AS BIGINT) AS wts, CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS cb, CAST(coalesce(sum(wt) OVER o, 0) AS BIGINT) AS wb FROM s1 WINDOW o AS (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total - cb) / (wts - wb) AS lv FROM s2),
s4 AS (SELECT *, (SELECT first(lv ORDER BY cap / wt, lv) FROM s3 WHERE cap > lv * wt) AS level FROM s3),
s5 AS (SELECT source, n_docs, ss, CASE WHEN level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), level * wt) END AS target FROM s4),
s6 AS (SELECT *, greatest(1, CAST(ceil((SELECT sum(ss) FROM s5) / {mixing.BLOCKS}) AS BIGINT)) AS block, CAST(ceil(n_docs / {mixing.SHARD_ROWS}) AS BIGINT) AS shards, (SELECT sum(target) FROM s5) AS aim FROM s5),
s7 AS (SELECT *, CAST(round(aim / block) AS BIGINT) AS seats FROM s6),
qu AS (SELECT source, target / (2 * k + 1) AS q FROM s7, LATERAL (SELECT unnest(range(0, CAST(ceil(target * seats / nullif(aim, 0)) AS BIGINT) + 50)) AS k) WHERE target > 0),
qr AS (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST) AS r FROM qu),
qs AS (SELECT source, count(*) AS quota FROM qr WHERE r <= (SELECT max(seats) FROM s7) GROUP BY 1),
pl AS (SELECT d.doc_id, d.source, d.rk, d.size, s.ss, s.target, s.block, coalesce(q.quota, 0) AS quota, {draw(f"concat_ws(':', '{mixing.SEED}', CAST(d.doc_id AS VARCHAR), d.rk)")} AS draw, s.shards FROM sz d JOIN s7 s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN qs q ON q.source IS NOT DISTINCT FROM d.source),
pp AS (SELECT *, draw % shards AS shard FROM pl),
sh AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS ring, max(quota) AS quota FROM pp GROUP BY 1, 2),
hq AS (SELECT source, shard, quota, ring / (2 * k + 1) AS q FROM sh, LATERAL (SELECT unnest(range(0, quota + 1)) AS k) WHERE ring > 0),
hr AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS r FROM hq),
hs AS (SELECT source, shard, count(*) AS quota FROM hr WHERE r <= quota GROUP BY 1, 2),
ro AS (SELECT p.*, sh.ring, least(coalesce(hs.quota, 0) * block, {mixing.MOST} * sh.ring) AS tokens, CAST(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY draw, doc_id, rk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM pp p JOIN sh ON sh.source IS NOT DISTINCT FROM p.source AND sh.shard = p.shard LEFT JOIN hs ON hs.source IS NOT DISTINCT FROM p.source AND hs.shard = p.shard),
rr AS (SELECT *, e - size AS b, CASE WHEN ring > 0 THEN tokens // ring ELSE 0 END AS turns, CASE WHEN ring > 0 THEN tokens % ring ELSE 0 END AS rest,
  ({draw(f"concat_ws(':', '{mixing.SEED}', 'start', coalesce(source, chr(0) || 'null'), CAST(shard AS VARCHAR))")} % greatest(1, CAST(ceil(ring / block) AS BIGINT))) * block AS fr FROM ro)
SELECT doc_id, size, ss AS source_size, target, CAST(turns * size + greatest(0, least(e, least(fr + rest, ring)) - greatest(b, fr)) + greatest(0, least(e, fr + rest - ring) - greatest(b, 0)) AS BIGINT) AS taken, source FROM rr"""


def warc_sql() -> str:
    """Digests by sha1, spelt in base 32 five bits at a time."""
    bits = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][CAST('0x' || c AS INT) + 1]), '')"
    five = "(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT))"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, {bits} AS bits, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {five} + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last_id THEN last_id END AS refers_to, url FROM p"""


def crc_sql(x: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit."""
    bytes_of = f"list_transform(range(0, strlen({x})), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i + 1, 2) AS BIGINT))"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_of}), lambda c, b: {step}))"


def importance_sql() -> str:
    """Features listed, hashed once each, counted by bucket on both sides; the highest scores by one window."""
    n, scale = importance.BUCKETS, importance.SCALE
    runs = "w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
fd AS (SELECT r, unnest(list_concat({runs})) AS f FROM d), fb AS (SELECT unnest(list_concat({runs})) AS f FROM b),
h AS (SELECT f, {crc_sql("f")} % {n} AS k FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
s AS (SELECT k, count(*) AS s FROM fd JOIN h USING (f) GROUP BY 1), t AS (SELECT k, count(*) AS t FROM fb JOIN h USING (f) GROUP BY 1),
g AS (SELECT k, CAST(floor({scale} * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {n})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {n})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(0, {n})) AS k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
w AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight, count(*) AS n FROM fd JOIN h USING (f) JOIN g USING (k) GROUP BY 1),
c AS (SELECT doc_id, len(d.w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST(floor(-{scale} * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS luck FROM d LEFT JOIN w USING (r)),
o AS (SELECT *, weight + luck AS score, words >= {importance.LEAST_WORDS} AS may FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY may) AS eligible FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= {importance.PERCENT} * eligible // 100 THEN place END AS rank FROM p"""


def url_filter_sql() -> str:
    """Links by expressions, aliases by what can be reached, rules by a join."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    hidden = url_filter.HIDDEN.replace("(?is)", "")
    get = lambda x, p, g=1, o="is": f"regexp_extract({x}, '{p}', {g}, '{o}')"
    low = lambda x: f"translate({x}, '{url_filter.UPPER}', '{url_filter.LOWER}')"
    value = lambda name: "concat(" + ", ".join(get("tag", rf"""\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))""", i) for i in (1, 2, 3)) + ")"
    node = lambda x: f"CASE WHEN contains({x}, '://') THEN concat({low(get(x, '^(.*?)://'))}, '://', {low(get(x, '^.*?://([^/?#]*)'))}, {get(x, '^.*?://[^/?#]*([^#]*)')}) END"
    parts = lambda x: f"{low(get(x, '^.*?://([^/?#]*)'))} AS host, {get(x, '^.*?://[^/?#]*([^?#]*)')} AS path"
    plain = "goes"
    for name, char in (("&quot;|&#34;", '"'), ("&#39;|&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;|&#38;|&#x26;", "&")):
        plain = f"regexp_replace({plain}, '{name}', '{char}', 'g')"
    goes_to = get(value("content"), r"""^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"'']*)""")
    steps = "list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(way, '/'), lambda x: [x])), lambda done, x: CASE WHEN x[1] = '.' THEN done WHEN x[1] = '..' THEN CASE WHEN len(done) > 1 THEN done[:len(done) - 1] ELSE done END ELSE list_concat(done, x) END)"
    return rf"""
WITH RECURSIVE r(h, p, v) AS (VALUES {rules}),
m AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{hidden}', ' ', 'gis'), '<(?:link|meta)\s[^>]*>', 0, 'is')) AS tag FROM pages WHERE contains(url, '://') AND regexp_matches(html, 'canonical|refresh', 'i')),
g AS (SELECT url, CASE WHEN regexp_matches(tag, '^<link\s', 'i') AND list_contains(regexp_split_to_array(lower({value("rel")}), '\s+'), 'canonical') THEN {value("href")}
  WHEN regexp_matches(tag, '^<meta\s', 'i') AND lower(trim({value("http-equiv")})) = 'refresh' THEN {goes_to} END AS goes FROM m),
t AS (SELECT url, trim({plain}) AS goes, {get("url", "^(.*?)://")} AS scheme, {get("url", "^(.*?://[^/?#]*)")} AS root, {get("url", "^.*?://[^/?#]*([^?#]*)")} AS path FROM g),
u AS (SELECT url, CASE WHEN regexp_matches(goes, '^[A-Za-z][A-Za-z0-9+.-]*://', 's') THEN goes WHEN starts_with(goes, '//') THEN concat(scheme, ':', goes) WHEN starts_with(goes, '/') THEN concat(root, goes) WHEN starts_with(goes, '?') THEN concat(root, path, goes)
  WHEN regexp_matches(goes, '^[A-Za-z][A-Za-z0-9+.-]*:') OR goes = '' OR starts_with(goes, '#') THEN NULL WHEN goes IS NOT NULL THEN concat(root, CASE WHEN path = '' THEN '/' ELSE {get("path", "^(.*/)")} END, goes) END AS far FROM t),
w AS (SELECT url, far, {get("far", "^(.*?://[^/?#]*)([^?#]*)(.*)$", 1)} AS b, {get("far", "^(.*?://[^/?#]*)([^?#]*)(.*)$", 2)} AS way, {get("far", "^(.*?://[^/?#]*)([^?#]*)(.*)$", 3)} AS a FROM u),
x AS (SELECT url, CASE WHEN regexp_matches(concat('/', way, '/'), '/\.\.?/') THEN concat(b, array_to_string({steps}, '/'), CASE WHEN regexp_matches(way, '/\.\.?$') THEN '/' ELSE '' END, a) ELSE far END AS far FROM w WHERE far IS NOT NULL),
e AS (SELECT {node("url")} AS s, {node("far")} AS t FROM x),
l AS (SELECT s AS a, t AS b FROM e UNION SELECT t, s FROM e),
c(a, b) AS (SELECT a, a FROM l UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
n AS (SELECT node, {parts("node")} FROM (SELECT DISTINCT b AS node FROM c)),
nv AS (SELECT node, arg_max(v, (strlen(h || p), v = 'allow')) AS v FROM n JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
av AS (SELECT a AS node, CASE WHEN bool_or(v = 'block') AND NOT bool_or(v = 'allow') THEN 'block' ELSE 'allow' END AS v FROM c JOIN nv ON nv.node = c.b GROUP BY 1),
pg AS (SELECT row_number() OVER () AS i, page_id, {parts("coalesce(url, '')")}, {node("url")} AS node FROM pages),
pv AS (SELECT i, arg_max((h || p, v), (strlen(h || p), v = 'allow')) AS f FROM pg JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, f[1] AS rule, coalesce(f[2], av.v, 'allow') AS verdict FROM pg LEFT JOIN pv USING (i) LEFT JOIN av USING (node)"""


def prefix_trie_sql() -> str:
    """All nodes by grouping chained digests; each node's subtree by the paths of its members' smallest."""
    fam = prefix_trie.FAMILY
    return f"""
WITH t AS (SELECT conv_id, strlen(coalesce(text, '')) AS b, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS e, turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, e) AS pos FROM t),
z AS (SELECT conv_id, count(*) AS n FROM n GROUP BY 1),
c AS (SELECT z.conv_id AS c, f.conv_id AS f, CASE WHEN z.conv_id % {fam} = 0 THEN 0 ELSE {crc_sql("CAST(z.conv_id AS VARCHAR)")} % {prefix_trie.BORROWED} END AS h, coalesce(f.n, 0) AS lent FROM z LEFT JOIN z f ON f.conv_id = z.conv_id - z.conv_id % {fam}),
r AS (SELECT c, pos AS d, e, b FROM c JOIN n ON n.conv_id = c.f AND pos <= h UNION ALL SELECT c, least(h, lent) + pos - h, e, b FROM c JOIN n ON n.conv_id = c.c AND pos > h),
p AS (SELECT c, d, b, md5(string_agg(e, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM c),
q AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS pk, d = max(d) OVER (PARTITION BY c) AS fin FROM p),
o AS (SELECT d, k, min(c) AS c, count(*) AS n, any_value(b) AS b, any_value(pk) AS pk, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE fin), '')) AS ends FROM q GROUP BY 1, 2),
ch AS (SELECT d - 1 AS d, pk AS k, count(*) AS kids FROM o WHERE d > 0 GROUP BY 1, 2),
oc AS (SELECT o.*, coalesce(kids, 0) AS kids FROM o LEFT JOIN ch ON ch.d = o.d AND ch.k = o.k),
su AS (SELECT p.d, p.k, CAST(count(*) FILTER (WHERE kids = 0) AS BIGINT) AS leaves, CAST(sum((n - 1) * oc.b) AS BIGINT) AS saved FROM oc JOIN p ON p.c = oc.c AND p.d <= oc.d GROUP BY 1, 2)
SELECT oc.c AS conv_id, oc.d AS depth, up.c AS parent_conv_id, oc.n AS n_convs, oc.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, oc.ends AS ends_sha256
FROM oc JOIN su ON su.d = oc.d AND su.k = oc.k LEFT JOIN o up ON up.d = oc.d - 1 AND up.k = oc.pk"""


def all_sql() -> dict[str, str]:
    return {"op2_quality": quality_sql(), "op6_mixing": mixing_sql(), "op8_warc": warc_sql(), "op11_importance": importance_sql(), "op12_prefix_trie": prefix_trie_sql(), "op13_url_filter": url_filter_sql()}
