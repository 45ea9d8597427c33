"""Quality rules, HTML, WARC, mixing: against SQL, plain versions and hand cases."""

import gzip
import math
import os
from html.parser import HTMLParser

import duckdb
import pytest

from tests.conftest import SF
from tests.test_oracle import rows
from tidemark.llm import html_text, mixing, quality, registry, warc


@pytest.mark.parametrize("name", ["op2_quality", "op6_mixing", "op8_warc"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.sql(registry.oracle_sql()[name]).df())


def test_quality_odd_rows(odd, empty, clashing):
    got = {r["doc_id"]: r for r in quality.judge(odd.select("doc_id", "text", "lang"), "doc_id").collect()}
    assert not got[2]["kept"] and not got[3]["kept"] and got[4]["n_words"] == 40_000 and got[8]["word_chars"] == 70_000
    assert got[1]["base_failed"] == got[5]["base_failed"]  # equal texts
    assert quality.judge(empty.select("doc_id", "text", "lang"), "doc_id").count() == 0
    assert quality.kept_rows(clashing).columns == clashing.columns
    assert quality.kept_rows(empty).count() == 0


def test_many_languages_speak_for_their_documents(spark, monkeypatch):
    """More languages than every document is compared with: the others still judge their own; without a reference none is judged."""
    monkeypatch.setattr(quality, "LARGEST", 2)
    prose = lambda k, n: " ".join(f"{'abcdefghij'[(i * 7 + k) % 10] * (2 + i % 5)}{'xyz'[i % 3]}{i}" if i % 4 else quality.COMMON[(i + k) % 20] for i in range(n))
    rows = [(100 * k + j, prose(k + j, 300), f"l{k}") for k in range(201) for j in range(8)]
    rows += [(100_000, " ".join("\u0431\u0435\u043b" + "\u043a\u0430\u0440\u0438"[i % 4] * (1 + i % 9) + "\u043e\u0442"[i % 2] * (i // 9) for i in range(200)), "ru"), (100_001, " ".join("#$%" * (i % 3 + 1) for i in range(200)), "l150"), (100_002, " ".join("#$%" * (i % 3 + 1) + str(i) for i in range(200)), "l150")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sent in (quality.SENT, 3):
        monkeypatch.setattr(quality, "SENT", sent)
        got = {r["doc_id"]: r for r in quality.judge(docs, "doc_id").collect()}
        assert len(got) == len(rows) and all(got[i]["kept"] for i in range(0, 20_100, 100)) and got[100_000]["kept"] == (not got[100_000]["base_failed"])
        assert not got[100_002]["base_failed"] and not got[100_002]["kept"]


def test_repeated_words_by_hand(spark):
    w = [f"w{i}" for i in range(30)]
    texts = {1: w, 2: w[:10] + w[:10], 3: ["a"] * 20, 4: w[:9] + w[20:22] + w[1:9]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in df.select("doc_id", quality.repeated_words(quality.word_list(df.text)).alias("n")).collect()}
    assert got == {1: 0, 2: 20, 3: 20, 4: 16}


def test_html_hand_cases():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<p>Four<br>five &eacute;.<div class="advert">Buy</div><ul><li>x<li>y</ul><form><input><button>Go</button></form><script>var t="</p>";</script><p>end</p>
    <section id="comments"><article class="comment"><p>First!</p></article></section></article><aside>More</aside><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page) == "A & B\n\nOne two three.\n\nFour five é.\n\nx\n\ny\n\nend"
    assert html_text.main_text("") == "" and html_text.main_text("plain <i>text</i>") == "plain text"
    assert html_text.main_text("<p a='>'>x</p><!-- y --><p>z") == "x\n\nz"
    plain = "<body><div class=menu><a>a</a></div><div><p>" + "A long paragraph of text. " * 5 + "</p><p>Short.</p></div><div><a href=1>one</a> <a href=2>two</a></div></body>"
    assert html_text.main_text(plain).endswith("Short.")


def test_html_of_hard_markup():
    assert html_text.main_text("<p title=it's>One text.</p><p>Two.</p>") == "One text.\n\nTwo."
    assert html_text.main_text("<p>&am<b>p;</b> stays.</p>") == "&amp; stays."
    assert html_text.main_text("<article><p>One.</p><div class='search results'>Two.</div><div class='tags form'>Three</div></article>") == "One.\n\nTwo.\n\nThree"
    long = "<p>" + "A long paragraph of text. " * 40 + "</p>"
    for page in (f"<body>{long}<nav>a</nav><nav>b</nav><nav>c</nav><p>The end.</p></body>", f"<body><article>{long}<nav>a</nav><nav>b</nav><nav>c</nav><p>end</p></article></body>"):
        assert html_text.main_text(page).endswith("nd." if "The" in page else "end")
    menu = "<div>" + "".join(f"<a href={i}>Link {i}</a><br>" for i in range(9)) + "</div>"
    page = f"<body><div>Site</div>{menu}<h1>Title</h1>{long}<p>Then short.</p>{menu}<div>\u00a9 2020 Somebody. All rights reserved.</div></body>"
    got = html_text.main_text(page).split("\n\n")
    assert got[0] == "Title" and got[-1] == "Then short." and len(got) == 3
    assert html_text.regions([0, 90, 0, 0, 0, 5, 0]) == [(1, 2)] and html_text.regions([5, 5, 0, 0, 0, 9]) == [(0, 2), (5, 6)]  # least: half of the heaviest window


class Plain(HTMLParser):
    """A second reading of pages that mark their article by the tag alone, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.article, self.skipped, self.divs = [], "", 0, 0, []

    def cut(self):
        if " ".join(self.text.split()):
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.article += 1
        elif tag in ("script", "style", "nav", "footer") or tag == "div" and dict(attrs).get("class") == "ad":
            self.skipped += 1
        if tag == "div":
            self.divs.append(dict(attrs).get("class") == "ad")
        if tag == "br":
            self.text += " "
        elif tag in html_text.BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.cut()
        if tag == "article":
            self.article -= 1
        elif tag in ("script", "style", "nav", "footer") or tag == "div" and self.divs and self.divs.pop():
            self.skipped -= 1

    def handle_data(self, data):
        if self.article and not self.skipped:
            self.text += data


def test_html_against_a_second_parser(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_text.query(spark, SF.replace("0.001", "0.01")).collect()}
    for r in pages:
        p = Plain()
        p.feed(r["html"])
        p.close()
        p.cut()
        assert got[r["page_id"]] == "\n\n".join(p.blocks), r["page_id"]


def test_html_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>One text here.</p>", "x", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert html_text.extract(df, ["page_id", "n_chars"]).collect()[0][:] == (1, 5, "One text here.")


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, "u", "<p>" * 3000 + "x" + "<div><span>" * 2000)], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_text.extract(df, ["page_id"]).collect()) == ["", "", "a", "a", "x"]
    assert html_text.extract(df.limit(0), ["page_id"]).count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_files(pages.repartition(3), str(tmp_path / "out"), archive_bytes=50_000)
    names = os.listdir(tmp_path / "out")
    assert len(names) >= 3 and all(n.endswith(".warc.gz") for n in names)
    with gzip.open(tmp_path / "out" / names[0]) as f:
        assert f.read(8) == b"WARC/1.1"
    got = {r["page_id"]: (r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_files(spark, str(tmp_path / "out")).collect()}
    assert got == {r["page_id"]: (r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.query(spark, SF).collect()}


PAGES = "page_id long, url string, html string, sha1 string, payload int"


def test_warc_round_trip_and_revisits(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, "u", "same"), (3, "v", "same"), (4, None, None), (5, "w", ""), (None, "n", "same"), (6, "z", "x" * 300_000), (3, "v", "same")]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], PAGES)
    warc.write_archives(df, str(tmp_path / "a"), archive_bytes=500)
    got = warc.read(spark.read.schema(warc.ARCHIVES).parquet(str(tmp_path / "a"))).collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert by[2][0]["record_type"] == "revisit" and by[2][0]["refers_to"] == 3 and by[2][0]["payload_bytes"] == 4 and {r["record_type"] for r in by[3]} == {"response"}
    assert by[4][0]["refers_to"] == 5 and by[5][0]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and by[None][0]["refers_to"] == 3
    assert bytes(by[1][0]["payload"]) == "<p>é</p>".encode() and by[1][0]["url"] == "http://a/%0D%0AX:%20y" and by[6][0]["payload_bytes"] == 300_000
    assert warc.read(warc.pack(warc.with_revisits(df.limit(0)))).count() == 0


def test_warc_files_and_broken_records(spark, tmp_path):
    one = warc.record(7, "http://a", b"abc", warc.digest32(b"abc"), None)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    assert [r["page_id"] for r in warc.read_files(spark, str(tmp_path)).collect()] == [7, 7]
    for broken in (one.replace(b"abc", b"abd"), one[:-3], b"GET" + one):
        with pytest.raises(ValueError):
            warc.parse(broken)
    with pytest.raises(ValueError):
        list(warc.members(gzip.compress(one)[:-9]))


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


def test_apportionment_by_brute_force(spark):
    votes = [1000.0, 400.0, 130.0, 1.0, 0.0, 77.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(votes)], "g int, i int, v double")
    for seats in (0, 1, 7, 50, 333):
        got = mixing.apportion(df, ["g"], ["i"], "v", mixing.F.lit(seats), "n").orderBy("i").collect()
        assert [r["n"] for r in got] == sainte_lague(votes, seats)


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 10, "b": 5000, "c": 4000, "d": 3, None: 700}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], "source string, n_docs long, source_size long")).collect()}
    names, total = ["a", "b", "c", "d", None], sum(sizes.values())
    weight = dict(zip(names, (5, 2, 1, 5, 2), strict=True))
    want, full = {}, set()
    while True:
        left, share = total - sum(3 * sizes[k] for k in full), sum(weight[k] for k in names if k not in full)
        want = {k: 3 * sizes[k] if k in full else left * weight[k] / share for k in names}
        over = {k for k in names if k not in full and want[k] > 3 * sizes[k]}
        if not over:
            break
        full |= over
    assert all(math.isclose(got[k], want[k]) for k in names)


def test_mixing_limits_and_odd_rows(spark, odd, empty, clashing):
    got = mixing.mix(mixing.sized(odd), blocks=500, shard_rows=2)
    r = got.collect()
    assert len(r) == 11 and all(x["taken"] <= 3 * x["size"] for x in r)
    by = {}
    for x in r:
        by.setdefault(x["source"], [x["target"], 0])[1] += x["taken"]
    assert all(abs(t - n) <= 100 for t, n in by.values())
    assert sorted(map(str, mixing.mix(mixing.sized(odd.repartition(3)), blocks=500, shard_rows=2).collect())) == sorted(map(str, r))
    assert mixing.mix(mixing.sized(empty)).count() == 0 and mixing.mixed_rows(clashing).columns == clashing.columns and mixing.mixed_rows(empty).count() == 0


def test_small_sources_beside_a_large_one_reach_their_targets(spark):
    """Blocks of total / 500 would be 2,000 words: more than any target of the small sources."""
    rows = [(k, "x", 1000, "big") for k in range(1000)] + [(2000 + k, "x", 5 + k, f"s{k % 3}") for k in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, row_key string, size long, source string"), blocks=500).groupBy("source").agg(mixing.F.first("target").alias("t"), mixing.F.sum("taken").alias("n")).collect()
    assert len(got) == 4 and all(r["n"] > 0 and abs(r["n"] - r["t"]) <= 0.04 * r["t"] for r in got)


def test_clean_text_without_a_reference_is_kept(spark):
    import random

    r = random.Random(0)
    of = lambda letters, n: " ".join("".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(n))
    latin, other = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцч"
    docs = [(k, of(latin, 100), "en") for k in range(30)] + [(100, of(other, 80), "ru"), (101, of(other, 80), None), (102, of("QX#7%&4Z", 80), "en"), (103, of("QX#7%&4Z", 80), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = {x["doc_id"] for x in quality.judge(df, "doc_id").collect() if x["kept"]}
    assert kept == {*range(30), 100, 101} and {x["doc_id"] for x in quality.kept_rows(df).collect()} == kept


def test_html_keeps_short_sections_and_references():
    long = "".join(f"<p>A long paragraph of text, number {i}. {'More of it. ' * 20}</p>" for i in range(8))
    page = f"<body><ul><li><a>Home</a><li><a>News</a></ul><div>{long}<ol><li><a>Reference one</a><li><a>Reference two</a><li>Last words.</ol></div><div class=advert>x</div><div class=share>y</div><form>z</form><p>A short last section.</p><ul><li><a>Terms</a></ul></body>"
    got = html_text.main_text(page).split("\n\n")
    assert len(got) == 12 and got[8:] == ["Reference one", "Reference two", "Last words.", "A short last section."]


def test_html_names_are_hints_and_the_text_decides():
    """Names that only contain a word for boilerplate, or wrap most of the text, lose nothing; real ones go."""
    ps = "".join(f"<p>A long paragraph number {i} of the text, with several words in it and an end.</p>" for i in range(3))
    want = html_text.main_text(ps)
    assert len(want.split("\n\n")) == 3
    for before in (
        '<div class="layout has-sidebar">', '<div id="page" class="site no-header">', '<div class="wrapper header-fixed">', '<article class="post has-comments">', '<article class="post type-post comments-open">',
        '<main><div class="alert">', '<div class="market-share">', '<section class="discussion">', '<div class="header-text">', '<div class="widget">', '<body class="nav"><div class="sidebar">', '<div class="comments">',
    ):
        assert html_text.main_text(before + ps) == want, before
        assert html_text.main_text('<div class="page-header">Site of somebody.</div><div class="main-nav">Home News</div>' + before + ps) == want, before
    for name in ("ad-banner", "cookie-notice", "site-footer", "comment-list", "comments", "sidebar-inner", "related-posts", "social-share", "newsletter"):
        side = f'<div class="{name}"><p>Words that nobody asked for, in one sentence of some length.</p></div>'
        assert html_text.main_text(side + ps + side) == want, name
        assert html_text.main_text(f"<article>{ps}{side}</article>") == want, name
    assert html_text.main_text(f'<article><p>Short one.</p></article><div class="comments">{ps}</div>') == "Short one."
    assert html_text.main_text("<p>Copyright law is a field of its own.</p>") == "Copyright law is a field of its own."
    assert html_text.main_text("<p>Copyright 2020 Somebody</p>" + ps) == want


def test_html_menus_inside_the_text():
    """Links in a row that fill a window go, wherever they stand; fewer stay between paragraphs; short first and last lines stay in an article."""
    ps = "<p>" + "A paragraph of text. " * 6 + "</p>"
    links = "".join(f"<div><a href={i}>Story number {i}</a></div>" for i in range(3))
    for page in (ps + links + ps, f"<main>{ps}{links}{ps}</main>"):
        assert "Story" not in html_text.main_text(page) and html_text.main_text(page).count("\n\n") == 1
    assert html_text.main_text(f"<article><p>One.</p><p>Two.</p>{ps}<p>End.</p></article>").startswith("One.\n\nTwo.\n\nA")
    assert html_text.main_text(f"<main>{ps}{links}<p>Buy now</p></main>") == html_text.main_text(ps)
