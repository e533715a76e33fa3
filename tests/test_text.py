"""Functions on literal rows, with the branches the given tables do not reach."""

import pytest
from pyspark.sql import functions as F

from palaver.functions import citations, display, lang, text, vectors, web
from palaver.operators import activity

C = F.col


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(C("v")).alias("o")).first().o


@pytest.mark.parametrize(
    "value, presence, ratio, document, script",
    [
        ("", "empty", "empty", "empty", "English"),
        ("   \n", "English", "empty", "empty", "English"),
        ("مرحبا", "Arabic", "ar", "unknown", "Arabic"),
        ("م" * 40 + " hello", "Arabic", "ar", "English", "Arabic"),
        ("م" * 60 + " hello", "Arabic", "ar", "Arabic", "Arabic"),
        ("les chats sont dans la rue", "French", "fr", "French", "English"),
        ("bonjour merci", "French", "en", "English", "English"),
        ("déjà vu", "English", "en", "English", "French"),
        ("1234", "English", "empty", "unknown", "English"),
    ],
)
def test_language_rules_disagree_as_meant(spark, value, presence, ratio, document, script):
    assert one(spark, value, lang.lang_presence) == presence
    assert one(spark, value, lang.lang_ratio) == ratio
    assert one(spark, value, lang.lang_ratio_document) == document
    assert one(spark, value, lang.lang_script) == script


def test_strip_equals_its_pattern(spark):
    """Also where a line separator ends the text, which is no white space but lets ``$`` stand before it."""
    ends = ["", " ", "\xa0", "\t\r\n", "\x0b\f", "\x85", " \x85", "\u2028", " \u2028\n", "\x1c", "\u2003", "\n \u2029", "\x85 \x85"]
    rows = [(a + middle + b,) for a in ends for middle in ("", "x", "a  b\n\nc") for b in ends] + [(None,)]
    pattern = F.regexp_replace("v", r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", "")
    df = spark.createDataFrame(rows, "v string").select("v", text.strip(C("v")).alias("got"), pattern.alias("want"), text.is_blank(C("v")).alias("blank"))
    for r in df.collect():
        assert (r.got, r.blank) == (r.want, None if r.v is None else r.want == "")


def test_language_ratio_finds_the_words_once(spark):
    df = spark.createDataFrame([("x",)], "v string").select(lang.lang_ratio(C("v")).alias("o"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(") == 1


def test_language_set_takes_every_script(spark):
    df = spark.createDataFrame([(1, "سؤال déjà"), (1, "plain"), (2, "?!"), (3, "plain")], "u int, v string")
    got = {r.u: r.s for r in df.groupBy("u").agg(lang.lang_set(C("v")).alias("s")).collect()}
    assert got == {1: ["ar", "en", "fr"], 2: [], 3: ["en"]}


@pytest.mark.parametrize(
    "value, want",
    [
        ("HTTPS://Www.Example.ORG//a//b/?q=1#frag", "https://www.example.org/a/b?q=1"),
        ("http://x.org:8080/a/b).", "http://x.org:8080/a/b"),
        ("http://x.org", "http://x.org/"),
        ("http://u:p@x.org/a;s=1?k", "http://x.org/a?k"),
        ("http://x.org/a​‏", "http://x.org/a"),
    ],
)
def test_canonical_url(spark, value, want):
    assert one(spark, value, web.canonical_url) == want


def test_host_rules(spark):
    assert one(spark, "http://worldwide.org/a", web.url_host) == "worldwide.org"
    assert one(spark, "http://www.worldwide.org/a", lambda c: web.url_host(c, strip_characters=True)) == "orldwide.org"


@pytest.mark.parametrize(
    "value, want",
    [
        ("https://youtu.be/x", True), ("https://sub.linkedin.com/x", True), ("https://x.org/a.PDF", True),
        ("https://x.org/wp-admin/a", True), ("https://covered.org/", True), ("https://x.org/a", False),
    ],
)
def test_crawl_skip(spark, value, want):
    assert one(spark, value, lambda c: web.crawl_skip(c, ["covered.org"])) is want


def test_page_links_stay_on_the_host(spark):
    page = (
        '<a href="/a">1</a><a class="x" href="b?c=1#d">2</a><a href="mailto:x@y">3</a><a href="//x.org/e/">4</a>'
        '<a href="http://other.org/">5</a><a href="#top">6</a><a href="http://www.x.org/a">7</a><a href="/f.pdf">8</a>'
    )
    df = spark.createDataFrame([(page, "http://x.org/dir/page")], "h string, u string")
    got = df.select(web.page_links(C("h"), C("u")).alias("l")).first().l
    assert got == ["http://x.org/a", "http://x.org/dir/b?c=1", "http://x.org/e", "http://www.x.org/a"]


def test_strip_html(spark):
    page = "<html><style>p{}</style><p>a &amp; b</p>\n\n\n<!-- no --><script>x='</p>'</script><p>c&nbsp;</p></html>"
    assert one(spark, page, web.strip_html) == "a & b\n\nc"
    assert one(spark, "caf&eacute; &#8211; x", web.unescape_all) == "café – x"


def test_names(spark):
    assert one(spark, "files/My plan (v2).pdf", text.safe_filename) == "My_plan_v2.txt"
    assert one(spark, "Arrêté 12.pdf", text.attachment_key) == "Arrêté_12.txt"
    assert one(spark, "a-b c.txt", text.document_key) == "a_b_c"
    assert one(spark, "!!!", text.slug) == "untitled"


def test_clean_lines_and_pages(spark):
    assert one(spark, "  a   b \r\n\n\n\n c\n", text.clean_lines) == "a b\n\nc"
    assert one(spark, "a\n\nb\n\nc", text.page_estimate) == 3


def test_quotes_and_redaction(spark):
    assert one(spark, '"a b "', text.strip_wrapping_quotes) == "a b"
    assert one(spark, "'a", text.strip_wrapping_quotes) == "'a"
    got = one(spark, "db postgres://u:p@h/x key sk-abcdefghij Token: abc", text.redact_secrets)
    assert got == "db postgres://***:***@h/x key *** Token=***"


def test_typos_are_reproducible_and_whole(spark):
    df = spark.createDataFrame([(i, "the quick brown fox jumps over 12 dogs " * 20) for i in range(50)], "i long, v string")
    made = df.select("i", "v", text.typos(C("v"), C("i") + 42).alias("m"))
    first = {r.i: r.m for r in made.repartition(7).collect()}
    assert first == {r.i: r.m for r in made.collect()}
    changed = [sum(a != b for a, b in zip(r.v, r.m)) > 0 for r in made.collect()]
    assert all(changed)
    assert all(0.93 < len(m) / 800 < 1.07 for m in first.values())
    none = df.select(text.typos(C("v"), C("i"), 0.0).alias("m"), "v").where("m <> v").count()
    assert none == 0


def test_citations(spark):
    df = spark.createDataFrame(
        [
            ("See [pdf_a.b-c_0], and [chat_1, ext_x] or [chat_1].", ["chat_1", "pdf_a.b-c_0"]),
            ("I don't have any information on that [chat_1], or [pdf_x]. See [1], [chat_1]!", ["chat_1"]),
            ("No cites [here].", ["chat_1"]),
        ],
        "a string, k array<string>",
    )
    rows = df.select(
        citations.renumber_citations(C("a"), C("k")).alias("t"), citations.cited_sources(C("a"), C("k")).alias("s")
    ).collect()
    assert rows[0].t == "See [1], and [2] [ext_x] or [2]."
    assert [(x.number, x.id) for x in rows[0].s] == [(1, "pdf_a.b-c_0"), (2, "chat_1")]
    assert rows[1].t == "I don't have any information on that. See [1]!" and rows[1].s == []
    assert rows[2].t == "No cites [here]."
    again = spark.createDataFrame([(rows[1].t,)], "a string").select(citations.scrub_citations(C("a")).alias("t")).first().t
    assert again == rows[1].t


def test_display(spark):
    row = spark.range(1).select(
        display.compact_chars(F.lit(1250)).alias("a"), display.compact_chars(F.lit(1_234_567)).alias("b"),
        display.compact_tokens(F.lit(2500)).alias("c"), display.percent(F.lit(1), F.lit(0)).alias("d"), display.percent(F.lit(1), F.lit(8)).alias("e"),
        display.pretty_model(F.lit("groq/llama-3-Versatile")).alias("f"),
        display.member_for(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")).alias("g"),
        display.freshness_band(F.lit(None).cast("timestamp"), F.current_timestamp()).alias("h"),
    ).first()
    assert tuple(row) == ("1.3k", "1.23M", "2k", 0, 13, "llama-3", "1 day", "never")


def test_commands(spark):
    df = spark.createDataFrame([("/ask@bot  what\nnow ",), ("/deep x",), ("/me",), ("/ask",), ("hello",), ("/reset@bot",)], "text string")
    got = {(r.command, r.argument) for r in activity.parse_commands(df).collect()}
    assert got == {("ask", "what\nnow"), ("deep", "x"), ("me", ""), ("reset", "")}


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r.u for r in df.select(vectors.l2_normalise(C("v")).alias("u")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
