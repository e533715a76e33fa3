"""Chunks, threads, links, exports and files on small fixtures."""

import json

from pyspark.sql import functions as F

from palaver.operators import corpus, threads
from palaver.sources import chat, files, sinks

C = F.col


def pack_by_hand(text, limit=2000, overlap=250):
    pieces, opened = [], ""
    for p in [x.strip() for x in text.strip().split("\n\n") if x.strip()]:
        if len(p) > limit:
            if opened:
                pieces.append(opened)
                opened = ""
            at = 0
            while True:
                pieces.append(p[at : at + limit])
                if at + limit >= len(p):
                    break
                at += limit - overlap
        elif opened and len(opened) + 2 + len(p) > limit:
            pieces.append(opened)
            opened = p
        else:
            opened = f"{opened}\n\n{p}" if opened else p
    if opened:
        pieces.append(opened)
    return [p if i == 0 else pieces[i - 1][-overlap:] + "\n\n" + p for i, p in enumerate(pieces)]


def test_chunks(spark):
    texts = [
        "", "  \n\n ", "short", "a" * 2000, "b" * 2001, "c" * 5500,
        "\n\n".join("p%d " % i + "x" * (i * 37 % 900) for i in range(60)),
        "intro\n\n" + "y" * 4200 + "\n\n" + "tail " * 30, "é" * 1999 + "\n\n" + "z",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in corpus.chunk_text(df).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.text)
    for i, t in enumerate(texts):
        assert got.get(i, []) == pack_by_hand(t), i
    assert max(len(c) for v in got.values() for c in v) <= 2252


def test_reply_chains_with_cycles_and_breaks(spark):
    rows = [(1, None), (2, 1), (3, 2), (10, 11), (11, 12), (12, 10), (20, 99), (21, 20), (30, 31), (31, 30), (40, 40)]
    rows += [(100 + i, 99 + i if i else 1) for i in range(300)]
    messages = spark.createDataFrame(rows, "id long, reply_to long").withColumn("mtype", F.lit("message"))
    topics = spark.createDataFrame([(1, "root"), (31, None)], "id long, title string")
    got = {r.id: r.topic for r in threads.reply_chain_topic(messages, topics).collect()}
    assert got[2] == got[3] == "root" and all(got[100 + i] == "root" for i in range(300))
    assert [got[i] for i in (1, 10, 11, 12, 20, 21, 40)] == [None] * 7
    assert got[30] is None and got[31] is None
    direct = {r.id: r.topic for r in threads.direct_topic(messages, topics.where("title IS NOT NULL")).collect()}
    assert direct[2] == "root" and direct[3] == "General"


def test_link_frontier(spark):
    seeds = spark.createDataFrame([("http://x.org/0",), ("http://y.org/0",)], "url string")
    edges = spark.createDataFrame(
        [("http://x.org/0", "http://x.org/1"), ("http://x.org/1", "http://x.org/2"), ("http://x.org/1", "http://x.org/0"), ("http://x.org/2", "http://x.org/3")],
        "url string, link string",
    )
    stored = spark.createDataFrame([(f"http://x.org/{i}", 500) for i in range(4)] + [("http://y.org/0", 400)], "url string, chars int")
    for depth, want in ((0, 2), (1, 3), (2, 4), (3, 5)):
        got = threads.link_frontier(seeds, edges, stored, depth).collect()
        assert len(got) == want and {r.url: r.depth for r in got}["http://x.org/0"] == 0
    assert threads.link_frontier(seeds, edges, stored, 3, cap=2).where("host = 'x.org'").count() == 2


def test_link_enrich_keeps_first_appearance(spark):
    messages = spark.createDataFrame([(1, "b http://x.org/b, a http://x.org/a and http://x.org/b#t again"), (2, "none")], "id long, text string")
    pages = spark.createDataFrame([("http://x.org/a", "A", "body a"), ("http://x.org/b", "", "b" * 1300)], "url string, title string, body string")
    got = {r.id: r.text for r in corpus.link_enrich(messages, pages).collect()}
    assert got[2] == "none"
    tail = "\n\n— Linked page: http://x.org/b\n" + "b" * 1200 + " […truncated]\n\n— Linked page: http://x.org/a — A\nbody a"
    assert got[1].endswith("again" + tail)


def test_ocr_threshold_of_twenty(spark):
    messages = spark.createDataFrame([(i, "cap") for i in range(4)], "id long, text string")
    ocr = spark.createDataFrame([(0, "x" * 20), (1, "x" * 19), (2, None)], "id long, ocr_text string")
    got = {r.id: (r.text_source, r.text, r.original_text) for r in corpus.ocr_merge(messages, ocr).collect()}
    assert got == {0: ("ocr", "x" * 20, "cap"), 1: ("ocr_failed", "cap", "cap"), 2: ("ocr_failed", "cap", "cap"), 3: ("original", "cap", "cap")}
    cache = spark.createDataFrame([(0, 20), (1, 21)], "id long, char_count long")
    states = {r.id: r.state for r in corpus.ocr_resume(messages, cache).collect()}
    assert states == {0: "todo", 1: "cached", 2: "todo", 3: "todo"}


def test_native_text_wins_over_recognised(spark):
    native = spark.createDataFrame([("Arrêté.txt", "n")], "file string, text string")
    ocr = spark.createDataFrame([("Arrêté.txt", "o"), ("new.txt", "o")], "file string, text string")
    got = {(r.file, r.text_source) for r in corpus.source_precedence(native, ocr).collect()}
    assert got == {("Arrêté.txt", "original"), ("new.txt", "ocr")}


def test_export_with_mixed_text(spark, tmp_path):
    export = {
        "chats": {"list": [{"name": "g", "type": "private", "id": 7, "messages": [
            {"id": -1, "type": "service", "action": "topic_created", "title": "T", "text": ""},
            {"id": 2, "type": "message", "date": "2024-01-02T03:04:05", "from": "A", "text": ["see ", {"type": "link", "text": "http://x.org"}, " and ", {"type": "text_link", "text": "this", "href": "http://y.org"}],
             "text_entities": [{"type": "link", "text": "http://x.org"}, {"type": "link", "text": "http://z.org"}, {"type": "bold", "text": "b"}],
             "reactions": [{"count": 2}, {"count": 3}], "photo": "p.jpg", "reply_to_message_id": -1},
            {"id": 3, "type": "message", "date": "2024-01-02T03:05:05", "actor": "B", "text": "plain", "edited": "x"},
            {"id": 4, "type": "message", "date": "2024-01-02T03:05:06", "from": "B", "text": 5},
        ]}, {"messages": [{"id": 99, "type": "message", "text": "other chat"}]}]}
    }
    (tmp_path / "result.json").write_text(json.dumps(export))
    messages = chat.read_export(spark, str(tmp_path / "result.json"))
    assert messages.count() == 4
    topics = threads.resolve_topics(
        messages.select("id", C("reply_to_message_id").alias("reply_to")), messages.where("action = 'topic_created'").select("id", "title")
    )
    rows = {r.id: r for r in chat.enriched_frame(messages, topics).collect()}
    assert rows[2].text == "see http://x.org and this" and rows[2].topic == "T" and rows[2].reaction_count == 5
    assert rows[2].links == ["http://x.org", "http://y.org", "http://z.org"] and rows[2].has_photo
    assert rows[3].sender == "B" and rows[3].is_edited and rows[3].reaction_count == 0 and rows[3].links == []
    assert rows[4].text == ""


def test_span_cover(spark):
    df = spark.createDataFrame(
        [("hello big world", [(6, 3, "bold"), (0, 5, "italic"), (7, 5, "code")]), ("", [(0, 1, "bold")]), ("plain", [])],
        "t string, e array<struct<offset:int,length:int,type:string>>",
    )
    got = [[(p.type, p.text) for p in r.c] for r in df.select(chat.cover_spans(C("t"), C("e")).alias("c")).collect()]
    assert got[0] == [("italic", "hello"), ("plain", " "), ("bold", "big"), ("plain", " world")]
    assert got[1] == [] and got[2] == [("plain", "plain")]


def test_text_folders(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a b+c.txt").write_text("one\ntwo")
    (docs / "_hidden.txt").write_text("x")
    (docs / "empty.txt").write_text("")
    (docs / "other.md").write_text("x")
    assert [(r.file, r.stem, r.text) for r in files.read_documents(spark, str(docs)).collect()] == [("a b+c.txt", "a b+c", "one\ntwo")]
    tree = tmp_path / "web"
    (tree / "chat_links" / "x.org").mkdir(parents=True)
    (tree / "site" / "en").mkdir(parents=True)
    (tree / "chat_links" / "x.org" / "_root.txt").write_text("[Source: s]\n\nhidden by its name")
    (tree / "chat_links" / "x.org" / "page.txt").write_text("[Source: http://x.org/p]\n[Title: T [x]]\n[Fetched: 2024]\n\nbody\n\n[not: header]")
    (tree / "site" / "en" / "1_a.txt").write_text("[Title: A]\nno blank line before\nbody")
    got = {r.slug: r for r in files.read_scraped(spark, str(tree)).collect()}
    assert set(got) == {"x.org__page", "1_a"}
    assert got["x.org__page"].headers == {"Source": "http://x.org/p", "Title": "T [x]", "Fetched": "2024"}
    assert got["x.org__page"].body == "body\n\n[not: header]" and got["1_a"].body == "no blank line before\nbody"
    chunks = corpus.web_chunks(files.read_scraped(spark, str(tree))).collect()
    assert {c.id for c in chunks} == {"ext_chat_links_x.org__page_0", "ext_site_1_a_0"}
    assert all(c.metadata.date == "" for c in chunks)  # only Modified is read as a date


def test_manifest_and_summary(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"http://X.org/a/": {"host": "x.org", "chars": 3}, "http://x.org/a": {"host": "x.org", "chars": 5}, "http://x.org/b": "junk"}))
    rows = files.read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert [(r.url, r.chars) for r in rows] == [("http://x.org/a", 5)]
    assert files.read_summary(spark, str(tmp_path / "none.json"), "file string, chars int").count() == 0


def test_write_if_changed_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    base = str(tmp_path / "t")
    assert sinks.write_if_changed(df, base) is True
    assert sinks.write_if_changed(df.orderBy(C("id").desc()), base) is False
    assert sinks.write_if_changed(df.distinct(), base) is True
    assert sinks.read_current(spark, base).count() == 2
    path = str(tmp_path / "m")
    sinks.append_messages(df.where("id = 1"), path)
    sinks.append_messages(df.where("id > 0").distinct(), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
