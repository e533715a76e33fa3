"""Chat formatting, licences, URLs, languages, mixing, token files and audio on small tables."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from llm_cases import awkward, frame, prose, row
from pyspark.sql import functions as F

import corpus_pipeline
from palaver.llm import audio, chat, decontaminate, entries, language, licenses, mixing, near_dup, tokens, url_filter

CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a </s> b &a <s>x\n"), (1, 2, "assistant", ""), (2, 0, "system", "plain & simple < text"),
    (2, 1, "assistant", "fine\nhere"), (3, None, None, None), (3, 1, "ass\nistant", "x"), (3, 1, "ass\nistant", "x"), (None, 0, "assistant", "é中"),
    (4, 0, "assistant", "</s"), (4, 1, "user", ">"), (5, 0, "user", "<chat:1>&l</s>[INST]"), (6, 0, "assistant", "x" * 50_000),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*r, "extra", "y") for r in CHATS], "conv_id long, turn long, role string, text string, source string, turns string")
    out = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    digests = {r.conv_id: r for r in chat.digests(chat.format_chats(rows)).collect()}
    by_id = collections.defaultdict(list)
    for conv, turn, role, text in CHATS:
        by_id[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(out) == set(by_id)
    for conv, turns in by_id.items():
        turns, r, d = sorted(turns), out[conv], digests[conv]
        assert [tuple(t) for t in r.turns] == [t[2:] for t in turns] and r.round_trip
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted) == d.formatted_chars
        at, learned = 0, []
        for x in r.loss_runs:
            if x.loss:
                part = r.formatted[at : at + x.chars]
                learned.append(part.replace("&n", "\n").replace("&l", "<").replace("&a", "&") if r.escaped else part)
            at += x.chars
        want = [t[3] for t in turns if t[2] == "assistant"]
        assert learned == want and d.loss_chars == len("".join(want))
        assert d.loss_sha256 == hashlib.sha256("".join(want).encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert r.escaped == (any(c in x for c in ("<s>", "</s>", "<chat:0>", "<chat:1>") for t in turns for x in t[2:]) or any("\n" in t[2] for t in turns))
    assert chat.format_chats(rows.limit(0)).collect() == []


def test_learned_text_comes_from_the_mask(spark):
    """Learned characters follow the mask, also where it is another one than the parsed roles would give."""
    rows = spark.createDataFrame([(1, 0, "user", "a <s> b <chat:1>"), (1, 1, "assistant", "x & <y"), (2, 0, "assistant", "plain"), (2, 1, "user", "&l")], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(rows)
    assert {r.conv_id: r.escaped for r in made.collect()} == {1: True, 2: False}
    turned = made.withColumn("loss_runs", F.transform("loss_runs", lambda r, i: F.struct(r.chars.alias("chars"), ((i % 3 == 1) & ~r.loss).alias("loss"))))
    got = {r.conv_id: r.loss_sha256 for r in chat.digests(turned).collect()}
    assert got == {1: hashlib.sha256(b"a <s> b <chat:1>").hexdigest(), 2: hashlib.sha256(b"&l").hexdigest()}
    assert {r.conv_id: r.loss_chars for r in chat.digests(made).collect()} == {1: 6, 2: 5}


def test_licenses(spark):
    mit = [t for n, t in licenses.TEMPLATES if n == "MIT"][1]
    half = len(mit) // 2
    at = mit.index(" ", half)
    texts = [
        "x\nReleased under the MIT License.\ny", "released UNDER the mit licence", f"intro\n\n{mit[:at]}\n{mit[at:]}\n\nend", mit.replace("free of charge", "gratis"),
        prose(1, 300), "license license license license", "Licensed under CC BY 4.0.\r\nLicensed under CC BY-NC 4.0.",
    ]
    rows = awkward() + [row(100 + i, t) for i, t in enumerate(texts)]
    got = sorted((r.doc_id, r.unit, r.number, r.license) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == [
        (100, "line", 2, "MIT"), (102, "paragraph", 2, "MIT"), (103, "line", 1, "MIT"), (106, "line", 1, "CC-BY-4.0"), (106, "line", 2, "CC-BY-NC-4.0"),
    ]
    assert licenses.scan(frame(spark, [])).collect() == []


def test_licenses_inside_texts(spark):
    mit = [t for n, t in licenses.TEMPLATES if n == "MIT"][1].split()
    block = "/*\n * Copyright someone\n *\n" + "".join(f" * {' '.join(mit[i : i + 9])}\n" for i in range(0, len(mit), 9)) + " *\n * " + prose(3, 90) + "\n */"
    texts = [
        "This file is released under the MIT License.", "All example code on this page is licensed under CC BY-NC 4.0.", block,
        prose(4, 200) + " Released under\nthe MIT License. " + prose(5, 200), "no notice: released under\nthe same rules", prose(6, 40) + " released under the mit licence " + prose(7, 40),
    ]
    got = sorted((r.doc_id, r.unit, r.number, r.license, r.word) for r in licenses.scan(frame(spark, [row(i, t) for i, t in enumerate(texts)])).collect())
    assert got == [(0, "line", 1, "MIT", 4), (1, "line", 1, "CC-BY-NC-4.0", 8), (2, "paragraph", 1, "MIT", 3), (3, "paragraph", 1, "MIT", 201)]


PAGES = [
    ("http://a.Example.ORG/en/1x?q", "a.example.org", "/en/1x", "example.org/en/1", "block"), ("x://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("https://notexample.org/es/1#f", "notexample.org", "/es/1", "org/", "allow"),
    ("http://b.com/fr/x://y", "b.com", "/fr/x://y", "com/fr/", "allow"), ("http://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://example.org", "example.org", "", None, None), ("http://example.org?/es/", "example.org", "", None, None), ("no scheme", "", "", None, None),
    (None, "", "", None, None), ("", "", "", None, None), ("://", "", "", None, None), ("http://\u0130.ORG/", "\u0130.org", "/", "org/", "allow"),
    ("http://xcom/fr/", "xcom", "/fr/", None, None), ("http://y.net/" + "z" * 20_000, "y.net", "/" + "z" * 20_000, None, None),
]


def test_url_rules(spark):
    rows = [(i, p[0], "h", "rule", "suffix") for i, p in enumerate(PAGES)] + [(None, None, None, None, None), (0, PAGES[0][0], "", "", "")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule string, suffix string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            _, host, path, rule, verdict = PAGES[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if rule else r.verdict in ("allow", "block") and 0 <= r.score <= 1
    one = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/")], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge(one).collect()} == {"allow"}
    assert url_filter.judge(one.limit(0)).collect() == []


def test_url_trees_learn_the_labels(spark):
    rows = [(i, f"http://h{i % 7}.com/{'de' if i % 2 else 'fr'}/{'x' * (20 if i % 2 else 2)}{i}") for i in range(400)]
    rows += [(1000 + i, f"http://k.net/q/{'x' * (20 if i % 2 else 2)}{i}") for i in range(100)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule IS NULL").collect()
    right = sum((r.verdict == "block") == bool(r.page_id % 2) for r in got)
    assert right >= 95


WORDS = {"en": "the and of to in that with ing tion over", "fr": "le la des une pour dans avec est eau oux", "de": "der die und das mit auf ein nicht ung keit"}


def speech(lang, seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS[lang].split(), n))


def test_language(spark):
    rows = [row(i, speech(lang, i, 60), lang) for i, lang in enumerate(["en", "fr", "de"] * 40)]
    mixed = speech("en", 1000, 80) + " " + speech("de", 1001, 40)
    rows += [row(900, mixed, None), row(901, None), row(902, "123 !?"), row(903, ""), row(904, "a"), row(905, "qqzzxx jjvvkk qxqxqz" * 20, None), row(None, speech("fr", 3, 30), "xx")]
    got = {r.doc_id: r for r in language.predict(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, lang in enumerate(["en", "fr", "de"] * 40):
        assert got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[900].lang_pred == "en" and sorted(got[900].languages) == ["de", "en"] and 0.5 < got[900].score < 0.8
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (901, 902, 903))
    assert got[904].lang_pred == "de" and not got[904].rejected
    assert got[905].rejected and got[None].lang_pred == "fr" and not got[None].held_out
    docs = frame(spark, rows)
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert {r.lang_pred for r in language.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.predict(frame(spark, [])).collect() == []


def test_language_sets_of_any_size_and_share(spark):
    words = {**WORDS, "es": "el los por que con como pero muy ya si"}

    def said(lang, seed, n):
        return " ".join(np.random.default_rng(seed).choice(words[lang].split(), n))

    rows = [row(i, said(lang, i, 60), lang) for i, lang in enumerate([*words] * 40)]
    rows.append(row(900, " ".join(said(lang, 50 + i, 200) for i, lang in enumerate(words)), None))
    rows += [row(901, said("en", 60, 4000) + " " + said("de", 61, 200), None), row(902, said("en", 62, 4000), None)]
    got = {r.doc_id: r for r in language.predict(frame(spark, rows)).collect()}
    assert sorted(got[900].languages) == sorted(words) and 0.2 < got[900].score < 0.4
    assert got[901].languages == ["en", "de"] and 0.9 < got[901].score < 0.99
    assert got[902].languages == ["en"] and all(got[i].languages == [lang] for i, lang in enumerate([*words] * 40))


def test_targets_and_seats():
    assert mixing.targets([100, 100, 100], [1, 1, 1]) == [100, 100, 100]
    assert mixing.targets([10, 100, 0], [5, 2, 1]) == [30, 80, 0]
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    votes = [5.0, 3.0, 1.0, 0.0]
    quotients = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(votes) for k in range(50)), reverse=True)[:20]
    assert mixing.sainte_lague(votes, 20) == [sum(-i == j for _, i in quotients) for j in range(4)]


def mixing_twin(docs, goal, names):
    """(doc_id, size, taken) by laying out every word of every shard and walking its blocks; seats one by one."""
    hashes = docs.withColumn("size", mixing.words(F.col("text"))).select("doc_id", "source", "size", F.xxhash64(F.lit(mixing.SEED), "doc_id", "size"), F.xxhash64(F.lit(mixing.SEED + 1), "doc_id")).collect()
    sizes = collections.Counter()
    for _, source, size, _, _ in hashes:
        sizes[source] += size
    shards = collections.defaultdict(list)
    for doc, source, size, h, order in hashes:
        if size:
            shards[names.index(source), h % -(-sizes[source] // mixing.SHARD_WORDS)].append((order, doc is not None, doc or 0, size))
    classes = collections.defaultdict(list)
    for key in sorted(shards):
        words = sum(x[3] for x in shards[key])
        block = 1
        while block * 2 <= min(1024, words // 1000):
            block *= 2
        classes[block].append((key, words, goal[key[0]] * words / sizes[names[key[0]]]))
    out = [(doc is not None, doc or 0, 0, 0) for doc, _, size, _, _ in hashes if not size]
    for block, members in classes.items():
        seats = [0] * len(members)
        for _ in range(round(sum(v for _, _, v in members) / block)):
            seats[max(range(len(members)), key=lambda i: (members[i][2] / (2 * seats[i] + 1), -i))] += 1
        for (key, words, _), q in zip(members, seats, strict=True):
            n = round(words / block)
            q = min(q, 3 * n)
            a, b = mixing._permutation(*key, n)
            line, at = [], 0
            for j in range(n):
                line += [q // n + ((a * j + b) % n < q % n)] * ((j + 1) * words // n - j * words // n)
            for _, there, doc, size in sorted(shards[key]):
                out.append((there, doc, size, sum(line[at : at + size])))
                at += size
    return out


def test_tiny_sources_meet_their_targets(spark):
    rows = [row(i, prose(i, 100), "en", "a") for i in range(40)] + [row(100, "x y z", "en", "b"), row(101, "x y", "en", "d"), row(102, "one", "en", "e")]
    got = {r.doc_id: (r.taken, r.target) for r in mixing.mixed_sizes(frame(spark, rows)).collect()}
    assert got[100] == (9, 9.0) and got[101] == (6, 6.0) and got[102] == (3, 3.0)


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 3000)
    rows = awkward() + [row(100 + i, prose(i, 20 + i % 60), "en", f"s{i % 4}") for i in range(600)]
    docs = frame(spark, rows)
    got = mixing.mixed_sizes(docs).collect()
    again = mixing.mixed_sizes(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len((r[1] or "").encode().split()) for r in rows)
    sources = collections.defaultdict(lambda: [0, 0])
    for r in got:
        assert r.taken <= 3 * r.size
        sources[r.source][0] += r.size
        sources[r.source][1] += r.taken
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sources[s][0] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for r in got:
        assert r.target == pytest.approx(want[names.index(r.source)]) and r.source_size == sources[r.source][0]
    for s, t in zip(names, want):
        assert abs(sources[s][1] - t) <= 0.002 * t + 1
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.taken) for r in got) == sorted(mixing_twin(docs, want, names))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    per = collections.Counter(r.source for r in mixed.collect() for _ in range(len((r.text or "").split())))
    assert all(abs(per[s] - t) <= 0.25 * t + 200 for s, t in zip(names, want) if s not in ("s2", None))
    assert mixing.mixed_sizes(frame(spark, [])).collect() == []
    assert mixing.mixed_sizes(frame(spark, [row(1, None), row(2, "")])).select("taken", "target").distinct().collect() == [(0, 0.0)]


def test_code_lengths():
    r = np.random.default_rng(1)
    for counts in ([5], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128], r.zipf(1.3, 500).clip(max=10**9)):
        counts = np.array(counts)
        sizes = tokens.code_lengths(counts, 12)
        assert sizes.max() <= 12 and (2.0 ** -sizes).sum() <= 1
        codes = [format(c, f"0{n}b") for c, n in zip(tokens.canonical(sizes), sizes)]
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert tokens.code_lengths(np.array([1, 2, 4, 8, 16])).tolist() == [4, 4, 3, 2, 1]
    assert tokens.code_lengths(np.array([1, 1, 1, 1, 100]), 3).tolist() == [3, 3, 3, 3, 1]


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_pack_and_unpack(n):
    r = np.random.default_rng(n)
    x = r.zipf(1.4, n).clip(max=300) - 1
    ids, counts = np.unique(x, return_counts=True)
    sizes = tokens.code_lengths(counts)
    code, size = np.zeros(301, np.int64), np.zeros(301, np.int64)
    code[ids], size[ids] = tokens.canonical(sizes), sizes
    checkpoints, stream = tokens.pack(code[x], size[x])
    assert (tokens.unpack(stream, checkpoints, n, *tokens._table(ids, sizes)) == x).all()


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "SEGMENT", 3000)
    t = Tokenizer.from_file(entries.tokenizer_file())
    rows = awkward() + [row(20, " leading  double <|endoftext|> x,\n\ny\t z "), row(21, "a.b? it's 's \u00a0 ok")]
    docs = frame(spark, rows)
    got = tokens.tokenised(docs, entries.tokenizer_file(), dtype="<u2").orderBy("start").collect()
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    folder = tokens.scratch(spark, "tokens")
    tokens.write(docs.limit(5), folder, entries.tokenizer_file())
    assert all(r.ids[-1] == 0 and len(r.ids) == r.n_tokens for r in tokens.read(spark, folder).collect())
    assert tokens.tokenised(frame(spark, []), entries.tokenizer_file()).collect() == []


def recording(tune, noise=0, seed=0):
    notes = audio._notes()
    body = notes[np.array(tune, int) % 24].reshape(-1).astype(int)
    if noise:
        body = np.clip(body + np.random.default_rng(seed).normal(0, noise, len(body)).round(), 0, 255)
    return audio.wave(body, audio.RATE)


def test_audio(spark, monkeypatch):
    r = np.random.default_rng(3)
    tune, other = r.integers(0, 24, 300).tolist(), r.integers(0, 24, 300).tolist()
    rows = [(50, recording(tune)), (51, recording(tune)), (52, recording(tune[100:220])), (53, recording(other[:90] + tune[40:160], 3)), (54, recording(other)), (100, recording(other[50:200]))]
    rows += [(55, None), (56, b"junk"), (57, recording([])), (150, recording([5] * 200)), (58, recording([5] * 150)), (None, recording(tune)), (150, recording([5] * 200))]
    monkeypatch.setattr(audio, "BLOCK_INTS", 250)
    got = audio.align(spark.createDataFrame([(*x, "k") for x in rows], "rec_id long, media binary, key string")).collect()
    member = [(x.rec_id, x.class_id) for x in got if x.kind == "member"]
    assert len(member) == len(rows) and (51, 50) in member and (None, 50) in member and member.count((150, 150)) == 2
    match = {(x.rec_id, x.class_id): x for x in got if x.kind == "match"}
    assert (50, 52) in match and (50, 53) in match and (100, 54) in match and (50, 54) not in match and (50, 50) not in match
    assert match[50, 52].offset == 100 and match[50, 52].bit_error < 0.02 and match[50, 53].offset == -50 and match[100, 54].offset == -50
    assert audio.align(spark.createDataFrame([], "rec_id long, media binary")).collect() == []


def stretches_by_hand(differ, voted):
    sums, votes = np.concatenate([[0], np.cumsum(differ)]), np.concatenate([[0], np.cumsum(voted)])
    n = len(differ)
    fits = [(a, b) for a in range(n) for b in range(a + audio.MIN_FRAMES, n + 1) if votes[b] - votes[a] >= audio.MIN_VOTES]
    gain = [round(3200 * audio.MAX_ERROR) * (b - a) - 100 * int(sums[b] - sums[a]) for a, b in fits]
    return max(gain, default=-1)


def test_best_stretches():
    r = np.random.default_rng(6)
    parts = []
    for i in range(40):
        n = int(r.integers(24, 90))
        differ = r.integers(0, 32, n) * (np.abs(np.arange(n) - r.integers(0, n)) > r.integers(5, 40))
        parts.append((differ, (r.random(n) < 0.4) & (differ == 0)))
    starts = np.cumsum([0, *[len(x) for x, _ in parts[:-1]]])
    got = {i: (a, b) for i, a, b in zip(*audio._stretches(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]), starts))}
    for i, (differ, voted) in enumerate(parts):
        want = stretches_by_hand(differ, voted)
        assert (i in got) == (want >= 0)
        if i in got:
            a, b = got[i][0] - starts[i], got[i][1] - starts[i]
            assert 0 <= a and b <= len(differ) and b - a >= audio.MIN_FRAMES and voted[a:b].sum() >= audio.MIN_VOTES
            assert round(3200 * audio.MAX_ERROR) * (b - a) - 100 * differ[a:b].sum() == want
    assert 5 < len(got) < 40


def test_audio_shared_passage(spark):
    r = np.random.default_rng(5)
    tune, one, two = (r.integers(0, 24, n).tolist() for n in (60, 300, 300))
    rows = [(100, recording(one[:120] + tune + one[120:])), (7, recording(two[:30] + tune + two[30:])), (8, recording(two))]
    got = audio.align(spark.createDataFrame(rows, "rec_id long, media binary")).where("kind = 'match'").collect()
    assert [(x.rec_id, x.class_id, x.offset) for x in got] == [(100, 7, 90)]
    assert 115 <= got[0].begin <= 121 and 50 <= got[0].frames <= 66 and got[0].votes >= audio.MIN_VOTES and got[0].bit_error < audio.MAX_ERROR


def groups_by_hand(rows):
    """Component of every (doc_id, text) by comparing all sets of five-word shingles; a row without words is one of its own."""
    rows = sorted(rows, key=repr)
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return dict(zip(rows, group, strict=True))


def test_stages(spark, tmp_path):
    items = [(i, prose(500 + i, 30)) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = awkward() + [row(100 + i, speech(("en", "fr", "de")[i % 3], i, 80), ("en", "fr", "de")[i % 3], f"s{i % 2}") for i in range(60)]
    rows += [row(300 + i, prose(800 + i, 20) + " " + t + " " + prose(900 + i, 20)) for i, t in items]
    docs = frame(spark, rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "token_files"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.collect(), stage(spark, docs, str(tmp_path))
        after = docs.collect()
        if name == "language_id":
            judged = {(r.doc_id, r.rejected) for r in language.predict(frame(spark, rows)).collect()}
            assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {d for d, bad in judged if bad}
            assert len(after) == len(before) - sum(r.rejected for r in language.predict(frame(spark, rows)).collect())
        elif name == "near_dedup":
            group = groups_by_hand({(r.doc_id, r.text) for r in before})
            assert sorted(group[r.doc_id, r.text] for r in after) == sorted(set(group.values()))
            again = stage(spark, frame(spark, before[::-1]), str(tmp_path)).collect()
            assert sorted(map(repr, again)) == sorted(map(repr, after))
            assert {len(r.text) for r in after if r.doc_id == 12} == {len(prose(5, 30_000)), len(prose(6, 50))}
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.find_leaks(frame(spark, before), spark.createDataFrame(items, "item_id long, text string")).collect()}
            assert {300, 301, 302} <= bad and [r for r in before if r.doc_id in bad] and len(after) == len([r for r in before if r.doc_id not in bad])
        if name != "token_files":
            assert docs.columns == frame(spark, []).columns
            docs = frame(spark, after)
        else:
            assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(after) == len(before)


def test_stages_hand_small_batches_to_python(spark, tmp_path):
    """A task's memory follows from the bytes of a batch: 20 MB of texts arrive as ten batches or more."""

    def sizes_of(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    for _, stage in corpus_pipeline.STAGES[:2]:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        docs = spark.createDataFrame([(1, "some words that are told here", "en", "s1")], "doc_id long, text string, lang string, source string")
        stage(spark, docs, str(tmp_path))
        texts = spark.range(0, 200, 1, 1).selectExpr("repeat('word ', 20000) AS text")
        sizes = [r.n for r in texts.mapInArrow(sizes_of, "n long").collect()]
        assert len(sizes) >= 9 and max(sizes) < 4 << 20
