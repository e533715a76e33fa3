"""Near duplicates, repeated strings and decontamination against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from llm_cases import awkward, frame, prose, row

from palaver.llm import decontaminate, hashing, near_dup, suffix_dedup
from palaver.llm.shared import components


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)] if words else [])


def components_by_hand(docs, size, percent=80):
    """Over (doc_id, text) with ids: {doc_id: smallest id reachable}."""
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, size)) for d, t in docs]
    for (d, x), (e, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(d), root(e)))
            parent[b] = a
    return {d: root(d) for d, _ in docs}


def check_near(spark, rows, size):
    got = near_dup.near_duplicates(frame(spark, rows), shingle=size).collect()
    want = components_by_hand([(r[0], r[1]) for r in rows if r[0] is not None], size)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted((r[0] is None, r[0] or 0, len(shingles(r[1], size))) for r in rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_awkward(spark, size):
    check_near(spark, awkward(), size)


def test_near_duplicates_chains_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CROWDED", 3)
    r = random.Random(4)
    rows, shared = [], prose(99, 60).split()
    for g in range(4):
        words = prose(g, 200).split()
        for i in range(18):  # chains: each copy changes the one before
            if i:
                for _ in range(r.randrange(1, 12)):
                    words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            rows.append(row(len(rows), " ".join(words)))
    for i in range(40):  # a passage in common, the rest its own
        rows.append(row(len(rows), " ".join(shared) + " " + prose(1000 + i, 70, 10**6)))
    check_near(spark, rows, 2)


def test_short_lists_meet_as_pairs(spark, monkeypatch):
    """Only lists of more than SHORT rows go on to the rounds of pivots; no link is lost by that."""
    monkeypatch.setattr(near_dup, "SHORT", 4)
    seen, opened = [], near_dup._open_lists

    def recorded(lists, labels):
        seen.extend(r["count"] + 1 for r in lists.groupBy("value").count().collect())  # and the head
        return opened(lists, labels)

    monkeypatch.setattr(near_dup, "_open_lists", recorded)
    r = random.Random(8)
    passage, rows = prose(77, 12, 10_000).split(), []
    for g in range(5):
        words = prose(100 + g, 150, 3000).split()
        for i in range(4):  # chains; the least id is not near all others
            words = words[:]
            for _ in range(7):
                words[r.randrange(150)] = f"c{g}x{i}x{r.random()}"
            rows.append(row(len(rows) + 1, " ".join(words + passage[3 * (g % 3) :])))
    r.shuffle(rows)
    check_near(spark, rows, 2)
    assert all(n > 4 for n in seen)


def test_pivots_meet_a_member_in_one_list(spark, monkeypatch):
    """Near documents share most of their lists; a pair of them is formed about once, and no link is lost by that."""
    monkeypatch.setattr(near_dup, "SHORT", 2)
    monkeypatch.setattr(near_dup, "PIVOTS", 4)
    made, pairs, met = [], [], near_dup._met

    def recorded(*args):
        found = met(*args).cache()
        rows = [(x.p, x.doc_id) for x in found.collect()]
        made.append(len(rows))
        pairs.append(len({frozenset(x) for x in rows}))
        return found

    monkeypatch.setattr(near_dup, "_met", recorded)
    r = random.Random(5)
    rows = []
    for g in range(2):
        base = prose(50 + g, 800, 5000).split()
        for i in range(25):  # copies of a text that is not there: about as far from each other as the threshold
            words = base[:]
            for j in r.sample(range(800), 21 + i % 8):
                words[j] = f"e{g}x{i}x{j}"
            rows.append(row(100 * g + i + 1, " ".join(words)))
    rows += [row(105, rows[3][1] + " one more"), row(7, rows[30][1] + " two more")]  # ids that have two texts
    r.shuffle(rows)
    check_near(spark, rows, 2)
    assert sum(pairs) > 50 and sum(made) <= 3 * sum(pairs)


def test_full_lists_take_one_python_step(spark):
    """Sets are made and picked from by one function; of a set of n values a linked one holds percent at least."""
    rows = [row(1, prose(1, 60)), row(2, prose(2, 3)), row(3, None), row(4, prose(3, 40))]
    docs = frame(spark, rows)
    found = near_dup._full_lists(docs, None, docs.select("doc_id"), 2, 80)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    size = {r[0]: len(shingles(r[1], 2)) for r in rows}
    listed = collections.Counter((r.doc_id, r.n) for r in found.collect())
    assert listed == {(d, n): n - -(-n * 80 // 100) + 1 for d, n in size.items() if n}


def test_shared_values_bound():
    assert near_dup.shared_values(near_dup.K, 80) <= near_dup.K * 0.8
    values = [near_dup.shared_values(n, 80) for n in (64, 100, 300, 1000, 10**6)]
    assert values == sorted(values, reverse=True) and values[-1] >= 28


def test_near_duplicates_empty(spark):
    assert near_dup.near_duplicates(frame(spark, [])).collect() == []


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_words_match_split():
    texts = ["", "a", " A  b\tc\x0bd ", "é\u00a0x y", "x" * 5, "q " * 10]
    import pyarrow as pa

    data, offsets = hashing.utf8(pa.array([*texts, None]))
    got, first = hashing.Words().of(data, offsets)
    lists = [got[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    table = {}
    for text, hashes in zip([*texts, ""], lists):
        words = text.encode().lower().split()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)


def test_words_of_long_text(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(3000)) + " " + "y" * 3000 + " end"
    data, offsets = hashing.utf8(pa.array([text]))
    whole, _ = hashing.Words().of(data, offsets)
    monkeypatch.setattr(hashing, "PIECE", 512)
    pieces, first = hashing.Words().of(data, offsets)
    assert (whole == pieces).all() and first.tolist() == [0, len(whole)]


def removed_by_hand(rows):
    seen = collections.defaultdict(set)
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            seen[b[i : i + 50]].add(d if d is not None else float("inf"))
    least = {k: min(v) for k, v in seen.items()}
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < (d if d is not None else float("inf")):
                gone[i : i + 50] = True
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d is None, d or 0, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, monkeypatch, hot):
    if hot:  # small chunks, and every bucket of two contexts counts as crowded; tiles that cut texts
        monkeypatch.setattr(suffix_dedup, "CONTEXTS", 1)
        monkeypatch.setattr(suffix_dedup, "CHUNK", 200)
        monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    r = random.Random(2)
    rows = [x[:2] for x in awkward() if len(x[1] or "") < 60_000]
    passage = prose(77, 30)
    for i in range(40):
        own = prose(200 + i, 40)
        cut = r.randrange(len(own))
        rows.append((100 + i, own[:cut] + passage[r.randrange(40) :] + own[cut:]))
    for i in range(10):
        words = prose(3, 80).split()
        words[r.randrange(80)] = "edit"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, "ab" * 300), (301, "b" + "ab" * 100), (302, "é" * 60), (303, "x" + "é" * 40)]
    got = suffix_dedup.remove_repeats(frame(spark, [row(*x) for x in rows]).repartition(3)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == removed_by_hand(rows)


def test_repeats_of_a_spread_bucket_settled_by_one_document(spark):
    import pyarrow as pa

    r = random.Random(12)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    candidates = noise(40_000)
    data, _ = hashing.utf8(pa.array([candidates]))
    at = int(suffix_dedup.Grams().order(data).argmin())
    gram = candidates[at : at + suffix_dedup.Q]  # the minimiser of whatever window holds it
    sides = {d: (noise(60), noise(suffix_dedup.SPAN)) for d in range(5, 26)}
    sides[10] = sides[10][0], sides[5][1]  # shares 50 bytes with documents 1 and 5 only
    far = [(d, a + gram + b) for d, (a, b) in sides.items()]
    near = [(1, dict(far)[5] + noise(80) + dict(far)[25])]
    docs = frame(spark, [row(*x) for x in far]).coalesce(1).unionByName(frame(spark, [row(*x) for x in near]).repartition(2))
    assert docs.rdd.getNumPartitions() == 3  # so that each side is a chunk of its own
    got = suffix_dedup.remove_repeats(docs).collect()
    want = removed_by_hand(far + near)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
    assert next(x for x in want if x[1] == 10)[3] >= 50


def test_repeats_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_masks_cover_the_tolerance():
    masks = [[j for j, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for n in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        for bad in itertools.combinations(range(n), decontaminate.tolerance(n)):
            assert any(not set(bad) & {o + j for j in m} for m in masks for o in range(n - m[-1]))


def leaks_by_hand(docs, items):
    """{(doc, item): (start, words, equal)} of the best diagonal, the earliest of equal ones."""
    found = {}
    for d, t in docs:
        doc = (t or "").encode().lower().split()
        for i, x in items:
            item = (x or "").encode().lower().split()
            n = min(13, len(item))
            spare = n // 6 if len(item) >= 8 else 0
            for move in range(-len(item) + 1, len(doc)) if item else ():
                pairs = [(p, doc[p] == item[p - move]) for p in range(max(0, move), min(len(doc), move + len(item)))]
                good = [a for a in range(len(pairs) - n + 1) if sum(same for _, same in pairs[a : a + n]) >= n - spare]
                if good:
                    stretch = pairs[good[0] : good[-1] + n]
                    best = (sum(same for _, same in stretch), -stretch[0][0], len(stretch))
                    found[d, i] = max(found.get((d, i), best), best)
    return {k: (-start, n, same) for k, (same, start, n) in found.items()}


def test_leaks_of_equal_words_in_pieces(monkeypatch):
    def found():
        import pyarrow as pa

        seeds = decontaminate.Seeds(pa.array(["a " * 300, "a b " * 100, "b " * 5]), [1, 2, 3])
        data, offsets = hashing.utf8(pa.array(["a " * 5000, "a b " * 2500, "c"]))
        return seeds.leaks(*hashing.Words().of(data, offsets))

    whole = found()
    assert whole == {(0, 0): (300, 0, 300), (1, 1): (200, 0, 200)}
    monkeypatch.setattr(decontaminate, "HITS", 1000)
    assert found() == whole


@pytest.mark.parametrize("blocks", [1, 3])
def test_leaks(spark, monkeypatch, blocks):
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    items = [(i, prose(500 + i, 8 + 3 * i)) for i in range(8)] + [(20, "so Short"), (21, None), (22, prose(702, 7)), (23, "z"), (24, "z z z"), (25, "z " * 9), (26, "x y " * 8), (27, " "), (None, prose(700, 20)), (30, prose(701, 15))]
    rows = awkward()
    r = random.Random(8)
    for k, (_, text) in enumerate(items[:8]):
        words = text.split()
        for j in range(k % 4):
            words[r.randrange(len(words))] = f"sub{j}"
        rows.append(row(50 + k, prose(600 + k, 25) + " " + " ".join(words).upper() + " " + prose(650 + k, 25)))
    rows.append(row(70, prose(700, 20)))
    rows += [row(71, "sO short"), row(72, "so very short so short so short"), row(73, prose(703, 30) + " " + prose(702, 7)), row(74, prose(702, 7).replace("w", "q", 1))]
    rows += [row(75, "z " * 60), row(76, "x y " * 30), row(77, "so z " * 9), row(78, "z " * 12 + "y " + "z " * 12)]
    docs, benchmark = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(docs, benchmark).collect()
    want = leaks_by_hand([x[:2] for x in rows], items)
    rows_ = [x for x in rows if x[0] != 12]  # its two texts are looked at below by their presence alone
    assert {(x.doc_id, x.item_id): (x.doc_start, x.n_words, x.n_equal) for x in got if x.doc_id != 12} == {k: v for k, v in leaks_by_hand([x[:2] for x in rows_], items).items()}
    assert {(x.doc_id, x.item_id) for x in got} == set(want) and len(want) > 12
    assert {(71, 20), (72, 20), (73, 22), (75, 25), (76, 26), (78, 24)} <= set(want) and (74, 22) not in want
    assert all(x.coverage == x.n_equal / len(dict(items)[x.item_id].split()) for x in got)
    kept = decontaminate.drop_leaked(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == len([x for x in rows if x[0] not in {d for d, _ in want}])
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), benchmark).count() == 0
