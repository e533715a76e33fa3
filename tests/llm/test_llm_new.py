"""Merkle manifests, byte networks and token alignment on small tables."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from llm_cases import awkward, frame, prose, row

from palaver.llm import align, entries, merkle, quality


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, siblings of each node, level by level)."""
    proofs, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i, leaves in enumerate(at):
            run = range(i // 8 * 8, min(i // 8 * 8 + 8, len(nodes)))
            for leaf in leaves:
                proofs[leaf].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [sum(at[i : i + 8], []) for i in range(0, len(at), 8)]
    return nodes[0] if nodes else None, proofs


def merkle_twin(rows):
    """One tuple a row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""

    def leaf(r, text):
        return H(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))

    branches = collections.defaultdict(list)
    for r in rows:
        branches[r[2]].append(((r[0] is not None, r[0] or 0, leaf(r, r[1])), r))
    names = sorted(branches, key=lambda x: (x is not None, (x or "").encode()))
    grown = {}
    for name in names:
        branches[name].sort(key=lambda x: x[0])
        grown[name] = tree([key[2] for key, _ in branches[name]])
    root, tops = tree([grown[name][0] for name in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        subroot, proofs = grown[name]
        for (key, r), proof in zip(branches[name], proofs, strict=True):
            path, text = proof + top, r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = leaf(r, text)
            for before, after in path:
                h = H(before, h, after)
            out.append((r[0], key[2], subroot, root, H(*[x + y for x, y in path]), h, h == root))
    return out


def sortable(rows):
    return sorted(map(repr, rows))


def test_merkle(spark):
    rows = awkward() + [row(100 + i, f"Text {i}", "en" if i % 3 else "pt", None) for i in range(1700)] + [row(5000 + i, "lone", f"l{i}") for i in range(70)]
    got = merkle.document_proofs(frame(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sortable(map(tuple, got.collect())) == sortable(merkle_twin(rows))
    for few in ([], rows[:1], rows[3:4], rows[20:29]):
        assert sortable(map(tuple, merkle.document_proofs(frame(spark, few)).collect())) == sortable(merkle_twin(few))


def test_manifest_of_any_table(spark):
    rows = frame(spark, [row(i, "x") for i in range(20)]).withColumnsRenamed({"value": "node", "label": "path", "before": "pos"})
    from pyspark.sql import functions as F

    out = merkle.manifest(rows, F.col("lang"), ["size", "doc_id"], merkle.digest(F.col("doc_id")), F.lit(None).cast("string"), ["doc_id", "node", "path", "pos"])
    got = {r.row.doc_id: r for r in out.collect()}
    root, proofs = tree([H(field(i)) for i in range(20)])
    for i in range(20):
        assert [(s.before, s.after) for s in got[i].path] == proofs[i]
        assert (got[i].leaf, got[i].root, got[i].folded_root, got[i].branch) == (H(field(i)), root, root, "en")


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(entries.tokenizer_file())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=entries.tokenizer_file("piece_bpe_32k.model"))


def alignment_twin(rows, both):
    """Literal walk over bytes: which token of either side holds each byte."""
    a_tok, b_tok = both
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    found, total = [], collections.Counter()
    for r in rows:
        text = r[1] or ""
        raw = (" " + text).encode()
        a = [(i, bytes(byte_of[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in b_tok.encode(text):
            p = b_tok.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append((r[0], 0, 0, [], []))
            continue
        of_a, of_b = ([k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b))
        links = [(a[i][0], b[j][0]) for i, j in sorted(set(zip(of_a, of_b, strict=True)))]
        total.update(links)
        groups, now = [], ([], [])
        for k in range(len(raw)):
            ends = [k + 1 == len(raw) or of[k + 1] != of[k] for of in (of_a, of_b)]
            for side, of, toks, end in zip(now, (of_a, of_b), (a, b), ends, strict=True):
                if end:
                    side.append(toks[of[k]][0])
            if all(ends):
                groups.append("|".join(",".join(map(str, side)) for side in now))
                now = ([], [])
        found.append((r[0], len(a), len(b), groups, links))
    highest = collections.Counter()
    for (_, b), n in total.items():
        highest[b] = max(highest[b], n)
    return [
        (doc, n_a, n_b, len(groups), len(links), sum(total[x] == highest[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, n_a, n_b, groups, links in found
    ]


def test_alignment(spark, both, monkeypatch):
    texts = [
        "<|endoftext|> plain </s> <s> <unk> <0x41>", "a▁b", "  two  blanks ", "tab\there\r\nand\n\nthere", "\x00zero", "\U0001f600 é ﬁ ①", "a", " ", "\n", ".",
        "don't we'll I'M 12,345.67 x=y+z; f(a)[b] http://x.org/?q=1", "café naïve Ångström", "word word 　 wide", "trailing ", " leading", "x" * 100,
    ]
    rows = awkward() + [row(100 + i, t) for i, t in enumerate(texts)] + [row(200 + i, prose(i, 80)) for i in range(30)]
    monkeypatch.setattr(align, "BLOCK_BYTES", 9_000)
    monkeypatch.setattr(align, "BATCH_BYTES", 2_500)
    files = entries.tokenizer_file(), entries.tokenizer_file("piece_bpe_32k.model")
    got = align.align(frame(spark, rows).repartition(3), *files)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sortable(map(tuple, got.collect())) == sortable(alignment_twin(rows, both))
    for few in ([], awkward()[3:5]):
        assert sortable(map(tuple, align.align(frame(spark, few), *files).collect())) == sortable(alignment_twin(few, both))


def test_given_texts_align(spark, both):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sortable(map(tuple, entries.op13(spark, folder).collect())) == sortable(alignment_twin(rows, both))


def network_twin(net, text):
    """The network byte by byte and filter by filter, without batches."""
    w, q = {k: v.astype(np.float64) for k, v in net.weights.items()}, quality
    reach = q.SPAN * q.STRIDE
    halves = max(2, -(-(len(text) + reach - q.STRIDE) // q.HALF))
    raw = text + bytes(halves * q.HALF + reach - len(text))
    pooled = np.zeros((halves, q.FILTERS))
    for at in range(0, halves * q.HALF - (q.SPAN - 1) * q.STRIDE, q.STRIDE):
        value = w["bias"].copy()
        for k in range(q.SPAN):
            x = w["embed"][list(raw[at + k * q.STRIDE : at + (k + 1) * q.STRIDE])].ravel()
            value += x @ w["filters"][:, k * q.FILTERS : (k + 1) * q.FILTERS]
        pooled[at // q.HALF] = np.maximum(pooled[at // q.HALF], value)
    chunks = [np.maximum(a, b) for a, b in zip(pooled[:-1], pooled[1:], strict=True)]
    f = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0), np.min(chunks, 0)])
    hidden = np.maximum(f @ w["dense"] + w["dense_bias"], 0)
    return 1 / (1 + np.exp(-float(hidden @ w["out"] + w["out_bias"][0])))


def test_network(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 12)
    r = np.random.default_rng(1)
    texts = [prose(i, 5 + 9 * i).encode() for i in range(40)] + [b"?!" * (3 + 20 * i) for i in range(40)] + [b"", b"a", bytes(r.integers(0, 256, 999, dtype=np.uint8))]
    net = quality.fit(texts, np.array([1] * 40 + [0] * 40 + [1, 1, 0]))
    offsets = np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    got = quality.score(net, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.allclose(got, [network_twin(net, t) for t in texts], atol=1e-5)
    # gradients against differences of the loss
    part = [1, 3, 45, 50, 82]
    data, cut = np.frombuffer(b"".join(texts[i] for i in part), np.uint8), np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
    label, weight = np.array([1, 1, 0, 0, 0], np.float32), np.array([1, 2, 1, 3, 1], np.float32)

    def loss(w):
        p = quality.score(quality.Network(w), data, cut)
        return float(-(weight * np.where(label == 1, np.log(p), np.log(1 - p))).mean())

    wide = {k: v.astype(np.float64) for k, v in net.weights.items()}
    g = quality._gradients(wide, data, cut, label, weight)
    for name, value in wide.items():
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in value.shape) if name != "embed" else (int(data[r.integers(len(data))]), int(r.integers(quality.EMBED)))
            moved = [{**wide, name: value.copy()} for _ in range(2)]
            moved[0][name][at] += 1e-6
            moved[1][name][at] -= 1e-6
            assert abs((loss(moved[0]) - loss(moved[1])) / 2e-6 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))


def test_quality(spark, monkeypatch):
    good = [row(i, prose(i, 40 + i)) for i in range(90)]
    bad = [row(100 + i, " ".join(f"W{i}!!" for _ in range(20 + i))) for i in range(90)]
    docs = awkward() + [row(1000 + r[0], *r[1:4]) for r in good + bad]
    labels = [(1000 + r[0], int(r[0] < 100), None) for r in good + bad] + [(None, 1, 0), (1001, None, 0), (1002, 7, 0), (4, 1, 0), (5, 0, 1), (5, 0, 1), (99, 1, 1)]
    tags = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    monkeypatch.setattr(quality, "STEPS", 200)
    got = quality.predict(frame(spark, docs), tags).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in docs)
    truth = {x: q for x, q, _ in labels if x and x >= 1000 and q in (0, 1)}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 20 and np.mean(right) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= quality.THRESHOLD)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert {r.score for r in quality.predict(frame(spark, docs), tags.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.predict(frame(spark, docs), tags.where("quality = 1")).collect()} == {1.0}
    assert quality.predict(frame(spark, []), tags).collect() == []


def test_quality_of_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(r, truth[r.doc_id]) for r in entries.op12(spark, folder).collect() if r.held_out and r.doc_id in truth]
    one, zero = ([r.score for r, q in got if q == k] for k in (1, 0))
    assert np.mean([[x > y for y in zero] for x in one]) > 0.95
    assert np.mean([r.predicted == q for r, q in got]) > 0.9
