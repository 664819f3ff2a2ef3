"""SimHash, passages, embeddings, components: against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from graphloom.llm import common, embedding_dedup, simhash, substring_dedup
from graphloom.llm.common import connected_components
from graphloom.llm.decontam import words_of

from .conftest import ODD, prose


def reachable(nodes, linked):
    """Smallest node reachable, by walking."""
    out, left = {}, sorted(nodes)
    while left:
        seen, todo = {left[0]}, [left[0]]
        while todo:
            x = todo.pop()
            for y in left:
                if y not in seen and linked(x, y):
                    seen.add(y)
                    todo.append(y)
        out |= dict.fromkeys(seen, left[0])
        left = [x for x in left if x not in seen]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    path = [(i, i + 1) for i in range(30)]
    edges = path + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(60)] + [(-5, 200)] * 3 + [(7, 7)]
    rng.shuffle(edges)
    near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    want = reachable({x for e in edges for x in e if e[0] != e[1]}, lambda x, y: (x, y) in near)
    found = connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_parted(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "MAP_BITS", bits)
    df = spark.createDataFrame([(f"key {i % 3000}", i) for i in range(6000)] + [(None, -1)], "k string, row long")
    keys = spark.createDataFrame([(f"key {i}",) for i in range(0, 4000, 2)] * 2 + [(None,)], "k string")
    maybe, rest = common.parted(df, keys, "k")
    assert maybe.columns == rest.columns == ["k", "row"]
    apart = {r.row for r in rest.collect()}
    assert sorted([*apart, *(r.row for r in maybe.collect())]) == list(range(-1, 6000))
    assert -1 in apart and not any(i >= 0 and i % 3000 % 2 == 0 for i in apart)
    assert len(apart) > (2800 if bits > 1 << 15 else 2500)
    assert common.parted(df, keys.where("false"), "k")[0].count() == 0


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [None, "", "A", "Ä b\tC\nd", "é " * 7, prose(1, 900), prose(2, 5), "a b c\x1fd e f"]:
        got = simhash.fingerprint(None if t is None else t.encode())
        assert got % (1 << 64) == brute_fingerprint(t)


def test_simhash_components(spark):
    docs = {}
    for g in range(12):
        base = prose(g, 120).split()
        for k in range(4):
            words = base[:]
            words[7 * k + 3] = f"new{k}" * (k > 1)
            docs[10 * g + k] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = reachable(docs, lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 4)
    found = simhash.components(df).withColumn("hex", simhash.hex_fingerprint())
    assert {r.doc_id: (r.component_id, r.hex) for r in found.collect()} == {i: (want[i], f"{fps[i]:016x}") for i in docs}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("wide", [False, True])
def test_simhash_links_in_blocks(spark, monkeypatch, wide):
    """A dense cluster split into blocks connects as a whole, also across them."""
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 300:
        x = center
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    want = reachable(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    monkeypatch.setattr(simhash, "CHUNK", 20)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    roots = connected_components(simhash.links(spark.createDataFrame(signed, "fp long"), wide))
    groups = {}
    for r in roots.collect():
        groups.setdefault(r.root, set()).add(r.node % (1 << 64))
    expected = {}
    for x, y in want.items():
        expected.setdefault(y, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_simhash_odd_rows(odd, empty):
    rows = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.components(odd).collect()), key=str)
    assert len(rows) == len(ODD)
    by = {d: c for _, d, c in rows}
    assert by[1] == by[2] == by[3] == 1 and by[None] == by[4] == by[5] == 4 and by[6] == 6
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7]
    assert simhash.components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(1)
    for n, top in ((60, 1000), (60, 4), (9, 3)):
        h = rng.integers(0, top, n).astype(np.uint64)
        found = list(zip(*(c.tolist() for c in substring_dedup.compact_windows(h, least=10))))
        both = substring_dedup.compact_windows(np.concatenate((h[:9], h)), np.repeat([0, 1], [9, n]), 10)
        assert [(l - 9, x - 9, r - 9) for l, x, r in zip(*(c.tolist() for c in both))] == found
        for a in range(n):
            for b in range(a + 9, n):
                low = h[a : b + 1].min()
                assert any(l <= a and b <= r and h[x] == low for l, x, r in found)
        assert len(found) <= max(1, n)


def test_passages(spark):
    shared, near = prose(50, 60).split(), prose(51, 120).split()
    edited = near[:]
    edited[60] = "changed"
    docs = {
        1: prose(1, 100).split() + shared + prose(2, 90).split(), 2: prose(3, 70).split() + shared, 3: near, 4: prose(4, 30).split() + edited,
        5: prose(5, 200).split(), 6: shared[:40], 7: shared[:30] + prose(6, 50).split() + shared[30:], 8: ["same"] * 300,
    }
    rows = [(i, " ".join(w), 9) for i, w in docs.items()] + [(9, " ".join(docs[5])), (9, " ".join(docs[5])), (10, None), (11, "")]
    df = spark.createDataFrame([(r[0], r[1], 9) for r in rows], "doc_id long, text string, row int")
    found = {r.doc_id: r for r in substring_dedup.report(df).collect()}
    assert {i: r.class_id for i, r in found.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 9: 5}
    assert found[1].spans == "100:160" and found[2].spans == "70:130" and found[4].spans == "30:150"
    assert substring_dedup.report(df).where("doc_id = 9").count() == 2
    assert substring_dedup.report(df.where("false")).count() == 0


def test_no_passage_is_lost(spark):
    rng = random.Random(9)
    pool = [prose(100 + i, rng.randint(55, 90)) for i in range(15)]
    docs = [(i, " ".join([prose(1000 + i, rng.randint(5, 80)), *rng.sample(pool, rng.randint(0, 2)), prose(5000 + i, 20)])) for i in range(80)]
    where = {}
    for i, t in docs:
        w = words_of(t.encode())
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    linked = [v for v in where.values() if len(v) > 1]
    want = reachable(set().union(*linked), lambda x, y: any(x in v and y in v for v in linked))
    got = {r.doc_id: r.class_id for r in substring_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_passages_among_filled_templates(spark):
    """Copies are found among many texts that share most of their words, which are no copies."""
    stock = prose(700, 60).split()
    docs = []
    for i in range(60):
        filled = stock[:]
        for k in range(5, 60, 12):
            filled[k] = f"slot{i}x{k}"
        docs += [(i + 100 * k, " ".join(prose(800 + 2 * i + k, 30, 4000).split() + filled + prose(950 + 2 * i + k, 30, 4000).split())) for k in (0, 1)]
    got = {r.doc_id: (r.class_id, r.spans) for r in substring_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (i % 100, "30:90") for i, _ in docs}


def test_near_passages_beside_edited_stretches():
    """A passage that is near enough counts, whatever its surroundings."""
    for seed in range(40):
        words = prose(300 + seed, 260).split()
        edited = words[:80] + words[80:]
        edited[40] = "new"
        for k in range(84, 180, 8):
            edited[k] = f"new{k}"
        for tail in (180, 120):
            x, y = (substring_dedup.shingles([w.encode() for w in t[:tail]]) for t in (words, edited))
            for p, q in ((x, y), (y, x)):
                found = substring_dedup.verify(p, q)
                assert found and any(a <= 4 and b >= 70 for a, b, _, _ in found)
                rest = substring_dedup.shingles([w.encode() for w in prose(990, 400).split()])
                assert not substring_dedup.verify(p, rest)
                for a, b, c, d in found:
                    both = len(set(p[a:b].tolist()) & set(q[c:d].tolist()))
                    assert min(b - a, d - c) >= 46 and both >= 0.8 * (len(set(p[a:b].tolist()) | set(q[c:d].tolist())))
    # Two places of one passage are both reported.
    words, other = prose(400, 60).split(), prose(401, 60).split()
    x, y = (substring_dedup.shingles([w.encode() for w in t]) for t in (words, words + other + words))
    assert {f[2:] for f in substring_dedup.verify(x, y)} == {(0, 56), (120, 176)}


def test_two_phrases_that_are_frequent_apart(spark):
    """Texts that share two phrases side by side are found among many that hold one of them; the phrases alone are no passage."""
    docs, n = [], 0
    for p in range(10):
        a, b = prose(20_000 + p, 30).split(), prose(21_000 + p, 30).split()
        for middle in [a + b] * 2 + [a] * 40 + [b] * 40:
            docs.append((n, " ".join(prose(22_000 + 2 * n, 40, 4000).split() + middle + prose(22_001 + 2 * n, 40, 4000).split())))
            n += 1
    got = {r.doc_id: (r.class_id, r.spans) for r in substring_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {82 * p + k: (82 * p, "40:100") for p in range(10) for k in (0, 1)}


def brute_alike(x, y, size):
    """Whether some ranges of so many shingles on one diagonal, give or take an edit, are alike."""
    for i in range(0, len(x) - size + 1, 2):
        p = set(x[i : i + size])
        for j in range(0, len(y) - size + 1, 2):
            q = set(y[j : j + size])
            if len(p & q) >= 0.8 * len(p | q):
                return True
    return False


def test_near_passages_are_recalled(spark):
    """Passages of 60 to 120 words with an edit in about each 60 words, among texts that share phrases; recall against all pairs."""
    rng = random.Random(77)
    stock = [prose(30_000 + k, 25).split() for k in range(3)]
    docs, want = [], {}
    for p in range(60):
        own = prose(31_000 + p, rng.randint(60, 120), 3000).split()
        for k in range(2):
            w = own[:]
            if k:
                for at in range(rng.randint(15, 45), len(w), 60):
                    w[at : at + rng.randint(0, 1)] = [f"edit{p}"]
            docs.append((10 * p + k, " ".join(prose(32_000 + 2 * p + k, 30, 3000).split() + rng.choice(stock) + w + prose(33_000 + 2 * p + k, 30, 3000).split())))
        x, y = (substring_dedup.shingles([w.encode() for w in t.split()]).tolist() for _, t in docs[-2:])
        want[10 * p] = brute_alike(x, y, 46)
    got = {r.doc_id: r.class_id for r in substring_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = sum(got.get(i + 1) == i for i, alike in want.items() if alike)
    assert sum(want.values()) >= 40 and found >= 0.95 * sum(want.values()), (found, sum(want.values()))
    assert all(c == i - i % 10 for i, c in got.items())


@pytest.mark.parametrize("block", [512, 16])
def test_no_neighbour_hides_a_near_passage(spark, monkeypatch, block):
    """Many edited copies of one text, of which few share a passage: classes as all pairs give them, however groups are dealt in blocks."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng, base, docs = random.Random(1), prose(60_001, 140, 3000).split(), []
    for i in range(120):
        w, at = base[:], rng.randint(0, 17)
        while at < len(w):
            w[at] = f"edit{i}x{at}"
            at += rng.randint(17, 34)
        docs.append((i, " ".join(w)))
    hashes = [substring_dedup.shingles([w.encode() for w in t.split()]) for _, t in docs]
    linked = {(i, j) for i in range(120) for j in range(i) if substring_dedup.verify(hashes[j], hashes[i])}
    classes = reachable(range(120), lambda x, y: (max(x, y), min(x, y)) in linked)
    want = {i: c for i, c in classes.items() if any(i in p for p in linked)}
    got = {r.doc_id: r.class_id for r in substring_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(want) > 60 and got == want


def test_passages_of_copies(spark):
    """Documents of equal texts are one class; a hot passage in many texts, dealt over many ranges, is one class, too."""
    same, short, hot = prose(41, 80), prose(42, 20), prose(43, 70)
    docs = [(i, same) for i in range(30)] + [(100 + i, short) for i in range(3)] + [(200, same + " " + prose(44, 30)), (None, same)]
    docs += [(1000 + i, f"{prose(5000 + i, 60, 3000)} {hot} {prose(7000 + i, 60, 3000)}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.class_id, r.spans) for r in substring_dedup.report(df).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: 0 if i is None or i < 999 else 1000 for i, _ in docs if i not in (100, 101, 102)}
    assert got[5][1] == "0:80" and got[200][1] == "0:80"
    # The words beside it may be equal by chance.
    for i in range(300):
        a, b = map(int, got[1000 + i][1].split(":"))
        assert 57 <= a <= 60 and 130 <= b <= 133


def brute_links(rows):
    x = {i: np.array(v, float) for i, v in rows.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in x.items() if v.size and np.isfinite(v).all() and v.any()}
    return lambda a, b: a in unit and b in unit and unit[a].size == unit[b].size and unit[a] @ unit[b] >= 0.9


@pytest.mark.parametrize("blocks", [(4096, 16384), (7, 11)])
def test_embeddings(spark, monkeypatch, blocks):
    monkeypatch.setattr(embedding_dedup, "MEMBERS", blocks[0])
    monkeypatch.setattr(embedding_dedup, "VISITORS", blocks[1])
    rng = np.random.default_rng(4)
    rows = {}
    for g in range(40):
        base = rng.normal(size=16)
        for k in range(1 + (g % 4) * 3):
            rows[100 * g + k] = (base + rng.normal(size=16) * 0.12).astype(np.float32).tolist()
    rows[5000], rows[5001] = rows[0], (np.array(rows[0]) * 2).tolist()
    linked = brute_links(rows)
    n = {i: sum(linked(i, j) for j in rows if j != i) for i in rows}
    found = {r.vec_id: r for r in embedding_dedup.components(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")).collect()}
    got = sum(r.n_links for r in found.values())
    assert all(found[i].n_links <= n[i] for i in rows) and got >= 0.95 * sum(n.values()) > 0
    want = reachable(rows, linked)
    # A link that is missed may leave a component in parts, never join two.
    assert all(want[r.component_id] == want[i] for i, r in found.items())
    assert sum(r.component_id == want[i] for i, r in found.items()) >= 0.98 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_odd_embeddings(spark):
    nan = float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.01]), (9, [1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (11, [1e200, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cid int")
    got = sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.components(df).collect()], key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)]
    assert got == sorted([*alone, (7, 4, 7, True), (7, 4, 7, True), (8, 4, 7, False), (None, 4, 7, False), (11, 4, 7, False)], key=str)
    assert embedding_dedup.components(df.where("false")).count() == 0
