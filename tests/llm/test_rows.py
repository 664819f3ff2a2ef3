"""Operators on single rows: decontamination, secrets, language, licences, chats, toxicity, BPE."""

import hashlib
import random
import re
import textwrap

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, chat_format, decontam, language_id, license_scan, queries, secret_scan, toxicity

from .conftest import ODD, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_decontamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(13, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    ids.add(str(i))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def brute_contaminated(text, items):
    """The stage's rule: a whole window of 13 words, or a twentieth of the words."""
    if brute_decontamination([(0, text)], items)[0][-1]:
        return True
    long = [(i, x) for i, x in items if len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x or "")) >= 13]
    return brute_decontamination([(0, text)], long)[0][2] > 0


@pytest.mark.parametrize("sieve, hot", [(decontam.SIEVE_BYTES, decontam.HOT_LEAST), (2000, 3)])
def test_decontamination(spark, monkeypatch, sieve, hot):
    """Also with words sought by a bit map and with hot words dealt over salts."""
    monkeypatch.setattr(decontam, "SIEVE_BYTES", sieve)
    monkeypatch.setattr(decontam, "HOT_LEAST", hot)
    items = [(i, prose(i, n)) for i, n in enumerate([13, 40, 5, 1, 12, 14])] + [(2, prose(1, 40)), (9, None), (10, ""), (11, "the the the"), (12, prose(1, 40))]
    rng = random.Random(1)
    docs = [(i, " ".join([prose(50 + i, rng.randint(0, 60)), (items[i % 7][1] or "").upper(), prose(90 + i, rng.randint(0, 900))])) for i in range(20)]
    docs += [(30, None), (31, ""), (32, "The THE the the x"), (32, "The THE the the x"), (None, items[1][1]), (33, " ".join(prose(1, 40).split()[5:25]))]
    docs += [(40, prose(400, 20_000) + " " + items[1][1] + " " + prose(401, 20_000)), (41, "the the the " + prose(402, 500))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, __Key int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(d.select("doc_id", "text"), b)
    assert sorted(map(tuple, got.collect()), key=str) == brute_decontamination(docs, items)
    clean = decontam.remove_contaminated(d, b)
    assert clean.columns == ["doc_id", "text", "__Key"] and clean.where("__Key <> 1").count() == 0
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for i, t in docs if not brute_contaminated(t, items)), key=str)
    kept = {r.doc_id for r in clean.collect()}
    assert 40 not in kept and {30, 31, 41} <= kept
    assert decontam.report(d.where("false"), b).count() == 0
    assert decontam.report(d, b.where("false")).where("n_hit > 0").count() == 0


SECRETS = [
    "password = hunter22x", "my PassWord: 'abcdef' API_KEY=\"0123456789\"", "token=token: abcdefgh", "secret=abc token=abc123", "apikey:x" * 3 + "abcdefg",
    "AKIA" + "A1" * 10, "AKIA123 AKIAAKIA" + "Z" * 20, "f" * 24 + " " + "0" * 23, "é日本 secret = ünï passwd=ok/+.-_=a", None, "",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "AIza" + "b" * 35, "xoxb-1234567890-ab", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "toſen secretK",
]


def brute_spans(text):
    out = []
    for rank, r in enumerate(secret_scan.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, f"{r.name}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_secrets(spark, odd, empty):
    rng = random.Random(2)
    texts = [*SECRETS, *(" ".join(rng.sample([s or "" for s in SECRETS], 5)) for _ in range(20))]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)] * 2, "doc_id long, text string, found string")
    got = secret_scan.report(df).collect()
    assert len(got) == 2 * len(texts) and all(r.spans == brute_spans(texts[r.doc_id]) for r in got)
    kept = secret_scan.remove_leaks(df)
    assert kept.columns == df.columns and kept.where("found <> 'y'").count() == 0 and kept.count() == 2 * sum(not brute_spans(t) for t in texts)
    assert secret_scan.report(odd).count() == len(ODD) and secret_scan.report(empty).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None and secret_scan.trigram_query("ab?c*") is None
    assert secret_scan.trigram_query("abcd(x|y)") == [frozenset({"abc", "bcd", "cdx"}), frozenset({"abc", "bcd", "cdy"})]
    assert secret_scan.trigram_query("(abc|d*)e") is None and secret_scan.trigram_query("foo.*BAR") == [frozenset({"foo", "bar"})]
    for r in secret_scan.RULES:
        wanted = secret_scan.trigram_query(r.pattern)
        for s in filter(None, SECRETS):
            if wanted and re.search(r.pattern, s):
                grams = {s.lower()[i : i + 3] for i in range(len(s) - 2)}
                assert any(c <= grams for c in wanted)


def languages(spark, n=300):
    rng = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["öst", "und", "ver"], "cc": ["tion", "que", "eau"]}
    word = lambda l: "".join(rng.choice(parts[l]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(l) for _ in range(rng.randint(5, 60))), l) for i in range(n) for l in [rng.choice(list(parts))]]
    return spark.createDataFrame([*rows, (n, None, "aa"), (n + 1, "123 !!", "aa"), (n + 2, "", None), (n + 3, "eauque " * 20_000, None)], "doc_id long, text string, lang string")


def test_language_id(spark, odd, empty):
    df = languages(spark)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    known = [r for r in df.collect() if r.lang and r.text and r.doc_id < 300]
    held = [r for r in known if got[r.doc_id].held_out]
    assert len(held) > 20 and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (300, 301, 302)) and got[303].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in known} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id in (300, 301, 302)").count() == 0
    made = language_id.classify(odd, {"aa": b" one two three "})
    assert made.count() == len(ODD) and made.where("text is null").first().lang_pred == "und"
    assert language_id.identify(df.where("false")).count() == 0


def test_licenses(spark, odd, empty):
    texts = ["Some prose.\nReleased under the MIT License.\nmore", "This work is licensed\nunder the GNU General Public Licence, version 3.\n\nx", "(c) 2020 A Company. All rights reserved.", "no licence at all here", None, "", license_scan.TEMPLATES["ISC"][0].upper()]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(7)] == ["MIT", "GPL-3.0", "none", None, None, None, "ISC"] and got[0].matches == "MIT:12:43" and got[4].n_matches == 0
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(empty).count() == 0


def test_licenses_in_any_wrapping():
    m, grant, gpl = license_scan.Matcher(), license_scan.TEMPLATES["MIT"][2], license_scan.TEMPLATES["GPL-3.0"][1]
    more = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rest = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.'
    mit = ["MIT License", "Copyright (c) 2020 Some One", grant, more, rest]
    for mark in ("", " * ", "# ", "// ", "dnl "):
        for width in (50, 72, 10_000):
            for parts, name, start in ((mit, "MIT", "Permission"), (["Foo, a tool.", gpl, more, rest], "GPL-3.0", "This")):
                text = ("\n" + mark.rstrip() + "\n").join("\n".join(mark + x for x in textwrap.wrap(p, width)) for p in parts)
                found = [f for f in m.scan(text) if f[2] == name]
                assert len(found) == 1 and start in text[found[0][0] : found[0][1]], (mark, width, name)
    assert [f[2] for f in m.scan(" ".join(mit))] == ["MIT"]
    line = "Foo is a small tool for many things. Released under the MIT License. See the docs for more."
    assert [(line[a:b], n, d) for a, b, n, d in m.scan(line)] == [("Released under the MIT License", "MIT", 1.0)]
    assert [f[2] for f in m.scan("x " * 50 + line + " y" * 50 + " Licensed under CC BY 4.0. " + line)] == ["MIT", "CC-BY-4.0", "MIT"]


def test_license_bounds_lose_nothing():
    """The size bounds give what comparing every template gives."""
    m, rng = license_scan.Matcher(), random.Random(1)
    for _ in range(300):
        words = license_scan.normalised(rng.choice([x for t in license_scan.TEMPLATES.values() for x in t]))
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["the", "of", "zz"]))
        own = license_scan.bigrams(words)
        best = max((license_scan.dice(own, b) for _, b in m.known), default=0)
        got = m.match(" ".join(words))
        assert (got[1] if got else 0) == (best if best >= m.threshold else 0)


def test_licenses_that_begin_alike():
    """Whole BSD texts are told apart, also within other text and with words changed; their common head is a general name."""
    m, two, three = license_scan.Matcher(), license_scan.TEMPLATES["BSD-2-Clause"][1], license_scan.TEMPLATES["BSD-3-Clause"][1]
    head, mit, isc = license_scan.TEMPLATES["BSD"][0], license_scan.TEMPLATES["MIT"][3], license_scan.TEMPLATES["ISC"][1]
    for text, name in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (head, "BSD"), (mit, "MIT"), (isc, "ISC")):
        for around in ("{}", "Foo, a tool.\n\n{}\n\nUse it well, and often, for many things.", prose(7, 60) + " {} " + prose(8, 60)):
            for width in (60, 100_000):
                body = "\n\n".join("\n".join(textwrap.wrap(x, width)) for x in re.split(r" (?=THIS SOFTWARE IS|[123]\. )", text))
                assert [f[2] for f in m.scan(around.format(body))] == [name], (name, around, width)
    changed = three.replace("copyright holder nor", "university nor").replace("source code", "sources")
    assert [f[2] for f in m.scan("\n\n".join(["Read this.", *changed.split(": ", 1)]))] == ["BSD-3-Clause"]


def test_license_windows_lose_nothing():
    """The best window of each template has the best coefficient of all windows of words, tried one by one."""
    known = {"a": ("one two three four five six",), "b": ("three four five six seven eight nine ten",), "a-b": ("two three four",)}
    m, rng = license_scan.Matcher(known), random.Random(4)
    for _ in range(200):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += rng.choice([*known.values()])[0].split() + [rng.choice(["x", "y", "two"])] * rng.randint(0, 3)
        words = [w for w in words if rng.random() > 0.1]
        got = {}
        for _, _, name, d in m.windows(" ".join(words)):
            got[name] = max(d, got.get(name, 0))
        best = {}
        for name, b in m.known:
            each = [license_scan.dice(license_scan.bigrams(words[i:j]), b) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
            if max(each, default=0) >= m.threshold:
                best[name] = max(each)
        assert got == best


CHATS = [(1, 0, "user", "plain"), (1, 1, "assistant", "a </turn>\n### user: x \\ y"), (2, 1, "assistant", "#" * 5 + "</turn>\n" * 3 + "\\\\"), (2, 0, "user", None), (2, 2, None, "t"), (3, None, "a: b\n", ""), (3, 1, "assistant", "</turn>"), (None, 0, "assistant", "é日"), (4, 1, "user", "same"), (4, 1, "user", "same")]


def test_chats(spark):
    df = spark.createDataFrame([(*r, 1) for r in CHATS], "conv_id long, turn long, role string, text string, body int")
    got = {r.conv_id: r for r in chat_format.report(df).collect()}
    full = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    for c in {r[0] for r in CHATS}:
        turns = sorted([(t is not None, t or 0, r or "", x or "") for i, t, r, x in CHATS if i == c])
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(turns), sha(text), len(loss), sha(loss), len(full[c].formatted))
        bodies = [full[c].formatted[m.start : m.end] for m in full[c].mask]
        assert "".join(re.sub(r"\\(.)", r"\1", b, flags=re.S) if "\\" in b else b for b in bodies) == loss
    assert full[1].formatted.startswith("### user: plain </turn>\n### assistant: ")
    assert chat_format.report(df.where("false")).count() == 0


def test_bpe(spark, odd, empty):
    library, own, rng = Tokenizer.from_file(PATH), bpe.Encoder(open(PATH, "rb").read()), random.Random(3)
    letters = "abcdefgh ABC 'sé É́ßİΣσ中文🎉‍\x1c\x85\xa0123½ⅷ²<|endoftext|></w>\n\t.,!?-'re'll"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["", "a" * 3000, "<|startoftext|>x<|endoftext|>", "ΑΣ ΑΣ", "don't we'll they're", prose(1, 300), "</w>", "ȀȐɏ ɐ"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == want.ids
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
    rows = spark.createDataFrame(list(enumerate(texts[-60:])), "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.encode(rows, PATH, ids=True).collect():
        ids = library.encode(texts[-60:][r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.ids_sha256) == (ids, len(ids), sha(" ".join(map(str, ids)))) and r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    got = bpe.encode(odd, PATH)
    assert got.count() == len(ODD) and got.where("doc_id = 1").first().n_tokens == 0 and bpe.encode(empty, PATH).count() == 0


def test_columns_that_clash_in_another_case(spark):
    df = spark.createDataFrame([(1, "some text", 5, 6, 7, 8)], "doc_id long, text string, Score int, N_TOKENS int, License int, LANG_PRED int")
    assert bpe.encode(df, PATH).select("n_tokens", "Score").first().n_tokens == 2
    assert license_scan.scan(df).select("license", "Score").first().license is None
    assert toxicity.score(df, toxicity.train([], [])).select("score", "License").first().score < 0.5
    assert language_id.classify(df, {"aa": b" some text "}).select("lang_pred", "N_TOKENS").first().lang_pred == "aa"


def test_tied_turns_are_ordered_by_text(spark):
    rows = [(1, 0, "user", "#z </turn>\n"), (1, 0, "user", "$"), (1, 0, "tool", "t"), (1, 1, "assistant", "long " * 50_000)] + [(2, i, "assistant", f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert [(t.role, t.text[:9]) for t in got[1].turns] == [("tool", "t"), ("user", "#z </turn"), ("user", "$"), ("assistant", "long long")]
    assert "".join(got[2].formatted[m.start : m.end] for m in got[2].mask) == "".join(f"t{i}" for i in range(700))


def test_bpe_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 3)
    own, text = bpe.Encoder(open(PATH, "rb").read()), prose(8, 400)
    assert own.encode(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_toxicity_gradient():
    """The step moves parameters against the loss's slope, found by differences."""
    m = toxicity.Model()
    parts = toxicity._inputs([b" ", *words(20)])
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 21, (6, 8))
    ids[0, 5:] = 0
    y = np.array([1, 0, 1, 0, 0, 1], np.float32)

    def loss():
        x = toxicity.arranged((m.features(*parts) @ m.p["w"] + m.p["wb"])[ids])
        z = m.forward(x, ids.T > 0)[0].astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    slopes = {}
    for name, at in (("u", (0, 2, 5)), ("w", (3, 40)), ("a", (4, 2)), ("o", (5, 0)), ("v", (1, 0)), ("wb", (20,)), ("u", (1, 3, 20))):
        old = m.p[name][at]
        m.p[name][at] = old + 1e-2
        up = loss()
        m.p[name][at] = old - 1e-2
        slopes[name, at] = (up - loss()) / 2e-2
        m.p[name][at] = old
    m.step(m.features(*parts), parts, ids, ids.T > 0, y)
    for (name, at), s in slopes.items():
        assert abs(m.moments[name][0][at] / 0.1 - s) < 2e-3 + 0.05 * abs(s)


def words(n):
    return [f"w{i}".encode() for i in range(n)]


def test_toxicity(spark, odd, empty):
    rng = random.Random(7)
    bad = ["zargle", "zarglen", "zarglest", "vrotz"]
    rows, marks = [], []
    for i in range(600):
        text, toxic = prose(i % 30, rng.randint(5, 300)).split(), i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text) + 1), rng.choice(bad))
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    held = [i for i, r in got.items() if r.held_out]
    truth = dict(marks)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held) and all(r.predicted == (r.score >= 0.3) for r in got.values())
    untrained = toxicity.train([], [])
    assert toxicity.score(odd, untrained).count() == len(ODD) and toxicity.score(empty, untrained).count() == 0


def test_windows_are_whole():
    for n in (0, 1, 39, 40, 41, 70, 71, 3005, 3010, 3011):
        w = toxicity.windows_of(n)
        assert set().union(*(range(a, b) for a, b in w)) == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in w)
    text = b" ".join(words(5000))
    s = toxicity.Scorer(toxicity.Model())
    alone = max(max(s.score(iter([b" ".join(words(5000)[a:b])]))) for a, b in toxicity.windows_of(5000))
    assert abs(next(s.score(iter([text]))) - alone) < 1e-5


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_secret_scan", "op7_chat_format"])
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
