"""Operators against plain versions of their definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import (
    byte_bpe, byte_cnn, decontaminate, katz, line_dedup, minhash, queries, quality_rules, secret_ledger, shared, suffix_dedup, textcodes, toxicity,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words(x):
    return (x or "").encode().lower().split()


def test_word_codes():
    for x in (b"", b"  ", b"a A\tb\x0bb\x85c \xc2\xa0d", bytes(range(256)) * 3):
        codes = textcodes.word_codes(x)
        w = x.lower().split()
        assert len(codes) == len(w) and [codes[i] == codes[j] for i in range(len(w)) for j in range(i)] == [w[i] == w[j] for i in range(len(w)) for j in range(i)]
    assert len(textcodes.word_codes(b"ab cd " * 400_000)) == 800_000


def test_op1_measures(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        w = [rng.choice("the a of %% ## ABC é".split()) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\t "]) for x in w) + " ".join(w[:10]) * rng.randint(0, 3)))
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        g = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        c = collections.Counter(g)
        covered = {k + j for k, s in enumerate(g) if c[s] > 1 for j in range(8)}
        lines = [s for s in x.split("\n") if s.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(s in "#*$%&|<>" for s in x), len(lines) - len(set(lines)), len(covered)
        )
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_op1_ablation(docs):
    led = quality_rules.ledger(docs)
    rows = [r.failed for r in led.collect()]
    for r in quality_rules.ablation(led, quality_rules.STRICT).collect():
        bit = 1 << list(quality_rules.RULES).index(r.rule)
        assert r.n_failed == sum(bool(f & bit) for f in rows) and r.n_failed_alone == sum(f == bit for f in rows)
        assert r.n_kept_without == sum(f in (0, bit) for f in rows)


def test_op2_planted(spark, docs, texts):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 60)))) for i in range(30)]
    rows, want = [], set()
    for i, x in list(texts.items())[:60]:
        w = (x or "").split()
        if i % 2:
            k, item = rng.randint(0, len(w)), rng.choice(items)
            w[k:k] = [v.upper() + "," for v in item[1].split()]
            want.add((i, item[0]))
        rows.append((i, " ".join(w)))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_op2_all_windows():
    """The multi-index yields what a scan of all windows and items verifies."""
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30)).encode()) for i in range(12)]
    index = decontaminate.BenchmarkIndex(items)
    found = missed = 0
    for _ in range(60):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.choice([0, 1, len(w) - 1, len(w) - 2])] = b"zz"
        data = b"x y z " + b" ".join(w) + b" q r s"
        got = {m[0] for m in index.matches(data)}
        codes = decontaminate.codes(data)
        own = textcodes.shingles(codes, 5)
        want = set()
        for i, x in items:
            s = textcodes.shingles(decontaminate.codes(x), 5)
            if any(decontaminate.weighted_jaccard(own[k : k + len(s)], s) >= 0.8 for k in range(len(own) - len(s) + 1)):
                want.add(i)
        assert got <= want
        found, missed = found + len(got), missed + len(want - got)
    assert found and missed <= 0.02 * found


def test_hamming_index_is_complete():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, (400, 2), dtype=np.int64).astype(np.uint64)
    index = decontaminate.HammingIndex(prints)
    for _ in range(100):
        p = prints[rng.integers(len(prints))].copy()
        for k in rng.choice(128, rng.integers(0, 45), replace=False).tolist():
            p[k // 64] ^= np.uint64(1 << k % 64)
        want = np.flatnonzero(np.bitwise_count(prints ^ p).sum(axis=1) <= decontaminate.RADIUS)
        assert index.within(p).tolist() == want.tolist()


def test_op2_index_selects_and_recalls():
    """Few stored prints are candidates, and almost no window at a similarity of 0.8 to 0.85 is beyond the radius."""
    rng = np.random.default_rng(5)
    items = rng.integers(0, 1 << 63, (4000, 60), dtype=np.int64).astype(np.uint64)
    index = decontaminate.HammingIndex(np.stack([decontaminate.simhash(x) for x in items]))
    seen = found = tried = 0
    for i in range(400):
        w = items[i].copy()
        gone = rng.choice(60, rng.integers(5, 7), replace=False)
        w[gone] = rng.integers(0, 1 << 63, len(gone), dtype=np.int64).astype(np.uint64)
        assert 0.8 <= decontaminate.weighted_jaccard(items[i], w) <= 0.86
        p = decontaminate.simhash(w)
        seen += len(index.candidates(p))
        found += i in index.within(p)
        tried += 1
    assert found >= 0.985 * tried and seen < 0.1 * tried * len(items)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_op3_automaton():
    trie = toxicity.FuzzyTrie([("idiot", False), ("worthless", False), ("lowe", True), ("moron", True)])
    rng = random.Random(5)
    for _ in range(500):
        w = list(rng.choice(["idiot", "worthless", "lowe", "moron"]) + rng.choice(["", "", "x", "chen"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "o"])
        w = "".join(w)
        want = {}
        for t, (term, stem) in enumerate(trie.terms):
            d = min(_distance(term, w[:k]) for k in range(len(w) + 1)) if stem else _distance(term, w)
            if d <= toxicity.budget(term):
                want[t] = d
        assert dict(trie.find(w)) == want


def test_op3_automaton_is_complete():
    """Letters before the first one are tried too: find() is the exact distance within the budget."""
    trie = toxicity.FuzzyTrie([("idiot", False), ("worthless", False), ("lowe", True), ("moron", True), ("pathetic", True), ("miserable", True)])
    assert dict(trie.find("xidiot")) == {0: 1} and dict(trie.find("qxworthless")) == {1: 2} and dict(trie.find("xmoronic")) == {3: 1}
    rng = random.Random(12)
    for _ in range(3000):
        w = list(rng.choice(trie.terms)[0] + rng.choice(["", "", "x", "chen"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.choice([0, 0, rng.randrange(len(w) + 1)])
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "o", "m"])
        w = "".join(w)
        want = {}
        for t, (term, stem) in enumerate(trie.terms):
            d = min(_distance(term, w[:k]) for k in range(len(w) + 1)) if stem else _distance(term, w)
            if d <= toxicity.budget(term):
                want[t] = d
        assert dict(trie.find(w)) == want, w


def test_op3_context_and_accuracy(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}{e}" for a in "bdfg" for b in "aeiou" for c in ("lm", "rt", "nd", "sk") for e in "ptkmnaeiou"]
    rows = []
    for i in range(400):
        w = [rng.choice(vocabulary) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["clown", "pathetic", "zorgling", "zorgher"])
        rows.append((" ".join(w).encode(), int(i % 4 == 0)))
    model = toxicity.fit(rows[:300])
    assert all((model.score(t.decode()) >= 0.5) == bool(y) for t, y in rows[300:])
    clean = " ".join(vocabulary[:30])
    assert model.score(clean + " pathettic " + clean) >= 0.5 > model.score(clean + ' "the term pathetic" ' + clean)


def _plain_toxicity(model, text):
    """The score by plain loops over words, terms, quotation marks and neighbours."""
    text = text.lower()
    words = [(m.start(), m[0]) for m in re.finditer(r"\w+", text)]
    best = collections.defaultdict(float)
    for i, (at, w) in enumerate(words):
        near = {x for _, x in words[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]}
        quoted = sum(c in "\"“”„«»" for c in text[:at]) % 2 == 1 or bool(near & toxicity.REPORTING)
        factor = (toxicity.QUOTED if quoted else 1.0) * (toxicity.ADDRESSED if near & toxicity.ADDRESS else 1.0)
        for t, (term, stem) in enumerate(model.terms):
            d = min(_distance(term, w[:k]) for k in range(len(w) + 1)) if stem else _distance(term, w)
            if d <= toxicity.budget(term):
                best[t] = max(best[t], factor * (model.fuzzy[t] if d else model.exact[t]))
    z = model.bias + model.scale * min(sum(best.values()), 30.0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@pytest.mark.parametrize("part", [1 << 20, 40, 1])
def test_op3_score(monkeypatch, part):
    """Scores are those of plain loops, however a text is cut into parts."""
    rng = random.Random(15)
    model = toxicity.ToxicityModel([("idiot", False), ("lowe", True), ("pathetic", False), ("worthless", False)], [3.0, 2.0, 2.5, 4.0], [1.0, 0.5, 2.0, 3.0], 1.1, -3.0)
    monkeypatch.setattr(toxicity, "PART", part)
    bag = ["idiot", "idot", "lowest", "Pathetic", "patethic", "worthless", "you", "said", '"', "“", "the", "of", "and", "more", "words", "here", "x" * 90, "\n", "tu"]
    for _ in range(120):
        text = " ".join(rng.choices(bag, k=rng.randint(0, 60)))
        assert math.isclose(model.score(text), _plain_toxicity(model, text), rel_tol=1e-12)


def test_op3_long_texts_score_alike():
    """Beyond a part of 1 MiB quotation marks and neighbours still count."""
    model = toxicity.ToxicityModel([("idiot", False)], [6.0], [3.0], 1.0, -2.0)
    for head in ("", "a quiet word " * 90_000):
        quoted = model.hits(head + 'he told us " that one idiot there " and went')
        assert [h[2] for h in quoted] == [toxicity.QUOTED]
    cut = "ab " * ((toxicity.PART - 2) // 3)
    assert [h[2] for h in model.hits(cut + "you see an idiot")] == [toxicity.ADDRESSED]


def _plain_cnn(net, data):
    """The score by nested loops."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    chunks, pools = byte_cnn._chunks(data), []
    for c in chunks:
        row = np.full(byte_cnn.FILTERS, -np.inf)
        for at in range(0, len(c) - byte_cnn.WIDTH + 1, byte_cnn.STEP):
            for f in range(byte_cnn.FILTERS):
                h = sum(p["e"][c[at + i], d] * p["w"][i * byte_cnn.DIM + d, f] for i in range(byte_cnn.WIDTH) for d in range(byte_cnn.DIM))
                row[f] = max(row[f], h)
        pools.append(np.maximum(row + p["b"], 0))
    v = np.concatenate([np.max(pools, axis=0), np.mean(pools, axis=0)])
    return 1 / (1 + math.exp(-float(v @ p["o"] + p["c"][0])))


def test_op8_forward():
    rng = random.Random(16)
    net = byte_cnn.ByteCNN()
    net.p["b"] += np.linspace(-0.5, 0.5, byte_cnn.FILTERS, dtype=np.float32)
    for n in (0, 3, 9, 50, 1030):
        data = bytes(rng.choices(range(256), k=n))
        assert abs(net.score(data) - _plain_cnn(net, data)) < 1e-4
    data = bytes(rng.choices(b"abcdefgh ", k=3000))
    covered = np.zeros(3000, bool)
    for start in [*range(0, 3000 - byte_cnn.CHUNK, byte_cnn.CHUNK - byte_cnn.OVERLAP), 3000 - byte_cnn.CHUNK]:
        covered[start : start + byte_cnn.CHUNK] = True
    assert covered.all() and b"".join(c[: byte_cnn.CHUNK - byte_cnn.OVERLAP].tobytes() for c in byte_cnn._chunks(data)[:-1]) == data[: 960 * (len(byte_cnn._chunks(data)) - 1)]


def test_op8_sees_a_pattern_at_every_place():
    """A filter's maximum over a text of one chunk does not depend on where the window that causes it stands."""
    net = byte_cnn.ByteCNN()
    rng = random.Random(18)
    window = bytes(rng.choices(range(256), k=byte_cnn.WIDTH))
    for at in range(9):
        data = b" " * (byte_cnn.WIDTH + at) + window + b" " * 40
        alone = net._conv(np.frombuffer(window, np.uint8)[None])[0] + net.p["b"]
        assert (net.pooled(data)[: byte_cnn.FILTERS] >= np.maximum(alone, 0) - 1e-5).all()
    text = bytes(rng.choices(range(256), k=5000))
    windows = {text[i : i + byte_cnn.WIDTH] for i in range(len(text) - byte_cnn.WIDTH + 1)}
    seen = {c[i : i + byte_cnn.WIDTH].tobytes() for c in byte_cnn._chunks(text) for i in range(0, len(c) - byte_cnn.WIDTH + 1, byte_cnn.STEP)}
    assert seen == windows


def test_op8_gradient_over_all_chunks(monkeypatch):
    """Finite differences on a text of far more chunks than are convolved at a time."""
    rng = random.Random(17)
    data = bytes(rng.choices(b"abcdefghijklmnop ", k=300_000))
    net = byte_cnn.ByteCNN()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    assert len(byte_cnn._chunks(data)) > byte_cnn.AT_A_TIME
    g = {k: np.zeros(v.shape) for k, v in net.p.items()}
    net.gradient(data, 0, g)
    loss = lambda: -math.log(1 - net.score(data) + 1e-7)
    for k, at in (("o", 3), ("o", byte_cnn.FILTERS + 5), ("b", 2), ("c", 0), ("w", (5, 7)), ("e", (ord("c"), 2))):
        net.p[k][at] += 1e-6
        up = loss()
        net.p[k][at] -= 2e-6
        down = loss()
        net.p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_op8_learns(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((" ".join(word() + ("%%%" if bad else "") for _ in range(rng.randint(10, 400))).encode(), int(not bad)))
    net = byte_cnn.fit(rows[:200])
    assert np.mean([(net.score(t) >= 0.5) == bool(y) for t, y in rows[200:]]) >= 0.95
    g = {k: np.zeros(v.shape) for k, v in net.p.items()}
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.gradient(*rows[0], g)
    loss = lambda: -math.log(1 - net.score(rows[0][0]) + 1e-7)
    for k, at in (("o", 3), ("b", 2), ("c", 0)):
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3


@pytest.mark.parametrize("t", [1, 2])
def test_op4_distance(spark, t):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choices("abé", k=rng.randint(0, 7)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "x string, y string")
    for r in df.select("x", "y", line_dedup.within(F.col("x"), F.col("y"), t).alias("w")).collect():
        assert r.w == (_distance(r.x, r.y) <= t), r


@pytest.mark.parametrize("hot", [64, 6])
def test_op4_classes(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(15, 60))) for _ in range(20)]
    common = "the quick brown fox jumps over the lazy dog again"
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(0, 4)):
            s = list(rng.choice(base))
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = rng.choice("xyz")
            lines.append("".join(s))
        k = rng.randrange(len(common))
        lines.append(common[:k] + rng.choice("pqrst") * rng.randint(0, 3) + common[k + rng.randint(0, 2) :])
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    occ = [(d, i, s) for d, x in rows for i, s in enumerate(x.split("\n")) if len(s) >= line_dedup.MIN_CHARS]
    distinct = sorted({s for *_, s in occ})
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            if abs(len(a) - len(distinct[j])) <= 1 and root(i) != root(j) and _distance(a, distinct[j]) <= 1:
                parent[root(i)] = root(j)
    cls, first = {s: root(i) for i, s in enumerate(distinct)}, {}
    for d, i, s in sorted(occ):
        first.setdefault(cls[s], (d, i))
    want = collections.defaultdict(list)
    for d, i, s in occ:
        if first[cls[s]] != (d, i):
            want[d].append(i)
    assert {r.doc_id: list(r.dropped) for r in line_dedup.line_dedup(df).collect()} == {d: sorted(want[d]) for d, _ in rows}
    out = {r.doc_id: r.text for r in line_dedup.without_dropped(df).collect()}
    assert out == {d: "\n".join(s for i, s in enumerate(x.split("\n")) if i not in want[d]) for d, x in rows}


@pytest.mark.parametrize("heavy", [1000, 3])
def test_op4_short_lines(spark, tmp_path, monkeypatch, heavy):
    """Lines under MIN_CHARS go by equality in the query and the stage; blank ones stay."""
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    long = "a line that is long enough for the edit join"
    rows = [
        (1, f"Ietzte.\n\n{long}\né"), (2, f"Ietzte.\n\n \u3000\n{long}!\nIetzte"), (3, f"x\nIetzte.\nx\n\n \u3000\né\n{long}"),
        (4, "Ietzte.\nx\nJetzte."), (5, ""), (6, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: [], 2: [0, 3], 3: [1, 2, 5, 6], 4: [0, 1], 5: [], 6: []}
    got = {r.doc_id: r for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert {d: list(r.dropped) for d, r in got.items()} == want and list(got[3].kept_in) == [1, 3]
    out = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, df, "").collect()}
    assert out == {d: x and "\n".join(s for i, s in enumerate(x.split("\n")) if i not in want[d]) for d, x in rows}


def test_op4_rows_of_one_id(spark):
    """Rows with one id and different texts keep their own lines; columns may have any names."""
    same = "a line that both of them have in full"
    rows = [(1, same, 0, "p"), (1, f"{same}\nan unrelated line of its own here", 1, "q"), (2, "another unrelated line of its own, too", 2, "r"), (2, None, 3, None), (2, f"{same}?", 4, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t int, dropped string").withColumn("_gone", F.lit(1)).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(3))
    out = {r.t: (r.text, r.dropped, r["a.b"]) for r in line_dedup.without_dropped(df).collect()}
    heads = sum((out[i][0] or "").count(same) for i in range(5))
    assert heads == 1 and "an unrelated line of its own here" in out[1][0] and out[2][0] == rows[2][1] and out[3][0] is None and out[4] == ("", "s", 3)


def _katz(train, tok, order):
    """(base, score) of each text by the definitions, as Fractions are not needed: p(history, word) for any history."""
    c = [None, collections.Counter(w for i in train for w in tok[i])]
    for k in range(2, order + 1):
        n = collections.defaultdict(collections.Counter)
        for i in train:
            t = [None, *tok[i]]
            for at in range(1, len(t)):
                if at >= k - 1:
                    n[tuple(t[at - k + 1 : at])][t[at]] += 1
        c.append(n)
    total, types = sum(c[1].values()), len(c[1])
    of = lambda xs: [sum(x == r for x in xs) for r in range(1, 7)]
    d = [None, katz.discounts(of(c[1].values()))] + [katz.discounts(of([x for y in n.values() for x in y.values()])) for n in c[2:]]
    free = sum((1 - d[1][x]) * x for x in c[1].values() if x <= 5) / total
    back = {}

    def p(h, w):
        k = len(h) + 1
        if k == 1:
            return (d[1][c[1][w]] if c[1][w] <= 5 else 1) * c[1][w] / total if w in c[1] else free
        if h not in c[k]:
            return p(h[1:], w)
        follow = c[k][h]
        n, free_h = sum(follow.values()), sum((1 - d[k][x]) * x for x in follow.values() if x <= 5)
        if w in follow:
            return (d[k][follow[w]] if follow[w] <= 5 else 1) * follow[w] / (n + (free_h <= 0))
        if h not in back:
            back[h] = (free_h / n if free_h > 0 else 1 / (n + 1)) / (1 - sum(p(h[1:], x) for x in follow))
        return back[h] * p(h[1:], w)

    for k in range(2, order + 1):  # probabilities add up to one over the vocabulary and the unknown type
        for h in list(c[k])[:3]:
            assert abs(sum(p(h, w) for w in c[1]) + p(h, object()) - 1) < 1e-8
    out = {}
    for i, x in tok.items():
        t = [None, *x]
        out[i] = (
            sum(math.log10((c[1][w] + 1) / (total + types + 1)) for w in x),
            sum(math.log10(p(tuple(t[max(0, at - order + 1) : at]), t[at])) for at in range(1, len(t))),
        )
    return out, c[1], total


def _check_katz(rows, texts, order):
    tok = {i: [*words(x), None] for i, x in texts.items()}
    train = [i for i in tok if zlib.crc32(str(i).encode()) % 7 != 2]
    want, c, total = _katz(train, tok, order)
    assert len(rows) == len(tok)
    for r in rows:
        base, s = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tok[r.doc_id]), sum(w in c for w in tok[r.doc_id]), total, r.doc_id not in set(train))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, s, rel_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_op5(spark, docs, texts, order):
    _check_katz(katz.score(docs, order).collect(), texts, order)


@pytest.mark.parametrize("salt", [4, 400])
def test_op5_salted_and_bare_contexts(spark, monkeypatch, salt):
    """Many blocks, contexts dealt over several partitions, and ones whose followers all occur often."""
    monkeypatch.setattr(katz, "SALT", salt)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 400)
    rng = random.Random(19)
    texts = {}
    for i in range(160):
        w = rng.choices(["the", "a", "of", *(f"w{j}" for j in range(40))], weights=[60, 30, 20, *range(1, 41)], k=rng.randint(0, 25))
        texts[i] = " ".join(["fixed start of all"] * (i % 3 > 0) + w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for order in (2, 3, 4):
        _check_katz(katz.score(df, order).collect(), texts, order)


def test_op5_stored_tables(spark, tmp_path, texts):
    """A model read back from its tables scores later texts as one trained beside them does."""
    some = dict(list(texts.items())[:80])
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    model = katz.train(df, f"file://{tmp_path}/model")
    assert model == katz.Model.load(spark, f"file://{tmp_path}/model")
    want = {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score(df).collect()}
    got = {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score(df, model=model).collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i][:2] == want[i][:2] and all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[i][2:], want[i][2:]))


def _repeats(rows):
    first = {}
    for d, x in rows:
        x = (x or "").encode()
        for s in range(len(x) - 49 if d is not None else 0):
            w = x[s : s + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, x in rows:
        x = (x or "").encode()
        gone = bytearray(len(x))
        for s in range(len(x) - 49 if d is not None else 0):
            if first[x[s : s + 50]] < d:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(x)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(c for i, c in enumerate(x) if not gone[i])).hexdigest()))
    return sorted(out, key=str)


def test_op6(spark, texts):
    rng = random.Random(10)
    base = ["".join(rng.choices("abcd \0é", k=rng.randint(30, 300))) for _ in range(8)]
    rows = list(texts.items())[:40]
    for _ in range(60):
        x = ""
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(base)
            a = rng.randrange(len(s))
            x += s[a : a + rng.randint(20, 200)] + "z" * rng.choice([0, 0, 90])
        rows.append((rng.randint(0, 50), x))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str) == _repeats(rows)


def test_op6_multikey_sort():
    rng = np.random.default_rng(11)
    rows = rng.integers(0, 2, (500, 20)).astype(np.uint8)
    order, common = suffix_dedup.multikey_sort(rows)
    got = [r.tobytes() for r in rows[order]]
    assert got == sorted(got)
    for a, b, n in zip(got, got[1:], common[1:]):
        assert a[:n] == b[:n] and (n == 20 or a[n] != b[n])


def test_op6_long_texts_and_boundaries(spark):
    """Repeats that run across the pieces of a long text, and none across texts that lie side by side."""
    rng = random.Random(13)
    passage = "".join(rng.choices("abcdefgh", k=3 * suffix_dedup.PIECE // 2))
    near = passage[:49]
    rows = [(1, "x" + passage), (2, "yy" * 700 + passage + "w"), (None, passage), (3, near[:25]), (4, near[25:] + "q"), (5, near)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    for d, x in rows:
        kept = ("yy" * 700 + "w" if d == 2 else x).encode()
        assert got[d].n_removed == len(x) - len(kept) and got[d].n_spans == (d == 2)
        assert got[d].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op6_repeated_windows():
    """Masks of every window, beside comparing all pairs of contexts."""
    rng = random.Random(14)
    base = ["".join(rng.choices("ab", k=120)).encode() for _ in range(3)]
    texts = [b[a : a + rng.randint(50, 90)] for b in base for a in rng.choices(range(40), k=20)]
    at = np.array([rng.randint(0, len(x) - suffix_dedup.GRAM) for x in texts])
    rows = np.concatenate([
        suffix_dedup.contexts(np.frombuffer(x, np.uint8), np.array([i]), np.array([0]), np.array([len(x)])) for x, i in zip(texts, at)
    ])
    docs = np.array([rng.randint(0, 30) for _ in texts])
    windows = [{o: x[i - o : i - o + 50] for o in range(27) if o <= i and i - o + 50 <= len(x)} for x, i in zip(texts, at.tolist())]
    want = [sum(any(v.get(o) == w and e < d for v, e in zip(windows, docs)) << o for o, w in u.items()) for u, d in zip(windows, docs)]
    assert suffix_dedup.repeated_windows(rows, docs).tolist() == want and any(want)


def test_op7(texts):
    bpe = byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(12)
    odd = ["", "a" * 5000, " \x1c\x85 x", "🙂" * 40, "don't  stop\n\n ", "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(3000))]
    got = list(bpe.encode_many([*odd, *(x or "" for x in texts.values())]))
    for ids, x in zip(got, [*odd, *(x or "" for x in texts.values())]):
        assert ids == own.encode_ordinary(x) and bpe.decode(ids) == x.encode()
    pieces = [bytes(rng.choices(b"abcde the\xc3\xa9", k=rng.randint(2, 33))) for _ in range(500)]
    pieces = [p for p in pieces if p not in bpe.ranks]
    assert bpe.merge_rows(pieces) == [bpe.merge(p) for p in pieces]


def test_op7_tables(docs, texts):
    path = P.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode_table(docs, path, P.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in byte_bpe.decode_table(ids, path, P.PATTERN).collect()} == texts


def _components(rows, k, least):
    sets = {i: ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())) for i, w in rows.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j >= i:
                break
            n = len(sets[i] & sets[j])
            if n and 100 * n >= least * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_op9(spark):
    rng = random.Random(13)
    rows = {}
    for g in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 12, 60, 400]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 9999)}"
            rows[len(rows)] = w
    df = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in rows.items()], "doc_id long, text string")
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k, 80).collect()}
        assert got == _components(rows, k, 80)


@pytest.mark.parametrize("block", [1024, 5])
def test_op9_strays(spark, monkeypatch, block):
    """Buckets with one large component and strays, in blocks of any size; ids that repeat with other texts."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PART", 64)
    rng = random.Random(23)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 6, 9, 12])):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 99)}"
        rows[len(rows)] = w
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    want = _components(rows, 4, 80)
    assert 1 < len({c for _, c, _ in want.values()}) < 50
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 4, 80).collect()} == want


def test_op9_rows_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a, 0), (2, a, 1), (2, b, 2), (3, b, 3), (3, b, 4)], "doc_id long, text string, text_hash int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (3, 2, False)]
    assert {r.text_hash for r in minhash.without_duplicates(df).collect()} == {0, 2}


def test_op9_recall_near_the_threshold():
    """Pairs at a similarity of 0.8 to 0.85 are within the radius, so the index finds them."""
    rng = np.random.default_rng(18)
    wrong = []
    for _ in range(1500):
        n = int(rng.integers(100, 800))
        both = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        k = int(rng.integers(-(-n * 3 // 37), n // 9 + 1))  # n - k shared, 2 k others: (n - k) / (n + k)
        x, y = (np.concatenate([both[k:], rng.integers(0, 1 << 63, k, dtype=np.int64).astype(np.uint64)]) for _ in range(2))
        assert 0.8 <= (n - k) / (n + k) <= 0.85
        wrong.append(int((minhash.signature(x) != minhash.signature(y)).sum()))
    assert np.mean(np.array(wrong) <= minhash.RADIUS) >= 0.999


def test_op9_pigeonhole():
    rng = np.random.default_rng(14)
    a = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for i in range(200):
        at = rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)
        b[i, at] ^= 1
    same = minhash.bucket_keys(a) == minhash.bucket_keys(b)
    assert same.any(axis=1).all() and (same.argmax(axis=1) == minhash.first_slots(a != b)).all()


def test_op10(spark, docs, texts):
    def base(x):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x) if len(m[1]) >= 12]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
        return sorted(out)

    odd = ["token:token=abcdefghijkl secret: password : longvalue12345", "AKIAAKIA" + "Z" * 9, "é PASSWD = 'Abcdefghijkl' API_key:0123456789abcdef0", "toKen=abcdefghijklm"]
    rows = [*texts.items(), *((1000 + i, x) for i, x in enumerate(odd)), (2000, odd[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_ledger.secret_scan(df, shared.new_path(spark)).collect()}
    for i, x in rows:
        spans = base(x or "")
        text = ",".join(f"{secret_ledger.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) - {""} <= set(got[i].spans.split(","))
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]


def test_op10_ledger_scans_only_new(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([(1, "token=abcdefghijklmn"), (2, "x")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "token=abcdefghijklmn"), (4, "y")], "doc_id long, text string")
    secret_ledger.update_ledger(one, path)
    assert secret_ledger.scan_unseen(two, secret_ledger.read_ledger(spark, path)).count() == 1
    secret_ledger.update_ledger(two, path)
    led = secret_ledger.read_ledger(spark, path)
    assert led.count() == 3 and {r.doc_id for r in secret_ledger.attach(two, led).where("n_assign = 1").collect()} == {3}
    assert secret_ledger.scan_unseen(two, led, rule_version=2).count() == 2
    # two updates at once may both list a blob; it still counts once
    led.limit(3).write.mode("append").parquet(path)
    assert secret_ledger.read_ledger(spark, path).count() == 3 and secret_ledger.secret_scan(two, path).count() == 2
    # a changed ledger shows in the result: it is where findings come from
    fake = led.where("n_assign = 1").selectExpr("blob", "77L AS n_assign", "n_access", "n_hex", "base_sha256", "spans", "rule_version")
    fake.write.parquet(f"{path}2")
    assert {r.doc_id: r.n_assign for r in secret_ledger.secret_scan(two, f"{path}2").collect()} == {3: 77, 4: 0}


def _leaks(text, benchmark):
    """Whether some window is alike enough to some item, by looking at all of them."""
    drop = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    cut = lambda x: (x or "").translate(drop).encode().lower().split()
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
    own = cut(text)
    for item in benchmark:
        w = cut(item)
        k = min(5, len(w))
        theirs, mine = collections.Counter(grams(w, k)), grams(own, k) if len(own) >= k else []
        n = len(w) - k + 1
        if sum(theirs[g] > 0 for g in mine) < 0.8 * n:
            continue
        for at in range(max(1, len(mine) - n + 1)):
            window = collections.Counter(mine[at : at + n])
            if sum((window & theirs).values()) >= 0.8 * sum((window | theirs).values()):
                return True
    return False


def test_pipeline(spark, docs, texts):
    """Stage by stage against plain versions, on the smallest tables."""
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    d = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in d.collect()}
        d, _ = shared.table(stage(spark, d, SF))
        after = {r.doc_id: r.text for r in d.collect()}
        if name == "near_dedup":
            kept = _components({i: words(x) for i, x in before.items()}, 5, 80)
            assert after == {i: before[i] for i, k in kept.items() if k[2]}
        elif name == "line_dedup":
            assert set(after) == set(before)
            for i, x in after.items():
                left = iter(before[i].split("\n"))
                assert not x or all(s in left for s in x.split("\n"))
            every = [s for x in after.values() for s in x.split("\n") if len(s) >= line_dedup.MIN_CHARS]
            assert len(every) == len(set(every))
        elif name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert after == {i: x for i, x in before.items() if _plain_toxicity(model, (x or "")[:20_000]) < 0.5 or len(x or "") > 20_000 and i in after}
        else:
            assert after == {i: x for i, x in before.items() if not _leaks(x, benchmark)}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & set(after)) <= len(toxic) // 2
    bpe = byte_bpe.encoder(P.path(queries.VOCABULARY), P.PATTERN)
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[4][1](spark, d, SF).collect()}
    assert {i: bpe.decode(r.ids).decode() for i, r in last.items()} == after
