"""The operators against plain versions, round trips and hard cases, on small fixtures."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, frames, jaccard_join, kneser_ney, licenses, mil_classifier, packing, quality_rules, queries, secrets, token_counts, vector_neighbours

DIR = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
HARD = [None, "", " \n\t ", "a", "The the THE", "日本 é\u0085x", "x" * 30000, "w1 w2 w3 w4 w5 w6 " * 40, 'token = "abcdef" AKIA' + "A" * 20 + " " + "0f" * 20]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "src0", None, "clash") for i, t in enumerate(HARD + HARD[-2:])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens long, kept string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_bpe_equals_tiktoken_and_round_trips(spark, docs, hard):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    raw = bpe.read_ranks(RANKS)
    for df in (docs, hard):
        want = texts_of(df)
        ids = bpe.encode(df, raw, keep=["doc_id"], offsets=True)
        got = {r.doc_id: r for r in ids.collect()}
        assert all(got[i]["ids"] == enc.encode_ordinary(t) and len(got[i]["starts"]) == got[i]["n_tokens"] for i, t in want.items())
        back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, raw, keep=["doc_id"]).collect()}
        assert all(back[i] == t.encode() for i, t in want.items())
    b = bpe.ByteBPE(raw)
    odd = ["a\0 b c", "\0", " ", "  x  y\tz \n w", "a\x1c b\u00a0 c\u0085 d", "it's 12 3 's", ""]
    for t in [*odd, *odd]:
        assert b.encode([t])[0].tolist() == enc.encode_ordinary(t)
    ids = b.encode(["日本語"])[0]
    assert "".join(b.decode_stream([[i] for i in ids])) == "日本語"


def test_bpe_digests(spark, docs):
    r = queries.op1_bpe(spark, DIR).where("doc_id = 3").first()
    text = texts_of(docs)[3]
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_base(spark, docs, hard):
    for df in (docs, hard):
        for t in texts_of(df).values():
            assert quality_rules.base_counts(t.encode()) == plain_counts(t)
    r = {x.doc_id: x for x in quality_rules.judge(hard, quality_rules.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet")), ["doc_id"]).collect()}
    assert len(r) == hard.count() and r[0].base_failed and not r[0].kept


def test_quality_and_classifier_hold_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op9_mil_classifier(spark, sf).collect() if r.doc_id in labels]
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    judged = [r for r in queries.op2_quality_rules(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept for r in judged if labels[r.doc_id]]) > 0.97


def test_classifier_of_an_endless_word(spark):
    rows = [(i, "good words here " * 9 if i % 2 else "# $ % bad" * 9, None) for i in range(40)] + [(90, "x" * 700_000, None), (91, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(90, 0, 0)], "doc_id long, quality int, toxic int")
    got = mil_classifier.score(docs, mil_classifier.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == 42 and all(0 <= r.score <= 1 for r in got)


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 5, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id, r.text) for r in quality_rules.labelled(docs, labels, 10).collect())
    assert got == [(0, "t0"), (1, "t1"), (2, "t12"), (4, "t14")]
    assert quality_rules.labelled(docs, labels, 2).count() == 2 and quality_rules.labelled(docs.limit(0), labels, 9).count() == 0


def test_character_grams_are_of_characters():
    a, b = ("日本語です", "xy"), ("é日本語で", "")
    def fours(texts):
        doc, bucket = quality_rules._grams([t.encode() for t in texts])[2]
        return [bucket[doc == i].tolist() for i in range(len(texts))]
    x, y = fours(a), fours(b)
    assert [len(g) for g in x] == [2, 0] and [len(g) for g in y] == [2, 0]
    assert x[0][0] == y[0][1] and fours(["日本語です"]) == x[:1]


def test_classifier_empty_tables(spark, hard):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = mil_classifier.fit(hard, none)
    assert {r.score for r in mil_classifier.score(hard, model, ["doc_id"]).collect()} == {0.5}
    assert mil_classifier.score(hard.limit(0), model, ["doc_id"]).count() == 0


BASE = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"),
]


def plain_secrets(text):
    out = []
    for k, rx in enumerate(BASE):
        for m in rx.finditer(text):
            if (len(m[2]) >= 6 if k == 0 else len(m[0]) >= (20, 24)[k - 1]):
                out.append((m.start(), k, m.end()))
    return [(k, s, e) for s, k, e in sorted(out)]


def test_secrets_equal_regexes(docs, hard):
    s = secrets.scanner()
    rng = random.Random(5)
    parts = ["token", "passwd", "secret", "api", "_", "key", "=", ":", " ", "'", "abc", "abcdef", "AKIA", "ABCDEFGH", "0123456789abcdef", "é", "\n", "ſ"]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    for t in [*texts_of(docs).values(), *texts_of(hard).values(), *made]:
        assert [x for x in s.scan(t.encode()) if x[0] < 3] == plain_secrets(t)
    clean = {r.doc_id: r.text for r in secrets.redact(hard).collect()}
    assert clean[0] is None and "abcdef" not in clean[len(HARD) - 1]
    assert s.scan(b"ghp_" + b"a1" * 20)[0][0] == 4


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_sums_to_one(spark, order):
    rows = [(1, "a b a c"), (2, "a b"), (3, None), (4, "B c a"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = kneser_ney.train(df, order=order)
    assert (m.n, m.v) == (9 + 5, 4)
    # The probabilities of all next tokens, the end and one unknown word among them, sum to 1.
    for before in ("", "a ", "b ", "zz ", "a b ", "a b a ", "b c a "):
        k = len(before.split())
        texts = [before.encode()] + [(before + w).encode() for w in ("a", "b", "c", "zz")]
        doc, _, _, p = m.tokens(texts)
        assert abs(sum(10 ** p[doc == i][k] for i in range(len(texts))) - 1) < 1e-9
    got = {r.doc_id: r for r in kneser_ney.score(df, m, ["doc_id"]).collect()}
    assert got[3].n_tokens == got[5].n_tokens == 1 and got[4].n_known == 4
    assert abs(got[5].base_score - np.log10((5 + 0.5) / (14 + 0.5 * 5))) < 1e-12
    assert kneser_ney.train(df.limit(0), order=order).n == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_equals_its_definition(spark, order):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijkl", [64, 32, 16, 8, 4, 2, 1, 1, 0.5, 0.5, 0.3, 0.3], k=rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, "a zz b"), (98, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    m = kneser_ney.train(df.where("doc_id < 90"), order=order)

    def grams(text):
        w = ["<s>"] * (order - 1) + text.split() + ["</s>"]
        return [tuple(w[i : i + order]) for i in range(len(w) - order + 1)]

    count = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):  # continuation counts
        count[k] = Counter(g[1:] for g in count[k + 1])

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) or k / 2 if n[k - 1] and n[0] else k / 2 for k in (1, 2, 3)]

    d = {k: discounts(c.values()) for k, c in count.items()}

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(count[1]) + 1)
        followers = [c for x, c in count[k].items() if x[:-1] == g[:-1]]
        if not followers:
            return p(g[1:])
        rest = sum(d[k][min(c, 3)] for c in followers) / sum(followers)
        return max(count[k][g] - d[k][min(count[k][g], 3)], 0) / sum(followers) + rest * p(g[1:])

    for r in kneser_ney.score(df.drop("score"), m, ["doc_id", "text"]).collect():
        assert abs(r.score - sum(np.log10(p(g)) for g in grams(r.text or ""))) < 1e-9


def test_kneser_ney_query_scores_by_trigrams(spark, docs):
    """The whole query against modified Kneser-Ney of order 3, on texts long enough for contexts that are not split."""
    table = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    tokens = {i: ["<s>"] * 2 + [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(table))] + ["</s>"] for i, t in texts_of(docs).items()}
    trained = [w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    count = {3: Counter(g for w in trained for g in zip(w, w[1:], w[2:]))}
    count[2] = Counter(g[1:] for g in count[3])
    count[1] = Counter(g[1:] for g in count[2])
    d, total, rest = {}, {k: Counter() for k in count}, {k: Counter() for k in count}
    for k, grams in count.items():
        n = [sum(c == j for c in grams.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d[k] = [0.0] + [j - (j + 1) * y * n[j] / n[j - 1] for j in (1, 2, 3)]
        for g, c in grams.items():
            total[k][g[:-1]] += c
            rest[k][g[:-1]] += d[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / (len(count[1]) + 1)
        k, t = len(g), total[len(g)][g[:-1]]
        if not t:
            return p(g[1:])
        return (max(count[k][g] - d[k][min(count[k][g], 3)], 0) + rest[k][g[:-1]] * p(g[1:])) / t

    got = queries.op5_kneser_ney(spark, DIR).collect()
    assert len(got) == len(tokens)
    assert sum(len(w) - 2 for w in trained) > 2 * 4096  # else every context that is seen twice is split
    for r in got:
        w = tokens[r.doc_id]
        assert r.n_tokens == len(w) - 2
        assert abs(r.score - sum(np.log10(p(g)) for g in zip(w, w[1:], w[2:]))) < 1e-6


def test_kneser_ney_orders_keys_as_a_stable_sort():
    rng = np.random.default_rng(5)
    near = rng.integers(0, 1 << 12, 5000, dtype=np.uint64) << np.uint64(52) | rng.integers(0, 50, 5000, dtype=np.uint64)
    hashes = [rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) for n in (0, 1, 2, 5000)]
    for key in (*hashes, near, rng.integers(0, 9, 5000, dtype=np.uint64), np.zeros(7, np.uint64), near >> np.uint64(40)):
        order, ordered = kneser_ney._order(key)
        assert (order == np.argsort(key, kind="stable")).all() and (ordered == np.sort(key)).all()
        own, which, first = kneser_ney._distinct(key)
        assert (own == np.unique(key)).all() and (own[which] == key).all() and (first == np.unique(key, return_index=True)[1]).all()


def test_kneser_ney_scores_each_distinct_ngram_once(spark, monkeypatch):
    m = kneser_ney.train(spark.createDataFrame([(1, "a b a c"), (2, "a b")], "doc_id long, text string"))
    texts = [b"a b " * 1000, b"", b"zz a b"] * 20
    alone = [m.tokens([t]) for t in texts]
    given, plain = [], kneser_ney.contexts

    def counted(columns):
        given.append(len(columns[0]))
        return plain(columns)

    monkeypatch.setattr(kneser_ney, "contexts", counted)
    doc, *got = m.tokens(texts)
    assert len(doc) > 40000 and max(given) < 20
    for x, y in zip(got, zip(*(a[1:] for a in alone))):
        assert (x == np.concatenate(y)).all()


def test_kneser_ney_finds_keys_of_equal_middle_bits(tmp_path):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) << np.uint64(1)
    keys = np.unique(np.concatenate((keys, keys[:500] ^ np.uint64(1), keys[:500] ^ np.uint64(6))))
    asked = np.unique(np.concatenate((keys, keys ^ np.uint64(9), rng.integers(0, 1 << 63, 500, dtype=np.uint64))))
    for parts in (1, 3, 7):
        at = kneser_ney.part_of(keys, parts)
        for f in range(parts):
            own = keys[at == f]
            kneser_ney._save_keyed(tmp_path.as_uri(), f"k{parts}", f, parts, own, np.arange(len(own)).astype(np.uint16))
        model = kneser_ney.KneserNey(tmp_path.as_uri(), parts)
        hit, place = model._find(f"k{parts}", asked, 1)
        assert (hit == np.isin(asked, keys)).all()
        first = np.searchsorted(at, np.arange(parts))
        assert (place[hit] + first[kneser_ney.part_of(asked[hit], parts)] == np.arange(len(keys))).all()


def plain_components(sets):
    ids, par = sorted(sets), {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    inverted = defaultdict(list)
    for i in ids:
        for h in sets[i]:
            inverted[h].append(i)
    for i in ids:
        shared = Counter(j for h in sets[i] for j in inverted[h] if j < i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_join_equals_brute_force(spark, docs, hard):
    rng = random.Random(2)
    base = [f"v{i}" for i in range(150)]
    near = [(1000 + k, " ".join(w if rng.random() > 0.03 else f"n{rng.random()}" for w in base)) for k in range(60)]
    mixed = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string")).union(hard.select(F.col("doc_id") + 5000, "text"))
    sets = {i: shingles(t) for i, t in texts_of(mixed).items()}
    want = plain_components(sets)
    got = jaccard_join.membership(mixed).collect()
    assert len(got) == len(sets)
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.component_id == want[r.doc_id] for r in got)
    assert [r.n_links for r in got] == [plain_links(sets)[r.doc_id] for r in got]
    assert jaccard_join.membership(mixed.limit(0)).count() == 0


def plain_links(sets):
    inverted, n = defaultdict(list), Counter()
    for i in sets:
        for h in sets[i]:
            inverted[h].append(i)
    for i in sets:
        shared = Counter(j for h in sets[i] for j in inverted[h] if j != i)
        n[i] = sum(100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k) for j, k in shared.items())
    return n


def test_jaccard_join_in_small_blocks(spark, monkeypatch):
    """Ranges, groups and blocks of a few n-grams and classes give the same links, common n-grams among them."""
    for name, value in (("GROUP_BYTES", 4000), ("BLOCK", 4), ("WITHIN", 16), ("EMIT", 100), ("RANGE_GRAMS", 20)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(4)
    texts = []
    for size in (8, 30, 60):
        base = [f"w{size}x{i}" for i in range(size)]
        texts += [" ".join(w if rng.random() > 0.02 else f"e{rng.randrange(9)}" for w in base) for _ in range(80 if size == 30 else 20)]
    texts += [" ".join(rng.choices("abc", k=12)) for _ in range(40)] + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    comps, n = plain_components(sets), plain_links(sets)
    got = jaccard_join.membership(df).collect()
    assert [(r.component_id, r.n_links) for r in got] == [(comps[r.doc_id], n[r.doc_id]) for r in got]


def test_ranges_let_common_ngrams_go(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 4)
    monkeypatch.setattr(jaccard_join, "HELD_GRAMS", 30)
    rng = np.random.default_rng(1)
    for bits in (1, 9):
        grams = rng.integers(0, 1 << 63, 20, dtype=np.uint64) >> np.uint64(bits)
        if bits == 1:
            grams &= np.uint64((1 << 56) - 1)
        held, found, sets = jaccard_join._Range(0, bits), set(), defaultdict(set)
        held.add(jaccard_join._HOT, b"", b"", jaccard_join._low(np.sort(grams[:1])))
        for key in range(12):
            own = np.sort(rng.choice(grams, rng.integers(1, 12), replace=False))
            if key == 5:
                own = np.sort(grams[:3])
            for g in own.tolist():
                sets[g].add(key)
            made = [held.add(jaccard_join._PLAIN, np.array([key]).tobytes(), np.array([len(own)], np.uint16).tobytes(), jaccard_join._low(own))]
            if held.size > held.limit:
                made.append(held.settle(False))
            found |= {x for m in made if m is not None for x in zip(*(c.tolist() for c in m))}
        found |= set(zip(*(c.tolist() for c in held.settle(True))))
        hot = int(grams[0])
        want = {(k, g, 4 if g == hot else min(4, len(o))) for g, o in sets.items() if len(o) > 1 or g == hot for k in o}
        assert found == want


def test_components_of_a_star_and_a_chain(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(7, 7), (None, 3)], "a long, b long")
    got = dict(tuple(r) for r in frames.components(e).collect())
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5201)}


def test_packing(spark, docs, hard):
    for df in (docs, hard):
        rows = packing.best_fit(df, capacity=512).collect()
        n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for i, t in texts_of(df).items()}
        per = Counter()
        bins = defaultdict(list)
        for r in rows:
            per[r.doc_id] += r.n_tokens
            bins[r.bin_id].append(r)
        assert per == Counter(n)
        source = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
        for b in bins.values():
            assert sum(r.n_tokens for r in b) <= 512
            assert len({source[r.doc_id] for r in b}) == len(b)
    assert packing.pack([(6, 1), (5, 2), (4, 1), (4, 4), (1, 2)], 10) == [(0, 0), (1, 0), (1, 5), (0, 6), (2, 0)]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 16))
    v = [(c + rng.normal(size=16) * 0.12).tolist() for c in centre for _ in range(40)] + rng.normal(size=(60, 16)).tolist()
    rows = [(i, x, i % 2) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, v[0], None), (904, v[0], 0), (905, v[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    e = {i: np.array(x) / np.linalg.norm(x) for i, x, lab in rows if x is not None and np.isfinite(x).all() and np.any(x) and lab is not None}
    lab = {r[0]: r[2] for r in rows}
    links = {i: [j for j in e if j != i and lab[i] == lab[j] and e[i] @ e[j] >= 0.93] for i in e}
    got = {r.vec_id: r for r in vector_neighbours.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    found, total = sum(got[i].n_links for i in e), sum(map(len, links.values()))
    assert found <= total and found >= 0.95 * total
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903))
    assert got[904].component_id == 0 and not got[904].kept


def test_vectors_rare_links_under_a_weak_search(spark, monkeypatch):
    """What a search loses in a label with links too few for an audit is found all the same."""
    monkeypatch.setattr(vector_neighbours, "BLOCK", 32)
    monkeypatch.setattr(vector_neighbours, "TREES", 1)
    monkeypatch.setattr(vector_neighbours, "DESCENTS", 0)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 32))
    v[750:758] = v[:8] + rng.normal(size=(8, 32)) * 0.3
    u = v / np.linalg.norm(v, axis=1)[:, None]
    truth = u @ u.T >= 0.93
    np.fill_diagonal(truth, False)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_neighbours.near_duplicates(df).collect()}
    assert truth.sum() >= 10
    assert [got[i] for i in range(len(v))] == truth.sum(1).tolist()


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.read_vocabulary(P.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(list(vocabulary), 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, vocabulary, ["doc_id"]).collect()}
    for i, t in texts_of(docs).items():
        assert got[i] == len(library.encode(t).ids)
    rng = random.Random(3)
    made = ["".join(rng.choices(["▁", " ", "  ", "a", "the", "ing", "é", "日", "\n", "ſ"], k=rng.randint(0, 9))) for _ in range(4000)]
    assert token_counts.UnigramCounter(vocabulary).count(made) == [len(library.encode(t).ids) for t in made]


def test_token_counts_of_hard_rows(spark, hard):
    vocabulary = (("<unk>", -9.0), ("▁", -1.0), ("a", -1.0), ("▁a", -2.0), ("aa", -2.0))
    got = token_counts.count_tokens(hard, vocabulary, ["doc_id", "kept"], name="pieces").collect()
    assert len(got) == hard.count() and got[0].pieces == got[1].pieces == 0
    assert token_counts.count_tokens(hard.limit(0), vocabulary, ["doc_id"]).count() == 0
    # Of equal sums the earlier start stays: "▁" "a" "a" is no better than "▁a" "a", and "▁" "aa" than that.
    assert token_counts.UnigramCounter(vocabulary).count(["aa"]) == [2]


def test_licenses(spark, hard):
    index = licenses.LicenseIndex(licenses.TEMPLATES)
    text = "é before. Licensed under the Apache License, Version 2.0. after"
    (name, cover, s, e), = [x for x in index.scan(text.encode()) if x[0] == "Apache-2.0"]
    assert cover == 1.0 and text[s:e].startswith("Licensed under") and text[s:e].endswith("2.0")
    whole = licenses.TEMPLATES["MIT-text"].replace("free of charge,", "without charge,")
    assert any(n == "MIT-text" and 0.8 < c < 1 for n, c, _, _ in index.scan(whole.encode()))
    assert all(not r.licenses for r in licenses.scan(hard, ["doc_id"]).collect())
    assert licenses.scan(hard.limit(0), ["doc_id"]).count() == 0
    text = "Licensed x y Licensed under the Apache License, Version 2.0"
    assert [text[s:e] for n, _, s, e in index.scan(text.encode()) if n == "Apache-2.0"] == [text[13:]]
    whole = "x " * 50 + licenses.TEMPLATES["MIT-text"] + " y" * 30
    assert [(n, c, whole[s:e]) for n, c, s, e in index.scan(whole.encode())] == [("MIT-text", 1.0, licenses.TEMPLATES["MIT-text"].rstrip("."))]


def plain_alignment(template, text):
    """Most matches, then the fewest words, then the first place, over all spans of the text."""
    best = (0, 0, 0)
    for a in range(len(text)):
        row = [0] * (len(template) + 1)
        for e in range(a, len(text)):
            new = [0]
            for i, w in enumerate(template):
                new.append(max(new[i], row[i + 1], row[i] + (w == text[e])))
            row = new
            best = max(best, (row[-1], a - e, -a))
    return (best[0], -best[2], -best[2] - best[1] + 1) if best[0] else (0, -1, -1)


def test_alignment_is_the_narrowest():
    rng = random.Random(6)
    for _ in range(300):
        template, text = rng.choices("abcd", k=rng.randint(1, 5)), rng.choices("abcde", k=rng.randint(0, 7))
        assert licenses.align(template, text, 0, band=12) == plain_alignment(template, text)


def test_queries_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, DIR)
        got, found = sorted(map(tuple, df.collect())), con.execute(sql)
        assert df.columns == [c[0] for c in found.description] and got == sorted(found.fetchall()), name


def test_vectors_of_mixed_lengths_and_none(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(30)] + [(100 + i, rng.normal(size=16).tolist(), 0) for i in range(20)] + [(200, [1.0] * 8, 0), (201, [1.0] * 16, 0), (202, [2.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in vector_neighbours.near_duplicates(df).collect()}
    assert got[202] == 200 and got[201] == 201 and len(got) == 53
    assert vector_neighbours.near_duplicates(df.limit(0)).count() == 0


def test_empty_documents(spark, hard):
    none = hard.limit(0)
    assert bpe.encode(none, bpe.read_ranks(RANKS), keep=["doc_id"]).count() == 0
    assert secrets.scan(none, ["doc_id"]).count() == 0
    assert packing.best_fit(none).count() == 0
