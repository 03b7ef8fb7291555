"""Near-duplicate operators against brute force."""

import random
import re

import numpy as np
import pytest

from leafmill.llm import components, hashing, multi_index, queries, setsketch_dedup
from tests.conftest import SF_DIR
from tests.llm.util import by_id, docs, read, with_clashes


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, words=2):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(words, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(texts, words=2, percent=80):
    sets = {i: shingles(t, words) for i, t in texts.items()}
    found, ids = Union(texts), sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            small, big = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * big:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (small + big - both):
                    found.join(a, b)
    return {i: (len(sets[i]), found.root(i), found.root(i) == i) for i in texts}


def results(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def variants(seed, groups=12, size=14):
    """Groups of texts with more and more words changed, so that links form chains and stars."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(20, 120))
        for _ in range(size):
            base_or_last = base if rng.random() < 0.7 else out[-1].split()
            w = list(base_or_last)
            for _ in range(rng.randrange(0, max(1, len(w) // 6))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_setsketch_matches_brute_force(spark, words):
    texts = variants(words) + ["", None, " \t\n", "one", "ONE", "one two", "ONE\x0btwo", "é É", "É é", "two one"]
    got = results(setsketch_dedup.near_duplicates(with_clashes(docs(spark, texts)), words=words))
    assert got == brute(dict(enumerate(texts, 1)), words)


def test_setsketch_on_the_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in read(spark, SF_DIR).collect()}
    assert results(queries.op2_setsketch(spark, SF_DIR)) == brute(texts)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_of_polynomials_alike_are_told_apart(spark):
    """Such words have equal polynomials modulo a power of two, whatever the base."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    hashes, _ = hashing.word_hashes([one.encode(), other.encode()])
    assert hashes[0] != hashes[1]
    got = results(setsketch_dedup.near_duplicates(docs(spark, [one, other, one])))
    assert got == brute({1: one, 2: other, 3: one})


def test_signatures_keep_linked_pairs_together():
    """Pairs at the threshold differ in fewer bits than a hub's two bounds lie apart."""
    rng, apart = np.random.default_rng(9), []
    for _ in range(1500):
        values = rng.integers(0, 1 << 63, 270).astype(np.uint64)
        a, b = (setsketch_dedup.signature(setsketch_dedup.registers(np.unique(v))) for v in (values[:243], values[27:]))
        apart.append(sum(int(x ^ y).bit_count() if x ^ y >= 0 else int((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True)))
    assert abs(np.mean(apart) - 12.8) < 0.5 and np.mean(np.array(apart) > setsketch_dedup.WIDE - setsketch_dedup.TIGHT) <= 0.001


def test_setsketch_links_in_buckets_of_several_hubs(spark):
    """Texts of one short common core and long parts of their own meet in the same buckets under different hubs."""
    rng = random.Random(12)
    vocabulary, texts = [f"v{k}" for k in range(3000)], []
    for _ in range(25):
        core = rng.choices(vocabulary, k=150)
        for _ in range(4):
            base = core + rng.choices(vocabulary, k=100)
            for _ in range(6):
                w = list(base)
                for at in rng.sample(range(len(w)), rng.randrange(0, 18)):
                    w[at] = rng.choice(vocabulary)
                texts.append(" ".join(w))
    rng.shuffle(texts)
    assert results(setsketch_dedup.near_duplicates(docs(spark, texts))) == brute(dict(enumerate(texts, 1)))


def test_setsketch_hot_groups_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(setsketch_dedup, "GROUP_BLOCK", 20)
    monkeypatch.setattr(setsketch_dedup, "LEFT_BLOCK", 7)
    texts = variants(5, groups=1, size=150) + ["same text here again"] * 60
    assert results(setsketch_dedup.near_duplicates(docs(spark, texts))) == brute(dict(enumerate(texts, 1)))
    assert setsketch_dedup.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    assert setsketch_dedup.near_duplicates(docs(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c")])).count() == 3


def test_setsketch_long_text_and_words(monkeypatch):
    text = b"ab " * 200_000 + b"x" * 3_000_000 + b" end"
    whole = setsketch_dedup.shingle_sets([text])[0]
    monkeypatch.setattr(hashing, "SLICE", 1000)
    assert len(whole) == 3 and (setsketch_dedup.shingle_sets([text])[0] == whole).all()


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(values[:2400]), np.unique(values[600:])
    ra, rb = setsketch_dedup.registers(a), setsketch_dedup.registers(b)
    assert (setsketch_dedup.merge(ra, rb) == setsketch_dedup.registers(np.unique(values))).all()
    got = setsketch_dedup.estimated_similarity(np.array([2400.0]), np.array([2400.0]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))[0]
    assert abs(got - 1800 / 3000) < 0.15
    one = setsketch_dedup.estimated_similarity(np.array([5.0]), np.array([5.0]), np.array([0]), np.array([0]))[0]
    assert one > 0.99


def test_shared_counts_by_matrix_and_one_by_one():
    rng = np.random.default_rng(2)
    a = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(30)]
    b = [np.unique(rng.integers(0, 300, 60)).astype(np.uint64) for _ in range(20)]
    pairs = np.argwhere(np.ones((30, 20)))
    want = [len(np.intersect1d(a[i], b[j])) for i, j in pairs]
    assert setsketch_dedup.shared_counts(a, b, pairs).tolist() == want
    assert setsketch_dedup.shared_counts(a, b, pairs[:5]).tolist() == want[:5]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (5, 4), (None, 3)]
    found = Union(range(301))
    for a, b in edges:
        if a is not None:
            found.join(a, b)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r["id"]: r["component_id"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: found.root(n) for n in nodes}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def vector_brute(vectors, cosine=0.95):
    good = {i: np.array(v, float) for i, v in vectors.items() if v and None not in v and np.isfinite(v).all() and np.any(v)}
    found, n = Union(vectors), dict.fromkeys(vectors, 0)
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= cosine:
                found.join(a, b)
                n[a] += 1
                n[b] += 1
    return {i: (n[i], found.root(i), found.root(i) == i) for i in vectors}


def vector_results(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_multi_index_recall_at_the_threshold(spark, monkeypatch):
    """Pairs around a cosine of 0.95: nothing below, and nearly everything above, against brute force."""
    monkeypatch.setattr(multi_index, "BLOCK", 100)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    near = [b + rng.normal(size=32) * np.linalg.norm(b) / 32**0.5 * s for b in base for s in (0.1, 0.2, 0.25, 0.3)]
    vectors = {i: [float(x) for x in v] for i, v in enumerate([*base, *near], 1)}
    got, want = vector_results(multi_index.near_vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))), vector_brute(vectors)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())


def test_multi_index_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = {1: [1.0, 0, 0, 0], 2: [1.0, 0, 0, 0], 3: None, 4: [0.0] * 4, 5: [1.0, None, 0, 0], 6: [nan, 1, 1, 1], 7: [inf, 0, 0, 0], 8: [], 9: [2e-200, 0, 0, 0], 10: [1.0, 0.01, 0, 0], 11: [-1.0, 0, 0, 0], 12: [1e200, 0, 0, 0]}
    v = {i: x and [y if y is None else float(y) for y in x] for i, x in v.items()}
    table = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = vector_results(multi_index.near_vectors(with_clashes(table)))
    linked = {1, 2, 9, 10, 12}
    assert got == {i: (4, 1, i == 1) if i in linked else (0, i, True) for i in v}
    assert multi_index.near_vectors(table.limit(0)).count() == 0
    assert vector_results(multi_index.near_vectors(table.where("vec_id in (3, 4)"))) == {3: (0, 3, True), 4: (0, 4, True)}


def test_multi_index_vectors_of_several_lengths(spark):
    """Every length is compared, that of one number by its sign; a length of few vectors as well as others."""
    rng = np.random.default_rng(6)
    rows = [[1.0], [2.0], [-3.0], [-0.5], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]]
    rows += [[float(x) for x in v] for base in rng.normal(size=(12, 5)) for v in (base, base * 3, base + rng.normal(size=5) * 0.05)]
    rows += [[float(x) for x in v] for base in rng.normal(size=(40, 3)) for v in (base, base + rng.normal(size=3) * 0.1)]
    vectors = dict(enumerate(rows, 1))
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    assert vector_results(multi_index.near_vectors(table)) == vector_brute(vectors)


def test_multi_index_repeated_rows_and_ids(spark):
    table = spark.createDataFrame([(4, [1.0, 1.0]), (4, [1.0, 1.0]), (9, [2.0, 2.0]), (None, [1.0, 1.0]), (None, [0.0, -1.0])], "vec_id long, embedding array<double>")
    rows = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in multi_index.near_vectors(table).collect())
    assert rows == [(0, 0, None, True), (0, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (9, 3, 4, False)]


def test_multi_index_recall_on_a_narrow_cloud(spark):
    """Vectors that share a direction and vary along few others, as embeddings do."""
    rng = np.random.default_rng(8)
    scale = np.concatenate(([2.0], 1 / np.arange(1, 32)))
    base = rng.normal(size=(300, 32)) * scale + scale
    near = [b + rng.normal(size=32) * scale * s for b in base for s in (0.05, 0.1, 0.15)]
    vectors = {i: [float(x) for x in v] for i, v in enumerate([*base, *near], 1)}
    got, want = vector_results(multi_index.near_vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))), vector_brute(vectors)
    assert all(got[i][0] <= want[i][0] for i in want)
    share = sum(g[0] for g in got.values()) / sum(w[0] for w in want.values())
    print("recall on a narrow cloud:", share)
    assert share >= 0.99


def test_multi_index_on_the_embeddings(spark):
    vectors = {r["vec_id"]: list(r["embedding"]) for r in read(spark, SF_DIR, "embeddings").collect()}
    assert vector_results(queries.op1_multi_index(spark, SF_DIR)) == vector_brute(vectors)


def test_traversal_order():
    rng = np.random.default_rng(5)
    index = multi_index.MultiIndex(np.zeros((6, 2)), np.zeros((6, 2)), 0.5, 6)
    a, b = rng.random(6), rng.random(6)
    a[0] = b[0] = 0
    cells = index.visits(a, b)
    sums = [a[c // 6] + b[c % 6] for c in cells]
    assert sums == sorted(sums) and set(cells) == {i * 6 + j for i in range(6) for j in range(6) if a[i] + b[j] <= 0.5}


def test_setsketch_by_rows_of_repeated_and_null_ids(spark):
    """Links of every row are found: texts that share an id, and texts without one."""
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(120))
    a, b, c = text(), text(), text()
    got = setsketch_dedup.near_duplicates(docs(spark, [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, c), (7, c + " z"), (None, c + " q"), (None, text()), (None, "")]))
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()), key=str)
    assert rows == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 7, False), (7, 7, True), (None, 7, False), (None, None, True), (None, None, True)], key=str)
