"""Embedding near-dedup, hard negatives and spelling variants against brute force."""

from __future__ import annotations

import collections
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

from trackloom.llm import embedding_dedup, hard_negatives, registry, spelling_variants

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from comparing import differences  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def links_of(vectors, cosine=0.95):
    """Pairs of places that link, by brute force."""
    x = [np.array(v, float) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) else None for v in vectors]
    fit = [i for i, v in enumerate(x) if v is not None]
    return [(i, j) for i in fit for j in fit if i < j and len(x[i]) == len(x[j]) and (x[i] @ x[j]) / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine]


def expected(ids, vectors):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = collections.Counter()
    for i, j in links_of(vectors):
        n[i] += 1
        n[j] += 1
        root[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    least = {g: min((i for i in own if i is not None), default=None) for g, own in groups.items()}
    return collections.Counter((ids[i], n[i], least[find(i)], ids[i] == least[find(i)]) for i in range(len(ids)))


def planted(rnd, n=600, dims=64):
    rows = [rnd.normal(size=dims) for _ in range(n)]
    for size, spread in ((150, 0.1), (90, 0.2), (60, 0.3)):  # families, ever looser: some pairs of the last are below the limit
        base = rnd.normal(size=dims)
        rows += [base + spread * rnd.normal(size=dims) for _ in range(size)]
    rows += [rows[3].copy() for _ in range(40)]  # equal rows
    rows += [rows[i] * rnd.uniform(0.1, 9) + 0.2 * rnd.normal(size=dims) * np.linalg.norm(rows[i]) / 8 for i in range(60)]
    return rows


@pytest.mark.parametrize("block,list_rows", [(4096, 512), (64, 32)])
def test_embedding_links(spark, monkeypatch, block, list_rows):
    """Families, equal rows, other lengths and odd vectors; lists in one task and over many."""
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", list_rows)
    rnd = np.random.RandomState(7)
    rows = [v.astype(np.float32).tolist() for v in planted(rnd)]
    rows += [None, [], [0.0] * 64, [None, *[1.0] * 63], [float("nan")] * 64, [float("inf")] * 64, [1.0, 2.0], [1.0, 2.01], [-1.0, 2.0], [1e30, 2e30]]
    ids = [int(i) for i in rnd.permutation(len(rows))]
    ids[5], ids[700], ids[-3] = None, ids[701], ids[0]
    given = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<float>, node string").repartition(7)
    got = embedding_dedup.near_embeddings(given, block=block).collect()
    assert collections.Counter(map(tuple, got)) == expected(ids, rows)


def test_embeddings_in_double_precision_and_empty(spark):
    rows = [(1, [1e200, 0.0, 1e200]), (2, [1e-200, 0.0, 1e-200]), (3, [0.0, 1.0, 0.0])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_dedup.near_embeddings(given).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert embedding_dedup.near_embeddings(given.limit(0)).collect() == []
    assert [tuple(r) for r in embedding_dedup.near_embeddings(given.where("vec_id = 3").selectExpr("vec_id", "cast(null as array<double>) as embedding")).collect()] == [(3, 0, 3, True)]
    with pytest.raises(ValueError):
        embedding_dedup.near_embeddings(given, cosine=0.3)


def test_index_recall():
    """On vectors without clusters: the lists that are visited hold all but a few near pairs, and the table bound none loses."""
    rnd, radius = np.random.RandomState(1), math.sqrt(0.1)
    x = rnd.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    step = rnd.normal(size=x.shape)
    step -= (step * x).sum(1)[:, None] * x
    y = x * 0.9505 + step / np.linalg.norm(step, axis=1)[:, None] * math.sqrt(1 - 0.9505**2)  # just within the limit
    model = embedding_dedup.Quantiser.fit(x[:2000], 100, radius)
    for margin, least in ((None, 0.99), (radius / 2, 1.0)):
        m = embedding_dedup._margin(margin, radius, 64)
        (a, seen_a), (b, seen_b) = model.lists_of(x, m), model.lists_of(y, m)
        found = [i == j or j in p or i in q for i, j, p, q in zip(a, b, seen_a, seen_b, strict=True)]
        assert np.mean(found) >= least
    codes, lost = model.codes(y, b)
    for i in range(200):
        assert model.table_distances(x[i : i + 1], b[i], codes[i : i + 1])[0, 0] <= radius + lost[i] + 1e-9


def test_forest_keeps_what_is_linked():
    rnd = random.Random(4)
    i, j = (np.array([rnd.randrange(300) for _ in range(260)]) for _ in range(2))
    root = np.arange(300)
    u, v = embedding_dedup.forest(root, i, j)
    again = np.arange(300)
    embedding_dedup.forest(again, u, v)
    assert (again == root).all() and len(u) == 300 - len(set(root))


def mined(rows, k=5, positives=5):
    """Hard negatives of ``id, label, v`` by brute force."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = collections.Counter()
    for a, (i, label, v) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, at, other) for at, (j, other, w) in enumerate(rows) if at != a and len(w) == len(v))
        for p in [s for s in scored if s[3] == label][:positives]:
            fit = [s for s in scored if s[3] != label and -80 * p[0] <= -100 * s[0] <= -100 * p[0]][:k]
            for rank, s in enumerate(fit, 1):
                out[i, p[1], rank, s[1], -p[0], -s[0]] += 1
    return out


def test_hard_negatives(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, rnd.randrange(3), [rnd.randrange(-3, 6) for _ in range(4)]) for i in range(900)]  # many ties
    rows += [(1000 + i, i % 2, [1, 1]) for i in range(30)] + [(None, 1, [1, 1]), (2000, None, [1, 1]), (2100, 1, None), (2200, 1, [1, None]), (2300, 1, []), (2301, 2, []), (2302, 1, [])]
    rows += [(3000, 7, [2**40, 2**20, 1, 1]), (3001, 7, [2**20, 2**40, 0, 1]), (3002, 8, [2**20 - 1, 2**40, 0, 1])]
    given = spark.createDataFrame([(*r, 1) for r in rows], "id long, label int, v array<long>, key int").repartition(5)
    for size in (8192, 64):
        monkeypatch.setattr(hard_negatives, "ROWS", size)
        monkeypatch.setattr(hard_negatives, "ANCHORS", size)
        got = hard_negatives.mine_negatives(given, "id % 100 = 0").collect()
        assert collections.Counter(map(tuple, got)) == mined(rows)
    assert hard_negatives.mine_negatives(given.limit(0), "id % 100 = 0").collect() == []


def test_whole_vectors(spark):
    rows = [(7, 9, [0.5, -0.001]), (8, 9, [1e30, -1e30]), (9, None, [1.0]), (10, 1, None), (11, 1, [float("nan")]), (12, 1, [None])]
    got = hard_negatives.whole_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(7, 0, [128, -1]), (8, 9, [2**63 - 1, -(2**63)]), (9, None, [256]), (10, 1, None), (11, 1, None), (12, 1, None)]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op13_hard_negatives"])
def test_vector_queries_against_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SMALL), registry.ORACLE_SQL[name], SMALL) == ""


def variants(docs, least_length=6, least_n=5, ratio=5, damage=199):
    """Spelling variants of ``doc_id, text`` by brute force over deletions of both words."""
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_n}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :]

    skeleton = collections.defaultdict(set)
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            skeleton[key].add(w)
    around = {w: {o for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for o in skeleton[key] if near(w, o)} for w in words}
    form = {}
    for w, own in around.items():
        best = min(own, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(around[w]), words[form[w]] if form[w] is not None else None) for w, n in words.items()}


def typos(rnd, n=300):
    words = ["station", "reading", "Bücher", "cafétéria", "aaaaaaaa", "mississippi", "garden", "gardens", "gården", "lettering"]
    docs = []
    for i in range(n):
        own = []
        for _ in range(60):
            w = list(rnd.choices(words, [2.0 ** -k for k in range(len(words))])[0])
            if rnd.random() < 0.2:
                at, what = rnd.randrange(len(w)), rnd.randrange(3)
                w[at : at + (what > 0)] = [] if what == 1 else [rnd.choice("aeg")]
            own.append("".join(w))
        docs.append((i, rnd.choice([" ", "-", "9"]).join(own)))
    return docs


def test_spelling_variants(spark):
    rnd = random.Random(12)
    docs = typos(rnd) + [(None, "station Station STATION"), (5, None), (6, ""), (7, "×÷×÷×÷ " * 9), (8, "x" * 70_000 + " " + "x" * 69_999 + "y "), (8, ("z" * 5000 + "a ") * 6 + ("z" * 5000 + "b ") * 40 + ("z" * 5001 + "b ") * 7)]
    given = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(5)
    got = [tuple(r) for r in spelling_variants.spelling_variants(given, damage=7).collect()]
    assert len(got) == len(set(got)) and set(got) == variants(docs, damage=7)
    assert any(r[1] for r in got) and any(r[2] != r[1] for r in got if r[1]) and any(r[4] > 3 for r in got)
    assert spelling_variants.spelling_variants(given.limit(0)).collect() == []


def test_unlike_words_of_one_hash(spark, monkeypatch):
    """Where letters share their mixed values, the joined pair decides."""
    monkeypatch.setattr(spelling_variants, "_mixed", lambda h: h % np.uint64(5))
    docs = typos(random.Random(13), 40)
    got = spelling_variants.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == variants(docs)


def test_neighbourhood_is_whole_and_distinct(monkeypatch):
    rnd, alphabet = random.Random(3), "abcé"
    for size in (1 << 17, 8):
        monkeypatch.setattr(spelling_variants, "SLICE", size)
        hasher, points = spelling_variants.Hasher(12), spelling_variants.code_points("abcé")
        for n in range(1, 12):
            words = ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(9)]
            got = collections.defaultdict(list)
            for length, h, real in hasher.neighbours(spelling_variants.code_points("".join(words)).reshape(9, n), points):
                for at in zip(*np.nonzero(real), strict=True):
                    got[at[0]].append((length, int(h[at].view(np.int64))))
            for i, w in enumerate(words):
                want = {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + c + w[i + 1 :] for i in range(n) for c in alphabet} | {w[:i] + c + w[i:] for i in range(n + 1) for c in alphabet}
                want = sorted(want - {w, ""})
                assert sorted(got[i]) == sorted(zip(map(len, want), spelling_variants.hashes(want).tolist(), strict=True))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_spelling_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op12_spelling_variants"](spark, SMALL)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == variants(docs)
