"""Corpus operators against brute force, and on awkward inputs."""

from __future__ import annotations

import array
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from trackloom.llm import bpe, decontaminate, exact_dedup, language_id, pii, quality, sharding, simhash, substring_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empty, tied, repeated and long texts; rows that share passages."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(60)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    line, passage = say(16), say(70)
    texts = [None, "", " ", "A", "a", line, line.upper(), passage, passage + " x", "x" * 30_000, "Ünïcode Ünïcode", say(400)]
    texts += [f"{say(20)} {line} {say(9)}" for _ in range(90)] + [f"{say(5)}\n{passage[: 40 * k]}\t{say(6)}" for k in range(1, 8)]
    texts += [say(12) for _ in range(5)] + [say(3) for _ in range(5)] + [texts[11], texts[11]]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 7, "z") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return [*rows, rows[3], (None, "null id", None, None, None, None, None), (None, line + " end", None, None, None, None, None), (-4, line + " low", "en", "", 1, 1, "")]


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, awkward, nothing):
    got = exact_dedup.exact_dedup(docs, keep="largest").collect()
    groups = collections.defaultdict(list)
    for r in awkward:
        groups[low(r[1])].append(r[0])
    want = collections.Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, best, len(ids), sha(t)] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_trie_spills_by_subtree():
    rnd = random.Random(2)
    keys = [("same start " + "".join(rnd.choice("ab") for _ in range(rnd.randrange(40)))).encode() for _ in range(4000)]

    def merge(end, payload):
        end[:] = [end[0] + payload[0]] if end else list(payload)

    owner = exact_dedup.TrieOwner(merge, budget=20_000)
    for k in keys:
        owner.add(k, (1,))
    assert owner.spills
    got = collections.Counter()
    for k, end in owner.drain():
        got[k] += end[0]
    assert got == collections.Counter(keys)


def test_sharding(docs, awkward, nothing):
    got = sharding.shard_documents(docs, 16).collect()
    assert len(got) == len(awkward)
    sizes, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    texts = collections.defaultdict(set)
    for r in awkward:
        texts[r[0]].add(r[1] or "")
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values()) and set(sizes) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing, 16).count() == 0


def test_best_fit_decreasing():
    rnd = random.Random(3)
    classes = [(s, rnd.randrange(1, 9)) for s in rnd.sample(range(1, 500), 60)]
    runs = sharding.best_fit_decreasing(classes, 1000)
    load, placed = collections.Counter(), collections.Counter()
    free = []  # a plain list as the balanced tree's twin
    want = []
    for size, n in sorted(classes, reverse=True):
        for _ in range(n):
            fits = sorted((f, b) for b, f in enumerate(free) if f >= size)
            b = fits[0][1] if fits else len(free)
            if not fits:
                free.append(1000)
            free[b] -= size
            want.append((size, b))
    got = []
    for size, a, b, bin_ in runs:
        load[bin_] += size * (b - a)
        placed[size] += b - a
        got += [(size, bin_)] * (b - a)
    assert max(load.values()) <= 1000 and placed == collections.Counter(dict(classes)) and len(load) == len(free)
    assert sorted(load.values()) == sorted(1000 - f for f in free)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs, awkward, nothing):
    rnd = random.Random(8)
    long = next(r[1] for r in awkward if r[0] == 11).split()
    items = [(1, " ".join(long[30:55])), (2, "Ünïcode, ÜNÏCODE"), (2, "a"), (3, None), (None, " ".join(long[100:130])), (4, "!!"), (5, " ".join(rnd.sample(long, 12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    owners = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        for s in range(max(1, len(w) - 9)) if w else ():
            owners[tuple(w[s : s + 10])].add("null" if i is None else str(i))
    want = collections.Counter()
    for r in awkward:
        w = WORD.findall(low(r[1]))
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in owners}:
            for s in range(len(w) - n + 1):
                if (who := owners.get(tuple(w[s : s + n]))) is not None:
                    hit[s : s + n] = [1] * n
                    found |= who
        want[r[0], len(w), sum(hit), ",".join(sorted(found))] += 1
    for block_bytes in (1 << 20, 100):  # in one block, and in many
        out = decontaminate.find_contamination(docs, bench, block_bytes=block_bytes).collect()
        assert collections.Counter((r.doc_id, r.n_words, sum(x.end - x.first for x in r.spans), ",".join(x or "null" for x in r["items"])) for r in out) == want
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    assert all(not r.spans for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())


def test_wu_manber_finds_every_occurrence():
    rnd = random.Random(4)
    seq = [rnd.randrange(4) for _ in range(3000)]
    for m in (1, 2, 3, 7):
        patterns = list({tuple(rnd.randrange(1, 4) for _ in range(m)) for _ in range(5)})
        want = {(i, k) for i in range(len(seq) - m + 1) for k, p in enumerate(patterns) if tuple(seq[i : i + m]) == p}
        assert set(decontaminate.WuManber(patterns, 4).search(seq)) == want


def test_bpe_agrees_with_the_library(docs, awkward):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.WordBPE(path)
    rnd = random.Random(1)
    odd = ["".join(chr(rnd.choice([rnd.randrange(0x250), rnd.randrange(0xD800), rnd.randrange(0x1F300, 0x1F700), 0x3A3, 0x301])) for _ in range(rnd.randrange(30))) for _ in range(400)]
    odd += [chr(c) + "a" for c in range(0x250)] + ["<|endoftext|>Hi<|startoftext|> x <|ENDOFTEXT|>", "İstanbul", "ΑΣ ΟΔΟΣ", "abcdefghij" * 2000]
    for t in odd + [r[1] or "" for r in awkward]:
        e, ids = library.encode(t, add_special_tokens=False), own.encode(t)
        assert list(array.array("I", ids)) == e.ids
        assert own.decode(ids) == library.decode(e.ids, skip_special_tokens=False)
    got = bpe.bpe_round_trip(docs, path).collect()
    assert len(got) == len(awkward) and all(len(r["ids"]) == r.n_tokens for r in got)


def test_pii_base_spans(spark, awkward):
    extra = [
        "a@b.c@d.e x@y.com.foo@z.com a@b.c_d@e.f é@x.y .%a@b-.c", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 1.1.1 " + "9" * 500 + ".1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 49927398716 " + "4" * 9000,
        "+1 (555) 010-9999. +12 +44 20 7946 0958 ++49 30 901820+7", "mail me: 𝒳 tom@example.com 😀 10.0.0.1", "+" * 300 + "1" * 20, None, "",
    ]
    rows = [(i, t) for i, t in enumerate(extra + [r[1] for r in awkward])]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(k, m):
        d = [int(x) for x in m if x.isascii() and x.isdigit()]
        if k == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if k == "card":
            return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
        return k == "email" or 8 <= len(d) <= 15

    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    for i, t in rows:
        for k, p in patterns.items():
            want = [(m.start(), m.end()) for m in re.finditer(p, t or "") if valid(k, m[0])]
            assert [(x.s, x.e) for x in got[i][k]] == want, (k, (t or "")[:80])


def test_pii_trees_add_spans(spark):
    rnd = random.Random(6)
    number = lambda: "".join(str(rnd.randrange(10)) for _ in range(10))
    rows = [(i, f"call +1{number()} now" if i % 2 else f"lot {number()[:3]}-{number()[:3]} left") for i in range(400)]
    rows += [(1000 + i, f"call +1{number()[:3]}/{number()} now") for i in range(4)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].phone and not out[i].added for i in range(1, 400, 2)) and not any(out[i].added for i in range(0, 400, 2))
    trees = pii.fit_trees([((3, 5, 1, 1, 0, 0, 0, 0, 0, 0, 0), 50.0, 1.0), ((3, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0), 0.0, 60.0)])
    score = lambda v: sum(pii.evaluate(t, v) for t in trees)
    assert score((3, 5, 1, 1, 0, 0, 0, 0, 0, 0, 0)) > 0 > score((3, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0))


def brute_simhash(rows):
    def fp(t):
        w = low(t).encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return [fp(r[1]) for r in rows]


def test_simhash_groups(docs, awkward, nothing):
    want = brute_simhash(awkward)
    f = np.array(want, np.uint64)
    comp = np.arange(len(f))
    near = np.array([np.bitwise_count(f ^ x) <= 3 for x in f])
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(f))])
        if (new == comp).all():
            break
        comp = new
    least = {c: min((r[0] for r, k in zip(awkward, comp, strict=True) if k == c and r[0] is not None), default=None) for c in set(comp)}
    expect = collections.Counter((r[0], w if w < 1 << 63 else w - (1 << 64), least[c]) for r, w, c in zip(awkward, want, comp, strict=True))
    assert collections.Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_groups(docs).collect()) == expect
    assert simhash.near_groups(nothing).count() == 0


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bits", [40, 24, 12])
def test_posting_lists_lose_no_link(bits, monkeypatch):
    """Long lists are cut finer, down to bit flips, and still link what brute force links."""
    monkeypatch.setattr(simhash, "DIRECT", 8)
    rng = np.random.default_rng(bits)
    fps = np.unique(rng.integers(0, 1 << bits, 700, dtype=np.uint64) | np.uint64(5 << 48))
    fps = np.unique(np.r_[fps, fps[:200] ^ (np.uint64(1) << rng.integers(0, bits, 200, dtype=np.uint64))])
    want = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 3]
    got = simhash.list_links(fps, (5, 6, 7), 3)
    assert all(bin(int(fps[i] ^ fps[j])).count("1") <= 3 for i, j in got)
    a, b = components(len(fps), want), components(len(fps), got)
    assert len({*zip(a, b, strict=True)}) == len(set(a)) == len(set(b))


def test_similar_groups(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(300)] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{rnd.randrange(5000)}" for _ in range(200))) for i in range(50)]
    rows += [(None, " ".join(base)), (200, ""), (201, None), (202, "two words"), (203, "two words")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert None not in got and {got[i] for i in range(30)} == {0}
    assert all(got[100 + i] == 100 + i for i in range(50)) and got[201] == 200 and got[203] == 202


def brute_repeats(rows, size):
    order = lambda i: substring_dedup.NULL_ID if i is None else i
    first = {}
    for r in rows:
        w = (r[1] or "").encode().split()
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, order(None)), order(r[0]))
    out = collections.Counter()
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = [0] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < order(r[0]):
                gone[s : s + size] = [1] * size
        out[r[0], len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return out


@pytest.mark.parametrize("per_salt", [128, 4])
def test_substring_dedup(docs, awkward, nothing, monkeypatch, per_salt):
    monkeypatch.setattr(substring_dedup, "PER_SALT", per_salt)
    got = substring_dedup.remove_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(awkward, 13)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_suffix_automaton():
    rnd = random.Random(1)
    ref, seq = [rnd.randrange(3) for _ in range(300)], [rnd.randrange(3) for _ in range(300)]
    automaton = substring_dedup.SuffixAutomaton()
    automaton.extend(ref)
    joined = "".join(map(str, ref))
    want = [max(n for n in range(i + 2) if "".join(map(str, seq[i + 1 - n : i + 1])) in joined) for i in range(len(seq))]
    assert automaton.statistics(seq) == want


def test_language_id(spark, docs):
    rnd = random.Random(7)
    kinds = {"aa": "abcde ", "bb": "vwxyz "}
    rows = [(i, "".join(rnd.choice(kinds[k]) for _ in range(rnd.randrange(30, 900))), k) for i, k in enumerate(["aa", "bb"] * 120)]
    rows += [(9000, None, "aa"), (9001, "1234 !!", "bb"), (None, "abcabc deb", None), (9002, "", None)]
    got = {r.doc_id: r for r in language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert sum(got[i].lang_pred == k for i, _, k in rows[:240]) >= 236
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9000, 9001, 9002)) and not got[None].held_out
    blank = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify_language(blank).first().lang_pred == "und" and language_id.identify_language(blank.limit(0)).count() == 0


def test_quality(spark, nothing):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["river", "stone", "calm", "green", "light"]) for _ in range(60)) + "."
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        text = good() if kind < 2 else good().upper().replace(" ", "!! ") if kind == 2 else good() + " moron idiot"
        rows.append((i, text, "en", f"http://h{i % 5}.org/p{i % 2}/x", len(text), None, None))
        labels.append((i, int(kind != 2), int(kind == 3)))
    rows += [(900, None, None, None, None, None, None), (0, rows[0][1], "en", "", 1, 1, "")]
    labels += [(1, None, 0), (None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.judge(docs, marks)
    assert out.columns == [*docs.columns, "__judged"] and out.count() == len(rows)
    keep = {r.doc_id: r["__judged"].keep for r in out.collect()}
    assert all(keep[i] == (i % 4 < 2) for i in range(400))
    assert quality.keep_good(docs, marks).columns == docs.columns
    few = {r.doc_id: r["__judged"].keep for r in quality.judge(docs, marks, broadcast_sites=0).collect()}
    assert few == keep
    assert all(r["__judged"].keep for r in quality.judge(docs, marks.limit(0)).collect())
    assert quality.judge(nothing, marks).count() == 0


def test_site_posteriors_shrink(spark):
    rows = [("big", "a", 6.0, -9.0)] * 200 + [("bad", "a", -6.0, -9.0)] * 200 + [("tiny", "a", -6.0, -9.0)]
    out, (mean, _) = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, quality double, toxic double"))
    post = {r.host: r.post_q for r in out.collect()}
    assert post["bad"] < post["tiny"] < mean < post["big"]


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 700, "b" * 1000
    rows = [(1, "http://a/1", big, 5), (2, "http://a b/\n2", big, 5), (7, None, big, 5), (3, "http://a/3", "small", 5), (4, "u", "small", 5), (5, "u", None, 5), (6, "u", "", 5), (8, "u", other, 5), (8, "u", other, 5), (None, "u", big, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, warc_type long").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.page_records(pages), path)
    back = warc.read_warc(spark, path)
    assert back.count() == len(rows)
    for r in back.collect():
        if r.warc_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.header_digest == r.computed_digest and r.payload_bytes == len(r.payload)
        else:
            assert r.refers_to == "<urn:page:7>" and r.payload is None and r.payload_bytes == 1400
    got = sorted((r.record_id, r.warc_type) for r in back.where("warc_type = 'revisit'").collect())
    assert got == [("<urn:page:1>", "revisit"), ("<urn:page:2>", "revisit"), ("<urn:page:none>", "revisit")]
    assert back.where("target_uri LIKE 'http://a/%'").count() == 2 and back.where("target_uri IS NULL").count() == 1
    warc.write_warc(warc.page_records(pages.limit(0)), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("kind", ["sl", "plain gzip", "uncompressed"])
def test_warc_reader_skips(kind):
    import gzip

    row = {"record_id": "<r>", "warc_type": "response", "target_uri": "u", "date": "d", "refers_to": None, "header_digest": None, "payload_bytes": None, "payload": None}
    raws = [warc.record_bytes(row | {"record_id": f"<{i}>", "payload": bytes([65 + i]) * (50_000 * (i % 3))}) for i in range(9)]
    data = b"".join(warc.gzip_member(r) if kind == "sl" else gzip.compress(r) if kind == "plain gzip" else r for r in raws)
    for wanted in (lambda r: True, lambda r: r["record_id"] in ("<4>", "<8>")):
        got = list(warc.read_records(pa.BufferReader(data), wanted, "full"))
        assert [(r["record_id"], r["payload"]) for r in got] == [(f"<{i}>", bytes([65 + i]) * (50_000 * (i % 3))) for i in range(9) if wanted({"record_id": f"<{i}>"})]
    assert gzip.decompress(b"".join(map(warc.gzip_member, raws))) == b"".join(raws)


def test_components(spark):
    from trackloom.llm.components import component_roots

    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(links, "u long, v long")).collect()}
    want = components(500, links)
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    assert all(got.get(i, i) == least[c] for i, c in enumerate(want))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(12)
    words = [f"word{i}" for i in range(3000)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [say(200) for _ in range(60)]
    passage = say(40)
    near = texts[3].split()
    near[7] = "other"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0].upper(), "en", "s", 1), (101, " ".join(near), "en", "s", 1), (102, texts[9] + " " + passage, "en", "s", 1), (103, None, None, None, None), (None, say(80), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    left = sorted((r.doc_id is not None, r.doc_id or 0) for r in P.run(spark, str(tmp_path)).collect())
    gone = {0, 101, 102}  # of equal texts the largest id stays, of near copies the smallest
    assert left == sorted((r[0] is not None, r[0] or 0) for r in rows if r[0] not in gone)


def test_pipeline_near_stage_keeps_one(spark):
    import corpus_pipeline as P

    rows = [(i, "a b c d e f g h i j k", "en", "s", 1, i) for i in (5, 3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra int")
    assert [r.doc_id for r in P.near(spark, docs, "").collect()] == [3]
    assert P.exact(spark, docs, "").select("doc_id").collect()[0].doc_id == 9
    assert P.exact(spark, docs.where("doc_id = 3").union(docs.where("doc_id = 3")), "").count() == 1




@pytest.mark.parametrize("name", ["op2_decontamination", "op3_warc", "op6_exact_dedup", "op7_substring_dedup"])
def test_sql_twins(spark, name):
    import os

    from comparing import differences

    from trackloom.llm import registry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data here")
    assert differences(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf) == ""


def test_every_query_returns_all_documents(spark):
    import os

    from trackloom.llm import registry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data here")
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_quality", "op4_language_id", "op5_sharding", "op8_bpe", "op9_pii", "op10_simhash"):
        assert registry.QUERIES[name](spark, sf).select("doc_id").distinct().count() == n, name


def borderline_family(n, pairs, seed):
    """Texts of one template at similarity just below 0.8, and pairs among them above it."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(300)]

    def edit(words, k):
        words = list(words)
        for at in rnd.sample(range(0, 300, 6), k):
            words[at] = f"n{rnd.randrange(10**9)}"
        return words

    texts = [edit(base, 7) for _ in range(n)]
    texts += [edit(t, 5 + i % 3) for i, t in enumerate(texts[:pairs])]
    return [" ".join(t) for t in texts]


def confirmed_components(texts):
    """Components of all pairs that share an index entry, pass the count filter and have Jaccard 0.8."""
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    fps = np.array([simhash.wide_fingerprint(s) for s in sets])
    raw = fps.view(np.uint8).reshape(len(texts), -1)
    links = []
    for i in range(len(texts)):
        same, bits = raw[i] == raw[:i], np.bitwise_count(fps[i] ^ fps[:i]).sum(axis=1)
        entry = np.any([same[:, a] & same[:, b] for a, b in simhash.PAIRS], axis=0)
        for j in np.flatnonzero(entry & (same.sum(axis=1) >= 4) & (bits <= 56)):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, int(j)))
    return components(len(texts), links)


def test_similar_groups_verify_every_candidate(spark):
    texts = borderline_family(300, 60, 4)
    want = confirmed_components(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(want)) < len(texts) - 20
    assert len({(got[i], want[i]) for i in range(len(texts))}) == len(set(want)) == len(set(got.values()))


def test_similar_groups_compare_whole_lists(spark, monkeypatch):
    """Lists of many blocks join what whole lists join."""
    monkeypatch.setattr(simhash, "BLOCK", 16, raising=False)
    texts = borderline_family(200, 60, 5)
    want = confirmed_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert len({(got[i], want[i]) for i in range(len(texts))}) == len(set(want)) == len(set(got.values()))
    long = spark.createDataFrame([(7, 3)], "key int, blocks int")
    postings = spark.createDataFrame([(k, i, i, bytes([i])) for k in (7, 8) for i in range(40)], "key int, node long, root long, fp binary")
    parts = collections.defaultdict(set)
    for r in simhash._dealt(postings, long).collect():
        parts[r.key, r.part].add(r.node)
    assert len(parts) == 4 and parts[8, 0] == set(range(40))
    assert all(any({i, j} <= p for (k, _), p in parts.items() if k == 7) for i in range(40) for j in range(i))


def test_pipeline_verdicts_hold_for_rows(spark, tmp_path):
    """Null ids are judged like others; rows that repeat an id are judged one by one."""
    import corpus_pipeline as P

    rnd = random.Random(3)
    say = lambda n: " ".join(f"word{rnd.randrange(3000)}" for _ in range(n))
    passage, base = say(40), say(200)
    copy = base.split()
    copy[7] = "other"
    rows = [(1, say(90)), (1, f"{say(90)} {passage}"), (None, say(90)), (None, f"{say(90)} {passage}"), (None, " ".join(copy)), (5, base), (5, say(120)), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    assert left(P.decontaminate(spark, docs, str(tmp_path))) == collections.Counter(r for i, r in enumerate(rows) if i not in (1, 3))
    # the two passages' rows are no near copies: half of their words differ
    assert left(P.near(spark, docs, str(tmp_path))) == collections.Counter(r for i, r in enumerate(rows) if i != 4)
