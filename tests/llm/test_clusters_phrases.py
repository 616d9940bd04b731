"""Centroid clustering, min-max near-dedup and phrase collocations against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inboxlens.llm import centroids, minmax, phrases, words
from tests.conftest import SF001
from tests.llm.conftest import MESSY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"memory_limit": "4GB"})
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    return con


def _same(df, duck, sql):
    want = duck.sql(sql)
    got = sorted(map(tuple, df.select(want.columns).collect()), key=repr)
    want = sorted(want.fetchall(), key=repr)
    assert got == want
    return want


# --- words ------------------------------------------------------------------

@pytest.mark.parametrize("gaps,breaks", [(b" \t\n\v\f\r", b""), (b" \t", b".,;:!?\n\v\f\r")])
def test_words_equal_regular_expressions(gaps, breaks):
    texts = [t for _, t in MESSY] + ["A b.C\td;; e f", "É \x1c x", ".", "a", "  "]
    for part in (pa.array(texts), pa.array(["skipped"] + texts).slice(1)):
        got = words.cut(part, gaps, breaks)
        want, at = [], 0
        for row, t in enumerate(texts):
            for piece in re.split(rb"[" + re.escape(breaks) + rb"]" if breaks else rb"(?!)", (t or "").encode().lower()):
                own = re.findall(rb"[^" + re.escape(gaps) + rb"]+", piece)
                want += [(row, at, x) for x in own]
                at += 1
        names = [x.encode() for x in got.names.to_pylist()]
        assert [(r, names[c]) for r, c in zip(got.rows.tolist(), got.codes.tolist())] == [(r, x) for r, _, x in want]
        same = [a == b for a, b in zip(got.pieces.tolist(), got.pieces.tolist()[1:])]
        assert same == [a[1] == b[1] for a, b in zip(want, want[1:])]


# --- centroids --------------------------------------------------------------

def test_clusters_equal_sql(spark, duck):
    out = centroids.cluster(spark.read.parquet(f"{SF001}/embeddings.parquet"))
    assert len(_same(out.drop("checked"), duck, centroids.oracle_sql())) == out.count() > 10


def _lloyd(rows, clusters, rounds, dimensions):
    """(id, vector) -> sorted (id, cluster, distance), by exact whole numbers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in first[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for k in range(rounds + 1):
        best = [min(range(len(now)), key=lambda c: (far(v, now[c]), c)) for _, v in kept]
        if k < rounds:
            for c in set(best):
                own = [v for (_, v), b in zip(kept, best) if b == c]
                now[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, b, far(v, now[b])) for (i, v), b in zip(kept, best)), key=repr)


def test_clusters_of_odd_vectors(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-3, 3) for _ in range(4)]) for i in range(60)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (None, [0.0, -0.0, 0.5, 1e6]), (7, rows[7][1]), (7, [9.0] * 4), (70, None), (71, []),
             (72, [1.0] * 3), (73, [1.0, None, 1.0, 1.0]), (74, [math.nan] * 4), (75, [math.inf, 0.0, 0.0, 0.0]), (76, [1.0] * 4),
             (77, [1.0] * 4), (78, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    for k in (1, 5, 100):
        got = centroids.cluster(df, clusters=k, rounds=2, dimensions=4).select("vec_id", "cluster", "distance").collect()
        assert sorted(map(tuple, got), key=repr) == _lloyd(rows, k, 2, 4)
    assert centroids.cluster(df.limit(0), dimensions=4).count() == 0
    assert centroids.cluster(df.where("vec_id between 70 and 75"), dimensions=4).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"), dimensions=4).count()


def test_bounds_skip_centroids_and_lose_none():
    rng = np.random.default_rng(3)
    middle = rng.integers(-4000, 4000, (16, 64))
    x = np.concatenate([middle[i] + rng.integers(-30, 30, (200, 64)) for i in range(16)] + [middle, middle[:3]]).astype(np.int64)
    now = middle.copy()
    now[5] = now[4]                                       # a tie everywhere around it
    pivots = middle[[i for pair in centroids.pivot_pairs(middle) for i in pair]]
    best, least, checked = centroids.nearest(x, np.sqrt(centroids._squares(x, pivots).astype(float)), now, pivots)
    every = centroids._squares(x, now)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
    assert checked.mean() < 4
    assert centroids.pivot_pairs(np.zeros((5, 3), np.int64)) == [] and centroids.pivot_pairs(middle[:1]) == []


# --- min-max ----------------------------------------------------------------

def _shingles(text, n=2):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def _near(rows):
    """(id, text) -> sorted (id, size, component, kept) by comparing every two sets."""
    sets = [(i, _shingles(t)) for i, t in rows]
    every = sorted({s for _, s in sets if s}, key=lambda s: (len(s), sorted(s)))
    parent = {s: s for s in every}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s
    for k, a in enumerate(every):
        for b in every[k + 1:]:
            if 100 * len(a) < 80 * len(b):
                break
            if 100 * len(a & b) >= 80 * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for i, s in sets:
        if s and i is not None:
            least[root(s)] = min(least.get(root(s), i), i)
    of = [(i, len(s), least.get(root(s)) if s else i) for i, s in sets]
    return sorted(((i, n, c, i == c) for i, n, c in of), key=repr)


NEAR = ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("table", ["docs", "messy"])
def test_near_copies_equal_every_pair(table, request):
    df = request.getfixturevalue(table)
    want = _near([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert sorted(map(tuple, minmax.near_duplicates(df).select(NEAR).collect()), key=repr) == want
    assert table == "messy" or sum(not r[3] for r in want) > 10


@pytest.mark.parametrize("paired", [2, 32])
def test_large_buckets_lose_no_link(spark, paired):
    """Chains and crowds of near copies in which most pairs are not similar enough, all in the same few buckets."""
    rnd, rows = random.Random(6), []
    vocabulary = [f"w{k}" for k in range(3000)]
    for base in range(3):
        text = [rnd.choice(vocabulary) for _ in range(120)]
        for _ in range(70):
            own = list(text)
            for _ in range(rnd.choice([1, 2, 4, 8, 14])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
            if rnd.random() < 0.3:
                text = own
    rows += [(len(rows) + k, " ".join(rnd.choice(vocabulary) for _ in range(40))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minmax.near_duplicates(df, paired=paired).select(NEAR).collect()), key=repr)
    assert got == _near(rows) and 4 < len({r[2] for r in got}) < 250


def test_near_copies_by_sql_and_of_nothing(docs, duck, nothing):
    _same(minmax.near_duplicates(docs), duck, minmax.oracle_sql())
    assert minmax.near_duplicates(nothing).count() == 0


def test_values_agree_as_often_as_sets_are_similar():
    assert minmax.bands_for(5, 1e-6) == 36 and (1 - 0.8 ** 5) ** 36 <= 1e-6
    rnd = random.Random(8)
    texts = []
    for _ in range(60):
        own = [f"a{rnd.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(own[:180]), " ".join(own[20:])]
    r, h = minmax.shingle_sets(pa.array(texts), 1)
    _, values = minmax.signatures(r, h, 90)
    assert abs((values[::2] == values[1::2]).mean() - 0.8) < 0.02
    bits = minmax._low_bits(values)
    differ = [sum(int(x).bit_count() for x in a ^ b) for a, b in zip(bits[::2], bits[1::2])]
    assert max(differ) <= minmax.most_differing(180, 0.8) < 60


# --- phrases ----------------------------------------------------------------

def _collocations(rows, least, top, longest=3, inside=50):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            f[lang or "und"].update(tuple(w[i:i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        some = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        drop = {q[i:j] for q, c in some.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                if j - i < len(q) and 100 * c >= inside * some[q[i:j]]}
        best = []
        for p, a in some.items():
            if p not in drop:
                score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


COLLOCATIONS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_equal_sql_with_one_and_many_tries(docs, duck):
    want = _same(phrases.collocations(docs), duck, phrases.oracle_sql())
    assert len(want) > 100
    assert sorted(map(tuple, phrases.collocations(docs, trie_phrases=400).select(COLLOCATIONS).collect()), key=repr) == want


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_of_odd_texts(spark, messy, nothing, longest):
    rnd = random.Random(longest)
    rows = [("en" if rnd.random() < 0.8 else None, " ".join(rnd.choice("a b c New York City .\n, x; été".split(" ")) for _ in range(30)))
            for _ in range(40)]
    df = spark.createDataFrame([(k, t, lang, 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, rank int")
    got = phrases.collocations(df, least=4, top=25, longest=longest).select(COLLOCATIONS).collect()
    assert sorted(map(tuple, got)) == _collocations(rows, 4, 25, longest)
    if longest == 3:
        got = phrases.collocations(messy).select(COLLOCATIONS).collect()
        assert sorted(map(tuple, got)) == _collocations([(r["lang"], r["text"]) for r in messy.collect()], 10, 2000)
        assert phrases.collocations(nothing).count() == 0
        assert phrases.collocations(messy.where("doc_id < 4")).count() == 0


def test_documents_are_read_once_for_each_length_whatever_the_number_of_tries(spark, docs):
    """Each trie used to take a pass of its own over all documents, so the passes grew with the phrases."""
    seen = spark.sparkContext.accumulator(0)

    def work(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = docs.select("lang", "text").mapInArrow(work, "lang string, text string")
    got = phrases.collocations(df, trie_phrases=50).count()
    assert got > 100 and seen.value == 3 * docs.count()


def test_small_blocks_and_full_bit_maps_lose_no_phrase(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(rnd.choice(["en", "", None, "a"]), " ".join(rnd.choice("a b c d New York en .\n x; \u00e9t\u00e9".split(" ")) for _ in range(40)))
            for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = _collocations([(lang if lang != "" else "empty", t) for lang, t in rows], 3, 40)
    want = sorted(("" if r[0] == "empty" else r[0], *r[1:]) for r in want)
    for name, value in (("GRAMS", 60), ("BLOCK_GRAMS", 200), ("MARK_BITS", 6), ("TEXT_BYTES", 500)):
        monkeypatch.setattr(phrases, name, value)
    got = phrases.collocations(df, least=3, top=40, trie_phrases=7).select(COLLOCATIONS).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == want


def test_tries_find_all_phrases_and_no_others():
    rnd = random.Random(9)
    paths = list({tuple(f"s{int(rnd.paretovariate(0.7)) % 400}" for _ in range(rnd.randrange(2, 6))) for _ in range(4000)})
    trie = phrases.Trie(pa.array([p[0] for p in paths]), pa.array([list(p[1:]) for p in paths]), np.arange(len(paths)))
    ids = {x: i for i, x in enumerate(trie.names.to_pylist())}
    known = {p: i for i, p in enumerate(paths)}
    for p in paths + [tuple(f"s{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 6))) for _ in range(4000)]:
        state = np.zeros(1, np.int64)
        for x in p:
            state = trie.step(state, np.array([ids.get(x, -1)]))
        found = int(trie.accepts[state[0]]) if state[0] >= 0 else -1
        assert found == known.get(p, -1)


def test_a_bit_map_rules_out_no_similar_pair_and_large_buckets_meet_few_others(spark):
    """Large buckets of sets that are alike but not similar used to be confirmed pair by pair, with all their texts."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]

    def changed(k, tag):
        w = list(base)
        for i in rng.choice(200, k, replace=False):
            w[i] = f"{tag}{i}"
        return " ".join(w)

    texts = [" ".join(base)] + [changed(4, f"near{k}x") for k in range(6)] + [changed(18, f"far{k}x") for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r, h = minmax.shingle_sets(pa.array(texts), 2)
    sets = [set(h[r == i].tolist()) for i in range(len(texts))]
    linked = [(u, v) for v in range(len(texts)) for u in range(v) if 100 * len(sets[u] & sets[v]) >= 80 * len(sets[u] | sets[v])]
    prints = minmax._prints(df.select("doc_id", "text", *minmax._text_hashes(F.col("text"))), 2, 5, 36)
    facts = prints.select(F.col("doc_id").alias("node"), F.col("n").alias("size"), minmax._ones(F.col("map")).alias("held"), "map", "bits")
    x, y = facts.alias("x"), facts.alias("y")
    met = x.join(y, (F.col("x.node") < F.col("y.node")) & minmax._alike("x", "y", 80, 100, 180))
    met = {(u, v) for u, v in met.select("x.node", "y.node").collect()}
    assert linked and set(linked) <= met and len(met) < len(linked) + 0.02 * len(texts) ** 2
    want = [min([i] + [u for u, v in linked if v == i]) if i else 0 for i in range(len(texts))]
    got = {row.doc_id: row.component_id for row in minmax.near_duplicates(df).collect()}
    assert len([i for i in got if got[i] == i]) > 30 and got == {i: want[i] for i in got}
