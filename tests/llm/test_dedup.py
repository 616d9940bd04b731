"""Sharding, exact, line and near deduplication, components."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from inboxlens.llm import exact, graph, lines, queries, sharding, simhash
from tests.conftest import SF001
from tests.llm.conftest import MESSY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF001}/documents.parquet'")
    return con


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# --- sharding ---------------------------------------------------------------

def test_shards_are_equal_gapless_and_shuffled(spark):
    rows = spark.range(10_000).select("id", F.lit(100).alias("bytes"), F.lit(1).alias("slot"))
    out = sharding.shard(rows, 7, F.col("bytes"), bucket_bytes=50_000).collect()
    assert sorted(r["id"] for r in out) == list(range(10_000)) and len({r["bucket"] for r in out}) == 20
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append((r["slot"], r["id"]))
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for own in by.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
        ids = [i for _, i in sorted(own)]
        rising = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
        assert 0.45 < rising < 0.55 and abs(sum(ids) / len(ids) - 5000) < 400
    again = sharding.shard(rows.repartition(5), 7, F.col("bytes"), bucket_bytes=50_000)
    assert sorted(out) == sorted(again.collect())
    other = sharding.shard(rows, 7, F.col("bytes"), bucket_bytes=50_000, seed=43).collect()
    assert sum(a != b for a, b in zip(sorted(out, key=lambda r: r["id"]), sorted(other, key=lambda r: r["id"]))) > 8000


def test_copies_of_one_row_spread_over_buckets(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    out = sharding.shard(rows, 4, F.lit(1000), bucket_bytes=100_000).collect()
    hot = Counter(r["bucket"] for r in out if r["k"] == "hot")
    assert len(out) == 4000 and len(hot) == 40 and max(hot.values()) < 3 * 1334 / 40


def test_sharding_odd_inputs(spark, messy, nothing, tmp_path):
    size = F.octet_length("text")
    out = sharding.shard(messy, 40, size, bucket_bytes=1000)
    assert out.columns == ["shard", "slot", "bucket", *messy.columns]
    assert _rows(out, "doc_id", "row") == _rows(messy, "doc_id", "row")
    assert sharding.shard(nothing, 40, size).count() == 0
    sharding.write_shards(messy, str(tmp_path / "s"), 3, size)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert _rows(back, "doc_id", "text", "row") == _rows(messy, "doc_id", "text", "row")
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [6, 6, 6]


def test_op1_takes_its_digest_from_written_shards(spark, tmp_path, monkeypatch, nothing):
    monkeypatch.setattr(queries, "shared_dir", lambda *a: str(tmp_path / "shards"))
    out = queries.op1_sharding(spark, SF001)
    written = spark.read.parquet(str(tmp_path / "shards"))
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert _rows(written, *docs.columns) == _rows(docs, *docs.columns)     # whole records, texts and all
    want = [(r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"])
            for r in written.collect()]
    assert _rows(out, "doc_id", "size", "text_crc32", "shard", "slot") == sorted(want, key=repr)
    sharding.write_shards(nothing, str(tmp_path / "none"), 40, F.octet_length("text"))
    none = sharding.read_shards(spark, str(tmp_path / "none"), nothing)
    assert none.columns == ["shard", "slot", *nothing.columns] and none.count() == 0


# --- exact ------------------------------------------------------------------

KEYS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def _exact(df, **o):
    return exact.exact_duplicates(df, **o).withColumnRenamed("sha256", "text_sha256")


def test_exact_equals_sql_even_when_identifiers_collide(docs, duck):
    want = sorted(duck.sql(exact.oracle_sql()).select(*KEYS).fetchall(), key=repr)
    assert any(r[2] > 1 for r in want)
    assert _rows(_exact(docs), *KEYS) == want
    assert _rows(_exact(docs, digests=(lambda b: b[:1], *exact.DIGESTS)), *KEYS) == want
    with pytest.raises(ValueError):
        _exact(docs, digests=(lambda b: b"",))


def test_exact_odd_inputs(messy, nothing):
    groups = defaultdict(list)
    for i, t in MESSY:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert _rows(_exact(messy), *KEYS) == sorted(want, key=repr)
    assert _exact(nothing).count() == 0


def test_chunks_cover_texts_and_survive_shifts():
    import numpy as np
    rnd = random.Random(1)
    a = bytes(rnd.randrange(97, 123) for _ in range(60_000))
    texts = [a, b"shifted by this" + a, b"", b"x" * 50_000, b"q"]
    stops = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], stops[:-1]])
    ends = exact.cuts(np.frombuffer(b"".join(texts), np.uint8), starts, stops)
    chunks = []
    for t, s, own in zip(texts, starts.tolist(), ends):
        own = [0, *(e - s for e in own)]
        parts = [t[i:j] for i, j in zip(own, own[1:])]
        assert b"".join(parts) == t and all(len(p) <= exact.MAX_CHUNK for p in parts)
        chunks.append(set(parts))
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 3 > 5


# --- lines ------------------------------------------------------------------

LINE_KEYS = ["doc_id", "text", "removed_chunks", "removed_lines"]


def test_lines_equal_sql(docs, duck):
    want = sorted(duck.sql(lines.oracle_sql()).fetchall(), key=repr)
    assert sum(r[2] for r in want) > 10
    assert _rows(lines.dedup_lines(docs), *LINE_KEYS) == want
    # A filter that is full lets every chunk through and changes nothing.
    assert _rows(lines.dedup_lines(docs, filter_bits=6), *LINE_KEYS) == want


def _surplus(texts, words=8):
    """How many neighbouring pairs of lines, of at least so many words, occur again somewhere, over different texts."""
    seen = Counter()
    for t in set(texts):
        own = t.split("\n")
        seen.update((a, b) for a, b in zip(own, own[1:]) if len(a.split()) + len(b.split()) >= words)
    return sum(n - 1 for n in seen.values())


def test_repeated_pairs_go_and_every_line_stays_somewhere(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in df.dropDuplicates(["text"]).collect()}
    some = df.where(F.col("doc_id").isin(list(before)))
    after = {r["doc_id"]: r["text"] for r in lines.dedup_lines(some).collect()}
    assert _surplus(before.values()) > 50 and _surplus(after.values()) <= 0.1 * _surplus(before.values())
    assert {x for t in before.values() for x in t.split("\n")} == {x for t in after.values() for x in t.split("\n")} | (
        set() if any("" in t.split("\n") for t in after.values()) else {""} & {x for t in before.values() for x in t.split("\n")})


@pytest.mark.parametrize("n", [2, 3, 4])
def test_short_passages_go_whatever_stands_around_them(spark, n):
    rnd = random.Random(10 + n)
    line = lambda words: " ".join(str(rnd.randrange(10**6)) for _ in range(words))
    passages, rows = [[line(5) for _ in range(n)] for _ in range(40)], []
    for _ in range(160):
        body = [line(rnd.randrange(1, 9)) for _ in range(rnd.randrange(0, 4))]
        for p in rnd.sample(passages, 2):
            body += p + [line(rnd.randrange(1, 9)) for _ in range(rnd.randrange(1, 4))]
        rows.append((len(rows), "\n".join(body)))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    after = {r["doc_id"]: r["text"].split("\n") for r in got}
    shared, total = {x for p in passages for x in p}, Counter(x for _, t in rows for x in t.split("\n"))
    left = Counter(x for t in after.values() for x in t)
    assert set(left) == set(total) and all(left[x] == total[x] for x in total if x not in shared)
    assert sum(left[x] - 1 for x in shared) <= 0.1 * sum(total[x] - 1 for x in shared)
    assert _surplus(map("\n".join, after.values())) <= 0.1 * _surplus(t for _, t in rows)


def test_shared_passage_goes_from_all_but_the_first(spark):
    rnd = random.Random(2)
    line = lambda: " ".join(str(rnd.randrange(10**6)) for _ in range(8))
    shared = [line() for _ in range(30)]
    texts = [[line() for _ in range(rnd.randrange(5))] + shared + [line() for _ in range(rnd.randrange(5))] for _ in range(9)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.dedup_lines(df).collect()}
    assert got[0] == texts[0]
    for i in range(1, 9):
        own = [x for x in texts[i] if x not in shared]
        assert [x for x in got[i] if x in set(own)] == own                # nothing of its own is lost
        assert not any(x in shared for x in got[i])


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_long_lines_go_whatever_their_neighbours_are(spark, n):
    rnd = random.Random(n)
    line = lambda words: " ".join(str(rnd.randrange(10**6)) for _ in range(words))
    shared = [line(52) for _ in range(n)]
    texts = [[line(9) for _ in range(rnd.randrange(1, 4))] + shared + [line(9) for _ in range(rnd.randrange(1, 4))] for _ in range(12)]
    df = spark.createDataFrame([(i, "\n".join(t), "en", "s") for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.line_dedup(spark, df, None).collect()}
    assert got[0] == texts[0]
    for i in range(1, 12):
        assert got[i] == [x for x in texts[i] if x not in shared]


def test_rows_of_one_id_keep_their_own_lines(spark):
    rnd = random.Random(4)
    line = lambda: " ".join(str(rnd.randrange(10**6)) for _ in range(60))
    shared, rows = line(), []
    for i, source in ((1, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e")):
        own = [line() for _ in range(3)]
        rows.append((i, "\n".join([*own[:len(rows) % 3], shared, *own[len(rows) % 3:]]), source))
    rows += [(9, rows[0][1], "f")] * 2                                    # two equal rows, copies of the first
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = defaultdict(list)
    for r in lines.dedup_lines(df).collect():
        got[r["source"]].append(r["text"])
    assert got["a"] == [rows[0][1]] and got["f"] == ["", ""]
    for _, text, source in rows[1:5]:
        assert got[source] == ["\n".join(x for x in text.split("\n") if x != shared)]


def test_lines_odd_inputs(spark, messy, nothing):
    out = lines.dedup_lines(messy)
    got = out.collect()
    assert out.columns == [*messy.columns, "removed_chunks", "removed_lines"] and len(got) == len(MESSY)
    for r in got:
        before = MESSY[r["row"]][1]
        assert (r["text"] is None) == (before is None)
        if not r["removed_chunks"]:
            assert r["text"] == before
    many = [f"line number {k * k} with some more words to count {k}" for k in range(60)]
    twice = spark.createDataFrame([(None, "\n".join([*many, "between", *many]))], "doc_id long, text string")
    [r] = lines.dedup_lines(twice).collect()                               # repeats within one text, without an id
    assert r["removed_lines"] == 60 and r["text"].split("\n") == [*many, "between"]
    same = spark.createDataFrame([(1, "x y z w v\n" * 4 + "end")], "doc_id long, text string")
    assert lines.dedup_lines(same).first()["text"] == "x y z w v\n" * 2 + "end"     # the first pair stays
    assert lines.dedup_lines(nothing).count() == 0


# --- near -------------------------------------------------------------------

def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows):
    """rows: (id, fingerprint) -> {fingerprint: smallest id}."""
    parent = {f: f for _, f in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    every = sorted(parent)
    for k, a in enumerate(every):
        for b in every[k + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {f: least.get(root(f)) for f in parent}


@pytest.mark.parametrize("table", ["docs", "messy"])
def test_near_duplicates_equal_every_pair(table, request):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], _fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    want = _components(rows)
    got = simhash.near_duplicates(df)
    assert _rows(got.select("doc_id", F.hex("fp").alias("f"), "component_id"), "doc_id", "f", "component_id") == sorted(
        ((i, f"{f:X}", want[f]) for i, f in rows), key=repr)


@pytest.mark.parametrize("paired", [3, simhash.PAIRED])
def test_links_connect_dense_clusters(spark, paired):
    rnd, fps = random.Random(3), set()
    base = rnd.getrandbits(64)
    for _ in range(300):
        x = base
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    for _ in range(100):
        x = rnd.getrandbits(64)
        fps |= {x, x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in graph.components(simhash.links(df, paired)).collect()}
    want = _components([(x, x) for x in fps])
    parts = defaultdict(set)
    for x in fps:
        parts[found.get(signed(x), signed(x))].add(x)
    wanted = defaultdict(set)
    for x in fps:
        wanted[want[x]].add(x)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, wanted.values()))


def test_near_duplicates_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 200)]
    df = spark.createDataFrame([*path, *star, (7, 7), (300, 300), (101, 100), (None, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 200)}}
    with pytest.raises(RuntimeError):
        graph.components(df, limit=1)


def test_links_that_come_in_parts_give_the_same_components(spark):
    """Merging link tables one by one ends at the components of all of them; a batch without news changes nothing."""
    rnd = random.Random(3)
    batches = [[(rnd.randrange(300), rnd.randrange(300)) for _ in range(60)] for _ in range(3)]
    parts = None
    for batch in [[], *batches, batches[0], [(7, 7)]]:
        parts = graph.merged(parts, spark.createDataFrame(batch, "u long, v long"))
    whole = graph.components(spark.createDataFrame([x for b in batches for x in b], "u long, v long"))
    assert sorted(map(tuple, parts.select("node", "root").collect())) == sorted(map(tuple, whole.collect()))
