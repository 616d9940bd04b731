"""Language model, Elias-Fano sequences, SentencePiece, and the pipeline."""

import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from inboxlens.llm import eliasfano, langid, lm, pieces
from inboxlens.llm.common import doc_bucket
from tests.conftest import SF001
from tests.llm.conftest import MESSY


@pytest.mark.parametrize("universe", [1, 50, 3000, 1 << 40])
def test_elias_fano(universe, tmp_path):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 3000):
        values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        eliasfano.EliasFano.save(eliasfano.EliasFano.build(values, universe), str(tmp_path), "x")
        ef = eliasfano.EliasFano.mapped(str(tmp_path), "x")
        if n:
            assert (ef.access(np.arange(n)) == values).all()
        ask = rng.integers(0, universe, 500, dtype=np.uint64)
        assert (ef.find(ask) == np.searchsorted(values, ask)).all()


def _brute(rows):
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None] for _, t, _ in rows]
    uni, bi = Counter(), Counter()
    for (_, _, held), t in zip(rows, toks):
        if not held:
            uni.update(t)
            bi.update(zip([None, *t], t))
    n, v, out = sum(uni.values()), len(uni), []
    for (i, _, held), t in zip(rows, toks):
        base = total = 0.0
        for before, w in zip([None, *t], t):
            p = (uni[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            total += math.log10(0.5 * bi[before, w] / uni[before] + 0.5 * p if uni[before] else p)
        out.append((i, held, len(t), sum(uni[w] > 0 for w in t), n, base, total))
    return sorted(out, key=lambda r: (r[2], r[5], repr(r[0])))


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_counting(docs, messy, small, monkeypatch):
    if small:                                             # many batches and shards
        monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
        monkeypatch.setattr(lm, "BATCH_BYTES", 60_000)
    df = docs.select("doc_id", "text").union(messy.select(F.col("doc_id") + 1000, "text"))
    held = doc_bucket(F.col("doc_id"), 10) == 0
    want = _brute([tuple(r) for r in df.select("doc_id", "text", held).collect()])
    got = sorted(map(tuple, lm.score(df, held).collect()), key=lambda r: (r[2], round(r[5], 6), repr(r[0])))
    want = sorted(want, key=lambda r: (r[2], round(r[5], 6), repr(r[0])))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= w[2] * 1.2e-4              # a step of the quantised part


def test_scoring_without_training_or_rows(messy, nothing):
    rows = lm.score(messy, F.lit(True)).collect()
    assert len(rows) == len(MESSY) and all(r["n_known"] == r["train_tokens"] == 0 and r["score"] == 0 for r in rows)
    assert lm.score(nothing, F.lit(False)).count() == 0
    assert {r["held_out"] for r in lm.score(messy, F.lit(None).cast("boolean")).collect()} == {False}


ODD = ["Hello  world\n x", "  a", " ", "", "a▁b", "日本語 ½ \x00 é é ﬁ", "a\t\tb \r\n", "a" * 500, "=" * 99 + "-" * 77,
       " " * 47 + "x" + " " * 15, "<s> </s> <unk> <0x0A>", "🤗🤗 \U0010ffff", "internationalization characteristically"]


def test_ids_equal_the_library(pdocs):
    rnd = random.Random(4)
    letters = "abcdeinorst  \n.,-=éüß▁日本ЖдA0"
    texts = [*ODD, *("".join(rnd.choice(letters) for _ in range(rnd.randrange(200))) for _ in range(800)), *pdocs.text]
    m = pieces.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    encoder = pieces.Encoder(m)
    for part in (texts[:20], texts[20:], texts):              # new, mixed, and remembered segments
        ids, at = encoder.encode(part)
        for t, i, j in zip(part, at[:-1], at[1:]):
            own = ids[i:j].tolist()
            assert own == sp.encode(t), t[:80]
            assert pieces.decode(own, m) == t.replace("▁", " ")


def test_pieces_side_by_side_are_what_merging_leaves():
    m = pieces.load()
    rank = {x: r for r, x in enumerate(m.pieces)}
    rnd = random.Random(6)
    some = [r for r in rnd.sample(range(len(m.pieces)), 400)]
    for a, b in zip(some, some[1:] + some[:1]):
        if m.pieces[b][0] != pieces.SPACE:
            assert pieces.side_by_side(m, a, b) == (pieces.merge(m.pieces[a] + m.pieces[b], rank) == [m.pieces[a], m.pieces[b]])


def test_encoding_tables(spark, messy, nothing):
    out = pieces.encode_documents(messy)
    assert out.columns == [*messy.columns, "token_ids", "n_tokens", "round_trip"]
    back = pieces.decode_documents(out)
    assert back.count() == len(MESSY) and back.where("coalesce(text, '') != decoded or not round_trip").count() == 0
    assert out.where("n_tokens != size(token_ids)").count() == 0
    assert pieces.encode_documents(nothing).count() == 0
    marked = pieces.encode_documents(spark.createDataFrame([("a▁b",), (None,)], "text string")).collect()
    assert sorted(r["round_trip"] for r in marked) == [False, True]


def test_encoder_remembers_a_bounded_number_of_characters():
    m = pieces.load()
    encoder = pieces.Encoder(m)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rnd = random.Random(8)
    for _ in range(12):                                 # segments without spaces, all different
        texts = ["".join(rnd.choice("theoryand") for _ in range(5000)) for _ in range(100)]
        ids, at = encoder.encode(texts)
        assert ids[:at[1]].tolist() == sp.encode(texts[0]) and ids[at[-2]:].tolist() == sp.encode(texts[-1])
        held = sum(map(len, encoder.known))
        assert held <= (4 << 20) + 600_000, held


def test_encoding_takes_few_steps_of_python():
    """Parts are relaxed together: not several lines of Python for every edge, of which a character has two or more."""
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(1, 15))) for _ in range(4000))]
    encoder = pieces.Encoder(pieces.load())
    encoder.encode(texts)                                # answers about pairs are learnt, segments forgotten
    encoder.forget()
    lines = Counter()

    def trace(frame, event, _):
        if frame.f_code.co_filename != pieces.__file__:
            return None
        lines[event] += 1
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        ids, _ = encoder.encode(texts)
    finally:
        sys.settrace(before)
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH).encode(texts[0])
    assert lines["line"] < 2 * len(texts[0]), lines


@pytest.mark.parametrize("least", [1, 3, 10**9])
def test_edges_relaxed_together_or_one_by_one(least, monkeypatch):
    monkeypatch.setattr(pieces, "LEAST", least)
    rnd = random.Random(10)
    alphabets = ["theoryandsing", "ACGT", "日本語½ﬁ🤗é x", "   \n\t\0ab", "▁ a", "(){}=; ifreturn\r\n"]
    texts = [*ODD, *("".join(rnd.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 7, 60, 900) for _ in range(5))]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    encoder = pieces.Encoder(pieces.load())
    for batch in (texts, texts[:9], ["", ""], [texts[-1]], [" " * 30, "é" * 9]):
        ids, at = encoder.encode(batch)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [sp.encode(t) for t in batch]


def test_suffix_search_finds_every_occurrence():
    m = pieces.load()
    encoder = pieces.Encoder(m)
    text = "▁the▁theory▁of▁there\0thethe"
    starts, ends, ranks = encoder._edges(encoder.code[[ord(c) for c in text]])
    got = sorted(zip(starts.tolist(), ends.tolist(), ranks.tolist()))
    want = sorted((i, i + len(x), r) for r, x in enumerate(m.pieces) for i in range(len(text)) if text.startswith(x, i))
    assert got == want


def test_pipeline_stages_keep_columns_and_clean_rows(spark, docs):
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF001)
        assert after.columns == columns
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        left.append(after.count())
        before = after
    assert left[0] >= 0.9 * docs.count() and left[1] == left[0] and left[2] < left[1] and left[3] < left[2]
    assert left[3] >= 0.75 * docs.count()
    out = corpus_pipeline.run(spark, SF001)
    assert out.count() == left[3] and out.where("not round_trip or n_tokens != size(token_ids)").count() == 0
    want = {r["doc_id"]: r["text"] for r in before.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    assert {r["doc_id"]: r["token_ids"] for r in out.collect()} == {i: sp.encode(t) for i, t in want.items()}


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "en", str(k)) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string").repartition(3)


def test_decontamination_keeps_clean_rows_of_a_dirty_id(spark):
    item = max((r["text"] for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()), key=len)
    rows = [(None, f"before it {item}"), (None, "a clean text"), (5, "another clean text"), (5, item), (6, None), (None, None)]
    left = corpus_pipeline.decontamination(spark, _table(spark, rows), SF001)
    assert left.columns == ["doc_id", "text", "lang", "source"]
    assert sorted(r["source"] for r in left.collect()) == ["1", "2", "4", "5"]


def test_near_dedup_leaves_one_row_of_each_group(spark):
    rnd = random.Random(6)
    a, b, c, d = (" ".join(str(rnd.randrange(10**6)) for _ in range(300)) for _ in range(4))
    rows = [(None, a), (None, a.replace(" ", "  ")), (3, b), (3, c), (2, b), (8, d), (8, d), (None, d)]
    left = [(r["doc_id"], " ".join(r["text"].split())) for r in corpus_pipeline.near_dedup(spark, _table(spark, rows), SF001).collect()]
    assert sorted(left, key=repr) == sorted([(None, a), (2, b), (3, c), (8, d)], key=repr)


CLASHES = ["score", "lang_pred", "rejected", "removed_chunks", "removed_lines", "n_chunks", "quoting", "key", "row", "place", "found", "often"]


def test_stages_pass_clashing_columns_through(spark):
    """Input columns called like what the operators add keep their values."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns, name
        rows = out.select("doc_id", *CLASHES).collect()
        assert len(rows) > 100 and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHES), name


def test_pipeline_on_odd_and_empty_tables(spark, messy, nothing):
    for table in (messy, nothing):
        rows = table
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")), SF001)
        assert rows.count() <= table.count()
    assert langid.train(nothing) == {}
