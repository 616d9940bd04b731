"""Scoring by a word bigram model in Elias-Fano tries.

The corpus is cut into batches of texts. Words are counted and numbered by Spark; each batch then sends its different
bigrams to shards by a hash of the bigram. A shard adds the counts up, builds its part of the trie (contexts, pointers,
successors as Elias-Fano levels in memory-mapped files, quantised probabilities), looks all bigrams up and answers with
one code each. The batches turn codes into scores. A frequent word or bigram is one row of each batch, never of each text.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_strays, materialize, slices
from .eliasfano import EliasFano

#: Share of the bigram estimate in a score; the rest is the smoothed word frequency.
WEIGHT = 0.5
#: Added to every word's count.
ADDED = 0.1
#: Bytes of text in a batch, tokens whose bigrams a shard holds.
BATCH_BYTES, SHARD_TOKENS = 9 << 20, 2_000_000
#: Quantised log10 probabilities: CODES steps down to LEAST.
CODES, LEAST = 65535, -14.0


def _squeeze(a: np.ndarray) -> bytes:
    """An array as compressed planes of bytes, all lowest bytes first."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def _spread(raw: bytes, kind) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The batch's different words, its tokens as 1 + number of the word (0: end), and where each text's tokens start."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, borders = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    counts = np.concatenate([[0], np.cumsum(real)])[borders]
    words = flat.filter(pa.array(real)).dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    n = np.diff(counts)
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    toks = np.zeros(starts[-1], np.uint32)
    inner = np.ones(len(toks), bool)
    inner[starts[1:] - 1] = False
    toks[inner] = words.indices.to_numpy().astype(np.uint32) + 1
    return words.dictionary, toks, starts


def _batches(batches):
    """(batch id, rows) of at most BATCH_BYTES of text; the id is the same whenever the partition is read."""
    part, k = TaskContext.get().partitionId(), 0
    for whole in batches:
        for b in slices(whole, 1, BATCH_BYTES):
            yield (part << 24) + k, b
            k += 1


def _word_rows(batches):
    """(batch, idx, word, n): how often each word of a batch occurs in training texts; idx 0, the empty word, is the end."""
    for key, b in _batches(batches):
        words, toks, starts = _tokens(b.column(1))
        train = np.repeat(~b.column(2).to_numpy(zero_copy_only=False), np.diff(starts))
        n = np.bincount(toks[train], minlength=len(words) + 1)
        for i in range(0, len(words) + 1, 1 << 16):
            part = words.slice(max(i - 1, 0), (1 << 16) - (i == 0))
            part = pa.concat_arrays([pa.array([""], words.type), part]) if i == 0 else part
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), key)), pa.array(np.arange(i, i + len(part), dtype=np.int32)),
                 part.cast(pa.string()), pa.array(n[i:i + len(part)].astype(np.int64))], names=["batch", "idx", "word", "n"])


def _text_rows(batches):
    """(batch, ids, held, starts, toks): one row for each batch."""
    for key, b in _batches(batches):
        _, toks, starts = _tokens(b.column(1))
        n = len(b)
        lists = lambda a: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key]), lists(b.column(0)), lists(b.column(2)), pa.array([_squeeze(starts.astype(np.uint64))]),
             pa.array([_squeeze(toks)])], names=["batch", "ids", "held", "starts", "toks"])


def _keys(toks: np.ndarray, starts: np.ndarray, gids: np.ndarray) -> np.ndarray:
    """For each token of a batch the bigram that it ends: context number << 32 | word number."""
    out = gids[toks]
    before = np.concatenate([gids[:1], out[:-1]])
    before[starts[:-1]] = gids[0]
    before <<= np.uint64(32)
    out |= before
    return out


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _unpack(row) -> tuple:
    """Tokens, starts, word numbers and counts by local number of a batch's row."""
    toks, starts = _spread(row["toks"], np.uint32), _spread(row["starts"], np.uint64).astype(np.int64)
    places = np.asarray(row["places"], np.int64)
    gids, counts = np.zeros(len(places), np.uint64), np.zeros(len(places))
    idx = places >> 32
    gids[idx], counts[idx] = (places & 0xFFFFFFFF).astype(np.uint64), np.asarray(row["counts"], np.float64)
    return toks, starts, gids, counts


def _context_counts(pairs: np.ndarray, gids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each bigram of a batch how often its context occurs in training texts."""
    by = np.argsort(gids)
    return counts[by[np.searchsorted(gids[by], pairs >> np.uint64(32))]]


class Trie:
    """One shard's bigrams: contexts, pointers and successors, with a quantised probability each."""

    def __init__(self, folder: str, keys: np.ndarray, log_probs: np.ndarray):
        """``keys`` are sorted and different; everything is written to ``folder`` and mapped from there."""
        contexts, first = np.unique(keys >> np.uint64(32), return_index=True)
        succ = keys & np.uint64(0xFFFFFFFF)
        self.span = np.uint64(int(succ.max()) + 1 if len(succ) else 1)
        # Successors are numbered relative to their context, which makes one rising sequence of them.
        own = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(np.append(first, len(keys))))
        EliasFano.save(EliasFano.build(contexts, int(contexts[-1]) + 1 if len(contexts) else 1), folder, "contexts")
        EliasFano.save(EliasFano.build(np.append(first, len(keys)).astype(np.uint64), len(keys) + 1), folder, "pointers")
        EliasFano.save(EliasFano.build(own * self.span + succ, len(contexts) * int(self.span) + 1), folder, "successors")
        codes = np.clip(np.round(log_probs / LEAST * CODES), 0, CODES).astype(np.uint16)
        np.save(os.path.join(folder, "codes.npy"), codes)
        self.contexts, self.pointers, self.successors = (
            EliasFano.mapped(folder, x) for x in ("contexts", "pointers", "successors"))
        self.codes, self.n = np.load(os.path.join(folder, "codes.npy"), mmap_mode="r"), len(contexts)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """1 + the code of each sorted key, 0 where the trie lacks it."""
        out = np.zeros(len(keys), np.uint32)
        if not self.n or not len(keys):
            return out
        context, back = np.unique(keys >> np.uint64(32), return_inverse=True)
        inside = context < np.uint64(int(self.contexts.access(np.array([self.n - 1]))[0]) + 1)
        at = np.zeros(len(context), np.int64)
        at[inside] = self.contexts.find(context[inside])
        known = inside & (self.contexts.access(np.minimum(at, self.n - 1)) == context)
        low = self.pointers.access(np.minimum(at, self.n - 1)).astype(np.int64)
        high = self.pointers.access(np.minimum(at, self.n - 1) + 1).astype(np.int64)
        succ = keys & np.uint64(0xFFFFFFFF)
        ask = np.flatnonzero(known[back] & (succ < self.span))
        of = back[ask]
        want = at[of].astype(np.uint64) * self.span + succ[ask]
        found = self.successors.find(want, low[of], high[of])
        hit = (found < high[of]) & (self.successors.access(np.minimum(found, self.successors.n - 1)) == want)
        out[ask[hit]] = self.codes[found[hit]].astype(np.uint32) + 1
        return out


def _count_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Add the bigrams of one shard up, build its trie and answer every batch with the codes of its bigrams."""
    keys = [_spread(x, np.uint64).cumsum(dtype=np.uint64) for x in rows["pairs"]]
    ns = [_spread(x, np.uint32) for x in rows["n"]]
    totals = [_spread(x, np.float32) for x in rows["total"]]
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(back, weights=np.concatenate(ns), minlength=len(every))
    total = np.zeros(len(every), np.float32)
    total[back] = np.concatenate(totals)
    seen = count > 0
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(folder, every[seen], np.log10(WEIGHT * count[seen] / total[seen]))
        codes = trie.look_up(every)
        del trie
    borders = np.cumsum([0, *(len(k) for k in keys)])
    out = [(b, s, _squeeze(codes[back[i:j]])) for b, s, i, j in zip(
        rows["batch"], rows["shard"], borders[:-1].tolist(), borders[1:].tolist())]
    return pd.DataFrame(out, columns=["batch", "shard", "codes"])


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row for each row of ``docs``.

    The model learns from the rows where ``held_out`` is not true. A-Z count as lower case; tokens are the words between
    white space and one end for each text, which also is the context of the first word. base_score adds up
    log10((c + 0.1) / (N + 0.1 (V + 1))); score adds up log10(0.5 c(before, token) / c(before) + 0.5 base), or base where
    the token before was never seen; the bigram part is quantised to 16 bits. Null and empty texts are one end. Without
    training rows all counts are 0; an empty table gives no rows; repeated rows are scored, and learnt, each time. More
    than 2**32 different words are an error.
    """
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.withColumn("__held", held)
    rows = drop_strays(rows, id_col, text_col, "__held").toDF("doc_id", "text", "held")
    word_rows = rows.mapInArrow(_word_rows, "batch long, idx int, word string, n long")
    vocabulary = materialize(word_rows.groupBy("word").agg(F.sum("n").alias("c")).withColumn(
        "m", F.monotonically_increasing_id()), "vocabulary")
    # Words get consecutive numbers: their place in a written part, after all parts before it.
    sizes = vocabulary.groupBy(F.shiftright("m", 33).alias("part")).agg((F.max("m") - F.shiftleft(
        F.shiftright(F.max("m"), 33), 33) + 1).alias("size"))
    sizes = sizes.withColumn("first", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0)))
    numbered = vocabulary.withColumn("part", F.shiftright("m", 33)).join(sizes, "part").select(
        "word", "c", (F.col("first") + F.col("m") - F.shiftleft("part", 33)).alias("gid"))
    stats = vocabulary.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"),
                           F.count(F.lit(1)).alias("words")).first()
    if stats["words"] >= 1 << 32:
        raise ValueError("too many different words for 32-bit numbers")
    n, v = stats["n"] or 0, stats["v"]
    shards = max(1, round(n / SHARD_TOKENS))
    # Local and global number in one value; both lists are filled row by row, so they have the same order.
    place = F.shiftleft(F.col("idx").cast("long"), 32).bitwiseOR(F.col("gid"))
    own = word_rows.select("batch", "idx", "word").join(numbered, "word").groupBy("batch").agg(
        F.collect_list(place).alias("places"), F.collect_list("c").alias("counts"))
    ids = T.ArrayType(rows.schema["doc_id"].dataType)
    texts = rows.mapInArrow(_text_rows, T.StructType([
        T.StructField("batch", T.LongType()), T.StructField("ids", ids), T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("starts", T.BinaryType()), T.StructField("toks", T.BinaryType())]))
    ready = texts.join(own, "batch")

    def send(batches):
        for b in batches:
            for row in _rows(b):
                toks, starts, gids, counts = _unpack(row)
                keys = _keys(toks, starts, gids)
                pairs = np.unique(keys)
                learnt, n_learnt = np.unique(keys[np.repeat(~np.asarray(row["held"], bool), np.diff(starts))],
                                             return_counts=True)
                del keys, toks
                seen = np.zeros(len(pairs), np.uint32)
                seen[np.searchsorted(pairs, learnt)] = n_learnt
                total = _context_counts(pairs, gids, counts).astype(np.float32)
                where = _shard_of(pairs, shards)
                by = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[by], np.arange(shards + 1))
                for s in range(shards):
                    mine = by[cuts[s]:cuts[s + 1]]
                    if len(mine):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([s], pa.int32()), pa.array([row["batch"]]),
                             pa.array([_squeeze(np.diff(pairs[mine], prepend=np.uint64(0)))]), pa.array([_squeeze(seen[mine])]),
                             pa.array([_squeeze(total[mine])])], names=["shard", "batch", "pairs", "n", "total"])

    # Both readers take all columns of `ready`, so that its shuffles are written once and used twice.
    sent = ready.mapInArrow(
        send, "shard int, batch long, pairs binary, n binary, total binary")
    answers = sent.groupBy("shard").applyInPandas(_count_shard, "batch long, shard int, codes binary")
    answers = answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "codes")).alias("answers"))
    whole = ready.join(answers, "batch")
    made = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()),
                         *[T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")],
                         *[T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]])

    def finish(batches):
        for b in batches:
            for i, row in enumerate(_rows(b)):
                toks, starts, gids, counts = _unpack(row)
                keys = _keys(toks, starts, gids)
                pairs = np.unique(keys)
                of = np.searchsorted(pairs, keys).astype(np.uint32)
                del keys
                where = _shard_of(pairs, shards)
                by = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[by], np.arange(shards + 1))
                codes = np.zeros(len(pairs), np.uint32)
                for a in row["answers"]:
                    codes[by[cuts[a["shard"]]:cuts[a["shard"] + 1]]] = _spread(a["codes"], np.uint32)
                part = np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 1) / CODES * LEAST), 0.0)
                base = (counts[toks] + ADDED) / (n + ADDED * (v + 1))
                seen_before = (_context_counts(pairs, gids, counts) > 0)[of]
                prob = np.where(seen_before, part[of] + (1 - WEIGHT) * base, base)
                add = lambda x: np.add.reduceat(x, starts[:-1])
                size = np.diff(starts)
                docs_of = b.column("ids")[i].values
                held_of = b.column("held")[i].values
                yield pa.RecordBatch.from_arrays(
                    [docs_of, held_of, pa.array(size), pa.array(add((counts[toks] > 0).astype(np.int64))),
                     pa.array(np.full(len(size), n)), pa.array(add(np.log10(base))), pa.array(add(np.log10(prob)))],
                    names=made.names)

    return whole.mapInArrow(finish, made)


def _rows(b: pa.RecordBatch):
    """The rows of a record batch, one at a time; lists of numbers as arrays."""
    for i in range(len(b)):
        yield {name: x.values.to_numpy(zero_copy_only=False) if pa.types.is_list(x.type) and not pa.types.is_struct(
            x.type.value_type) else x.as_py() for name, x in zip(b.schema.names, (b.column(k)[i] for k in range(b.num_columns)))}
