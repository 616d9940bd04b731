"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage with block-max WAND.

Passages are overlapping windows of words, wide enough that a quoted item lies whole in one of them. An item's threshold
follows from its own terms: no passage that passes the final check can score less. Question and answer of what is
retrieved are then compared with the passage by their word shingles.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_strays, slices

SHINGLE_WORDS, MIN_OVERLAP = 5, 0.8
K1, B = 1.2, 0.75
#: Postings in a block of the index; bytes of test items in one index (more items make more indexes, one after another).
BLOCK, INDEX_BYTES = 32, 4 << 20
#: Bytes of text searched at a time, and postings of rare terms added up at a time: bounds on memory only.
TEXT_BYTES, POSTINGS = 1 << 20, 1 << 18
#: A score counts as reached from here, in thresholds. Common terms of an item may hold this share of its threshold.
_REACHED, _COMMON = 1 - 1e-9, 0.4


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, space-joined; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def shingles(tokens: list, n: int = SHINGLE_WORDS) -> set[tuple]:
    """Word shingles; fewer words are one shingle, no words none."""
    if len(tokens) <= n:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)}


def contained(part: set, whole: set) -> float:
    """Share of ``part`` that is in ``whole``; nothing is contained in full."""
    return len(part & whole) / len(part) if part else 1.0


@dataclass
class Item:
    """A test item: its last sentence counts as the answer, what stands before as the question."""

    item_id: object
    question: list
    answer: list
    weights: dict = field(default_factory=dict)
    threshold: float = 0.0


@dataclass
class Index:
    """BM25 postings by term: sorted item numbers, weights in thresholds of their items, the largest, that of each block."""

    items: list
    terms: dict
    postings: list
    width: int
    #: Items without a threshold (their words repeat so much that shingles may go with every word), by each term.
    direct: dict = field(default_factory=dict)

    @staticmethod
    def build(items: list[Item], df: dict, n: int, average: float) -> Index:
        lists: dict[str, list] = {}
        for k, x in enumerate(items):
            tokens = x.question + x.answer
            norm = K1 * (1 - B + B * len(tokens) / max(average, 1e-9))
            for t in set(tokens):
                tf = tokens.count(t)
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                x.weights[t] = idf * tf * (K1 + 1) / (tf + norm)
                lists.setdefault(t, []).append((k, x.weights[t]))
            x.threshold = _threshold(x)
        bounded = [x.threshold > 0 for x in items]
        terms = {t: i for i, t in enumerate(lists)}
        postings = []
        for t in terms:
            own = [k for k, _ in lists[t] if bounded[k]], [w / items[k].threshold for k, w in lists[t] if bounded[k]]
            postings.append((*own, max(own[1], default=0.0), [max(own[1][i:i + BLOCK]) for i in range(0, len(own[1]), BLOCK)]))
        for x in items:
            x.weights = {terms[t]: w / (x.threshold or 1.0) for t, w in x.weights.items()}
        direct: dict[int, list] = {}
        for k, x in enumerate(items):
            for t in x.weights if not bounded[k] else ():
                direct.setdefault(t, []).append(k)
        return Index(items, terms, postings, max([64, *(2 * len(x.question + x.answer) for x in items)]), direct)

    @cached_property
    def rare(self):
        return index_rare(self)

    @cached_property
    def vocabulary(self) -> pa.Array:
        return pa.array(list(self.terms))

    def unbounded(self, query: set[int]) -> list[tuple[int, float]]:
        """Items without a threshold that share a term with a passage of these terms, with their scores."""
        found = sorted({k for t in query for k in self.direct.get(t, ())}) if self.direct else []
        return [(k, sum(w for t, w in self.items[k].weights.items() if t in query)) for k in found]

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """All items (number and score) that a passage of these terms scores at their threshold or above."""
        cursors = [[0, *self.postings[t]] for t in query]  # place, items, weights, largest weight, that of each block
        found = []
        while True:
            cursors = sorted((c for c in cursors if c[0] < len(c[1])), key=lambda c: c[1][c[0]])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[3]
                if total >= _REACHED:
                    pivot = c[1][c[0]]
                    break
            if pivot is None:
                return found
            upto = []
            for c in cursors:
                if c[1][c[0]] > pivot:
                    break
                c[0] = bisect_left(c[1], pivot, c[0])
                if c[0] < len(c[1]):
                    upto.append(c)
            if sum(c[4][c[0] // BLOCK] for c in upto) >= _REACHED:
                score = sum(c[2][c[0]] for c in upto if c[1][c[0]] == pivot)
                if score >= _REACHED:
                    found.append((pivot, score * self.items[pivot].threshold))
            for c in upto:
                if c[1][c[0]] == pivot:
                    c[0] += 1


def _threshold(x: Item) -> float:
    """The least score of a passage that holds MIN_OVERLAP of the shingles of question and answer.

    Every word outside all shared shingles belongs to a missed shingle of its own, so at most as many words are absent
    as shingles may be missed. A word's weight is lost only with its last occurrence.
    """
    missed = 0
    for part in (x.question, x.answer):
        have = max(len(part) - SHINGLE_WORDS + 1, 1 if part else 0)
        missed += math.floor((1 - MIN_OVERLAP) * have + 1e-9) + max(0, have - len(shingles(part)))
    return sum(sorted(x.weights.values(), reverse=True)[missed:])


def split_item(item_id, text: str) -> Item | None:
    """Question and answer of an item's text, cut as ``sentences`` does; an item without words is None."""
    plain = lambda s: "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in s.lower()).split()
    return make_item(item_id, [plain(s) for s in re.split(r"(?<=[.!?])\s+", text or "")])


def sentences(text: Column) -> Column:
    """The words of each sentence (see ``words``); a sentence ends at white space after a full stop, ! or ?."""
    cut = F.split(text, r"(?<=[.!?])[\s\x1c-\x1f\x{85}\p{Z}]+", -1)
    return F.filter(F.transform(cut, words), lambda s: s != "")


def make_item(item_id, sentences: list[list]) -> Item | None:
    sentences = [w for w in sentences if w]
    if not sentences:
        return None
    if len(sentences) == 1:
        return Item(item_id, sentences[0], [])
    return Item(item_id, [w for s in sentences[:-1] for w in s], sentences[-1])


def _candidates(tids: np.ndarray, cells: np.ndarray, index: Index) -> np.ndarray:
    """Windows (numbers of their first cell) in which some item's rare terms alone leave its threshold in reach.

    Of each item the terms are split: the common ones together hold a part of the threshold at most, so the others must
    make up for the rest.
    """
    (offsets, items, weights), need = index.rare
    near = np.empty(0, np.int64)
    if index.direct:
        near = cells[np.isin(tids, np.array(list(index.direct)))]
        near = np.unique(np.concatenate([near, near - 1]))
    keep = np.flatnonzero(tids >= 0)
    t, c = tids[keep], cells[keep]
    count = offsets[t + 1] - offsets[t]
    t, c, count = t[count > 0], c[count > 0], count[count > 0]
    if not len(t):
        return near
    # A window has the terms of its cell and the next. Ranges of windows [lo, hi) are added up one after another.
    parts = (np.cumsum(count) - 1) // POSTINGS
    cuts = np.unique(c[np.flatnonzero(parts[1:] != parts[:-1]) + 1])
    found = [near]
    for lo, hi in zip([c[0] - 1, *cuts.tolist()], [*cuts.tolist(), c[-1] + 1]):
        own = slice(np.searchsorted(c, lo), np.searchsorted(c, hi, side="right"))
        t_, c_, n = t[own], c[own], count[own]
        pos = np.repeat(offsets[t_] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        cell, item, w, term = np.repeat(c_, n), items[pos], weights[pos], np.repeat(t_, n)
        this, last = cell < hi, cell > lo
        cell = np.concatenate([cell[this], cell[last] - 1])
        item, w, term = (np.concatenate([x[this], x[last]]) for x in (item, w, term))
        if not len(cell):
            continue
        key = (cell + 1) * len(index.items) + item
        order = np.lexsort((term, key))
        key, w, term = key[order], w[order], term[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (term[1:] != term[:-1])])
        key, w = key[new], w[new]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(w, heads)
        ok = total >= need[key[heads] % len(index.items)] - 1e-9
        found.append(key[heads][ok] // len(index.items) - 1)
    return np.unique(np.concatenate(found))


def index_rare(index: Index):
    """Postings of each item's rare terms (offsets by term, items, weights) and what they must add up to by item."""
    by_term: list[list] = [[] for _ in index.terms]
    need = np.ones(len(index.items))
    for k, x in enumerate(index.items):
        if x.threshold <= 0:
            continue
        common = 0.0
        for t, w in sorted(x.weights.items(), key=lambda tw: tw[1]):
            if common + w <= _COMMON:
                common += w
            else:
                by_term[t].append((k, w))
        need[k] -= common
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in by_term])]).astype(np.int64)
    flat = [y for x in by_term for y in x]
    return (offsets, np.array([k for k, _ in flat], np.int64), np.array([w for _, w in flat])), need


def passages(texts: pa.Array, index: Index) -> list[list[tuple]]:
    """For each prepared text (see ``words``) its verified items: (item, first word, score, question, answer)."""
    lists = pc.split_pattern(texts, " ")
    flat, starts = lists.flatten(), lists.offsets.to_numpy()
    starts = starts - starts[0]
    tids = pc.fill_null(pc.index_in(flat, value_set=index.vocabulary), -1).to_numpy()
    counts = np.diff(starts)
    own = np.arange(len(flat)) - np.repeat(starts[:-1], counts)
    # A cell is half a window; each text has one cell more than it needs, so that windows don't run into the next.
    cells_of = counts // index.width + 2
    first = np.concatenate([[0], np.cumsum(cells_of)])
    cells = np.repeat(first[:-1], counts) + own // index.width
    found: list[list[tuple]] = [[] for _ in range(len(texts))]
    for window in _candidates(tids, cells, index).tolist():
        doc = int(np.searchsorted(first, max(window, 0), side="right")) - 1
        local = max(window - int(first[doc]), 0)
        a = int(starts[doc]) + local * index.width
        b = min(a + 2 * index.width, int(starts[doc + 1]))
        if a >= b:
            continue
        query = {t for t in tids[a:b].tolist() if t >= 0}
        got = index.search(sorted(query)) + index.unbounded(query)
        if got:
            have = shingle_sets(flat.slice(a, b - a).to_pylist(), {min(len(p), SHINGLE_WORDS) for k, _ in got for p in (
                index.items[k].question, index.items[k].answer) if p})
        for k, score in got:
            x = index.items[k]
            q, r = (contained(shingles(p), have.get(min(len(p), SHINGLE_WORDS), set())) for p in (x.question, x.answer))
            if q >= MIN_OVERLAP and r >= MIN_OVERLAP:
                found[doc].append((k, a - int(starts[doc]), score, q, r))
    return found


def shingle_sets(tokens: list, sizes: set) -> dict[int, set]:
    return {n: {tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)} for n in sizes}


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, index_bytes: int = INDEX_BYTES):
    """The test items as indexes of at most ``index_bytes`` of text each (one item at least), one at a time.

    Weights use the counts of all items. Items with equal text are searched like any other; items without words can't
    be found. No items give no index.
    """
    rows = drop_strays(items, id_col, text_col).toDF("item_id", "text").where(F.col("text").isNotNull())
    rows = rows.withColumn("bytes", F.octet_length("text"))
    parts = math.ceil((rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0) / index_bytes)
    if not parts:
        return
    # Cut like the documents, in Spark: both sides then have the same words whatever the script.
    rows = rows.withColumn("sentences", sentences(F.col("text")))
    rows = rows.withColumn("w", F.split(F.array_join("sentences", " "), " "))
    tokens = rows.select("w")
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("average")).first()
    df = tokens.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").count()
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        own = [make_item(x["item_id"], [s.split(" ") for s in x["sentences"]])
               for x in rows.where(part == k).orderBy("item_id", "text").collect()]
        own = [x for x in own if x]
        here = rows.where(part == k).select(F.explode(F.array_distinct("w")).alias("term"))
        known = {x["term"]: x["count"] for x in df.join(here.distinct(), "term", "left_semi").collect()}
        if own:
            yield Index.build(own, {t: known[t] for x in own for t in x.question + x.answer}, stats["n"],
                              stats["average"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", *, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``(doc_id, item_id, first_word, score, question_overlap, answer_overlap)`` for each item a document quotes.

    A passage quotes an item if it holds at least MIN_OVERLAP of the five-word shingles of its question and of its
    answer (the last sentence; an item of one sentence is all question). One row for each pair, from the passage with
    the largest overlap, then the first. Case, punctuation and white space don't count. Every text is searched whole;
    null, empty and short texts quote nothing, or items as short. Repeated rows give repeated results; no items or no
    documents give no rows.
    """
    rows = drop_strays(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.select("doc_id", words(F.col("text")).alias("text"))
    item_type = items.schema[item_id_col].dataType
    made = T.StructType([rows.schema["doc_id"], T.StructField("item_id", item_type), T.StructField("first_word", T.LongType()),
                         *[T.StructField(x, T.DoubleType()) for x in ("score", "question_overlap", "answer_overlap")]])
    # Without items, an empty table that Spark makes by itself: no Python workers only for its rows.
    out = docs.sparkSession.range(0).limit(0).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in made])
    for index in indexes(items, item_id_col, index_bytes=index_bytes):
        out = out.unionByName(rows.mapInArrow(_searcher(index, made), made))
    return out


def _searcher(index: Index, made: T.StructType):
    def work(batches):
        for whole in batches:
            for b in slices(whole, 1, TEXT_BYTES):
                rows = []
                for doc, found in enumerate(passages(b.column(1), index)):
                    best: dict = {}
                    for k, first, score, q, r in found:
                        best[k] = max(best.get(k, (-1,)), (q + r, -first, score, q, r))
                    rows += [(doc, index.items[k].item_id, -x[1], *x[2:]) for k, x in sorted(best.items())]
                ids = b.column(0).take(pa.array([x[0] for x in rows], pa.int64()))
                cols = [pa.array([x[i] for x in rows]) for i in range(1, 6)] if rows else [pa.nulls(0)] * 5
                kinds = [*([pa.int64()] if not rows else [cols[0].type]), pa.int64(), *[pa.float64()] * 3]
                yield pa.RecordBatch.from_arrays([ids, *[c.cast(t) for c, t in zip(cols, kinds)]], names=made.names)
    return work
