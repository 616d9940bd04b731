"""Phrase collocations, mined level by level with double-array tries.

A phrase can be frequent only if all phrases inside it are (Apriori). So for each length one pass over the documents sends
the n-grams at places where two frequent phrases of a word less overlap; a bit map of fixed size tells them, which leaves out
none. N-grams are dealt to blocks by their hashes. In a block, the candidates are those whose supports, added up under hashes,
suffice, which never gives too little; they stand in double-array tries of a bounded size: numpy moves the states of all
n-grams on together, word by word, and counts the accepting states. So a trie meets the n-grams of its block only, and the
passes do not grow with the number of phrases.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_strays, marked, materialize, slices
from .words import Words, cut, word_hashes

LONGEST, LEAST, TOP, INSIDE_PERCENT = 3, 10, 2000, 50
#: Phrases of one trie at most, or somewhat more.
TRIE_PHRASES = 1 << 20
#: Words of the n-grams that a task adds up before it sends them, and places of phrases for each block.
GRAMS, BLOCK_GRAMS = 1 << 21, 1 << 21
#: Bits of the map of frequent phrases that is broadcast: 16 MB at most. A full map only drops fewer n-grams.
MARK_BITS = 27
#: Bytes of text that a worker cuts at a time; each word takes some hundred bytes meanwhile.
TEXT_BYTES = 2 << 20
GAPS, BREAKS = b" \t", b".,;:!?\n\v\f\r"
UNDETERMINED = "und"
SCALE = 1_000_000


class Trie:
    """A double array: the child of state s by symbol x is base[s] + x if check names s as its parent.

    Symbols number the labels in ``names`` (a language, then words); ``accepts`` gives the phrase of a state or -1.
    """

    def __init__(self, langs: pa.Array, words: pa.ListArray, numbers: np.ndarray):
        """Phrases are different; each is a language and one word or more, and has a number."""
        many, flat = pc.list_value_length(words).to_numpy(), words.flatten()
        coded = pa.concat_arrays([langs.cast(pa.large_string()), flat.cast(pa.large_string())]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.names = coded.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[coded.indices.to_numpy()]
        paths = np.full((len(many), int(many.max(initial=0)) + 1), -1, np.int64)
        paths[:, 0] = codes[:len(many)]
        own = np.repeat(np.arange(len(many)), many)
        paths[own, np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + 1] = codes[len(many):]
        size = len(order) + 1
        self._room(size + 2 * int((paths >= 0).sum()) + 16)
        at, live = np.zeros(len(paths), np.int64), np.arange(len(paths))
        for depth in range(paths.shape[1]):
            live = live[paths[live, depth] >= 0]
            edges, back = np.unique(at[live] * size + paths[live, depth], return_inverse=True)
            at[live] = self._place(edges // size, edges % size)[back]
        self.accepts[at] = numbers
        used = int(np.flatnonzero(self.check >= 0).max(initial=0)) + 1
        self.base, self.check, self.accepts = self.base[:used], self.check[:used], self.accepts[:used]

    def _room(self, size: int) -> None:
        """Arrays of at least ``size`` states; slot 0 is the root and nobody's child."""
        old = getattr(self, "check", np.zeros(0, np.int32))
        grow = lambda a, value: np.concatenate([a, np.full(size - len(old), value, np.int32)])
        self.base = grow(getattr(self, "base", old), 0)
        self.accepts = grow(getattr(self, "accepts", old), -1)
        self.check = grow(old, -1)
        if not len(old):
            self.check[0] = 0

    def _place(self, parents: np.ndarray, syms: np.ndarray) -> np.ndarray:
        """A state for each edge; edges are sorted by parent, then symbol. Large families are placed first."""
        own, first, n = np.unique(parents, return_index=True, return_counts=True)
        slots = np.empty(len(syms), np.int64)
        start = 1
        for f in np.argsort(-n, kind="stable").tolist():
            if n[f] == 1:
                break
            family = syms[first[f]:first[f] + n[f]]
            steps, tries, span = family - family[0], 0, int(family[-1] - family[0])
            # Small families are strewn over the array, large ones go where there was room for the last.
            at = start if n[f] > 16 else f * 0x9E3779B1 % max(1, len(self.check) - span)
            while True:
                if at + span >= len(self.check):
                    self._room(at + span + (1 << 16))
                if at and self.check[at] < 0 and (self.check[at + steps] < 0).all():
                    break
                # Steps grow with the tries, so that a family soon comes to where there is room.
                tries += 1
                at += 1 + tries * tries // 64
            self.base[own[f]] = at - family[0]
            self.check[at + steps] = own[f]
            slots[first[f]:first[f] + n[f]] = at + steps
            if n[f] > 16:
                start += tries // 4
        single = first[n == 1]
        free = np.flatnonzero(self.check < 0)[:len(single)]
        if len(free) < len(single):
            self._room(len(self.check) + len(single))
            free = np.flatnonzero(self.check < 0)[:len(single)]
        self.base[parents[single]] = free - syms[single]
        self.check[free] = parents[single]
        slots[single] = free
        return slots

    def step(self, states: np.ndarray, syms: np.ndarray) -> np.ndarray:
        """The states after one more symbol each; -1 where there is none (or state or symbol is -1)."""
        to = self.base[states] + syms
        ok = (states >= 0) & (syms >= 0) & (to > 0) & (to < len(self.check))
        ok &= self.check[np.where(ok, to, 0)] == states
        return np.where(ok, to, -1)

    def walk(self, words: Words, langs: pa.Array, depth: int):
        """For 1 to ``depth`` words the positions where a path of that length begins, and its states."""
        of = pc.fill_null(pc.index_in(langs.cast(pa.large_string()), self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        syms = pc.fill_null(pc.index_in(words.names, self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        syms = syms[words.codes] if len(words.codes) else np.zeros(0, np.int64)
        at = np.arange(len(syms))
        states = self.step(np.zeros(len(langs), np.int64), of)[words.rows] if len(syms) else syms
        for d in range(depth):
            if d:
                inside = at + d < len(syms)
                at, states = at[inside], states[inside]
                together = words.pieces[at] == words.pieces[at + d]
                at, states = at[together], states[together]
            states = self.step(states, syms[at + d])
            at, states = at[states >= 0], states[states >= 0]
            yield at, states


def _cuts(batches):
    """Languages and words of slices of the batches (lang, text)."""
    for whole in batches:
        for b in slices(whole, 1, TEXT_BYTES):
            yield b.column(0), cut(b.column(1), GAPS, BREAKS)


def _unified(parts: list) -> tuple[pa.Array, list[np.ndarray]]:
    """The different strings of all arrays, and for each array the number of each of its strings among them."""
    coded = pa.concat_arrays([x.cast(pa.large_string()) for x in parts]).dictionary_encode()
    return coded.dictionary, np.split(coded.indices.to_numpy(), np.cumsum([len(x) for x in parts])[:-1])


def _sorted(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows stand together, and the places in it where other rows begin; values are below ``sizes``."""
    key, size = columns[0].astype(np.int64), sizes[0]
    for column, n in zip(columns[1:], sizes[1:]):
        if size * n >= 1 << 62:
            key, size = np.unique(key, return_inverse=True)[1].astype(np.int64), len(key)
        key, size = key * n + column, size * n
    order = np.argsort(key, kind="stable")
    return order, np.flatnonzero(np.diff(key[order], prepend=-1))


def _words(docs: DataFrame) -> DataFrame:
    """(lang, word, f): how often each word occurs in each language."""
    def added(held):
        (langs, of), (names, codes) = _unified([x[0] for x in held]), _unified([x[1] for x in held])
        of, codes = np.concatenate(of), np.concatenate(codes)
        order, first = _sorted([of, codes], [len(langs), len(names)])
        n = np.add.reduceat(np.concatenate([x[2] for x in held])[order], first) if len(first) else first
        return pa.RecordBatch.from_arrays(
            [langs.take(pa.array(of[order[first]])).cast(pa.string()), names.take(pa.array(codes[order[first]])).cast(pa.string()),
             pa.array(n, pa.int64())], names=["lang", "word", "n"])

    def work(batches):
        held, many = [], 0
        for langs, words in _cuts(batches):
            coded = langs.dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key, n = np.unique(of[words.rows] * len(words.names) + words.codes, return_counts=True)
            held.append((coded.dictionary.take(pa.array(key // max(len(words.names), 1))),
                         words.names.take(pa.array(key % max(len(words.names), 1))), n))
            many += 2 * len(key)
            if many >= GRAMS:
                yield added(held)
                held, many = [], 0
        if held:
            yield added(held)

    return docs.mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _seeds(langs: pa.Array) -> np.ndarray:
    """What the hashes of a language's n-grams begin with; a language may be empty."""
    return word_hashes(pc.binary_join_element_wise(langs.cast(pa.large_string()), pa.scalar(".", pa.large_string()),
                                                   pa.scalar("", pa.large_string()))).astype(np.uint64)


def _rolled(seeds: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """64 bits of a hash of each n-gram: ``seeds`` are of its language, ``hashes`` of its words one by one."""
    h = seeds
    for x in hashes:
        h = (h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


def _hashed(batches):
    for b in batches:
        h = _rolled(_seeds(b.column("lang")), [word_hashes(b.column("word"))])
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("word"), b.column("f"), pa.array(h.view(np.int64))],
                                         names=["lang", "word", "f", "h"])


def _marks(level: DataFrame):
    """A broadcast bit map of the hashes ``h`` of a level's phrases; what is broadcast is 2**MARK_BITS bits at most."""
    bits = min(MARK_BITS, max(16, math.ceil(math.log2(16 * max(1, level.count())))))
    found = marked(level.select("h"), bits).toArrow()
    marks = np.zeros(1 << bits - 6, np.int64)
    marks[found["word"].to_numpy()] = found["bits"].to_numpy()
    return level.sparkSession.sparkContext.broadcast(marks.tobytes())


def _dealt(held: list, depth: int, blocks: int) -> pa.RecordBatch:
    """The n-grams (languages, their numbers, names, codes of the words) added up and dealt to blocks by their hashes.

    A row has the n-grams of a language in a block, compressed: their numbers in the row's own list of words and how often each
    occurs, in planes of bytes (first words, which rise, by their differences), then that list, joined by blanks.
    """
    (langs, a), (names, b) = _unified([x[0] for x in held]), _unified([x[2] for x in held])
    of = np.concatenate([own[x[1]] for own, x in zip(a, held)])
    codes = [np.concatenate([own[x[3][j]] for own, x in zip(b, held)]) for j in range(depth)]
    order, first = _sorted([of, *codes], [len(langs)] + [len(names)] * depth)
    n = np.diff(first, append=len(order))
    of, codes = of[order[first]], [c[order[first]] for c in codes]
    hashes = word_hashes(names)
    h = _rolled(_seeds(langs)[of], [hashes[c] for c in codes])
    deal = (h >> np.uint64(32)).astype(np.int64) % blocks * len(langs) + of
    order, first = _sorted([deal], [blocks * len(langs)])
    own = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
    # As numbers of 32 bits, if they suffice: this is where most memory is taken.
    own = own.astype(np.int32 if len(first) * len(names) < 1 << 31 else np.int64)
    used, at = np.unique(np.stack([own * own.dtype.type(len(names)) + c[order] for c in codes], 1), return_inverse=True)
    begins = np.searchsorted(used // len(names), np.arange(len(first) + 1))
    values = np.empty((len(order), depth + 1), "<u4")
    values[:, :depth] = at.reshape(-1, depth)
    values[:, :depth] -= begins[own].astype(np.uint32)[:, None]
    values[:, depth] = n[order]
    del at, codes, h
    text = pc.binary_join(pa.ListArray.from_arrays(
        pa.array(begins, pa.int32()), names.take(pa.array(used % len(names))).cast(pa.string())), " ")
    packed, sizes = [], []
    for i, (x, y) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(order)])):
        part = values[x:y].copy()
        part[1:, 0] -= values[x:y - 1, 0]
        raw = part.T.copy().view(np.uint8).reshape(depth + 1, y - x, 4).transpose(0, 2, 1).tobytes() + text[i].as_buffer().to_pybytes()
        packed.append(pa.compress(raw, codec="zstd", asbytes=True))
        sizes.append(len(raw))
    deal = deal[order[first]]
    return pa.RecordBatch.from_arrays(
        [pa.array(deal // len(langs), pa.int32()), langs.take(pa.array(deal % len(langs))).cast(pa.string()),
         pa.array(np.diff(first, append=len(order)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
        names=["block", "lang", "grams", "bytes", "packed"])


def _followed(docs: DataFrame, level: DataFrame, depth: int, blocks: int) -> DataFrame:
    """(block, lang, grams, bytes, packed): n-grams of ``depth`` words, at places where two phrases of the ``level`` overlap."""
    sent = _marks(level)

    def work(batches):
        marks = np.frombuffer(sent.value, np.uint64)
        low, held, many = np.uint64(64 * len(marks) - 1), [], 0
        for langs, words in _cuts(batches):
            last = len(words.codes) - depth + 1         # n-grams that begin here may still go over the end of their piece
            if last < 1:
                continue
            coded = langs.dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.rows]
            hashes = word_hashes(words.names)[words.codes]
            h = _rolled(_seeds(coded.dictionary)[of[:last + 1]], [hashes[j:last + 1 + j] for j in range(depth - 1)])
            h &= low
            known = (marks[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
            at = np.flatnonzero(known[:last] & known[1:] & (words.pieces[:last] == words.pieces[depth - 1:]))
            held.append((coded.dictionary, of[at].astype(np.int32), words.names, [words.codes[at + j] for j in range(depth)]))
            many += depth * len(at)
            if many >= GRAMS:
                yield _dealt(held, depth, blocks)
                held, many = [], 0
        if many:
            yield _dealt(held, depth, blocks)

    return docs.mapInArrow(work, "block int, lang string, grams long, bytes long, packed binary")


def _candidates(h: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Which n-grams can be frequent: the supports of all that share a hash, added up, reach ``least``."""
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
    enough = np.add.reduceat(n[order], first) >= least
    found = np.empty(len(h), bool)
    found[order] = np.repeat(enough, np.diff(first, append=len(h)))
    return found


def _counted(rows: pa.Table, depth: int, least: int, size: int) -> pa.Table:
    """(lang, words, f, h): the frequent phrases among the n-grams of a block, by tries of some ``size`` phrases."""
    parts, lists = [], []
    for grams, bytes_, packed in zip(*(rows[c].to_pylist() for c in ("grams", "bytes", "packed"))):
        raw = pa.decompress(packed, bytes_, codec="zstd", asbytes=True)
        planes = np.frombuffer(raw, np.uint8, 4 * (depth + 1) * grams).reshape(depth + 1, 4, grams)
        part = planes.transpose(0, 2, 1).copy().view("<u4").reshape(depth + 1, grams)
        part[0] = np.cumsum(part[0], dtype=np.uint32)
        parts.append(part)
        lists.append(pc.split_pattern(pa.array([raw[planes.size:]], pa.large_binary()).view(pa.large_string()), " ").values)
    langs, (of,) = _unified([rows["lang"].combine_chunks()])
    of = np.repeat(of, [x.shape[1] for x in parts])
    names, numbers = _unified(lists)
    codes = np.concatenate([own[x[:depth]] for own, x in zip(numbers, parts)], 1).T
    n, hashes = np.concatenate([x[depth] for x in parts]).astype(np.int64), word_hashes(names)
    del parts, lists
    h = _rolled(_seeds(langs)[of], [hashes[codes[:, j]] for j in range(depth)])
    some = np.flatnonzero(_candidates(h, n, least))
    n, of, codes, h = n[some], of[some], codes[some], h[some]
    order, first = _sorted([of, *codes.T], [len(langs)] + [len(names)] * depth)
    first = order[first]
    part = (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % max(1, math.ceil(len(first) / size))
    found = []
    for k in range(int(part.max(initial=-1)) + 1):
        ours, phrases = part == k, first[part[first] == k]
        if not len(phrases):
            continue
        words = names.take(pa.array(codes[phrases].ravel()))
        trie = Trie(langs.take(pa.array(of[phrases])), pa.FixedSizeListArray.from_arrays(words, depth).cast(pa.list_(pa.large_string())),
                    np.arange(len(phrases)))
        f = count(trie, langs, of[ours], names, codes[ours], n[ours], len(phrases))
        found.append((phrases[f >= least], f[f >= least]))
    phrases, f = (np.concatenate([x[i] for x in found] + [np.zeros(0, np.int64)]) for i in (0, 1))
    words = names.take(pa.array(codes[phrases].ravel())).cast(pa.string())
    return pa.table({"lang": langs.take(pa.array(of[phrases])).cast(pa.string()),
                     "words": pa.ListArray.from_arrays(pa.array(np.arange(len(phrases) + 1) * depth, pa.int32()), words),
                     "f": pa.array(f, pa.int64()), "h": pa.array(h[phrases].view(np.int64))})


def count(trie: Trie, langs: pa.Array, of: np.ndarray, names: pa.Array, codes: np.ndarray, n: np.ndarray, phrases: int) -> np.ndarray:
    """How often each of the trie's ``phrases`` occurs among n-grams that occur ``n`` times each."""
    depth = codes.shape[1]
    own = np.repeat(np.arange(len(codes)), depth)
    *_, (at, states) = trie.walk(Words(codes.ravel(), names, of[own], own), langs, depth)
    here = trie.accepts[states]
    total = np.zeros(phrases, np.int64)
    np.add.at(total, here[here >= 0], n[at[here >= 0] // depth])
    return total


def _level(docs: DataFrame, level: DataFrame, depth: int, least: int, size: int) -> DataFrame:
    """(lang, words, f, h): the frequent phrases of ``depth`` words, one more than those of the ``level`` (f, h) have.

    One pass over the documents, whatever the number of phrases: n-grams are dealt to as many blocks as keep a block's
    n-grams in bounds, and a block's tries meet its own n-grams only.
    """
    blocks = max(1, math.ceil((level.agg(F.sum("f")).first()[0] or 0) / BLOCK_GRAMS))
    work = lambda rows: _counted(rows, depth, least, size)
    return materialize(_followed(docs, level, depth, blocks).groupBy("block").applyInArrow(
        work, "lang string, words array<string>, f long, h long"), "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = LONGEST,
                 least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT,
                 trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    Texts, A-Z in lower case, are cut into pieces at ``.,;:!?`` and line ends and pieces at blanks and tabs into words; a
    null text is empty, a null language is ``und``. Candidates are phrases of 2 to ``longest`` words that occur at least
    ``least`` times in a language. Cut after k words, a phrase of a occurrences scores floor(1000000 * a * a / (l * r)) with
    the occurrences l and r of its parts; the lowest score counts, of equal ones the smallest k. Phrases inside a longer
    candidate of at least ``inside_percent`` % of their occurrences are left out. Ties in rank go to the more frequent, then
    the smaller phrase. Repeated rows count each; no documents, or none with a frequent phrase, give no rows. Counts up to
    10**13 stay exact. The documents are read once for each length up to ``longest``. A task counts with one trie of about
    ``trie_phrases`` phrases at a time; the driver holds a bit map of 2**MARK_BITS bits at most.
    """
    docs = drop_strays(docs, lang_col, text_col).toDF("lang", "text")
    docs = docs.select(F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"), "text")
    words = materialize(_words(docs), "words")
    frequent = words.where(F.col("f") >= least)
    level, levels = materialize(frequent.mapInArrow(_hashed, "lang string, word string, f long, h long"), "words-hashed"), []
    for depth in range(2, longest + 1):
        level = _level(docs, level, depth, least, trie_phrases)
        levels.append(level.drop("h"))
    counted = levels[0]
    for x in levels[1:]:
        counted = counted.unionByName(x)
    spaced = lambda x: F.array_join(x, " ")
    every = frequent.select("lang", F.col("word").alias("phrase"), "f").unionByName(
        counted.select("lang", spaced(F.col("words")).alias("phrase"), "f"))
    cuts = counted.select("lang", "words", spaced(F.col("words")).alias("phrase"), F.col("f").alias("a"),
                          F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", spaced(F.slice("words", F.lit(1), F.col("k"))).alias("first"),
                       spaced(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("rest"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(14,0)")
    cuts = cuts.withColumn("a_", wide("a")).withColumn("lr", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr(f"({SCALE} * (a_ * a_)) div lr"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = counted.where(F.size("words") > 2).select("lang", "words", F.col("f").alias("longer"), F.explode(
        F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    longer = longer.select("lang", "words", "longer", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("i"))
    inside = longer.groupBy("lang", spaced(F.slice("words", F.col("i"), F.col("m"))).alias("phrase")).agg(F.max("longer").alias("longer"))
    scored = scored.join(inside, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n",
                                             "cut.score")


def oracle_sql(relation: str = "documents", least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> str:
    """DuckDB statement for the rows at the usual longest phrase of 3 words."""
    return rf"""
with p as (
  select coalesce(lang, '{UNDETERMINED}') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from {relation}),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from w, (values (1), (2), (3)) k(m) where len(w) >= m),
c as materialized (select lang, m, phrase, count(*) as f from g group by all),
t as (select lang, sum(f)::bigint as n from c where m = 1 group by lang),
a as (select *, string_split(phrase, ' ') as w from c where m > 1 and f >= {least}),
x as materialized (
  select lang, phrase, f as a, m, unnest(range(1, m)) as k, w from a),
y as materialized (
  select lang, phrase, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest from x),
s as (
  select y.lang, y.phrase, a, k, l.f as l, r.f as r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score
  from y join c l on l.lang = y.lang and l.phrase = first join c r on r.lang = y.lang and r.phrase = rest),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, f from a where m = 3),
j as (select lang, phrase, max(f) as longer from i group by all),
f as (select b.* from b left join j using (lang, phrase) where longer is null or 100 * longer < {inside_percent} * a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from f)
select lang, rank, phrase, a, l, r, n, score from o join t using (lang) where rank <= {top}"""
