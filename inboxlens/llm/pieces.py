"""SentencePiece encoding and decoding by suffix-array matching.

The different segments of a batch of texts are written one after the other and indexed by a suffix array. A binary search
for every piece gives the range of its occurrences; these are the edges of a graph over text positions. Sorted by
position they are relaxed from left to right, in all segments at once: an edge is taken if its start is reached and the
merge rules would leave its piece and the one before it side by side. That gives the ids that merging in order of score
gives.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import sys
import types
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters compared in the suffix order: four words of four, doubled twice. Longer pieces are an error.
WORD, WORDS = 4, 4
#: Different segments whose ids a worker remembers from batch to batch, the characters they may have, and pairs of pieces.
KNOWN, KNOWN_CHARS, KNOWN_PAIRS = 1 << 18, 1 << 21, 1 << 19
#: Bytes of text encoded at a time, and edges turned into Python numbers at a time: bounds on memory only.
TEXT_BYTES, EDGES = 1 << 19, 1 << 16
#: Fewest edges or parts that are taken a step on together, and bits of the places for answers about pairs: bounds on time only.
LEAST, PAIR_BITS = 64, 20


@dataclass
class Model:
    """What the workers need: pieces are numbered by rank, characters first, then in order of their merges."""

    pieces: list          # text of each rank
    ids: list             # its id in the model
    halves: list          # for each rank the two ranks that are merged into it; for a character itself twice
    pairs: dict           # left rank * number of ranks + right rank -> rank of both together
    byte_ids: list        # ids of the 256 bytes
    decoded: list         # bytes of each id
    runs: dict            # length of a run of space marks -> id of its piece, if there is one
    breaks: str           # control characters that are in no piece but may separate lines or columns


def load(path: str = MODEL_PATH) -> Model:
    """Read a byte-pair model with byte fallback, a dummy prefix and no normalisation; anything else is an error."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " ﬁ Á ①  b"
    if sp.decode(sp.encode(probe)) != probe or sp.encode("a", out_type=str) != [SPACE + "a"]:
        raise ValueError("the model changes texts or has no dummy prefix")
    n = sp.get_piece_size()
    bytes_of = {sp.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
    if any(not sp.is_byte(i) for i in bytes_of):
        raise ValueError("the model has no byte fallback")
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    text = {i: sp.id_to_piece(i) for i in plain}
    runs = {len(x): i for i, x in text.items() if not x.strip(SPACE)}
    late = max((sp.get_score(i) for k, i in runs.items() if k > 1), default=-np.inf)
    plain = [i for i in plain if i not in runs.values() or len(text[i]) == 1]
    if max(len(text[i]) for i in plain) > WORD * WORDS or any(SPACE in text[i][1:] for i in plain):
        raise ValueError("the model has pieces that are too long or cross a space")
    if len({sp.get_score(i) for k, i in runs.items() if k > 1}) > 1 or any(
            len(text[i]) > 1 and sp.get_score(i) <= late for i in plain):
        raise ValueError("runs of spaces are not merged after all others, from left to right")
    order = sorted(plain, key=lambda i: (len(text[i]) > 1, -sp.get_score(i) if len(text[i]) > 1 else 0, i))
    pieces = [text[i] for i in order]
    rank = {x: r for r, x in enumerate(pieces)}
    if any(c not in rank for x in pieces for c in x) or len({sp.get_score(i) for i in plain if len(text[i]) > 1}) < sum(
            len(x) > 1 for x in pieces):
        raise ValueError("not a byte-pair model: characters are missing or scores are equal")
    pairs = {rank[x[:k]] * len(pieces) + rank[x[k:]]: r for x, r in rank.items() for k in range(1, len(x))
             if x[:k] in rank and x[k:] in rank}
    halves = [(r, r) if len(x) == 1 else _last_merge(x, rank) for r, x in enumerate(pieces)]
    decoded = [b""] * n
    for i in range(n):
        decoded[i] = bytes([bytes_of[i]]) if i in bytes_of else text[i].replace(SPACE, " ").encode() if i in text else b""
    joined = {c for x in pieces if len(x) > 1 for c in x}
    byte_ids = [i for i, _ in sorted(bytes_of.items(), key=lambda x: x[1])]
    return Model(pieces, order, halves, pairs, byte_ids, decoded, runs,
                 "".join(c for c in map(chr, range(32)) if c not in joined and c not in rank))


def merge(text: str, rank: dict) -> list[str]:
    """Merge the characters of ``text`` in order of rank, leftmost first; only used for single pieces and in tests."""
    parts = list(text)
    while len(parts) > 1:
        best = min((rank.get(a + b, len(rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == len(rank):
            break
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


def _last_merge(piece: str, rank: dict) -> tuple[int, int] | None:
    """The two ranks that are merged last when ``piece`` stands alone; None if merging doesn't give the piece."""
    without = {k: v for k, v in ((piece[i:j], rank.get(piece[i:j])) for i in range(len(piece))
                                 for j in range(i + 1, len(piece) + 1)) if v is not None}
    own = without.pop(piece)
    parts = list(piece)
    while len(parts) > 2:
        found = [(without[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in without]
        if not found:
            return None
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return (rank[parts[0]], rank[parts[1]]) if own is not None else None


def side_by_side(m: Model, left: int, right: int) -> bool:
    """Whether merging the characters of both pieces in order ends with exactly these two.

    The merges are undone from the last to the first. What stands at the seam at each time must not form a piece that
    would have been merged before the next step on either side.
    """
    size, bound = len(m.pieces), len(m.pieces)
    while True:
        both = m.pairs.get(left * size + right)
        if both is not None and both < bound:
            return False
        a, b = m.halves[left], m.halves[right]
        whole_left, whole_right = a[1] == left, b[0] == right
        if whole_left and whole_right:
            return True
        if whole_right or (left > right and not whole_left):
            bound, left = left, a[1]           # at equal rank the merge further left comes first
        else:
            bound, right = right + 1, b[0]


class _Neighbours(dict):
    """Answers of ``side_by_side`` by left rank * (number of ranks + 1) + right rank; an unknown character's rank is
    the number of ranks, and it never merges. A table in front of the answers serves arrays of keys."""

    def __init__(self, m: Model):
        super().__init__()
        self.m, self.size = m, len(m.pieces)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.table = np.full(1 << PAIR_BITS, -1, np.int64)    # 2 * key + answer at the key's place; a later key replaces it

    def __missing__(self, key: int) -> bool:
        left, right = divmod(key, self.size + 1)
        ok = self[key] = self.size in (left, right) or side_by_side(self.m, left, right)
        return ok

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The answers for an array of keys."""
        place = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        found = self.table[place]
        missed = np.flatnonzero(found >> 1 != keys)
        if len(missed):
            asked, back = np.unique(keys[missed], return_inverse=True)
            answers = asked * 2 + np.fromiter(map(self.__getitem__, asked.tolist()), np.int64, len(asked))
            found[missed] = answers[back]
            self.table[place[missed]] = found[missed]
        return found & 1 == 1


class _Numbers(dict):
    """Numbers of texts in the order in which they were first asked for; ``new`` lists those that weren't known."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        k = self[text] = len(self)
        self.new.append(text)
        return k

    def taken(self) -> list[str]:
        """The texts that are new since the last call."""
        new, self.new = self.new, []
        return new


class Encoder:
    """Encodes segments; remembers those it has seen, up to ``KNOWN`` and ``KNOWN_CHARS``."""

    def __init__(self, m: Model):
        self.m, self.size = m, len(m.pieces)
        self.memo = _Neighbours(m)
        usable = [r for r, h in enumerate(m.halves) if h is not None]
        # Codes of the characters: the space mark, others in longer pieces, then those that are only pieces themselves.
        touching = {x[i:i + 2] for x in m.pieces for i in range(len(x) - 1)}
        joined = [SPACE, *sorted({c for x in touching for c in x} - {SPACE})]
        chars = [*joined, *sorted({c for x in m.pieces for c in x}.difference(joined))]
        self.code = np.zeros(0x110000, np.uint64)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1, dtype=np.uint64)
        # Whether some piece has two characters side by side; several space marks are not cut apart either.
        self.touching = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        for x in [SPACE * 2, *touching]:
            self.touching[tuple(self.code[[ord(c) for c in x]].astype(np.int64))] = True
        keys = np.zeros((len(usable), WORD * WORDS), np.uint64)
        for row, r in enumerate(usable):
            keys[row, :len(m.pieces[r])] = self.code[[ord(c) for c in m.pieces[r]]]
        by = np.lexsort(_pack(keys)[::-1])
        keys, self.usable = keys[by], np.array(usable, np.int64)[by]
        self.lengths = np.array([len(m.pieces[r]) for r in self.usable], np.int64)
        self.low, self.high = _pack(keys), _pack(np.where(keys == 0, np.uint64(0xFFFF), keys))
        # By rank, the last entry for an unknown character.
        self.length = np.array([*map(len, m.pieces), 1], np.int64)
        self.ids, self.byte_ids = np.array([*m.ids, -1], np.int32), np.array(m.byte_ids, np.int32)
        self.split = re.compile(f"{SPACE}*[^{SPACE}{re.escape(m.breaks)}]+|{SPACE}+|[{re.escape(m.breaks)}]").findall
        self.forget()

    def forget(self):
        self.known, self.parts = _Numbers(), _Numbers()
        self.segment_ids, self.part_ids = _Lists(), _Lists()
        self.chars = 0

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, rank) of every occurrence of every piece."""
        padded = np.concatenate([codes, np.zeros(WORD * WORDS, np.uint64)])
        words = sum(padded[k:len(codes) + WORD * (WORDS - 1) + k] << np.uint64(16 * (WORD - 1 - k)) for k in range(WORD))
        order = _suffixes(words)
        keys = [words[WORD * k:WORD * k + len(codes)][order] for k in range(WORDS)]
        low, high = np.searchsorted(keys[0], self.low[0]), np.searchsorted(keys[0], self.high[0], "right")
        for k in range(1, WORDS):                         # longer pieces, where the words before are equal
            on = np.flatnonzero((self.lengths > WORD * k) & (low < high))
            first, behind = low[on], high[on]
            low[on] = _search(keys[k], self.low[k][on], first, behind, False)
            high[on] = _search(keys[k], self.high[k][on], first, behind, True)
        count = high - low
        starts = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        ends, ranks = starts + np.repeat(self.lengths, count), np.repeat(self.usable, count)
        return starts, ends, ranks

    def _relax(self, begins: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               ranks: np.ndarray) -> np.ndarray:
        """The rank that ends at each position; -2 if it is not reached, -1 at the beginning of a part."""
        memo, over = self.memo, self.size + 1
        last = np.full(int(sizes.sum()) + len(sizes), -2, np.int64)
        last[begins] = -1
        # Edges that start equally deep in different parts don't touch each other: they are relaxed at once, depth by
        # depth, as long as there are many. What is left are the ends of long parts, one edge after the other.
        depth = starts - np.repeat(begins, sizes + 1)[starts]
        level = np.bincount(depth)
        levels = int(np.argmax(np.append(level, 0) < LEAST))
        levels = min(levels, 0xFFFF)
        many = np.flatnonzero(depth < levels)
        many = many[np.argsort(depth[many].astype(np.uint16), kind="stable")]
        behind = np.cumsum(level[:levels])
        for a, b in zip((behind - level[:levels]).tolist(), behind.tolist()):
            part = many[a:b]
            before, rank = last[starts[part]], ranks[part]
            ok = before == -1
            on = np.flatnonzero(before >= 0)
            ok[on] = memo.of(before[on] * over + rank[on])
            last[ends[part[ok]]] = rank[ok]
        few = np.flatnonzero(depth >= levels)
        if not len(few):
            return last
        few = few[np.argsort(starts[few])]
        last = last.tolist()
        for part in np.split(few, range(EDGES, len(few), EDGES)):
            for start, end, rank in zip(starts[part].tolist(), ends[part].tolist(), ranks[part].tolist()):
                before = last[start]
                if before == -1 or (before >= 0 and memo[before * over + rank]):
                    last[end] = rank
        return np.array(last, np.int64)

    def _tokens(self, begins: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of the token that starts at each position, -1 if none does: all parts from their ends, step by step."""
        token = np.full(len(last), -1, np.int64)
        low, at = begins, begins + sizes
        while len(at) >= LEAST:
            rank = last[at]
            at = at - self.length[rank]
            token[at] = rank
            on = at > low
            low, at = low[on], at[on]
        for b, e in zip(low.tolist(), at.tolist()):
            while e > b:
                rank = last[e]
                e -= int(self.length[rank])
                token[e] = rank
        return token

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after the other, and how many each has."""
        points, begins, sizes = _joined(parts)
        # Of several space marks all but the last are merged after everything else.
        twice = np.flatnonzero((points[:-1] == ord(SPACE)) & (points[1:] == ord(SPACE)))
        marks = np.bincount(np.searchsorted(begins, twice, "right") - 1, minlength=len(parts))
        if len(twice):
            points, sizes = np.delete(points, twice), sizes - marks
            begins = np.cumsum(sizes + 1) - (sizes + 1)
        # The separator is in no piece, so no edge crosses it; other characters that are in none are edges themselves.
        codes = self.code[points]
        unknown = codes == 0
        unknown[(begins + sizes)[:-1]] = False
        unknown = np.flatnonzero(unknown)
        starts, ends, ranks = self._edges(codes)
        starts = np.concatenate([starts, unknown])
        ends, ranks = np.concatenate([ends, unknown + 1]), np.concatenate([ranks, np.full(len(unknown), self.size)])
        token = self._tokens(begins, sizes, self._relax(begins, sizes, starts, ends, ranks))
        at = np.flatnonzero(token >= 0)
        ids, count, first = self.ids[token[at]], np.ones(len(at), np.int64), np.searchsorted(at, begins)
        odd = np.flatnonzero(token[at] == self.size)
        wild = points[at[odd]].astype(np.int64)
        width = count[odd] = 1 + (wild >= 0x80) + (wild >= 0x800) + (wild >= 0x10000)
        runs = []
        for part in np.flatnonzero(marks).tolist():
            t, extra = int(first[part]), int(marks[part])
            lone = int(ids[t] == self.m.runs[1])
            runs.append((t, _run(extra + lone, self.m.runs)))
            count[t] = len(runs[-1][1]) + 1 - lone
        flat, place = np.repeat(ids, count), np.cumsum(count) - count
        for k in range(4):                                # the bytes of unknown characters
            on = np.flatnonzero(width > k)
            x, w = wild[on], width[on]
            byte = x >> 6 * (w - 1 - k)
            byte = (byte & 0x3F) | 0x80 if k else np.where(w == 1, byte, byte | (0xF00 >> w) & 0xFF)
            flat[place[odd[on]] + k] = self.byte_ids[byte]
        for t, run in runs:
            flat[place[t]:place[t] + len(run)] = run
        return flat, np.add.reduceat(count, first)

    def _cut(self, segments: list[str]) -> tuple[list[str], np.ndarray]:
        """The segments in parts that no merge can cross, between two characters that no piece has side by side; and how
        many parts each has."""
        points, begins, sizes = _joined(segments)
        codes = self.code[points]
        codes[codes >= len(self.touching)] = 0
        codes = codes.astype(np.int64)
        new = np.concatenate([[True], ~self.touching[codes[:-1], codes[1:]]])
        new[(begins + sizes)[:-1]] = False                # a separator
        new[begins] = True
        starts = np.flatnonzero(new)
        first = np.searchsorted(starts, begins)
        ends = np.append(starts[1:], len(points))
        ends[first[1:] - 1] -= 1
        text = "\0".join(segments)
        return ([text[i:j] for i, j in zip(starts.tolist(), ends.tolist())],
                np.diff(np.append(first, len(starts))))

    def _learn(self, segments: list[str]) -> None:
        """Encode new segments by way of their different parts."""
        texts, counts = self._cut(segments)
        every = np.fromiter(map(self.parts.__getitem__, texts), np.int64, len(texts))
        if unseen := self.parts.taken():
            self.part_ids.append(*self._encode(unseen))
        self.segment_ids.append(*self.part_ids.gather(every, counts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each begins."""
        if len(self.known) > KNOWN or self.chars > KNOWN_CHARS:
            self.forget()
        if len(self.memo) > KNOWN_PAIRS:
            self.memo.clear()
        number, every, counts = self.known.__getitem__, [], []
        for t in texts:
            before = len(every)
            if t:
                every.extend(map(number, self.split((" " + t).replace(" ", SPACE))))
            counts.append(len(every) - before)
        if new := self.known.taken():
            self.chars += sum(map(len, new))
            self._learn(new)
        flat, counts = self.segment_ids.gather(np.array(every, np.int64), np.array(counts, np.int64))
        return flat, np.concatenate([[0], np.cumsum(counts)])


class _Lists:
    """Many short lists of ids, one after the other."""

    def __init__(self):
        self.flat, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def append(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])

    def gather(self, every: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists numbered ``every`` joined in one array; ``sizes`` of them at a time are a row: how many ids each has."""
        own = self.counts[every]
        ends = np.cumsum(own)
        at = np.cumsum(self.counts) - self.counts
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(at[every] - (ends - own), own) + np.arange(total)]
        borders = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return flat, np.diff(borders)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts with a zero between them, where each text begins, and its size."""
    points = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, np.cumsum(sizes + 1) - (sizes + 1), sizes


def _run(n: int, runs: dict) -> list[int]:
    """Ids of ``n`` space marks, merged from left to right."""
    parts: list[int] = []
    for _ in range(n):
        parts.append(1)
        while len(parts) > 1 and parts[-2] + parts[-1] in runs:
            parts[-2:] = [parts[-2] + parts[-1]]
    return [runs[k] for k in parts]


def _pack(keys: np.ndarray) -> list[np.ndarray]:
    return [sum(keys[:, WORD * w + k] << np.uint64(16 * (WORD - 1 - k)) for k in range(WORD)) for w in range(WORDS)]


def _suffixes(words: np.ndarray) -> np.ndarray:
    """Order of the positions by the ``WORDS`` words from each on, by prefix doubling. The words behind the text are no
    positions."""
    step, rank = WORD, words
    while True:
        by = np.argsort(rank)
        if step == WORD * WORDS:
            return by
        ordered, rank = rank[by], np.empty_like(rank)
        rank[by] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]), dtype=np.uint64)
        rank = rank[:-step] << np.uint64(32) | rank[step:]
        step *= 2


def _search(key: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """First place in each part ``low`` to ``high`` of ``key``, which is sorted there, that is not less than (after:
    greater than) what is wanted."""
    while (open_ := low < high).any():
        mid = np.minimum((low + high) // 2, len(key) - 1)
        right = open_ & ((key[mid] <= wanted) if after else (key[mid] < wanted))
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def decode(ids: list[int], m: Model) -> str:
    """The text of a list of ids, without the dummy prefix; ids of control pieces are nothing."""
    raw = b"".join([m.decoded[i] for i in ids])
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def _encoder(m: Model, name: str) -> Encoder:
    """This worker process's encoder for the model: what one task has learnt serves the next."""
    store = sys.modules.setdefault("_inboxlens_encoders", types.ModuleType("_inboxlens_encoders"))
    if not hasattr(store, name):
        setattr(store, name, Encoder(m))
    return getattr(store, name)


def encode_documents(docs: DataFrame, text_col: str = "text", *, path: str = MODEL_PATH) -> DataFrame:
    """``docs`` with token_ids (array of int), n_tokens and round_trip (whether decoding gives the text again).

    The model is read on the driver and shipped with the job. Null and empty texts have no tokens; null counts as empty
    for the round trip. A text that holds the model's space mark itself decodes with spaces there. Whole texts are
    encoded; every row stays, repeated ones too. Columns that are called like the new ones are replaced.
    """
    m = load(path)
    name = hashlib.sha256(pickle.dumps(m)).hexdigest()
    new = ["token_ids", "n_tokens", "round_trip"]
    rows = docs.drop(*new)

    def work(column: pa.Array) -> pa.Array:
        encoder, made = _encoder(m, name), []
        for b in slices(pa.RecordBatch.from_arrays([column], names=["t"]), 0, TEXT_BYTES):
            texts = [x or "" for x in b.column(0).to_pylist()]
            ids, at = encoder.encode(texts)
            back = [decode(ids[i:j].tolist(), m) == t for t, i, j in zip(texts, at[:-1].tolist(), at[1:].tolist())]
            made.append(pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(at), pa.int64()),
                 pa.array(back, pa.bool_())], names=new))
        return pa.concat_arrays(made)

    # Only the texts go to Python; the rows they belong to stay where they are.
    coded = F.arrow_udf(work, "token_ids array<int>, n_tokens long, round_trip boolean")
    out = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), coded(F.col(f"`{text_col}`")).alias("coded"))
    return out.select("row.*", "coded.*")


def decode_documents(encoded: DataFrame, ids_col: str = "token_ids", column: str = "decoded", *,
                     path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` with one more text column: the decoded ids. Null ids give null, an empty list the empty text."""
    m = load(path)
    rows = encoded.drop(column)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{ids_col}`").alias("t"))
    made = T.StructType([packed.schema["row"], T.StructField(column, T.StringType())])

    def work(batches):
        for b in batches:
            texts = [None if x is None else decode(x, m) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=made.names)

    return packed.mapInArrow(work, made).select("row.*", column)
