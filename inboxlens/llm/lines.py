"""Line deduplication by content-defined chunks of lines.

Several rolling hashes run over the hashes of the lines, one for each of their leading BITS bits and each direction. Such
a hash sets a boundary between two lines unless its bit changes from the one to the other in its direction. So its chunks
begin with a line of the one kind and end with a line of the other: a passage's own lines cut it, and it is cut alike
wherever it stands. Two neighbouring lines are a chunk of some hash unless all their BITS bits agree. A line and its repetition
are a chunk, too, and a line of many words is one by itself. A chunk that occurs more than once anywhere is removed from all places but the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, flagged, materialize, repeated

#: Bits of a line's hash that set boundaries (a multiple of 4): of 256 pairs of different lines one is never a chunk.
BITS = 8
#: Chunks that count: two lines of at least MIN_WORDS words, or a line of at least LONG_WORDS.
MIN_WORDS, LONG_WORDS = 8, 50

_GAP = r"\x20\x09-\x0D"


def _kind(line: Column) -> Column:
    """The leading BITS bits of a line's hash, as hexadecimal digits."""
    return F.substring(F.md5(line), 1, BITS // 4)


def _has_words(text: Column, n: int) -> Column:
    """Whether ``text`` has ``n`` words at least; reading ends with the n-th word."""
    if n < 1:
        return text.isNotNull()
    word = rf"[^{_GAP}]++[{_GAP}]++"
    return (F.length(text) >= 2 * n - 1) & text.rlike(rf"^[{_GAP}]*+(?:{word}){{{n - 1}}}[^{_GAP}]")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _cut_alike(a: Column, b: Column, min_words: int) -> Column:
    """Whether two neighbouring lines are a chunk that counts."""
    return F.coalesce(_has_words(F.concat_ws("\n", a, b), min_words) & ((_kind(a) != _kind(b)) | (a == b)), F.lit(False))


def _chunks(rows: DataFrame, min_words: int, long_words: int) -> DataFrame:
    """(id, t1, t2, at, n, body) for the chunks that count: number of the first line, number of lines, text."""
    lines = _lines(F.col("text"))
    pairs = F.posexplode(F.zip_with(lines, F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))),
                                    lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    one = rows.select("id", "t1", "t2", pairs.alias("at", "x")).select("id", "t1", "t2", "at", "x.a", "x.b")
    a, b = F.col("a"), F.col("b")
    made = F.array(F.when(_has_words(a, long_words), F.struct(F.lit(1).alias("n"), a.alias("body"))),
                   F.when(_cut_alike(a, b, min_words), F.struct(F.lit(2).alias("n"), F.concat_ws("\n", a, b).alias("body"))))
    return one.select("id", "t1", "t2", "at", F.explode(made).alias("c")).where(F.col("c").isNotNull()).select(
        "id", "t1", "t2", "at", "c.n", "c.body")


def _kept_lines(lines: Column, gone: Column) -> Column:
    """``lines`` without those whose numbers (from 0, rising) are in ``gone``: the stretches between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS,
                long_words: int = LONG_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with shortened texts and two more columns: removed_chunks and removed_lines.

    Lines end at line feeds. Of equal chunks (compared byte by byte) the one with the smallest id stays, then the one
    nearest to the start of its text; a null id comes after all others, rows of one id are ordered by a hash of their
    texts. A line goes if it lies in a chunk that goes and in none that stays as the first of several; so the first
    occurrence of any line always stays. Of rows that are equal in id and text one is first, and all chunks of the
    others go. Null texts stay null; an empty text is one empty line and stays; every row stays, also one whose text
    becomes empty. Further columns pass through; those called like the new ones are replaced.

    Only hashes are counted over all chunks. Bodies move only of chunks whose hash is repeated (a bit map of
    ``filter_bits`` bits, broadcast, lets few others through; more repeated hashes than that let more through and change
    no result), one for each task and chunk. Chunks whose 128-bit hashes agree but not their bytes stay. Texts are shuffled
    once, to meet the lines that go; no group of equal chunks is brought together.
    """
    docs = docs.drop("removed_chunks", "removed_lines")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(f"row.`{text_col}`")
    keyed = docs.select(row).select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(text).alias("t1"),
                                    F.xxhash64(F.lit(1), text).alias("t2"))
    key = ["id", "t1", "t2"]
    equal = [F.col(f"g.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key]
    chunks = _chunks(keyed.select(*key, text.alias("text")), min_words, long_words)
    marks = materialize(repeated(chunks.select(F.xxhash64("body").alias("h")), filter_bits), "lines-repeated")
    hit = flagged(chunks.withColumn("h1", F.xxhash64("body")), F.col("h1"), marks, filter_bits).where("often")
    hit = hit.select(*key, "at", "n", "body", "h1", F.xxhash64(F.lit(1), "body").alias("h2"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "t1", "t2", "at")
    first = hit.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("many"), F.min("body").alias("b1"), F.max("body").alias("b2"),
                                        F.min(place).alias("first")).where("many > 1 and b1 = b2")
    first = materialize(first.select("h1", "h2", "first"), "lines-first")
    seen = hit.drop("body").join(first, ["h1", "h2"]).withColumn("goes", place != F.col("first"))
    # A document's own chunks and lines only; equal rows have them in the same places.
    chunk = F.struct("at", "n")
    lists = seen.groupBy(*key).agg(F.collect_set(F.when(F.col("goes"), chunk)).alias("out"),
                                   F.collect_set(F.when(~F.col("goes"), chunk)).alias("in")).where(F.size("out") > 0)
    covered = lambda c: F.flatten(F.transform(c, lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    lists = lists.select(*key, F.array_sort(F.array_except(covered("out"), covered("in"))).alias("gone"),
                         F.size("out").alias("removed_chunks"))
    singles, extras = _equal_rows(keyed, key)
    joined = singles.alias("k").join(lists.alias("g"), equal[0] & equal[1] & equal[2], "left").select("row", "gone", "removed_chunks")
    lines = _lines(text)
    out = joined.select("row", F.when(F.size("gone") > 0, F.array_join(_kept_lines(lines, F.col("gone")), "\n")).otherwise(text).alias("new"),
                        F.coalesce(F.col("removed_chunks"), F.lit(0)).alias("removed_chunks"),
                        F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))
    if extras is not None:
        out = out.unionByName(_without_chunks(extras, text, min_words, long_words))
    return out.select(*[F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
                      "removed_chunks", "removed_lines")


def _equal_rows(keyed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """One row of each id and text, and the others; None if there are no others, as in tables with different ids."""
    twins = materialize(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "lines-twins")
    if twins.isEmpty():
        return keyed, None
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key]
    meet = lambda how: keyed.alias("k").join(twins.alias("t"), same[0] & same[1] & same[2], how)
    numbered = materialize(meet("left_semi").withColumn("number", F.monotonically_increasing_id()), "lines-equal")
    first = numbered.groupBy(*key).agg(F.min("number").alias("number")).select("number")
    one = numbered.join(first, "number", "left_semi").drop("number")
    return meet("left_anti").unionByName(one), numbered.join(first, "number", "left_anti").select("row")


def _without_chunks(rows: DataFrame, text: Column, min_words: int, long_words: int) -> DataFrame:
    """``rows`` without the lines of any chunk that counts."""
    lines = F.col("lines")
    rows = rows.select("row", _lines(text).alias("lines"))
    long = lambda x: _has_words(x, long_words)
    pair = lambda i: _cut_alike(F.get(lines, i), F.get(lines, i + 1), min_words)
    rows = rows.select("row", "lines", F.transform(lines, lambda x, i: F.struct(long(x).alias("long"), pair(i).alias("pair"))).alias("c"))
    before = lambda i: F.when(i > 0, F.get("c", i - 1)["pair"]).otherwise(F.lit(False))
    kept = F.filter(lines, lambda _, i: ~(F.get("c", i)["long"] | F.get("c", i)["pair"] | before(i)))
    gone = F.coalesce(F.size(lines) - F.size(kept), F.lit(0))
    count = F.aggregate("c", F.lit(0), lambda s, c: s + c["long"].cast("int") + c["pair"].cast("int"))
    return rows.select("row", F.array_join(kept, "\n").alias("new"), F.coalesce(count, F.lit(0)).alias("removed_chunks"),
                       gone.alias("removed_lines"))


def oracle_sql(relation: str = "documents", min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> str:
    """DuckDB statement for the rows (doc_id, text, removed_chunks, removed_lines); ids must be unique."""
    words = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"
    return rf"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as a, generate_subscripts(string_split(text, chr(10)), 1) as i
  from {relation}),
p as (select *, lead(a) over (partition by doc_id order by i) as b, {words.format("a")} as w from l),
q as (select *, lead(w) over (partition by doc_id order by i) as v from p),
c as (
  select doc_id, i, 1 as n, a as body from q where w >= {long_words}
  union all
  select doc_id, i, 2, a || chr(10) || b from q
  where b is not null and w + v >= {min_words} and (a = b or left(md5(a), {BITS // 4}) <> left(md5(b), {BITS // 4}))),
r as (select *, row_number() over (partition by body order by doc_id, i) as r, count(*) over (partition by body) as many from c),
x as (select doc_id, unnest(range(i, i + n)) as i, r > 1 as goes from r where many > 1),
g as (select doc_id, i from x group by doc_id, i having bool_and(goes)),
t as (
  select l.doc_id, string_agg(a, chr(10) order by l.i) filter (g.i is null) as text, count(g.i)::int as removed_lines
  from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id),
k as (select doc_id, count(*)::int as removed_chunks from r where r > 1 group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(t.text, '') end as text,
  coalesce(removed_chunks, 0) as removed_chunks, coalesce(removed_lines, 0) as removed_lines
from {relation} d left join t using (doc_id) left join k using (doc_id)"""
