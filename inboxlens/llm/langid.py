"""Language identification by compression.

Each language gets a zstandard dictionary of raw content: sample texts of that language. A text is cut into blocks and
compressed with every dictionary; the language whose dictionary gives the fewest bytes in total wins. When the runner-up
is almost as small, the text is rejected.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_strays, slices

UNDETERMINED = "und"
#: Bounds of the training sample: languages, rows of each language, characters of each row.
MAX_LANGUAGES, SAMPLE_ROWS, SAMPLE_CHARS = 256, 64, 1024
#: Bytes compressed at a time, so that the dictionary counts as much at the end of a long text as at its start.
BLOCK_BYTES = 4096
LEVEL = 6
#: A text is rejected if the runner-up is larger by less than this part.
MIN_MARGIN = 0.005


def letters(text: Column) -> Column:
    """Lower case, every run of other characters than letters as one space; null counts as empty.

    Combining marks stay with the letters; a text without any letter becomes empty.
    """
    text = F.coalesce(text, F.lit(""))
    kept = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(text.rlike(r"\p{L}"), kept).otherwise("")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
          sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """One raw-content dictionary for each label of ``labelled``.

    The sample is bounded: of each language the ``sample_rows`` rows with the smallest hash of the id, of each row the
    first ``sample_chars`` letters and spaces. More than ``MAX_LANGUAGES`` labels are an error. Rows whose text or
    label is null, or whose text has no letter, teach nothing; an empty table gives an empty model.
    """
    rows = (drop_strays(labelled, id_col, text_col, lang_col).toDF("id", "text", "lang")
            .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .select("lang", F.xxhash64("id").alias("h"), F.substring(letters(F.col("text")), 1, sample_chars).alias("t")))
    first = W.partitionBy("lang").orderBy("h", "t")
    rows = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_rows)
    names = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    model: dict[str, list[str]] = {}
    for x in rows.orderBy("lang", F.desc("r")).collect():
        model.setdefault(x["lang"], []).append(x["t"])
    return {k: "\n".join(v).encode() for k, v in model.items()}


def _sizes(texts: list[bytes], model: dict[str, bytes]) -> list[list[int]]:
    """For each text its compressed size under each dictionary."""
    coders = []
    for raw in model.values():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False).compress)
    out = []
    for t in texts:
        blocks = [t[i:i + BLOCK_BYTES] for i in range(0, len(t), BLOCK_BYTES)]
        out.append([sum(len(c(b)) for b in blocks) for c in coders])
    return out


def decide(texts: list[bytes], model: dict[str, bytes]) -> list[tuple[str, float]]:
    """Language and margin of each prepared text: how much smaller the best coding is than the next, 0 to 1."""
    names, out = list(model), []
    for t, sizes in zip(texts, _sizes(texts, model)):
        if not t or not names:
            out.append((UNDETERMINED, 0.0))
            continue
        ranked = sorted(zip(sizes, names))
        out.append((ranked[0][1], 1.0 if len(ranked) == 1 else 1.0 - ranked[0][0] / ranked[1][0]))
    return out


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", *,
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with three more columns: lang_pred, score (the margin) and rejected.

    Nothing but the whole text is used. A null, empty or letterless text is ``und`` with score 0 and rejected; equal
    sizes go to the language first in the alphabet, with score 0 and rejected. Every row stays, repeated ones too.
    Columns of the input that are called like the new ones are replaced.
    """
    new = ["lang_pred", "score", "rejected"]
    rows = docs.drop(*new)

    def work(texts: pa.Array) -> pa.Array:
        found = []
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0):
            found += decide([(x or "").encode() for x in part.column(0).to_pylist()], model)
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64()),
             pa.array([x == UNDETERMINED or y < min_margin for x, y in found], pa.bool_())], names=new)

    # Only the prepared texts go to Python; the rows they belong to stay where they are.
    made = F.arrow_udf(work, "lang_pred string, score double, rejected boolean")
    out = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), made(letters(F.col(f"`{text_col}`"))).alias("found"))
    return out.select("row.*", "found.*")
