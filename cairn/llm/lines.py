"""Substring deduplication by hashing lines, paragraphs or sentences.

Units are normalised and digested where the text is; only digests with places are
shuffled. The earliest place of each digest is found by an aggregation that combines
before its shuffle, and joined back; digests that are very frequent (a bounded number of
them) are sent to the units instead, so that a line which a third of the documents share
never gathers in one task. Repeated units count where they follow one another for at
least run_words words, so that a phrase which texts share by chance stays.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut, join_split

#: What a unit is; the units of a text, put together, are the text, but for separators of paragraphs.
UNITS = {"line": re.compile("[^\n]*\n+|[^\n]+"), "paragraph": re.compile("(?:[^\n]|\n(?![\x09-\x0d ]*\n))+"), "sentence": re.compile("[^\n.!?]*[.!?\n]+|[^\n.!?]+")}
SPACES = re.compile("[\x09-\x0d ]+")
#: Words of repeated units in a row from which on they are removed.
RUN_WORDS = 30
#: A digest is frequent if more than one in so many units has it: so many digests at most.
FREQUENT = 2000


def units(docs: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, unit, start, end, words, hi, lo): units that are not blank, numbered in each text,
    with their place in the original text in code points, end exclusive, and a 128-bit digest
    of the unit in lower case with runs of ASCII white space as one space and none at its
    ends. row: a hash of the whole text, which tells rows of one id apart."""
    pattern = UNITS[unit]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for key, text in zip(batch.column(0).slice(lo, 64).to_pylist(), batch.column(1).slice(lo, 64).to_pylist(), strict=True):
                    k, row = 0, xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)
                    for m in pattern.finditer(text or ""):
                        plain = SPACES.sub(" ", m[0].lower()).strip(" ")
                        if plain:
                            d = xxhash.xxh3_128_intdigest(plain.encode("utf-8", "surrogatepass"))
                            rows.append((key, row, k, m.start(), m.end(), plain.count(" ") + 1, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
                            k += 1
                cols = [*zip(*rows, strict=True)] or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "row", "unit", "start", "end", "words", "hi", "lo"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, row long, unit long, start long, end long, words long, hi long, lo long")


def repeated_units(docs: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """The units to remove: (id_col, unit, start, end, first_id, first_unit, first_start).

    Occurrences of a digest are ranked by id (null last), then place; the earliest stays. Of
    the others those are returned that stand in a run of such units of one text which has
    run_words words or more, with the place of the one that stays. Rows that repeat an id
    have equal ranks at equal places: of those with equal texts all units stay or go
    together. Null, empty and blank texts have no units. Empty table: no rows. Other
    columns are not read.
    """
    found = cut(units(docs, unit, id_col, text_col))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("unit").alias("unit"), F.col("start").alias("start"))
    first = found.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_split(found, first, ["hi", "lo"], "first", FREQUENT)
    later = later.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("unit") == F.col("first.unit"))))
    text = Window.partitionBy("id", "row")  # the units of one text
    later = later.withColumn("run", F.col("unit") - F.dense_rank().over(text.orderBy("unit")))
    later = later.withColumn("copies", F.count("*").over(Window.partitionBy("id", "row", "run", "unit")))
    later = later.withColumn("long", F.sum(F.col("words") / F.col("copies")).over(Window.partitionBy("id", "row", "run")) >= run_words - 1e-6)
    return later.where("long").select(
        F.col("id").alias(id_col), "unit", "start", "end", F.col("first.id").alias("first_id"), F.col("first.unit").alias("first_unit"), F.col("first.start").alias("first_start")
    )


def without_units(docs: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the repeated units cut out of text_col and a column removed_spans: the places
    cut, as "start:end" in order. Rows with null ids and rows without repeats come back as
    they are, with an empty list."""
    gone = repeated_units(docs, unit, id_col, text_col, run_words).where(F.col(id_col).isNotNull())
    spans = gone.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    rows = docs.drop("removed_spans").select(F.struct("*").alias("row"))  # so that no name clashes
    both = rows.join(spans, F.col(f"row.{id_col}") == F.col("_id"), "left").withColumn("_t", F.col(f"row.{text_col}"))
    joined = F.expr("concat_ws('', transform(sequence(0, size(_spans)), i -> substring(_t, int(if(i = 0, 0L, _spans[i - 1].end) + 1), int(if(i = size(_spans), length(_t), _spans[i].start) - if(i = 0, 0L, _spans[i - 1].end)))))")
    text = F.when(F.col("_spans").isNull(), F.col("_t")).otherwise(joined)
    places = F.coalesce(F.expr("transform(_spans, s -> concat(s.start, ':', s.end))"), F.array().cast("array<string>"))
    return both.select(F.col("row").withField(text_col, text).alias("row"), places.alias("removed_spans")).select("row.*", "removed_spans")
