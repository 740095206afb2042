"""One query for each operator, over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import table
from cairn.llm.decontaminate import leaks
from cairn.llm.embeddings import near_duplicates as near_vectors
from cairn.llm.langid import predict
from cairn.llm.lines import repeated_units
from cairn.llm.lm import score
from cairn.llm.mixing import TARGETS, domain_labels, mix
from cairn.llm.pages import main_text
from cairn.llm.secrets import digest
from cairn.llm.simhash import near_duplicates
from cairn.llm.suffixes import repeated_bytes


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")), TARGETS)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lines, op2_simhash, op3_suffixes, op4_secrets, op5_langid, op6_embeddings, op7_html, op8_mixing, op9_lm, op10_decontaminate)
}

ORACLES = {
    "op1_lines": r"""
        WITH split AS (SELECT doc_id, regexp_extract_all(text, '[^\n.!?]*[.!?\n]+|[^\n.!?]+') AS parts FROM documents),
        each AS (SELECT doc_id, i, parts[i] AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)),
        placed AS (
            SELECT doc_id, i, length(part) AS size, trim(regexp_replace(lower(part), '[\x09-\x0d ]+', ' ', 'g'), ' ') AS plain,
                coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM each),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit, len(string_split(plain, ' ')) AS words FROM placed WHERE plain <> ''),
        ranked AS (
            SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS first_id, first_value(unit) OVER w AS first_unit, first_value(start) OVER w AS first_start
            FROM numbered WINDOW w AS (PARTITION BY plain ORDER BY doc_id, unit)),
        later AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM ranked WHERE k > 1),
        runs AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS run_words FROM later)
        SELECT doc_id, CAST(unit AS BIGINT) AS unit, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS "end", first_id,
            CAST(first_unit AS BIGINT) AS first_unit, CAST(first_start AS BIGINT) AS first_start
        FROM runs WHERE run_words >= 30""",
    # No item of the benchmark has fewer words than a shingle.
    "op10_decontaminate": r"""
        WITH item_words AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
        doc_words AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
        item_grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words)),
        doc_grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_words)),
        sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_grams GROUP BY item_id),
        shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_grams JOIN item_grams USING (g) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
        FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9""",
}
