"""The pN_ queries on page text, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.llm import leakage, packing, reading, terms
from cairn.llm.sql import SQL
from cairn.tables import table


def p3_found(spark, d):
    return terms.hash_frequencies(table(spark, d, "chunk_refs")).filter("mark IS NOT NULL").select("hash", "mark")


def p3_frequencies(spark, d):
    return terms.hash_frequencies(table(spark, d, "chunk_refs"))


def p3_sequences(spark, d):
    """Runs of up to three chunks, which files share that share contents."""
    return terms.hash_sequences(table(spark, d, "chunk_refs"), 3).select(F.array_join("terms", ",").alias("terms"), "n", "n_records", "mark")


def p7_packed(spark, d):
    return packing.pack(packing.token_counts(table(spark, d, "documents")))


def p7_containers(spark, d):
    return p7_packed(spark, d).filter("container IS NOT NULL").groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))


def p8_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_spans(spark, d):
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark, d):
    """The whole corpus, leaked stretches cut out."""
    return leakage.cleaned(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def _levels(spark, d):
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_found(spark, d):
    return _levels(spark, d).select("doc_id", "band")


def p9_profile(spark, d):
    return _levels(spark, d).groupBy("band").agg(F.count("*").alias("n_pages"), F.sum("n_words").alias("n_words"))


QUERIES = {f.__name__: f for f in (p3_found, p3_frequencies, p3_sequences, p7_packed, p7_containers, p8_found, p8_spans, p8_clean, p9_found, p9_profile)}
__all__ = ["QUERIES", "SQL"]
