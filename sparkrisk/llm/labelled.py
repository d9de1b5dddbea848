"""The labelled sample that classifiers are fitted on: bounded, and the same at each call."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents a fit reads at most: those whose ids have the smallest hashes.
SAMPLE = 12_000


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id's text, modulo 4; documents of fold 2 are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def sample(documents: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> Iterator[tuple[str, int]]:
    """(text, label) of at most `most` labelled documents outside the held-out fold, in the order of a hash of their ids."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most `most` rows of two numbers are broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "label")
    for row in rows.toLocalIterator():
        yield row["text"], row["label"]
