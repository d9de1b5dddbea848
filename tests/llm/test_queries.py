"""Queries over whole small tables: against SQL, and against brute force where SQL cannot say it; the pipeline stage by stage."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkrisk.llm import pretokens as pt
from sparkrisk.llm import labelled, line_dedup, ngram_join, quality, queries, toxicity
from sparkrisk.llm.common import table

from ..conftest import SMALL, same_rows
from . import helpers


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SMALL).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents", "doc_id", "text").collect()]


def test_classes(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8_ngram_join(spark, SMALL).collect()}
    assert got == helpers.classes(documents)


def test_lines_left(spark, documents):
    """The registered query against all pairs of lines, as digests."""
    left = helpers.lines_left(documents, line_dedup.LEAST_CHARS, lambda n: max(1, n // line_dedup.CHARS_PER_EDIT))
    got = {r["doc_id"]: r for r in queries.op6_line_dedup(spark, SMALL).collect()}
    assert {d: r["left_sha256"] for d, r in got.items()} == {d: hashlib.sha256(left[d].encode()).hexdigest() for d, _ in documents}
    assert all(got[d]["n_lines"] == t.count("\n") + 1 and (got[d]["n_dropped"] == t.count("\n") - left[d].count("\n") or not left[d]) for d, t in documents)


def test_token_counts_of_the_library(spark, documents):
    library = pt.load(queries.tokenizer_path("byte_bpe_50k.json"))
    want = {d: (len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in documents}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op4_token_counts(spark, SMALL).collect()} == want


def test_packed_ids_of_the_library(spark, documents):
    library = pt.load(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in documents}
    rows = queries.op7_packing(spark, SMALL).collect()
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]]) for r in rows)
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())


def test_pieces_of_the_library(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    want = {}
    for d, t in documents:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op10_piece_round_trips(spark, SMALL).collect()} == want


def test_pipeline_of_null_and_empty_documents(spark, tmp_path):
    """Tables with nulls, empties, repeats and clashing names, and without rows."""
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (3, "and the same line\nand", "en", "s", 3), (3, "and the same line\nand", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, some in (("some", docs.withColumns({c: F.lit("mine") for c in ("n_lines", "_of", "_lines", "_gone", "_number")})), ("none", docs.limit(0))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in rows} == ({None, 1, 2, 3} if name == "some" else set())
        assert len({(r["doc_id"], r["start"]) for r in rows}) == len(rows)  # the repeated row has gone


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name,rows", [("op4_token_counts", 1), ("op5_quality", 1), ("op9_toxicity", 1), ("op10_piece_round_trips", 1), ("op6_line_dedup", 1)])
def test_a_row_per_document(spark, documents, name, rows):
    assert sorted(r["doc_id"] for r in queries.queries()[name](spark, SMALL).select("doc_id").collect()) == sorted(d for d, _ in documents)


def test_pipeline(spark, documents):
    """Each stage against a plain version of it over what the stage before has kept."""
    docs = table(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SMALL)
    model = quality.model_for(docs.select("doc_id", "text"), table(spark, SMALL, "labels"))
    kept = [(d, t) for (d, t), s in zip(documents, model.scores([t for _, t in documents]), strict=True) if s >= 0.7]
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(d for d, _ in kept) and good.schema == docs.schema
    clean = stages["toxicity"](spark, good, SMALL)
    p = toxicity.model_for(docs.select("doc_id", "text"), table(spark, SMALL, "labels")).exceeding([t for _, t in kept])[:, 0]
    kept = [x for x, y in zip(kept, p, strict=True) if y < 0.5]
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in kept)
    lined = stages["line dedup"](spark, clean, SMALL)
    left = helpers_lines(kept)
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == left and lined.columns == docs.columns
    single = stages["n-gram Jaccard join"](spark, lined, SMALL)
    found = helpers.classes(list(left.items()))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, (_, c) in found.items() if c == d)
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {d for d, (_, c) in found.items() if c == d}


def helpers_lines(kept):
    left = helpers.lines_left(kept, line_dedup.LEAST_CHARS, lambda n: max(1, n // line_dedup.CHARS_PER_EDIT))
    return {d: left[d] for d, t in kept if left[d].strip() or not t.strip()}
