"""What larger tables need: no step holds all at once, nothing is learned from a part."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import line_dedup, linking, ngram_join, scratch

rng = random.Random(7)
TEXTS = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(100)]
NEAR = [t + " and one more" for t in TEXTS[:40]]


@pytest.fixture
def shuffled(monkeypatch):
    """Numbers of signature rows that are shuffled at once."""
    seen, whole = [], linking.candidates

    def candidates(sigs, *options):
        seen.append(sigs.count())
        return whole(sigs, *options)

    monkeypatch.setattr(linking, "candidates", candidates)
    return seen


def test_signatures_are_shuffled_in_parts(spark, shuffled):
    docs = scratch.save(spark.createDataFrame(list(enumerate(TEXTS + NEAR)), "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {k: k - 100 if k >= 100 else k for k in range(140)}
    whole = ngram_join._signature_rows(docs, 5, 80, 100, 3, 1, np.zeros(0, np.uint64)).count()
    assert sum(shuffled) == whole and max(shuffled) < 0.4 * whole


def test_common_features_are_counted_in_all_documents(spark):
    # equal ids fall into any choice by id together, or none of them does
    passage = "the same passage in many of the texts"
    for doc_id in (1, 2):
        rows = [(doc_id, f"a{k} b{k} c{k} d{k} e{k}" + (f" {passage}" if k % 50 == 0 else "")) for k in range(6000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = ngram_join.common_features(docs, 6000, 5)
        assert len(got) == 4 and (np.diff(got.astype(np.float64)) > 0).all()  # 8 words, 120 of 6,000 documents


def test_rare_features_are_not_common(spark):
    docs = spark.createDataFrame([(k, f"a{k // 10} b c d e") for k in range(6000)], "doc_id long, text string").repartition(3)
    assert len(ngram_join.common_features(docs, 6000, 5)) == 0


def test_bitmap_of_many_ids(spark):
    ids = [*range(-3000, 3000, 3), 2**63 - 1, -(2**63)]
    among = linking.Among(scratch.save(spark.createDataFrame([(k,) for k in ids], "id long").repartition(3)), most=100)
    assert not among.exact and among(np.array(ids)).all()
    assert among(np.arange(10_000, 30_000)).mean() < 0.05
    assert linking.Among(scratch.save(spark.createDataFrame([(5,)], "id long")))(np.array([4, 5, 6])).tolist() == [False, True, False]


def test_many_candidate_lines_send_no_other_texts(spark, monkeypatch):
    lines = [f"{k} {rng.getrandbits(200)} {rng.getrandbits(200)}" for k in range(300)]
    near = [line + " x" for line in lines[:30]]
    docs = scratch.save(spark.createDataFrame([(k, line) for k, line in enumerate(lines + near)], "doc_id long, text string").repartition(3))
    ids = scratch.save(line_dedup._line_table(docs).where("doc_id < 30 or doc_id >= 300").select(F.col("line_id").alias("id")))
    chosen = linking.Among
    monkeypatch.setattr(linking, "Among", lambda ids: chosen(ids, 10))  # as if 60 ids were many
    texts = line_dedup._texts(docs, ids)
    assert "Join" not in texts._jdf.queryExecution().executedPlan().toString()
    got = {bytes(r.bytes).decode() for r in texts.collect()}
    assert got >= {*lines[:30], *near} and len(got) < 80
    dropped = {r.doc_id for r in line_dedup.line_components(docs).where("not keep").collect()}
    assert dropped == {300 + k for k in range(30)}


def test_pipeline_shuffles_signatures_in_parts(spark, shuffled):
    docs = scratch.save(spark.createDataFrame(list(enumerate(TEXTS + NEAR)), "doc_id long, text string"))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, "").collect()}
    assert kept == set(range(100)) and max(shuffled) < 0.4 * sum(shuffled)


@pytest.fixture
def compared(spark, monkeypatch):
    """Blocks of five members; numbers of members of which blocks compared have been made."""
    monkeypatch.setattr(linking, "BLOCK", 5)
    return spark.sparkContext.accumulator(0)


def _across(spark, links, sets, made):
    """Of links (a, b) between numbered sets of numbers, what the second comparison finds."""
    contents = [(k, np.array(sorted(s), np.uint64).tobytes()) for k, s in enumerate(sets)]
    known = scratch.save(spark.createDataFrame(contents, "id long, content binary"))

    def as_sets(a, b):
        made.add(len(a) + len(b))
        return tuple([np.frombuffer(x, np.uint64) for x in part] for part in (a, b))

    found = linking.across(scratch.save(spark.createDataFrame(links, "a long, b long")), None, known, lambda ids: None, as_sets, 80, 100)
    return sorted((r.id, r.comp) for r in linking.components(found).collect())


def test_a_group_of_chance_candidates_sends_no_more_than_its_links(spark, compared):
    # every tenth two neighbours are equal, and a chain of candidates joins all 200
    sets = [{1000 * (k - (k % 10 == 1)) + j << 24 for j in range(10)} for k in range(200)]
    got = _across(spark, [(k + 1, k) if k % 2 else (k, k + 1) for k in range(199)], sets, compared)
    assert got == [(k + d, k) for k in range(0, 200, 10) for d in (0, 1)]
    assert compared.value <= 4 * 200 + 20  # twice as many within a block; 40 blocks of them would be 200 x 40


def test_members_of_a_large_bucket_all_meet(spark, compared, monkeypatch):
    # ten chained buckets of 40, each a star around its least member, whose members are equal in twos
    save, labels = scratch.save, []
    monkeypatch.setattr(scratch, "save", lambda df, label="table": labels.append(label) or save(df, label))
    sets = [{1000 * (k // 2) + j << 24 for j in range(10)} for k in range(400)]
    links = [(k, k // 40 * 40) for k in range(400) if k % 40] + [(k, k + 40) for k in range(0, 360, 40)]
    assert _across(spark, links, sets, compared) == [(k, k // 2 * 2) for k in range(400)]
    assert labels.count("across") > 1  # 9 blocks a star: more than four times the contents is not sent at once
