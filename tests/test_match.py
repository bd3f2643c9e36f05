import random

import pytest
from pyspark.sql import functions as F

from spanloom.errors import IncompatibleMetadataError, QueryError
from spanloom.functions import text as T
from spanloom.operators import concordance as K
from spanloom.operators import match as M
from spanloom.operators import metadata as D
from spanloom.operators import speech as P
from spanloom.search import Search

LINES = [(1, 0, "ær is Ær here"), (1, 1, "a b a b c"), (1, 2, "c a"), (2, 0, "b x y c b c"), (2, 1, ""), (2, 2, "a x b c c")]


@pytest.fixture(scope="module")
def micro(spark):
    rows = [(t, s, line.split(), line.upper().split()) for t, s, line in LINES]
    return spark.createDataFrame(rows, "text_id long, s_no int, word array<string>, lemma array<string>")


def spans(df):
    return sorted((r.text_id, r.s_no, r.first, r.last) for r in df.select("text_id", "s_no", F.col("first"), F.col("last")).collect())


def test_spans(micro):
    assert spans(M.match(micro, '[word="a"] [word="b"]')) == [(1, 1, 0, 1), (1, 1, 2, 3)]
    assert spans(M.match(micro, '[word="Ær" %c]')) == [(1, 0, 0, 0), (1, 0, 2, 2)]
    assert spans(M.match(micro, '[word="b"] []{0,2} [word="c"]')) == [(1, 1, 1, 4), (1, 1, 3, 4), (2, 0, 0, 3), (2, 0, 4, 5), (2, 2, 2, 3)]
    assert spans(M.match(micro, '<s> [word="a"]')) == [(1, 1, 0, 0), (2, 2, 0, 0)]
    assert spans(M.match(micro, '[word="c"] </s>')) == [(1, 1, 4, 4), (2, 0, 5, 5), (2, 2, 4, 4)]
    assert spans(M.match(micro, '[word="c"] [word="a"]')) == [(1, 2, 0, 1)]  # never across sentences
    assert spans(M.match(micro, '([word="a"] | [word="x"]) [word="b"]')) == [(1, 1, 0, 1), (1, 1, 2, 3), (2, 2, 1, 2)]
    with pytest.raises(QueryError):
        M.match(micro, '[nothing="a"]')


def test_strategies_agree(micro):
    rng = random.Random(4)
    tokens = micro.select("text_id", "s_no", F.posexplode("word").alias("i", "word"))
    for _ in range(6):
        q = " ".join(rng.choice(['[word="a"]', '[word="b"]', "[]", '[word="c|x"]', '[word!="a"]']) for _ in range(rng.randint(1, 3)))
        fixed = spans(M.match(micro, q, strategy="array"))
        assert fixed == spans(M.match(micro, q, strategy="classes"))
        assert fixed == spans(M.match_by_windows(tokens, q))


def test_union_is_distinct(micro):
    both = spans(M.match_any(micro, ['[word="a"]', '[word="b"]', '[word="a"]']))
    assert both == sorted(set(spans(M.match(micro, '[word="a"]'))) | set(spans(M.match(micro, '[word="b"]'))))


def test_pages_join_up(micro):
    hits = M.match(micro, "[]")
    whole = [r.asDict() for r in K.sort(hits, "left").collect()]
    parts = [r.asDict() for n in range(1, 5) for r in K.page(hits, n, 6, "left").collect()]
    assert whole == parts
    assert {r.page for r in K.pages(hits, [1, 3], 5).select("page").collect()} == {1, 3}
    assert [r.hits for r in K.progressive_counts(hits, 1).orderBy("step").collect()] == [1, 20, len(whole)]


def test_context(micro):
    r = K.with_context(M.match(micro, '[word="c"] [word="a"]'), micro, 2).first()
    assert (r.before, r.after) == ("a b a b c", "")


def test_search_and_metadata(spark, micro):
    cells = spark.createDataFrame([(1, "tid", "t1"), (1, "lang", "no"), (2, "tid", "t2"), (2, "lang", "en")], "text_id long, category string, value string")
    found = Search(micro, [{"query": '[word="a"]'}], cells, {"lang": ["en"]})
    assert found.count() == 1 and found.run(1).first()["right"] == "x b c c"
    with pytest.raises(IncompatibleMetadataError):
        Search(micro, [{"query": '[word="a"]'}], cells, {"lang": ["xx"]}).hits()
    with pytest.raises(QueryError):
        Search(micro, [{"query": ""}]).hits()
    new = spark.createDataFrame([("t2", 5), ("t9", 7)], "tid string, startpos long")
    old = spark.createDataFrame([(2, "t2", 1)], "text_id long, tid string, startpos long")
    assert {(r.tid, r.startpos) for r in D.upsert_texts(old, new).collect()} == {("t2", 5), ("t9", 7)}


def test_runs_cross_buckets(spark):
    keys = spark.createDataFrame([(k, "a" if k < 5 else "b" if k < 9 else "a") for k in range(12)], "line_key int, basename string")
    assert sorted(tuple(r) for r in D.runs(keys, 3).collect()) == [("a", 0, 4), ("a", 9, 11), ("b", 5, 8)]


def test_segments_and_window(spark):
    line = "<sync_time 1.5><sync_end 2.0><who_name a_b><who_line_key 7>hei {{du}}</who_line_key></who_name></sync_end></sync_time>"
    r = P.parse_segments(spark.createDataFrame([(line,)], "line string")).first()
    assert (r["from"], r["to"], r.speaker, r.line_key, r.said, r.is_match) == ("1.5", "2.0", "a_b", "7", "hei {{du}}", True)
    segs = spark.createDataFrame([(1, k, "x", str(k), str(k + 1), ["w"]) for k in range(6)], "file int, seg int, speaker string, `from` string, `to` string, word array<string>")
    objects = P.media_objects(spark.createDataFrame([(1, 1)], "file int, seg int"), segs)
    w = P.overlapping(P.player_window(objects, 2)).first()
    assert (w.window_start, w.window_end, len(w.window), len(w.overlaps)) == (0, 3, 4, 0)


def test_scalars(spark):
    row = spark.createDataFrame([("{{<s_id 1>went>", "12abc", "yes", "ma1 hao3 lou2")], "a string, b string, c string, d string")
    r = row.select(T.braces_inside(F.col("a")).alias("a"), T.to_integer(F.col("b")).alias("b"), T.searched_boolean(F.col("c")).alias("c"), T.pinyin(F.col("d")).alias("d"), T.clock(F.lit(75.25)).alias("e")).first()
    assert tuple(r) == ("<s_id 1>{{went>", 12, True, "mā hǎo lóu", "1.15.2")


def test_anchors_reach_the_region(micro):
    region = {"headword": (F.lit(0), F.lit(2))}
    assert spans(M.match(micro, '<headword> [word="a"] []{0,} </headword>', region)) == [(1, 1, 0, 2), (2, 2, 0, 2)]
    assert spans(M.match(micro, '[word="b"] within headword', region)) == [(1, 1, 1, 1), (2, 0, 0, 0), (2, 2, 2, 2)]
    assert spans(M.match_any(micro, ['<s> [word="a"]', '[word="x"]'])) == [(1, 1, 0, 0), (2, 0, 1, 1), (2, 2, 0, 0), (2, 2, 1, 1)]
    assert spans(M.match(micro, '(<s> [word="a"]) within s | ([word="x"]) within s')) == spans(M.match_any(micro, ['<s> [word="a"]', '[word="x"]']))
    with pytest.raises(QueryError):
        M.match(micro, '[word="a"] within nothing')
    many = " ".join(f'[word="w{k}|b"]?' for k in range(9))
    assert spans(M.match(micro, f'[word="x"] {many} [word="c"]')) == [(2, 2, 1, 3)]


def test_aligned_rows(micro):
    pairs = micro.sparkSession.createDataFrame([(1, s, 2, s) for s in range(3)], "text_id long, s_no int, other_text_id long, other_s_no int")
    one, two = micro.where("text_id = 1"), micro.where("text_id = 2")
    found = M.aligned_rows(one, {"no": (two, pairs), "ru": (two, pairs)}, '"is" :RUN_NO "x" :RUN_RU []')
    assert [(r.s_no, r.first, r.word_ru) for r in found.collect()] == [(0, 1, "b x y c b c".split())]
    search = Search(one, [{"lang": "en", "query": '"is"'}, {"lang": "no", "query": '"zzz"'}], others={"no": (two, pairs)})
    assert search.hits().collect() == []


def test_runs_over_buckets(micro):
    keys = [(k, "abb"[k // 7 % 3]) for k in range(0, 100, 3)]
    got = D.runs(micro.sparkSession.createDataFrame(keys, "line_key long, basename string"), bucket=5).orderBy("line_key_begin").collect()
    starts = [(k, b) for (k, b), (_, before) in zip(keys, [(0, None), *keys[:-1]], strict=True) if b != before]
    ends = [k - 1 for k, _ in starts[1:]] + [99]
    assert [(r.line_key_begin, r.line_key_end, r.basename) for r in got] == [(k, e, b) for (k, b), e in zip(starts, ends, strict=True)]


def test_stream_ingest(spark, tmp_path):
    from spanloom.streaming import ingest as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("t1\ten\nt2\t\\N\nt1\ten\n")
    stream.append(stream.metadata_stream(spark, f"{tmp_path}/in", ["tid", "lang"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert sorted((r.tid, r.lang) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("t1", "en"), ("t2", None)]
