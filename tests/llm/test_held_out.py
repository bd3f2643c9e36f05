"""Held-out accuracy, recall, brute force on small fixtures, empty tables and rows in any order."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, embed_dedup, html_extract, langid, licenses, line_dedup, linking, ngram_join, packing, quality, queries, scratch


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert all(held_out(r.doc_id) for r in rows)
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_language_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").collect()
    lettered = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    assert len(lettered) > 100 and all(held_out(r.doc_id) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in lettered]) > 0.97
    assert all(r.lang_pred == "und" for r in rows if r not in lettered)


def test_quality_cut_where_most_is_bad():
    rng = np.random.default_rng(3)
    good = np.arange(1000) < 100
    x = np.stack([rng.normal(good * 6.0), rng.normal(size=1000)], axis=1)
    model = quality.fit(x, good)
    assert ((model.score(x) >= quality.CUT) == good).mean() > 0.98


def test_recall_of_near_lines(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts, near = [], []
    for k in range(600):
        line = " ".join(word() for _ in range(rng.randint(12, 50)))
        other = list(line)
        for _ in range(rng.randint(1, max(1, len(line) // 90))):
            other[rng.randrange(len(other))] = rng.choice("xyz")
        texts.append((2 * k, line)), texts.append((2 * k + 1, "".join(other)))
        a, b = (line_dedup.shingle_set(t.encode(), line_dedup.SHINGLE) for t in (line, "".join(other)))
        near.append(len(a & b) / len(a | b) >= 0.8)
    kept = {r.doc_id for r in line_dedup.line_components(spark.createDataFrame(texts, "doc_id long, text string")).where("keep").select("doc_id").collect()}
    caught = [2 * k + 1 not in kept for k in range(600)]
    assert sum(near) > 200 and np.mean([c for c, n in zip(caught, near, strict=True) if n]) >= 0.985
    assert not any(c for c, n in zip(caught, near, strict=True) if not n)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(k, "".join(rng.choice("abc ") for _ in range(rng.randint(20, 70))).strip()) for k in range(8)]
    docs = []
    for k in range(60):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 200)))
        if k % 2:
            item = list(items[k % 8][1])
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(item))
                item[i : i + 1] = rng.choice([[], ["z"], [item[i], "q"]])
            at = rng.randint(0, len(text))
            text = text[:at] + "".join(item).upper() + text[at:]
        docs.append((k, text))

    def least(item, text):  # the plain table of edit distances, free at both ends of the text
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != t)))
            row = new
        return min(row)

    expected = set()
    for d, text in docs:
        for k, item in items:
            plain = decontaminate.normal(item)
            if least(plain, decontaminate.normal(text)) <= int(len(plain) * decontaminate.RATE):
                expected.add((d, k))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(expected) > 5
    assert {r.doc_id for r in decontaminate.clean(frame, bench, most=100).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (4, [1.0, 0.0], 1)]
    got = embed_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in got) == [(-1, 0, -1, True), (1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 1, False)]


def test_chat_parts_in_any_order(spark, tmp_path):
    rows = [(c, t, ["user", "assistant"][t % 2], f"</s>[INST] {c} {t}") for c in (1, 2, None, -(1 << 62)) for t in range(9)]
    parts = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    expected = sorted(map(str, chat.read_back(parts).collect()))
    parts.repartition(7).write.parquet(f"{tmp_path}/parts")
    assert len(expected) == 4 and sorted(map(str, chat.read_back(spark.read.parquet(f"{tmp_path}/parts")).collect())) == expected


def test_html_in_linear_time():
    weights = html_extract.learned_weights()
    for page in ("<font>word " * 100_000, '<div class="q">' * 100_000 + "</b></i>" * 100_000, "<p>a<li>b" * 50_000):
        began = time.process_time()
        html_extract.extract(page, weights)
        assert time.process_time() - began < 8


def test_html_of_plain_names():
    weights = html_extract.learned_weights()
    text = "This is a real article, with sentences that go on for a while. It has several of them, and they are long enough."
    menu = "<nav><a>Home</a><a>News</a></nav>"
    assert html_extract.extract(f'{menu}<div id="x1"><p>{text}</p></div><footer>2020</footer>', weights) == text
    adverts = '<div class="ad">Buy now</div>' * 400
    assert html_extract.extract(f'{menu}<div class="content"><p>{text}</p>{adverts}<p>{text}</p></div>', weights) == f"{text}\n\n{text}"
    assert html_extract.extract(f'<main><p>{text}</p><div class="comments"><p>{text}</p></div></main>', weights) == text


def test_other_vocabularies_are_used_as_they_are(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"A": 1, "a": 2, "b": 3, "?": 0}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    plain.save(f"{tmp_path}/words.json")
    tokenizer = packing.WordTokenizer(f"{tmp_path}/words.json")
    assert not tokenizer.by_word and [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode([b"A a b", b"", b"c A"])] == [[1, 2, 3], [], [0, 1]]


def test_words_of_letters_together():
    ours, plain = packing.WordTokenizer(queries.vocabulary(), cache=20), packing.WordTokenizer(queries.vocabulary()).tokenizer
    texts = ["İstanbul ǅ ﬁne ﬂ café café ß ẞ Ⅷ ª", "x's don't we'll <|endoftext|> a<|endoftext|>. it's, ok", "a b c d\x85e\x1cf 12.5% 3rd!? 漢字 かな 한국어 हिन्दी", ""]
    assert ours.by_word
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, sig long, id long, x string, line int, label string")
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string, seq long")
    labels, bench = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    assert quality.train(docs, labels) is None and langid.train(docs) is None
    for out in (
        ngram_join.jaccard_components(docs), line_dedup.line_report(docs), line_dedup.drop_repeated_lines(docs), quality.score(docs, None), langid.predict(docs, None), packing.pack(docs, queries.vocabulary()),
        licenses.scan(docs), decontaminate.matches(docs, bench), decontaminate.clean(docs, bench), chat.read_back(chat.format_turns(turns)), html_extract.main_text(pages),
    ):
        assert out.count() == 0


def test_clashing_columns_do_no_harm(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven", 3, "d")], "item_id long, text string, distance int, doc_id string")
    docs = spark.createDataFrame([(1, "so ONE two three four five six  seven eight", 9, 0.5)], "doc_id long, text string, item_id long, distance double")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, bench).collect()] == [(1, 1, 0)]
    vectors = spark.createDataFrame([(k, [1.0, 0.1 * k], 0, k, "q") for k in range(3)], "vec_id long, embedding array<double>, label int, id int, vector string")
    assert embed_dedup.embedding_components(vectors).count() == 3
    pages = spark.createDataFrame([(1, "u", "<p>a b c d</p>", "own")], "page_id long, url string, html string, text string")
    assert html_extract.main_text(pages).columns == ["page_id", "url", "text"]
    turns = spark.createDataFrame([(1, 0, "user", "a", 5, "f")], "conv_id long, turn long, role string, text string, seq int, formatted string")
    assert chat.read_back(chat.format_turns(turns)).first().n_turns == 1


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Session())


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """A group of many near copies, in several blocks, against brute force."""
    monkeypatch.setattr(linking, "BLOCK", 10)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(116)} for k, t in rows}
    parent = {k: k for k in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), small=2).select("doc_id", F.col("component_id")).collect()}
    assert got == {k: root(k) for k in sets} and len(set(got.values())) > 1
