"""Every operator against brute force and on hostile rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from spanloom.llm import chat, decontaminate, embed_dedup, html_extract, langid, licenses, line_dedup, linking, ngram_join, packing, quality, queries, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, x string, sig long"


def rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    base = [word() for _ in range(60)]
    out = []
    for k in range(40):  # near copies at several distances, and copies
        words = list(base) if k % 2 else [word() for _ in range(rng.randint(1, 80))]
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words) + ("\n" + " ".join(base[:12]) if k % 5 == 0 else ""))
    out += [None, "", "   ", "\n\n", "one", "One", "a b c d", "A  b\tc d", "x" * 300_000, "y " * 50_000, *out[:6], "..."]
    return [(k, t, "en" if k % 3 else None, "s", len(t or ""), k % 2, None, 5) for k, t in enumerate(out)] + [(None, out[0], None, None, None, 1, "z", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return scratch.save(spark.createDataFrame(rows(), SCHEMA).repartition(3))


def union(n, links):
    parent = {k: k for k in n}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in n}


@pytest.mark.parametrize("options", [{}, {"small": 2}, {"small": 2, "n2": 1, "k2": 0}])
def test_ngram_components(docs, options):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows() if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = union(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, **options).where("doc_id is not null").collect()}
    assert got == {k: (len(sets[k]), expected[k]) for k in sets}


@pytest.mark.parametrize(("n2", "k2"), [(1, 0), (2, 1), (3, 1), (4, 2)])
def test_room_for_empty_partitions(n2, k2):
    """What a set decides by itself holds for each size that a partner may have."""
    for edge in range(9):
        for cross in (0, 1):
            n1, low, parts, room = ngram_join._sizes(edge, cross, 80, 100, n2, k2, ngram_join.SHARED)
            for a in range(low, low + len(parts)):
                for b in range(low, low + len(parts)):
                    if 100 * min(a, b) >= 80 * max(a, b) and not (cross and (a <= 1 << edge) == (b <= 1 << edge)):
                        sure = min(parts[a - low], parts[b - low]) - (a + b) * 20 // 180 // (k2 + 1)
                        assert parts[a - low] <= n1 and room[a - low] <= sure - ngram_join.SHARED


def shared_signatures(a, b, **options):
    """(even, odd) signatures that two sets have in common."""
    ids, per = np.array([0, 1]), np.array([0, len(a), len(a) + len(b)])
    sig, who = ngram_join.signatures(np.concatenate([np.sort(a), np.sort(b)]), per, ids, **options)
    both = np.intersect1d(sig[who == 0], sig[who == 1])
    return int((both & 1 == 0).sum()), int((both & 1).sum())


@pytest.mark.parametrize(("n2", "k2"), [(1, 0), (2, 1), (3, 1)])
def test_signatures_of_adversarial_sets(n2, k2):
    """Similar sets share enough signatures when their features crowd a few partitions and their
    differences, as many as there can be, spread over all."""
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2)
    for trial in range(300):
        a = int(rng.integers(4, 400))
        least, greatest = -(-a * 80 // 100), a * 100 // 80
        b = int(rng.choice([a, greatest, rng.integers(least, greatest + 1), least]))
        n1 = ngram_join._sizes(int(np.ceil(np.log2(max(a, b)))), 0, 80, 100, n2, k2, 3)[0]
        cell = ngram_join._cells(pool, n1, n2)[0]
        spread = pool[np.unique(cell, return_index=True)[1]]
        rng.shuffle(spread)
        crowded = pool[cell < max(1, int(n1 * rng.random()))] if trial % 3 else pool[rng.permutation(len(pool))]
        d = (a + b) * 20 // 180
        common = (a + b - d + 1) // 2
        both = np.setdiff1d(crowded, spread)[: 4 * common]
        rng.shuffle(both)
        if len(both) < common or len(spread) < a + b - 2 * common:
            continue
        both = both[:common]
        x = np.concatenate([both, spread[: a - common]])
        y = np.concatenate([both, spread[a - common : a + b - 2 * common]])
        assert 100 * common >= 80 * (len(x) + len(y) - common)
        usual = np.sort(both[: int(rng.integers(0, common))]) if trial % 2 else None
        even, odd = shared_signatures(x, y, n2=n2, k2=k2, common=usual)
        assert even >= ngram_join.SHARED or odd


def test_components_in_rounds(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1400)] + [(k, k + 1) for k in range(4000, 4200)] + [(9000, 5000 + k) for k in range(500)]
    expected = union({v for e in edges for v in e}, edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7).cache()
    for most in (0, 10**6):
        got = {r.id: r.comp for r in linking.components(frame, most=most).collect()}
        assert got == {v: expected[v] for v in {v for a, b in edges if a != b for v in (a, b)}}
    with pytest.raises(RuntimeError):
        linking.components(frame, rounds=1, most=0)


def test_lines(docs):
    strip = " \t\n\r\x0b\x0c"
    lines = {(r[0], n): re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip)) for r in rows() if r[0] is not None for n, x in enumerate((r[1] or "").split("\n")) if x.strip(strip)}
    texts = sorted(set(lines.values()))
    sets = [line_dedup.shingle_set(t.encode(), 8) for t in texts]
    links = [(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = union(range(len(texts)), links)
    first = {}
    for k in sorted(lines):
        first.setdefault(comp[texts.index(lines[k])], k)
    expected = {k: first[comp[texts.index(v)]] == k for k, v in lines.items()}
    got = {(r.doc_id, r.line): r.keep for r in line_dedup.line_components(docs).where("doc_id is not null").collect()}
    assert got.keys() == expected.keys()
    assert sum(got[k] != expected[k] for k in got) <= 0.02 * len(got)  # MinHash recall
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 40").count() == 1  # null text stays
    report = line_dedup.line_report(docs)
    assert report.count() == docs.count()


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 16))
    table = []
    for k in range(240):
        v = base[k % 6] + rng.standard_normal(16) * [0, 0.02, 0.08, 0.15, 1][k % 5]
        table.append((k, [float(x) for x in v.astype(np.float32)], k % 2))
    table += [(240, None, 1), (241, [0.0] * 16, 1), (242, [float("nan")] * 16, 1), (243, table[0][1], None), (244, [], 0), (245, table[0][1], 0), (246, [None] * 16, 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    good = {k: (lab, np.array(v) / np.linalg.norm(v)) for k, v, lab in table[:240] + [table[245]]}
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and good[a][1] @ good[b][1] >= 0.98]
    comp = union([t[0] for t in table], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_components(df, block=16).collect()}
    assert got == {t[0]: (sum(t[0] in x for x in links), comp[t[0]], comp[t[0]] == t[0]) for t in table}
    assert embed_dedup.embedding_components(df.limit(0)).count() == 0


def test_quality(docs, spark, data):
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality.train(d, labels)
    scored = quality.score(d, model).join(labels, "doc_id").toPandas()
    assert ((scored.score >= quality.CUT) == (scored.quality == 1)).mean() > 0.95
    assert quality.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert quality.train(docs, labels.limit(0)) is None and quality.keep_good(docs, model).columns == docs.columns
    assert 0 <= quality.score_quantile(quality.score(d, model), 0.1) <= 1


def test_gradients_through_time():
    net = langid.new_network(["a", "b"], hidden=3)
    for p in (net.ahead, net.behind):
        p.table, p.back = p.table.astype(np.float64), p.back.astype(np.float64)
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    x, y = np.array([[1, 2], [3, 1], [2, 2]], np.uint8), np.array([0, 1])
    _, grads = net.gradients(x, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = p[at]
        p[at] = old + 1e-3
        up = net.gradients(x, y)[0]
        p[at] = old - 1e-3
        down = net.gradients(x, y)[0]
        p[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 2e-2 * abs(g[at]) + 1e-4


def test_language(docs, spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(d, queries._fold() != 0)
    r = langid.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.9
    found = {x.doc_id: x.lang_pred for x in langid.predict(docs, model).collect()}
    assert found[40] == found[41] == found[42] == found[56] == "und"


def test_packing(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary())
    got = packing.pack(docs.where("doc_id is not null"), queries.vocabulary()).toPandas()
    for k, text, *_ in rows():
        if k is not None and k not in (48, 49):
            ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            mine = got[got.doc_id == k].sort_values("piece")
            assert mine.length.sum() == len(ids) and (mine.length[:-1] == 2048).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert packing.pack(docs.limit(0), queries.vocabulary()).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 60))), reverse=True)
        gaps = []
        for s in sizes:  # sequential best-fit
            fits = [k for k, g in enumerate(gaps) if g >= s]
            k = min(fits, key=lambda i: gaps[i]) if fits else len(gaps)
            if not fits:
                gaps.append(20)
            gaps[k] -= s
        placed = packing.plan({s: sizes.count(s) for s in set(sizes)}, 20)
        used = {}
        for k, (size, rank, first, each, offset) in enumerate(placed):
            after = [r for s, r, *_ in placed if s == size and r > rank]
            for n in range((min(after) if after else sizes.count(size)) - rank):
                used.setdefault(first + n // each, []).append((offset + n % each * size, size))
        for spans in used.values():
            spans.sort()
            assert all(a + s == b for (a, s), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= 20
        assert len(used) == len(gaps)


def test_licenses(spark, docs):
    text = "Copyright (c) 2020 Someone\n  permission to use, COPY, modify and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + licenses.KNOWN[5][1].split("copies. ", 1)[1]
    df = spark.createDataFrame([(1, text), (2, "hm\nReleased under the MIT Licence!\nAll rights reserved"), (3, None), (4, ""), (5, "...")], "doc_id long, text string")
    got = {r.doc_id: (r.whole_license, r.line_licenses) for r in licenses.scan(df).collect()}
    assert got == {1: ("ISC", "ISC"), 2: (None, "LicenseRef-all-rights-reserved,MIT"), 3: (None, ""), 4: (None, ""), 5: (None, "")}
    assert licenses.scan(docs).count() == docs.count()


def test_decontamination(spark, docs):
    rng = random.Random(3)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    edited = item[:50] + "Q" + item[52:120] + item[121:]
    far = "".join(c if rng.random() > 0.2 else "z" for c in item)
    df = spark.createDataFrame([(1, "a " + item.upper().replace(" ", "\n") + " b"), (2, edited), (3, far), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()} == {(1, 7), (1, 10), (2, 7), (2, 10)}
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench, most=100).collect()) == [3, 4, 5]
    assert decontaminate.clean(docs, bench).count() == docs.count()

    def distance(p, t):  # least over all substrings, by the full table
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row, best = new, min(best, new[-1])
        return best

    for _ in range(200):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(2))
        assert decontaminate.myers(p, t)[0] == distance(p, t)


def test_chat_round_trip(spark):
    odd = ["<\\s>", "</s>\n", "[INST", "]", "<", "[/INST] x [\\/INST]", "", None, "<\\\\s>", "é" * 70_000, "\\"]
    table = [(k % 3 if k else None, k, ["user", "assistant", "system", None, "<s>"][k % 5], t) for k, t in enumerate(odd * 3)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))).collect()}
    for c in {t[0] for t in table}:
        turns = sorted((t for t in table if t[0] == c), key=lambda t: t[1])
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in turns)
        loss = "".join(x or "" for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_html():
    w = html_extract.learned_weights()
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>First   para<br>two &eacute;</p><div class="ad">Buy now please</div><p>Second <a href=y>linked</a> para.</p><form>Name <input></form></article>
    <section id="comments"><p>Nice article, thanks</p></section><aside>Other things</aside><footer>&copy; me</footer></body></html>"""
    assert html_extract.extract(page, w) == "Head & line\n\nFirst para two é\n\nSecond linked para."
    assert html_extract.extract(None, w) == html_extract.extract("", w) == ""
    assert html_extract.extract("<p>cut off <b>here", w) == "cut off here"
    good = total = 0
    for page, marks in html_extract.labelled_pages(60, seed=99):
        runs = [t for t, c, _ in html_extract.scan(page, {}) if t is not None]
        text = html_extract.extract(page, w)
        for run, mark in zip(runs, marks, strict=True):
            total += 1
            good += (run in text) == mark
    assert good / total > 0.9


def test_registered(spark, data):
    for name in ("op3_line_dedup", "op5_language_id", "op8_benchmark_decontamination", "op10_html_extraction"):
        assert queries.queries()[name](spark, data).columns


def test_pipeline(spark, data):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, data).toPandas()
    assert len(out) and out.groupby("sequence_id").length.sum().max() <= 2048


def test_ngram_stage_keeps_by_row(spark):
    import corpus_pipeline

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = [" ".join(word() for _ in range(60)) for _ in range(7)]
    near = [t + " end" for t in text]
    table = [
        (1, text[0]), (2, near[0]),  # near copies: the least doc_id stays
        (3, text[1]), (3, text[2]), (4, near[2]),  # a repeated doc_id with different texts
        (0, text[3]), (5, near[3]), (5, text[4]),  # one text of doc_id 5 is a near copy, the other is not
        (None, text[5]), (None, near[5]), (None, text[6]), (None, near[0]),  # null ids
        (6, text[6] + " z"), (7, None), (7, ""), (None, None), (8, text[1]), (8, text[1]),
    ]
    docs = scratch.save(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    got = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_stage(spark, docs, "").collect()]
    either = [(None, text[5]), (None, near[5])]
    assert sum(got.count(x) for x in either) == 1
    expected = [table[k] for k in (0, 2, 3, 5, 7, 12, 13, 14, 15)]
    assert sorted((x for x in got if x not in either), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("holder", ["article", 'div class="content"', "main", "body"])
def test_html_short_head_and_tail(holder):
    links = "".join(f"<li><a href=x>word{k}</a></li>" for k in range(30))
    between = [f'<ul class="menu">{links}</ul>', f'<div class="share">{links}</div>', f"<form>{'<label>Your name</label><input>' * 20}</form>", f'<div class="related">{links}</div>', f"<section id=comments>{'<p>Nice one</p>' * 40}</section>"]
    body = "".join(f"<p>{'some long text of the article ' * 4}{k}</p>" for k in range(2))
    for x in between:
        for y in between:
            inner = f"<h1>Two words</h1>{x}{body}{y}<p>The very end</p>"
            page = f"<nav><a href=x>Home</a></nav><{holder}>{inner}</{holder.split()[0]}><footer><p>Imprint</p></footer>"
            got = html_extract.extract(f"<html>{page}</html>" if holder == "body" else f"<html><body>{page}</body></html>", html_extract.learned_weights()).split("\n\n")
            assert got[0] == "Two words" and got[-1] == "The very end" and len(got) == 4


def test_html_raw_elements():
    w = html_extract.learned_weights()
    first, last = "<p>first part of the article text</p>", "<p>last part of the article text</p>"
    read = lambda inner: html_extract.extract(f"<html><body><article>{first}{inner}{last}</article></body></html>", w).split("\n\n")
    ends = ["first part of the article text", "last part of the article text"]
    for inner in ("<svg/>", '<svg width="1" />', "<svg viewBox='0 0 1 1'/>", "<math/>", "<template-card></template-card>", "<select-box></select-box>", "<svg><text>no</text></svg>", '<svg a="/">no</svg>', "<select><option>no</select>", "<SCRIPT>no</script>", "<style/>no</style>"):
        assert read(inner) == ends
    assert html_extract.extract(f"<html><head><svg/></head><body><article>{last}</article></body></html>", w) == ends[1]
    for name in ("noscript", "object", "canvas"):
        assert read(f"<{name}><p>inside the element here</p></{name}>") == [ends[0], "inside the element here", ends[1]]
    assert read("<p>let <math><mi>x</mi></math> be a number</p>")[1].split() == "let x be a number".split()


def kept_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "n_chars").collect()), key=str)


def given(keep):
    return sorted(((k, t, lang, n) for k, t, lang, _, n, *_ in rows() if keep(k, t)), key=str)


def test_quality_and_benchmark_stages_by_row(docs, spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(k, k % 2) for k in range(56)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r.text: r.score for r in quality.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert kept_rows(corpus_pipeline.quality_stage(spark, docs, str(tmp_path))) == given(lambda k, t: scores[t] >= quality.CUT)
    item = " ".join(rows()[1][1].split()[20:40])
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pattern, budget = decontaminate.normal(item), int(len(decontaminate.normal(item)) * decontaminate.RATE)
    got = kept_rows(corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)))
    assert got == given(lambda k, t: decontaminate.myers(pattern, decontaminate.normal(t))[0] > budget) and len(got) < len(rows())


def test_ngram_stage_on_hostile_rows(docs, spark):
    import corpus_pipeline

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(r[1]) for r in rows()]  # rows come by doc_id, null last
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = union(range(len(sets)), links)
    first = {rows()[k][0] for k in comp if comp[k] == k}
    assert kept_rows(corpus_pipeline.ngram_stage(spark, docs, "")) == given(lambda k, t: k in first)


def test_line_stage_keeps_what_lines_keep(docs, spark):
    import corpus_pipeline

    keep = {(r.doc_id, r.line): r.keep for r in line_dedup.line_components(docs).collect()}
    expected = []
    for k, t, lang, _, n, *_ in rows():
        lines = (t or "").split("\n")
        left = [x for i, x in enumerate(lines) if keep.get((k, i), True)]
        if len(left) == len(lines):
            expected.append((k, t, lang, n))
        elif any(x.strip(" \t\n\r\x0b\x0c") for x in left):
            expected.append((k, "\n".join(left), lang, len("\n".join(left))))
    assert kept_rows(corpus_pipeline.line_stage(spark, docs, "")) == sorted(expected, key=str)


def test_packing_stage_of_long_texts(docs, spark):
    import zlib

    import corpus_pipeline
    from tokenizers import Tokenizer

    plain, expected = Tokenizer.from_file(queries.vocabulary()), []
    for k, text, *_ in rows():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(k, i, lo, len(ids[lo : lo + 2048]), zlib.crc32(ids[lo : lo + 2048].tobytes())) for i, lo in enumerate(range(0, len(ids), 2048))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.packing_stage(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
