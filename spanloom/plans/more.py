"""Further registered queries: rewrites and scalar functions on written cases, whose SQL holds
the expected values, and operators over the driver's tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IncompatibleMetadataError, QueryError
from ..functions import cqp, text as T
from ..operators import concordance as K
from ..operators import match as M
from ..operators import metadata as D
from ..operators import speech as P
from ..operators import statistics as S
from ..search import Search
from ..sources import ingest, package, results
from . import corpus as C
from .registry import EAV, PAIR, SPEECH, TOK, _ALIGN, _PHRASE, _SPAN, _cells, _objects, _phrase, _sentences, _speech, query


def _quoted(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS t({names})"


def _rewrites(name: str, rewrite: Callable, cases: list[tuple]) -> None:
    """Registers a function of Python values: (given, result) of each case against what is written here."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(json.dumps(given, ensure_ascii=False), rewrite(given)) for given, _ in cases]
        return spark.createDataFrame(rows, f"given string, result {'long' if isinstance(cases[0][1], int) else 'string'}")

    run.__name__ = name
    query(_values([(json.dumps(given, ensure_ascii=False), expected) for given, expected in cases], "given, result"))(run)


def _columns(name: str, function: Callable[[Column], Column], cases: list[tuple], kind: str = "string") -> None:
    """Registers a function of a column in the same way."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(given,) for given, _ in cases], f"given {kind}")
        return rows.select("given", function(F.col("given")).alias("result"))

    run.__name__ = name
    query(_values(cases, "given, result"))(run)


def _failing(text: str) -> str:
    try:
        return cqp.text_of(cqp.parse(text))
    except QueryError:
        return "error"


# -- the query language -----------------------------------------------------------

_rewrites("cqp_from_phrase", cqp.from_phrase, [("han ", '[word="han" %c]'), ("你好 ja", '[word="你" %c] [word="好" %c] [word="ja" %c]'), ("  ", '[word=".*" %c]')])
_rewrites("cqp_normalise", cqp.normalise, [('[word=".*" %c]', ""), ('[word="a" %c] [word=".*" %c]', '[word="a" %c] []'), ("[]", "")])
_rewrites("cqp_guard", lambda q: int(cqp.may_search([{"query": q}])), [('""', 0), ("  ", 0), ('[word="a"]', 1)])
_rewrites("cqp_phonetic", cqp.to_phonetic, [('[word="a" %c]', '[phon="a" %c]'), ("", '[phon=".*" %c]'), ('[word="a"] [lemma="b"]', '[phon="a"] [lemma="b"]')])
_rewrites("cqp_headword", cqp.with_headword, [('[word="a"]', '<headword>[word="a"] []{0,}</headword>'), ('<headword>[word="b"] []{0,}</headword>', '<headword>[word="b"] []{0,}</headword>')])
_rewrites("cqp_without_headword", cqp.without_headword, [('<headword>[word="a"] []{0,}</headword>', '[word="a"]'), ('[word="a"]', '[word="a"]')])
_rewrites("cqp_split_terms", lambda q: " ; ".join(cqp.split_terms(q)), [('"a" []{1,2} [lemma="b]" & pos="n"] []', '"a" ; []{1,2} ; [lemma="b]" & pos="n"] ; []'), ("", "")])
_rewrites(
    "cqp_read_terms",
    lambda q: " ; ".join(f"{t.form} {t.pos} {'l' * t.lemma}{'p' * t.phonetic}{'s' * t.start}{'e' * t.end} {t.least},{t.most} {t.features}" for t in cqp.read_terms(q)),
    [('[]{1,2} [(lemma="car.+" & pos="n")]', "car n ls 1,2 []"), ('[word=".+ing" %c] []{0,} [phon="x" & num="pl"]', "ing None e None,None [] ; x None p 0,None [('num', 'pl')]")],
)
_rewrites("cqp_write_terms", lambda q: cqp.write_terms(cqp.read_terms(q)), [('[]{1,2} [lemma="car.+" & pos="n"]', '[]{1,2} [lemma="car.+" %c & pos="n"]'), ('[pos="n" & num="pl"] []{0,3} "b"', '[pos="n" & num="pl"] []{0,3} [word="b" %c]')])
_rewrites("cqp_tones", lambda q: cqp.with_tones(q, "zh"), [('[phon="ma" %c]', '[phon="ma[1-4]?" %c]'), ('[phon="ma3"]', '[phon="ma3"]'), ('[word="ma"]', '[word="ma"]')])
_rewrites("cqp_to_phrase", cqp.to_phrase, [('[word="of" %c] [word="the" %c]', "of the"), ('"a" []', "a .*"), ('[(phon="b")]', "b"), ('[lemma="a"]', '[lemma="a"]')])
_rewrites("cqp_is_simple", lambda q: int(cqp.is_simple(q)), [('[word="of" %c] []', 1), ("", 1), ('[lemma="a"]', 0), ('"a" []{1,2} "b"', 0), ('"a" | "b"', 0), ('<s> "a"', 0)])
_rewrites("cqp_any_of", cqp.any_of, [(["a", "b"], "(a) within s | (b) within s"), (["a"], "a within s")])
_rewrites("cqp_aligned", lambda rows: cqp.aligned("run", rows), [([{"lang": "en", "query": '"she"'}, {"lang": "no", "query": '"hun"'}, {"lang": "ru", "query": '""'}], '"she" :RUN_NO "hun" :RUN_RU []')])
_rewrites("cqp_corpus_name", lambda x: cqp.corpus_name("run", [{"lang": "en"}], x), [(["en", "no"], "RUN_EN"), (["en"], "RUN")])
_rewrites("cqp_add_language", lambda x: " ".join(r["lang"] for r in cqp.add_language([{"lang": c} for c in x], ["en", "no", "ru"])), [(["en"], "en no"), (["en", "ru"], "en ru no"), (["en", "no", "ru"], "en no ru")])
_rewrites(
    "cqp_raw",
    _failing,
    [
        ('[!(word="a" | pos="n")]', '[word!="a" & pos!="n"]'), ('"a" :RUN_NO "b"', '[word="a"] :RUN_NO [word="b"]'), ('[word="é" %cd]', '[word="é" %cd]'), ('[word="\\p{L}+"]', '[word="\\p{L}+"]'),
        ('(<s> "a") within s | ("b") within s', '(<s> [word="a"]) within s | ([word="b"]) within s'), ("[word=]", "error"), ('"a" %x', "error"), ('"(', "error"), ('"a"{3,1}', "error"), ("", "error"),
    ],
)
_rewrites("sql_binding", lambda x: results.bound_sql("SELECT &name FROM #TARGET WHERE a = ?", x, name="rid"), [("#12:0", "SELECT rid FROM #12:0 WHERE a = ?")])
_rewrites("page_count_clip", lambda x: f"{K.page_count(x[0])} {K.clip_page(x[1], K.page_count(x[0]))}", [([100, 9], "2 2"), ([101, 0], "3 1"), ([1, 1], "1 1")])
_rewrites("step_limits", lambda x: str([K.step_cut(k, 50, x) for k in (1, 2, 3)]), [(2000, "[50, 1000, 2000]"), (70, "[50, 70, 70]"), (None, "[50, 1000, None]")])
_rewrites("headword_forces_sort", lambda x: K.search_order([{"headword_search": x}], "left"), [(True, "headword_len"), (False, "left")])
_rewrites("registry_header", lambda x: json.dumps(package.registry_header(x), sort_keys=True), [("# {name: Run, config: {a: 1}}\nx", '{"config": {"a": 1}, "encoding": "utf-8", "name": "Run", "search_engine": "cwb"}')])
_rewrites("corpus_code", ingest.corpus_code, [("RUN_EN2.zip", "run_en"), ("my-corpus.ZIP", "mycorpus")])
_rewrites("cimdi_record", lambda x: package.cimdi(x, {"no": "Norwegian"}), [({"name": "Run", "cimdi": {"languages": ["no"]}}, "<resource><name>Run</name><description>No value given</description><licence>No value given</licence><lingualityType>monolingual</lingualityType><language><id>no</id><name>Norwegian</name></language></resource>")])
_rewrites("language_tags", lambda x: json.dumps(package.languages_with_tags(x, {"obt": {"n": 1}}), sort_keys=True), [([{"lang": "no", "tags": "obt"}, {"lang": "en"}], '[{"lang": "no", "tag_set": {"n": 1}, "tags": "obt"}, {"lang": "en", "tag_set": null}]')])
_rewrites("merged_parameters", lambda x: json.dumps(results.merged_parameters(*x), sort_keys=True), [([{"a": 1, "b": 2}, {"b": 3}], '{"a": 1, "b": 3}')])

# -- scalar functions ---------------------------------------------------------------

_columns("hit_prefix", T.strip_hit_prefix, [("  123: a 4: b", "a 4: b"), ("-->run_no: hun", "hun"), ("plain", "plain")])
_columns("braces_speech", lambda x: T.braces_inside(x, r"(?:who_name|sync_\w+)"), [("{{<sync_time 1><who_name a>went</who_name></sync_time>}} x", "<sync_time 1><who_name a>{{went}}</who_name></sync_time> x"), ("{{a}}", "{{a}}")])
_columns("aligned_line", T.aligned_text, [("<no_id 7>hun går</no_id> <no_id 8>ja</no_id>", "7: hun går 8: ja")])
_columns("speaker_prefix", T.speaker_prefixes, [("<who_name a1><who_line_key 3>hei du</who_line_key></who_name>", "<a1> hei du")])
_columns("pinyin_marks", T.pinyin, [("ni3 hao3", "nǐ hǎo"), ("lv4 dou1 xue2", "lǜ dōu xué"), ("ma5", "ma")])
_columns("humanised_code", T.humanised, [("short_name_id", "Short name"), ("RUN_EN", "Run en")])
_columns("type_names", T.type_name, [("Rg::MetadataValueText", "metadata_value_text"), ("Plain", "plain")])
_columns("property_names", T.property_name, [("@rid", "rid"), ("name", "name")])
_columns("record_ids", lambda x: T.is_record_id(x).cast("int"), [("#12:0", 1), ("12:0", 0), ("#1:2x", 0)])
_columns("url_names", T.url_encoded, [("my file (1)/å.mp4", "my%20file%20(1)/%C3%A5.mp4"), ("a+b&c", "a+b&c")])
_columns("audio_names", lambda x: T.audio_name(x, F.when(x.startswith("UIO_"), "bigbrother").otherwise("other")), [("UIO_sp_AB.wav", "BB_sp"), ("NOTA_sp_AB.WAV", "sp_AB"), ("_x.wav", "x")])
_columns("display_tags", T.display_pos, [("n:sg", "n/sg")])
_columns("curve_rows", lambda x: T.curve_pixel(x, 5000.0, 100, 400), [(0, 400.0), (5000, 100.0), (2500, 250.0)], "long")
_columns("mouse_hz", lambda x: T.pixel_to_hz(x, 400, 8000.0, 300), [(400, 0), (250, 4000), (399, 27)], "long")
_columns("image_times", lambda x: T.milliseconds(x, 200.0), [(0, 0), (50, 250), (333, 1665)], "long")
_columns("chinese_joined", lambda x: T.words_joined(F.split(x, " ")), [("你 好", "你好"), ("你 a 好", "你 a 好"), ("a b", "a b")])
_columns("written_booleans", lambda x: T.written_boolean(x).cast("int"), [("no", 0), ("False", 0), ("maybe", 1)])
_columns("row_json", lambda x: F.to_json(F.struct(x.alias("a"), F.lit(1).alias("n"))), [("x", '{"a":"x","n":1}')])


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([x FOR x IN w IF list_contains(v, x)])), ' ') AS same, array_to_string(list_sort(list_distinct([x FOR x IN w IF NOT list_contains(v, x)])), ' ') AS more FROM (SELECT d.doc_id, string_split(d.text, ' ')[1:30] AS w, string_split(coalesce(p.text, ''), ' ')[1:30] AS v FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id - 1 WHERE d.text IS NOT NULL)")
def array_common_added(spark, sf_dir):
    """The first words of each text beside those of the text before: in common, and new."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.slice(F.split("text", " ", -1), 1, 30).alias("w"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("w").alias("v"))
    both = docs.where("w is not null").join(before, "doc_id", "left").withColumn("v", F.coalesce("v", F.array(F.lit(""))))
    line = lambda c: F.array_join(F.array_sort(c), " ")
    return both.select("doc_id", line(T.common(F.col("w"), F.col("v"))).alias("same"), line(T.added(F.col("w"), F.col("v"))).alias("more"))


# -- matching -----------------------------------------------------------------------

_HEAD = TOK + ", head AS (SELECT text_id, s_no, w, least(len(w), 3) - 1 AS stop FROM sent WHERE len(w) > 0)\n"


def _region() -> dict[str, tuple[Column, Column]]:
    """The first three tokens of a line stand for its headword."""
    return {"headword": (F.lit(0), F.least(F.size("word"), F.lit(3)) - 1)}


@query(_HEAD + "SELECT text_id, s_no, 0 AS first, stop AS last FROM head WHERE regexp_full_match(lower(w[1]), 'th.+')")
def headword(spark, sf_dir):
    return M.match(_sentences(spark, sf_dir), cqp.with_headword('[word="th.+" %c]'), _region()).select(*_SPAN)


@query(_HEAD + "SELECT text_id, s_no, 0 AS first, stop AS last FROM head WHERE lower(w[1]) IN ('the', 'of') UNION SELECT text_id, s_no, i, i FROM tok WHERE word = 'from' AND i = n - 1")
def or_headwords(spark, sf_dir):
    rows = [cqp.with_headword('[word="the" %c]'), cqp.with_headword('[word="of" %c]'), '[word="from"] </s>']
    return M.match_any(_sentences(spark, sf_dir), rows, regions=_region()).select(*_SPAN)


@query(_HEAD + "SELECT text_id, s_no, 0 AS first, stop + 1 AS headword_len FROM head WHERE regexp_full_match(lower(w[1]), 'th.+') ORDER BY stop, text_id, s_no LIMIT 40")
def headword_by_length(spark, sf_dir):
    search = Search(_sentences(spark, sf_dir), [{"query": '[word="th.+" %c]', "headword_search": True}], regions=_region(), max_hits=None)
    return search.results(0, 39).select("text_id", "s_no", "first", "headword_len")


@query(TOK + "SELECT text_id, s_no, i AS first, i AS last FROM tok WHERE lower(strip_accents(word)) = 'de'")
def bare_word(spark, sf_dir):
    return M.match(_sentences(spark, sf_dir), '[word="dé" %cd]').select(*_SPAN)


@query(TOK + "SELECT a.text_id, a.s_no, a.i AS first, a.i + 1 AS last FROM att a JOIN att b ON a.text_id = b.text_id AND a.s_no = b.s_no AND b.i = a.i + 1 WHERE lower(a.word) = 'the' AND NOT (b.pos = 'WORD' OR b.pos = 'CAP')")
def negated_group(spark, sf_dir):
    return M.match(_sentences(spark, sf_dir, "pos"), '[word="the" %c] [!(pos="WORD" | pos="CAP")]').select(*_SPAN)


@query(TOK + "SELECT text_id, s_no, i AS first, i AS last FROM tok WHERE regexp_full_match(word, '\\p{Lu}\\p{Ll}+') AND i = 0")
def character_classes(spark, sf_dir):
    return M.match(_sentences(spark, sf_dir), r'<s> [word="\p{Lu}\p{Ll}+"]').select(*_SPAN)


@query(_HEAD + "SELECT t.text_id, t.s_no, t.i AS first, t.i AS last FROM tok t JOIN head h USING (text_id, s_no) WHERE t.word = 'of' AND t.i <= h.stop")
def within_region(spark, sf_dir):
    return M.match(_sentences(spark, sf_dir), '[word="of"] within headword', _region()).select(*_SPAN)


@query(TOK + ", pos AS (SELECT text_id, s_no, coalesce(sum(len(w)) OVER (PARTITION BY text_id ORDER BY s_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sent) SELECT a.text_id, a.s_no, a.i AS first, a.i + 1 AS last FROM tok a JOIN tok b ON a.text_id = b.text_id AND a.s_no = b.s_no AND b.i = a.i + 1 JOIN pos p ON p.text_id = a.text_id AND p.s_no = a.s_no WHERE a.word = 'of' AND b.word = 'the' AND (p.start + a.i >= 10 AND p.start + a.i + 1 <= 60 OR p.start + a.i >= 100 AND p.start + a.i + 1 <= 130)")
def range_search(spark, sf_dir):
    """Hits in the tokens 10-60 and 100-130 of each text, which stand for a speaker's parts."""
    texts = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.lit("10-60 100-130").alias("positions"))
    return M.in_ranges(M.match(C.positions(_sentences(spark, sf_dir)), '[word="of"] [word="the"]'), ingest.ranges(texts)).select(*_SPAN)


def _others(spark: SparkSession, sf_dir: str, *languages: str) -> tuple[DataFrame, dict]:
    docs, rows = C.table(spark, sf_dir, "documents"), _sentences(spark, sf_dir)
    return rows.where("lang = 'en'"), {x: (rows.where(F.col("lang") == x), C.alignment(docs, "en", x)) for x in languages}


_THREE = _ALIGN + ", al2 AS (SELECT a.doc_id AS text_id, s.s_no, b.doc_id AS other_text_id FROM ranked a JOIN ranked b ON a.k = b.k AND a.lang = 'en' AND b.lang = 'fr' JOIN sent s ON s.text_id = a.doc_id AND s.s_no < b.n)\n"


@query(_THREE + "SELECT t.text_id, t.s_no, t.i AS first, array_to_string(o.w, ' ') AS de, array_to_string(f.w, ' ') AS fr FROM tok t JOIN al ON t.text_id = al.text_id AND t.s_no = al.s_no JOIN al2 ON t.text_id = al2.text_id AND t.s_no = al2.s_no JOIN sent o ON o.text_id = al.other_text_id AND o.s_no = al.s_no JOIN sent f ON f.text_id = al2.other_text_id AND f.s_no = al2.s_no WHERE lower(t.word) = 'the' AND EXISTS (SELECT 1 FROM tok x WHERE x.text_id = al.other_text_id AND x.s_no = al.s_no AND lower(x.word) = 'die')")
def aligned_three(spark, sf_dir):
    source, others = _others(spark, sf_dir, "de", "fr")
    found = M.aligned_rows(source, others, '[word="the" %c] :RUN_DE [word="die" %c] :RUN_FR []')
    return found.select("text_id", "s_no", "first", F.array_join("word_de", " ").alias("de"), F.array_join("word_fr", " ").alias("fr"))


@query(_ALIGN + "SELECT t.text_id, t.s_no, t.i AS first FROM tok t JOIN al ON t.text_id = al.text_id AND t.s_no = al.s_no WHERE lower(t.word) = 'the' AND EXISTS (SELECT 1 FROM tok o WHERE o.text_id = al.other_text_id AND o.s_no = al.s_no AND lower(o.word) = 'die')")
def aligned_search_rows(spark, sf_dir):
    source, others = _others(spark, sf_dir, "de")
    rows = [{"lang": "en", "query": '[word="the" %c]'}, {"lang": "de", "query": '[word="die" %c]'}]
    return Search(source, rows, others=others, corpus="run").hits().select("text_id", "s_no", "first")


@query(EAV + "SELECT count(*) = 0 AS incompatible FROM meta WHERE lang = 'en' AND source = 'no such source'")
def incompatible_metadata(spark, sf_dir):
    try:
        D.restrict(_sentences(spark, sf_dir), _cells(spark, sf_dir), {"lang": ["en"], "source": ["no such source"]})
        return spark.range(1).select(F.lit(False).alias("incompatible"))
    except IncompatibleMetadataError:
        return spark.range(1).select(F.lit(True).alias("incompatible"))


@query(PAIR.replace("WHERE lower(a.word)", "WHERE a.lang = 'en' AND a.source IN ('src1', 'src2') AND lower(a.word)") + "SELECT text_id, s_no, first, last FROM hit")
def checked_search(spark, sf_dir):
    search = Search(_sentences(spark, sf_dir), [{"query": _PHRASE}], _cells(spark, sf_dir), {"lang": ["en"], "source": ["src1", "src2"]}, max_hits=None)
    return search.hits().select(*_SPAN)


@query(PAIR + "SELECT least(count(*), 2000) AS hits FROM hit")
def default_limit(spark, sf_dir):
    return spark.createDataFrame([(Search(_sentences(spark, sf_dir), [{"query": _PHRASE}]).count(),)], "hits long")


# -- metadata -----------------------------------------------------------------------


@query(EAV + "SELECT text_id FROM meta WHERE lang IN ('de', 'fr') AND source = 'src1'")
def filter_by_value_ids(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    names = {"lang": ["de", "fr"], "source": ["src1"]}
    ids = spark.createDataFrame([(c, v) for c, vs in names.items() for v in vs], "category string, value string").select("category", F.xxhash64("category", "value").alias("id"))
    chosen: dict[str, list[int]] = {}
    for r in ids.collect():  # the three values of the request
        chosen.setdefault(r.category, []).append(r.id)
    return D.matching_ids(cells, C.TYPES, chosen)


@query(EAV + "SELECT CAST(row_number() OVER (ORDER BY value) AS INT) AS place, value AS text FROM (SELECT DISTINCT value FROM cells WHERE category = 'source')")
def values_in_order(spark, sf_dir):
    listed = [r.text for r in D.listed(D.value_table(_cells(spark, sf_dir), C.TYPES), "source").collect()]  # a picker's list
    return spark.createDataFrame(list(enumerate(listed, 1)), "place int, text string")


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 1")
def first_row(spark, sf_dir):
    return K.first_of(C.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query("SELECT r_regionkey AS corpus_id, r_name AS code, array_to_string(list(n_nationkey || ' ' || n_name ORDER BY n_nationkey), ', ') AS categories FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL")
def corpus_lookup(spark, sf_dir):
    """Regions stand for corpora, nations for their categories."""
    corpora = C.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("corpus_id"), F.col("r_name").alias("code"))
    categories = C.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("corpus_id"), F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("short_name"))
    found = D.corpus_with_categories(corpora, categories, "ASIA")
    return found.withColumn("categories", F.array_join(F.transform("categories", lambda c: F.concat_ws(" ", c["category_id"].cast("string"), c["short_name"])), ", "))


@query("SELECT n_nationkey AS corpus_id, n_name AS code FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 7)")
def corpora_of_user(spark, sf_dir):
    corpora = C.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("corpus_id"), F.col("n_name").alias("code"))
    permissions = C.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("user_id"), F.col("c_nationkey").alias("corpus_id"))
    return D.allowed_corpora(corpora, permissions, 7)


@query(_values([(1, "author", "Forfatter"), (2, "birth_year", "Birth Year")], "category_id, short_name, name"))
def category_names(spark, sf_dir):
    categories = spark.createDataFrame([(1, "author"), (2, "birth_year")], "category_id int, short_name string")
    return D.localized(categories, spark.createDataFrame([(1, "no", "Forfatter"), (2, "en", "Born")], "category_id int, locale string, name string"), "no")


@query(_values([(0, "tid", "Tid", "list", "text"), (2, "born", "Year of birth", "shortlist", "integer")], "position, short_name, name, category_type, value_type"))
def category_lines(spark, sf_dir):
    lines = spark.createDataFrame([(0, "tid"), (1, "sex\tSex"), (2, "born\tYear of birth\tshortlist\tinteger"), (3, "")], "position int, line string")
    return ingest.read_categories(lines, spark.createDataFrame([("sex",)], "short_name string"))


@query(EAV + "SELECT 't' || text_id AS tid, lang, source, '1 2' AS bounds, chr(92) || chr(9) || 'x' AS note FROM meta")
def value_lines(spark, sf_dir):
    """Each text's metadata written as a line of an import file, and read."""
    rows = C.texts(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    cell = lambda c: F.coalesce(F.col(c), F.lit(r"\N"))
    lines = rows.select(F.concat_ws("\t", F.concat(F.lit(" "), "tid"), cell("lang"), F.coalesce("source", F.lit("")), F.lit("1\\\t2"), F.lit("\\\tx")).alias("value"))
    return ingest.read_values(lines, ["tid", "lang", "source", "bounds", "note"], speech=True)


@query("SELECT tid, startpos, CASE WHEN known THEN text_id ELSE -1 END AS text_id FROM (SELECT 't' || doc_id AS tid, doc_id % 3 <> 0 AS known, doc_id AS text_id, CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 ELSE doc_id END AS startpos FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0)")
def upserted_texts(spark, sf_dir):
    """Texts that were known keep their ids; even ones come again, with new ranges."""
    docs = C.table(spark, sf_dir, "documents").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("tid"), F.col("doc_id").alias("text_id"), F.col("doc_id").alias("startpos"))
    existing = docs.where("text_id % 3 <> 0")
    incoming = docs.where("text_id % 2 = 0").select("tid", (F.col("startpos") * 10).alias("startpos"))
    out = D.upsert_texts(existing, incoming)
    return out.select("tid", "startpos", F.when(F.col("text_id") == F.xxhash64("tid"), F.lit(-1).cast("long")).otherwise(F.col("text_id")).alias("text_id"))


@query("SELECT doc_id AS text_id, CAST(doc_id * 5 AS BIGINT) AS start, CAST(doc_id * 5 + 4 AS BIGINT) AS \"end\" FROM documents UNION ALL SELECT doc_id, doc_id, doc_id + 9 FROM documents UNION ALL SELECT doc_id, 1000000, 1000007 FROM documents")
def position_ranges(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), (F.col("doc_id") * 5).alias("startpos"), (F.col("doc_id") * 5 + 4).alias("endpos"), F.concat(F.col("doc_id").cast("string"), F.lit("-"), (F.col("doc_id") + 9).cast("string"), F.lit(" 1000000-1000007")).alias("positions"))
    return ingest.ranges(docs)


# -- statistics and places ------------------------------------------------------------

_PLACES = ", spot AS (SELECT 't' || doc_id AS who_name, source AS place FROM documents WHERE source IS NOT NULL)\n"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are their own speakers; sources stand for places."""
    cells = _cells(spark, sf_dir).withColumn("category", F.when(F.col("category") == "source", "place").otherwise(F.col("category")))
    return S.tid_places(cells)


@query("SELECT 't' || doc_id AS who_name, source AS place FROM documents WHERE source IS NOT NULL")
def places_of_tids(spark, sf_dir):
    return _placed(spark, sf_dir)


@query(PAIR + _PLACES + "SELECT place, count(*) AS freq FROM hit JOIN spot ON who_name = 't' || text_id GROUP BY place")
def geo_of_search(spark, sf_dir):
    groups = S.group_counts(_phrase(spark, sf_dir), F.lower(F.get("word", F.col("first"))), F.concat(F.lit("t"), F.col("text_id").cast("string")))
    return S.by_place(groups, _placed(spark, sf_dir)).where("total = 1").select("place", "freq")


@query("SELECT DISTINCT source AS place FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_nationkey < 5)")
def places_without_coordinates(spark, sf_dir):
    known = C.table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("place"))
    return S.missing_places(_placed(spark, sf_dir), known)


@query(SPEECH + "SELECT CASE WHEN lower(x) = 'the' THEN 'the' ELSE 'other' END AS phon, count(*) AS freq FROM (SELECT unnest(w) AS x FROM seg) WHERE lower(x) <> 'of' GROUP BY ALL")
def legend_forms(spark, sf_dir):
    """``of`` stands for an undefined form."""
    hits = M.match(_speech(spark, sf_dir), "[]")
    form = F.lower(F.get("word", F.col("first")))
    return S.legend(S.group_counts(hits, F.when(form == "of", "_").when(form == "the", "the").otherwise("other"), F.col("speaker")))


@query("SELECT conv_id AS clip, count(*) AS images, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS width FROM conversations GROUP BY conv_id")
def image_widths(spark, sf_dir):
    rows = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip"), F.length(F.coalesce("text", F.lit(""))).alias("width"))
    return S.total_width(rows)


# -- speech -------------------------------------------------------------------------

_ENDS = SPEECH + ", h AS (SELECT file, seg, w FROM seg WHERE list_contains(list_transform(w, lambda x: lower(x)), 'the')), e AS (SELECT file, CAST(min(seg) AS VARCHAR) AS start_at, CAST(max(seg) + 1 AS VARCHAR) AS end_at, count(*) AS lines FROM seg GROUP BY file)\n"


@query(_ENDS + "SELECT file, h.seg, start_at, end_at FROM h JOIN e USING (file)")
def media_ends(spark, sf_dir):
    return _objects(spark, sf_dir).select("file", "seg", "start_at", "end_at")


@query(_ENDS + 'SELECT h.file, h.seg AS hit, s.speaker, array_to_string(s.w, \' \') AS line, CAST(s.seg AS VARCHAR) AS "from", s.seg = h.seg AS is_match FROM h JOIN seg s ON s.file = h.file')
def media_annotation(spark, sf_dir):
    lines = _objects(spark, sf_dir).select("file", F.col("seg").alias("hit"), F.explode("annotation").alias("a"))
    return lines.select("file", "hit", "a.speaker", F.array_join("a.line", " ").alias("line"), "a.from", "a.is_match")


@query(SPEECH + "SELECT file, CAST(min(seg) AS VARCHAR) AS \"from\", CAST(min(seg) + 1 AS VARCHAR) AS \"to\", arg_min(speaker, seg) AS speaker, CAST(min(line_key) AS VARCHAR) AS line_key, 'a b' AS said, true AS is_match FROM seg GROUP BY file")
def speech_segments(spark, sf_dir):
    """A marked-up line of each file's first segment, read into its parts."""
    first = _speech(spark, sf_dir).groupBy("file").agg(F.min_by(F.struct("from", "to", "speaker", "line_key"), "seg").alias("s")).select("file", "s.*")
    line = F.concat(F.lit("<sync_time "), "from", F.lit("><sync_end "), "to", F.lit("><who_name "), "speaker", F.lit("><who_line_key "), F.col("line_key").cast("string"), F.lit(">a {{b}}</who_line_key></who_name></sync_end></sync_time>"))
    found = P.parse_segments(first.select("file", line.alias("line")))
    return found.select("file", "from", "to", "speaker", "line_key", F.regexp_replace("said", r"[{}]", "").alias("said"), "is_match")


@query(_values([("pos", "noun", "num", "pl", "Plural"), ("pos", "noun", "num", "sg", "sg"), ("pos", "verb", None, None, None)], "pos_attr, pos, feature_attr, value, label"))
def tag_menu(spark, sf_dir):
    tree = {"tags": {"attr": "pos", "options": [{"name": "Noun", "value": "noun", "features": [{"attr": "num", "options": [{"name": "Plural", "value": "pl"}, {"value": "sg"}]}]}, {"name": "verb"}]}}
    return package.menu(spark, tree)


@query("SELECT r_name, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def rows_as_json(spark, sf_dir):
    rows = C.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return results.as_json(rows).select(F.get_json_object("json", "$.r_name").alias("r_name"), "json")


@query("SELECT r_name, '<ROW><r_name>' || r_name || '</r_name></ROW>' AS xml FROM region")
def rows_as_xml(spark, sf_dir):
    found = results.as_xml(C.table(spark, sf_dir, "region").select("r_name"))
    return found.select(F.regexp_extract("xml", "<r_name>([^<]*)", 1).alias("r_name"), F.regexp_replace("xml", r"\s*\n\s*", "").alias("xml"))


@query(_values([("no", '"hun"', True), ("en", '"she"', None)], "lang, query, headword_search"))
def saved_queries(spark, sf_dir):
    record = results.search_record("s1", [{"lang": "no", "query": '"hun"', "headword_search": True}, {"lang": "en", "query": '"she"'}])
    return results.read_queries(spark.createDataFrame([(record["queries"],)], "queries string")).select(F.inline("queries"))


@query("SELECT DISTINCT doc_id % 4 AS k FROM documents WHERE doc_id < 4")
def inline_relation(spark, sf_dir):
    return D.inline(spark, "k", [0, 1, 2, 3, 2])
