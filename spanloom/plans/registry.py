"""The registered queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cqp, text as T
from ..operators import concordance as K
from ..operators import match as M
from ..operators import metadata as D
from ..operators import speech as P
from ..operators import statistics as S
from . import corpus as C

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TOK = r"""WITH lines AS (SELECT doc_id AS text_id, lang, source, unnest(range(len(l))) AS s_no, unnest(l) AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)),
sent AS (SELECT text_id, lang, source, s_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM lines),
tok AS (SELECT text_id, lang, source, s_no, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM sent),
att AS (SELECT *, lower(regexp_replace(word, '[^\p{L}\p{N}]', '', 'g')) AS lemma, CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 'NUM' WHEN NOT regexp_matches(word, '[\p{L}\p{N}]') THEN 'PUNCT' WHEN regexp_matches(word, '^\p{Lu}') THEN 'CAP' ELSE 'WORD' END AS pos FROM tok)
"""
EAV = """WITH meta AS (SELECT d.doc_id AS text_id, 't' || d.doc_id AS tid, d.lang, d.source, CAST(floor(d.n_chars / 1000) AS INT) AS size, CASE l.quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS quality, CASE l.toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
cells AS (SELECT text_id, 'tid' AS category, tid AS value FROM meta UNION ALL SELECT text_id, 'lang', lang FROM meta WHERE lang IS NOT NULL UNION ALL SELECT text_id, 'source', source FROM meta WHERE source IS NOT NULL UNION ALL SELECT text_id, 'quality', quality FROM meta WHERE quality IS NOT NULL UNION ALL SELECT text_id, 'toxic', toxic FROM meta WHERE toxic IS NOT NULL UNION ALL SELECT text_id, 'size', CAST(size AS VARCHAR) FROM meta WHERE size IS NOT NULL)
"""
SPEECH = r"""WITH seg AS (SELECT conv_id AS file, turn AS seg, role AS speaker, conv_id * 100 + turn AS line_key, list_filter(string_split(regexp_replace(coalesce(text, ''), '[\n\t\r]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM conversations)
"""
_PHRASE = '[word="of" %c] [word="the" %c]'
PAIR = TOK + ", hit AS (SELECT a.text_id, a.lang, a.source, a.s_no, a.n, a.i AS first, a.i + 1 AS last, s.w FROM tok a JOIN tok b ON a.text_id = b.text_id AND a.s_no = b.s_no AND b.i = a.i + 1 JOIN sent s ON s.text_id = a.text_id AND s.s_no = a.s_no WHERE lower(a.word) = 'of' AND lower(b.word) = 'the')\n"
_KWIC = "text_id, s_no, first, array_to_string(w[1:first], ' ') AS \"left\", array_to_string(w[first + 1:last + 1], ' ') AS match, array_to_string(w[last + 2:len(w)], ' ') AS \"right\""
_SPAN = ["text_id", "s_no", "first", "last"]
_LINE = ["text_id", "s_no", "first", "left", "match", "right"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _sentences(spark: SparkSession, sf_dir: str, *attributes: str) -> DataFrame:
    return C.sentences(C.table(spark, sf_dir, "documents"), attributes)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unpivot(C.texts(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")), C.TYPES)


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.speech(C.table(spark, sf_dir, "conversations"))


def _phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match(_sentences(spark, sf_dir), cqp.from_phrase("of the"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a phrase's concordance, sorted by the right context."""
    return K.kwic(K.page(_phrase(spark, sf_dir), 1, by="right")).select(*_LINE)


# -- corpus ---------------------------------------------------------------------


@query(TOK + "SELECT lang, count(*) AS tokens FROM tok GROUP BY lang")
def token_count(spark, sf_dir):
    return _sentences(spark, sf_dir).groupBy("lang").agg(F.sum(F.size("word")).alias("tokens")).where("tokens > 0")


@query(TOK + "SELECT lang, count(*) AS sentences FROM sent GROUP BY lang")
def sentence_count(spark, sf_dir):
    return _sentences(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("sentences"))


# -- matching -------------------------------------------------------------------


def _spans(name: str, cql: str, condition: str, sql_terms: int, attributes: tuple[str, ...] = (), extra: str = "", **options) -> None:
    """Registers a pattern of ``sql_terms`` adjacent tokens t0, t1, ... as a query of spans."""
    joins = "".join(f" JOIN att t{k} ON t{k}.text_id = t0.text_id AND t{k}.s_no = t0.s_no AND t{k}.i = t0.i + {k}" for k in range(1, sql_terms))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return M.match(_sentences(spark, sf_dir, *attributes), cql, **options).select(*_SPAN)

    run.__name__ = name
    query(TOK + f"SELECT t0.text_id, t0.s_no, t0.i AS first, t0.i + {sql_terms - 1} AS last FROM att t0{joins} WHERE {condition}{extra}")(run)


_spans("simple_phrase", '[word="of"] [word="the"]', "t0.word = 'of' AND t1.word = 'the'", 2)
_spans("phrase_ci", _PHRASE, "lower(t0.word) = 'of' AND lower(t1.word) = 'the'", 2)
_spans("start_of_word", '[word="th.+" %c] [word="of" %c]', "regexp_full_match(lower(t0.word), 'th.+') AND lower(t1.word) = 'of'", 2)
_spans("end_of_word", '[word=".+tion" %c]', "regexp_full_match(lower(t0.word), '.+tion')", 1)
_spans("lemma_search", '[lemma="the" %c] [lemma="of" %c]', "t0.lemma = 'the' AND t1.lemma = 'of'", 2, ("lemma",))
_spans("conjunction_pos", '[word="th.*" %c & pos="CAP"]', "regexp_full_match(lower(t0.word), 'th.*') AND t0.pos = 'CAP'", 1, ("pos",))
_spans("negated_test", '[word="the" %c] [pos!="WORD"]', "lower(t0.word) = 'the' AND t1.pos <> 'WORD'", 2, ("pos",))
_spans("any_token", '[word="of"] [] [word="the"]', "t0.word = 'of' AND t2.word = 'the'", 3)
_spans("either_test", '[word="of" | word="in"] [word="the"]', "t0.word IN ('of', 'in') AND t1.word = 'the'", 2)
_spans("sentence_anchor", '<s> [word="The"]', "t0.word = 'The' AND t0.i = 0", 1)
_spans("phonetic_search", '[phon="the" %c] [phon="of" %c]', "lower(t0.word) = 'the' AND lower(t1.word) = 'of'", 2, ("phon",))


@query(TOK + "SELECT text_id, s_no, first, min(last) AS last FROM (SELECT a.text_id, a.s_no, a.i AS first, b.i AS last FROM tok a JOIN tok b ON a.text_id = b.text_id AND a.s_no = b.s_no AND b.i - a.i BETWEEN 2 AND 3 WHERE a.word = 'of' AND b.word = 'the') GROUP BY ALL")
def gap_1_2(spark, sf_dir):
    return M.match(_sentences(spark, sf_dir), '[word="of"] []{1,2} [word="the"]').select(*_SPAN)


@query(TOK + "SELECT text_id, s_no, first, min(last) AS last FROM (SELECT a.text_id, a.s_no, a.i AS first, b.i AS last FROM tok a JOIN tok b ON a.text_id = b.text_id AND a.s_no = b.s_no AND b.i > a.i WHERE a.word = 'with' AND b.word = 'from') GROUP BY ALL")
def gap_open(spark, sf_dir):
    return M.match(_sentences(spark, sf_dir), '[word="with"] []{0,} [word="from"]').select(*_SPAN)


@query(TOK + "SELECT DISTINCT a.text_id, a.s_no, a.i AS first, a.i + 1 AS last FROM tok a JOIN tok b ON a.text_id = b.text_id AND a.s_no = b.s_no AND b.i = a.i + 1 WHERE (a.word = 'of' AND b.word = 'the') OR (a.word = 'in' AND b.word = 'the') OR (a.word = 'of' AND b.word = 'the')")
def or_phrases(spark, sf_dir):
    return M.match(_sentences(spark, sf_dir), cqp.any_of(['[word="of"] [word="the"]', '[word="in"] [word="the"]', '[word="of"] [word="the"]'])).select(*_SPAN)


@query(PAIR + "SELECT text_id, s_no, first, last FROM hit ORDER BY text_id, s_no, first LIMIT 100")
def cut_n(spark, sf_dir):
    return M.match(_sentences(spark, sf_dir), _PHRASE + " cut 100").select(*_SPAN)


@query(PAIR + "SELECT text_id, s_no, first, last FROM hit")
def phrase_by_windows(spark, sf_dir):
    return M.match_by_windows(C.tokens(_sentences(spark, sf_dir)), _PHRASE).select(*_SPAN)


@query(PAIR + "SELECT count(*) AS hits FROM hit")
def hit_count(spark, sf_dir):
    return _phrase(spark, sf_dir).agg(F.count("*").alias("hits"))


# -- concordance ------------------------------------------------------------------


@query(PAIR + f"SELECT {_KWIC} FROM hit")
def kwic_context(spark, sf_dir):
    return K.kwic(_phrase(spark, sf_dir)).select(*_LINE)


def _sorted(name: str, by: str, key: str, offset: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return K.kwic(K.page(_phrase(spark, sf_dir), offset // K.PAGE + 1, by=by)).select(*_LINE)

    run.__name__ = name
    query(PAIR + f"SELECT {_KWIC} FROM hit ORDER BY {key} NULLS FIRST, text_id, s_no, first LIMIT 50 OFFSET {offset}")(run)


_sorted("kwic_sort_match", "match", "w[first + 1]")
_sorted("kwic_sort_left", "left", "CASE WHEN first > 0 THEN w[first] END")
_sorted("kwic_sort_right", "right", "w[last + 2]")
_sorted("kwic_page_2", "right", "w[last + 2]", 50)


@query(PAIR + "SELECT h.text_id, h.s_no, h.first, coalesce(array_to_string(b.w, ' '), '') AS before, coalesce(array_to_string(a.w, ' '), '') AS after FROM hit h LEFT JOIN sent b ON b.text_id = h.text_id AND b.s_no = h.s_no - 1 LEFT JOIN sent a ON a.text_id = h.text_id AND a.s_no = h.s_no + 1")
def kwic_wide_context(spark, sf_dir):
    return K.with_context(_phrase(spark, sf_dir), _sentences(spark, sf_dir), 2).select("text_id", "s_no", "first", "before", "after")


@query(PAIR + "SELECT CAST((r - 1) // 50 + 1 AS INT) AS page, text_id, s_no, first FROM (SELECT *, row_number() OVER (ORDER BY text_id, s_no, first) AS r FROM hit) WHERE r <= 100")
def prefetch_two_pages(spark, sf_dir):
    return K.pages(_phrase(spark, sf_dir), [1, 2]).select("page", "text_id", "s_no", "first")


@query(PAIR + "SELECT step, least(n, coalesce(most, n)) AS hits FROM (SELECT count(*) AS n FROM hit) CROSS JOIN (VALUES (1, 50), (2, 1000), (3, NULL)) AS s(step, most)")
def progressive_counts(spark, sf_dir):
    return K.progressive_counts(_phrase(spark, sf_dir))


# -- metadata ----------------------------------------------------------------------


@query(EAV + "SELECT text_id, category, value FROM cells")
def eav_unpivot(spark, sf_dir):
    return _cells(spark, sf_dir).select("text_id", "category", "value")


@query(EAV + "SELECT category, count(DISTINCT value) AS n_values, count(*) AS n_links FROM cells GROUP BY category")
def eav_value_dictionary(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    ids = D.value_table(cells, C.TYPES).groupBy("category").agg(F.count_distinct("value_id").alias("n_values"))
    return ids.join(cells.groupBy("category").agg(F.count("*").alias("n_links")), "category")


@query(EAV + "SELECT text_id FROM meta WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2', 'src0')")
def metadata_filter_and_or(spark, sf_dir):
    return D.matching_texts(_cells(spark, sf_dir), {"lang": ["de", "fr"], "source": ["src1", "src2", "src0"], "toxic": []})


@query(PAIR.replace("WHERE lower(a.word)", "WHERE a.lang = 'en' AND a.source = 'src1' AND lower(a.word)") + "SELECT text_id, s_no, first, last FROM hit")
def filtered_search(spark, sf_dir):
    rows = D.restrict(_sentences(spark, sf_dir), _cells(spark, sf_dir), {"lang": ["en"], "source": ["src1"]}, check=False)
    return M.match(rows, _PHRASE).select(*_SPAN)


@query(EAV + "SELECT DISTINCT source AS value FROM meta WHERE lang = 'es' OR quality = 'no'")
def constrained_values(spark, sf_dir):
    return D.constrained_values(_cells(spark, sf_dir), "source", {"lang": ["es"], "quality": ["no"], "source": ["src1"]})


@query(EAV + "SELECT DISTINCT source AS value FROM meta WHERE lang = 'es' AND quality = 'no'")
def constrained_values_all(spark, sf_dir):
    return D.constrained_values(_cells(spark, sf_dir), "source", {"lang": ["es"], "quality": ["no"]}, "all")


def _value_search(name: str, category: str, typed: str, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.shown(D.search_values(D.value_table(_cells(spark, sf_dir), C.TYPES), category, typed)).select("category", "text")

    run.__name__ = name
    query(EAV + f"SELECT DISTINCT category, value AS text FROM cells WHERE category = '{category}' AND {condition}")(run)


_value_search("value_search_text", "source", "SRC1", "value ILIKE '%src1%'")
_value_search("value_search_int", "size", "3 thousand", "value = '3'")
_value_search("value_search_bool", "quality", "true", "value = 'yes'")


@query("SELECT doc_id AS text_id FROM documents WHERE doc_id = 17")
def text_by_tid(spark, sf_dir):
    return D.text_by_tid(_cells(spark, sf_dir), "t17")


# -- statistics ----------------------------------------------------------------------


def _frequency(name: str, attribute: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = () if attribute == "word" else (attribute,)
        return S.frequencies(M.match(_sentences(spark, sf_dir, *own), '[word="th.*" %c]'), attribute)

    run.__name__ = name
    query(TOK + f"SELECT {column} AS form, count(*) AS freq FROM att WHERE regexp_full_match(lower(word), 'th.*') GROUP BY 1")(run)


_frequency("freq_word", "word", "word")
_frequency("freq_lemma", "lemma", "lemma")
_frequency("freq_pos", "pos", "pos")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = M.match(_speech(spark, sf_dir), '[word="th.*" %c]')
    return S.group_counts(hits, F.lower(F.get("word", F.col("first"))), F.col("speaker"))


@query(SPEECH + "SELECT lower(x) AS phon, speaker AS who_name, count(*) AS freq FROM (SELECT speaker, unnest(w) AS x FROM seg) WHERE regexp_full_match(lower(x), 'th.*') GROUP BY ALL")
def group_speaker_by_form(spark, sf_dir):
    return _groups(spark, sf_dir)


def _by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for speakers, nations and regions for places."""
    hits = _phrase(spark, sf_dir)
    groups = S.group_counts(hits, F.lower(F.get("word", F.col("last") + 1)), F.col("source"))
    nations = C.table(spark, sf_dir, "nation").join(C.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = nations.select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("who_name"), F.col("r_name").alias("place"))
    return S.by_place(groups, places)


_PLACE = PAIR + ", placed AS (SELECT h.w[h.last + 2] AS x, r.r_name AS place FROM hit h JOIN nation n ON h.source = 'src' || n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)\n"


@query(_PLACE + "SELECT place, count(*) AS freq FROM placed GROUP BY place")
def geo_place_totals(spark, sf_dir):
    return _by_place(spark, sf_dir).where("total = 1").select("place", "freq")


@query(_PLACE + "SELECT place, lower(x) AS phon, count(*) AS freq FROM placed GROUP BY ALL")
def geo_form_by_place(spark, sf_dir):
    return _by_place(spark, sf_dir).where("total = 0").select("place", "phon", "freq")


@query(PAIR + "SELECT source, count(*) AS hits FROM hit GROUP BY source")
def part_counts(spark, sf_dir):
    return S.part_counts(_phrase(spark, sf_dir), "source")


@query("SELECT min(value) AS min, round(avg(value), 2) + 0.0 AS avg, max(value) AS max FROM events WHERE event_id BETWEEN 100 AND 700")
def range_stats(spark, sf_dir):
    return S.range_statistics(C.table(spark, sf_dir, "events").withColumnRenamed("event_id", "x"), 700, 100)


@query("SELECT CAST(k - 1 AS INT) AS formant, round(min(v), 5) AS min, round(avg(v), 2) + 0.0 AS avg, round(max(v), 5) AS max FROM (SELECT unnest([1, 2, 3, 4]) AS k, CAST(unnest(embedding[1:4]) AS DOUBLE) AS v FROM embeddings WHERE vec_id BETWEEN 10 AND 300) GROUP BY k")
def formant_stats(spark, sf_dir):
    rows = C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("x"), F.transform("embedding", lambda v: v.cast("double")).alias("formants"))
    return S.formant_statistics(rows, 10, 300).select("formant", F.round("min", 5).alias("min"), "avg", F.round("max", 5).alias("max"))


# -- speech and media --------------------------------------------------------------------


_RUNS = SPEECH + ", chg AS (SELECT line_key, file FROM (SELECT line_key, file, lag(file) OVER (ORDER BY line_key) AS p FROM seg) WHERE p IS DISTINCT FROM file), runs AS (SELECT file AS basename, line_key AS line_key_begin, coalesce(lead(line_key) OVER (ORDER BY line_key) - 1, (SELECT max(line_key) FROM seg)) AS line_key_end FROM chg)\n"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.runs(_speech(spark, sf_dir).select("line_key", F.col("file").alias("basename")))


@query(_RUNS + "SELECT * FROM runs")
def line_key_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(_RUNS + "SELECT seg.line_key, basename FROM seg LEFT JOIN runs ON line_key BETWEEN line_key_begin AND line_key_end")
def media_range_join(spark, sf_dir):
    return D.media_of(_speech(spark, sf_dir).select("line_key"), _runs(spark, sf_dir))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _speech(spark, sf_dir)
    return P.media_objects(M.match(rows, '[word="the" %c]').select("file", "seg").distinct(), rows)


_OBJ = SPEECH + ", n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seg) - 1 AS line, count(*) OVER (PARTITION BY file) - 1 AS top FROM seg), h AS (SELECT * FROM n WHERE list_contains(list_transform(w, lambda x: lower(x)), 'the'))\n"


@query(_OBJ + "SELECT file, seg, CAST(line AS INT) AS hit_line, CAST(top AS INT) AS max_end FROM h")
def media_object(spark, sf_dir):
    return _objects(spark, sf_dir).select("file", "seg", "hit_line", "max_end")


@query(_OBJ + "SELECT file, seg, CAST(greatest(line - 2, 0) AS INT) AS window_start, CAST(least(line + 2, top) AS INT) AS window_end FROM h")
def player_window(spark, sf_dir):
    return P.player_window(_objects(spark, sf_dir), 2).select("file", "seg", "window_start", "window_end")


# -- aligned corpora -----------------------------------------------------------------------


_ALIGN = TOK + ", ranked AS (SELECT doc_id, lang, len(string_split(text, chr(10))) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents), al AS (SELECT a.doc_id AS text_id, s.s_no, b.doc_id AS other_text_id FROM ranked a JOIN ranked b ON a.k = b.k AND a.lang = 'en' AND b.lang = 'de' JOIN sent s ON s.text_id = a.doc_id AND s.s_no < b.n)\n"


def _aligned(spark: SparkSession, sf_dir: str, other: str) -> DataFrame:
    docs, rows = C.table(spark, sf_dir, "documents"), _sentences(spark, sf_dir)
    return M.aligned_match(rows.where("lang = 'en'"), rows.where("lang = 'de'"), C.alignment(docs, "en", "de"), '[word="the" %c]', other)


@query(_ALIGN + "SELECT t.text_id, t.s_no, t.i AS first, al.other_text_id FROM tok t JOIN al ON t.text_id = al.text_id AND t.s_no = al.s_no WHERE lower(t.word) = 'the' AND EXISTS (SELECT 1 FROM tok o WHERE o.text_id = al.other_text_id AND o.s_no = al.s_no AND lower(o.word) = 'die')")
def aligned_search(spark, sf_dir):
    return _aligned(spark, sf_dir, '[word="die" %c]').select("text_id", "s_no", "first", "other_text_id")


@query(_ALIGN + "SELECT t.text_id, t.s_no, t.i AS first, array_to_string(o.w, ' ') AS other FROM tok t JOIN al ON t.text_id = al.text_id AND t.s_no = al.s_no JOIN sent o ON o.text_id = al.other_text_id AND o.s_no = al.s_no WHERE lower(t.word) = 'the'")
def aligned_display(spark, sf_dir):
    return _aligned(spark, sf_dir, "[]").select("text_id", "s_no", "first", F.array_join("other_word", " ").alias("other"))


# -- scalar functions -------------------------------------------------------------------------


_MARKS = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "{": "&#123;", "}": "&#125;"}


def _swapped(text: Column, marks: list[tuple[str, str]]) -> Column:
    for old, new in marks:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


@query(PAIR + "SELECT text_id, s_no, first, CAST(text_id AS VARCHAR) AS s_id, array_to_string(w[1:first], ' ') AS \"left\", array_to_string(w[first + 1:last + 1], ' ') AS match, array_to_string(w[last + 2:len(w)], ' ') AS \"right\" FROM hit")
def hit_text_split(spark, sf_dir):
    """Prints hits as marked-up lines, with braces outside the tags at a line's ends, and reads them again."""
    lines = K.kwic(_phrase(spark, sf_dir))
    left, match, right = (_swapped(F.col(c), list(_MARKS.items())) for c in ("left", "match", "right"))
    tag, end = F.concat(F.lit("<s_id "), F.col("text_id").cast("string"), F.lit(">")), F.lit("</s_id>")
    before = F.when(left == "", F.concat(F.lit("{{"), tag)).otherwise(F.concat(tag, left, F.lit(" {{")))
    after = F.when(right == "", F.concat(end, F.lit("}}"))).otherwise(F.concat(F.lit("}} "), right, end))
    read = T.split_hit(T.braces_inside(T.strip_hit_prefix(F.concat(F.lit(" 12: "), before, match, after))))
    back = [(new, old) for old, new in reversed(_MARKS.items())]
    return lines.select("text_id", "s_no", "first", read.alias("h")).select("text_id", "s_no", "first", "h.s_id", *[_swapped(F.col(f"h.{c}"), back).alias(c) for c in ("left", "match", "right")])


@query(TOK + "SELECT text_id, s_no, i, word AS form, lemma, CASE WHEN pos <> 'WORD' THEN pos END AS pos FROM att")
def token_display(spark, sf_dir):
    """All tokens as ``form/lemma/pos`` and back; one tag stands for an undefined value; slashes and
    per cent signs of the form are escaped while it is shown."""
    rows = C.tokens(_sentences(spark, sf_dir, "lemma", "pos"), ("word", "lemma", "pos"))
    escaped = F.replace(F.replace("word", F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    shown = F.concat_ws("/", escaped, "lemma", F.when(F.col("pos") == "WORD", "__UNDEF__").otherwise(F.col("pos")))
    read = T.token_attributes(shown, ["lemma", "pos"])
    form = F.replace(F.replace(T.token_form(shown), F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))
    return rows.select("text_id", "s_no", "i", form.alias("form"), F.try_element_at(read, F.lit("lemma")).alias("lemma"), F.try_element_at(read, F.lit("pos")).alias("pos"))


@query(SPEECH + "SELECT line_key, sha256('RUN@' || line_key || '@' || seg || '@' || (seg + 1)) AS key FROM seg")
def sha_key(spark, sf_dir):
    return _speech(spark, sf_dir).select("line_key", T.clip_key(F.lit("RUN"), F.col("line_key"), F.col("from"), F.col("to")).alias("key"))


@query("SELECT event_id, (event_id // 60) || '.' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '.5' AS shown FROM events")
def time_format(spark, sf_dir):
    return C.table(spark, sf_dir, "events").select("event_id", T.clock(F.col("event_id") + F.lit(0.5)).alias("shown"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS value FROM documents")
def integer_conversion(spark, sf_dir):
    typed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(" items"))).otherwise(F.concat(F.lit("no. "), F.col("doc_id").cast("string")))
    return C.table(spark, sf_dir, "documents").select("doc_id", T.to_integer(typed).cast("long").alias("value"))


@query("SELECT DISTINCT source, upper(source[1]) || source[2:] AS shown, regexp_replace('spk_a_' || source, '^.*_', '') AS speaker FROM documents WHERE source IS NOT NULL")
def display_names(spark, sf_dir):
    rows = C.table(spark, sf_dir, "documents").select("source").distinct().where("source is not null")
    return rows.select("source", T.capitalised(F.col("source")).alias("shown"), T.short_speaker(F.concat(F.lit("spk_a_"), F.col("source"))).alias("speaker"))


def queries() -> dict[str, Query]:
    from . import more  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more  # noqa: F401

    return dict(_SQL)
