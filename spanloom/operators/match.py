"""Token queries as column expressions over rows of sentences.

A sentence is one row with an array column for each token attribute (``word``,
``lemma``, ``pos``, ...), so that only the attributes in use are read or derived.
Matching needs no shuffle and no exploded tokens: a pattern of fixed length is a
``filter`` over start positions; any other becomes a regular expression over a
string with one character for each token, its class being the set of predicates
that it satisfies.  Matches are spans (first, last) of 0-based positions.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import replace
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import cqp

ATOMS = 12
#: A character for each set of satisfied predicates, 2**ATOMS of them.
_ALPHABET = "".join(map(chr, range(0x4E00, 0x4E00 + (1 << ATOMS))))
_PLAIN = re.compile(r"[\w \-',;:!%&#/<>=@]*")


def bare(text: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@cache
def _accented() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters that are one letter and marks, and those letters."""
    pairs = [(chr(c), bare(chr(c))) for c in (*range(0xC0, 0x530), *range(0x1E00, 0x2000))]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def test_column(test: cqp.Test, value: Column) -> Column:
    """Null (a position outside the sentence, an undefined value) satisfies nothing."""
    if test.bare:
        value = F.regexp_replace(F.translate(value, *_accented()), r"\p{Mn}+", "")
        test = replace(test, regex=bare(test.regex), bare=False)
    if _PLAIN.fullmatch(test.regex):
        found = F.lower(value) == test.regex.lower() if test.fold else value == test.regex
    else:
        found = value.rlike(f"{'(?iu)' if test.fold else ''}^(?:{test.regex})$")
    return value.isNotNull() & ~found if test.negated else F.coalesce(found, F.lit(False))


def token_column(node: object, at) -> Column:
    """Whether the token whose attribute ``a`` is ``at(a)`` satisfies a predicate."""
    if isinstance(node, cqp.Any):
        return at("word").isNotNull()
    if isinstance(node, cqp.Test):
        return test_column(node, at(node.attr))
    if isinstance(node, (cqp.Both, cqp.Either)):
        out = token_column(node.parts[0], at)
        for part in node.parts[1:]:
            out = out & token_column(part, at) if isinstance(node, cqp.Both) else out | token_column(part, at)
        return out
    raise QueryError(f"not a token: {node!r}")


def flat(node: object) -> list | None:
    """The tokens of a pattern of fixed length, else None."""
    if isinstance(node, (cqp.Test, cqp.Both, cqp.Either, cqp.Any)):
        return [node]
    if isinstance(node, cqp.Sequence):
        parts = [flat(p) for p in node.parts]
        return None if any(p is None for p in parts) else [t for p in parts for t in p]
    if isinstance(node, cqp.Repeat) and node.least == node.most and (inner := flat(node.body)):
        return inner * node.least
    return None


def atoms(node: object) -> list:
    """The distinct token predicates of a pattern, in order."""
    if isinstance(node, (cqp.Test, cqp.Both, cqp.Either)):
        return [node]
    found: list = []
    for part in getattr(node, "parts", ()) or ([node.body] if hasattr(node, "body") else []):
        found += [a for a in atoms(part) if a not in found]
    return found


def attributes(node: object) -> set[str]:
    """The token attributes that a pattern tests."""
    if isinstance(node, cqp.Test):
        return {node.attr}
    return set().union(*(attributes(p) for p in (getattr(node, "parts", ()) or ([node.body] if hasattr(node, "body") else [])))) if node else set()


def spans_fixed(tokens: list) -> Column:
    """array<struct<first,last>> by a filter over start positions."""
    n = F.size("word")
    starts = F.when(n >= len(tokens), F.sequence(F.lit(0), n - len(tokens))).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        # rarest first would be best; tests that are not [] come before those that are
        out = None
        for k, t in sorted(enumerate(tokens), key=lambda x: isinstance(x[1], cqp.Any)):
            if isinstance(t, cqp.Any):
                continue
            c = token_column(t, lambda a, k=k: F.get(F.col(a), i + k))
            out = c if out is None else out & c
        return F.lit(True) if out is None else out

    return F.transform(F.filter(starts, here), lambda i: F.struct(i.alias("first"), (i + (len(tokens) - 1)).alias("last")))


def class_regex(node: object, known: list) -> str:
    """The pattern over class letters, lazy throughout: the shortest match from each start."""
    if isinstance(node, cqp.Any):
        return "."
    if node in known:
        bit = 1 << known.index(node)
        return "[" + "".join(c for k, c in enumerate(_ALPHABET[: 1 << len(known)]) if k & bit) + "]"
    if isinstance(node, cqp.Sequence):
        return "".join(class_regex(p, known) for p in node.parts)
    if isinstance(node, cqp.Choice):
        return "(?:" + "|".join(class_regex(p, known) for p in node.parts) + ")"
    if isinstance(node, cqp.Repeat):
        return f"(?:{class_regex(node.body, known)}){{{node.least},{'' if node.most is None else node.most}}}?"
    raise QueryError(f"not a pattern: {node!r}")


def class_string(known: list) -> Column:
    """One letter for each token of the sentence."""
    masks = F.transform(F.sequence(F.lit(0), F.size("word") - 1), lambda i: _letter(known, i))
    return F.when(F.size("word") > 0, F.array_join(masks, "")).otherwise("")


def _letter(known: list, i: Column) -> Column:
    mask = F.lit(1)
    for k, t in enumerate(known):
        mask = mask + F.when(token_column(t, lambda a: F.get(F.col(a), i)), 1 << k).otherwise(0)
    return F.substring(F.lit(_ALPHABET), mask, F.lit(1))


def spans_variable(node: object, classes: Column, known: list, first: Column | None = None, last: Column | None = None) -> Column:
    """array<struct<first,last>>: from each start the shortest match of a lazy pattern.

    ``first``: the only start.  ``last``: where the match has to end, however far that is.
    """
    pattern = f"^(?:{class_regex(node, known)})" + ("$" if last is not None else "")
    none = F.array().cast("array<int>")
    if first is not None:
        starts = F.when((first >= 0) & (first < F.length(classes)), F.array(first.cast("int"))).otherwise(none)
    else:
        starts = F.when(F.length(classes) > 0, F.sequence(F.lit(0), F.length(classes) - 1)).otherwise(none)
    stop = F.length(classes) if last is None else F.least(last + 1, F.length(classes)).cast("int")
    sized = F.transform(starts, lambda i: F.struct(i.alias("first"), (i + F.length(F.regexp_extract(F.substring(classes, i + 1, F.greatest(stop - i, F.lit(0))), pattern, 0)) - 1).alias("last")))
    return F.filter(sized, lambda s: s["last"] >= s["first"])


def _edged(spans: Column, side: str, edge: Column) -> Column:
    return F.filter(spans, lambda s: s[side] == edge)


def _inside(spans: Column, region: tuple[Column, Column]) -> Column:
    return F.filter(spans, lambda s: (s["first"] >= region[0]) & (s["last"] <= region[1]))


def _spans(data: DataFrame, query: cqp.Query, places: dict[str, tuple[Column, Column]], strategy: str) -> tuple[DataFrame, Column]:
    """The matches of one row of a query, anchors and unit included; class strings become columns of ``data``."""
    for name in (query.opens, query.closes, query.within):
        if name and name not in places:
            raise QueryError(f"unknown region {name}")
    first = places[query.opens][0] if query.opens else None
    last = places[query.closes][1] if query.closes else None
    body = cqp.simplified(query.body)
    parts = []
    for choice in body.parts if isinstance(body, cqp.Choice) else (body,):
        tokens = flat(choice) if strategy != "classes" else None
        if tokens is not None:
            spans = spans_fixed(tokens)
        elif strategy == "array":
            raise QueryError("the array strategy needs a pattern of fixed length")
        else:
            known = atoms(choice)
            if len(known) > ATOMS:
                raise QueryError(f"more than {ATOMS} different tokens in a pattern of variable length")
            name = f"__classes{sum(c.startswith('__classes') for c in data.columns)}"
            data = data.withColumn(name, class_string(known))
            spans = spans_variable(choice, F.col(name), known, first, last)
        if first is not None:
            spans = _edged(spans, "first", first)
        if last is not None:
            spans = _edged(spans, "last", last)
        if query.within and query.within != "s":
            spans = _inside(spans, places[query.within])
        parts.append(spans)
    return data, parts[0] if len(parts) == 1 else F.array_sort(F.array_distinct(F.concat(*parts)))


def _rows(query: cqp.Query) -> tuple[cqp.Query, ...]:
    several = isinstance(query.body, cqp.Choice) and all(isinstance(p, cqp.Query) for p in query.body.parts)
    return query.body.parts if several else (query,)


def match(sentences: DataFrame, query: str | cqp.Query, regions: dict[str, tuple[Column, Column]] | None = None, strategy: str = "auto") -> DataFrame:
    """``sentences`` with ``first`` and ``last`` of each match, one row for each.

    ``regions``: for an anchor name the first and last position of the region in
    the sentence; ``s`` is the sentence itself.  Between anchors a match reaches from edge to
    edge, else it is the shortest from its start.  ``strategy``: ``array``, ``classes`` or ``auto``.
    """
    query = cqp.parse(query) if isinstance(query, str) else query
    if query.aligned:
        raise QueryError("an aligned query needs the other corpora: use aligned_rows")
    rows = _rows(query)
    missing = set().union(*(attributes(r.body) for r in rows)) - set(sentences.columns)
    if missing:
        raise QueryError(f"unknown attribute {sorted(missing)}")
    places = {"s": (F.lit(0), F.size("word") - 1)} | (regions or {})
    data, spans = sentences, []
    for row in rows:
        data, found = _spans(data, row, places, strategy)
        spans.append(found)
    limit = query.cut if len(rows) == 1 else rows[-1].cut
    found = data.withColumn("__span", F.explode(spans[0] if len(spans) == 1 else F.array_sort(F.array_distinct(F.concat(*spans)))))
    found = found.drop(*[c for c in data.columns if c.startswith("__classes")])
    found = found.withColumn("first", F.col("__span.first")).withColumn("last", F.col("__span.last")).drop("__span")
    return cut(found, limit)


ORDER = ("text_id", "s_no", "first", "last")


def cut(hits: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` matches in corpus order; all if None."""
    return hits if most is None else hits.orderBy(*ORDER).limit(most)


def match_any(sentences: DataFrame, queries: list[str], **options) -> DataFrame:
    """The union of the matches of several queries, each span once; anchors and units hold for
    their own query, the last one's cut for all."""
    rows = tuple(r for q in queries for r in _rows(cqp.parse(q)))
    return match(sentences, cqp.Query(cqp.Choice(rows)) if len(rows) > 1 else rows[0], **options)


def match_by_windows(tokens: DataFrame, query: str) -> DataFrame:
    """(text_id, s_no, first, last) of a short pattern of fixed length, over rows of
    tokens (text_id, s_no, i, word, ...) by ``lead``: for token tables that are stored exploded."""
    from pyspark.sql import Window

    parts = flat(cqp.simplified(cqp.parse(query).body))
    if parts is None:
        raise QueryError("windows need a pattern of fixed length")
    order = Window.partitionBy("text_id", "s_no").orderBy("i")
    found = tokens
    for k, t in enumerate(parts):
        found = found.withColumn(f"__{k}", token_column(t, lambda a, k=k: F.lead(a, k).over(order) if k else F.col(a)))
    hit = found.where(" and ".join(f"__{k}" for k in range(len(parts))))
    return hit.select("text_id", "s_no", F.col("i").alias("first"), (F.col("i") + len(parts) - 1).alias("last"))


def aligned_match(source: DataFrame, target: DataFrame, alignment: DataFrame, query: str, other: str) -> DataFrame:
    """Matches of ``query`` in ``source`` whose aligned unit in ``target`` matches ``other``.

    ``alignment``: (text_id, s_no, other_text_id, other_s_no).  ``[]`` or a blank asks for
    an aligned unit only.  The aligned unit's words come as ``other_word``.
    """
    hits = match(source, query).join(alignment, ["text_id", "s_no"])
    units = target.select(F.col("text_id").alias("other_text_id"), F.col("s_no").alias("other_s_no"), F.col("word").alias("other_word"))
    if cqp.normalise(other) not in ("", '""'):
        kept = match(target, other).select(F.col("text_id").alias("other_text_id"), F.col("s_no").alias("other_s_no")).distinct()
        hits = hits.join(kept, ["other_text_id", "other_s_no"], "left_semi")
    return hits.join(units, ["other_text_id", "other_s_no"])


def aligned_rows(source: DataFrame, others: dict[str, tuple[DataFrame, DataFrame]], query: str) -> DataFrame:
    """Matches of an aligned query ``q :CORPUS q :CORPUS q`` of any number of corpora.

    ``others``: for the last part of a corpus's name in lower case (its language) the
    sentences and their alignment, see :func:`aligned_match`.  The words of each
    language's unit come as ``word_<language>``.
    """
    tree = cqp.parse(query)
    hits = match(source, replace(tree, aligned=()))
    for corpus, row in tree.aligned:
        language = corpus.rpartition("_")[2].lower()
        if language not in others:
            raise QueryError(f"no corpus {corpus}")
        target, alignment = others[language]
        units = target
        if cqp.simplified(row.body) != cqp.Any():
            units = target.join(match(target, row).select("text_id", "s_no").distinct(), ["text_id", "s_no"], "left_semi")
        units = units.select(F.col("text_id").alias("other_text_id"), F.col("s_no").alias("other_s_no"), F.col("word").alias(f"word_{language}"))
        hits = hits.join(alignment, ["text_id", "s_no"]).join(units, ["other_text_id", "other_s_no"]).drop("other_text_id", "other_s_no")
    return hits


def in_ranges(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Hits inside one of a text's ranges of token positions, such as a speaker's part of it.

    ``hits`` have ``start``, the position of the sentence's first token in the text;
    ``ranges``: (text_id, start, end), both ends included.  Each hit once.
    """
    parts = ranges.select("text_id", F.col("start").alias("__lo"), F.col("end").alias("__hi"))
    inside = (hits["text_id"] == parts["text_id"]) & (F.col("start") + F.col("first") >= F.col("__lo")) & (F.col("start") + F.col("last") <= F.col("__hi"))
    return hits.join(parts, inside, "left_semi")
