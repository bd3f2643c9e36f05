"""One search, from its rows to pages, counts and statistics."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from .errors import QueryError
from .functions import cqp
from .operators import concordance, match, metadata, statistics


class SearchEngine(Protocol):
    """What an engine for another kind of corpus has to offer."""

    def hits(self) -> DataFrame: ...

    def results(self, start: int, stop: int, sort_by: str = "position") -> DataFrame: ...

    def count(self) -> int: ...

    def part_count(self, part: str) -> DataFrame: ...


@dataclass
class Search:
    """Query rows over sentences, restricted by metadata."""

    sentences: DataFrame
    queries: list[dict]
    cells: DataFrame | None = None
    selected: dict[str, list[str]] = field(default_factory=dict)
    max_hits: int | None = 2000
    sort_by: str = "position"
    #: For another language its sentences and their alignment, see :func:`match.aligned_rows`.
    others: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)
    corpus: str = "corpus"
    regions: dict | None = None

    def __post_init__(self) -> None:
        if "headword" in (self.regions or {}):
            self.sort_by = concordance.search_order(self.queries, self.sort_by)

    def hits(self) -> DataFrame:
        if not cqp.may_search(self.queries):
            raise QueryError("nothing to search for")
        rows = self.sentences if self.cells is None else metadata.restrict(self.sentences, self.cells, self.selected)
        texts = [cqp.with_tones(q["query"], q.get("lang", "")) for q in self.queries]
        texts = [cqp.with_headword(t) if q.get("headword_search") else t for t, q in zip(texts, self.queries, strict=True)]
        if len({q.get("lang") for q in self.queries}) > 1:
            aligned = cqp.aligned(self.corpus, [{**q, "query": t} for q, t in zip(self.queries, texts, strict=True)])
            return match.aligned_rows(rows, self.others, aligned)
        found = match.match_any(rows, texts, regions=self.regions) if len(texts) > 1 else match.match(rows, texts[0], self.regions)
        region = (self.regions or {}).get("headword")
        return concordance.with_headword_len(found, region) if region else found

    def run(self, step: int = 1, size: int = concordance.PAGE) -> DataFrame | int:
        """Step 1 gives the first page's rows, steps 2 and 3 counts."""
        limited = match.cut(self.hits(), concordance.step_cut(step, size, self.max_hits))
        return concordance.kwic(concordance.sort(limited, self.sort_by)) if step == 1 else limited.count()

    def results(self, start: int, stop: int, sort_by: str = "") -> DataFrame:
        return concordance.kwic(concordance.rows(match.cut(self.hits(), self.max_hits), start, stop, sort_by or self.sort_by))

    def count(self) -> int:
        return match.cut(self.hits(), self.max_hits).count()

    def part_count(self, part: str) -> DataFrame:
        return statistics.part_counts(self.hits(), part)

    def frequencies(self, attribute: str = "word") -> DataFrame:
        """Of the first query over the whole corpus, as the statistics page shows it."""
        return statistics.frequencies(match.match(self.sentences, self.queries[0]["query"]), attribute)
