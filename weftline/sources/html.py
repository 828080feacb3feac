"""Fields out of HTML pages by the standard library's parser, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """Collects, for each rule (tag, attribute, value), the texts inside matching elements or one of their attributes."""

    def __init__(self, rules: dict[str, tuple[str, str | None, str | None, str]]):
        super().__init__(convert_charrefs=True)
        self.rules, self.found, self.open = rules, {k: [] for k in rules}, []

    def handle_starttag(self, tag, attrs) -> None:  # noqa: ANN001
        own = dict(attrs)
        watching = []
        for name, (want, attr, value, take) in self.rules.items():
            if tag == want and (attr is None or (value is None and attr in own) or (value is not None and value in (own.get(attr) or "").split())):
                if take == "text":
                    watching.append((name, []))
                elif own.get(take):
                    self.found[name].append(own[take].strip())
        if tag not in VOID:
            self.open.append((tag, watching))

    def handle_endtag(self, tag) -> None:  # noqa: ANN001
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            t, watching = self.open.pop()
            self._close(watching)
            if t == tag:
                break

    def _close(self, watching) -> None:  # noqa: ANN001
        for name, parts in watching:
            text = " ".join("".join(parts).split())
            if text:
                self.found[name].append(text)

    def handle_data(self, data) -> None:  # noqa: ANN001
        for _, watching in self.open:
            for _, parts in watching:
                parts.append(data)

    def finish(self) -> dict[str, list[str]]:
        self.close()
        while self.open:
            self._close(self.open.pop()[1])
        return self.found


def page_fields(html: str | None, rules: dict[str, tuple[str, str | None, str | None, str]]) -> dict[str, list[str]]:
    """The values of each rule in a page, in its order; broken pages give what can be read."""
    page = _Page(rules)
    page.feed(html or "")
    return page.finish()


def project_pages(pages: DataFrame, id_col: str, html_col: str, rules: dict[str, tuple[str, str | None, str | None, str]]) -> DataFrame:
    """pages -> (id, one array<string> for each rule). A rule: (tag, attribute or None, its word or None, "text" or an attribute to take).

    Null and empty pages give empty arrays.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page_fields(h, rules) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f[r] for f in found], pa.list_(pa.string())) for r in rules]], names=[id_col, *rules])

    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{r}` array<string>" for r in rules))
