"""Research reports that a page shows in a frame: what is dropped or replaced among their nodes.

The frame's document isn't part of the page; whoever captured it put its html, or its text, into attributes of the frame.
The parse puts that html in place of the frame's content (``html.trees`` with ``graft``) and tidies it here, while the
page's nodes are at hand; each node is looked at once for each element around it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that only tell how long a search took and what it found; below these, equal neighbours are content.
STATS = r"^research completed in\b.*$|^(?:[\d\s·.,]|citations?|searches?|sources?|fuentes?|búsquedas?)+$"
ROWS_AND_ITEMS = {"tr", "tbody", "thead", "table", "ul", "ol", "dl"}
DIAGRAM = "[Diagram: not shown -- not representable in this export]"
LEAST_DIGITS, LEAST_SIDE = 10, 80
DIGIT, HEADING, LINE, NAMED = re.compile(r"[0-9]"), re.compile(r"h[1-6]"), re.compile(STATS, re.I), re.compile("diagram|chart|graph|timeline|mermaid")
NUMBER = re.compile(r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))")


class Report:
    """The nodes ``first`` to ``end`` of a page, below one frame; ``nodes`` has a list for each field."""

    def __init__(self, nodes: dict[str, list], first: int, end: int) -> None:
        self.n, self.frame, self.span = nodes, first - 1, range(first, end)
        self.markers: set[int] = set()
        self.kids: dict[int, list[int]] = {}

    def stands(self, i: int) -> bool:
        return self.n["kind"][i] == "element" or i in self.markers

    def drop(self, i: int) -> None:
        for j in range(i, self.n["end_id"][i] + 1):
            self.n["kind"][j] = "dropped"
            self.markers.discard(j)

    def said(self, i: int) -> str:
        return "".join(self.n["text"][j] for j in range(i, self.n["end_id"][i] + 1) if self.n["kind"][j] == "text").strip()

    def live(self, i: int) -> list[int]:
        return [k for k in self.kids.get(i, ()) if self.stands(k)]

    def around(self) -> list[int]:
        """The frame and its elements, as far as they still stand when their turn comes."""
        return [self.frame, *(i for i in self.span if self.n["kind"][i] == "element")]

    def is_diagram(self, i: int) -> bool:
        """By the size that attributes or the view box give, else by its label."""
        attrs = dict(self.n["attrs"][i])
        number = lambda v: float(m[1]) if (m := NUMBER.match(v or "")) else None
        box = [number(v) for v in re.split(r"[\s,]+", attrs.get("viewbox", "").strip())]
        width, height = (number(attrs.get(k)) for k in ("width", "height"))
        if len(box) == 4 and None not in box:
            width, height = box[2] if width is None else width, box[3] if height is None else height
        if width is not None and height is not None:
            return width >= LEAST_SIDE and height >= LEAST_SIDE
        label = next((self.said(j) for j in range(i + 1, self.n["end_id"][i] + 1) if self.n["tag"][j] in ("title", "desc") and self.stands(j)), attrs.get("aria-label", ""))
        return bool(NAMED.search(label.lower()))

    def mark_diagrams(self) -> None:
        """A drawing becomes one text, a block of its own; small icons stay for whoever cleans the page."""
        n = self.n
        for i in self.span:
            if n["kind"][i] == "element" and n["tag"][i] == "svg" and self.is_diagram(i):
                self.drop(i)
                n["kind"][i], n["tag"][i], n["text"][i], n["end_id"][i], n["block_id"][i] = "text", None, DIAGRAM, i, i
                self.markers.add(i)

    def drop_digit_runs(self) -> None:
        """Neighbours of a single digit each, ten and more: counters that roll."""
        for up in self.around():
            run: list[int] = []
            for k in [*self.live(up), None]:
                if k is not None and DIGIT.fullmatch(self.said(k)):
                    run.append(k)
                    continue
                for gone in run if len(run) >= LEAST_DIGITS else ():
                    self.drop(gone)
                run = []

    def drop_stats(self) -> None:
        """Innermost elements that say nothing but figures of the search; bare numbers count as such, in cells too."""
        for i in [i for i in self.span if self.n["kind"][i] == "element" and not self.live(i)]:
            text = self.said(i)
            if text and LINE.search(text):
                self.drop(i)

    def drop_doubled_titles(self) -> None:
        """What says the same as the heading right behind it, but for rows, cells and items."""
        for up in self.around():
            before = None
            for k in () if self.n["tag"][up] in ROWS_AND_ITEMS else self.live(up):
                if before is not None and HEADING.fullmatch(self.n["tag"][k] or "") and (text := self.said(k)) and self.said(before) == text:
                    self.drop(before)
                before = k

    def tidy(self, allowed: set[str]) -> None:
        for i in self.span:
            if self.n["kind"][i] == "element" and self.n["tag"][i] not in allowed:
                self.drop(i)
        self.mark_diagrams()
        for i in self.span:
            if self.stands(i):
                self.kids.setdefault(self.n["parent_id"][i], []).append(i)
        self.drop_digit_runs()
        self.drop_stats()
        self.drop_doubled_titles()


def is_stats(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "").rlike(f"(?iu){STATS}")


def tidy_text(text: Column) -> Column:
    """A report's plain text without rolled counters and lines of figures, trimmed; null if nothing is left."""
    digits = F.regexp_replace(text, r"(?:(?<=\n)|\A)(?:[ \t\r]*[0-9][ \t\r]*(?:\n|\z)){%d,}" % LEAST_DIGITS, "")
    kept = F.filter(F.split(digits, "\n", -1), lambda x: ~is_stats(x))
    return F.nullif(F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", ""), F.lit(""))
