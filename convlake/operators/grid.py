"""Cells of one table at their real places; plain Python that tasks run on one table at a time."""

from __future__ import annotations

from collections.abc import Iterable

Cell = tuple[int, int, str, int, int]  # row, place among the row's own cells, text, rows and columns it covers


def placed(cells: Iterable[Cell]) -> list[tuple[int, int, str]]:
    """(row, column, text) of every place that is covered; a cell's text stands in its first place only.

    Placement depends on what the rows above still occupy, so cells are taken in order.  A cell covers no more
    rows than there are.
    """
    cells, out = sorted(cells, key=lambda c: c[:2]), []
    taken: dict[int, set[int]] = {}
    free: dict[int, int] = {}  # below it, a row is full
    last = cells[-1][0] if cells else 0
    for row, _, text, down, across in cells:
        col, mine = free.get(row, 0), taken.setdefault(row, set())
        for j in range(across):
            while col in mine:
                col += 1
            for i in range(row, min(row + down - 1, last) + 1):
                taken.setdefault(i, set()).add(col)
                out.append((i, col, text if (i, j) == (row, 0) else ""))
        free[row] = col
    return out


def contents(head: list[Cell], body: list[Cell]) -> dict:
    """A table's texts: one header row (none without header cells), and body rows at least as wide as it.

    Several header rows become one: the parts of a column that aren't empty, a space apart.
    """
    columns: dict[int, list[str]] = {}
    for _, col, text in sorted(placed(head), key=lambda c: c[:2]):
        columns.setdefault(col, []).append(text.strip(" "))
    header = [" ".join(filter(None, columns[k])) for k in sorted(columns)] or None
    rows: dict[int, dict[int, str]] = {}
    for row, col, text in placed(body):
        rows.setdefault(row, {})[col] = text
    width = max(columns, default=-1) + 1
    return {"header": header, "body": [[rows[r].get(k, "") for k in range(max(width, max(rows[r]) + 1))] for r in sorted(rows)]}
