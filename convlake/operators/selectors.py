"""CSS selectors, read once, as an automaton for the parse and as predicates on nodes.

Supported: tags, ``.class``, ``#id``, ``[attr]``, ``[attr="v"]``, ``^=``, ``*=`` and ``$=``, several of
these together, escapes (``\\!``, ``\\/``, ``\\[``), descendants (a space between) and alternatives (a comma
between).  What can't be read is a ``ValueError`` that names the selector.

:class:`Automaton` has all selectors of a list at once: a node's state, a bit for each part of a selector that
it or a node around it fits, is its parent's and what it adds, so any number of selectors costs one pass
over the nodes, descendants included.  :func:`matcher` is a column expression for a single selector on
nodes that are parsed already.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]
NAME = r"(?:[\w-]|\\.)+"
PIECE = re.compile(
    rf"""(?P<gap>\s*,\s*|\s+)|\.(?P<cls>{NAME})|\#(?P<id>{NAME})|\[\s*(?P<attr>{NAME})\s*(?:(?P<how>[\^*$]?)=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'))?\s*\]|(?P<tag>\*|{NAME})"""
)


class Compound(NamedTuple):
    """A selector without spaces."""

    tag: str | None
    classes: tuple[str, ...]
    ids: tuple[str, ...]
    attrs: tuple[tuple[str, str, str | None], ...]  # name, how, value; a value of None asks for the attribute alone


def parse(selector: str) -> list[list[Compound]]:
    """Alternatives, each a list of compounds, the outermost first."""
    plain = lambda s: re.sub(r"\\(.)", r"\1", s)
    ways, at, text = [[]], 0, selector.strip()
    tag, classes, ids, attrs = None, [], [], []

    def close() -> None:
        nonlocal tag, classes, ids, attrs
        if tag is None and not (classes or ids or attrs):
            raise ValueError(f"this selector can't be read: {selector!r}")
        ways[-1].append(Compound(None if tag in (None, "*") else tag.lower(), tuple(classes), tuple(ids), tuple(attrs)))
        tag, classes, ids, attrs = None, [], [], []

    while at < len(text):
        m = PIECE.match(text, at)
        if not m or m["tag"] and (tag is not None or classes or ids or attrs):
            raise ValueError(f"this selector can't be read: {selector!r}")
        if m["gap"]:
            close()
            if "," in m["gap"]:
                ways.append([])
        elif m["tag"]:
            tag = plain(m["tag"])
        elif m["cls"]:
            classes.append(plain(m["cls"]))
        elif m["id"]:
            ids.append(plain(m["id"]))
        else:
            attrs.append((plain(m["attr"]).lower(), m["how"] or "", m["a"] if m["a"] is not None else m["b"]))
        at = m.end()
    close()
    return ways


COMPARE = {"": lambda a, v: a == v, "^": lambda a, v: bool(v) and a.startswith(v), "*": lambda a, v: bool(v) and v in a, "$": lambda a, v: bool(v) and a.endswith(v)}


def fits(c: Compound, tag: str, classes: list[str], attrs: dict[str, str]) -> bool:
    return (
        (c.tag is None or c.tag == tag) and all(k in classes for k in c.classes) and all(attrs.get("id") == i for i in c.ids)
        and all(a in attrs and (v is None or COMPARE[how](attrs[a], v)) for a, how, v in c.attrs)
    )


class Automaton:
    """Named selectors over a document in order."""

    def __init__(self, selectors: dict[str, str]) -> None:
        # by a feature that a node must have: (compound, bit before, bit, name if the selector ends here)
        self.by: dict[str, list[tuple[Compound, int, int, str | None]]] = defaultdict(list)
        bits = 0
        for name, selector in selectors.items():
            for way in parse(selector):
                before = 0
                for k, c in enumerate(way):
                    bit, bits = 1 << bits, bits + 1
                    feature = f".{c.classes[0]}" if c.classes else f"[{'id' if c.ids else c.attrs[0][0]}" if c.ids or c.attrs else c.tag or "*"
                    self.by[feature].append((c, before, bit, name if k == len(way) - 1 else None))
                    before = bit

    def step(self, above: int, tag: str, classes: list[str], attrs: dict[str, str]) -> tuple[int, list[str]]:
        """The state of an element whose parent has the state ``above``, and the names of the selectors it matches."""
        state, hits = above, []
        for feature in ("*", tag, *(f".{k}" for k in dict.fromkeys(classes)), *(f"[{a}" for a in attrs)):
            for c, before, bit, name in self.by.get(feature, ()):
                if before & above == before and fits(c, tag, classes, attrs):
                    state |= bit
                    if name is not None and name not in hits:
                        hits.append(name)
        return state, hits


# ---- column expressions -------------------------------------------------------------------


def attr(x: Column, name: str) -> Column:
    return F.try_element_at(x["attrs"], F.lit(name))


def compound(c: Compound) -> Predicate:
    tests: list[Predicate] = [lambda x: x["kind"] == "element"]
    if c.tag:
        tests.append(lambda x: x["tag"] == c.tag)
    tests += [lambda x, k=k: F.array_contains(x["classes"], k) for k in c.classes]
    tests += [lambda x, i=i: attr(x, "id") == i for i in c.ids]
    for key, how, value in c.attrs:
        if value is None:
            tests.append(lambda x, k=key: attr(x, k).isNotNull())
        else:
            compare = {"": lambda a, v: a == v, "^": lambda a, v: a.startswith(v), "*": lambda a, v: a.contains(v), "$": lambda a, v: a.endswith(v)}[how]
            tests.append(lambda x, k=key, v=value, f=compare: f(attr(x, k), F.lit(v)))

    def predicate(x: Column) -> Column:
        out = tests[0](x)
        for test in tests[1:]:
            out = out & test(x)
        return F.coalesce(out, F.lit(False))

    return predicate


def below(parts: list[Predicate], nodes: Column) -> Predicate:
    """The last of ``parts``, somewhere below the one before it, and so on."""

    def predicate(x: Column) -> Column:
        if len(parts) == 1:
            return parts[0](x)
        up = below(parts[:-1], nodes)
        return parts[-1](x) & F.exists(nodes, lambda a: (a["node_id"] < x["node_id"]) & (x["node_id"] <= a["end_id"]) & up(a))

    return predicate


def matcher(selector: str, nodes: Column | None = None) -> Predicate:
    """Whether a node of the page's ``nodes`` matches the selector; with descendants, each node looks at those before it."""
    nodes = F.col("nodes") if nodes is None else nodes
    ways = [below([compound(c) for c in way], nodes) for way in parse(selector)]

    def predicate(x: Column) -> Column:
        out = ways[0](x)
        for way in ways[1:]:
            out = out | way(x)
        return out

    return predicate
