"""Table names of a query, found in its parsed plan and replaced in its text.

Spark's own parser tells which words are tables: strings, comments, columns and aliases
are never taken for one, and a common table expression hides a table of its name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Gives the view of a table name's parts, or None where it is no table of the engine.
Lookup = Callable[[list[str]], str | None]


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _place(node) -> tuple[int, int] | None:
    """Where the node stands in the text, in characters, both ends included."""
    at = node.origin()
    start, stop = at.startIndex(), at.stopIndex()
    return (start.get(), stop.get()) if start.isDefined() and stop.isDefined() else None


def replaced(spark: SparkSession, text: str, lookup: Lookup) -> tuple[str, list[str]]:
    """The text with every table that `lookup` knows replaced by its view, and those views.

    A replaced table keeps its last name as alias, so columns qualified by it still
    resolve; columns that name the schema as well lose that part.
    """
    edits: dict[tuple[int, int], str] = {}
    views: list[str] = []
    columns: list = []

    def relation(node, hidden: frozenset[str]) -> None:
        parts, at = _list(node.multipartIdentifier()), _place(node)
        if at is None or (len(parts) == 1 and parts[0].lower() in hidden):
            return
        view = lookup(parts)
        if view is not None:
            views.append(view)
            edits[at] = f"({view} AS `{parts[-1]}`)"

    def expression(node, hidden: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind in ("UnresolvedAttribute", "UnresolvedStar"):
            columns.append((kind, node))
        if "Subquery" in kind or kind in ("Exists", "ListQuery"):
            try:
                walk(node.plan(), hidden)
            except Exception as e:  # noqa: BLE001 - InSubquery holds its plan in a child
                if "plan" not in str(e):
                    raise
        for child in _list(node.children()):
            expression(child, hidden)

    def walk(node, hidden: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            relation(node, hidden)
            return
        if kind == "UnresolvedWith":
            for entry in _list(node.cteRelations()):
                name = entry._1().lower()
                walk(entry._2(), hidden | {name} if node.allowRecursion() else hidden)
                hidden = hidden | {name}
        for e in _list(node.expressions()):
            expression(e, hidden)
        for child in _list(node.children()):
            walk(child, hidden)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(text), frozenset())
    for kind, node in columns:
        at = _place(node)
        parts = _list(node.nameParts()) if kind == "UnresolvedAttribute" else _list(node.target().get()) if node.target().isDefined() else []
        need = 3 if kind == "UnresolvedAttribute" else 2
        for used in (3, 2):  # catalog.schema.table, then schema.table
            if at is not None and len(parts) >= used + need - 2 and lookup(parts[:used]) is not None:
                edits[at] = ".".join(f"`{p}`" for p in parts[used - 1 :]) + ("" if kind == "UnresolvedAttribute" else ".*")
                break
    for (start, stop), new in sorted(edits.items(), reverse=True):
        if re.search(r"\btable\s*$", text[:start], re.I):
            new = new[1:].split(" ", 1)[0]  # TABLE name takes a name alone
        text = text[:start] + new + text[stop + 1 :]
    return text, list(dict.fromkeys(views))
