"""Declarative specifications. Everything here is plain data; no session is needed to define it.

Predicates and derivations are SQL expression text, so a specification can be built, compared and
printed before any Spark session exists; operators turn the text into columns with ``expr``.
"""

from __future__ import annotations

from dataclasses import dataclass

TEXT = "text"
HHMM = "hhmm"


@dataclass(frozen=True)
class Field:
    """One contract column: ``name`` is filled from raw column ``source``.

    ``kind`` is ``text`` (trim, blank becomes NULL), ``hhmm`` (four-digit clock text) or any SQL
    type name, which is converted tolerantly (unreadable text becomes NULL).
    """

    name: str
    source: str
    kind: str = TEXT


@dataclass(frozen=True)
class Rule:
    """A named reject reason: SQL text over typed fields, true for a row that fails. NULL is not a failure.

    ``uses`` names the fields the text reads; empty means that it may read any.
    """

    name: str
    fails_when: str
    uses: tuple[str, ...] = ()


@dataclass(frozen=True)
class Derived:
    """An output column computed by SQL text over the typed columns."""

    name: str
    sql: str


@dataclass(frozen=True)
class Measure:
    """An aggregate output column, as SQL text."""

    name: str
    sql: str


@dataclass(frozen=True)
class Reference:
    """A foreign key of a fact table and the dimension column it must be found in."""

    dimension: str
    foreign_key: str
    primary_key: str


@dataclass(frozen=True)
class TableSpec:
    """Contract, rules and identity of a cleaned table.

    ``arrival`` orders the copies of one key, newest first. ``ties`` names raw columns that break
    equal arrivals (ascending); those absent from the input are ignored, and the other typed columns
    always come last, so the surviving copy never depends on task order. ``alike`` names key columns that
    other columns go with (a route, its cities): rows are sorted by them first, so that they compress well.
    """

    fields: tuple[Field, ...]
    rules: tuple[Rule, ...]
    key: tuple[str, ...]
    derived: tuple[Derived, ...] = ()
    dropped: tuple[str, ...] = ()
    arrival: str = "_ingest_ts"
    ties: tuple[str, ...] = ()
    alike: tuple[str, ...] = ()

    def sources(self) -> list[str]:
        """Raw columns the contract needs, in order."""
        return list(dict.fromkeys(f.source for f in self.fields))

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def deciding(self) -> list[str]:
        """Fields that decide about a row: those of the key and of the rules."""
        names = self.names()
        used = {*self.key, *(u for r in self.rules for u in (r.uses or names))}
        return [n for n in names if n in used]


def required(column: str, reason: str | None = None) -> Rule:
    return Rule(reason or f"missing_{column}", f"{column} is null", (column,))


def matching(column: str, pattern: str, reason: str) -> Rule:
    return Rule(reason, f"not coalesce({column} rlike '{pattern}', false)", (column,))


def positive(column: str, reason: str) -> Rule:
    return Rule(reason, f"not coalesce({column} > 0, false)", (column,))


def one_of(column: str, values: tuple[str, ...], reason: str) -> Rule:
    listed = ", ".join(f"'{v}'" for v in values)
    return Rule(reason, f"not coalesce({column} in ({listed}), false)", (column,))
