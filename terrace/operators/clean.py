"""Raw text rows to a typed, validated, one-row-per-key table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import CalendarIntervalType, MapType, VariantType

from terrace.functions import blank_to_null, clock_text, tolerant
from terrace.spec import HHMM, TEXT, Field, Rule, TableSpec

REASON = "_reject_reason"
RAW = "_raw_record"

_ODD = re.compile(r"[^0-9a-zA-Z_]")


def safe_name(name: str) -> str:
    return _ODD.sub("_", name)


def safe_names(names: Sequence[str]) -> list[str]:
    """Names restricted to letters, digits and underscore; two names may not become one."""
    cleaned = [safe_name(n) for n in names]
    taken: dict[str, str] = {}
    for old, new in zip(names, cleaned):
        # Spark resolves names without regard to case, so that is how a clash is judged.
        other = taken.setdefault(new.lower(), old)
        if other != old or cleaned.count(new) > 1:
            raise ValueError(f"columns {other!r} and {old!r} would both be named {new!r}")
    return cleaned


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))


def with_lineage(df: DataFrame, source_file: str = "_metadata.file_path") -> DataFrame:
    """Add when a row arrived and which file it came from."""
    return df.withColumns({"_ingest_ts": F.current_timestamp(), "_source_file": F.col(source_file)})


def _source_name(spec: TableSpec, source: str) -> str:
    """A source column's name while raw and typed columns live side by side. Renaming every column
    would be simpler, but each renamed column doubles the constraints the optimizer derives."""
    taken = {f.name.lower() for f in spec.fields}
    return f"_source_{source}" if source.lower() in taken else source


def _source_names(spec: TableSpec) -> dict[str, str]:
    return {s: _source_name(spec, s) for s in spec.sources()}


def _stated(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """The contract's source columns, arrival time and carried tie-breakers."""
    absent = [s for s in spec.sources() if s not in raw.columns]
    if absent:
        raise ValueError(f"input lacks contract columns: {', '.join(absent)}")
    arrival = F.col(spec.arrival) if spec.arrival in raw.columns else F.current_timestamp().alias(spec.arrival)
    names = _source_names(spec).items()
    sources = [F.col(f"`{s}`") if s == name else F.col(f"`{s}`").alias(name) for s, name in names]
    return raw.select(*sources, arrival, *_carried(raw, spec))


def _typed(spec: TableSpec, field: Field) -> Column:
    source = F.col(f"`{_source_name(spec, field.source)}`")
    if field.kind == TEXT:
        return blank_to_null(source)
    if field.kind == HHMM:
        return clock_text(source)
    # Blank first: an empty number is common and need not go through a failing conversion.
    return tolerant(blank_to_null(source), field.kind)


def _fields(spec: TableSpec, names: Sequence[str]) -> dict[str, Column]:
    return {f.name: _typed(spec, f) for f in spec.fields if f.name in names}


def _decidable(stated: DataFrame, spec: TableSpec) -> DataFrame:
    """Add the typed fields that rules and key need.

    A generator adds them, as one unit: with plain columns the optimizer would push the filter on them
    below their computation, and so compute them, and whatever computed column they came from, again for
    the filter. The remaining fields are typed later, on fewer rows.
    """
    typed = [column.alias(name) for name, column in _fields(spec, spec.deciding()).items()]
    return stated.select("*", F.inline(F.array(F.struct(*typed))))


def _complete(decided: DataFrame, spec: TableSpec) -> DataFrame:
    """Add the typed fields that ``_decidable`` left out."""
    rest = _fields(spec, [n for n in spec.names() if n not in spec.deciding()])
    return decided.withColumns(rest) if rest else decided


def _carried(df: DataFrame, spec: TableSpec) -> list[str]:
    return [t for t in spec.ties if t in df.columns]


def conform(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Project raw columns onto the contract: typed fields and arrival time."""
    typed = _fields(spec, spec.names())
    return _stated(raw, spec).select(*[c.alias(name) for name, c in typed.items()], spec.arrival)


def any_failed(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.expr(r.fails_when), F.lit(False)) for r in rules], F.lit(False))


def reasons(rules: Sequence[Rule]) -> Column:
    """Comma-joined names of the failed rules in rule order; empty text when none failed."""
    return F.concat_ws(",", *[F.when(F.expr(r.fails_when), F.lit(r.name)) for r in rules])


def keep_latest(df: DataFrame, key: Sequence[str], newest_first: Sequence[Column], alike: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first under ``newest_first``.

    Ranking with a limit of one lets Spark drop the losers of each key inside every map task before
    the shuffle (a group limit), so a key that holds a large share of all rows sends at most one
    row per map task to its reducer. Rows are sorted by the partition columns before the shuffle and after it.
    A hash leads them because the sorts then compare one long number, instead of several texts, for all rows but
    those of the same key. ``alike`` names key columns to lead instead: rows that agree on them then lie side by side, which
    makes long rows compress better, in this shuffle and in what follows, and the hash need not travel.
    """
    if alike:
        leading = [c for c in alike if c in key]
        ranked = Window.partitionBy(*leading, *[c for c in key if c not in leading]).orderBy(*newest_first)
    else:
        ranked = Window.partitionBy("_key_hash", *key).orderBy(*newest_first)
        df = df.withColumn("_key_hash", F.xxhash64(*key))
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank", "_key_hash")


def refine(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Apply the derived columns in one projection; every expression sees the typed input values."""
    computed = {d.name: F.expr(d.sql).alias(d.name) for d in spec.derived}
    kept = [c for c in df.columns if c not in spec.dropped]
    replaced = [computed.pop(c, F.col(c)) for c in kept]
    return df.select(*replaced, *computed.values())


def _sortable(df: DataFrame, name: str) -> Column:
    """The column, as text if its type has no order."""
    kind = df.schema[name].dataType
    return F.col(name).cast("string") if isinstance(kind, (CalendarIntervalType, MapType, VariantType)) else F.col(name)


def accepted(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows that pass every rule, one per key, with the derived columns.

    Passing rows are typed before the copies of a key meet: numbers and clock texts are shorter than their source texts, and
    these rows are sorted, shuffled and sorted again. Derived columns, which would lengthen them, are added to the survivors.
    Copies that agree in arrival and ties are told apart by their other typed columns, not by a hash that would travel with them.
    """
    stated = _stated(raw, spec)
    carried = _carried(stated, spec)
    passing = _decidable(stated, spec).filter(~any_failed(spec.rules))
    typed = _complete(passing, spec).select(*spec.names(), spec.arrival, *carried)
    last = [_sortable(typed, n) for n in spec.names() if n not in spec.key]
    order = [F.col(spec.arrival).desc(), *[F.col(t).asc() for t in carried], *last]
    return refine(keep_latest(typed, spec.key, order, spec.alike).select(*spec.names(), spec.arrival), spec)


def rejected(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows that fail some rule: typed values, reasons, and the original text as JSON.

    Reasons, JSON and most types are made after the filter, so accepted rows do not pay for them.
    """
    failing = _complete(_decidable(_stated(raw, spec), spec).filter(any_failed(spec.rules)), spec)
    original = F.struct(*[F.col(f"`{name}`").alias(s) for s, name in _source_names(spec).items()])
    return failing.select(
        *spec.names(), spec.arrival, reasons(spec.rules).alias(REASON), F.to_json(original).alias(RAW)
    )


def clean(raw: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Both are lazy and share no cached state: the rejected side is a narrow
    scan-and-filter, cheaper to evaluate again than to keep a second copy of the input."""
    return accepted(raw, spec), rejected(raw, spec)
