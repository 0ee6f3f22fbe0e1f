"""One schema for the vintages of a feed.

A survey's files change from year to year: area codes move to a column of a new name, columns come
and go.  Each vintage names how its columns map to the common schema; what it lacks is a
typed null, so that the household join by all area columns still matches (null to null)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VintageConflict(ValueError):
    """A vintage that the common schema can't take as it stands."""


def reconcile(frames: Mapping[str, DataFrame], schema: T.StructType | str, renames: Mapping[str, Mapping[str, str]] | None = None,
              ignored: Mapping[str, Sequence[str]] | None = None, tag: str = "vintage") -> DataFrame:
    """The vintages stacked under ``schema``, with the vintage's name in ``tag``.

    ``renames`` maps, for each vintage, its column names to common ones; a column of the common name
    needs none.  A column that is neither common nor renamed has to be among the vintage's
    ``ignored``: nothing is lost unseen.  Raised as ``VintageConflict``: two columns for one common
    one, a rename of a column that isn't there or to a name that isn't common, an unknown
    column, a type that can't be stored in the common one without loss, a vintage of no common column."""
    common = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if tag in common.names:
        raise VintageConflict(f"the tag {tag} is a column of the schema")
    parts = []
    for name, df in frames.items():
        asked, passed = dict((renames or {}).get(name, {})), set((ignored or {}).get(name, ()))
        problems = [f"no column {c} to rename" for c in asked if c not in df.columns]
        problems += [f"{c} is renamed to {to}, which isn't common" for c, to in asked.items() if to not in common.names]
        sources: dict[str, list[str]] = {}
        for c in df.columns:
            to = asked.get(c, c)
            if to in common.names and (c in asked or c not in passed):
                sources.setdefault(to, []).append(c)
            elif c not in passed:
                problems.append(f"column {c} is neither common nor ignored")
        problems += [f"{' and '.join(c)} are both {to}" for to, c in sources.items() if len(c) > 1]
        problems += [f"{c[0]} is {df.schema[c[0]].dataType.simpleString()}, {to} is {common[to].dataType.simpleString()}"
                     for to, c in sources.items() if not _fits(df.schema[c[0]].dataType, common[to].dataType)]
        if not sources:
            problems.append("no common column")
        if problems:
            raise VintageConflict(f"vintage {name}: " + "; ".join(problems))
        parts.append(df.select(*[(F.col(f"`{sources[f.name][0]}`") if f.name in sources else F.lit(None)).cast(f.dataType).alias(f.name) for f in common.fields],
                               F.lit(str(name)).alias(tag)))
    return reduce(DataFrame.unionByName, parts)


_WIDTHS = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}


def _fits(own: T.DataType, common: T.DataType) -> bool:
    """Whether every value of a type is one of the other: the same type, a wider number, or anything as text
    but a number, whose leading zeros are gone already."""
    a, b = own.simpleString(), common.simpleString()
    if a == b or a == "void":
        return True
    if a in _WIDTHS and b in _WIDTHS:
        return _WIDTHS[a] <= _WIDTHS[b] and (a, b) not in (("bigint", "float"), ("bigint", "double"), ("int", "float"))
    return False
