"""Label cells as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_container(label: Column) -> Column:
    """A label ending in ``/`` names a container, not a class."""
    return F.endswith(label, F.lit("/"))


def split_labels(cell: Column, separator: str = ",") -> Column:
    """Trimmed parts of a label cell without blanks and containers (order and repeats kept)."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), _quote(separator)), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & ~is_container(x))


def distinct_labels(cell: Column, separator: str = ",") -> Column:
    """Labels of a row, each once, first-seen order."""
    return F.array_distinct(split_labels(cell, separator))


def matching(labels: Column, needle: str | None) -> Column:
    """Labels that contain ``needle``; all of them without one."""
    return labels if not needle else F.filter(labels, lambda x: F.contains(x, F.lit(needle)))


def union_labels(cells: list[Column], vocabulary: str) -> Column:
    """Labels of one vocabulary over several columns split on ``,`` and ``|``."""
    parts = [F.transform(F.split(F.coalesce(c, F.lit("")), r"[,|]"), lambda x: F.trim(x)) for c in cells]
    return F.array_distinct(F.filter(
        F.flatten(F.array(*parts)), lambda x: F.contains(x, F.lit(vocabulary)) & ~is_container(x)))


def rejoin_names(fragments: Column) -> Column:
    """Put back together display names that were cut at a separator inside the name.

    A fragment goes on when it starts in lower case, the name before ends in ``-``, or that
    name has an open parenthesis.
    """
    def step(acc: Column, piece: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        first = F.left(piece, F.lit(1))
        open_paren = F.length(F.regexp_replace(last, r"[^(]", "")) > F.length(F.regexp_replace(last, r"[^)]", ""))
        goes_on = (F.size(acc) > 0) & (first.rlike(r"^\p{Ll}") | F.endswith(last, F.lit("-")) | open_paren)
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                          F.array(F.concat(last, F.lit(", "), piece)))
        return F.when(goes_on, merged).otherwise(F.concat(acc, F.array(piece)))

    return F.aggregate(fragments, F.array().cast("array<string>"), step)


def pair_names(uris: Column, names: Column) -> Column:
    """``array<struct<uri,name>>``: pairs when the counts line up, possibly after rejoining."""
    def zipped(right: Column) -> Column:
        return F.zip_with(uris, right, lambda u, n: F.struct(u.alias("uri"), n.alias("name")))

    repaired = rejoin_names(names)
    none = F.array().cast("array<struct<uri:string,name:string>>")
    return (F.when(F.size(uris) == F.size(names), zipped(names))
            .when(F.size(uris) == F.size(repaired), zipped(repaired))
            .otherwise(none))


def names_for(kept: Column, pairs: Column) -> Column:
    """Names of exactly the ``kept`` labels, in their order; empty unless all are known."""
    def known(u: Column) -> Column:
        return F.get(F.filter(pairs, lambda p: p["uri"] == u), 0)["name"]

    found = F.transform(kept, known)
    return F.when(F.forall(found, lambda n: n.isNotNull()), F.array_join(found, ", ")).otherwise(F.lit(""))


def parent_namespace(label: Column) -> Column:
    """The namespace a label sits in directly; empty for a label without one."""
    return F.regexp_extract(label, "^(.*/)[^/]*$", 1)


def label_set_text(labels: Column) -> Column:
    """The label set as one comparable text."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _quote(separator: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in separator)
