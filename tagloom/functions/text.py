"""Text preparation as column expressions; all of it runs inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import strip_accents, unescape_entities

# --- fixed values: character classes and markup patterns --------------------------------
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
ODD_SPACE = r"[\t\n\x{0B}\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TAG_STRICT = r"<[A-Za-z/!?][^<>]*>"
TAG_LOOSE = r"<[^<>]+>"
MD_LINK = r"!?\[([^\[\]]*)\]\([^()]*\)"
MD_MARKS = "[*_`~#>]+"
# marks and control characters go in one pass: both are deleted wherever they stand
DROPPED = MD_MARKS[:-2] + CONTROL[1:] + "+"
FORMULA_LEAD = r"^[=+\-@\t\r]"
#: Cells a CSV reader turns into "missing" in text columns (never in label columns).
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# ----------------------------------------------------------------------------------------

CLEANING_VERSION = 2


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, ODD_SPACE + "+", " "), " {2,}", " "))


def clean_text(text: Column, version: int = CLEANING_VERSION) -> Column:
    """One clean line: entities, tags, Markdown links and marks, control characters, spaces.

    Version 1 takes any ``<...>`` for a tag, version 2 only what opens like one.
    """
    if version not in (1, 2):
        raise ValueError(f"unknown text cleaning version {version}")
    out = unescape_entities(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, TAG_STRICT if version == 2 else TAG_LOOSE, " ")
    out = F.regexp_replace(out, MD_LINK, "$1")
    out = F.regexp_replace(out, DROPPED, "")
    return squeeze(out)


def missing_as_empty(cell: Column) -> Column:
    """Text columns only: the reader's NA words, and null, are the empty text."""
    return F.when(cell.isNull() | cell.isin(*NA_WORDS), F.lit("")).otherwise(cell)


def assemble(columns: Sequence[str], weights: Mapping[str, int] | None = None,
             available: Sequence[str] | None = None) -> Column:
    """Weighted text: each column repeated by its weight, joined by one space, nulls empty.

    Weights for columns that are not assembled are ignored; ``available`` narrows nothing
    silently -- a listed column that is missing is the caller's error.
    """
    if available is not None:
        lost = [c for c in columns if c not in available]
        if lost:
            raise ValueError(f"text columns {lost} not found; available: {sorted(available)}")
    weights = weights or {}
    slots = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns for _ in range(max(1, int(weights.get(c, 1))))]
    return F.concat_ws(" ", *slots)


def effective_weights(requested: Mapping[str, int] | None, configured: Mapping[str, int],
                      columns: Sequence[str]) -> dict[str, int]:
    """Request beats configuration, an empty request means no weighting; bounds 1..10."""
    chosen = {c: w for c, w in configured.items() if c in columns} if requested is None else dict(requested)
    bad = {c: w for c, w in chosen.items() if not 1 <= int(w) <= 10}
    if bad:
        raise ValueError(f"text column weights must lie in 1..10, got {bad}")
    return chosen


def assemble_record(record_json: Column, columns: Sequence[str], weights: Mapping[str, int] | None = None) -> Column:
    """Text of a JSON record in the model's own columns; null where it carries none of them."""
    fields = F.from_json(record_json, "map<string,string>")
    cells = {c: F.element_at(fields, F.lit(c)) for c in columns}
    weights = weights or {}
    slots = [F.coalesce(cells[c], F.lit("")) for c in columns for _ in range(max(1, int(weights.get(c, 1))))]
    carries = F.arrays_overlap(F.map_keys(fields), F.array(*[F.lit(c) for c in columns]))
    return F.when(carries, F.concat_ws(" ", *slots))


def duplicate_key(text: Column) -> Column:
    """Digest of the lower-cased, accent-free text: what two copies of a text share."""
    return F.md5(strip_accents(F.lower(text)))


def letter_ratio(text: Column) -> Column:
    """Letters among the visible characters (null for a text without any)."""
    # plain spaces go without a search
    visible = F.length(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), SPACE, ""))
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.nullif(visible, F.lit(0))


def words(text: Column) -> Column:
    """Words with a letter first, hyphen compounds kept together."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}\p{N}_]*(?:-[\p{L}\p{N}_]+)*"), F.lit(0))


def plain_words(text: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def normalise_url(url: Column) -> Column:
    """Identity of a web address: no scheme, no ``www.``, no trailing slash, lower case."""
    out = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    out = F.regexp_replace(out, r"^https?://", "")
    out = F.regexp_replace(out, r"^www\.", "")
    return F.regexp_replace(out, "/+$", "")


def normalise_title(title: Column) -> Column:
    """Identity of a title: lower case, single spaces."""
    return squeeze(F.lower(F.coalesce(title, F.lit(""))))


def preview(text: Column, chars: int = 500) -> tuple[Column, Column]:
    """``(shown text, was it cut)`` for review pages."""
    return F.left(text, F.lit(chars)), F.length(text) > chars


def echo(text: Column, chars: int = 200) -> Column:
    """Shortened text with an ellipsis, as answers repeat their input."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("..."))).otherwise(text)


def spreadsheet_safe(cell: Column) -> Column:
    """A leading tab defuses cells a spreadsheet would run as a formula."""
    return F.when(cell.rlike(FORMULA_LEAD), F.concat(F.lit("\t"), cell)).otherwise(cell)
