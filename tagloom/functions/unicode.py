"""Entities, accents and composition as deterministic JVM expressions.

The tables come from rules over the standard library's Unicode and entity data, so that the
optimiser can still push, prune and fold around these expressions (a reflective or Python call
would stop it).
"""

from __future__ import annotations

import html.entities
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind

NON_ASCII = r"[^\x{00}-\x{7F}]"


#: a syllable is lead * 588 + vowel * 28 + tail, counted from the first one
SYLLABLES = r"\x{AC00}-\x{D7A3}"
LEADS, VOWELS, TAILS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _classed(codes: Iterable[int]) -> str:
    """The inside of a character class, as ranges."""
    spans: list[list[int]] = []
    for code in sorted(codes):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in spans)


def _guarded(inside: str) -> str:
    """The class of ``inside``, whose characters are all beyond ASCII, for searching long texts.

    The matcher goes through a large class range by range; the common characters below its first one are told
    by a single comparison before that.
    """
    first = int(re.match(r"\\x\{([0-9A-F]+)\}", inside)[1], 16)
    return rf"[[^\x{{0}}-\x{{{first - 1:X}}}]&&[{inside}]]"


def guarded(codes: Iterable[int]) -> str:
    """The class of some characters beyond ASCII, for searching long texts."""
    return _guarded(_classed(codes))


def _not_guarded(inside: str) -> str:
    """The complement of `_guarded`, as cheap."""
    first = int(re.match(r"\\x\{([0-9A-F]+)\}", inside)[1], 16)
    return rf"[\x{{0}}-\x{{{first - 1:X}}}[^{inside}]]"


@dataclass(frozen=True)
class Tables:
    """What the standard library's data say about characters, syllables aside."""

    decomposed: dict[str, str]    # canonical, in full
    compatible: dict[str, str]    # compatibility, in full, without accents
    pairs: dict[str, str]         # two characters that compose
    weights: dict[str, int]       # combining class of the characters that have one
    active: str                   # class of characters that composition may change or join to the one before


@lru_cache(maxsize=1)
def tables() -> Tables:
    decomposed, compatible, pairs, weights = {}, {}, {}, {}
    active = {*map(ord, VOWELS), *map(ord, TAILS)}
    for code in (*range(0x80, 0xAC00), *range(0xE000, 0x110000)):
        ch = chr(code)
        if unicodedata.combining(ch):
            weights[ch] = unicodedata.combining(ch)
            active.add(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not "\u0300" <= c <= "\u036f")
        if plain != ch:
            compatible[ch] = plain
        parts = unicodedata.decomposition(ch)
        if not parts or parts.startswith("<"):
            continue
        decomposed[ch] = unicodedata.normalize("NFD", ch)
        pair = "".join(chr(int(c, 16)) for c in parts.split())
        if unicodedata.normalize("NFC", ch) != ch:
            active.add(code)
        elif len(pair) == 2:
            pairs[pair] = ch
            active.add(ord(pair[1]))
    return Tables(decomposed, compatible, pairs, weights, _classed(active))


def _literal_map(entries: dict[str, str]) -> Column:
    # one text literal, folded once: thousands of literals would weigh on every plan
    packed = "\x02".join(f"{k}\x01{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x01"))


def _jamo(syllable: Column) -> Column:
    """Lead, vowel and tail of a syllable."""
    def parts(i: Column) -> Column:
        def at(letters: str, n: Column) -> Column:
            return F.substr(F.lit(letters), n.cast("int"), F.lit(1))
        tail = i % 28
        return F.concat(at(LEADS, F.floor(i / 588) + 1), at(VOWELS, F.floor(i % 588 / 28) + 1), F.when(tail == 0, "").otherwise(at(TAILS, tail)))
    return bind(F.ascii(syllable) - 0xAC00, parts)


def _pieces(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with its pieces (matches of ``pattern``, which covers it) changed, in one pass."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change), "")


def _ordered(text: Column, marks: dict[str, int]) -> Column:
    """Runs of combining characters by their classes; equal classes stay in order."""
    inside = _classed(map(ord, marks))
    mark, other = _guarded(inside), _not_guarded(inside)
    names, codes = "".join(marks), "".join(chr(0x100 + w) for w in marks.values())

    def arranged(run: Column) -> Column:
        keyed = F.transform(F.split(run, ""), lambda c, i: F.struct(F.ascii(F.translate(c, names, codes)).alias("weight"), i.alias("i"), c.alias("c")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda k: k["c"]), "")

    def change(piece: Column) -> Column:
        return F.when(piece.rlike(f"^{mark}{{2,}}$"), arranged(piece)).otherwise(piece)

    return bind(text, lambda t: F.when(t.rlike(f"{mark}{{2}}"), _pieces(t, f"{mark}+|{other}+", change)).otherwise(t))


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without accents (U+0300 to U+036F); ASCII rows pass untouched."""
    known = tables()
    single = {k: v for k, v in known.compatible.items() if len(v) == 1}
    gone = "".join(k for k, v in known.compatible.items() if not v)
    many = {k: v for k, v in known.compatible.items() if len(v) > 1}
    inside = _classed({*map(ord, many), *range(0xAC00, 0xD7A4)})
    wide, plain_ = _guarded(inside), _not_guarded(inside)
    expansions = _literal_map(many)

    def expanded(piece: Column) -> Column:
        return (F.when(piece.rlike(f"^[{SYLLABLES}]"), _jamo(piece))
                .when(piece.rlike(f"^{wide}"), F.element_at(expansions, piece)).otherwise(piece))

    def folded(t: Column) -> Column:
        plain = F.translate(t, "".join(single) + gone, "".join(single.values()))
        out = bind(plain, lambda p: F.when(p.rlike(wide), _pieces(p, f"{wide}|{plain_}+", expanded)).otherwise(p))
        return _ordered(out, {k: w for k, w in known.weights.items() if not "\u0300" <= k <= "\u036f"})

    return bind(text, lambda t: F.when(t.rlike(NON_ASCII), folded(t)).otherwise(t))


def _joined(first: Column, second: Column) -> Column:
    """The one character that two compose to, or null."""
    def place(letters: str, c: Column) -> Column:
        return F.instr(F.lit(letters), c)

    lead, vowel, tail = place(LEADS, first), place(VOWELS, second), place(TAILS, second)
    code = F.ascii(first) - 0xAC00
    syllable = (F.when((lead > 0) & (vowel > 0), 0xAC00 + (lead - 1) * 588 + (vowel - 1) * 28)
                .when((tail > 0) & code.between(0, 11171) & (code % 28 == 0), 0xAC00 + code + tail))
    point = F.decode(F.unhex(F.lpad(F.hex(syllable.cast("long")), 8, "0")), "UTF-32")
    return F.coalesce(point, F.element_at(_literal_map(tables().pairs), F.concat(first, second)))


def compose(text: Column) -> Column:
    """The canonical composed form (NFC).

    Only characters that may change or join the one before them are taken apart, with that one: decomposed,
    marks put in order, and joined from the left.
    """
    known = tables()
    active, other, parts = _guarded(known.active), _not_guarded(known.active), _literal_map(known.decomposed)
    names, codes = "".join(known.weights), "".join(chr(0x100 + w) for w in known.weights.values())

    def split_up(c: Column) -> Column:
        return F.when(c.rlike(f"[{SYLLABLES}]"), _jamo(c)).otherwise(F.coalesce(F.element_at(parts, c), c))

    def step(acc: Column, c: Column) -> Column:
        def joined(x: Column) -> Column:
            weight, one = x["weight"], x["one"]
            starts = weight == 0
            return (F.when(one.isNotNull(), F.struct(acc["done"].alias("done"), one.alias("first"), acc["tail"].alias("tail"), acc["last"].alias("last")))
                    .when(starts, F.struct(F.concat(acc["done"], acc["first"], acc["tail"]).alias("done"), c.alias("first"),
                                           F.lit("").alias("tail"), F.lit(0).alias("last")))
                    .otherwise(F.struct(acc["done"].alias("done"), acc["first"].alias("first"), F.concat(acc["tail"], c).alias("tail"), weight.alias("last"))))

        code = F.ascii(F.translate(c, names, codes))
        weight = F.when(c.rlike(f"[{_classed(map(ord, known.weights))}]"), code - 0x100).otherwise(0)
        # a mark is blocked by one of its own or a higher class before it, a starter by any mark
        free = (acc["tail"] == "") | (acc["last"] < weight)
        return bind(F.struct(weight.alias("weight"), F.when(free & (acc["first"] != ""), _joined(acc["first"], c)).alias("one")), joined)

    def put_together(chars: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), F.lit("").alias("first"), F.lit("").alias("tail"), F.lit(0).alias("last"))
        return F.aggregate(chars, start, step, lambda acc: F.concat(acc["done"], acc["first"], acc["tail"]))

    def renewed(piece: Column) -> Column:
        apart = F.array_join(F.transform(F.split(piece, ""), split_up), "")
        return F.when(piece.rlike(active), put_together(F.split(_ordered(apart, known.weights), ""))).otherwise(piece)

    pattern = f"{other}?{active}+|{other}+(?={other}{active})|{other}+"
    return bind(text, lambda t: F.when(t.rlike(active), _pieces(t, pattern, renewed)).otherwise(t))


@lru_cache(maxsize=1)
def _entity_tables() -> tuple[dict[str, str], str, dict[str, str]]:
    named = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    legacy = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    # numeric references into the C1 block mean Windows-1252, as browsers read them
    windows = {}
    for code in range(0x80, 0xA0):
        try:
            windows[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            windows[str(code)] = chr(code)
    windows["13"] = "\r"
    return named, "|".join(legacy), windows


def unescape_entities(text: Column) -> Column:
    """Decode named and numeric character references once; rows without ``&`` are untouched."""
    named, legacy, windows = _entity_tables()
    names, c1 = _literal_map(named), _literal_map(windows)

    def number(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "^#[xX]?0*(?=.)", "")
        # more than eight digits without leading zeros are beyond the last code point
        code = (F.when(F.length(digits) > 8, F.lit(0x110000).cast("long"))
                .when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long")))
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        # control codes and non-characters decode to nothing
        void = (code.between(1, 8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F)
                | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
        point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (F.when(bad, F.lit("�"))
                .when(code.between(0x80, 0x9F) | (code == 13), F.element_at(c1, code.cast("string")))
                .when(void, F.lit("")).otherwise(point))

    def piece(part: Column, at: Column) -> Column:
        ref = F.regexp_extract(part, "^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31})(;?)", 1)
        closed = F.substr(part, F.length(ref) + 1, F.lit(1)) == ";"
        rest = F.substr(part, F.length(ref) + F.when(closed, 2).otherwise(1))
        known = (F.when(ref == "amp", "&").when(ref == "lt", "<").when(ref == "gt", ">")
                 .when(ref == "quot", '"').when(ref == "nbsp", " ").otherwise(F.element_at(names, ref)))
        old = F.regexp_extract(part, f"^({legacy})", 1)
        return (F.when(at == 0, part)
                .when(F.startswith(ref, F.lit("#")), F.concat(number(ref), rest))
                .when((ref != "") & closed & known.isNotNull(), F.concat(known, rest))
                .when(old != "", F.concat(F.element_at(names, old), F.substr(part, F.length(old) + 1)))
                .otherwise(F.concat(F.lit("&"), part)))

    def decoded(value: Column) -> Column:
        return F.array_join(F.transform(F.split(value, "&"), piece), "")

    return bind(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))
