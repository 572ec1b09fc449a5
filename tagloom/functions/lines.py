"""Tests and rewrites on pages, lines and sentences, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx
from .bind import bind
from .text import CONTROL, MD_LINK, TAG_STRICT, letter_ratio, words
from .unicode import compose, guarded, unescape_entities

# --- fixed values ------------------------------------------------------------------------
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|caption|dd|details|div|dl|dt|fieldset|figcaption"
    "|figure|footer|form|h[1-6]|head|header|hr|legend|li|main|nav|noscript|ol|option|p|pre"
    "|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
)
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
             "ﬅ": "st", "ﬆ": "st"}
# -----------------------------------------------------------------------------------------
MARK = "[*_`~]"
LINE_BREAK = r"\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
#: white space beyond ASCII that breaks no line
GAPS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: five words, as `words` finds them
FIVE_WORDS = r"^(?:[^\p{L}]*+\p{L}[\p{L}\p{N}_]*+(?:-[\p{L}\p{N}_]++)*+){5}"
#: elements whose contents are no text
HIDDEN_TAGS = ("script", "style", "nav", "footer")
#: put behind the ``<`` of an opener that nothing closes; a private-use letter
MUTE = "\ue0f5"
ALNUM = r"[\p{L}\p{N}]"


def _mute_unclosed(text: Column, opener: str, closer: str) -> Column:
    """Openers behind the last closer cannot match; muted, they are not searched from in vain.

    So every opener that is left finds its closer, and removing the elements takes linear time.
    """
    def muted(t: Column) -> Column:
        head = F.regexp_extract(t, rf"(?is)^.*{closer}", 0)
        tail = F.regexp_replace(F.substr(t, F.length(head) + 1), rf"(?i)<(?={opener[1:]})", "<" + MUTE)
        return F.when(t.rlike(rf"(?i){opener}"), F.concat(head, tail)).otherwise(t)

    return bind(text, muted)


def _without_heading_marks(text: Column) -> Column:
    """Lines that open with one to six ``#`` lose these, and the ``#`` at their end; each step is linear."""
    opening = r"^[ \t]{0,3}#{1,6}[ \t]++"

    def bare(line: Column) -> Column:
        out = F.regexp_replace(line, opening, "")
        for trailing in (r"(?<![ \t])[ \t]++$", r"(?<!#)#++$", r"(?<![ \t])[ \t]++$"):
            out = F.regexp_replace(out, rf"(?d){trailing}", "")
        return F.when(line.rlike(opening), out).otherwise(line)

    lines = F.array_join(F.transform(F.split(text, "\n", -1), bare), "\n")
    return F.when(F.contains(text, F.lit("#")), lines).otherwise(text)


#: one step of a rewriting: what a text must hold to be changed by it (None: not told beforehand), and the change
Step = tuple[Callable[[Column], Column] | None, Callable[[Column], Column]]


def _holds(*marks: str) -> Callable[[Column], Column]:
    return lambda t: reduce(or_, [F.contains(t, F.lit(m)) for m in marks])


def _replaced(pattern: str, by: str) -> Callable[[Column], Column]:
    return lambda t: F.regexp_replace(t, pattern, by)


def _without_comments(text: Column) -> Column:
    return F.replace(F.regexp_replace(_mute_unclosed(text, "<!--", "-->"), r"(?s)<!--.*?-->", ""), F.lit(MUTE), F.lit(""))


def _muted(tag: str) -> Callable[[Column], Column]:
    return lambda t: _mute_unclosed(t, rf"<{tag}\b", rf"</{tag}\b[^<>]*>")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(unescape_entities(text), CONTROL, "")


# a run of marks stays when it is a rule of one repeated mark, or sits inside a word
_RULE = rf"({MARK})\1{{3,}}(?!{MARK})"
_INSIDE = rf"(?<={ALNUM})(?:_+|{MARK}){ALNUM}"
#: markup removal; entities are decoded last, and only a reference can bring control characters back
MARKUP_STEPS: list[Step] = [
    (_holds("\r"), _replaced(r"\r\n?", "\n")),
    (_holds("<!--", MUTE), _without_comments),
    *[(_holds("<"), _muted(tag)) for tag in HIDDEN_TAGS],
    (_holds("<"), _replaced(rf"(?is)<({'|'.join(HIDDEN_TAGS)})\b[^<>]*>.*?</\1\b[^<>]*>", "\n")),
    (_holds(MUTE), lambda t: F.replace(t, F.lit(MUTE), F.lit(""))),
    (_holds("<"), _replaced(rf"(?i)</?(?:{BLOCK_TAGS})(?=[\s/>])[^<>]*>", "\n")),
    (_holds("<"), _replaced(TAG_STRICT, "")),
    (None, _replaced(CONTROL, "")),
    (_holds("]("), _replaced(MD_LINK, "$1")),
    (_holds(">"), _replaced(r"(?dm)^(?:[ \t]{0,3}>[ \t]?)+", "")),
    (_holds("#"), _without_heading_marks),
    (_holds(*"*_`~"), _replaced(rf"(?={MARK})(?<!{MARK})(?!{_RULE})(?!{_INSIDE}){MARK}++", "")),
    (_holds("&"), _unescaped),
]


def _spelled(text: Column) -> Column:
    out = F.translate(text, "\u00a0" + ZERO_WIDTH, " ")
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def _special(text: Column) -> Column:
    return text.rlike(guarded(map(ord, "\u00a0" + ZERO_WIDTH + "".join(LIGATURES))))


#: composed form, no zero-width characters, Latin ligatures spelled out, plain spaces
UNICODE_STEPS: list[Step] = [(None, lambda t: compose(t)), (_special, _spelled)]
#: every run of white space inside a line one space; no run goes beyond its line, so a text's lines are squeezed at once
SPACE_STEPS: list[Step] = [(None, lambda t: F.regexp_replace(t, rf"[\t{guarded(map(ord, GAPS))}]+", " ")), (_holds("  "), _replaced(" {2,}", " "))]


def rewritten(df: DataFrame, column: str, steps: Sequence[Step]) -> DataFrame:
    """``df`` with ``column`` changed step by step; a text that a step cannot change is not searched.

    Every step is a projection of its own: one expression of all would be planned, level by level, for longer than it runs.
    """
    for needs, change in steps:
        t = F.col(column)
        df = df.withColumn(column, change(t) if needs is None else F.when(needs(t), change(t)).otherwise(t))
    return df


def _in_turn(text: Column, steps: Sequence[Step]) -> Column:
    return reduce(lambda out, step: step[1](out), steps, text)


def strip_markup(raw: Column) -> Column:
    """Markup removal that keeps the lines of a page."""
    return _in_turn(F.coalesce(raw, F.lit("")), MARKUP_STEPS)


def normalise_unicode(text: Column) -> Column:
    """Composed form, no zero-width characters, Latin ligatures spelled out, plain spaces."""
    return _in_turn(text, UNICODE_STEPS)


def opens_lower(text: Column) -> Column:
    """Does the first word start in lower case (and hold no upper case)?"""
    word = F.regexp_extract(text, r"^[^\p{L}\p{N}]*([\p{L}\p{N}_]+)", 1)
    return word.rlike(r"^\p{L}") & (word == F.lower(word))


def capitalised(text: Column) -> Column:
    """First letter in upper case when the text opens in lower case."""
    def lifted(t: Column) -> Column:
        at = F.length(F.regexp_extract(t, r"^[^\p{L}]*", 0))
        upper = F.upper(F.substr(t, at + 1, F.lit(1)))
        return F.when(opens_lower(t), F.concat(F.left(t, at), upper, F.substr(t, at + 2))).otherwise(t)

    return bind(text, lifted)


def is_boilerplate(line: Column, stopwords: Sequence[str] = lx.STOPWORDS) -> Column:
    """Chrome of a page: a stock phrase in a short line, a reference entry, or a menu line."""
    phrase = "|".join(re.escape(p) for p in lx.BOILERPLATE_PHRASES)
    menu = F.array(*[F.lit(w) for w in lx.MENU_WORDS])
    known = F.array(*[F.lit(w) for w in (*lx.MENU_WORDS, *stopwords)])

    def menu_line(tokens: Column) -> Column:
        return F.size(tokens).between(1, 4) & F.arrays_overlap(tokens, menu) & (F.size(F.array_except(tokens, known)) == 0)

    low = F.lower(line)
    # every form of a reference has one of these
    reference = F.contains(line, F.lit("(")) | F.contains(line, F.lit("ISBN")) | F.contains(line, F.lit("↑"))
    return (((F.length(line) <= 200) & low.rlike(phrase)) | (reference & line.rlike(lx.REFERENCE_LINE))
            | (~low.rlike(FIVE_WORDS) & bind(words(low), menu_line)))


def is_list_item(line: Column) -> Column:
    return line.rlike(lx.LIST_MARKER)


def ends_sentence(text: Column) -> Column:
    # a mark, a quote and a line's end are all it takes
    return F.right(text, F.lit(4)).rlike(lx.SENTENCE_END)


def is_task_instruction(text: Column) -> Column:
    """Opens with a task verb or the word for a task."""
    first = F.lower(F.get(words(text), 0))
    return F.coalesce(first.isin("aufgabe", *lx.TASK_VERBS), F.lit(False))


def is_description_sentence(s: Column, stopwords: Sequence[str] = lx.STOPWORDS) -> Column:
    """A whole prose sentence fit for a description."""
    return (F.length(s).between(30, 350) & ends_sentence(s) & ~opens_lower(s) & ~is_list_item(s)
            & (F.size(words(s)) >= 5) & (F.coalesce(letter_ratio(s), F.lit(0.0)) >= 0.7)
            & ~is_boilerplate(s, stopwords) & ~is_task_instruction(s))


def points_back(s: Column) -> Column:
    """Opens with a word that needs the sentence before."""
    opener = F.regexp_extract(s, r"""^["'„“”‚‘’»« ]*(\S+)""", 1)
    return F.lower(F.regexp_replace(opener, "[,:;]+$", "")).isin(*lx.BACK_REFERENCES)


def stem(word: Column) -> Column:
    """Light German stem: umlauts folded, common inflection endings cut from longer words."""
    low = F.translate(F.lower(word), "äöü", "aou")
    low = F.replace(low, F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(low, r"^(.{4,}?)(?:ern|em|en|er|es|e|s|n)$", "$1")
