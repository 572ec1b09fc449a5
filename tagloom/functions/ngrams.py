"""Word and character n-grams as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import strip_accents


def normalised(text: Column) -> Column:
    """Lower case without accents: what both feature blocks are cut from."""
    return strip_accents(F.lower(F.coalesce(text, F.lit(""))))


def word_tokens(text: Column) -> Column:
    """Tokens of two or more word characters."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def joined_runs(tokens: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, joined by a space; tokens are runs of word characters, as of `word_tokens`.

    One search over the joined tokens: building a run in a lambda costs several times as much.
    """
    if n == 1:
        return tokens
    run = rf"(?<!\S)(?=(\S++(?: \S++){{{n - 1}}}))\S++"
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(run), F.lit(1))


def spaced_words(normal: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(normal, r"\s+"), lambda w: w != "")


def word_char_runs(word: Column, n: int = 5) -> Column:
    """Character n-grams of one word padded with spaces; a padded word of at most ``n`` is one gram."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    last = F.greatest(F.length(padded) - (n - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(padded, i, F.lit(n)))


def padded_char_runs(normal: Column, n: int = 5) -> Column:
    """Character n-grams of each word of a text, as `word_char_runs` has them, by one search over the text."""
    if n < 3:
        return F.flatten(F.transform(spaced_words(normal), lambda w: word_char_runs(w, n)))
    windows = [rf" \S{{{n - 1}}}", rf"\S{{{n}}}", rf"\S{{{n - 1}}} ", rf" \S{{{n - 2}}} "]
    if n > 3:
        windows.append(rf" \S{{1,{n - 3}}} ")
    spaced = F.concat(F.lit(" "), F.regexp_replace(normal, r"\s", " "), F.lit(" "))
    # one character is taken at a time, so that a window never starts inside a surrogate pair
    return F.regexp_extract_all(spaced, F.lit(rf"(?s)(?=({'|'.join(windows)}))."), F.lit(1))
