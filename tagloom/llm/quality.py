"""Quality rules whose cut-offs are learnt: quantile sketches per language and source, then a joined filter.

Every text is measured once.  Each measure is a rate, put into one of a fixed number of buckets
(`bucket`): the counts per bucket are a quantile sketch with a bounded relative error, and two
sketches merge by adding counts.  They are kept per (language, source), merged up to the language and
to the whole table, and a fence per group and measure is read from them:

    fence = median + SPREAD * (median - lower decile) + slack of the measure

Only the lower half of a distribution sets its fence, so a group stays usable while less than half of
it is junk.  A group of fewer than MIN_GROUP texts uses its language's sketch, a small language that of
the table.  Texts above any fence are rejected, and those that fail the base rules (see `base_failed`).

Nulls: a null text is measured as an empty one and fails the base rules; a null language or source is
a group of its own.  Repeated rows are measured one by one.  Extra columns are ignored by `measure`
and carried through by `keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from tagloom.llm import words as W
from tagloom.llm.staging import staged

#: measures: parts in a thousand of (numerator, denominator), and the slack added to the learnt fence
MEASURES = {
    "symbols": ("n_symbols", "n_words", 80),
    "shouting": ("n_upper", "word_chars", 300),
    "marks": ("n_marks", "n_words", 300),
    "dup_lines": ("n_dup_lines", "n_lines", 500),
    "stutter": ("n_stutter", "n_words", 200),
}
SPREAD = 4
MIN_GROUP = 30
MIN_WORDS = 20
WINDOW = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: sentence marks that shouting or garbled text repeats; the symbols above are counted by themselves
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?^~@=+_{}[]\\")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[0x0A] = True
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_stutter")
_TYPE = StructType([StructField(f, LongType()) for f in FIELDS])


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True bytes in each text."""
    sums = np.concatenate(([0], np.cumsum(mask)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each value, whether the same text holds it elsewhere too."""
    order = np.lexsort((values, text))
    same = (values[order][1:] == values[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(values), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _earlier(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each value, whether the same text held it before."""
    order = np.lexsort((values, text))
    out = np.zeros(len(values), bool)
    out[order[1:]] = (values[order][1:] == values[order][:-1]) & (text[order][1:] == text[order][:-1])
    return out


def measure_block(block: W.Block) -> dict[str, np.ndarray]:
    found = W.words(block, lower=False)
    n = np.diff(found.bounds)
    spaces = W.SPACES[block.data]
    out = {
        "n_words": n,
        "word_chars": _per_text(~spaces & ~_CONTINUES[block.data], block.offsets),
        "n_symbols": _per_text(_SYMBOLS[block.data], block.offsets),
        "n_upper": _per_text(_UPPER[block.data], block.offsets),
        "n_marks": _per_text(_MARKS[block.data], block.offsets),
    }
    # lines: the stretches between line feeds that hold a word
    starts, ends, bounds = W.runs(block, _LINE_END)
    sums = np.concatenate(([0], np.cumsum(~spaces)))
    worded = sums[ends] > sums[starts]
    line_text = np.repeat(np.arange(block.texts), np.diff(bounds))[worded]
    lines = W.stretch_hashes(block, starts[worded], ends[worded], lower=False)
    out["n_lines"] = np.bincount(line_text, minlength=block.texts)
    out["n_dup_lines"] = np.bincount(line_text[_earlier(lines, line_text)], minlength=block.texts)
    # words equal to the word before them
    text = found.text_of()
    again = (found.hashes[1:] == found.hashes[:-1]) & (text[1:] == text[:-1])
    out["n_stutter"] = np.bincount(text[1:][again], minlength=block.texts)
    # words covered by windows that occur twice or more
    value, at = W.windows(found, WINDOW)
    covered = np.zeros(len(text) + 1, np.int64)
    twice = at[_repeated(value, text[at])] if len(at) else at
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    inside = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(text[inside], minlength=block.texts)
    return out


def _measures(texts: pa.Array) -> pa.Array:
    parts = [measure_block(b) for b in W.blocks(texts)]
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate([p[f] for p in parts]) if parts else [], pa.int64()) for f in FIELDS], list(FIELDS))


def measures(text: Column) -> Column:
    """Struct of the counts in FIELDS for a text column."""
    return arrow_udf(_measures, _TYPE)(text)


def base_failed(m: Column) -> Column:
    """Too short, or too much of it stands in windows that occur again."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def rate(m: Column, name: str) -> Column:
    top, bottom, _ = MEASURES[name]
    return F.when(m[bottom] > 0, F.floor(1000 * m[top] / m[bottom])).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """Bucket of a rate in thousandths: exact below 32, then 16 buckets for each doubling.

    Relative error at most 1/16.
    """
    power = F.length(F.bin(F.greatest(value, F.lit(32)))) - 1
    inside = F.floor(value / F.pow(F.lit(2.0), power - 4))
    return F.when(value < 32, value).otherwise((power - 5) * 16 + inside + 16).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest rate of a bucket."""
    high = F.pow(F.lit(2.0), F.floor((b - 32) / 16) + 1)
    return F.when(b < 32, b.cast("double")).otherwise((F.pmod(b, F.lit(16)) + 17) * high - 1)


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per (lang, source, measure, bucket) of rows with ``lang, source, m``."""
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), bucket(rate(F.col("m"), name)).alias("bucket")) for name in MEASURES]))
    return (measured.select("lang", "source", each.alias("e"))
            .groupBy("lang", "source", F.col("e.measure").alias("measure"), F.col("e.bucket").alias("bucket"))
            .agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def _cuts(sketch: DataFrame, *keys: str) -> DataFrame:
    """One fence per group and measure, and how many texts the group has."""
    within = Window.partitionBy(*keys, "measure")
    upto = within.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("all", F.sum("n").over(within)).withColumn("below", F.sum("n").over(upto))

    def quantile(share: float) -> Column:
        return bucket_top(F.min(F.when(F.col("below") >= share * F.col("all"), F.col("bucket"))))

    slack = F.create_map(*[x for name, (_, _, s) in MEASURES.items() for x in (F.lit(name), F.lit(s))])
    return (ranked.groupBy(*keys, "measure")
            .agg(quantile(0.5).alias("middle"), quantile(0.1).alias("low"), F.max("all").alias("texts"))
            .select(*keys, "measure", "texts", (F.col("middle") + SPREAD * (F.col("middle") - F.col("low"))
                                                + slack[F.col("measure")]).alias("fence")))


def fences(sketch: DataFrame) -> DataFrame:
    """Per (lang, source): a map from measure to fence, from the smallest group that is large enough."""
    own = _cuts(sketch, "lang", "source")
    by_lang = _cuts(merged(sketch, "lang"), "lang").withColumnsRenamed({"texts": "lang_texts", "fence": "lang_fence"})
    whole = _cuts(merged(sketch)).select("measure", F.col("fence").alias("all_fence"))
    own, by_lang = own.alias("own"), by_lang.alias("by_lang")
    same = F.col("own.lang").eqNullSafe(F.col("by_lang.lang")) & (F.col("own.measure") == F.col("by_lang.measure"))
    joined = own.join(by_lang, same).select("own.*", "lang_texts", "lang_fence").join(whole, "measure")
    best = (F.when(F.col("texts") >= MIN_GROUP, F.col("fence"))
            .when(F.col("lang_texts") >= MIN_GROUP, F.col("lang_fence")).otherwise(F.col("all_fence")))
    return (joined.groupBy("lang", "source")
            .agg(F.map_from_entries(F.collect_list(F.struct("measure", best))).alias("fences")))


def judged(measured: DataFrame, fence_table: DataFrame) -> DataFrame:
    """``measured`` (with ``lang, source, m``) plus ``base_failed`` and ``kept``."""
    rows, cuts = measured.alias("rows"), fence_table.alias("cuts")
    same = F.col("rows.lang").eqNullSafe(F.col("cuts.lang")) & F.col("rows.source").eqNullSafe(F.col("cuts.source"))
    m, f = F.col("m"), F.col("fences")
    above = F.lit(False)
    for name in MEASURES:
        above = above | F.coalesce(rate(m, name) > f[name], F.lit(False))
    joined = rows.join(cuts, same, "left").select("rows.*", "fences").withColumn("base_failed", base_failed(m))
    return joined.withColumn("kept", ~F.col("base_failed") & ~above)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, m`` per row."""
    return docs.select("doc_id", "lang", "source", measures(F.col("text")).alias("m"))


#: fences are sent to every task only while they take up to this many bytes
MAX_SENT = 32 << 20


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``text, lang, source`` and others) that the base rules and the learnt fences keep."""
    measured = staged(docs.select("lang", "source", measures(F.col("text")).alias("m")))
    table = staged(fences(sketches(measured)))
    size = table.agg(F.sum(500 + 4 * (F.length(F.coalesce("lang", F.lit(""))) + F.length(F.coalesce("source", F.lit("")))))).first()[0]
    rows = docs.select(F.struct("*").alias("row"), "lang", "source", measures(F.col("text")).alias("m"))
    kept = judged(rows, F.broadcast(table) if (size or 0) <= MAX_SENT else table).where("kept")
    return kept.select("row.*")
