"""TF-IDF features as long tables: word and character blocks side by side.

Texts are placed by row id once, and their terms are counted there text by text (`counting`); where a
vocabulary is known, no other term leaves the task that counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lines
from ..functions import ngrams as ng
from ..session import InputError, broadcast_counted, broadcast_within, cut_lineage
from . import counting, digests
from .ranking import running_sums


@dataclass(frozen=True)
class FeatureSpec:
    """Blocks, n-gram lengths and vocabulary limits."""

    word_ngrams: tuple[int, int] = (1, 2)
    char_ngram: int = 5
    use_char: bool = True
    max_word_features: int = 80_000
    max_char_features: int = 120_000
    min_df: int = 2
    max_df: float = 0.95
    drop_words: tuple[str, ...] = ()
    stem: bool = False

    def caps(self) -> dict[str, int]:
        caps = {"word": self.max_word_features}
        return {**caps, "char": self.max_char_features} if self.use_char else caps


def place(rows: DataFrame, row_id: str) -> DataFrame:
    """Hash-place rows by id: everything grouped by (id, ...) afterwards needs no further exchange."""
    return rows.repartition(row_id)


def own_tokens(normal: Column, spec: FeatureSpec) -> Column:
    """The tokens of a normalised text that the features are made of."""
    tokens = ng.word_tokens(normal)
    if spec.drop_words:
        tokens = F.filter(tokens, lambda w: ~w.isin(*spec.drop_words))
    return F.transform(tokens, lambda w: lines.stem(w)) if spec.stem else tokens


def terms(rows: DataFrame, spec: FeatureSpec = FeatureSpec(), row_id: str = "row_id", text: str = "text",
          keep: Sequence[str] = ()) -> DataFrame:
    """``(row_id, block, term)``, one row per occurrence; a row without terms has one null term."""
    base = rows.select(row_id, *keep, ng.normalised(F.col(text)).alias("_n"))
    base = base.withColumn("_t", own_tokens(F.col("_n"), spec))
    low, high = spec.word_ngrams
    words = F.flatten(F.array(*[ng.joined_runs(F.col("_t"), n) for n in range(low, high + 1)]))
    blocks = [F.struct(F.lit("word").alias("block"), words.alias("terms"))]
    if spec.use_char:
        source = F.array_join("_t", " ") if spec.drop_words or spec.stem else F.col("_n")
        blocks.append(F.struct(F.lit("char").alias("block"), ng.padded_char_runs(source, spec.char_ngram).alias("terms")))
    return (base.select(row_id, *keep, F.explode(F.array(*blocks)).alias("b"))
            .select(row_id, *keep, "b.block", F.explode_outer("b.terms").alias("term")))


#: a set of so many terms at most is sent to the tasks that count
SENT_TERMS = 1 << 20


def sent_terms(terms: DataFrame) -> Broadcast | None:
    """The terms of ``terms(block, term)`` by block, sent to all tasks; None for more than a task should hold."""
    found = terms.select("block", "term").limit(SENT_TERMS + 1).toArrow()
    if found.num_rows > SENT_TERMS:
        return None
    sets = {"word": set(), "char": set()}
    for block, term in zip(found["block"].to_pylist(), found["term"].to_pylist(), strict=True):
        sets.setdefault(block, set()).add(term)
    return terms.sparkSession.sparkContext.broadcast(sets)


def sent_known(terms: DataFrame, spec: FeatureSpec) -> Broadcast | None:
    """The terms of ``terms(block, term)`` to be looked for in tasks; None for more than a task should hold."""
    found = terms.select("block", "term").limit(SENT_TERMS + 1).toArrow()
    if found.num_rows > SENT_TERMS:
        return None
    sets = {block: set() for block in digests.BLOCKS}
    for block, term in zip(found["block"].to_pylist(), found["term"].to_pylist(), strict=True):
        if block in sets and term is not None:
            sets[block].add(term)
    known = digests.Known.of(spec, {block: sorted(some) for block, some in sets.items()})
    return terms.sparkSession.sparkContext.broadcast(known)


def tokenised(rows: DataFrame, spec: FeatureSpec, text: str = "text") -> DataFrame:
    """``rows`` with what is counted of their texts in place of these; whoever counts them again need not cut them again."""
    return _tokenised(rows, spec, text, [c for c in rows.columns if c != text])


def _counted_columns(rows: DataFrame, spec: FeatureSpec, text: str) -> list[str]:
    """The columns to count: those of `tokenised`, or the text."""
    return ["_t", "_c"][:1 + spec.use_char] if "_t" in rows.columns and text not in rows.columns else [text]


def placed_tokens(rows: DataFrame, spec: FeatureSpec, key: Sequence[str], text: str) -> DataFrame:
    """``(*key, tokens[, text])`` to be counted; rows of the first key are neighbours in one task."""
    placed = place(rows.select(*key, *_counted_columns(rows, spec, text)), key[0])
    return _tokenised(placed.sortWithinPartitions(*key), spec, text, key)


def term_counts(rows: DataFrame, spec: FeatureSpec = FeatureSpec(), row_id: str = "row_id", text: str = "text",
                keep: Sequence[str] = (), known: DataFrame | None = None) -> DataFrame:
    """``(row_id, block, term, tf)``; rows of one id are counted together, which ``place`` brings to one task.

    With ``known(block, term)``, a vocabulary, other terms may be left out; a row without known ones has a null term.
    """
    return _counted(rows, spec, row_id, text, keep, None if known is None else sent_known(known, spec))


def _counted(rows: DataFrame, spec: FeatureSpec, row_id: str, text: str, keep: Sequence[str], sent: Broadcast | None) -> DataFrame:
    key = [row_id, *keep]
    tokens = placed_tokens(rows, spec, key, text)
    schema = T.StructType([*(tokens.schema[c] for c in key), T.StructField("block", T.StringType()),
                           T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    if sent is None:
        return tokens.mapInArrow(lambda batches: counting.per_row(batches, spec, len(key)), schema)
    return tokens.mapInArrow(lambda batches: digests.per_row(batches, sent.value, len(key), schema.names), schema)


def frequencies(counts: DataFrame) -> DataFrame:
    """``(block, term, df, cf)``: document and corpus frequency."""
    return counts.where("term is not null").groupBy("block", "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _tokenised(rows: DataFrame, spec: FeatureSpec, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """What is counted of a text: its tokens, and the text that character n-grams are cut from."""
    if (columns := _counted_columns(rows, spec, text)) != [text]:
        return rows.select(*keep, *columns)
    base = rows.select(*keep, ng.normalised(F.col(text)).alias("_n")).withColumn("_t", own_tokens(F.col("_n"), spec))
    return base.select(*keep, F.array_join("_t", " ").alias("_t"), *([_char_source(spec).alias("_c")] if spec.use_char else []))


def _char_source(spec: FeatureSpec) -> Column:
    return F.array_join("_t", " ") if spec.drop_words or spec.stem else F.col("_n")


def occurrences(rows: DataFrame, spec: FeatureSpec = FeatureSpec(), text: str = "text") -> DataFrame:
    """``(block, term, cf)``: how often each term stands in all texts.

    No text is shuffled.  Character n-grams never leave their word, so a task cuts each word it meets again only once.
    """
    counted = _tokenised(rows, spec, text).mapInArrow(lambda batches: counting.occurrences(batches, spec), counting.BATCH)
    return counted.groupBy("block", "term").agg(F.sum("n").alias("cf"))


def document_counts(rows: DataFrame, wanted: DataFrame, spec: FeatureSpec = FeatureSpec(), text: str = "text", row_id: str | None = None) -> DataFrame:
    """``(block, term, df)`` of the ``wanted(block, term)`` that stand in some text; ``wanted`` is a stored table.

    Every row is a text; with ``row_id``, rows of one id are one text.
    """
    key = [] if row_id is None else [row_id]
    tokens = placed_tokens(rows, spec, key, text) if key else _tokenised(rows, spec, text)
    sent = sent_terms(wanted)
    counted = tokens.mapInArrow(
        lambda batches: counting.documents(batches, spec, len(key), sent and sent.value), counting.BATCH)
    if sent is None:
        counted = counted.join(broadcast_counted(wanted.select("block", "term"), "term"), ["block", "term"], "left_semi")
    return counted.groupBy("block", "term").agg(F.sum("n").alias("df"))


def digest_counts(rows: DataFrame, spec: FeatureSpec = FeatureSpec(), text: str = "text") -> DataFrame:
    """``(block, code, cf)``: `occurrences` by the terms' digests."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    counted = _tokenised(rows, spec, text).mapInArrow(lambda batches: digests.occurrences(batches, spec), schema)
    block = F.get(F.array(*[F.lit(b) for b in digests.BLOCKS]), F.col("kind")).alias("block")
    return counted.groupBy("kind", "code").agg(F.sum("n").alias("cf")).select(block, "code", "cf")


def sketched(rows: DataFrame, spec: FeatureSpec = FeatureSpec(), text: str = "text") -> digests.Sketch:
    """Upper bounds of `occurrences` in tables of a fixed size: tasks hand on their counters, never their terms."""
    schema = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    pieces = _tokenised(rows, spec, text).mapInArrow(lambda batches: digests.sketch(batches, spec), schema)
    found = pieces.repartition("piece").mapInArrow(digests.added, schema).collect()
    return digests.Sketch.of(spec, [(r["piece"], bytes(r["counts"])) for r in found])


def known_frequencies(rows: DataFrame, known: digests.Known, text: str = "text", row_id: str | None = None) -> DataFrame:
    """``(block, term, df, cf)`` of the known terms.  Every row is a text; with ``row_id``, rows of one id are one text."""
    sent, spec, keys = rows.sparkSession.sparkContext.broadcast(known), known.spec, 0 if row_id is None else 1
    tokens = placed_tokens(rows, spec, [row_id], text) if keys else _tokenised(rows, spec, text)
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("code", T.LongType()), T.StructField("term", T.StringType()),
                           T.StructField("df", T.LongType()), T.StructField("cf", T.LongType())])
    return (tokens.mapInArrow(lambda batches: digests.documents(batches, sent.value.fresh(), keys), schema).groupBy("block", "code")
            .agg(F.min("term").alias("term"), F.sum("df").alias("df"), F.sum("cf").alias("cf")).drop("code"))


def wanted_terms(wanted: DataFrame, spec: FeatureSpec) -> digests.Known | None:
    """The terms whose digests are ``wanted(block, code)``; None for more than a task should hold."""
    found = wanted.select("block", "code").limit(SENT_TERMS + 1).toArrow()
    if found.num_rows > SENT_TERMS:
        return None
    blocks, codes = np.array(found["block"].to_pylist(), object), found["code"].to_numpy().view(np.uint64)
    return digests.Known(spec, {b: codes[blocks == b] for b in digests.BLOCKS})


#: terms beyond the cap whose document counts are taken in the first round, as a share of the cap
SPARE = 0.25
#: caps in all up to which a sketch tells the terms at the top from others
SKETCHED = 1 << 14


def corpus_vocabulary(rows: DataFrame, n_docs: int, spec: FeatureSpec = FeatureSpec(), text: str = "text",
                      row_id: str | None = None) -> DataFrame:
    """The vocabulary of `select_vocabulary`, counting documents only of terms that can still reach the cut.

    Every row is a document; with ``row_id``, rows of one id are one, as in `term_counts`.

    The cap takes the terms that stand most often, so occurrences are counted first, and documents only of the terms
    at the top.  Should too many of these be too rare or too common, the next round takes more.  For small caps the
    occurrences are bounded by a sketch, else counted by digest.
    """
    limits = dict(spec.caps())

    def enough(counted: DataFrame, cuts: dict[str, int], open_: set[str]) -> bool:
        able = counted.where((F.col("df") >= spec.min_df) & (F.col("df") <= spec.max_df * n_docs))
        reached = reduce(or_, [(F.col("block") == block) & (F.col("cf") >= cut) for block, cut in cuts.items()], F.lit(False))
        full = {r["block"]: r["n"] for r in able.where(reached).groupBy("block").agg(F.count("*").alias("n")).collect()}
        return all(full.get(block, 0) >= limits[block] for block in open_ & limits.keys())

    extra = SPARE
    if sum(limits.values()) <= SKETCHED:
        bounds = sketched(rows, spec, text)
        while max(limits.values()) * (1 + extra) <= 16 * SKETCHED:
            cuts = bounds.cuts({block: int(limit * (1 + extra)) + 1 for block, limit in limits.items()}, spec.min_df)
            counted = cut_lineage(known_frequencies(rows, bounds.candidates(spec, cuts), text, row_id))
            if enough(counted, cuts, {block for block, cut in cuts.items() if cut > max(spec.min_df, 1)}):
                return select_vocabulary(counted, n_docs, spec)
            extra = 4 * extra + 1
    all_ = cut_lineage(digest_counts(rows, spec, text).where(F.col("cf") >= spec.min_df))
    above = running_sums(all_.groupBy("block", "cf").agg(F.count("*").alias("k")), ["block"], "cf", ["k"])
    above = cut_lineage(above)  # per frequency: terms that stand at least so often
    while True:
        reach = F.lit(None)
        for block, limit in limits.items():
            reach = F.when(F.col("block") == block, int(limit * (1 + extra))).otherwise(reach)
        # the highest frequency at which there are enough terms, or the lowest there is
        cuts = above.groupBy("block").agg(F.coalesce(F.max(F.when(F.col("k") >= reach, F.col("cf"))), F.min("cf")).alias("cut"), F.min("cf").alias("lowest"))
        known = wanted_terms(all_.join(F.broadcast(cuts), "block").where("cf >= cut"), spec)
        if known is None:  # more than tasks hold: all terms are counted as strings
            every = cut_lineage(occurrences(rows, spec, text).where(F.col("cf") >= spec.min_df))
            return select_vocabulary(every.join(document_counts(rows, every, spec, text, row_id), ["block", "term"]), n_docs, spec)
        counted = cut_lineage(known_frequencies(rows, known, text, row_id))
        found = cuts.collect()
        if enough(counted, {r["block"]: r["cut"] for r in found}, {r["block"] for r in found if r["cut"] > r["lowest"]}):
            return select_vocabulary(counted, n_docs, spec)
        extra = 4 * extra + 1


def known_counts(rows: DataFrame, vocab: DataFrame, spec: FeatureSpec = FeatureSpec(), row_id: str = "row_id", text: str = "text") -> DataFrame:
    """``(row_id, block, term, tf)`` of the vocabulary's terms."""
    sent = sent_known(vocab, spec)
    listed = _counted(rows, spec, row_id, text, (), sent).where("term IS NOT NULL")
    if sent is None:
        listed = listed.join(vocabulary_hint(vocab.select("block", "term"), spec), ["block", "term"], "left_semi")
    return listed.select(row_id, "block", "term", "tf")


def known_lists(rows: DataFrame, vocab: DataFrame, spec: FeatureSpec = FeatureSpec(), row_id: str = "row_id", text: str = "text") -> DataFrame:
    """``(row_id, block, terms)``: which of the vocabulary's terms a row has, in one array; rows without any are left out."""
    sent = sent_known(vocab, spec)
    if sent is None:
        return known_counts(rows, vocab, spec, row_id, text).groupBy(row_id, "block").agg(F.collect_list("term").alias("terms"))
    tokens = placed_tokens(rows, spec, [row_id], text)
    schema = T.StructType([tokens.schema[row_id], T.StructField("block", T.StringType()), T.StructField("terms", T.ArrayType(T.StringType()))])
    return tokens.mapInArrow(lambda batches: digests.lists(batches, sent.value, schema.names), schema)


def select_vocabulary(freq: DataFrame, n_docs: Column | int, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """``(block, term, df, idf, column)``: the capped vocabulary in alphabetical column order.

    The cap keeps the terms with the highest corpus frequency, ties alphabetical.  The cut is
    found on the histogram of frequencies; only the terms at the cut frequency are ordered.
    """
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    # stored once: the histogram, the sure terms and the ties all read it
    able = cut_lineage(freq.where((F.col("df") >= spec.min_df) & (F.col("df") <= spec.max_df * n)))
    hist = able.groupBy("block", "cf").agg(F.count("*").alias("k"))
    upto = running_sums(hist, ["block"], "cf", ["k"])
    cap = F.lit(None)
    for block, limit in spec.caps().items():
        cap = F.when(F.col("block") == block, limit).otherwise(cap)
    # per block: all terms above ``full`` fit; of those at ``edge`` there is room for ``room``
    cut = upto.groupBy("block").agg(
        F.min(F.when(F.col("k") <= cap, F.col("cf"))).alias("full"),
        F.max(F.when(F.col("k") <= cap, F.col("k"))).alias("taken"),
        F.max(F.when(F.col("k") > cap, F.col("cf"))).alias("edge"))
    judged = able.join(cut, "block")
    sure = judged.where(F.col("cf") >= F.coalesce("full", F.col("cf") + 1)).select("block", "term", "df")
    picked = sure
    for block, limit in spec.caps().items():
        # a top-k per task, merged: never more than ``limit`` rows from any task
        ties = (judged.where((F.col("block") == block) & (F.col("cf") == F.col("edge")))
                .withColumn("_room", limit - F.coalesce("taken", F.lit(0))).orderBy("term").limit(limit))
        order = Window.partitionBy("block").orderBy("term")
        picked = picked.unionByName(ties.withColumn("_r", F.row_number().over(order))
                                    .where(F.col("_r") <= F.col("_room"))
                                    .select("block", "term", "df"))
    column = F.row_number().over(Window.partitionBy("block").orderBy("term")) - 1  # at most the cap per block
    return picked.select("block", "term", "df",
                         (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf"), column.alias("column"))


def require_vocabulary(vocab: DataFrame) -> None:
    if vocab.isEmpty():
        raise InputError("the vocabulary is empty: lower min_df or raise max_df")


def vocabulary_hint(vocab: DataFrame, spec: FeatureSpec, extra_bytes: int = 0) -> DataFrame:
    """The caps bound the vocabulary, so its size is known before it is built."""
    return broadcast_within(vocab, sum(spec.caps().values()), 96 + extra_bytes)


def weights(counts: DataFrame, vocab: DataFrame, spec: FeatureSpec = FeatureSpec(), row_id: str = "row_id") -> DataFrame:
    """``(row_id, block, term, column, w)``: unnormalised sublinear tf x idf, unknown terms gone."""
    known = vocabulary_hint(vocab.select("block", "term", "idf", "column"), spec)
    return counts.join(known, ["block", "term"]).select(
        row_id, "block", "term", "column", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))


def tfidf(counts: DataFrame, vocab: DataFrame, spec: FeatureSpec = FeatureSpec(), row_id: str = "row_id") -> DataFrame:
    """``(row_id, block, term, column, tfidf)``: L2-normalised per row and block.

    The window runs in the placement of the counts: no exchange, groups no longer than a row.
    """
    w = weights(counts, vocab, spec, row_id)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(row_id, "block")))
    return w.select(row_id, "block", "term", "column", (F.col("w") / norm).alias("tfidf"))


def row_norms(counts: DataFrame, vocab: DataFrame, spec: FeatureSpec = FeatureSpec(), row_id: str = "row_id") -> DataFrame:
    """Per row and block: kept terms and their squared norm; rows without kept terms stay with 0."""
    known = vocabulary_hint(vocab.select("block", "term", "idf"), spec)
    w = (1 + F.ln("tf")) * F.col("idf")
    return counts.join(known, ["block", "term"], "left").groupBy(row_id, "block").agg(
        F.count("idf").alias("terms"), F.coalesce(F.sum(w * w), F.lit(0.0)).alias("squared"))


def statistics(counts: DataFrame, vocab: DataFrame, spec: FeatureSpec = FeatureSpec(), row_id: str = "row_id") -> DataFrame:
    """Per block: non-zeros, features, non-zeros per row, and whether the cap was reached."""
    rows = row_norms(counts, vocab, spec, row_id)
    nnz = rows.groupBy("block").agg(F.sum("terms").alias("nnz"), F.count("*").alias("n_rows"))
    size = vocab.groupBy("block").agg(F.count("*").alias("features"))
    cap = F.lit(None)
    for block, limit in spec.caps().items():
        cap = F.when(F.col("block") == block, limit).otherwise(cap)
    return nnz.join(size, "block").select(
        "block", "nnz", "features", (F.col("nnz") / F.col("n_rows")).alias("per_row"),
        (F.col("features") >= cap).alias("saturated"))


def feature_ids(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """Blocks laid side by side: word columns first, then character columns."""
    words = vocab.where("block = 'word'").count()  # one number
    return features.withColumn("feature", F.when(F.col("block") == "word", F.col("column")).otherwise(F.col("column") + words))


def sparse_rows(features: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``(row_id, indices, values)`` in ascending feature order -- one sparse vector per row."""
    cells = F.array_sort(F.collect_list(F.struct(F.col("feature").cast("int").alias("i"), F.col("tfidf").alias("v"))))
    grouped = features.groupBy(row_id).agg(cells.alias("c"))
    return grouped.select(row_id, F.col("c.i").alias("indices"), F.col("c.v").alias("values"))
