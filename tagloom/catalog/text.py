"""Text preparation (T rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import lines, text
from ..operators.noise import with_spelling_noise
from .registry import Catalog
from .views import ASSEMBLED, items, sql_clean, table, with_views

CATALOG = Catalog()
add = CATALOG.add
WEIGHTS = {"title": 2, "keywords": 2}
TEXT_COLUMNS = ["title", "description", "keywords"]


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@add("t1_clean_text", f"SELECT page_id, {sql_clean('html')} AS text FROM pages")
def t1(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


@add("t1_clean_text_documents", f"SELECT doc_id, {sql_clean('text')} AS text FROM documents")
def t1_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@add("t2_clean_text_v1", f"SELECT page_id, {sql_clean('html', 1)} AS text FROM pages")
def t2(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_text(F.col("html"), version=1).alias("text"))


@add("t3_strip_markup_lines")
def t3(spark, sf):
    return table(spark, sf, "pages").select("page_id", lines.strip_markup(F.col("html")).alias("text"))


@add("t4_normalise_unicode",
     "SELECT doc_id, " + "replace(" * 7 + r"regexp_replace(replace(nfc_normalize(text), chr(160), ' '), "
     r"'[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{AD}]', '', 'g')"
     + "".join(f", '{k}', '{v}')" for k, v in lines.LIGATURES.items()) + " AS text FROM documents")
def t4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lines.normalise_unicode(F.col("text")).alias("text"))


@add("t5_weighted_assembly", with_views("items", f"SELECT item_id, {ASSEMBLED} AS text FROM items"))
def t5(spark, sf):
    df = items(spark, sf)
    return df.select("item_id", text.assemble(TEXT_COLUMNS, WEIGHTS, df.columns).alias("text"))


@add("t7_record_text", with_views("items", """
SELECT item_id, CASE WHEN item_id % 5 = 0 THEN NULL
  ELSE concat(title, ' ', title, ' ', '', ' ', keywords) END AS text FROM items"""))
def t7(spark, sf):
    df = items(spark, sf)
    record = F.when(F.col("item_id") % 5 == 0, F.to_json(F.struct(F.col("item_id").alias("other")))) \
        .otherwise(F.to_json(F.struct("title", "keywords")))
    return df.select("item_id", text.assemble_record(record, ["title", "summary", "keywords"], {"title": 2}).alias("text"))


@add("t8_duplicate_key", "SELECT doc_id, md5(strip_accents(lower(text))) AS key FROM documents")
def t8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.duplicate_key(F.col("text")).alias("key"))


@add("t9_min_length", f"SELECT doc_id, length({sql_clean('text')}) AS n FROM documents WHERE length({sql_clean('text')}) >= 60")
def t9(spark, sf):
    cleaned = table(spark, sf, "documents").select("doc_id", F.length(text.clean_text(F.col("text"))).alias("n"))
    return cleaned.where("n >= 60")


@add("t10_letter_ratio", r"""
SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) * 1.0 /
  nullif(length(regexp_replace(text, '[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')), 0), 5) AS ratio
FROM documents""")
def t10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(text.letter_ratio(F.col("text")), 5).alias("ratio"))


@add("t11_words", r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '\p{L}[\p{L}\p{N}_]*(?:-[\p{L}\p{N}_]+)*'), '|') AS words,
       len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n_plain
FROM documents""")
def t11(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.words(F.col("text")), "|").alias("words"),
        F.size(text.plain_words(F.col("text"))).cast("bigint").alias("n_plain"))


@add("t12_stopword_flags", rf"""
SELECT doc_id, count(*) AS n_words,
       count(*) FILTER (WHERE w IN ({_quoted(lx.STOPWORDS)})) AS n_stop,
       count(*) FILTER (WHERE w IN ({_quoted(lx.GENERIC_TERMS)})) AS n_generic
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}[\p{{L}}\p{{N}}_]*(?:-[\p{{L}}\p{{N}}_]+)*')) AS w FROM documents)
GROUP BY doc_id""")
def t12(spark, sf):
    # the lists are parameters of bounded size, so the test stays a map-side array filter
    doc = table(spark, sf, "documents").select("doc_id", text.words(F.lower("text")).alias("w"))
    def hits(listed):
        return F.size(F.filter("w", lambda x: x.isin(*listed))).cast("bigint")
    return doc.where(F.size("w") > 0).select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"),
        hits(lx.STOPWORDS).alias("n_stop"), hits(lx.GENERIC_TERMS).alias("n_generic"))


_LINES = "(SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)"


def _doc_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")) \
        .select("doc_id", F.trim("line").alias("line"))


_PAGE_LINES = """(SELECT page_id, trim(unnest(string_split(
  regexp_replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '<[^<>]+>', chr(10), 'g'), chr(10)))) AS line FROM pages)"""


@add("t13_boilerplate_lines", rf"""
WITH l AS (SELECT page_id, line, lower(line) AS low,
  regexp_extract_all(lower(line), '\p{{L}}[\p{{L}}\p{{N}}_]*(?:-[\p{{L}}\p{{N}}_]+)*') AS t FROM {_PAGE_LINES})
SELECT page_id, line, (length(line) <= 200 AND len(list_filter([{_quoted(lx.BOILERPLATE_PHRASES)}], lambda p: contains(low, p))) > 0)
  OR regexp_matches(line, '{lx.REFERENCE_LINE.replace("'", "''")}')
  OR (len(t) BETWEEN 1 AND 4 AND list_has_any(t, [{_quoted(lx.MENU_WORDS)}])
      AND list_has_all([{_quoted((*lx.MENU_WORDS, *lx.STOPWORDS))}], t)) AS boilerplate
FROM l WHERE line <> ''""")
def t13(spark, sf):
    html = F.replace(F.replace(F.col("html"), F.lit("&copy;"), F.lit("©")), F.lit("&middot;"), F.lit("·"))
    line = F.explode(F.split(F.regexp_replace(html, "<[^<>]+>", "\n"), "\n"))
    return table(spark, sf, "pages").select("page_id", line.alias("line")) \
        .select("page_id", F.trim("line").alias("line")).where("line <> ''") \
        .select("page_id", "line", lines.is_boilerplate(F.col("line")).alias("boilerplate"))


@add("t14_line_kinds", rf"""
WITH l AS (SELECT doc_id, line, regexp_extract(line, '^[^\p{{L}}\p{{N}}]*([\p{{L}}\p{{N}}_]+)', 1) AS w,
  regexp_extract(line, '\p{{L}}[\p{{L}}\p{{N}}_]*(?:-[\p{{L}}\p{{N}}_]+)*') AS f FROM {_LINES})
SELECT doc_id, line, regexp_matches(line, '{lx.LIST_MARKER}') AS list_item,
  regexp_matches(line, '{lx.SENTENCE_END.replace("'", "''")}') AS ends,
  regexp_matches(w, '^\p{{L}}') AND w = lower(w) AS fragment,
  lower(f) IN ('aufgabe', {_quoted(lx.TASK_VERBS)}) AS task
FROM l WHERE line <> ''""")
def t14(spark, sf):
    line = F.col("line")
    return _doc_lines(spark, sf).where("line <> ''").select(
        "doc_id", "line", lines.is_list_item(line).alias("list_item"), lines.ends_sentence(line).alias("ends"),
        lines.opens_lower(line).alias("fragment"), lines.is_task_instruction(line).alias("task"))


@add("t16_spelling_noise", """
WITH c AS (SELECT doc_id, string_split(text, '') AS ch FROM documents),
o AS (SELECT doc_id, ch, list_transform(range(len(ch)), lambda i: CASE WHEN
    CAST(concat('0x', substr(md5(concat('42|', doc_id, '|', i)), 1, 3)) AS INT) < 328
    THEN CAST(concat('0x', substr(md5(concat('42|', doc_id, '|', i)), 1, 3)) AS INT) % 3 ELSE 3 END) AS op FROM c)
SELECT doc_id, array_to_string(list_transform(range(1, len(ch) + 1), lambda i: CASE
    WHEN op[i] = 0 AND coalesce(op[i + 1], -1) = 3 THEN ch[i + 1]
    WHEN op[i] = 3 AND i > 1 AND coalesce(op[i - 1], -1) = 0 THEN ch[i - 1]
    WHEN op[i] = 1 THEN '' WHEN op[i] = 2 THEN concat(ch[i], ch[i]) ELSE ch[i] END), '') AS noisy
FROM o""")
def t16(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return with_spelling_noise(docs, "text", "doc_id", 0.08, 42, "noisy").select("doc_id", "noisy")


@add("t17_identity_normalisation", """
SELECT page_id, rtrim(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/') AS url_key
FROM pages""")
def t17(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.normalise_url(F.col("url")).alias("url_key"))


@add("t17_title_identity", with_views("items", r"""
SELECT item_id, trim(regexp_replace(lower(title), '[\s\x{A0}]+', ' ', 'g')) AS title_key FROM items"""))
def t17_title(spark, sf):
    return items(spark, sf).select("item_id", text.normalise_title(F.col("title")).alias("title_key"))


@add("t18_preview", """
SELECT doc_id, left(text, 500) AS shown, length(text) > 500 AS cut,
       CASE WHEN length(text) > 200 THEN concat(left(text, 200), '...') ELSE text END AS echo FROM documents""")
def t18(spark, sf):
    shown, cut = text.preview(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", shown.alias("shown"), cut.alias("cut"), text.echo(F.col("text")).alias("echo"))
