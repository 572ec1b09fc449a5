"""The fixture views every registered query reads, once in Spark and once as SQL.

They are projections of the given tables, so their size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_SET = (
    "http://v/lang/de", "http://v/lang/en", "http://v/lang/es", "http://v/lang/fr",
    "http://v/flag/quality", "http://v/flag/toxic", "http://v/flag/never",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """A metadata export: text columns, a label cell, display names and mark columns."""
    d = table(spark, sf, "documents").alias("d")
    lab = table(spark, sf, "labels").alias("l")
    did = F.col("d.doc_id")
    lang, source = F.col("d.lang"), F.col("d.source")
    good, toxic = F.col("l.quality") == 1, F.col("l.toxic") == 1

    def also(cond: Column, text: Column | str) -> Column:
        return F.when(cond, text if isinstance(text, Column) else F.lit(text)).otherwise(F.lit(""))

    cell = F.concat(
        F.lit("http://v/lang/"), lang, F.lit(",http://v/source/"), source,
        also(good, ",http://v/flag/quality"), also(toxic, ",http://v/flag/toxic"),
        also(did % 50 == 0, ",http://v/lang/"),
        also(did % 31 == 0, F.concat(F.lit(" , http://v/lang/"), lang)))
    return d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        did.alias("item_id"),
        F.substring("d.text", 1, 60).alias("title"),
        F.col("d.text").alias("description"),
        F.concat(lang, F.lit(" "), source).alias("keywords"),
        F.when(did % 97 == 0, F.lit("")).otherwise(cell).alias("labels"),
        F.concat(F.lit("Sprache "), lang, F.lit(",Quelle "), source,
                 also(good, ",Gut"), also(toxic, ",Rechts-, Links")).alias("labels_displayname"),
        also(did % 11 == 0, F.concat(F.lit("http://v/lang/"), lang)).alias("generated_for"),
        F.when(did % 13 == 0, "  x").when(did % 19 == 0, "   ").otherwise("").alias("example_for"),
        also(did % 17 == 0, "keywords").alias("enriched_fields"))


ITEMS = """items AS (
SELECT d.doc_id AS item_id, substr(d.text, 1, 60) AS title, d.text AS description,
       concat(d.lang, ' ', d.source) AS keywords,
       CASE WHEN d.doc_id % 97 = 0 THEN '' ELSE
         concat('http://v/lang/', d.lang, ',http://v/source/', d.source,
           CASE WHEN l.quality = 1 THEN ',http://v/flag/quality' ELSE '' END,
           CASE WHEN l.toxic = 1 THEN ',http://v/flag/toxic' ELSE '' END,
           CASE WHEN d.doc_id % 50 = 0 THEN ',http://v/lang/' ELSE '' END,
           CASE WHEN d.doc_id % 31 = 0 THEN concat(' , http://v/lang/', d.lang) ELSE '' END) END AS labels,
       concat('Sprache ', d.lang, ',Quelle ', d.source,
           CASE WHEN l.quality = 1 THEN ',Gut' ELSE '' END,
           CASE WHEN l.toxic = 1 THEN ',Rechts-, Links' ELSE '' END) AS labels_displayname,
       CASE WHEN d.doc_id % 11 = 0 THEN concat('http://v/lang/', d.lang) ELSE '' END AS generated_for,
       CASE WHEN d.doc_id % 13 = 0 THEN '  x' WHEN d.doc_id % 19 = 0 THEN '   ' ELSE '' END AS example_for,
       CASE WHEN d.doc_id % 17 = 0 THEN 'keywords' ELSE '' END AS enriched_fields
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

LABEL_SET_SQL = "label_set AS (" + " UNION ALL ".join(
    f"SELECT {i} AS label_no, '{u}' AS label" for i, u in enumerate(LABEL_SET, 1)) + ")"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scripted scores: one row per item, ``scores`` = array of (label, y, pm) for every label.

    ``pm`` is the probability in whole thousandths, so cuts and rankings are exact.
    """
    it = items(spark, sf)
    padded = F.concat(F.lit(","), F.replace(F.col("labels"), F.lit(" "), F.lit("")), F.lit(","))

    def cell(no: int, uri: str) -> Column:
        has = F.contains(padded, F.lit(f",{uri},"))
        pm = (F.col("item_id") * 7919 + no * 104729) % 600 + F.when(has, 350).otherwise(0)
        return F.struct(F.lit(uri).alias("label"), F.when(has, 1).otherwise(0).alias("y"),
                        pm.cast("int").alias("pm"))

    return it.select("item_id", F.array(*[cell(i, u) for i, u in enumerate(LABEL_SET, 1)]).alias("scores"))


def scored_long(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("item_id", F.explode("scores").alias("s")).select("item_id", "s.*")


SCORED = """scored AS (
SELECT i.item_id, s.label,
       CASE WHEN concat(',', replace(i.labels, ' ', ''), ',') LIKE concat('%,', s.label, ',%') THEN 1 ELSE 0 END AS y,
       CAST((i.item_id * 7919 + s.label_no * 104729) % 600
         + CASE WHEN concat(',', replace(i.labels, ' ', ''), ',') LIKE concat('%,', s.label, ',%')
           THEN 350 ELSE 0 END AS INT) AS pm
FROM items i CROSS JOIN label_set s)"""


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed predictions, oldest first by ``pos``."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    conv = F.col("conv_id")
    return c.select(
        (conv * 1000 + F.col("turn")).alias("pos"),
        F.concat(F.lit("m"), (conv % 3).cast("string")).alias("model_name"),
        "text",
        F.lit("http://v/lang/en").alias("predicted"),
        F.when(conv % 5 == 0, "").when(conv % 2 == 0, "http://v/lang/de,http://v/flag/quality")
        .otherwise("http://v/lang/fr").alias("corrected"),
        F.when(conv % 4 == 0, "script").otherwise("ui").alias("source"))


CORRECTIONS = """corrections AS (
SELECT c.conv_id * 1000 + c.turn AS pos, concat('m', CAST(c.conv_id % 3 AS VARCHAR)) AS model_name,
       c.text AS text, 'http://v/lang/en' AS predicted,
       CASE WHEN c.conv_id % 5 = 0 THEN '' WHEN c.conv_id % 2 = 0 THEN 'http://v/lang/de,http://v/flag/quality'
            ELSE 'http://v/lang/fr' END AS corrected,
       CASE WHEN c.conv_id % 4 = 0 THEN 'script' ELSE 'ui' END AS source
FROM conversations c WHERE c.role = 'user')"""

# --- SQL building blocks shared by the oracles ---------------------------------------------
_SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sql_clean(expr: str, version: int = 2) -> str:
    """DuckDB text of the cleaning chain (the entities that occur in the tables)."""
    out = f"coalesce({expr}, '')"
    for name, ch in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{ch}')"
    tag = "<[A-Za-z/!?][^<>]*>" if version == 2 else "<[^<>]+>"
    out = f"regexp_replace({out}, '{tag}', ' ', 'g')"
    out = rf"regexp_replace({out}, '!?\[([^\[\]]*)\]\([^()]*\)', '\1', 'g')"
    out = f"regexp_replace({out}, '[*_`~#>]+', '', 'g')"
    out = rf"regexp_replace({out}, '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}-\x{{9F}}]', '', 'g')"
    return f"trim(regexp_replace({out}, '{_SPACE}', ' ', 'g'))"


ASSEMBLED = "concat(title, ' ', title, ' ', description, ' ', keywords, ' ', keywords)"


def sql_labels(expr: str, distinct: bool = True) -> str:
    """DuckDB list of a label cell; repeats dropped in first-seen order."""
    out = f"list_filter(list_transform(string_split({expr}, ','), lambda x: trim(x)), lambda x: x <> '' AND NOT suffix(x, '/'))"
    return f"list_filter({out}, lambda x, i: list_position({out}, x) = i)" if distinct else out


# loaded: the standard loader over ``items`` (title and keywords twice, all marks, dedupe)
PREPARED = f"""prepared AS (
SELECT item_id, {sql_clean(ASSEMBLED)} AS text, {sql_labels('labels')} AS labels,
       (CASE WHEN trim(generated_for) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(example_for) <> '' THEN 2 ELSE 0 END)
       + (CASE WHEN trim(enriched_fields) <> '' THEN 4 ELSE 0 END) AS own_mark
FROM items)"""

LOADED = """keyed AS (SELECT *, md5(strip_accents(lower(text))) AS key FROM prepared
  WHERE length(text) >= 5 AND len(labels) > 0),
loaded AS (SELECT item_id, text, labels, own_mark, key,
  CASE WHEN own_mark > 0 THEN own_mark WHEN any_marked > 0 THEN 8 ELSE 0 END AS mark FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY item_id) AS rn, max(own_mark) OVER (PARTITION BY key) AS any_marked
  FROM keyed) WHERE rn = 1)"""

_PARTS = {"items": (ITEMS,), "label_set": (LABEL_SET_SQL,), "scored": (ITEMS, LABEL_SET_SQL, SCORED),
          "corrections": (CORRECTIONS,), "prepared": (ITEMS, PREPARED), "loaded": (ITEMS, PREPARED, LOADED)}


def with_views(names: str, body: str, more: str = "") -> str:
    """``WITH <views>[, more] body`` with each view's prerequisites, each once."""
    parts: list[str] = []
    for name in names.split():
        parts += [p for p in _PARTS[name] if p not in parts]
    if more:
        parts.append(more)
    return "WITH " + ",\n".join(parts) + "\n" + body
