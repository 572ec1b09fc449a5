"""Times the headline jobs; prints one JSON line.

The given ``documents`` table is a single row group, which one task would have to read.  It is laid
out once as several files before timing, as a table of any size would be.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: the headline jobs; scoring is timed after them, apart from building its model
QUERIES = (
    "t1_clean_text_documents", "j1_first_wins_dedupe", "a2_threshold_table", "l10_learnable_targets", "x2_stratified_partition",
    "f5_vocabulary", "k2_threshold_decision", "h3_label_cuts", "e1_metrics", "d5_descriptions",
    "u4_first_wins_over_blocks",
)


def laid_out(spark, folder: str) -> str:
    from tagloom.session import shared_dir

    target = f"{shared_dir(spark)}/tagloom-bench-{uuid.uuid4().hex}"
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            parts = int(CPUS) * 2 if name in ("documents.parquet", "pages.parquet", "conversations.parquet") else 1
            spark.read.parquet(f"{folder}/{name}").repartition(parts).write.parquet(f"{target}/{name}")
    return target


def main() -> None:
    from tagloom.catalog import registry
    from tagloom.session import local_session

    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    folder = laid_out(spark, SF_DIR)
    registered, seconds = registry.queries(), {}
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or QUERIES
    for name in only:
        start = time.time()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    if not os.environ.get("BENCH_QUERIES"):
        from tagloom.catalog.scoring import doc_scores, log_odds_model, wide_model

        start = time.time()
        model = log_odds_model(spark, folder)
        seconds["k1_model_tables"] = round(time.time() - start, 3)
        start = time.time()
        doc_scores(spark, folder, model).write.format("noop").mode("overwrite").save()
        seconds["k1_scoring"] = round(time.time() - start, 3)
        # as wide as a model in service: 59 labels, caps of 80 000 words and 120 000 character n-grams
        start = time.time()
        wide = wide_model(spark, folder, 59)
        seconds["k1_wide_model"] = round(time.time() - start, 3)
        start = time.time()
        doc_scores(spark, folder, wide).write.format("noop").mode("overwrite").save()
        seconds["k1_wide_scoring"] = round(time.time() - start, 3)
    out = {"metric": "headline jobs, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
           "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "documents": rows, "cpus": CPUS}
    if seconds.get("k1_scoring"):
        out["scored_rows_per_sec"] = round(rows / seconds["k1_scoring"], 1)
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
