"""Headline queries, timed end to end on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from credence.plans.catalog import all_queries
from credence.session import build_session

HEADLINE = [
    "a_report", "a_dash_counts", "j_verif_list", "j_cand_status", "r_duplicate", "d_dedupe_apply", "w_rownum", "w_latest",
    "r_number_check", "r_institution", "r_content", "x_extract_names", "r_metadata", "r_detect", "r_fuse", "r_qr",
    "a_cross_consist", "a_clone_blocks", "i_text_feats", "m_balance", "t_dup_stream", "candidate_trust_core", "verify_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("credence-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    queries["src_table"](spark, folder).count()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1],
        "documents_per_second": round(documents / seconds["verify_documents"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
