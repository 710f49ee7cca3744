"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs in full into the no-op sink: all rows and columns are computed,
nothing is collected. After a pass over the small tables each query runs twice and
the faster run counts, so that JIT compilation is not part of the figure; the times
include plan building.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioweave.catalog import collect_catalog  # noqa: E402
from folioweave.session import build_session  # noqa: E402

HEADLINE = [
    "pages_to_results", "html_to_markdown", "html_to_text", "tokenize_html", "extract_links", "semantic_sections",
    "detect_type", "word_count", "content_hash", "tidy_markdown", "convert_once", "cache_misses", "page_meta",
    "assemble_pages", "image_index", "paginate", "latest_result", "perf_stats_all", "render_github", "render_grid",
    "table_or_note", "find_md_tables", "scan_json", "export_json", "scan_docx_blocks", "scan_xlsx_cells", "convert_corpus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    catalog = collect_catalog()
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times = {}
    for name in only:
        run = catalog[name][0]
        taken = []
        for folder in ([warm] if os.path.isdir(warm) else []) + [sf_dir, sf_dir]:
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(min(taken[-2:]), 3)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}
    if "pages_to_results" in times:
        n = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
        out["pages_per_sec"] = round(n / times["pages_to_results"], 1)
    out["cpus"] = int(cpus)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
