"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from gridloom.plans import registry  # noqa: E402

HEADLINE = ["prf1", "ap_coco", "map_overall", "per_image_pivot", "nms", "suppress_b", "containment_a", "wbf", "fuse_b", "max_sim", "phash_dedup", "dbscan", "p90_area", "parse_labels", "summary_scores", "yolo_lines"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["prf1"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    took, errors, start, limit = {}, {}, time.time(), float(os.environ.get("BENCH_SECONDS", "600"))
    for name in HEADLINE:
        if time.time() - start > limit:  # the rest is listed as not run
            break
        began = time.time()
        try:
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # one query must not hide the others' figures
            errors[name] = str(error).strip().split("\n")[0][:300]
            continue
        finally:
            print(f"{name}: {time.time() - began:.2f} s {errors.get(name, '')}", file=sys.stderr, flush=True)
        took[name] = round(time.time() - began, 3)
    rest = [n for n in HEADLINE if n not in took and n not in errors]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "errors": errors, "not_run": rest, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
