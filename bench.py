"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lapsewise import plans  # noqa: E402
from lapsewise.session import local_session  # noqa: E402

HEADLINE = (
    "clean_listing", "dedup_keep_first", "column_summary", "km_curve", "censor_km", "doc_term_stemmed", "tfidf",
    "prune_low_idf", "pos_filter", "typos_p05", "degrade_levels", "length_change", "subword_vec", "encoder_vec",
    "strat_split", "design_matrix", "pca_coords", "knn_cosine", "vif", "cox_fit", "cox_fit_left_truncated",
    "cox_fit_wide", "deviance_resid", "harrell_c", "harrell_c_model", "uno_c", "auc_uno", "auc_cd", "brier_t",
    "coxnet_path", "coxnet_cv_loglik", "ks2", "kl_knn", "hd_quantiles",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    plans.ship(spark)
    plans.QUERIES["km_curve"](spark, folder).count()  # start the JVM's compiler and the Python workers
    plans.QUERIES["encoder_vec"](spark, folder).count()
    times = {}
    for name in names:
        start = time.perf_counter()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    name = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(name[2:]) if name.startswith("sf") else name}))
    spark.stop()


if __name__ == "__main__":
    main()
