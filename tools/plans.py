"""Physical-plan summary of registered queries (after execution, so the
adaptive plan is final): number of shuffles, single-partition exchanges,
broadcast joins, sort-merge joins, Python (Arrow) stages, scan columns.

    python tools/plans.py [sf_dir] [name ...]  > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["cascade_metrics", "cascade_agreement", "threshold_metrics", "auroc_exact", "roc_points",
            "stratified_folds", "fold_metrics", "model_compare", "bootstrap_auc_ci", "best_threshold_f1",
            "clean_inequalities", "drop_high_missing", "ordinal_encode", "describe_all", "corr_matrix",
            "corr_spearman", "outliers", "by_target", "impute_median", "cascade_keyed"]


def summarize(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning)", plan)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "python": plan.count("MapInPandas") + plan.count("ArrowEvalPython"),
        "windows": plan.count("Window ["),
        "read_schemas": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))),
    }


def main(argv):
    sf = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)] or HEADLINE
    from strata.plans import registry
    from strata.session import local_session

    spark = local_session()
    qs = registry.queries()
    print(f"# Physical plans (final adaptive plans, {sf})\n")
    print("Generated by `python tools/plans.py`. A `SinglePartition` exchange here carries either the "
          "per-task partial results of a global aggregate (one row per task) or a window over a table whose "
          "size was checked first (distinct scores under the bound, threshold grid, fold rows, bucket "
          "offsets); no cohort-sized table is moved to one partition. Python stages are Arrow-batched "
          "`mapInPandas` (bootstrap draws, Tree SHAP). Cohort-pipeline queries start from the checkpointed cleaned / encoded cohort, so their final plan begins at that snapshot (the upstream work ran in the job that wrote it). Joins of cohort-sized tables show as broadcast here only because AQE measured them small at this scale factor.\n")
    print("| query | shuffles | SinglePartition | broadcast joins | sort-merge joins | Python stages | windows |")
    print("|---|---|---|---|---|---|---|")
    details = []
    for n in names:
        df = qs[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        print(f"| {n} | {s['shuffles']} | {s['single_partition']} | {s['broadcast_joins']} | {s['smj']} | "
              f"{s['python']} | {s['windows']} |")
        details.append((n, s["read_schemas"]))
    print("\nScan columns (ReadSchema) per query:\n")
    for n, rs in details:
        print(f"* `{n}`: " + "; ".join(f"`{r}`" for r in rs))


if __name__ == "__main__":
    main(sys.argv)
