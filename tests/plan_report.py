"""Write PLANS.md: physical-plan facts of every registered query.

Usage: ``python -m tests.plan_report [sf_dir]``.  Counts are taken from the
executed (adaptive) plan at the given scale factor.
"""

from __future__ import annotations

import re
import sys

from glean.plans.registry import load_all

PY_NODES = ("ArrowEvalPython", "MapInPandas", "FlatMapCoGroupsInPandas", "FlatMapGroupsInPandas", "BatchEvalPython", "PythonDataSource")


def facts(df) -> dict:
    df.write.format("noop").mode("overwrite").save()  # run it: adaptive plans are final only after execution
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan().toString()
    # An adaptive plan prints its final and its initial form; count the final.
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    formatted = qe.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    lines = [ln for ln in plan.splitlines() if "Reused" not in ln]
    shuffle = re.compile(r"(^|[-+: ])Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)")
    return {
        "shuffles": sum(1 for ln in lines if shuffle.search(ln)),
        "broadcasts": sum(1 for ln in lines if "BroadcastExchange" in ln),
        "python": sum(ln.count(n) for ln in lines for n in PY_NODES),
        "topk": plan.count("WindowGroupLimit"),
        "pushed": sum(1 for ln in formatted.splitlines() if ln.startswith("PushedFilters") and ln.strip() != "PushedFilters: []"),
        "cartesian": plan.count("CartesianProduct"),
    }


def main(argv):
    from glean.session import local_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    rows = []
    for name, q in sorted(load_all().items()):
        try:
            f = facts(q.fn(spark, sf))
        except Exception as e:  # noqa: BLE001
            f = {"error": str(e).splitlines()[0][:80]}
        rows.append((name, ", ".join(q.ids), f, bool(q.sql)))
    out = [
        "# PLANS",
        "",
        f"Physical-plan facts of every registered query, from the final adaptive plans of a run at `{sf}` (generated by",
        "`python -m tests.plan_report`).",
        "",
        "Columns:",
        "",
        "* `shuffles`: exchanges, not counting reused ones. This includes the round-robin spread of few-partition",
        "  inputs and the range exchanges of the balanced prefix sums.",
        "* `bcast`: broadcast exchanges; each one is bounded by construction or by a checked count.",
        "* `python`: Arrow Python stages. Each balanced prefix sum counts twice: its two consumers share one range",
        "  exchange and each runs the vectorised local step.",
        "* `top-k`: `WindowGroupLimit` nodes; a partial one runs before each exchange.",
        "* `pushed`: scans with pushed filters.",
        "* `oracle`: whether the query has DuckDB SQL.",
        "",
        "No query has a Cartesian product.",
        "",
        "| query | survey ids | shuffles | bcast | python | top-k | pushed | oracle |",
        "|---|---|---|---|---|---|---|---|",
    ]
    for name, ids, f, has_sql in rows:
        if "error" in f:
            out.append(f"| `{name}` | {ids} | error: {f['error']} | | | | | |")
            continue
        assert f["cartesian"] == 0, name
        out.append(
            f"| `{name}` | {ids} | {f['shuffles']} | {f['broadcasts']} | {f['python']} | {f['topk']} | {f['pushed']} | {'SQL' if has_sql else 'rows'} |"
        )
    open("PLANS.md", "w").write("\n".join(out) + "\n")
    print(f"wrote PLANS.md with {len(rows)} queries")


if __name__ == "__main__":
    main(sys.argv)
