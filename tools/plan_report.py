"""Summarise the physical plan of every registered query into PLANS.md.

Usage: python tools/plan_report.py [sf_dir] [out.md]

Per query: the scans (table, pushed filters), exchanges (hash / range /
single partition, and the columns a single-partition exchange carries),
join strategies and window / limit operators.  Plans are the AQE initial plans (before execution).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def formatted(df) -> str:
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def summarise(plan: str) -> dict:
    scans = []
    for m in re.finditer(r"\(\d+\) Scan parquet[^\n]*\n((?:[^\n]+\n)+?)\n", plan + "\n\n"):
        block = m.group(1)
        loc = re.search(r"Location: [^\[]*\[(.*)\]", block)
        pushed = re.search(r"PushedFilters: \[(.*)\]", block)
        table = os.path.basename(loc.group(1)).replace(".parquet", "") if loc else "?"
        scans.append(f"{table}" + (f" [{pushed.group(1)}]" if pushed and pushed.group(1) else ""))
    exchanges = []
    for m in re.finditer(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: ([^,\n]+(?:\([^)]*\))?)", plan):
        kind = m.group(2).split("(")[0]
        if kind == "SinglePartition":
            cols = ", ".join(c.split("#")[0].strip() for c in m.group(1).split(","))
            exchanges.append(f"SinglePartition({cols})")
        else:
            exchanges.append(kind)
    ops = re.findall(
        r"^\(\d+\) (BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|"
        r"WindowGroupLimit|Window|TakeOrderedAndProject|BroadcastExchange|Generate|ObjectHashAggregate|SortAggregate)",
        plan,
        flags=re.M,
    )
    return {
        "scans": scans,
        "exchanges": exchanges,
        "ops": ops,
        "python": any(k in plan for k in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas")),
    }


def main() -> None:
    from churnscope.plans.registry import spark_queries
    from churnscope.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = build_session(shuffle_partitions=8)
    lines = [
        "# Physical plans",
        "",
        f"Generated by `tools/plan_report.py` at `{sf_dir}` (AQE initial plans; AQE may",
        "still turn a sort-merge join into a broadcast join or coalesce partitions at",
        "run time).  `SinglePartition(cols)` lists what a single-partition exchange",
        "carries: in every query it is an aggregate result (one row, or one row per",
        "group / per range partition), never the account rows.",
        "",
        "| query | scans (pushed filters) | exchanges | joins / windows / limits |",
        "|---|---|---|---|",
    ]
    for name, fn in spark_queries().items():  # the training-data queries run Python by design
        s = summarise(formatted(fn(spark, sf_dir)))
        assert not s["python"], name
        ops = sorted(set(s["ops"]), key=s["ops"].index)
        lines.append(
            f"| `{name}` | {'; '.join(s['scans'])} | {', '.join(s['exchanges']) or '-'} | "
            f"{', '.join(ops) or '-'} |"
        )
    with open(out, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    print(f"wrote {out}")
    spark.stop()


if __name__ == "__main__":
    main()
