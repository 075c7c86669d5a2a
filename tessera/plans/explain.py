"""Plans of queries as rows, with measured figures if wanted."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

_SCHEMA = "line int, plan string"


def text(df: DataFrame, mode: str = "formatted") -> str:
    query = df._jdf.queryExecution()
    return query.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def plan(df: DataFrame, mode: str = "formatted") -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(text(df, mode).splitlines())), _SCHEMA)


def _nodes(plan, depth: int = 0) -> list[str]:
    """Each operator of a plan that has run, with its measured figures."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _nodes(plan.executedPlan(), depth)
    if kind.endswith("QueryStageExec"):
        return _nodes(plan.plan(), depth)
    lines, own = [], depth
    if kind not in ("WholeStageCodegenExec", "InputAdapter"):
        figures, each = [], plan.metrics().iterator()
        while each.hasNext():
            metric = each.next()._2()
            if metric.value() > 0 and metric.name().isDefined():
                figures.append(f"{metric.name().get()}={metric.value()}")
        lines.append(f"{'  ' * depth}{plan.nodeName()}: {', '.join(sorted(figures)) or '-'}")
        own += 1
    children = plan.children()
    return lines + [line for i in range(children.size()) for line in _nodes(children.apply(i), own)]


def analyze(df: DataFrame) -> DataFrame:
    """Run the query itself without keeping its rows; then its final plan, the figures of its operators, its rows and its time."""
    query = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = query.toRdd().count()
    took = time.perf_counter() - began
    lines = [*text(df).splitlines(), "== Measured ==", *_nodes(query.executedPlan()), f"rows: {rows}", f"seconds: {took:.3f}"]
    return df.sparkSession.createDataFrame(list(enumerate(lines)), _SCHEMA)
