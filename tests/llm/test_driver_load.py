"""The driver keeps a record of every task, so rounds of few links run few tasks."""

import random

import pytest

from omicsgraph.llm import simhash


def tasks_of(spark, run):
    """What run() returns, and how many tasks it took with 40 partitions for each exchange."""
    context, old = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    group = f"tasks-{random.random()}"
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup(group, group)
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    status = context.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)


def test_rounds_of_components_take_few_tasks(spark):
    links = [(k, 0) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(5)]
    df = spark.createDataFrame(links, "a long, b long").coalesce(2)
    got, tasks = tasks_of(spark, lambda: {r.node: r.root for r in simhash.components(df).collect()})
    assert got == {k: 0 for k in range(1, 300)} | {1000 + k: 1000 for k in range(1, 6)}
    assert 0 < tasks < 800


@pytest.mark.parametrize("most", [0, 100_000])
def test_components_are_right_with_and_without_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_POINTED", most)
    rng = random.Random(11)
    links = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(500)]
    links += [(5000, k) for k in range(4000, 4200)] + [(k, k + 1) for k in range(6000, 6040)] + links[:50]
    root = {x: x for p in links for x in p}
    for _ in root:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    got = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(p for p in root.items() if p[0] != p[1])
