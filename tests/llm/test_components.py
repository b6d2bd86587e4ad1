import random

from paypulse.llm.components import components


def test_random_graphs_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(2000 + 7 * k % 101, 2101) for k in range(101)] + [(5, 5)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tasks_follow_the_edges(spark):
    """A small graph takes few tasks, each of which leaves files, however many shuffle partitions there are."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext
    tracker = context.statusTracker()
    links = spark.range(300, numPartitions=4).selectExpr("id as a", "id + 1 as b")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("test_tasks_follow_the_edges", "")
        found = components(links).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.component for r in found} == {0} and len(found) == 301
    stages = {s for j in tracker.getJobIdsForGroup("test_tasks_follow_the_edges") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    assert tasks < 1500, tasks
