import random

import pytest

from faultlens.llm.components import components


def brute(links):
    group = {}

    def top(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        if a != b:
            x, y = top(a), top(b)
            group[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(group)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "empty"])
def test_roots_are_the_least_nodes(spark, kind):
    r = random.Random(7)
    links = {
        "chain": [(k, k + 1) for k in range(60)],
        "star": [(0, k) for k in range(1, 80)] + [(200, k) for k in range(201, 230)],
        "random": [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3), (9, 8)],
        "empty": [],
    }[kind]
    r.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({x["node"] for x in got})
    assert {x["node"]: x["root"] for x in got} == brute(links)


@pytest.mark.parametrize("per_task", [3, 40])
@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_tasks_of_few_links(spark, monkeypatch, kind, per_task):
    """Links over many tasks: centers that nodes tie are joined, by themselves or by rounds."""
    from faultlens.llm import components as module

    monkeypatch.setattr(module, "LINKS", per_task)
    r = random.Random(8)
    links = {"chain": [(k, k + 1) for k in range(90)], "star": [(0, k) for k in range(1, 90)], "random": [(r.randint(0, 99), r.randint(0, 99)) for _ in range(120)]}[kind]
    r.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()
    assert len(got) == len({x["node"] for x in got})
    assert {x["node"]: x["root"] for x in got} == brute(links)


def test_few_links_need_no_shuffle(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "components")
    try:
        got = components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("components")) <= 3 and {x["root"] for x in got.collect()} == {0}
