"""Links listed without candidate pairs, against the pairs of all nodes that share a key."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.operators import graph

NODE = "node_id bigint, kmer array<bigint>, abundance bigint, seqlen bigint, shift_l int, shift_r int"


def test_links_are_those_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(graph, "LISTED", 3)
    r = random.Random(3)
    nodes = [(i, [r.randrange(2) for _ in range(4)], 5, r.randrange(20, 30), r.choice([None, 1, 2]), r.randrange(1, 4)) for i in range(40)]
    df = spark.createDataFrame(nodes, NODE)
    found, pairs = Counter(map(tuple, graph.edges(df, 4).collect())), graph.candidates(df, df, 4).select("n1", "o1", "n2", "o2", "overlap")
    assert found == Counter(map(tuple, pairs.collect())) and max(found.values()) > 1


def test_links_of_a_common_key_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "LISTED", 16)
    nodes = [(2 * i, [100 + i, 1, 2, 3], 5, 20, 1, 1) for i in range(64)] + [(2 * i + 1, [1, 2, 3, 300 + i], 5, 20, 1, 1) for i in range(64)]
    links = graph.edges(spark.createDataFrame(nodes, NODE), 4)
    per = [x["count"] for x in links.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(per) == 2 * 64 * 64 and max(per) < sum(per)
