"""What the correction fetches, and the pairs of classes it is built on, against all pairs."""

import random

from strandloom.operators import analytics, correct

LISTS = "read_id string, minims array<bigint>, pos array<int>"


def test_pairs_of_classes_are_those_of_all_pairs(spark):
    r = random.Random(8)
    true = [[r.randrange(400) for _ in range(40)] for _ in range(4)]
    lists = [(f"r{i}", [x if r.random() < 0.97 else None if r.random() < 0.2 else r.randrange(400) for x in true[i % 4]]) for i in range(60)]
    df = spark.createDataFrame([(i, m, list(range(len(m)))) for i, m in lists], LISTS)
    of = {x.class_id: x.minims for x in analytics.list_classes(df).collect()}
    grams = {c: {min((a, b), (b, a), key=str) for a, b in zip(m, m[1:])} for c, m in of.items()}
    true_pairs = {
        (a, b) for a in of for b in of if a < b and 1 - len({*of[a]} & {*of[b]}) / len({*of[a]} | {*of[b]}) < 0.15 and grams[a] & grams[b]
    }
    found = [(x["class_id"], x["other"]) for x in analytics.class_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == true_pairs and found


def test_texts_are_fetched_only_for_lists_that_meet_others(spark, monkeypatch):
    kept, plain = [], correct.written
    monkeypatch.setattr(correct, "written", lambda df, *more: kept.append(plain(df, *more)) or kept[-1])
    r = random.Random(9)
    text = lambda: "".join(r.choice("ACGT") for _ in range(60))
    twice = text()
    reads = [("a", twice), ("b", twice)] + [(f"lone{i}", text()) for i in range(8)]
    lists = [("a", [1, 2, 3], [5, 20, 40]), ("b", [1, 2, 3], [5, 20, 40])] + [(f"lone{i}", [10 * i + x for x in (11, 12, 13)], [5, 20, 40]) for i in range(8)]
    done = correct.corrected(spark.createDataFrame(reads, "read_id string, seq string"), spark.createDataFrame(lists, LISTS), 4)
    assert {x.read_id: (x.seq, x.minims, x.pos) for x in done.collect()} == {i: (s[5:44], dict((a, b) for a, b, _ in lists)[i], [0, 15, 35]) for i, s in reads}
    assert [df.count() for df in kept if "o" in df.columns] == [2]
