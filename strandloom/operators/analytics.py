"""Analyses over nodes, links, intervals and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.dna import canonical, windows
from strandloom.session import saved


def nodes_once(nodes: DataFrame) -> DataFrame:
    """node_id, kmer, abundance, seqlen, shift_l, shift_r, samples of every node with an id: its rows that arrived again agree, so any
    known value of each column stands."""
    known = nodes.where(F.col("node_id").isNotNull())
    return known.groupBy("node_id").agg(
        F.first("kmer", ignorenulls=True).alias("kmer"), F.max("abundance").alias("abundance"), F.max("seqlen").alias("seqlen"),
        F.max("shift_l").alias("shift_l"), F.max("shift_r").alias("shift_r"),
    )


def unitig_samples(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """unitig, n_samples: distinct samples whose nodes lie on each path; pairs are reduced before they meet."""
    pairs = paths.select("unitig", "node_id").join(nodes.where("sample_id IS NOT NULL").select("node_id", "sample_id").distinct(), "node_id")
    return pairs.select("unitig", "sample_id").distinct().groupBy("unitig").agg(F.count("*").alias("n_samples"))


def count_below(points: DataFrame, queries: DataFrame, by: str, x: str, width: float, out: str, or_equal: bool = False) -> DataFrame:
    """`queries` with `out`: how many points of the same `by` lie below each query's `x` (or at it).

    Counts by cell of `width` are added up per key, and only the query's own cell is sorted: a key that holds a third of all rows
    is spread over its cells.  Nothing is paired.  Queries and points with a null key or x count nothing.
    """
    cell = F.floor(F.col(x) / F.lit(float(width)))
    p = points.where(F.col(by).isNotNull() & F.col(x).isNotNull()).select(by, F.col(x).alias("__x"), cell.alias("__cell"))
    cells = p.groupBy(by, "__cell").agg(F.count("*").alias("__n"))
    before = cells.withColumn("__before", F.sum("__n").over(Window.partitionBy(by).orderBy("__cell")) - F.col("__n"))
    q = queries.where(F.col(by).isNotNull() & F.col(x).isNotNull()).withColumn("__cell", cell)
    row = F.struct(*[F.col(c) for c in queries.columns])
    side = 1 if or_equal else 0  # points sort before a query at the same x if they count
    both = p.select(by, "__cell", "__x", F.lit(1 - side).alias("__side"), F.lit(1).alias("__point"), F.lit(None).cast(q.select(row).schema[0].dataType).alias("__q")).unionByName(
        q.select(by, "__cell", F.col(x).alias("__x"), F.lit(side).alias("__side"), F.lit(0).alias("__point"), row.alias("__q"))
    )
    inside = Window.partitionBy(by, "__cell").orderBy("__x", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = both.withColumn("__in", F.sum("__point").over(inside)).where("__point = 0")
    # the last cell with points at or before the query's own
    last = F.last("__upto", ignorenulls=True).over(Window.partitionBy(by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    steps = before.select(by, "__cell", (F.col("__before") + F.col("__n")).alias("__upto")).unionByName(
        q.select(by, "__cell").distinct().withColumn("__upto", F.lit(None).cast("bigint"))
    ).groupBy(by, "__cell").agg(F.max("__upto").alias("__upto")).withColumn("__before", F.coalesce(last, F.lit(0)))
    return ranked.join(steps.select(by, "__cell", "__before"), [by, "__cell"]).select("__q.*", (F.col("__before") + F.col("__in")).alias(out))


def overlap_counts(intervals: DataFrame, by: str, start: str, end: str, min_overlap: float, width: float) -> DataFrame:
    """intervals with n_overlaps: others of the same `by` that share more than `min_overlap` with each.

    Of intervals longer than min_overlap, those that overlap one by more are all that start before its end - min_overlap, less those
    that end at or before its start + min_overlap; so two counts replace the theta join and no pair is made.
    """
    cols = intervals.columns
    long = intervals.where((F.col(end) - F.col(start) > min_overlap) & F.col(by).isNotNull())
    a = count_below(long.select(by, F.col(start).alias("__v")), long.withColumn("__v", F.col(end) - min_overlap), by, "__v", width, "__started")
    b = count_below(long.select(by, F.col(end).alias("__v")), a.withColumn("__v", F.col(start) + min_overlap), by, "__v", width, "__ended", or_equal=True)
    return b.select(*cols, (F.col("__started") - F.col("__ended") - 1).alias("n_overlaps"))


def list_classes(lists: DataFrame) -> DataFrame:
    """lists with class_id: equal lists, in either direction, form a class.  Empty lists have none and are left out."""
    return lists.where(F.size("minims") > 0).withColumn("class_id", _class_hash(canonical(F.col("minims"))))


def _class_hash(c: Column) -> Column:
    return F.xxhash64(c, F.size(c))


def class_sets(lists: DataFrame, n: int) -> DataFrame:
    """class_id, members, list (in its canonical direction), able (it has runs of n elements).  Fails if two lists have one hash."""
    c = canonical(F.col("minims"))
    found = list_classes(lists).groupBy("class_id").agg(F.min(c).alias("list"), F.max(c).alias("list2"), F.count("*").alias("members"))
    same = F.when(F.col("list") == F.col("list2"), F.col("list")).otherwise(F.raise_error(F.lit("two lists have one hash")).cast("array<bigint>"))
    return found.select("class_id", same.alias("list"), "members").withColumn("able", F.size("list") >= n)


def class_pairs(lists: DataFrame, distance: float = 0.15, n: int = 2) -> DataFrame:
    """class_id, other, dist, members, members2: pairs of classes (each once) below a Jaccard distance that share n consecutive elements.

    Classes meet over their rarest elements only: two sets that similar must share one of each one's first
    |s| - ceil((1 - distance) |s|) + 1 elements in any common order, and by rising frequency these are never the elements that
    hold most occurrences unless a set has no others.
    """
    return pairs_of_sets(saved(class_sets(lists, n)), distance, n)


def pairs_of_sets(sets: DataFrame, distance: float, n: int) -> DataFrame:
    """The pairs of `class_pairs` from the result of `class_sets`, which is read several times and should be saved.

    Each class offers its rarest elements with 256 bits, in each of which it has the parity of a share of its elements.  Bits that differ are
    at most as many as elements that only one of two sets has, so most pairs are refused before their lists are fetched.
    """
    own = sets.select("class_id", F.array_distinct("list").alias("s")).select("*", F.size("s").alias("size"), F.size(F.array_compact("s")).alias("known"))
    freq = own.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("f"))
    # elements of one class only come first and meet nothing
    rows = own.select("class_id", "size", "known", F.explode("s").alias("x")).join(freq.where("f > 1"), "x")
    mine = Window.partitionBy("class_id")
    ranked = rows.withColumn("place", F.col("known") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("f", "x")))
    prefix = ranked.where(F.col("place") <= F.col("size") - F.ceil((1 - distance) * F.col("size")) + 1).select("class_id", "size", "x")

    def parity(word: int) -> Column:
        bit = lambda x: F.xxhash64(x, F.lit(0xB175)).bitwiseAND(F.lit(255))
        add = lambda at, x: F.when(F.shiftright(bit(x), 6) == word, at.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(x).bitwiseAND(F.lit(63)).cast("int")))).otherwise(at)
        return F.aggregate("s", F.lit(0).cast("bigint"), add).alias(f"b{word}")

    prefix = prefix.join(own.select("class_id", *[parity(w) for w in range(4)]), "class_id")
    other = prefix.select(F.col("class_id").alias("other"), F.col("size").alias("size2"), "x", *[F.col(f"b{w}").alias(f"c{w}") for w in range(4)])
    near = (F.col("size2") >= (1 - distance) * F.col("size")) & (F.col("size") >= (1 - distance) * F.col("size2"))
    differ = sum((F.bit_count(F.col(f"b{w}").bitwiseXOR(F.col(f"c{w}"))) for w in range(1, 4)), F.bit_count(F.col("b0").bitwiseXOR(F.col("c0"))))
    # of sets below the distance, elements that only one has are less than this share of both sizes; a little more for rounding
    few = differ <= (F.col("size") + F.col("size2")) * (distance / (2 - distance)) + 1e-6
    cand = prefix.join(other, "x").where((F.col("class_id") < F.col("other")) & near & few).select("class_id", "other").distinct()
    right = sets.select(F.col("class_id").alias("other"), F.col("list").alias("list2"), F.col("members").alias("members2"))
    dist = 1 - F.size(F.array_intersect("list", "list2")) / F.size(F.array_union("list", "list2"))
    pairs = cand.join(sets, "class_id").join(right, "other").withColumn("dist", dist).where(F.col("dist") < distance)
    grams = lambda c: F.transform(windows(c, n), canonical)
    return pairs.where(F.arrays_overlap(grams("list"), grams("list2"))).select("class_id", "other", "dist", "members", "members2")


def similar_lists(lists: DataFrame, distance: float = 0.15, n: int = 2) -> DataFrame:
    """read_id, class_id, n_links: how many other reads lie within a Jaccard distance of their element sets below `distance` and share
    n consecutive elements in either direction.  Members of a class link to one another without being paired."""
    sets = saved(class_sets(lists, n))
    pairs = pairs_of_sets(sets, distance, n)
    links = pairs.select("class_id", F.col("members2").alias("m")).union(pairs.select("other", "members")).groupBy("class_id").agg(F.sum("m").alias("linked"))
    own = sets.select("class_id", "members", "able")
    total = own.join(links, "class_id", "left").select(
        "class_id", (F.coalesce("linked", F.lit(0)) + F.when(F.col("able"), F.col("members") - 1).otherwise(0)).alias("n_links")
    )
    return list_classes(lists).select("read_id", "class_id").join(total, "class_id").select("read_id", "class_id", "n_links")


def levenshtein_ball(lmers: DataFrame, column: str) -> DataFrame:
    """lmer, other: distinct strings one edit away from each l-mer, edits at inner places only, other than itself."""
    c = F.col(column)
    n = F.length(c)
    letters = F.array(*[F.lit(x) for x in "ACGT"])
    inner = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    edit = lambda i, new, skip: F.concat(c.substr(F.lit(1), i - 1), new, c.substr(i + skip, n))
    swapped = F.flatten(F.transform(inner, lambda i: F.transform(letters, lambda x: edit(i, x, 1))))
    added = F.flatten(F.transform(inner, lambda i: F.transform(letters, lambda x: edit(i, x, 0))))
    removed = F.transform(inner, lambda i: edit(i, F.lit(""), 1))
    return lmers.select(c.alias("lmer"), F.explode(F.array_distinct(F.concat(swapped, added, removed))).alias("other")).where("other <> lmer")


def genome_ids(df: DataFrame, column: str, sign: str) -> DataFrame:
    """genome, n: distinct names before the first `sign`."""
    return df.where(F.col(column).isNotNull()).groupBy(F.substring_index(column, sign, 1).alias("genome")).agg(F.count("*").alias("n"))


def node_degrees(links: DataFrame) -> DataFrame:
    """node_id, links_out, links_in over links written from either side once."""
    from strandloom.operators.graph import both_sides

    e = both_sides(links)
    forward: Column = F.col("o1") == "+"
    return e.groupBy(F.col("n1").alias("node_id")).agg(F.count_if(forward).alias("links_out"), F.count_if(~forward).alias("links_in"))
