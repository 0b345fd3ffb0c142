"""The overlap graph between nodes: construction, simplification, components, maximal paths.

A node is read forwards (+) or backwards (-).  An edge (n1, o1, n2, o2) says that n1 read as o1 is followed by n2 read as o2; read from the
other side it is (n2, -o2, n1, -o1).  Rows with a null end or orientation are no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.dna import canonical, without_first, without_last
from strandloom.session import tasks, written

#: Ends of a (k-1)-mer in one list; the links between two lists are made in one task.
LISTED = 512


def _side(name: str, part: Column) -> list[Column]:
    """128 bits of a (k-1)-mer's canonical form, whether it is reversed in it, and whether it is a palindrome."""
    c = canonical(part)
    return [
        F.xxhash64(c).alias(f"{name}a"), F.xxhash64(F.lit(0x5EED), c).alias(f"{name}b"),
        (part != c).alias(f"{name}r"), (part == F.reverse(part)).alias(f"{name}p"),
    ]


def edges(nodes: DataFrame, k: int, presimp: float = 0.0) -> DataFrame:
    """n1, o1, n2, o2, overlap from nodes (node_id, kmer, abundance, seqlen, shift_l, shift_r).

    Each node offers and looks up its two canonical (k-1)-mers; a node whose two keys agree is found and looks up twice, as in the
    original bag semantics.  With presimp > 0 candidates far below the abundance around their key are dropped, and
    with them the same pair of nodes in either direction.

    Nodes meet by 128 bits of their (k-1)-mers, so no lists travel.  Rows are all links; a (k-1)-mer of very many nodes makes a link for
    each matching pair.  `overlap_members` gives the same links as classes, one row a node and key.
    """
    if presimp <= 0:
        return _every_link(nodes, k)
    cand = candidates(nodes, nodes, k)
    pair = Window.partitionBy(F.least("n1", "n2"), F.greatest("n1", "n2"))
    marked = weak(cand, presimp).select("n1", "o1", "n2", "o2", "overlap", "weak")
    return marked.withColumn("gone", F.max("weak").over(pair)).where("NOT gone").select("n1", "o1", "n2", "o2", "overlap")


def _every_link(nodes: DataFrame, k: int) -> DataFrame:
    """The links of `candidates`, of which no row is made before it is known to be one.

    A node's end meets the ends of its (k-1)-mer that enter where it leaves, at a palindrome all.  Ends lie in lists of LISTED, and pairs of
    lists are dealt out to the tasks, so a common (k-1)-mer is no single task's.  Two nodes that meet in several ways find one another by
    each of them and list them all each time; what that adds to one row a link is `_found_again`.
    """
    pre, suf = without_last(F.col("kmer"), k), without_first(F.col("kmer"), k)
    hashed = nodes.select("node_id", "seqlen", "shift_l", "shift_r", *_side("s", suf), *_side("p", pre))

    def end(x: str, forwards: bool) -> Column:
        """Of the last part (s) read forwards, of the first (p) backwards."""
        out = ~F.col(f"{x}r") if forwards else F.col(f"{x}r")
        left = (F.col("seqlen") - F.col("shift_l" if forwards else "shift_r")).alias("left")
        own = F.struct(F.col("node_id").alias("n"), F.lit(forwards).alias("fwd"), left, (F.col("seqlen") - 1).alias("most"))
        return F.struct(F.col(f"{x}a").alias("ka"), F.col(f"{x}b").alias("kb"), F.col(f"{x}p").alias("pal"), (F.col(f"{x}p") | out).alias("out"), own.alias("end"))

    # partitioned once by key: lists and their pairs are made where the ends lie
    ends = hashed.select(F.inline(F.array(end("s", True), end("p", False)))).repartition("ka", "kb")
    place = F.row_number().over(Window.partitionBy("ka", "kb", "out").orderBy("end.n", "end.fwd"))
    lists = ends.withColumn("list", F.floor((place - 1) / LISTED)).groupBy("ka", "kb", "out", "pal", "list").agg(F.collect_list("end").alias("ends"))
    one = lists.select("ka", "kb", "pal", F.col("out").alias("out1"), F.col("ends").alias("firsts"))
    two = lists.select("ka", "kb", F.col("pal").alias("pal2"), F.col("out").alias("out2"), F.col("ends").alias("seconds"))
    pairs = one.join(two, ["ka", "kb"]).where(F.col("pal") | (F.col("out1") != F.col("out2"))).select("firsts", "seconds")
    dealt = pairs.repartition(tasks(nodes.sparkSession))
    each = dealt.select(F.inline("firsts").alias("n1", "f1", "left", "most1"), "seconds").select("n1", "f1", "left", F.inline("seconds").alias("n2", "f2", "left2", "most"))
    sign = lambda c: F.when(c, "+").otherwise("-")
    links = each.select("n1", sign(F.col("f1")).alias("o1"), "n2", sign(~F.col("f2")).alias("o2"), F.least("left", "most").alias("overlap"))
    return links.union(_found_again(hashed))


def _found_again(hashed: DataFrame) -> DataFrame:
    """n1, o1, n2, o2, overlap: further rows of links between nodes that meet in n > 1 ways, n - 1 of each: they have the same two keys, or
    one of them has one key at both ends.  Only ids and 64 bits of the keys are shuffled for all nodes."""
    twin = (F.col("sa") == F.col("pa")) & (F.col("sb") == F.col("pb"))
    # a node meets itself in two ways at least, but is linked to itself only at a palindrome
    keys = F.xxhash64(F.least("sa", "pa"), F.greatest("sa", "pa")).alias("keys")
    alike = hashed.where(~twin).groupBy(keys).agg(F.collect_list("node_id").alias("xs"), F.bool_or(F.col("sp") | F.col("pp")).alias("pal")).where("pal OR size(xs) > 1")
    alike = alike.select(F.explode("xs").alias("x"), "xs").select("x", F.explode("xs").alias("y"))
    twins = hashed.where(twin).select(F.col("node_id").alias("x"), F.col("sa").alias("key"))
    met = twins.join(hashed.where(~twin).select(F.explode(F.array("sa", "pa")).alias("key"), F.col("node_id").alias("y")), "key").select("x", "y")
    both = twins.join(twins.withColumnRenamed("x", "y"), "key").select("x", "y")
    pairs = alike.union(met).union(met.select("y", "x")).union(both).distinct()
    one, two = (hashed.select(*[F.col(c).alias(f"{c}{i}") for c in hashed.columns]) for i in (1, 2))
    pairs = pairs.join(one, F.col("x") == F.col("node_id1")).join(two, F.col("y") == F.col("node_id2"))
    same = lambda x, y: ((F.col(f"{x}a1") == F.col(f"{y}a2")) & (F.col(f"{x}b1") == F.col(f"{y}b2"))).cast("int")
    more = same("s", "s") + same("s", "p") + same("p", "s") + same("p", "p") - 1
    return _linked(pairs.withColumn("more", more).where("more > 0")).select(*LINK, F.explode(F.array_repeat(F.lit(0), F.col("more")))).select(*LINK)


LINK = ("n1", "o1", "n2", "o2", "overlap")


def _linked(pairs: DataFrame) -> DataFrame:
    """`pairs` of nodes with n1, o1, n2, o2, overlap: a row for each way in which they are linked."""

    def meets(x: str, y: str, turned: bool) -> Column:
        """Whether part x of the first node equals part y of the second, one of them turned round or not."""
        same = F.col(f"{x}r1") != F.col(f"{y}r2") if turned else F.col(f"{x}r1") == F.col(f"{y}r2")
        return (F.col(f"{x}a1") == F.col(f"{y}a2")) & (F.col(f"{x}b1") == F.col(f"{y}b2")) & (same | F.col(f"{x}p1"))

    ways = (("++", "s", "p", False), ("+-", "s", "s", True), ("-+", "p", "p", True), ("--", "p", "s", False))
    found = F.array_compact(F.array(*[F.when(meets(x, y, turned), F.lit(o)) for o, x, y, turned in ways]))
    shift = F.when(F.col("o").startswith("+"), F.col("shift_l1")).otherwise(F.col("shift_r1"))
    return pairs.select("*", F.explode(found).alias("o")).select(
        "*", F.col("node_id1").alias("n1"), F.substring("o", 1, 1).alias("o1"), F.col("node_id2").alias("n2"), F.substring("o", 2, 1).alias("o2"),
        F.least(F.col("seqlen1") - shift, F.col("seqlen2") - 1).alias("overlap"),
    )


def candidates(firsts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """n1, o1, n2, o2, overlap, ka, kb, slot, abundance1, abundance2: what each of the nodes `firsts` finds by its two keys among `nodes`."""
    pre, suf = without_last(F.col("kmer"), k), without_first(F.col("kmer"), k)
    key = lambda slot, side: F.struct(F.lit(slot).alias("slot"), F.col(f"{side}a").alias("ka"), F.col(f"{side}b").alias("kb"))
    marks = [f"{side}{x}" for side in "sp" for x in "abrp"]

    def keyed(own: DataFrame) -> DataFrame:
        hashed = own.select("node_id", "abundance", "seqlen", "shift_l", "shift_r", *_side("s", suf), *_side("p", pre))
        return hashed.select("*", F.inline(F.array(key(0, "s"), key(1, "p"))))

    one = keyed(firsts).select("ka", "kb", "slot", *[F.col(c).alias(f"{c}1") for c in ("node_id", "abundance", "seqlen", "shift_l", "shift_r", *marks)])
    two = keyed(nodes).select("ka", "kb", *[F.col(c).alias(f"{c}2") for c in ("node_id", "abundance", "seqlen", *marks)])

    return _linked(one.join(two, ["ka", "kb"])).select(*LINK, "ka", "kb", "slot", "abundance1", "abundance2")


def weak(cand: DataFrame, presimp: float) -> DataFrame:
    """Candidates with `weak`: far below the abundance around their key."""
    # all rows of a node's slot have one key, by which they lie together already
    group = Window.partitionBy("ka", "kb", "n1", "slot")
    ref = F.least(F.max("abundance2").over(group), F.col("abundance1"))
    far = F.col("abundance2").cast("float") < F.lit(presimp).cast("float") * ref.cast("float")
    return cand.withColumn("weak", (F.count("*").over(group) >= 2) & far)


def overlap_members(nodes: DataFrame, k: int) -> DataFrame:
    """key, node_id, slot, reversed: each node under its two canonical (k-1)-mers, its last (slot 0) and its first (slot 1).

    The linear form of the overlap graph: two rows of a key are linked wherever their directions fit, and nothing is paired.
    """
    pre, suf = without_last(F.col("kmer"), k), without_first(F.col("kmer"), k)
    side = lambda slot, part: F.struct(canonical(part).alias("key"), F.lit(slot).alias("slot"), (part != canonical(part)).alias("reversed"))
    return nodes.select("node_id", F.inline(F.array(side(0, suf), side(1, pre)))).select("key", "node_id", "slot", "reversed")


def overlap_classes(nodes: DataFrame, k: int) -> DataFrame:
    """key, n_nodes, n_links: each shared (k-1)-mer, its distinct nodes, and the links through it, counted without pairing them."""
    out, into = F.col("slot") == F.col("reversed").cast("int"), F.col("slot") != F.col("reversed").cast("int")
    per = overlap_members(nodes, k).groupBy("key").agg(
        F.countDistinct("node_id").alias("n_nodes"), F.count_if(out).alias("leave"), F.count_if(into).alias("enter"), F.count("*").alias("rows")
    )
    # what leaves in a direction meets what enters in it: a last part forwards, or a first part backwards, leaves forwards
    palindrome = F.col("key") == F.reverse("key")
    n = F.when(palindrome, F.col("rows") * F.col("rows")).otherwise(F.lit(2) * F.col("leave") * F.col("enter"))
    return per.where("n_nodes > 1").select("key", "n_nodes", n.alias("n_links"))


def break_loops(links: DataFrame) -> DataFrame:
    """Without self-loops, and of each unordered pair of nodes only the first link by (n1, o1, n2, o2, overlap)."""
    kept = links.where((F.col("n1") != F.col("n2")) & F.col("o1").isNotNull() & F.col("o2").isNotNull())
    first = F.min(F.struct("n1", "o1", "n2", "o2", "overlap")).alias("e")
    return kept.groupBy(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).agg(first).select("e.*")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node_id, component (its smallest node_id) of every node of the links (n1, n2).

    Alternating large-star and small-star rounds: each is one shuffle by node, a hub's neighbours are reduced to their minimum with
    a partial aggregate, and the rounds grow with the logarithm of the longest path.  Nothing is collected but a change count.
    """
    pairs = links.where(F.col("n1").isNotNull() & F.col("n2").isNotNull()).select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b"))
    every = pairs.select(F.col("a").alias("node_id")).union(pairs.select("b")).distinct()
    cur = written(pairs.where("a <> b").distinct())
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node moves to the node's smallest neighbour (or itself)
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b")
        # small star: every smaller neighbour of a node, and the node, move to its smallest neighbour
        large = large.where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(low.select("m", "b"))
        cur = written(small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), instead_of=cur)
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    low = cur.groupBy(F.col("b").alias("node_id")).agg(F.min("a").alias("component"))
    return every.join(low, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def flip(o: Column) -> Column:
    return F.when(o == "+", "-").otherwise("+")


def both_sides(links: DataFrame) -> DataFrame:
    """Distinct links written from either side."""
    return _from_either_side(links).distinct()


def _from_either_side(links: DataFrame) -> DataFrame:
    kept = links.where(F.col("n1").isNotNull() & F.col("n2").isNotNull() & F.col("o1").isin("+", "-") & F.col("o2").isin("+", "-"))
    own = kept.select("n1", "o1", "n2", "o2")
    return own.union(kept.select("n2", flip(F.col("o2")), "n1", flip(F.col("o1"))))


def unitigs(links: DataFrame, all_nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """unitig, ord, node_id, o: maximal paths without branches, each once.

    A step leads from an oriented node to the next if it is the only way out of the one and the only way into the other.  Pointer
    doubling finds for every oriented node its path's start and its number on it, in rounds that grow with the logarithm of
    the longest path.  Each path and its mirror image both appear; the one with the smaller start is kept.  A circle
    is cut before its smallest oriented node.  `all_nodes` (node_id) adds nodes without links.
    """
    both = _from_either_side(links)
    start = F.struct(F.col("n1").alias("n"), F.col("o1").alias("o"))
    stop = F.struct(F.col("n2").alias("n"), F.col("o2").alias("o"))
    e = both.select(start.alias("u"), stop.alias("v"))
    # repeated links have one end, so they need not be made distinct before they are counted in the tasks
    single_out = e.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v = w").select("u", "v")
    single_in = e.groupBy("v").agg(F.min("u").alias("u"), F.max("u").alias("w")).where("u = w").select("v")
    # a node does not follow its own mirror image
    step = written(single_out.join(single_in, "v", "left_semi").where("u.n <> v.n"))
    nodes = both.select("n1")
    if all_nodes is not None:
        nodes = nodes.union(all_nodes.select("node_id"))
    ends = nodes.distinct().select(F.explode(F.array(*[F.struct(F.col("n1").alias("n"), F.lit(x).alias("o")) for x in "+-"])).alias("v"))
    # at: the farthest node reached backwards, hops: steps to it, low: smallest node on the way, root: nothing leads to `at`
    first = F.col("u").isNull()
    state = written(ends.join(step, "v", "left").select(
        "v", F.coalesce("u", "v").alias("at"), (~first).cast("bigint").alias("hops"), F.least("v", F.coalesce("u", "v")).alias("low"), first.alias("root")))
    columns = ["v", "at", "hops", "low", "root"]
    for _ in range(max_rounds):
        # only what has not reached its root looks on; few such rows are broadcast by their table's size, and then nothing is shuffled
        back = state.select(F.col("v").alias("at"), F.col("at").alias("at2"), F.col("hops").alias("hops2"), F.col("low").alias("low2"), F.col("root").alias("root2"))
        on = state.where("NOT root").select("v", "at", "hops", "low").join(back, "at").select(
            "v", F.col("at2").alias("at"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("low", "low2").alias("low"), F.col("root2").alias("root"),
            (F.col("root2") | (F.col("low2") < F.col("low"))).alias("moved"))
        state = written(on.union(state.where("root").select(*columns, F.lit(False))), instead_of=state)
        n_open, n_moved = state.agg(F.count_if(~F.col("root")), F.count_if("moved")).first()
        if not n_open or not n_moved:
            break
    else:
        raise RuntimeError(f"paths have not settled after {max_rounds} rounds")
    found = state.where("root").select("v", F.col("at").alias("head"), F.col("hops").alias("ord"))
    if n_open:
        # what never reached a root lies on a circle
        found = written(found.union(_number_circles(state.where("NOT root").select("v", "low"), step, max_rounds)))
    # one of a path and its mirror image: the smaller of both heads; the mirror's head is the flipped tail
    tail = found.groupBy("head").agg(F.max(F.struct("ord", "v")).alias("t")).select("head", F.struct(F.col("t.v.n").alias("n"), flip(F.col("t.v.o")).alias("o")).alias("mirror"))
    kept = found.join(tail, "head").where(F.col("head") <= F.col("mirror"))
    return kept.select(F.concat(F.col("head.n").cast("string"), F.col("head.o")).alias("unitig"), F.col("ord").cast("bigint").alias("ord"), F.col("v.n").alias("node_id"), F.col("v.o").alias("o"))


def _number_circles(circle: DataFrame, step: DataFrame, max_rounds: int) -> DataFrame:
    """v, head, ord for oriented nodes on circles, cut before the smallest one; of a circle and its mirror only that with the
    smaller cut."""
    own = circle.select("v", "low")
    other = circle.select(F.struct(F.col("v.n").alias("n"), flip(F.col("v.o")).alias("o")).alias("v"), F.col("low").alias("low2"))
    own = written(own.join(other, "v").where(F.col("low") <= F.col("low2")).select("v", "low"))
    before = step.join(own.select("v", "low"), "v").where(F.col("v") != F.col("low")).select("v", "u")
    state = written(own.select("v").join(before, "v", "left").select("v", F.coalesce("u", "v").alias("at"), F.col("u").isNotNull().cast("bigint").alias("hops")))
    if state.isEmpty():
        return state.select("v", F.col("at").alias("head"), F.col("hops").alias("ord"))
    for _ in range(max_rounds):
        back = state.select(F.col("v").alias("at"), F.col("at").alias("at2"), F.col("hops").alias("hops2"))
        state = written(
            state.join(back, "at").select("v", F.col("at2").alias("at"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("hops2") > 0).alias("moved")), instead_of=state
        )
        if state.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"circles have not settled after {max_rounds} rounds")
    return state.select("v", F.col("at").alias("head"), F.col("hops").alias("ord"))


def tips(links: DataFrame, paths: DataFrame, sizes: DataFrame, max_nodes: int, max_length: int) -> DataFrame:
    """unitig of every dead end: a path of at most `max_nodes` nodes and `max_length` bases, one end of which has no link while the
    other joins a branch.  `sizes` is (node_id, seqlen); a node of unknown length counts as a node and adds no bases."""
    both = both_sides(links)
    per = paths.join(sizes.select("node_id", "seqlen"), "node_id", "left").groupBy("unitig").agg(
        F.min(F.struct("ord", "node_id", "o")).alias("first"), F.max(F.struct("ord", "node_id", "o")).alias("last"), F.count("*").alias("n_nodes"), F.coalesce(F.sum("seqlen"), F.lit(0)).alias("bases")
    )
    outs = both.groupBy(F.col("n1").alias("n"), F.col("o1").alias("o")).agg(F.count("*").alias("outs"))
    first, last = F.col("first"), F.col("last")
    ends = per.select("unitig", "n_nodes", "bases", first["node_id"].alias("fn"), flip(first["o"]).alias("fo"), last["node_id"].alias("ln"), last["o"].alias("lo"))
    left = outs.select(F.col("n").alias("fn"), F.col("o").alias("fo"), F.col("outs").alias("l"))
    right = outs.select(F.col("n").alias("ln"), F.col("o").alias("lo"), F.col("outs").alias("r"))
    joined = ends.join(left, ["fn", "fo"], "left").join(right, ["ln", "lo"], "left")
    dead = F.col("l").isNull() != F.col("r").isNull()
    return joined.where(dead & (F.col("n_nodes") <= max_nodes) & (F.col("bases") <= max_length)).select("unitig")


def bubbles(links: DataFrame, paths: DataFrame, stats: DataFrame, max_length: int) -> DataFrame:
    """unitig of every weaker side of a bubble: a path of at most `max_length` bases between the same two oriented ends as a path of
    higher (mean_abundance, then smaller name).  `stats` is (unitig, bases, mean_abundance)."""
    both = both_sides(links)
    ends = paths.groupBy("unitig").agg(F.min(F.struct("ord", "node_id", "o")).alias("f"), F.max(F.struct("ord", "node_id", "o")).alias("l"))
    before = both.select(F.col("n2").alias("fn"), F.col("o2").alias("fo"), F.struct(F.col("n1").alias("n"), F.col("o1").alias("o")).alias("a"))
    after = both.select(F.col("n1").alias("ln"), F.col("o1").alias("lo"), F.struct(F.col("n2").alias("n"), F.col("o2").alias("o")).alias("z"))
    rows = ends.select("unitig", F.col("f.node_id").alias("fn"), F.col("f.o").alias("fo"), F.col("l.node_id").alias("ln"), F.col("l.o").alias("lo"))
    one_in = before.groupBy("fn", "fo").agg(F.count("*").alias("c"), F.min("a").alias("a")).where("c = 1").drop("c")
    one_out = after.groupBy("ln", "lo").agg(F.count("*").alias("c"), F.min("z").alias("z")).where("c = 1").drop("c")
    rows = rows.join(one_in, ["fn", "fo"]).join(one_out, ["ln", "lo"])
    turned = lambda c: F.struct(F.col(f"{c}.n").alias("n"), flip(F.col(f"{c}.o")).alias("o"))
    own, other = F.struct("a", "z"), F.struct(turned("z").alias("a"), turned("a").alias("z"))
    rows = rows.select("unitig", F.least(own, other).alias("key")).join(stats, "unitig")
    best = rows.groupBy("key").agg(F.count("*").alias("sides"), F.max(F.struct("mean_abundance", "bases", "unitig")).alias("best"))
    return rows.join(best, "key").where((F.col("sides") > 1) & (F.col("unitig") != F.col("best.unitig")) & (F.col("bases") <= max_length)).select("unitig")


def without_unitigs(links: DataFrame, paths: DataFrame, gone: DataFrame) -> DataFrame:
    """Links whose ends both lie outside the named unitigs."""
    out = paths.join(gone, "unitig", "left_semi").select(F.col("node_id").alias("x")).distinct()
    return links.join(out, F.col("n1") == F.col("x"), "left_anti").join(out, F.col("n2") == F.col("x"), "left_anti")


def subgraph(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links with both ends in `chosen` (node_id)."""
    a, b = chosen.select(F.col("node_id").alias("n1")), chosen.select(F.col("node_id").alias("n2"))
    return links.join(a, "n1", "left_semi").join(b, "n2", "left_semi")


def n50(lengths: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """n, total, and for each share the length from which longer pieces hold it (n50, n90).

    Pieces are added up by distinct length first, so the running sum goes over lengths and not over pieces.
    """
    per = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("len")).agg(F.count("*").alias("c"), (F.count("*") * F.col(column)).alias("s"))
    run = per.withColumn("upto", F.sum("s").over(Window.orderBy(F.desc("len"))))
    total = per.agg(F.sum("s")).scalar()
    found = [F.max(F.when(F.col("upto") >= total * F.lit(x), F.col("len"))).alias(f"n{round(100 * x)}") for x in shares]
    return run.agg(F.sum("c").alias("n"), F.sum("s").alias("total"), *found)
