"""Maximal paths and cleaning of the overlap graph by its (k-1)-mers, without a row for each link.

A node has two ends, its last (slot 0) and its first (slot 1) (k-1)-mer.  At a (k-1)-mer every left end is linked to every right one, at a
palindrome every end to every end, itself included.  Only links that are taken out are listed (`cuts`, from either end), so an end's links
are counted as the other side's ends less its cuts, and a single one left is their exclusive or.  A path becomes one row, a segment, and
later rounds see segments only.  Definitions are those of `graph`: the same graph gives the same paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from strandloom.operators import graph
from strandloom.session import together, written

SIGN = ("+", "-")
END = ("n", "slot", "ka", "kb", "left", "pal")


def segments(nodes: DataFrame, k: int) -> DataFrame:
    """One segment a node: sid (the first node), f and l (its first and last end), and sums in either direction."""
    pre, suf = graph.without_last(F.col("kmer"), k), graph.without_first(F.col("kmer"), k)
    hashed = nodes.select("*", *graph._side("s", suf), *graph._side("p", pre))

    def end(slot: int, x: str) -> Column:
        left = F.col(f"{x}r") if slot else ~F.col(f"{x}r")
        parts = (F.col("node_id"), F.lit(slot), F.col(f"{x}a"), F.col(f"{x}b"), left, F.col(f"{x}p"))
        return F.struct(*[c.alias(name) for name, c in zip(END, parts)])

    big = lambda c: c.cast("bigint")
    return hashed.select(
        F.col("node_id").alias("sid"), F.xxhash64("read_id").alias("near"), end(1, "p").alias("f"), end(0, "s").alias("l"), F.lit(1).cast("bigint").alias("n_nodes"), big(F.col("seqlen")).alias("seqlens"),
        big(F.col("shift_r")).alias("added_f"), big(F.col("shift_l")).alias("added_r"), big(F.col("seqlen") - F.col("shift_r")).alias("whole_f"),
        big(F.col("seqlen") - F.col("shift_l")).alias("whole_r"), big(F.col("abundance")).alias("abundance"), F.lit(False).alias("ring"),
    )


def weak_cuts(nodes: DataFrame, segs: DataFrame, k: int, presimp: float) -> DataFrame:
    """Cuts of the pairs of nodes that `graph.edges` leaves out with this presimp.

    Only a node of more than 1 / presimp can have weak neighbours, so only such nodes list theirs.
    """
    strong = nodes.where(F.col("abundance") * presimp > 0.99)
    pairs = graph.candidates(strong, nodes, k).transform(lambda c: graph.weak(c, presimp)).where("weak").select(F.least("n1", "n2").alias("n1"), F.greatest("n1", "n2").alias("n2")).distinct()
    a, b = (segs.select(F.col("sid").alias(f"n{i}"), F.array("l", "f").alias(f"e{i}")) for i in (1, 2))
    both = pairs.join(a, "n1").join(b, "n2").select(F.explode("e1").alias("x"), "e2").select("x", F.explode("e2").alias("y"))
    return _cuts(both.where(_linked(F.col("x"), F.col("y"))))


def _linked(x: Column, y: Column) -> Column:
    return (x["ka"] == y["ka"]) & (x["kb"] == y["kb"]) & ((x["left"] != y["left"]) | x["pal"])


def _cuts(pairs: DataFrame) -> DataFrame:
    """n, slot, ka, kb, n2, slot2 of pairs of ends (x, y), from either end."""
    one = lambda x, y: pairs.select(*[F.col(f"{x}.{c}").alias(c) for c in ("n", "slot", "ka", "kb")], F.col(f"{y}.n").alias("n2"), F.col(f"{y}.slot").alias("slot2"))
    return one("x", "y").union(one("y", "x")).distinct()


def _degrees(segs: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """sid, at (0 first, 1 last end), d: number of links, the only one's end (nn, ns) and segment end (nsid, nat), whether a path goes on there."""
    end = lambda at, x: F.struct(F.lit(at).alias("at"), *[F.col(f"{x}.{c}").alias(c) for c in END])
    own = segs.select("sid", F.inline(F.array(end(0, "f"), end(1, "l"))))
    to = ("n", "slot", "sid", "at")
    rows = own.withColumn("cut", F.lit(False)).select("*", *[F.lit(None).cast(kind).alias(f"{c}2") for c, kind in zip(to, ("bigint", "int", "bigint", "int"))])
    if cuts is not None:
        other = own.select(*[F.col(c).alias(f"{c}2") for c in to])
        rows = rows.unionByName(cuts.join(other, ["n2", "slot2"]).withColumn("cut", F.lit(True)), allowMissingColumns=True)
    key, mine = Window.partitionBy("ka", "kb"), Window.partitionBy("ka", "kb", "n", "slot")
    zero = lambda c: F.coalesce(c, F.lit(0))
    gone = [F.count_if("cut").over(mine).alias("g")] + [zero(F.bit_xor(f"{c}2").over(mine)).alias(f"g_{c}") for c in to]
    rows = rows.select("*", *gone)
    sides = {"l": ~F.col("cut") & F.col("left"), "r": ~F.col("cut") & ~F.col("left")}
    of_side = [x for s, here in sides.items() for x in (F.count_if(here).over(key).alias(s), *[zero(F.bit_xor(F.when(here, F.col(c))).over(key)).alias(f"{s}_{c}") for c in to])]
    rows = rows.select("*", *of_side).where("NOT cut")
    across = lambda both, x: F.when(F.col("pal"), both).when(F.col("left"), F.col(f"r{x}")).otherwise(F.col(f"l{x}"))
    only = {c: across(F.col(f"l_{c}").bitwiseXOR(F.col(f"r_{c}")), f"_{c}").bitwiseXOR(F.col(f"g_{c}")).alias(x) for c, x in zip(to, ("nn", "ns", "nsid", "nat"))}
    rows = rows.select("ka", "kb", "sid", "at", (across(F.col("l") + F.col("r"), "") - F.col("g")).alias("deg"), *only.values())
    # a path goes on where both ends have no other link; it does not follow its own mirror image or itself
    single = (F.col("deg") == 1) & (F.col("sid") != F.col("nsid"))
    here, there = F.struct("sid", "at"), F.struct(F.col("nsid").alias("sid"), F.col("nat").alias("at"))
    rows = rows.withColumn("lo", F.when(single, F.least(here, there))).withColumn("hi", F.when(single, F.greatest(here, there)))
    meet = F.count("*").over(Window.partitionBy("ka", "kb", "lo", "hi")) == 2
    return rows.select("sid", "at", F.struct("deg", "nn", "ns", "nsid", "nat", (single & meet).alias("on")).alias("d"))


def _chained(part: pa.Table) -> pa.Table:
    """Rows of segments of one node each with `turned`, `head` and `hops`: their place on the path that they form with others of the table,
    null where there is none.  Circles are left alone."""
    n = len(part)
    flat = {x: [pc.struct_field(part.column(x), c).to_numpy() for c in ("on", "nsid", "nat")] for x in ("fd", "ld")}
    sid = part.column("sid").to_numpy()
    order = np.argsort(sid)
    # 2 * row + o is a node read forwards (0) or backwards (1), `at` the farthest reached backwards
    at, hops = np.arange(2 * n), np.zeros(2 * n, dtype=np.int64)
    for o, (on, nsid, nat) in enumerate(flat.values()):
        j = order[np.minimum(np.searchsorted(sid, nsid, sorter=order), n - 1)]
        here = np.flatnonzero(on.astype(bool) & (sid[j] == nsid))
        at[2 * here + o] = 2 * j[here] + 1 - nat[here]
        hops[2 * here + o] = 1
    first = hops == 0
    for _ in range(int(2 * n).bit_length() + 1):
        if first[at].all():
            break
        hops, at = hops + hops[at], at[at]
    alone = ~first[at]
    own, back = np.arange(2 * n), np.arange(2 * n) ^ 1
    at, hops = np.where(alone, own, at), np.where(alone, 0, hops)
    # the mirror image of a path begins where that of its last node is reached from
    head, other = at, at[back]
    smaller = (sid[head // 2] < sid[other // 2]) | ((sid[head // 2] == sid[other // 2]) & (head % 2 <= other % 2))
    kept = np.where(smaller[0::2], own[0::2], own[1::2])
    lone = (at[0::2] == own[0::2]) & (at[1::2] == own[1::2])
    column = lambda x: pa.array(x, mask=lone)
    return part.append_column("turned", column(kept % 2 == 1)).append_column("head", column(sid[head[kept] // 2])).append_column("hops", column(hops[kept]))


class Paths:
    """The maximal paths of a graph as it is cleaned.  `segs` has a row for each path, with what its ends (fd, ld) are linked to."""

    def __init__(self, nodes: DataFrame, k: int, presimp: float, max_rounds: int = 60):
        self.max_rounds = max_rounds
        self.singles = written(segments(nodes, k))
        self.cuts = written(weak_cuts(nodes, self.singles, k, presimp)) if presimp > 0 else None
        self.where = self.singles.select(F.col("sid").alias("node_id"), "sid", F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("o"))
        self.moves: list[DataFrame] = []
        self.segs = self.singles
        self._gather()
        self.merge()

    def _linked(self) -> DataFrame:
        """The segments with fd and ld, what their ends are linked to."""
        own = [c for c in self.segs.columns if c not in ("fd", "ld")]
        per = _degrees(self.segs, self.cuts).groupBy("sid").agg(*[F.max(F.when(F.col("at") == at, F.col("d"))).alias(name) for at, name in ((0, "fd"), (1, "ld"))])
        return self.segs.select(own).join(per, "sid")

    def _gather(self) -> None:
        """Joins nodes whose places lie in reads of one task: neighbours on a path mostly have theirs in one read."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = list(batches)
            if part:
                yield from _chained(pa.Table.from_batches(part)).to_batches(max_chunksize=10_000)

        rows = self._linked().repartition("near")
        schema = StructType([*rows.schema, StructField("turned", BooleanType()), StructField("head", LongType()), StructField("hops", LongType())])
        found = written(rows.mapInArrow(run, schema))
        chains = self._turned(found.where("head IS NOT NULL"))
        self._replace(found.where("head IS NULL"), chains)

    def merge(self) -> None:
        """Joins segments to maximal paths."""
        while True:
            circles = self._merged()
            if circles is None:
                return
            # the cut of a circle depends on its nodes, so these are taken one by one
            self._split(circles)

    def _merged(self) -> DataFrame | None:
        """Merges; or changes nothing and returns the segments (sid) of more than one node that lie on circles not yet cut."""
        segs = written(self._linked())
        lone = F.col("fd.on") | F.col("ld.on")
        start = segs.where(lone).select("sid", F.inline(F.array(*[F.struct(F.lit(o).alias("o"), *[F.col(f"{d}.{c}").alias(c) for c in ("nsid", "nat", "on")]) for o, d in enumerate(("fd", "ld"))])))
        at = F.when(F.col("on"), F.struct(F.col("nsid").alias("n"), (1 - F.col("nat")).alias("o"))).otherwise(F.struct(F.col("sid").alias("n"), "o"))
        tables = [written(start.select(F.struct(F.col("sid").alias("n"), "o").alias("v"), at.alias("at"), F.col("on").cast("bigint").alias("hops"), F.least(F.struct(F.col("sid").alias("n"), "o"), at).alias("low"), (~F.col("on")).alias("root")))]
        first = tables[0]
        done, last, open_ = None, first, True
        for _ in range(self.max_rounds):
            # what has reached its start lies in earlier rounds' tables, read as one
            every = last if done is None else done.union(last)
            back = every.select(F.col("v").alias("at"), F.col("at").alias("at2"), F.col("hops").alias("hops2"), F.col("low").alias("low2"), F.col("root").alias("root2"))
            seen = Observation()
            on = last.where("NOT root").select("v", "at", "hops", "low").join(back, "at").select(
                "v", F.col("at2").alias("at"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("low", "low2").alias("low"), F.col("root2").alias("root"),
                (F.col("root2") | (F.col("low2") < F.col("low"))).alias("moved"))
            tables.append(written(on.observe(seen, F.count_if(~F.col("root")).alias("open"), F.count_if("moved").alias("moved")).drop("moved")))
            last, done = tables[-1], together(tables[:-1]).where("root")
            open_, moved = seen.get["open"], seen.get["moved"]
            if not open_ or not moved:
                break
        else:
            raise RuntimeError(f"paths have not settled after {self.max_rounds} rounds")
        left = last.where("NOT root")
        found = together(tables).where("root").select("v", F.col("at").alias("head"), "hops")
        found = found.withColumn("ring", F.lit(False))
        closed = segs.where("n_nodes > 1 AND NOT ring AND fd.deg = 1 AND ld.deg = 1 AND fd.nsid = sid AND ld.nsid = sid AND fd.nat = 1").select("sid")
        if open_:
            closed = closed.union(segs.where("n_nodes > 1").join(left.select(F.col("v.n").alias("sid")).distinct(), "sid", "left_semi").select("sid"))
        if not closed.isEmpty():
            return written(closed)
        if open_:
            signed = lambda c: F.struct(F.col(f"{c}.n").alias("n"), F.when(F.col(f"{c}.o") == 0, "+").otherwise("-").alias("o"))
            number = lambda c: F.struct(F.col(f"{c}.n").alias("n"), (F.col(f"{c}.o") == "-").cast("int").alias("o"))
            step = first.where("NOT root").select(signed("at").alias("u"), signed("v").alias("v"))
            round_ = graph._number_circles(left.select(signed("v").alias("v"), signed("low").alias("low")), step, self.max_rounds)
            found = found.union(round_.select(number("v").alias("v"), number("head").alias("head"), F.col("ord").alias("hops"), F.lit(True).alias("ring")))
        rows = found.select(F.col("v.n").alias("sid"), (F.col("v.o") == 1).alias("turned"), "head", "hops", "ring").join(segs.where(lone).drop("ring"), "sid")
        self._replace(segs.where(~lone), self._turned(rows))
        return None

    def _turned(self, rows: DataFrame) -> DataFrame:
        """Rows of segments with `turned`, `head` and `hops`, as they are read in their path."""
        turn = lambda x, y: F.when(F.col("turned"), F.col(y)).otherwise(F.col(x)).alias(x)
        pairs = (("f", "l"), ("fd", "ld"), ("added_f", "added_r"), ("whole_f", "whole_r"))
        return rows.select("sid", "near", "turned", "head", "hops", "n_nodes", "seqlens", "abundance", "ring", *[turn(x, y) for a, b in pairs for x, y in ((a, b), (b, a))])

    def _replace(self, alone: DataFrame, rows: DataFrame) -> None:
        """Makes one segment of each head's rows."""
        path = Window.partitionBy("head").orderBy("hops")
        whole = path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.select("*", F.first("f").over(whole).alias("pf"), F.last("l").over(whole).alias("pl"), (F.sum("n_nodes").over(path) - F.col("n_nodes")).alias("before"))
        # one of a path and its mirror image: the one whose first node, as read in it, is the smaller
        rows = written(rows.where(F.struct(F.col("pf.n"), F.col("pf.slot") == 0) <= F.struct(F.col("pl.n"), F.col("pl.slot") == 0)))
        merged = rows.groupBy(F.col("pf.n").alias("sid")).agg(
            *[F.min_by(c, "hops").alias(c) for c in ("near", "f", "fd", "whole_f")], *[F.max_by(c, "hops").alias(c) for c in ("l", "ld", "whole_r")],
            *[F.sum(c).alias(c) for c in ("n_nodes", "seqlens", "added_f", "added_r", "abundance")], F.bool_or("ring").alias("ring"))
        self.moves.append(rows.select("sid", F.col("pf.n").alias("to"), "before", "turned", F.col("n_nodes").alias("n")))
        columns = [*self.singles.columns, "fd", "ld"]
        self.segs = written(alone.select(columns).union(merged.select(columns)))

    def _place(self) -> None:
        """Brings the nodes' places (`where`) up to the segments that are left."""
        place = self.where
        for m in self.moves:
            placed = F.when(F.col("turned"), F.col("n") - 1 - F.col("ord")).otherwise(F.col("ord")) + F.coalesce("before", F.lit(0))
            place = place.join(m, "sid", "left").select("node_id", F.coalesce("to", "sid").alias("sid"), placed.alias("ord"), F.when(F.col("turned"), 1 - F.col("o")).otherwise(F.col("o")).alias("o"))
        self.where = written(place.join(self.segs.select("sid"), "sid", "left_semi").select("node_id", "sid", "ord", "o"))
        self.moves = []

    def _split(self, gone: DataFrame) -> None:
        """Takes the segments `gone` (sid) apart into their nodes."""
        self._place()
        out = written(self.where.join(gone, "sid", "left_semi").select("node_id"))
        apart = self.where.join(gone, "sid", "left_anti").union(out.select("node_id", F.col("node_id").alias("sid"), F.lit(0).cast("bigint"), F.lit(0)))
        self.where = written(apart)
        own = self.singles.columns
        self.segs = written(self.segs.select(own).join(gone, "sid", "left_anti").select(own).union(self.singles.join(out.select(F.col("node_id").alias("sid")), "sid", "left_semi").select(own)))

    def bases(self) -> int:
        return self.segs.agg(F.sum(F.col("whole_f") + F.col("added_f"))).first()[0] or 0

    def _name(self) -> Column:
        return F.concat(F.col("f.n").cast("string"), F.when(F.col("f.slot") == 1, "+").otherwise("-"))

    def clip(self, tip_nodes: int, tip_length: int, bubble_length: int) -> bool:
        """Removes dead ends and the weaker sides of bubbles (`graph.tips`, `graph.bubbles`); whether there were any."""
        gone = []
        if tip_length:
            dead = (F.col("fd.deg") == 0) != (F.col("ld.deg") == 0)
            gone.append(self.segs.where(dead & (F.col("n_nodes") <= tip_nodes) & (F.coalesce("seqlens", F.lit(0)) <= tip_length)).select("sid"))
        if bubble_length:
            to = lambda d: F.struct(F.col(f"{d}.nn").alias("n"), F.col(f"{d}.ns").alias("slot"))
            rows = self.segs.where("fd.deg = 1 AND ld.deg = 1").select(
                "sid", self._name().alias("name"), (F.col("whole_f") + F.col("added_f")).alias("bases"), (F.col("abundance") / F.col("n_nodes")).alias("mean_abundance"),
                F.struct(F.least(to("fd"), to("ld")), F.greatest(to("fd"), to("ld"))).alias("key"))
            best = rows.groupBy("key").agg(F.count("*").alias("sides"), F.max(F.struct("mean_abundance", "bases", "name")).alias("best")).where("sides > 1")
            gone.append(rows.join(best, "key").where((F.col("name") != F.col("best.name")) & (F.col("bases") <= bubble_length)).select("sid"))
        out = written(reduce(DataFrame.union, gone).distinct())
        if out.isEmpty():
            return False
        self.segs = self.segs.join(out, "sid", "left_anti")
        self.merge()
        return True

    def unloop(self) -> None:
        """Removes links of a node with itself, and of each pair of nodes all but the first (`graph.break_loops`).

        Two nodes have several links only where they share both (k-1)-mers, or where one has the same at both of its ends.  A (k-1)-mer has at
        most four nodes of that kind and two of them at most eight in common, so such pairs grow with the nodes.
        """
        self._place()
        own = self.singles.join(self.where.select(F.col("node_id").alias("sid")), "sid", "left_semi").select(F.col("sid").alias("n"), F.col("l").alias("s"), F.col("f").alias("p"))
        key = lambda x: F.struct(F.col(f"{x}.ka"), F.col(f"{x}.kb"))
        s, p = F.col("s"), F.col("p")
        itself = own.select(F.inline(F.array(F.struct(s.alias("x"), p.alias("y")), F.struct(s.alias("x"), s.alias("y")), F.struct(p.alias("x"), p.alias("y")))))
        itself = itself.where(_linked(F.col("x"), F.col("y")))
        listed = own.groupBy(F.least(key("s"), key("p")).alias("k1"), F.greatest(key("s"), key("p")).alias("k2")).agg(F.collect_list(F.struct("n", "s", "p")).alias("xs")).where(F.size("xs") > 1)
        alike = listed.select(F.explode("xs").alias("a"), "xs").select("a", F.explode("xs").alias("b"))
        twice = own.where(key("s") == key("p")).select(key("s").alias("k"), F.struct("n", "s", "p").alias("b"))
        every = own.select(F.struct("n", "s", "p").alias("a"), F.explode(F.array(key("s"), key("p"))).alias("k"))
        met = every.join(twice, "k")
        pairs = alike.union(met.select("a", "b")).union(met.select("b", "a")).where("a.n < b.n").distinct()
        ways = F.array(*[F.struct(F.lit(i).alias("way"), F.col(x).alias("x"), F.col(y).alias("y")) for i, (x, y) in enumerate((("a.s", "b.p"), ("a.s", "b.s"), ("a.p", "b.p"), ("a.p", "b.s")))])
        links = pairs.select(F.inline(ways)).where(_linked(F.col("x"), F.col("y")))
        if self.cuts is not None:
            was = self.cuts.select(*[F.col(c).alias(f"c_{c}") for c in ("n", "slot", "n2", "slot2")])
            links = links.join(was, (F.col("x.n") == F.col("c_n")) & (F.col("x.slot") == F.col("c_slot")) & (F.col("y.n") == F.col("c_n2")) & (F.col("y.slot") == F.col("c_slot2")), "left_anti")
        later = links.withColumn("place", F.row_number().over(Window.partitionBy("x.n", "y.n").orderBy("way"))).where("place > 1")
        new = written(_cuts(itself.union(later.select("x", "y"))))
        self.cuts = new if self.cuts is None else written(self.cuts.union(new).distinct())
        at = self.where.select("node_id", "sid")
        inner = new.where("n < n2").join(at.select(F.col("node_id").alias("n"), "sid"), "n").join(at.select(F.col("node_id").alias("n2"), F.col("sid").alias("sid2")), "n2").where("sid = sid2")
        inner = written(inner.select("sid").distinct())
        if not inner.isEmpty():
            self._split(inner)
        self.merge()

    def listed(self) -> DataFrame:
        """unitig, ord, node_id, o: the paths node by node, as `graph.unitigs` lists them."""
        self._place()
        names = self.segs.select("sid", self._name().alias("unitig"))
        return written(self.where.join(names, "sid").select("unitig", "ord", "node_id", F.when(F.col("o") == 0, "+").otherwise("-").alias("o")))
