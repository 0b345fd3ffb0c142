"""Queries over nodes, edges and intervals, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import analytics, basespace, correct, graph
from strandloom.session import saved, table
from strandloom.sources import formats

K = 5
#: Limits of dead ends and bubbles.
TIP_NODES, TIP_LENGTH, BUBBLE_LENGTH = 10, 5_000, 5_000


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.nodes_once(table(spark, sf_dir, "nodes"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges")


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node once."""
    return nodes(spark, sf_dir)


def mdbg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap graph of the nodes."""
    return graph.edges(nodes(spark, sf_dir).where("abundance IS NOT NULL AND seqlen IS NOT NULL"), K)


def mdbg_edges_presimp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap graph without neighbours of less than a hundredth of the abundance around them."""
    return graph.edges(nodes(spark, sf_dir).where("abundance IS NOT NULL AND seqlen IS NOT NULL"), K, presimp=0.01)


def overlap_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes under their two (k-1)-mers: the overlap graph without its pairs."""
    return graph.overlap_members(nodes(spark, sf_dir).where("abundance IS NOT NULL AND seqlen IS NOT NULL"), K)


def overlap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared (k-1)-mers with their nodes and the links through each."""
    return graph.overlap_classes(nodes(spark, sf_dir).where("abundance IS NOT NULL AND seqlen IS NOT NULL"), K)


def break_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without self-loops, one for each pair of nodes."""
    return graph.break_loops(links(spark, sf_dir))


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links out of and into each node."""
    return analytics.node_degrees(links(spark, sf_dir))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakly connected component of every linked node."""
    return graph.components(links(spark, sf_dir))


def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest components."""
    return graph.components(links(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n_nodes")).orderBy(F.desc("n_nodes"), "component").limit(10)


def subgraph_abundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between nodes of abundance 5 or more."""
    chosen = nodes(spark, sf_dir).where("abundance >= 5").select("node_id")
    return graph.subgraph(graph.both_sides(links(spark, sf_dir)), chosen)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unitigs(links(spark, sf_dir), nodes(spark, sf_dir))


def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal paths without branches, node by node."""
    return _paths(spark, sf_dir)


def _stats(spark: SparkSession, sf_dir: str, paths: DataFrame) -> DataFrame:
    return basespace.unitig_stats(paths, nodes(spark, sf_dir).where("seqlen IS NOT NULL"))


def unitig_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, bases and abundance of each path."""
    return _stats(spark, sf_dir, _paths(spark, sf_dir))


def unitig_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N50 and N90 of the paths."""
    return graph.n50(_stats(spark, sf_dir, _paths(spark, sf_dir)), "bases")


def unitig_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples along each path."""
    return analytics.unitig_samples(_paths(spark, sf_dir), table(spark, sf_dir, "nodes"))


def graph_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short dead ends."""
    e = links(spark, sf_dir)
    return graph.tips(e, saved(_paths(spark, sf_dir)), nodes(spark, sf_dir).where("seqlen IS NOT NULL"), TIP_NODES, TIP_LENGTH)


def graph_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weaker sides of short bubbles."""
    paths = saved(_paths(spark, sf_dir))
    return graph.bubbles(links(spark, sf_dir), paths, _stats(spark, sf_dir, paths), BUBBLE_LENGTH)


def simplified_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after one round of clipping dead ends and popping bubbles."""
    e, paths = graph.both_sides(links(spark, sf_dir)), saved(_paths(spark, sf_dir))
    sizes = nodes(spark, sf_dir).where("seqlen IS NOT NULL")
    gone = graph.tips(e, paths, sizes, TIP_NODES, TIP_LENGTH).union(graph.bubbles(e, paths, _stats(spark, sf_dir, paths), BUBBLE_LENGTH)).distinct()
    return graph.without_unitigs(e, paths, gone)


def unitig_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizers along each path of known nodes of which one has an abundance above 2."""
    return basespace.unitig_minimizers(_paths(spark, sf_dir), nodes(spark, sf_dir), min_abundance=2)


def link_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given links held against the overlap graph, as recruits of each node against its true ones: number and mean distances."""
    pairs = lambda e: graph.both_sides(e).where("n1 <> n2").select(F.col("n1").alias("template"), F.col("n2").alias("recruit"))
    own = nodes(spark, sf_dir).where("abundance IS NOT NULL AND seqlen IS NOT NULL")
    found = correct.retrieval_distances(pairs(links(spark, sf_dir)), pairs(graph.edges(own, K)), own.select(F.col("node_id").alias("id"), F.col("kmer").alias("minims")))
    return found.select("template", "kind", "n", F.round("jaccard", 9).alias("jaccard"), F.round("mash", 9).alias("mash"))


def repaired_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose overlap fits both ends."""
    return basespace.repair_overlaps(links(spark, sf_dir), nodes(spark, sf_dir).where("seqlen IS NOT NULL"))


def gfa_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as lines of its exchange format."""
    kept = nodes(spark, sf_dir).where("abundance IS NOT NULL AND seqlen IS NOT NULL")
    e = links(spark, sf_dir).where("n1 IS NOT NULL AND n2 IS NOT NULL AND o1 IS NOT NULL AND o2 IS NOT NULL AND overlap IS NOT NULL").distinct()
    return formats.gfa_lines(kept, e)


def node_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and mean abundance and their number."""
    return nodes(spark, sf_dir).agg(F.count("abundance").alias("n"), F.median("abundance").alias("median"), F.avg("abundance").alias("mean"))


def link_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard, containment and Mash distance of the lists at both ends of each pair of linked nodes."""
    n = nodes(spark, sf_dir).select("node_id", "kmer")
    pairs = graph.both_sides(links(spark, sf_dir)).where("n1 < n2").select("n1", "n2").distinct()
    rows = pairs.join(n.select(F.col("node_id").alias("n1"), F.col("kmer").alias("a")), "n1").join(n.select(F.col("node_id").alias("n2"), F.col("kmer").alias("b")), "n2")
    d = lambda kind: F.round(dna.set_distance(F.col("a"), F.col("b"), kind, 41), 9).alias(kind)
    return rows.select("n1", "n2", d("jaccard"), d("containment"), d("mash"))


def event_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of `value` seconds: how many others of the same user overlap each by more than a tenth of a second."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").where("ts IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL")
    rows = rows.select("event_id", "user_id", start.alias("start"), (start + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("end"))
    return analytics.overlap_counts(rows, "user_id", "start", "end", 100_000, 3_600_000_000).select("event_id", "n_overlaps")


QUERIES = {f.__name__: f for f in (
    node_table, mdbg_edges, mdbg_edges_presimp, overlap_members, overlap_classes, break_loops, node_degrees, graph_components, largest_components, subgraph_abundant, unitigs, unitig_stats,
    unitig_n50, unitig_samples, graph_tips, graph_bubbles, simplified_links, unitig_minimizers, link_retrieval, repaired_overlaps, gfa_text, node_abundance, link_distances, event_overlaps,
)}

NODES = """node AS (SELECT node_id, any_value(kmer) AS kmer, max(abundance) AS abundance, max(seqlen) AS seqlen, max(shift_l) AS shift_l, max(shift_r) AS shift_r
  FROM nodes WHERE node_id IS NOT NULL GROUP BY node_id)"""
_CANDIDATES = NODES + """, u AS (SELECT * FROM node WHERE abundance IS NOT NULL AND seqlen IS NOT NULL),
keyed AS (SELECT *, 0 AS slot, least(kmer[2:5], list_reverse(kmer[2:5])) AS key FROM u UNION ALL SELECT *, 1, least(kmer[1:4], list_reverse(kmer[1:4])) FROM u),
j AS (SELECT a.node_id AS n1, b.node_id AS n2, a.slot, a.abundance AS a1, b.abundance AS a2, a.seqlen AS s1, b.seqlen AS s2, a.shift_l, a.shift_r,
  a.kmer[2:5] AS sp, list_reverse(a.kmer)[2:5] AS sm, b.kmer[1:4] AS pp, list_reverse(b.kmer)[1:4] AS pm FROM keyed a JOIN keyed b USING (key)),
c AS (SELECT *, '+' AS o1, '+' AS o2 FROM j WHERE sp = pp UNION ALL SELECT *, '+', '-' FROM j WHERE sp = pm
  UNION ALL SELECT *, '-', '+' FROM j WHERE sm = pp UNION ALL SELECT *, '-', '-' FROM j WHERE sm = pm),
e AS (SELECT n1, o1, n2, o2, least(s1 - CASE WHEN o1 = '+' THEN shift_l ELSE shift_r END, s2 - 1) AS overlap,
  count(*) OVER g >= 2 AND CAST(a2 AS FLOAT) < CAST(0.01 AS FLOAT) * CAST(least(max(a2) OVER g, a1) AS FLOAT) AS weak FROM c WINDOW g AS (PARTITION BY n1, slot))"""
_MEMBERS = NODES + """, u AS (SELECT * FROM node WHERE abundance IS NOT NULL AND seqlen IS NOT NULL),
part AS (SELECT node_id, 0 AS slot, kmer[2:5] AS p, kmer[2:5] AS leaves, list_reverse(kmer[2:5]) AS enters FROM u UNION ALL SELECT node_id, 1, kmer[1:4], list_reverse(kmer[1:4]), kmer[1:4] FROM u),
member AS (SELECT *, least(p, list_reverse(p)) AS key, p <> least(p, list_reverse(p)) AS reversed FROM part)"""
BOTH = """own AS (SELECT n1, o1, n2, o2 FROM edges WHERE n1 IS NOT NULL AND n2 IS NOT NULL AND o1 IN ('+', '-') AND o2 IN ('+', '-')),
both_sides AS (SELECT * FROM own UNION SELECT n2, CASE o2 WHEN '+' THEN '-' ELSE '+' END, n1, CASE o1 WHEN '+' THEN '-' ELSE '+' END FROM own)"""
COMPONENTS = """RECURSIVE lk AS (SELECT n1 AS a, n2 AS b FROM edges WHERE n1 IS NOT NULL AND n2 IS NOT NULL UNION SELECT n2, n1 FROM edges WHERE n1 IS NOT NULL AND n2 IS NOT NULL),
reach(node_id, component) USING KEY (node_id) AS (SELECT DISTINCT a, a FROM lk
  UNION SELECT lk.b, min(reach.component) FROM reach JOIN lk ON lk.a = reach.node_id JOIN recurring.reach AS old ON old.node_id = lk.b
  WHERE reach.component < old.component GROUP BY lk.b)"""

ORACLES = {
    "node_table": f"WITH {NODES} SELECT * FROM node",
    "mdbg_edges": f"WITH {_CANDIDATES} SELECT n1, o1, n2, o2, overlap FROM e",
    "mdbg_edges_presimp": f"""WITH {_CANDIDATES}, gone AS (SELECT DISTINCT least(n1, n2) AS lo, greatest(n1, n2) AS hi FROM e WHERE weak)
SELECT n1, o1, n2, o2, overlap FROM e WHERE NOT weak AND NOT EXISTS (SELECT 1 FROM gone WHERE lo = least(n1, n2) AND hi = greatest(n1, n2))""",
    "overlap_members": f"WITH {_MEMBERS} SELECT key, node_id, slot, reversed FROM member",
    "overlap_classes": f"""WITH {_MEMBERS}, li AS (SELECT a.key, count(*) AS n FROM member a JOIN member b ON a.key = b.key AND a.leaves = b.enters GROUP BY a.key)
SELECT key, count(DISTINCT node_id) AS n_nodes, coalesce(any_value(n), 0) AS n_links FROM member LEFT JOIN li USING (key) GROUP BY key HAVING count(DISTINCT node_id) > 1""",
    "break_loops": """SELECT n1, o1, n2, o2, overlap FROM (SELECT *, row_number() OVER (PARTITION BY least(n1, n2), greatest(n1, n2) ORDER BY n1, o1, n2, o2, overlap NULLS FIRST) AS place
FROM edges WHERE n1 <> n2 AND o1 IS NOT NULL AND o2 IS NOT NULL) WHERE place = 1""",
    "node_degrees": f"WITH {BOTH} SELECT n1 AS node_id, count(*) FILTER (o1 = '+') AS links_out, count(*) FILTER (o1 = '-') AS links_in FROM both_sides GROUP BY n1",
    "graph_components": f"WITH {COMPONENTS} SELECT node_id, component FROM reach",
    "largest_components": f"WITH {COMPONENTS} SELECT component, count(*) AS n_nodes FROM reach GROUP BY component ORDER BY n_nodes DESC, component LIMIT 10",
    "subgraph_abundant": f"""WITH {BOTH}, {NODES}, ok AS (SELECT node_id FROM node WHERE abundance >= 5)
SELECT n1, o1, n2, o2 FROM both_sides WHERE n1 IN (SELECT node_id FROM ok) AND n2 IN (SELECT node_id FROM ok)""",
    "repaired_overlaps": f"""WITH {NODES} SELECT n1, o1, n2, o2, CASE WHEN overlap > a.seqlen OR overlap > b.seqlen THEN least(a.seqlen - 1, b.seqlen - 1) ELSE overlap END AS overlap
FROM edges JOIN node a ON n1 = a.node_id JOIN node b ON n2 = b.node_id WHERE overlap IS NOT NULL AND a.seqlen IS NOT NULL AND b.seqlen IS NOT NULL""",
    "gfa_text": f"""WITH {NODES} SELECT 'H\tVN:Z:1.0' AS value, 0 AS section
UNION ALL SELECT concat('S\t', node_id, '\t*\tLN:i:', seqlen, '\tKC:i:', abundance), 1 FROM node WHERE abundance IS NOT NULL AND seqlen IS NOT NULL
UNION ALL SELECT * FROM (SELECT DISTINCT concat('L\t', n1, '\t', o1, '\t', n2, '\t', o2, '\t', overlap, 'M'), 2 FROM edges
  WHERE n1 IS NOT NULL AND n2 IS NOT NULL AND o1 IS NOT NULL AND o2 IS NOT NULL AND overlap IS NOT NULL)""",
    "node_abundance": f"WITH {NODES} SELECT count(abundance) AS n, median(abundance) AS median, avg(abundance) AS mean FROM node",
    "link_distances": f"""WITH {BOTH}, {NODES}, p AS (SELECT DISTINCT n1, n2 FROM both_sides WHERE n1 < n2),
x AS (SELECT n1, n2, len(list_intersect(a.kmer, b.kmer)) AS i, len(list_distinct(a.kmer)) AS na, len(list_distinct(list_concat(a.kmer, b.kmer))) AS u FROM p JOIN node a ON n1 = a.node_id JOIN node b ON n2 = b.node_id)
SELECT n1, n2, round(1 - i / u, 9) AS jaccard, round(1 - i / na, 9) AS containment, round(CASE WHEN i = 0 THEN 1.0 ELSE -ln(2 * (i / u) / (1 + i / u)) / 41 END, 9) AS mash FROM x""",
    "event_overlaps": """WITH v AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS e FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL),
l AS (SELECT * FROM v WHERE e - s > 100000)
SELECT a.event_id, count(b.event_id) AS n_overlaps FROM l a LEFT JOIN l b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND least(a.e, b.e) - greatest(a.s, b.s) > 100000 GROUP BY a.event_id""",
}

# Oriented nodes as numbers: twice the node_id, plus one if read backwards; they sort like (node_id, orientation).
_UNITIGS = f"""RECURSIVE {BOTH}, {NODES},
en AS (SELECT n1 * 2 + CAST(o1 = '-' AS INT) AS u, n2 * 2 + CAST(o2 = '-' AS INT) AS v FROM both_sides),
so AS (SELECT u, min(v) AS v FROM en GROUP BY u HAVING count(*) = 1), si AS (SELECT v FROM en GROUP BY v HAVING count(*) = 1),
step AS (SELECT u, v FROM so SEMI JOIN si USING (v) WHERE u // 2 <> v // 2),
o AS (SELECT n * 2 + s AS v FROM (SELECT n1 AS n FROM both_sides UNION SELECT node_id FROM node), (VALUES (0), (1)) t(s)),
path(head, v, ord) AS (SELECT v, v, 0 FROM o ANTI JOIN step USING (v) UNION ALL SELECT head, step.v, ord + 1 FROM path JOIN step ON path.v = step.u),
ring(head, v, ord) AS (SELECT v, v, 0 FROM o ANTI JOIN path USING (v) UNION ALL SELECT head, step.v, ord + 1 FROM ring JOIN step ON ring.v = step.u WHERE step.v <> head),
every AS (SELECT * FROM path UNION ALL SELECT * FROM ring WHERE head IN (SELECT head FROM ring GROUP BY head HAVING min(v) = head AND min(xor(v, 1)) >= head)),
tail AS (SELECT head, arg_max(v, ord) AS t FROM every GROUP BY head),
unitig AS (SELECT concat(head // 2, CASE head % 2 WHEN 0 THEN '+' ELSE '-' END) AS unitig, CAST(ord AS BIGINT) AS ord, v // 2 AS node_id, CASE v % 2 WHEN 0 THEN '+' ELSE '-' END AS o
  FROM every JOIN tail USING (head) WHERE head <= xor(t, 1)),
stats AS (SELECT unitig, count(*) AS n_nodes, CAST(sum(CASE WHEN ord = 0 THEN seqlen WHEN o = '+' THEN shift_r ELSE shift_l END) AS BIGINT) AS bases,
  CAST(sum(abundance) AS BIGINT) AS total_abundance, sum(abundance) / count(*) AS mean_abundance FROM unitig JOIN node USING (node_id) WHERE seqlen IS NOT NULL GROUP BY unitig)"""

_GONE = f"""{_UNITIGS}, fl(f) AS (SELECT '+' UNION ALL SELECT '-'),
endp AS (SELECT unitig, arg_min(node_id, ord) AS fn, arg_min(o, ord) AS fo, arg_max(node_id, ord) AS ln, arg_max(o, ord) AS lo, count(*) AS n_nodes, coalesce(sum(seqlen), 0) AS len FROM unitig LEFT JOIN node USING (node_id) GROUP BY unitig),
tip AS (SELECT unitig FROM endp WHERE n_nodes <= {TIP_NODES} AND len <= {TIP_LENGTH}
  AND EXISTS (SELECT 1 FROM both_sides WHERE n1 = fn AND o1 <> fo) <> EXISTS (SELECT 1 FROM both_sides WHERE n1 = ln AND o1 = lo)),
prev AS (SELECT n2, o2, any_value(n1 * 2 + CAST(o1 = '-' AS INT)) AS a FROM both_sides GROUP BY n2, o2 HAVING count(*) = 1),
foll AS (SELECT n1, o1, any_value(n2 * 2 + CAST(o2 = '-' AS INT)) AS z FROM both_sides GROUP BY n1, o1 HAVING count(*) = 1),
arm AS (SELECT unitig, least([a, z], [xor(z, 1), xor(a, 1)]) AS key, bases, mean_abundance FROM endp JOIN prev ON fn = n2 AND fo = o2 JOIN foll ON ln = n1 AND lo = o1 JOIN stats USING (unitig)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY key) AS sides, row_number() OVER (PARTITION BY key ORDER BY mean_abundance DESC NULLS LAST, bases DESC NULLS LAST, unitig DESC) AS place FROM arm),
bubble AS (SELECT unitig FROM ranked WHERE sides > 1 AND place > 1 AND bases <= {BUBBLE_LENGTH}),
gone AS (SELECT DISTINCT node_id FROM unitig WHERE unitig IN (SELECT unitig FROM tip UNION SELECT unitig FROM bubble))"""

ORACLES |= {
    "graph_tips": f"WITH {_GONE} SELECT unitig FROM tip",
    "graph_bubbles": f"WITH {_GONE} SELECT unitig FROM bubble",
    "simplified_links": f"WITH {_GONE} SELECT n1, o1, n2, o2 FROM both_sides WHERE n1 NOT IN (SELECT node_id FROM gone) AND n2 NOT IN (SELECT node_id FROM gone)",
    "unitig_minimizers": f"""WITH {_UNITIGS}, pc AS (SELECT unitig, ord, abundance, kmer, CASE WHEN o = '+' THEN kmer ELSE list_reverse(kmer) END AS w FROM unitig LEFT JOIN node USING (node_id))
SELECT unitig, flatten(list(CASE WHEN ord = 0 THEN w ELSE w[-1:] END ORDER BY ord)) AS minims FROM pc GROUP BY unitig HAVING count(*) = count(kmer) AND max(abundance) > 2""",
    "link_retrieval": f"""WITH {_CANDIDATES}, own2 AS (SELECT n1, n2 FROM edges WHERE n1 <> n2 AND o1 IN ('+', '-') AND o2 IN ('+', '-')), f AS (SELECT n1, n2 FROM own2 UNION SELECT n2, n1 FROM own2),
tr AS (SELECT n1, n2 FROM e WHERE n1 <> n2 UNION SELECT n2, n1 FROM e WHERE n1 <> n2),
pr AS (SELECT n1, n2, CASE WHEN f.n1 IS NULL THEN 'fn' WHEN tr.n1 IS NULL THEN 'fp' ELSE 'tp' END AS kind FROM f FULL JOIN tr USING (n1, n2)),
x AS (SELECT n1, kind, len(list_intersect(a.kmer, b.kmer)) / len(list_distinct(list_concat(a.kmer, b.kmer))) AS j FROM pr JOIN u a ON n1 = a.node_id JOIN u b ON n2 = b.node_id)
SELECT n1 AS template, kind, count(*) AS n, round(avg(1 - j), 9) AS jaccard, round(avg(CASE WHEN j = 0 THEN 1.0 ELSE -ln(2 * j / (1 + j)) / 10 END), 9) AS mash FROM x GROUP BY n1, kind""",
    "unitigs": f"WITH {_UNITIGS} SELECT unitig, ord, node_id, o FROM unitig",
    "unitig_stats": f"WITH {_UNITIGS} SELECT * FROM stats",
    "unitig_n50": f"""WITH {_UNITIGS}, run AS (SELECT bases, sum(bases) OVER (ORDER BY bases DESC, unitig) AS upto, sum(bases) OVER () AS total FROM stats WHERE bases IS NOT NULL)
SELECT count(*) AS n, CAST(sum(bases) AS BIGINT) AS total, max(bases) FILTER (upto >= 0.5 * total) AS n50, max(bases) FILTER (upto >= 0.9 * total) AS n90 FROM run""",
    "unitig_samples": f"""WITH {_UNITIGS} SELECT unitig, count(DISTINCT sample_id) AS n_samples FROM unitig JOIN (SELECT node_id, sample_id FROM nodes WHERE sample_id IS NOT NULL) USING (node_id) GROUP BY unitig""",
}
