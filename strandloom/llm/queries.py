"""Queries of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import encode, heavy, mixing, runs, seen, spans, subjects, terms
from strandloom.session import saved, table

READ_ONCE = """once AS (SELECT read_id, any_value(minims) AS minims, any_value(pos) AS pos FROM minspace
  WHERE read_id IS NOT NULL AND minims IS NOT NULL GROUP BY read_id)"""


# -- 2: repeated consecutive events -------------------------------------------------------------------------------------------

def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 9 bases of every read, single unclear letters bridged."""
    found = runs.collapse_runs(table(spark, sf_dir, "reads"), "read_id", "seq", min_events=9, max_gap=1)
    return found.select(F.col("id").alias("read_id"), "run_start", F.col("n_events").alias("n_bases"), "run_span")


def p2_blurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 9 bases over gaps of up to 4 unclear letters, as long as nine tenths of a run's span are its base: the purest
    neighbours merge first."""
    found = runs.collapse_runs(table(spark, sf_dir, "reads"), "read_id", "seq", min_events=9, max_gap=4, min_similarity=0.9)
    return found.select(F.col("id").alias("read_id"), F.col("event").alias("base"), "run_start", F.col("n_events").alias("n_bases"), "run_span")


P2_SQL = """WITH r AS (SELECT read_id, any_value(s) AS s FROM (
  SELECT read_id, replace(upper(regexp_replace(seq, '[ \\t\\n\\r\\v\\f]', '', 'g')), 'U', 'T') AS s FROM reads WHERE read_id IS NOT NULL AND seq IS NOT NULL)
  WHERE s NOT IN ('', '*') GROUP BY read_id),
c AS (SELECT read_id, i, substr(s, i + 1, 1) AS b FROM (SELECT read_id, s, unnest(range(length(s))) AS i FROM r)),
g AS (SELECT *, CASE WHEN b = lag(b) OVER w AND i - lag(i) OVER w <= 2 THEN 0 ELSE 1 END AS cut FROM c WHERE b IN ('A', 'C', 'G', 'T') WINDOW w AS (PARTITION BY read_id ORDER BY i)),
n AS (SELECT *, sum(cut) OVER (PARTITION BY read_id ORDER BY i) AS run FROM g)
SELECT read_id, CAST(min(i) AS INTEGER) AS run_start, CAST(count(*) AS INTEGER) AS n_bases, CAST(max(i) - min(i) + 1 AS INTEGER) AS run_span
FROM n GROUP BY read_id, b, run HAVING count(*) >= 9"""


# -- 3: frequency of every distinct term --------------------------------------------------------------------------------------

FIELDS = {0: "minims", 1: "abundance"}


def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, item, occurrences, records, mark of every hash and abundance; each read and each node once."""
    minspace, nodes = table(spark, sf_dir, "minspace"), table(spark, sf_dir, "nodes")
    lists = minspace.where(F.col("read_id").isNotNull() & (F.size("minims") > 0))
    reads = lists.groupBy("read_id").agg(F.min("arrival_no").alias("rec"), F.first("minims").alias("minims"))
    once = nodes.where(F.col("node_id").isNotNull() & F.col("abundance").isNotNull()).groupBy("node_id").agg(F.min("abundance").alias("item"))
    pairs = reads.select(F.lit(0).alias("field"), F.explode("minims").alias("item"), "rec").unionByName(
        once.select(F.lit(1).alias("field"), "item", F.col("node_id").alias("rec"))
    )
    totals = lists.agg(F.countDistinct("read_id").alias("n_records")).withColumn("field", F.lit(0)).unionByName(
        once.agg(F.count("*").alias("n_records")).withColumn("field", F.lit(1))
    )
    found = terms.marked(terms.term_counts(pairs), totals, {0: 0.035, 1: 0.10})
    return found.withColumn("field", F.when(F.col("field") == 0, FIELDS[0]).otherwise(FIELDS[1]))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are too rare or too common."""
    return term_table(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "item", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every item."""
    return term_table(spark, sf_dir).select("field", "item", "occurrences", "records")


_P3 = f"""WITH {READ_ONCE},
node AS (SELECT node_id, min(abundance) AS item FROM nodes WHERE node_id IS NOT NULL AND abundance IS NOT NULL GROUP BY node_id),
pairs AS (SELECT 'minims' AS field, unnest(minims) AS item, read_id AS rec FROM once UNION ALL SELECT 'abundance', item, CAST(node_id AS VARCHAR) FROM node),
counts AS (SELECT field, item, count(*) AS occurrences, count(DISTINCT rec) AS records FROM pairs GROUP BY ALL),
totals AS (SELECT 'minims' AS field, count(*) AS n, 0.035 AS share FROM once WHERE len(minims) > 0 UNION ALL SELECT 'abundance', count(*), 0.10 FROM node)"""


# -- 4: long spans shared between records -------------------------------------------------------------------------------------

def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal stretches of each read that lie in windows of 8 minimizers which another read has as well."""
    found = spans.shared_stretches(table(spark, sf_dir, "minspace"), "read_id", "minims", "pos", k=8)
    return found.select(F.col("id").alias("read_id"), "start_pos", "end_pos")


def p4_shared_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each read with a shared stretch: its elements, those shared, and their share."""
    found = spans.shared_stretches(table(spark, sf_dir, "minspace"), "read_id", "minims", "pos", k=8)
    total = found.groupBy(F.col("id").alias("read_id"), "n_elements").agg(F.sum(F.col("i1") - F.col("i0")).alias("n_shared"))
    return total.withColumn("share", F.col("n_shared") / F.col("n_elements"))


def p4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages: chains of shared windows of the reads whose arrival_no is divisible by 50, aligned against all other reads."""
    return spans.fuzzy_passages(table(spark, sf_dir, "minspace"), "read_id", "minims", F.col("arrival_no") % 50 == 0, k=8, min_matched=12)


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of reads of each class of equal lists, under the smallest id of the class."""
    members = spans.copies(table(spark, sf_dir, "minspace"), "read_id", "minims")
    return members.groupBy("of").agg(F.min("id").alias("read_id"), F.count("*").alias("n_reads")).select("read_id", "n_reads")


_P4 = f"""WITH {READ_ONCE},
w AS (SELECT read_id, i, minims[i:i+7] AS x FROM (SELECT *, unnest(range(1, len(minims) - 6)) AS i FROM once WHERE len(minims) >= 8)),
c AS (SELECT read_id, i, least(x, list_reverse(x)) AS x FROM w),
s AS (SELECT x FROM c GROUP BY x HAVING count(DISTINCT read_id) > 1),
e AS (SELECT DISTINCT read_id, i + o AS i FROM c SEMI JOIN s USING (x), range(8) t(o)),
g AS (SELECT read_id, i, i - row_number() OVER (PARTITION BY read_id ORDER BY i) AS run FROM e),
stretch AS (SELECT read_id, min(i) AS a, max(i) AS z FROM g GROUP BY read_id, run)"""


# -- 5: most frequent items ---------------------------------------------------------------------------------------------------

def heavy_items(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    parts = [
        heavy.top_items(table(spark, sf_dir, name), col, k).withColumn("field", F.lit(col))
        for name, col in (("minspace", "minims"), ("nodes", "abundance"))
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most frequent items of either field."""
    return heavy_items(spark, sf_dir).select("field", "item")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most frequent items of either field with their verified counts."""
    return heavy_items(spark, sf_dir).select("field", "item", "n")


_P5 = """WITH occ AS (SELECT 'minims' AS field, unnest(minims) AS item FROM minspace UNION ALL SELECT 'abundance', abundance FROM nodes),
counts AS (SELECT field, item, count(*) AS n FROM occ WHERE item IS NOT NULL GROUP BY ALL)
SELECT {} FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, item) AS place FROM counts) WHERE place <= 10"""


# -- 6: has this key been seen before -----------------------------------------------------------------------------------------

def seen_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.arrivals(table(spark, sf_dir, "minspace"), "minims", seen.list_key("minims"), "arrival_no").unionByName(
        seen.arrivals(table(spark, sf_dir, "nodes"), "node_id", seen.id_key("node_id"), "arrival_no")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key came before."""
    return seen.decide(seen_records(spark, sf_dir)).where("repeat").select("kind", F.col("no").alias("arrival_no"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, repeats and wrong answers of each kind; the truth comes from whole lists and ids."""
    firsts = seen.exact_firsts(table(spark, sf_dir, "minspace"), "minims", "minims", "arrival_no").unionByName(
        seen.exact_firsts(table(spark, sf_dir, "nodes"), "node_id", "node_id", "arrival_no")
    )
    return seen.wrong_answers(firsts, seen.decide(seen_records(spark, sf_dir)))


_P6 = """WITH a AS (SELECT 'minims' AS kind, arrival_no, CAST(minims AS VARCHAR) AS k FROM minspace WHERE len(minims) > 0
UNION ALL SELECT 'node_id', arrival_no, CAST(node_id AS VARCHAR) FROM nodes WHERE node_id IS NOT NULL),
r AS (SELECT kind, arrival_no, row_number() OVER (PARTITION BY kind, k ORDER BY arrival_no) > 1 AS again FROM a)"""


# -- 7: encoding --------------------------------------------------------------------------------------------------------------

def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p2_blurred": p2_blurred,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p4_found": p4_found,
    "p4_shared_part": p4_shared_part,
    "p4_passages": p4_passages,
    "p4_copies": p4_copies,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_ids": p7_ids,
}

ORACLES = {
    "p2_found": P2_SQL,
    "p3_found": _P3 + """ SELECT field, item, CASE WHEN records = 1 THEN 'rare' ELSE 'common' END AS mark FROM counts JOIN totals USING (field)
WHERE records = 1 OR (records > share * n AND records >= 10)""",
    "p3_terms": _P3 + " SELECT field, item, occurrences, records FROM counts",
    "p4_found": _P4 + " SELECT read_id, pos[a] AS start_pos, pos[z] AS end_pos FROM stretch JOIN once USING (read_id)",
    "p4_shared_part": _P4 + """ SELECT read_id, CAST(len(any_value(minims)) AS INTEGER) AS n_elements, CAST(sum(z - a + 1) AS BIGINT) AS n_shared,
sum(z - a + 1) / len(any_value(minims)) AS share FROM stretch JOIN once USING (read_id) GROUP BY read_id""",
    "p4_copies": f"WITH {READ_ONCE} SELECT min(read_id) AS read_id, count(*) AS n_reads FROM once WHERE len(minims) > 0 GROUP BY minims",
    "p5_found": _P5.format("field, item"),
    "p5_counts": _P5.format("field, item, n"),
    "p6_found": _P6 + " SELECT kind, arrival_no FROM r WHERE again",
    "p6_rates": _P6 + """ SELECT kind, count(*) AS n_records, count(*) FILTER (again) AS n_repeats, CAST(0 AS BIGINT) AS n_wrong,
CAST(0 AS DOUBLE) AS wrong_rate FROM r GROUP BY kind""",
}


# -- 8: mixing sources --------------------------------------------------------------------------------------------------------

def chosen_mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, mixing.Targets]:
    targets = mixing.read_targets(table(spark, sf_dir, "mix_targets"))
    return mixing.choose(saved(mixing.memberships(table(spark, sf_dir, "documents"), targets)), targets), targets


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix uses each document (0: not at all), under the source it counts for."""
    chosen, _ = chosen_mix(spark, sf_dir)
    return chosen.select("doc_id", F.col("domain").alias("source"), "soft", "n_tokens", "rate", "repeats")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each source."""
    return mixing.shares(*chosen_mix(spark, sf_dir))


# -- 9: subject areas ---------------------------------------------------------------------------------------------------------

def subjects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"), table(spark, sf_dir, "subject_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the subjects they deal with."""
    return subjects_of(spark, sf_dir).select("doc_id", F.explode("subjects").alias("subject"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject and their share of all documents; the row `none` counts those without any."""
    found = subjects_of(spark, sf_dir).select(F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("none")))).alias("subject"))
    total = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    return found.groupBy("subject").agg(F.count("*").alias("n_documents")).withColumn("share", F.col("n_documents") / total)


QUERIES |= {"p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_composition": p9_composition}
