"""File formats of sequence graphs and reads: readers and writers as DataFrame operations.

Readers accept what Spark's text source accepts (files, folders, globs; gzip by suffix).  Malformed lines of a format are left out.
LZ4 frames are decoded in tasks, as Spark's own codec reads another framing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom import session
from strandloom.functions.dna import fold, reverse_complement, shown

#: Bytes that a decoder takes at a time.
PIECE = 1 << 20


def looks_like_fasta(name: str) -> bool:
    """FASTA by file name, with or without a compression suffix; any other name is FASTQ."""
    for packed in (".gz", ".lz4"):
        name = name.removesuffix(packed)
    return name.endswith((".fa", ".fasta")) or ".fa." in name or ".fasta." in name


def compression(name: str) -> str:
    """gzip, lz4 or none, by suffix."""
    return {"gz": "gzip", "lz4": "lz4"}.get(name.rsplit(".", 1)[-1], "none")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """read_id (first word of the header), seq (line breaks removed).  Records are split at line starts with `>`; as the separator
    is part of the split, one file may be read by many tasks."""
    if compression(path) == "lz4":
        lines = lz4_lines(spark, path).withColumn("head", F.col("line").startswith(">"))
        # a record is what follows a header in its file; one task has each file already
        lines = lines.withColumn("r", F.sum(F.col("head").cast("int")).over(Window.partitionBy("file").orderBy("n"))).where("r > 0")
        parts = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("n", "line"))))
        records = lines.groupBy("file", "r").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("h"), F.array_join(F.transform(parts, lambda x: x["line"]), "").alias("seq"))
        return records.select(F.split(F.expr("substring(h, 2)"), r"\s").getItem(0).alias("read_id"), "seq").where("read_id <> ''")
    raw = spark.read.option("lineSep", "\n>").text(path)
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>|\r", "")
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"[\r\n]", "")).otherwise("")
    return raw.select(F.split(head, r"\s").getItem(0).alias("read_id"), body.alias("seq")).where("read_id <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 0), line: the lines of text files by number; one file may be read by many tasks.

    Rows of one task keep the order of their block of a file, so a line's number is its place there plus the lines of the blocks before.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    blocks = read.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return read.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("n"), "line")


def lz4_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 0), line of text files in LZ4 frames, decoded piece by piece in the task that has the file; frames cannot be split, so
    give several files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            system, where = fs.FileSystem.from_uri(name)
            n, rest = 0, b""
            with system.open_input_stream(where, compression=None) as raw, pa.CompressedInputStream(raw, "lz4") as text:
                while True:
                    block = text.read(PIECE)
                    *lines, rest = (rest + block).split(b"\n")
                    if not block and rest:
                        lines, rest = [*lines, rest], b""
                    if lines:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(lines)), pa.array(range(n, n + len(lines)), pa.int64()), pa.array([x.decode("utf-8", "replace").removesuffix("\r") for x in lines], pa.string())],
                            names=["file", "n", "line"],
                        )
                        n += len(lines)
                    if not block:
                        break

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(session.tasks(spark)).mapInArrow(run, "file string, n bigint, line string")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line of text files, plain, gzip or LZ4 by suffix."""
    return lz4_lines(spark, path) if compression(path) == "lz4" else numbered_lines(spark, path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq of 4-line records.

    A record cannot be told from a line alone, as a quality line may begin like a header; so lines are grouped by their numbers.
    """
    lines = text_lines(spark, path)
    records = lines.groupBy("file", F.floor(F.col("n") / 4).alias("r")).agg(
        F.max(F.when(F.col("n") % 4 == 0, F.col("line"))).alias("head"), F.max(F.when(F.col("n") % 4 == 1, F.col("line"))).alias("seq")
    )
    return records.where(F.col("head").startswith("@") & F.col("seq").isNotNull()).select(F.split(F.expr("substring(head, 2)"), r"\s").getItem(0).alias("read_id"), "seq")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ by file name."""
    return read_fasta(spark, path) if looks_like_fasta(path.rsplit("/", 1)[-1]) else read_fastq(spark, path)


def _fields(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.get("f", F.lit(0)) == kind)


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def _tag(name: str, kind: str) -> Column:
    return F.regexp_extract(F.array_join("f", "\t"), f"(?:^|\t){name}:{kind}:([^\t]*)", 1)


def read_gfa_segments(spark: SparkSession, path: str) -> DataFrame:
    """name, seq (null for `*`), length, count, mean of S lines."""
    rows = _fields(spark, path, "S")
    return rows.select(
        _field(1).alias("name"), F.nullif(_field(2), F.lit("*")).alias("seq"), _tag("LN", "i").try_cast("bigint").alias("length"),
        _tag("KC", "i").try_cast("bigint").alias("count"), _tag("mc", "f").try_cast("double").alias("mean"),
    )


def read_gfa_links(spark: SparkSession, path: str) -> DataFrame:
    """n1, o1, n2, o2 (names), overlap of L lines."""
    return _fields(spark, path, "L").select(
        _field(1).alias("n1"), _field(2).alias("o1"), _field(3).alias("n2"), _field(4).alias("o2"), F.regexp_extract(_field(5), r"^(\d+)M", 1).try_cast("bigint").alias("overlap")
    )


def read_gfa_paths(spark: SparkSession, path: str) -> DataFrame:
    """unitig, offset, o, node_id of A lines (unitig, offset, orientation, node)."""
    return _fields(spark, path, "A").select(_field(1).alias("unitig"), _field(2).try_cast("bigint").alias("offset"), _field(3).alias("o"), _field(4).try_cast("bigint").alias("node_id"))


def gfa_lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """value, section: header, S lines (no bases) and L lines; sort by section to write them in order."""
    t = lambda *c: F.concat_ws("\t", *c)
    head = nodes.sparkSession.range(1).select(F.lit("H\tVN:Z:1.0").alias("value"), F.lit(0).alias("section"))
    s = nodes.select(t(F.lit("S"), F.col("node_id").cast("string"), F.lit("*"), F.concat(F.lit("LN:i:"), "seqlen"), F.concat(F.lit("KC:i:"), "abundance")).alias("value"), F.lit(1).alias("section"))
    link = links.select(t(F.lit("L"), F.col("n1").cast("string"), "o1", F.col("n2").cast("string"), "o2", F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"), F.lit(2).alias("section"))
    return head.union(s).union(link)


def complete_gfa_lines(contigs: DataFrame, links: DataFrame) -> DataFrame:
    """value, section with bases, true lengths and mean abundances: contigs (name, seq, mean_abundance), links (n1, o1, n2, o2, overlap)."""
    s = contigs.select(F.format_string("S\t%s\t%s\tLN:i:%d\tmc:f:%.1f", "name", "seq", F.length("seq"), "mean_abundance").alias("value"), F.lit(1).alias("section"))
    return s.union(links.select(F.format_string("L\t%s\t%s\t%s\t%s\t%dM", "n1", "o1", "n2", "o2", "overlap").alias("value"), F.lit(2).alias("section")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files in the order of sections, range-partitioned so that no task gets them all."""
    lines.repartitionByRange("section", "value").sortWithinPartitions("section", "value").select("value").write.mode("overwrite").text(path)


def stripped(segments: DataFrame) -> DataFrame:
    """Segments without their bases."""
    return segments.withColumn("seq", F.lit("*"))


def fasta_lines(contigs: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """value: one folded record a row."""
    return contigs.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), fold(F.col(seq))).alias("value"))


def sequence_lines(nodes: DataFrame) -> DataFrame:
    """value: node id, list, bases, two unused fields and the shifts of (node_id, kmer, seq, shift_l, shift_r)."""
    shifts = F.concat(F.lit("("), F.col("shift_l").cast("string"), F.lit(", "), F.col("shift_r").cast("string"), F.lit(")"))
    return nodes.select(F.concat_ws("\t", F.col("node_id").cast("string"), shown(F.col("kmer")), "seq", F.lit("*"), F.lit("*"), shifts).alias("value"))


def read_sequence_lines(spark: SparkSession, path: str) -> DataFrame:
    """node_id, kmer, seq, shift_l, shift_r; lines that begin with # are comments."""
    lines = lz4_lines(spark, path).select("line") if compression(path) == "lz4" else spark.read.text(path).select(F.col("value").alias("line"))
    rows = lines.where(~F.col("line").startswith("#")).select(F.split("line", "\t").alias("f"))
    shift = lambda i: F.regexp_extract(_field(5), r"\((\d+), *(\d+)\)", i).try_cast("int")
    return rows.select(
        _field(0).try_cast("bigint").alias("node_id"), F.from_json(_field(1), "array<bigint>").alias("kmer"), _field(2).alias("seq"), shift(1).alias("shift_l"), shift(2).alias("shift_r")
    ).where("node_id IS NOT NULL")


def read_lmer_counts(spark: SparkSession, path: str) -> DataFrame:
    """lmer (smaller of both strands), count; of repeated l-mers the line of the highest number stands."""
    rows = numbered_lines(spark, path).select("n", F.split(F.trim("line"), r"\s+").alias("f")).select(F.col("n").alias("at"), _field(0).alias("l"), _field(1).try_cast("bigint").alias("n"))
    last = rows.where("n IS NOT NULL").groupBy(F.least("l", reverse_complement("l")).alias("lmer")).agg(F.max(F.struct("at", "n")).alias("x"))
    return last.select("lmer", F.col("x.n").alias("count"))


def read_lmer_list(spark: SparkSession, path: str, l: int) -> DataFrame:
    """lmer: the first l letters of each line that has as many, each once."""
    return spark.read.text(path).select(F.trim("value").alias("v")).where(F.length("v") >= l).select(F.col("v").substr(1, l).alias("lmer")).distinct()


def read_minspace_text(spark: SparkSession, path: str) -> DataFrame:
    """read_id, minims of lines `id m1 m2 ...`; lines with a colon or the word Parsing are messages."""
    rows = spark.read.text(path).where(~F.col("value").contains(":") & ~F.col("value").contains("Parsing")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    return rows.where(_field(0) != "").select(_field(0).alias("read_id"), F.expr("transform(slice(f, 2, size(f)), x -> CAST(x AS bigint))").alias("minims"))


def read_stats_lines(stats: DataFrame) -> DataFrame:
    """value: `id: c1 c2 ...`."""
    return stats.select(F.concat(F.col("read_id"), F.lit(": "), F.array_join(F.col("counts").cast("array<string>"), " ")).alias("value"))


def corrected_lines(reads: DataFrame) -> DataFrame:
    """value: five lines a record of (read_id, seq, minims, pos): id, bases, hashes, an unused line, positions."""
    return reads.select(F.concat_ws("\n", "read_id", "seq", shown(F.col("minims")), F.lit("[]"), shown(F.col("pos"))).alias("value"))


def read_corrected(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq, minims, pos of 5-line records, grouped by the lines' numbers."""
    lines = numbered_lines(spark, path)
    line = lambda i: F.max(F.when(F.col("n") % 5 == i, F.col("line")))
    rows = lines.groupBy("file", F.floor(F.col("n") / 5).alias("r")).agg(line(0).alias("read_id"), line(1).alias("seq"), line(2).alias("m"), line(4).alias("p"))
    return rows.where("p IS NOT NULL").select("read_id", "seq", F.from_json("m", "array<bigint>").alias("minims"), F.from_json("p", "array<int>").alias("pos"))


def recruit_lines(recruits: DataFrame) -> DataFrame:
    """value: template and its recruits (template, recruits array<string>), separated by tabs."""
    return recruits.select(F.concat_ws("\t", "template", F.array_join("recruits", "\t")).alias("value"))


def read_recruits(spark: SparkSession, path: str) -> DataFrame:
    """template, recruit; one row for each recruit."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(_field(0) != "")
    return rows.select(_field(0).alias("template"), F.explode(F.expr("slice(f, 2, size(f))")).alias("recruit")).where("recruit <> ''")


def subgraph_of(segments: DataFrame, paths: DataFrame, links: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments (name), path lines (unitig) and links (n1, n2) of the segments in `names` (name); a link needs both of its ends."""
    key = lambda c: names.select(F.col("name").alias(c)).distinct()
    both = links.join(key("n1"), "n1", "left_semi").join(key("n2"), "n2", "left_semi").select(*links.columns)
    return segments.join(key("name"), "name", "left_semi"), paths.join(key("unitig"), "unitig", "left_semi"), both


def read_n50_logs(spark: SparkSession, path: str) -> DataFrame:
    """cvg, k, l, d, n50 of logs: each N50 with the parameters in the file name of the `assembly:` line before it.

    The name's numbers are k, l, 0, d; after a coverage (1, or 0 and its decimals) if there are five or six of them.
    """
    lines = text_lines(spark, path).withColumn("x", F.regexp_extract_all(F.regexp_replace("line", r"\.n50\s*$", ""), F.lit("[0-9]+"), F.lit(0)))
    size = F.size("x")
    at = lambda i: F.get("x", size + F.lit(i))
    cvg = F.when(size == 6, F.concat(F.lit("0."), F.get("x", F.lit(1)))).when(size == 5, F.get("x", F.lit(0)))
    named = F.struct(cvg.cast("double").alias("cvg"), at(-4).cast("int").alias("k"), at(-3).cast("int").alias("l"), F.concat(F.lit("0."), at(-1)).cast("double").alias("d"))
    known = F.when(F.col("line").contains("assembly:") & size.between(4, 6), named)
    rows = lines.withColumn("p", F.last(known, ignorenulls=True).over(Window.partitionBy("file").orderBy("n")))
    return rows.where(F.col("line").contains("N50:")).select("p.*", F.substring_index("line", ":", -1).try_cast("bigint").alias("n50"))


def truth_interval(name: Column) -> tuple[Column, Column]:
    """Start and end that simulated reads carry as the third and fourth part of their name."""
    parts = F.split(name, "_")
    return F.get(parts, F.lit(2)).try_cast("bigint"), F.get(parts, F.lit(3)).try_cast("bigint")
