"""Encoding of a text column with a byte-level BPE of a public tokenizer, by merges over the distinct words of the corpus.

1. Documents are put into blocks of some megabytes by a hash of id and text; texts are shuffled once for both of their uses.
2. Each block is cut into words and offers each distinct word once.  These pairs are sorted by word, so every distinct word of the corpus is
   merged once, in one task, together with the others of its range of hashes (see `bpe`).  A word has at most one pair a
   block, so no word makes a hot key.
3. Blocks get their words' tokens back and put their documents together.

Null and empty texts give an empty list and are not shuffled.  Rows that agree in id and text share a block, so ids should be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import bpe
from strandloom.session import tasks

#: Vocabulary file, at the same place on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pairs (word, block) that one replay takes; bounds memory, not the result.
REPLAY_ROWS = 1 << 17
BLOCK, TEXT = "__block", "__text"


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; nulls count as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block -> block, word: each distinct word of each block once."""
    now, seen = None, set()
    for batch in batches:
        block = batch[BLOCK].to_numpy()
        edge = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.empty(0, dtype=np.int64)
        for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(block)]):
            if block[a] != now:
                now, seen = block[a], set()
            data, at = utf8(batch[TEXT].slice(a, z - a))
            for i, j in bpe.blocks(at):
                words = [w for w in bpe.cut(data[at[i] : at[j]], at[i : j + 1] - at[i], bpe.classes())[1].distinct() if w not in seen]
                seen.update(words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), now)), pa.array(words, pa.binary())], names=[BLOCK, "word"])


def _merged(vocabulary: str):
    """Arrow kernel: (block, word) by word -> block, word and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, list[int]] = (None, [])
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal last
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            word = rows["word"].to_pylist()
            first = [i for i, w in enumerate(word) if i == 0 or w != word[i - 1]]
            known = word[0] == last[0]  # a word whose pairs go on from the rows before
            ids = [last[1]] * known + bpe.merges(vocabulary).replay([word[i] for i in first[known:]])
            last = word[-1], ids[-1]
            of = np.repeat(np.arange(len(first)), np.diff([*first, len(word)]))
            return pa.RecordBatch.from_arrays([rows[BLOCK].combine_chunks(), rows["word"].combine_chunks(), pa.array(ids, pa.list_(pa.int32())).take(pa.array(of))], names=[BLOCK, "word", "ids"])

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= REPLAY_ROWS:
                yield flush()
        if held:
            yield flush()

    return run


def _put_together(keep: list[str], counts_only: bool):
    """Cogroup kernel: documents of a block, and its words with their ids -> documents with ids, or with their number."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        known, ids = words["word"].to_pylist(), words["ids"].combine_chunks()
        size = np.diff(ids.offsets.to_numpy()) if len(known) else np.empty(0, dtype=np.int64)
        begin, flat = np.concatenate([[0], np.cumsum(size)]), ids.flatten().to_numpy(zero_copy_only=False)
        data, at = utf8(docs[TEXT].combine_chunks())
        out = []
        for i, j in bpe.blocks(at):
            bounds = at[i : j + 1] - at[i]
            start, found = bpe.cut(data[at[i] : at[j]], bounds, bpe.classes())
            word = found.numbers(known)
            total = np.concatenate([[0], np.cumsum(size[word])])
            offsets = total[np.searchsorted(start, bounds)]
            if counts_only:
                out.append(pa.array(np.diff(offsets)))
            else:
                source = np.repeat(begin[word] - total[:-1], size[word]) + np.arange(total[-1])
                out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[source])))
        name, kind = ("n_tokens", pa.int64()) if counts_only else ("ids", pa.list_(pa.int32()))
        return pa.table([*[docs[c] for c in keep], pa.chunked_array(out, kind)], names=[*keep, name])

    return run


#: Bytes of text for each task of the shuffles, where that needs more tasks than the session's number.
TASK_BYTES = 64 << 20


def _encoded(df: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str, counts_only: bool) -> DataFrame:
    name, kind = ("n_tokens", "bigint") if counts_only else ("ids", "array<int>")
    some = df.where(F.col(text_col) != "")
    n_bytes = some.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    n_tasks = max(tasks(df.sparkSession), -(-n_bytes // TASK_BYTES))
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(max(2 * n_tasks, -(-n_bytes // bpe.BLOCK_BYTES))))
    placed = some.select(block.alias(BLOCK), F.col(text_col).alias(TEXT), *keep).repartition(n_tasks, BLOCK)
    # the whole rows go into the kernel, so that its shuffle is also that of the last step
    pairs = placed.sortWithinPartitions(BLOCK).mapInArrow(_distinct_words, f"{BLOCK} bigint, word binary")
    merged = pairs.repartition(n_tasks, "word").sortWithinPartitions("word").mapInArrow(_merged(vocabulary), f"{BLOCK} bigint, word binary, ids array<int>")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    out = placed.groupBy(BLOCK).cogroup(merged.groupBy(BLOCK)).applyInArrow(_put_together(keep, counts_only), f"{kinds}, {name} {kind}")
    empty = F.lit(0).cast("bigint") if counts_only else F.array().cast("array<int>")
    return out.unionByName(df.where(F.coalesce(F.col(text_col), F.lit("")) == "").select(*keep, empty.alias(name)))


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """id_col, ids array<int> of every row, without special tokens."""
    return _encoded(df, id_col, text_col, [id_col], vocabulary, counts_only=False)


def count_tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns `keep` and n_tokens bigint of every row; 0 for null and empty texts."""
    return _encoded(df, id_col, text_col, keep, vocabulary, counts_only=True)
