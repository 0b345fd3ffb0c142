"""Subject areas of documents: a lexicon learned from labels, classifier chains, beam search.

1. A bounded sample of labelled documents (`MAX_LABELLED`, smallest hashes of their ids) yields a lexicon: terms that occur mostly
   in documents of one subject.  Terms are words of names, comments and literals, cut at case changes and stripped of a plural s.
2. Every document gets, for each subject, how many statements mention its terms, how many mentions and how many different
   terms there are, and their share, besides source and structure features.
3. A chain of logistic classifiers, fitted on the sample, takes these features and the earlier subjects of the chain, so that
   subjects that occur together support one another; each link is calibrated on held-out halves.
4. A beam search over the chain gives each document its most probable combination of subjects, possibly none.

Licence notices and programming as such occur with every subject and so carry no term.  Null, empty and blank texts have no
subject.  Repeated labels count once, `none` and unknown names are no subject; without labels nothing is found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import saved

#: Labelled documents that training uses at most.
MAX_LABELLED = 20_000
#: Labelled documents that hold a term, and share of them of one subject, from which it enters the lexicon; so the lexicon is bounded by the
#: words of MAX_LABELLED documents.
MIN_DOCS, MIN_SHARE = 4, 0.7
BEAM = 6
#: Own features of a subject, structure features.
OWN, STRUCTURE = 6, 5
#: Runs of letters, and the signs that part statements (lines, literals, tags, blocks).
PIECE = re.compile("[^\\W\\d_]+|[\n;\"'<>{}]")
BREAKS = "\n;\"'<>{}"
PART = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|[^\W\d_]+")
#: Distinct pieces a task remembers before it starts over; bounds memory, not the result.
PIECE_MEMORY = 1 << 19


def terms_of(piece: str) -> list[str]:
    """Terms of a run of letters: halves of camel case, lower case, without a plural s."""
    out = []
    for w in PART.findall(piece):
        w = w.lower()
        out.append(w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w)
    return out


def _count_terms(subjects: list[str]):
    """Arrow kernel over (text, labels): documents by (term, subject); subject -1 for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {s: i for i, s in enumerate(subjects)}
        total: Counter = Counter()
        for batch in batches:
            for text, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {t for p in set(PIECE.findall(text or "")) if p not in BREAKS for t in terms_of(p)}
                for s in [-1, *[number[x] for x in labels if x in number]]:
                    total.update((t, s) for t in found)
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())],
            names=["term", "subject", "n"],
        )

    return run


def learn_lexicon(labelled: DataFrame, subjects: list[str]) -> dict[str, int]:
    """term -> subject number, from (text, labels); its size is bounded by the sample's words."""
    counts = labelled.select("text", "labels").mapInArrow(_count_terms(subjects), "term string, subject int, n bigint").groupBy("term", "subject").agg(F.sum("n").alias("n"))
    docs = counts.where("subject = -1").select("term", F.col("n").alias("docs"))
    best = counts.where("subject >= 0").groupBy("term").agg(F.max(F.struct("n", -F.col("subject"))).alias("b"))
    kept = best.join(docs, "term").where((F.col("docs") >= MIN_DOCS) & (F.col("b.n") >= MIN_SHARE * F.col("docs")))
    return {r[0]: r[1] for r in kept.select("term", -F.col("b.col2")).collect()}


class Scanner:
    """Counts the lexicon's terms in texts."""

    def __init__(self, lexicon: dict[str, int], n_subjects: int):
        names = sorted(lexicon)
        self.number = {t: i for i, t in enumerate(names)}
        self.subject = np.array([lexicon[t] for t in names] or [0], dtype=np.int64)
        self.n_subjects = n_subjects
        self.pieces: dict[str, tuple[int, ...]] = dict.fromkeys(BREAKS, (-1,))

    def mentions(self, text: str) -> list[int]:
        """Numbers of the mentioned terms in order; -1 between statements that mention any."""
        if len(self.pieces) > PIECE_MEMORY:
            self.pieces = dict.fromkeys(BREAKS, (-1,))
        known, out = self.pieces, []
        for p in PIECE.findall(text):
            hit = known.get(p)
            if hit is None:
                hit = known[p] = tuple(self.number[t] for t in terms_of(p) if t in self.number)
            if hit:
                out.extend(hit)
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Rows of n_subjects * OWN + STRUCTURE features."""
        n, k = len(texts), self.n_subjects
        own = np.zeros((n, k, OWN))
        structure = np.zeros((n, STRUCTURE))
        for i, text in enumerate(texts):
            if not text:
                continue
            m = np.array(self.mentions(text), dtype=np.int64)
            real = m >= 0
            statement = np.cumsum(~real)[real]
            term = m[real]
            s = self.subject[term]
            hits = np.bincount(s, minlength=k)
            lines = np.bincount(np.unique(statement * k + s) % k, minlength=k)
            distinct = np.bincount(self.subject[np.unique(term)], minlength=k)
            total = max(1, int(hits.sum()))
            own[i] = np.stack([np.log1p(lines), np.log1p(hits), np.log1p(distinct), hits / total, lines >= 2, lines >= 4], axis=1)
            n_lines = 1 + int((~real).sum())
            structure[i] = [np.log1p(len(text)), np.log1p(n_lines), np.log1p(len(text) / n_lines), total / (total + n_lines), (lines > 0).sum()]
        return np.concatenate([own.reshape(n, -1), structure], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; x has a leading column of ones, which is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Chain:
    """Weights of each link, its calibration (slope, offset), and the scaling of the features."""

    weights: list[np.ndarray]
    calibration: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, features: np.ndarray, source: np.ndarray, s: int) -> np.ndarray:
        """Inputs of link s without the earlier labels: own features, the strongest other subject, structure, source."""
        k = len(self.calibration)
        own = features[:, : k * OWN].reshape(len(features), k, OWN)
        others = np.delete(own, s, axis=1).max(axis=1)[:, :4] if k > 1 else np.zeros((len(features), 4))
        x = np.concatenate([own[:, s], others, features[:, k * OWN :]], axis=1)
        x = (x - self.mean[s]) / self.scale[s]
        return np.concatenate([np.ones((len(x), 1)), x, source], axis=1)

    def decode(self, features: np.ndarray, source: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Most probable label rows, by beam search along the chain."""
        n, k = len(features), len(self.calibration)
        labels = np.zeros((n, 1, 0))
        score = np.zeros((n, 1))
        for s in range(k):
            w = self.weights[s]
            x = self.inputs(features, source, s)
            z = (x @ w[: x.shape[1]])[:, None] + labels @ w[x.shape[1] :]
            a, b = self.calibration[s]
            p = np.clip(sigmoid(a * z + b), 1e-9, 1 - 1e-9)
            score = np.concatenate([score + np.log(1 - p), score + np.log(p)], axis=1)
            zero, one = np.zeros((*labels.shape[:2], 1)), np.ones((*labels.shape[:2], 1))
            labels = np.concatenate([np.concatenate([labels, zero], axis=2), np.concatenate([labels, one], axis=2)], axis=1)
            if score.shape[1] > beam:
                top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                score = np.take_along_axis(score, top, axis=1)
                labels = np.take_along_axis(labels, top[:, :, None], axis=1)
        return labels[np.arange(n), score.argmax(axis=1)].astype(bool)


def fit_chain(features: np.ndarray, source: np.ndarray, y: np.ndarray) -> Chain:
    """Fits and calibrates the chain; y holds one column of 0/1 for each subject, in chain order."""
    n, k = y.shape
    raw = Chain([], np.zeros((k, 2)), np.zeros(k), np.ones(k))
    plain = [raw.inputs(features, np.zeros((n, 0)), s)[:, 1:] for s in range(k)]
    mean = np.array([x.mean(axis=0) for x in plain])
    scale = np.array([x.std(axis=0) + 1e-3 for x in plain])
    shape = Chain([], np.zeros((k, 2)), mean, scale)
    weights, calibration = [], []
    half = np.arange(n) % 2 == 0
    for s in range(k):
        x = np.concatenate([shape.inputs(features, source, s), y[:, :s]], axis=1)
        held = np.zeros(n)
        for part in (half, ~half):
            if part.any() and (~part).any():
                held[~part] = x[~part] @ fit_logistic(x[part], y[part, s])
        b, a = fit_logistic(np.stack([np.ones(n), held], axis=1), y[:, s])
        calibration.append((a, b) if a > 0 else (1.0, 0.0))
        weights.append(fit_logistic(x, y[:, s]))
    return Chain(weights, np.array(calibration), mean, scale)


def one_hot(values: list[str | None], names: list[str]) -> np.ndarray:
    """One column for each of `names`, in any case and with outer blanks; other values and nulls give zeros."""
    at = {x: i for i, x in enumerate(names)}
    out = np.zeros((len(values), len(names)))
    for i, v in enumerate(values):
        j = at.get(v.strip().lower()) if v else None
        if j is not None:
            out[i, j] = 1
    return out


def frequent(values: list[str | None], least: int = MIN_DOCS) -> list[str]:
    """Values, in lower case and without outer blanks, that occur at least so often."""
    n = Counter(v.strip().lower() for v in values if v and v.strip())
    return sorted(v for v, c in n.items() if c >= least)


def classify(documents: DataFrame, subjects: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, subjects array<string> of every document, an empty list where it has none.

    documents(doc_id, text, source, ...), subjects(subject, ...) (a fixed list), labels(doc_id, subject).  Sources that the labelled
    sample names at least MIN_DOCS times are features.
    """
    names = sorted(r[0] for r in subjects.select("subject").where(F.col("subject").isNotNull()).distinct().collect())
    own = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # bounded by max_labelled rows
    labelled = saved(documents.select("doc_id", "text", "source").join(F.broadcast(sample), "doc_id"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    lexicon = learn_lexicon(labelled, names)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon, len(names))
        for batch in batches:
            x = scanner.features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2), batch.column(3)], names=["doc_id", "x", "source", "labels"])

    fitted = labelled.select("doc_id", "text", "source", "labels").mapInArrow(measure, f"doc_id {kind}, x array<double>, source string, labels array<string>")
    rows = fitted.toArrow().sort_by("doc_id")  # at most max_labelled rows
    chain, sources = None, frequent(rows["source"].to_pylist())
    if rows.num_rows and lexicon:
        x = np.stack(rows["x"].to_numpy())
        y = np.array([[s in set(got) for s in names] for got in rows["labels"].to_pylist()], dtype=float)
        chain = fit_chain(x, one_hot(rows["source"].to_pylist(), sources), y)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon, len(names))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if chain is None:
                found = [[] for _ in texts]
            else:
                y = chain.decode(scanner.features(texts), one_hot(batch.column(2).to_pylist(), sources))
                found = [[names[s] for s in np.flatnonzero(r)] if t and t.strip() else [] for t, r in zip(texts, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "subjects"])

    return documents.select("doc_id", "text", "source").mapInArrow(decide, f"doc_id {kind}, subjects array<string>")
