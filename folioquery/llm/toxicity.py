"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled text (U) train a linear classifier.
With the share of toxic documents pi, the risk pi * R_P(+) + max(0, R_U(-) - pi *
R_P(-)) is estimated without any document confirmed to be clean: what toxic
documents in U add to R_U(-) is taken off again, and where that correction goes
below zero, which only overfitting can bring about, the step turns around.

P are documents that the labels call toxic. U are documents of the labels too,
drawn whatever their label, which isn't read: so U has the class prior of the
labels, and all rows that the classifier is fitted on are labelled ones.

Features are words and their first four to six bytes, so that a stem counts in
whatever ending it comes, each present at least once, twice or four times. They
are picked on the sample by how much more often they occur in P than in U.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.llm.common import arrow_rows, durable, fresh, prefix_hashes, range_hashes, release_memory, slices, table, utf8_bytes

#: Labelled documents of the samples that the classifier is fitted on, at most about so many.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 6000
MOST_FEATURES = 4096
PREFIXES = (4, 5, 6)
LEAST_COUNT = 3
#: A feature is present at level k in a text that has it at least so many times.
LEVELS = (1, 2, 4)
#: Least log-likelihood ratio (chi-squared) and least ratio of shares of a feature in P and U.
LEAST_G, LEAST_LIFT = 24.0, 2.5
STEPS, RATE, DECAY = 400, 0.1, 1e-3
THRESHOLD = 0.3
#: The fold of crc32(doc_id as text) that is held out: its labels aren't read.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is held out; false for a null id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """30-bit feature hashes of each text's words and prefixes, with the row of each; they may repeat.

    Words are runs of letters, lower-cased; bytes beyond ASCII count as letters.
    """
    data, offsets = utf8_bytes(pc.utf8_lower(column))
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (~np.concatenate([[False], letter[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(letter & (~np.concatenate([letter[1:], [False]]) | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    prefix = prefix_hashes(data)
    out, of = [range_hashes(prefix, starts, ends)], [rows]
    for n in PREFIXES:
        long = ends - starts > n
        out.append(range_hashes(prefix, starts[long], starts[long] + n) + np.uint64(n))
        of.append(rows[long])
    return (np.concatenate(out) >> np.uint64(34)).astype(np.uint32), np.concatenate(of)


def leveled(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with their levels (four times the hash, plus the level) and rows, each pair once, sorted by row."""
    both, counts = np.unique((rows.astype(np.uint64) << np.uint64(32)) | (hashes.astype(np.uint64) << np.uint64(2)), return_counts=True)
    both = np.concatenate([both[counts >= least] + np.uint64(k) for k, least in enumerate(LEVELS)])
    both.sort()
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)


@dataclass
class Model:
    """A linear classifier: sorted feature hashes, their weights, the bias."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of toxic for each text."""
        margin = np.full(len(column), self.bias)
        if len(self.keys) and len(column):
            hashes, rows = features(column)
            bases = np.unique(self.keys >> np.uint32(2))
            marked = np.zeros(1 << 16, bool)
            marked[bases >> np.uint32(14)] = True
            some = np.flatnonzero(marked[hashes >> np.uint32(14)])
            some = some[np.isin(hashes[some], bases)]
            keys, rows = leveled(hashes[some], rows[some])
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[place] == keys
            margin += np.bincount(rows[hit], weights=self.weights[place[hit]], minlength=len(column))
        return sigmoid(margin)


def selected(counts: DataFrame, n_p: int, n_u: int, most: int = MOST_FEATURES) -> np.ndarray:
    """Sorted features that stand out in P, from their documents (key, p, u) in P and U: those whose shares differ beyond chance and by a factor."""
    p, u = F.least(F.col("p") / n_p, F.lit(1 - 1e-9)), (F.col("u") + 1) / (n_u + 2)
    g = 2.0 * n_p * (F.col("sp") * F.ln(F.col("sp") / F.col("su")) + (1 - F.col("sp")) * F.ln((1 - F.col("sp")) / (1 - F.col("su"))))
    shares = counts.where(F.col("p") >= LEAST_COUNT).select("key", p.alias("sp"), u.alias("su")).withColumn("g", g)
    best = shares.where((F.col("g") >= LEAST_G) & (F.col("sp") >= LEAST_LIFT * F.col("su"))).orderBy(F.desc("g"), "key").limit(most)
    return np.sort(best.select("key").toArrow().column(0).to_numpy().astype(np.uint32))


@dataclass
class Sample:
    """Which of the features each document has: pairs (document, feature) of P and of U, and the numbers of documents and features."""

    p_row: np.ndarray
    p_key: np.ndarray
    u_row: np.ndarray
    u_key: np.ndarray
    n_p: int
    n_u: int
    n_keys: int


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def risk(weights: np.ndarray, sample: Sample, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk of toxic documents and the corrected risk of clean ones, with their gradients; the last weight is the bias.

    The loss is logistic. The first is prior * R_P(+), the second R_U(-) - prior * R_P(-).
    """
    k = sample.n_keys
    z_p = weights[k] + np.bincount(sample.p_row, weights=weights[sample.p_key], minlength=sample.n_p)
    z_u = weights[k] + np.bincount(sample.u_row, weights=weights[sample.u_key], minlength=sample.n_u)
    s_p, s_u = sigmoid(z_p), sigmoid(z_u)

    def gradient(pull: np.ndarray, row: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(key, weights=pull[row], minlength=k), pull.sum())

    toxic = prior * float(np.logaddexp(0, -z_p).mean())
    clean = float(np.logaddexp(0, z_u).mean()) - prior * float(np.logaddexp(0, z_p).mean())
    of_toxic = prior * gradient((s_p - 1) / sample.n_p, sample.p_row, sample.p_key)
    of_clean = gradient(s_u / sample.n_u, sample.u_row, sample.u_key) - prior * gradient(s_p / sample.n_p, sample.p_row, sample.p_key)
    return toxic, clean, of_toxic, of_clean


def fit(keys: np.ndarray, sample: Sample, prior: float) -> Model:
    """Train with the class prior; where the corrected risk is below zero, the step goes back up its gradient."""
    prior, k = min(max(prior, 1e-4), 0.9), sample.n_keys
    # U holds prior * P and more: no set of documents is rarer in U than prior times its share of P
    if len(sample.p_row):
        prior = min(prior, (len(np.unique(sample.u_row)) + 1) / sample.n_u / (len(np.unique(sample.p_row)) / sample.n_p))
    weights, moments, squares = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    weights[k] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        _, clean, of_toxic, of_clean = risk(weights, sample, prior)
        g = of_toxic + of_clean if clean >= 0 else -of_clean
        g[:k] += DECAY * prior * weights[:k]
        moments = 0.9 * moments + 0.1 * g
        squares = 0.999 * squares + 0.001 * g * g
        weights -= RATE * (moments / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.999**step)) + 1e-8)
    return Model(keys, weights[:k].copy(), float(weights[k]))


def _with_features(docs: DataFrame) -> DataFrame:
    """(positive, hashes) of each document of a sample: its features with levels, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, rows = leveled(*features(batch.column(1)))
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            raw = keys.astype("<u4")
            packed = [raw[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["positive", "hashes"])

    return arrow_rows(docs).mapInArrow(run, "positive boolean, hashes binary")


def _counted(sample: DataFrame) -> DataFrame:
    """(key, p, u): documents of P and of U with each feature; summed by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = np.array(batch.column(0).to_pylist(), bool)
            found = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
            both, n = np.unique(np.concatenate([f.astype(np.int64) * 2 + m for f, m in zip(found, marks, strict=True)]), return_counts=True)
            positive = (both & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(np.where(positive, n, 0)), pa.array(np.where(positive, 0, n))], names=["key", "p", "u"])

    return arrow_rows(sample).mapInArrow(run, "key long, p long, u long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _placed(sample: DataFrame, keys: np.ndarray) -> Sample:
    """The selected features of each sampled document, on the driver: at most len(keys) small numbers a document, however long its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = []
            for x in batch.column(1).to_pylist():
                found = np.frombuffer(x, "<u4")
                place = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
                packed.append(place[keys[place] == found].astype("<u2").tobytes() if len(keys) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["positive", "places"])

    rows = arrow_rows(sample).mapInArrow(run, "positive boolean, places binary").toArrow()
    marks, places = rows.column(0).to_pylist(), [np.frombuffer(x, "<u2") for x in rows.column(1).to_pylist()]
    del rows

    def of(mark: bool) -> tuple[np.ndarray, np.ndarray, int]:
        mine = [p for p, m in zip(places, marks, strict=True) if m is mark]
        flat = np.concatenate(mine) if mine else np.zeros(0, "<u2")
        return np.repeat(np.arange(len(mine)), [len(p) for p in mine]), flat.astype(np.int64), len(mine)

    (p_row, p_key, n_p), (u_row, u_key, n_u) = of(True), of(False)
    return Sample(p_row, p_key, u_row, u_key, n_p, n_u, len(keys))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, prior: float | None = None) -> Model:
    """Fit on a sample of the labelled documents that aren't held out: about ``most_positive`` toxic ones, and ``most_unlabelled`` whatever their label.

    Both samples are drawn by a hash of the id, so they don't depend on the
    order of rows. The prior is the share of toxic rows among the labels that
    may be read, unless it is given. Null labels and ids aren't read, several
    labels of one id count as their largest. Without confirmed examples nothing
    is toxic. The sample's ids are the only thing broadcast, and what reaches the
    driver are its documents' places in the list of features.
    """
    if most_positive + most_unlabelled > 1 << 20:
        raise ValueError("the sample is fitted on the driver: at most 2**20 documents")
    readable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = readable.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not counts["p"]:
        return Model()

    def drawn(share: float) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))

    positive = (F.col("toxic") == 1) & drawn(min(1.0, most_positive / counts["p"]))
    unlabelled = drawn(min(1.0, most_unlabelled / counts["n"]))
    # a document drawn for both samples gives a row to each
    roles = F.filter(F.array(F.when(positive, F.lit(True)), F.when(unlabelled, F.lit(False))), lambda x: x.isNotNull())
    picked = readable.select("doc_id", roles.alias("roles")).where(F.size("roles") > 0)
    open_docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = durable(_with_features(open_docs.join(F.broadcast(picked), "doc_id").select(F.explode("roles").alias("positive"), "text")))
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return Model()
    keys = selected(_counted(sample), sizes[True], sizes[False])
    model = fit(keys, _placed(sample, keys), prior if prior is not None else counts["p"] / counts["n"])
    release_memory()
    return model


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with a score column (which must be a new name) for the whole text; null texts are empty."""
    if score_col in docs.columns:
        raise ValueError(f"there is a column {score_col} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = pa.array(model.scores(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score_col])

    return arrow_rows(docs).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their columns as they are."""
    model = train(docs, labels)
    (score,) = fresh(docs.columns, "_toxicity")
    return with_scores(docs, model, score_col=score).where(F.col(score) < threshold).drop(score)


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
