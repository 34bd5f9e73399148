"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of its byte pairs (folded to ``TERMS`` terms) and of a
few shape terms (repetition, symbols, word length).  Counts are damped,
weighted by inverse document frequency, counted over all documents, and
projected to ``RANK`` latent dimensions found by a singular value
decomposition of the labelled sample.
The sample's vectors are the model: at most ``SAMPLE`` of them, so what is
broadcast has a fixed bound.  Every document is compared with *all* of them,
in blocks, as exact cosine products, and its nearest ``NEIGHBOURS`` (and all
that are as near as the last of them, to five decimals) vote with their
similarity as weight.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import remainder

#: At most this many labelled rows are learnt from (those of smallest id hash).
SAMPLE = 4096
TERMS = 1024
RANK = 48
NEIGHBOURS = 25
#: Documents compared at a time.
BLOCK = 1024
#: A neighbour's vote weighs its cosine to this power.
SHARPNESS = 8
#: Score from which a document counts as good.
THRESHOLD = 0.3
#: Rows whose remainder is 0 are held out.
FOLDS = 5
SHAPES = 8


def terms(text: bytes) -> np.ndarray:
    """Damped term counts of one text: folded byte pairs, then shape terms."""
    out = np.zeros(TERMS + SHAPES, np.float32)
    if not text:
        return out
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    if len(b) > 1:
        out[:TERMS] = np.bincount(((b[:-1] * 256 + b[1:]) * 40503 >> 5) & (TERMS - 1), minlength=TERMS)
    words = text.split()
    n, kinds = max(len(words), 1), len(set(words))
    symbols = len(re.findall(rb"[^\w\s\x80-\xff.,]", text))
    lines = text.split(b"\n")
    scale = max(len(b), 1)
    shape = (1 - kinds / n, min(1.0, symbols / n), len(set(lines)) / len(lines), min(1.0, scale / n / 16),
             len(re.findall(rb"[0-9]", text)) / scale, len(re.findall(rb"[A-Z]", text)) / scale,
             min(1.0, len(lines) / n), 2 * sum(a == b for a, b in zip(words, words[1:])) / n)
    out[:TERMS] = np.log1p(out[:TERMS])
    norm = np.linalg.norm(out[:TERMS])
    if norm:
        out[:TERMS] /= norm
    out[TERMS:] = np.asarray(shape, np.float32)
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents hold each term, and how many there are (term -1)."""
    held, n = np.zeros(TERMS + SHAPES, np.int64), 0
    for batch in batches:
        for t in batch.column("text"):
            held += terms((t.as_py() or "").encode()) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(held)), pa.int32()),
                                      pa.array(np.concatenate([[n], held]), pa.int64())], ["term", "n"])


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term: one row per term and task, summed by Spark."""
    found = docs.select("text").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r["term"]: r["n"] for r in found.collect()}
    return n.get(-1, 0), np.array([n.get(i, 0) for i in range(TERMS + SHAPES)])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [terms((t.as_py() or "").encode()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(packed, pa.binary())],
                                         ["quality", "vector"])


class Model:
    """Term weights, latent directions and the labelled sample's vectors."""

    def __init__(self, weight: np.ndarray, basis: np.ndarray, sample: np.ndarray, label: np.ndarray):
        self.weight, self.basis, self.sample, self.label = weight, basis, sample, label
        self.prior = float(label.mean()) if len(label) else 0.5

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weight) @ self.basis
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest sample rows, weighted by similarity."""
        if not len(self.label):
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.label))
        for i in range(0, len(x), BLOCK):
            z = self.latent(x[i:i + BLOCK])
            cos = z @ self.sample.T
            cos = np.round(cos, 5)
            last = np.partition(cos, len(self.label) - k, axis=1)[:, len(self.label) - k, None]
            w = np.where(cos >= last, np.maximum(cos, 0), 0).astype(float) ** SHARPNESS
            total = w.sum(axis=1)
            vote = w @ self.label
            out[i:i + BLOCK] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows of the learning folds.

    The driver holds ``sample`` vectors of ``TERMS + SHAPES`` numbers.  Of an
    id on several rows of ``docs`` the smallest text is learnt from.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() &
                       (remainder(F.col("doc_id"), FOLDS) != 0)).select("doc_id", F.col("quality").cast("int"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = (docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
             .groupBy("doc_id").agg(F.min("text").alias("text")))
    rows = (texts.join(F.broadcast(chosen), "doc_id").select("quality", "text")
            .mapInArrow(_vectors, "quality int, vector binary").collect())
    if not rows:
        return Model(np.zeros(TERMS + SHAPES, np.float32), np.zeros((TERMS + SHAPES, 1), np.float32),
                     np.zeros((0, 1), np.float32), np.zeros(0))
    rows.sort(key=lambda r: (bytes(r["vector"]), r["quality"]))           # the order rows arrive in differs
    x = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), np.float32).reshape(len(rows), -1)
    y = np.array([r["quality"] for r in rows], float)
    n, df = frequencies(docs)
    weight = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    xw = (x * weight).astype(np.float64)
    _, vectors = np.linalg.eigh(xw.T @ xw)                                # right singular vectors
    basis = vectors[:, ::-1][:, :min(RANK, len(x), vectors.shape[1])].astype(np.float32)
    model = Model(weight, basis, np.zeros((0, 1), np.float32), y)
    model.sample = model.latent(x)
    return model


def _score_batch(model: Model, text: pa.Array) -> np.ndarray:
    out = np.empty(len(text))
    for i in range(0, len(text), BLOCK):
        x = [terms((t.as_py() or "").encode()) for t in text[i:i + BLOCK]]
        out[i:i + BLOCK] = model.scores(np.stack(x))
    return out


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Only ``text`` is looked at.  Null, empty and wordless texts have no
    direction and get the sample's share of label 1, as does every text if
    the sample is empty (then 0.5).  Equal texts get equal scores; repeated
    rows are scored each; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _score_batch(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())],
                                             ["doc_id", "score"])
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all their columns unchanged.

    Null, empty and wordless texts score the sample's share of label 1;
    repeated rows are judged each; no rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _score_batch(model, batch.column(batch.schema.get_field_index("text"))) >= threshold
            yield batch.filter(pa.array(good)) if len(good) else batch
    return docs.mapInArrow(run, docs.schema)
