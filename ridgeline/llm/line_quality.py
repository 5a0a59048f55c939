"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets features of its own bytes and of the lines before and after it; the field labels each
line good or bad, with weights for the features and for the change between neighbouring labels.  A
document's quality is the mean of its lines' marginal probabilities of being good, weighted by their
length, calibrated to the labelled documents by a logistic curve.

The model is a few dozen numbers.  It is fitted on the driver on the features (not the texts) of a
bounded sample of labelled documents, ``SAMPLE_DOCS`` of them and at most ``SAMPLE_LINES`` lines, of one
document no more than its share of them (the first ``SAMPLE_LINES / SHARES``), so that none uses up the sample;
scoring runs over whole texts, in Arrow batches, without a shuffle.

Defined results: a null or empty text is one empty line; null ids and repeated rows are scored each on
its own; without usable labels of both kinds every score is 0.5 exactly; an empty table gives no rows;
other columns are not read by the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import Batches, stored

#: Bounds of the training sample (documented parameters of ``train``).
SAMPLE_DOCS = 6000
SAMPLE_LINES = 60_000
SHARES = 100
THRESHOLD = 0.7

LOWER, CAPITAL, DIGIT, SPACE, STOP, MARK, HIGH, NEWLINE = range(8)


def _classes() -> np.ndarray:
    """Byte classes: letters, digits, white space, sentence marks, other marks, bytes of other scripts."""
    kind = np.full(256, MARK, np.uint8)
    kind[ord("a") : ord("z") + 1] = LOWER
    kind[ord("A") : ord("Z") + 1] = CAPITAL
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[9, 11, 12, 13, 32]] = SPACE
    for c in ".,;:!?'\"-()":
        kind[ord(c)] = STOP
    kind[128:] = HIGH
    kind[10] = NEWLINE
    return kind


CLASSES = _classes()
OWN = 18
FEATURES = 1 + 3 * OWN


@dataclass(frozen=True)
class Model:
    """Weights of the features and of equal neighbouring labels, feature scaling, and the calibration."""

    weights: np.ndarray
    stay: np.ndarray  # potentials of (previous label, label)
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    usable: bool = field(default=True)


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, each closed by a newline, and where each text starts."""
    raw = [(x or "").encode() for x in column.to_pylist()]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    return joined, np.concatenate([[0], np.cumsum(sizes)])


def line_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths, first line of each text and the end) of newline-closed texts.

    A line has its own OWN features, those of the line before, and those of the line after; a missing
    neighbour has zeros.
    """
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    first = np.searchsorted(begins, starts)
    kind = CLASSES[data]
    length = (ends - begins).astype(np.float64)
    counts = np.stack([np.add.reduceat((kind == k).astype(np.int32), begins) for k in range(7)], axis=1).astype(np.float64)
    blank = (kind == SPACE) | (kind == NEWLINE)
    before = np.concatenate([[True], blank[:-1]])
    word = ~blank & before
    # What follows a word: one mark after a word is a sentence's; several, or other marks, are junk's.
    closes = ~blank & np.concatenate([blank[1:], [True]])
    prior = np.concatenate([[NEWLINE], kind[:-1]])
    tally = lambda mask: np.add.reduceat(mask.astype(np.int32), begins).astype(np.float64)
    words = tally(word)
    some, w = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, CAPITAL] + counts[:, HIGH] / 2, 1)
    own = np.stack(
        [
            np.log1p(length) / 5,
            np.log1p(words) / 4,
            counts[:, LOWER] / some,
            counts[:, CAPITAL] / letters,
            counts[:, DIGIT] / some,
            counts[:, SPACE] / some,
            counts[:, STOP] / some,
            counts[:, MARK] / some,
            counts[:, HIGH] / some,
            np.minimum(length / w, 30) / 10,
            tally(closes & (kind == MARK)) / w,
            tally(closes & (kind == STOP) & ((prior == STOP) | (prior == MARK))) / w,
            tally(word & closes & (kind != LOWER)) / w,
            tally((kind == CAPITAL) & (prior == CAPITAL)) / letters,
            (length == 0).astype(np.float64),
        ],
        axis=1,
    )
    own = np.concatenate([own, _repeats(data, begins, ends, first)], axis=1)
    n = len(own)
    up, down = np.zeros_like(own), np.zeros_like(own)
    up[1:], down[:-1] = own[:-1], own[1:]
    up[first[:-1]] = 0
    down[first[1:] - 1] = 0
    return np.concatenate([np.ones((n, 1)), own, up, down], axis=1), length, first


def _repeats(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per line: whether its text already had it, the share of its words said before in it, and the
    share of its words equal to the word before."""
    out = np.zeros((len(begins), 3))
    raw = data.tobytes()
    for a, b in zip(first[:-1], first[1:], strict=True):
        seen = set()
        for i in range(a, b):
            line = raw[begins[i] : ends[i]]
            out[i, 0] = line in seen
            seen.add(line)
            words = line.split()
            if len(words) > 1:
                out[i, 1] = 1 - len(set(words)) / len(words)
                out[i, 2] = sum(map(eq, words, words[1:])) / len(words)
    return out


def _steps(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling number of lines, and how many still have a line at each step."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), "right")
    return order, alive


def forward_backward(unary: np.ndarray, first: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of every line, expected label pairs as a 2 x 2 sum), all texts stepping together.

    ``unary`` is the log-odds of good; the messages are normalised at each step.
    """
    order, alive = _steps(first)
    start = first[:-1][order]
    local = np.stack([np.zeros_like(unary), np.clip(unary, -30, 30)], axis=1)
    local = np.exp(local - local.max(axis=1, keepdims=True))
    move = np.exp(stay)
    fore, back = np.empty_like(local), np.ones_like(local)
    for t, k in enumerate(alive):
        at = start[:k] + t
        message = local[at] if t == 0 else (fore[at - 1] @ move) * local[at]
        fore[at] = message / message.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        seen = local[at] * back[at]
        message = seen @ move.T
        joint = fore[at - 1][:, :, None] * move[None] * seen[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[at - 1] = message / message.sum(axis=1, keepdims=True)
    belief = fore * back
    return belief[:, 1] / belief.sum(axis=1), pairs


def _mean_by_text(values: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight = length + 1  # an empty line counts as its line end
    cuts = first[:-1]
    return np.add.reduceat(values * weight, cuts) / np.add.reduceat(weight, cuts)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, length: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int = 250, decay: float = 1e-3) -> Model:
    """Maximum conditional likelihood (Adam) with every line under its text's label, then the calibration.

    The label of a text is what is known; the field learns which lines speak for it.  Both classes
    weigh the same in sum, lines weigh by their text's number of lines.
    """
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean[0], scale[scale < 1e-9], scale[0] = 0.0, 1.0, 1.0
    x = (features - mean) / scale
    sizes = np.diff(first)
    y = np.repeat(good.astype(np.float64), sizes)
    per_text = np.where(good == 1, 0.5 / max(good.sum(), 1), 0.5 / max((good == 0).sum(), 1))
    weight = np.repeat(per_text / sizes, sizes)
    same_label = np.zeros((2, 2))
    for label in (0, 1):
        same_label[label, label] = ((sizes - 1) * (good == label)).sum()
    total = max((sizes - 1).sum(), 1)
    theta, stay = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v, ms, vs = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(stay), np.zeros_like(stay)
    for step in range(1, rounds + 1):
        p, pairs = forward_backward(x @ theta, first, stay)
        g = x.T @ (weight * (y - p)) - decay * theta
        gs = (same_label - pairs) / total - 0.1 * stay
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        ms, vs = 0.9 * ms + 0.1 * gs, 0.99 * vs + 0.01 * gs * gs
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        theta = theta + 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        stay = stay + 0.05 * (ms / c1) / (np.sqrt(vs / c2) + 1e-8)
    p, _ = forward_backward(x @ theta, first, stay)
    slope, shift = calibrate(_logit(_mean_by_text(p, length, first)), good)
    return Model(theta, stay, mean, scale, slope, shift)


def calibrate(z: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the labels over z, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((good - p) * z).sum() - 1e-2 * a, (good - p).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(move[0], -0.5, 0.5)), b + float(np.clip(move[1], -0.5, 0.5))
    return max(a, 1e-3), b


def score_batch(texts: pa.Array, model: Model) -> np.ndarray:
    if not model.usable:
        return np.full(len(texts), 0.5)
    data, starts = _text_bytes(texts)
    features, length, first = line_features(data, starts)
    p, _ = forward_backward(((features - model.mean) / model.scale) @ model.weights, first, model.stay)
    z = model.slope * _logit(_mean_by_text(p, length, first)) + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """True for the fold that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Features of a bounded sample of labelled documents outside the held-out fold, by hash order.

    Ids with contradicting labels are left out, ids of several rows count once.  The chosen ids, ``sample_docs`` at most, are the only
    broadcast; documents come back as features, in hash order while they fit ``sample_lines``.  A document
    longer than its share of the lines teaches with its first ones.
    """
    share = max(1, sample_lines // SHARES)
    told = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    chosen = told.select(F.col("doc_id").alias("id"), "quality").orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    kept = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "text", "quality")

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, starts = _text_bytes(part.column("text"))
                x, length, first = line_features(data, starts)
                ends = np.minimum(first[1:], first[:-1] + share)
                rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], ends, strict=True)]
                sizes = [length[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.int64()), part.column("quality").cast(pa.int32()), pa.array(ends - first[:-1], pa.int64()),
                     pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())],
                    names=["id", "quality", "lines", "x", "length"],
                )

    rows = kept.mapInArrow(measure, "id long, quality int, lines long, x binary, length binary")
    # An id that many rows repeat counts once, by the smallest of its features, reduced before the shuffle.
    one = rows.groupBy("id").agg(F.min(F.struct("quality", "lines", "x", "length")).alias("r")).select("id", F.xxhash64("id").alias("turn"), "r.*")
    measured = stored(one, "sample")
    # The bound in lines is found on ids and counts alone, and holds before anything reaches the driver.
    so_far = Window.orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = measured.select("id", "turn", F.sum("lines").over(so_far).alias("so_far")).filter(F.col("so_far") <= sample_lines).select(F.col("id").alias("i"))
    got = measured.join(fitting, F.col("id") == F.col("i"), "left_semi").collect()
    got.sort(key=lambda r: (r["turn"], r["id"]))
    good = np.array([r["quality"] for r in got], np.int64)
    if not len(good) or good.min() == good.max():
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]).astype(np.float64)
    length = np.concatenate([np.frombuffer(r["length"], np.float32) for r in got]).astype(np.float64)
    return x, length, np.concatenate([[0], np.cumsum([r["lines"] for r in got])]), good


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model:
    sample = training_sample(docs, labels, sample_docs, sample_lines)
    if sample is None:
        none = np.zeros(FEATURES)
        return Model(none, np.zeros((2, 2)), none, none, usable=False)
    return fit(*sample)


def scored(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(row, score, predicted) of every document; row holds the columns to keep."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            # Texts are scored a few at a time, so that the work space follows them and not the batch.
            text = batch.column("text")
            scores = [score_batch(text.slice(at, 256), model) for at in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["row", "score"])

    schema = rows.select("row").schema.add("score", "double")
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    doc_id = F.col("row.doc_id")
    return scored(docs, model, ["doc_id"], threshold).select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that the classifier does not reject.  A model without labels to learn from rejects none."""
    if not model.usable:
        return docs
    return scored(docs, model, docs.columns, threshold).filter("predicted = 1").select("row.*")
