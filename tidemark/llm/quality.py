"""Quality of documents by histogram gradient-boosted trees over statistics of their texts.

``statistics`` turns a whole text into ``STATISTICS``. Trees are fitted on a bounded sample
of labelled texts: statistics become bins of about equal content, each level of a tree
takes for every node the split that gains most over the histograms of gradients, and a
tree is a complete binary one, so a model is a few flat arrays (``Model``). Scoring walks
all trees for a block of rows at once, level by level.

Defined cases: a NULL text is an empty one and gets a score; labels other than 0 and 1, of
no id or of no text, teach nothing; of several labels for one id the larger share counts, 1
at a tie. A labelled text that occurs often is learnt from once a label. With labels of
one kind only, or none, every score is their share (one half without any). Extra columns
are left out unless carried, repeated rows get the same score, an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_parts, text_or_empty
from tidemark.operators.staging import staged

SAMPLE = 20_000  # texts of each label that trees are fitted on, about
STATISTICS = (
    "characters words lines word_length word_length_spread longest_word letters upper digits spaces full_stops marks symbols beyond_ascii entropy"
    " different_words commonest_word same_as_before different_pairs different_lines line_length ended_lines marked_words upper_words bare_marks sentence_length"
).split()
BINS, DEPTH, TREES, RATE, SMOOTHING, LEAST_WEIGHT = 64, 4, 60, 0.2, 1.0, 3.0

# Classes of bytes: 0 upper, 1 lower, 2 digit, 3 space, 4 marks of prose, 5 other printing, 6 control, 7 beyond ASCII.
_CLASS = np.full(256, 5, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[:32] = 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 4
_CLASS[127] = 6
_CLASS[128:] = 7
_PROSE_END = frozenset(".,;:?!'\")-")


def statistics(text: str) -> list[float]:
    """The ``STATISTICS`` of a whole text; all zero for an empty one."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return [0.0] * len(STATISTICS)
    counts = np.bincount(data, minlength=256)
    classes = np.bincount(_CLASS, weights=counts, minlength=8)
    share = counts[counts > 0] / len(data)
    upper, lower, digits, spaces, marks, symbols, _, beyond = (classes / len(data)).tolist()
    letters = upper + lower + beyond
    words = text.split()
    many = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    of_word = Counter(words)
    of_pair = len(set(zip(words, words[1:], strict=False)))
    again = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    kinds = [(n, w) for w, n in of_word.items()]
    marked = sum(n for n, w in kinds if not (w[-1].isalnum() or w[-1] in _PROSE_END))
    capitals = sum(n for n, w in kinds if len(w) > 1 and w.isupper())
    bare = sum(n for n, w in kinds if not any(map(str.isalnum, w)))
    lines = [line for line in text.split("\n") if line.strip()]
    some = max(len(lines), 1)
    ended = sum(1 for line in lines if line.rstrip()[-1] in ".?!")
    stops = int(counts[ord(".")] + counts[ord("?")] + counts[ord("!")])
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(int(lengths.max())),
        letters,
        upper / letters if letters else 0.0,
        digits,
        spaces,
        float(counts[ord(".")]) / many,
        marks,
        symbols,
        beyond,
        float(-(share * np.log2(share)).sum()),
        len(of_word) / many,
        max(of_word.values(), default=0) / many,
        again / many,
        of_pair / many,
        len(set(lines)) / some,
        math.log1p(len(text) / some),
        ended / some,
        marked / many,
        capitals / many,
        bare / many,
        math.log1p(len(words) / max(stops, 1)),
    ]


@dataclass(frozen=True)
class Model:
    """Complete binary trees: inner nodes level by level, then leaves. ``base`` is the score before any tree, as log odds."""

    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray  # a larger value goes right
    leaf: np.ndarray  # (trees, 2^depth)

    def log_odds(self, values: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(values), self.base)
        row, tree = np.arange(len(values))[:, None], np.arange(trees)[None, :]
        at = np.zeros((len(values), trees), np.int64)
        for _ in range(int(math.log2(inner + 1))):
            right = values[row, self.feature[tree, at]] > self.threshold[tree, at]
            at = 2 * at + 1 + right
        return self.base + self.leaf[tree, at - inner].sum(axis=1)

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(values), -40, 40)))


def constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    nothing = np.empty((0, 2**DEPTH - 1))
    return Model(math.log(share / (1 - share)), nothing.astype(np.int64), nothing, np.empty((0, 2**DEPTH)))


def _edges(values: np.ndarray) -> list[np.ndarray]:
    """Upper edges of the bins of each statistic; at most BINS - 1."""
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(column, cuts, method="lower")) for column in values.T]


def fit(values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
    """Boost TREES trees on log loss; rows of a block that fits in memory."""
    share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5
    model = constant(share)
    if len(np.unique(labels)) < 2:
        return model
    edges = _edges(values)
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, values.T, strict=True)])
    # A place of the histogram for every (statistic, bin); nodes come in front of it.
    places = binned + (np.arange(len(edges)) * BINS)[:, None]
    usable = np.arange(BINS)[None, :] < np.array([len(e) for e in edges])[:, None]  # a split after bin b
    inner, odds = 2**DEPTH - 1, np.full(len(labels), model.base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        certain = 1 / (1 + np.exp(-odds))
        first, second = weights * (certain - labels), weights * certain * (1 - certain)
        node = np.zeros(len(labels), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            n, begin = 2**level, 2**level - 1
            local = node - begin
            size = len(edges) * BINS
            sums = [
                sum(np.bincount(local * size + place, weights=w, minlength=n * size) for place in places).reshape(n, len(edges), BINS)
                for w in (first, second)
            ]
            left = [np.cumsum(s, axis=2) for s in sums]
            whole = [s.sum(axis=2, keepdims=True) for s in sums]
            right = [w - s for w, s in zip(whole, left, strict=True)]
            gain = sum(g * g / (h + SMOOTHING) for g, h in ((left[0], left[1]), (right[0], right[1]))) - whole[0] ** 2 / (whole[1] + SMOOTHING)
            light = LEAST_WEIGHT / 4  # a row in doubt has a second derivative of a quarter of its weight
            gain[(left[1] < light) | (right[1] < light) | ~usable[None]] = -np.inf
            best = gain.reshape(n, -1).argmax(axis=1)
            for k in range(n):
                if gain.reshape(n, -1)[k, best[k]] > 1e-9:
                    feature[begin + k] = best[k] // BINS
                    threshold[begin + k] = edges[best[k] // BINS][best[k] % BINS]
            node = 2 * node + 1 + (values[np.arange(len(values)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (first, second))
        value = -RATE * g / (h + SMOOTHING)
        odds = odds + value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Model(model.base, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from; a row without id is learnt from no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _statistics_of(docs: DataFrame, kept: Sequence[str]) -> DataFrame:
    """``kept`` columns and ``statistics`` (array of float) of ``docs(kept, _text)``."""
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics(t.as_py()) for t in batch.column(len(kept))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], found], [*kept, "statistics"])

    return in_parts(docs.select(*kept, "_text"), run, f"{fields}statistics array<double>")


def _share(column: str) -> Column:
    """A number from 0 to 1 drawn by the value of a column."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit("quality")), 11) / F.lit(float(1 << 53))


def _by_label(shares: dict[int, float]) -> Column:
    return F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in shares.items()], F.lit(0.0))


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Trees from about ``sample`` labelled texts of each label, in ``docs(doc_id, text)`` and ``labels(doc_id, label)``.

    Ids are drawn before texts are joined, so the drawn ids are few and the texts are
    filtered where they are scanned. Ids that many rows bear are drawn once more by text.
    What reaches the driver is the statistics of the sample.
    """
    told = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("label"))
    known = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}  # two numbers
    drawn = staged(told.filter(_share("doc_id") < _by_label({k: min(1.0, sample / n) for k, n in known.items()})))
    texts = docs.select("doc_id", text_or_empty().alias("_text")).join(drawn, "doc_id")
    texts = texts.select("label", F.xxhash64("_text").alias("content"), "_text")
    found = staged(_statistics_of(texts, ("label", "content")).dropDuplicates(["label", "content"]))
    held = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}  # two numbers
    if not held:
        return constant(0.5)
    rows = found.filter(_share("content") < _by_label({k: min(1.0, sample / n) for k, n in held.items()})).orderBy("content", "label").toArrow()
    truth = rows.column("label").to_numpy().astype(np.int64)
    values = rows.column("statistics").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    # Each label weighs as it does in the table, whatever its share of the sample.
    of = {k: known[k] / max((truth == k).sum(), 1) for k in held}
    weights = np.array([of[k] for k in truth.tolist()])
    return fit(values, truth, weights * len(truth) / max(weights.sum(), 1e-12))


def predict(docs: DataFrame, model: Model, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, carried columns and ``score`` of every row: statistics and trees in one pass over the texts."""
    kept = ["doc_id", *carry]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TREES trees, whatever the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(len(kept))]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(trees.score(values))], [*kept, "score"])

    return in_parts(docs.select(*kept, text_or_empty().alias("_text")), run, f"{fields}score double")
