"""Language identification: known words first, then ever shorter character n-grams.

The model holds, per language, log frequencies of words and of character n-grams, counted
on a bounded sample of labelled rows: about ``per_language`` rows of each language, chosen
by a hash of the id, or all rows of a language that has fewer. A word seen ``least`` times
or more is scored by its frequencies. Any other is scored by its n-grams: from each of its
places the longest known one counts, from length ``N`` down to 1, averaged over places. A
text's score adds up its words; the share of the best language among all, from 0 to 1, is
the score that is returned. Equal scores go to the language first by code point.

A text without a letter, a NULL text, or a model without languages gives ``und`` with
score 0. Rows without label or id are never learned from. Repeated rows each get their
prediction; extra columns take no part unless they are named to be carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_parts, text_or_empty
from tidemark.operators.staging import staged

UNKNOWN = "und"
N = 4
REMEMBERED = 1 << 17
LETTERS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Model:
    """``grams``: log frequency per language of words (length 0) and of n-grams, by length."""

    languages: tuple[str, ...]
    grams: dict[int, dict[str, tuple[float, ...]]]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for testing: CRC-32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    counts = labelled.groupBy("lang").count().collect()  # one number per language; the model holds the languages too
    if not counts:
        return labelled.select("lang", "text")
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_language / r["count"])])
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    return labelled.filter(drawn < F.element_at(shares, F.col("lang"))).select("lang", "text")


def _parts(text: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(places, lambda at: F.substring(text, at, F.lit(n)))


def learn(docs: DataFrame, *, per_language: int = 800, least: int = 3) -> Model:
    """A model from rows of ``docs(doc_id, text, lang)`` that have id, text and label."""
    labelled = docs.select("doc_id", "text", "lang").filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    words = _sample(labelled, per_language).select("lang", F.explode(found).alias("gram"))
    words = staged(words.groupBy("lang", "gram").count())
    padded = F.concat(F.lit("^"), F.col("gram"), F.lit("$"))
    kinds = [words.select("lang", F.lit(0).alias("length"), "gram", "count")]
    for n in range(1, N + 1):
        parts = words.select("lang", "count", F.explode(_parts(padded, n)).alias("gram"))
        kinds.append(parts.groupBy("lang", "gram").agg(F.sum("count").alias("count")).select("lang", F.lit(n).alias("length"), "gram", "count"))
    counts = kinds[0]
    for kind in kinds[1:]:
        counts = counts.union(kind)
    counts = staged(counts)
    totals = counts.groupBy("lang", "length").agg(F.sum("count").alias("total"))
    kept = counts.groupBy("length", "gram").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"))
    kept = kept.filter(F.col("n") >= least)
    # Both are bounded by the sample and go to the driver to become the model.
    sums = {(r["lang"], r["length"]): r["total"] for r in totals.collect()}
    languages = tuple(sorted({lang for lang, _ in sums}))
    grams: dict[int, dict[str, tuple[float, ...]]] = {n: {} for n in range(N + 1)}
    for r in kept.collect():
        shares = [(r["by"].get(lang, 0) + 0.1) / (sums.get((lang, r["length"]), 0) + 1000.0) for lang in languages]
        grams[r["length"]][r["gram"]] = tuple(map(math.log, shares))
    return Model(languages, grams)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.longest_first = [(n, model.grams[n].get) for n in range(N, 0, -1)] if model.languages else []
        self._clear()

    def _clear(self) -> None:
        self.row_of: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)))

    def word(self, word: str) -> Sequence[float]:
        known = self.model.grams[0].get(word)
        if known is not None:
            return known
        padded, found = f"^{word}$", []
        end = len(padded)
        for at in range(end):
            for n, known_of in self.longest_first:
                values = known_of(padded[at : at + n]) if at + n <= end else None
                if values is not None:
                    found.append(values)
                    break
        if not found:
            return [0.0] * len(self.model.languages)
        return [sum(column) / len(found) for column in zip(*found, strict=True)]

    def _row(self, word: str) -> int:
        at = len(self.row_of) + 1
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.word(word)
        self.row_of[word] = at
        return at

    def predict(self, text: str) -> tuple[str, float]:
        words = LETTERS.findall(text.lower())
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        if len(self.row_of) > REMEMBERED:
            self._clear()
        known, row = self.row_of.get, self._row
        total = self.rows_sum([known(w) or row(w) for w in words])
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.languages[best], float(share[best] / share.sum())

    def rows_sum(self, rows: list[int]) -> np.ndarray:
        return self.rows.take(rows, axis=0).sum(axis=0)


def predict(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row of ``docs``, with ``lang_pred`` and ``score`` of its ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learned from
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "lang_pred", "score"])

    return in_parts(docs.select(*carry, text_or_empty().alias("_scored")), run, f"{fields}, lang_pred string, score double")
