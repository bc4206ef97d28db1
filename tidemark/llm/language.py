"""Language identification, word first.

A word the model knows is scored by its log frequency in each language. An unseen word backs off to character
n-grams, from ``MOST`` characters down: the first length at which any of its n-grams is known scores it, by the mean of
their log frequencies. A text's language has the greatest sum over its words; of languages that tie, the first by name."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column_list, lean, pick

MOST, LEAST_COUNT, ADD = 5, 2, 0.5
#: Bound of the training sample: about so many documents of each language, drawn by a hash of the row.
TRAIN_ROWS = 3000
KEPT_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case. A text has none exactly if it has no letter."""
    found = WORD.findall((text or "").lower())
    return found if text is None or text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between marks of its ends."""
    w = f"_{word}_" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies of words and n-grams by language, and the backoff between them."""

    def __init__(self, languages: list[str], counts: dict[tuple[int, str], np.ndarray]):
        """counts: by (0 for words or n for n-grams, the string), an array of counts by language."""
        self.languages = languages
        kinds: dict[int, dict[str, np.ndarray]] = {}
        for (kind, gram), c in counts.items():
            kinds.setdefault(kind, {})[gram] = c
        self.words, rows = {}, []
        for gram, row in self._logs(kinds.get(0, {})):
            self.words[gram] = len(rows)
            rows.append(row)
        self.grams = {n: dict(self._logs(kinds.get(n, {}))) for n in range(1, MOST + 1)}
        self.learned = len(rows)
        self.rows = np.zeros((max(2 * len(rows), 1024), max(1, len(languages))), np.float32)
        if rows:
            self.rows[: len(rows)] = rows
        self.used = len(rows)

    @staticmethod
    def _logs(table: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray]]:
        if table:
            total = np.sum(list(table.values()), axis=0) + ADD * (len(table) + 1)
            yield from ((g, np.log((c + ADD) / total).astype(np.float32)) for g, c in table.items())

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(MOST, len(word) + 2), 0, -1):
            known = self.grams[n]
            rows = [known[g] for g in grams_of(word, n) if g in known]
            if rows:
                return np.mean(rows, axis=0)
        return np.zeros(self.rows.shape[1], np.float32)

    def _add(self, word: str) -> None:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used] = self.unseen(word)
        self.words[word] = self.used
        self.used += 1

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the posterior; ('und', 0) without letters or without a trained model."""
        words = words_of(text)
        if not words or not self.languages:
            return "und", 0.0
        try:
            at = list(map(self.words.__getitem__, words))
        except KeyError:
            if self.used > self.learned + KEPT_WORDS:  # forget the unseen words met so far
                self.words = {w: i for w, i in self.words.items() if i < self.learned}
                self.used = self.learned
            for w in words:
                if w not in self.words:
                    self._add(w)
            at = list(map(self.words.__getitem__, words))
        score = self.rows[at].sum(axis=0, dtype=np.float64)
        best = int(score.argmax())
        return self.languages[best], float(1 / np.exp(score - score[best]).sum())


def train(labelled: DataFrame, text: str, language: str, rows: int = TRAIN_ROWS, seed: int = 11) -> Model:
    """A model of the labelled rows (null texts and labels are left out), from about ``rows`` documents of each language.

    The sample is drawn by a hash, so it is the same each time; words and 5-grams seen once are not
    kept as known, and back off. The model's size follows from the sample's bound and not from the corpus."""
    plain = labelled.select(F.col(text).alias("text"), F.col(language).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in plain.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {})
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows / sizes[k]))])
    drawn = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = plain.where(drawn < share[F.col("lang")])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: dict[str, list[Counter]] = {}
        for b in batches:
            for t, k in zip(column_list(b, "text"), column_list(b, "lang"), strict=True):
                some = Counter(words_of(t))
                table = counts.setdefault(k, [Counter() for _ in range(MOST + 1)])
                table[0].update(some)
            if sum(len(t[0]) for t in counts.values()) > 200_000:
                yield from emit(counts)
                counts = {}
        yield from emit(counts)

    def emit(counts):
        import pyarrow as pa

        for k, (table, *_) in counts.items():
            tables = [table, *(Counter() for _ in range(MOST))]
            for w, c in table.items():
                for n in range(1, MOST + 1):
                    for g in grams_of(w, n):
                        tables[n][g] += c
            for n, t in enumerate(tables):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(t), pa.string()), pa.array([n] * len(t), pa.int32()), pa.array(list(t), pa.string()), pa.array(list(t.values()), pa.int64())], names=["lang", "kind", "gram", "n"])

    summed = sample.mapInArrow(lean(run), "lang string, kind int, gram string, n long").groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    per_gram = summed.groupBy("kind", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
    kept = per_gram.where(f"n >= {LEAST_COUNT} or kind between 1 and {MOST - 1}")
    number = {k: i for i, k in enumerate(languages)}
    counts = {}
    for r in kept.select("kind", "gram", "by").toLocalIterator():
        c = np.zeros(len(languages))
        for k, n in r["by"].items():
            c[number[k]] = n
        counts[(r["kind"], r["gram"])] = c
    return Model(languages, counts)


def predict(docs: DataFrame, doc_id: str, text: str, model: Model, also: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, further columns ``also``, lang_pred and score (the posterior of lang_pred among the learned languages).

    Null texts and those without a letter are 'und' with score 0; so is all if nothing was learned. Of languages that tie, the first by name
    is taken. Repeated rows stay repeated, with the same answer. An empty table gives an empty one."""
    import pyarrow as pa

    also = also or {}
    plain = pick(docs, doc_id, text).toDF("doc_id", "text").select("doc_id", *[c.alias(k) for k, c in also.items()], "text")
    names = ["doc_id", *also]
    schema = plain.select(*names).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        held = sent.value
        for b in batches:
            found = [held.predict(t) for t in column_list(b, "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return plain.mapInArrow(lean(run), schema)


def identify(docs: DataFrame, doc_id: str, text: str, language: str, held_out: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row doc_id, held_out, lang_pred, score, of a model trained on the labelled rows that are not held out."""
    plain = pick(docs, doc_id, text, language)
    model = train(plain.where(~held_out), text, language, rows)
    return predict(plain, doc_id, text, model, {"held_out": held_out})
