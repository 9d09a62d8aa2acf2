"""Language identification by rank-order profiles.

A profile is a list of the most frequent character n-grams (1 to 3 characters, words padded with a blank), most
frequent first. A document's distance to a language is the sum, over the document's own profile, of how far each
n-gram is out of its place in the language's profile; n-grams that the language lacks count as its whole length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strail.llm.common import fold, own_names, text_of

LENGTHS = (1, 2, 3)
PROFILE = 400  # n-grams in a language's profile
TOP = 300  # n-grams in a document's profile
PER_LANGUAGE = 400  # documents that a language is learned from: this many are expected, twice as many the most
WORDS = 200_000  # words whose n-grams a worker remembers
SPARE = 1 << 16  # n-grams of no profile that a worker remembers; more are forgotten before the next text

_words = re.compile(r"[^\W\d_]+").findall  # runs of letters, and of signs of numbers such as fractions, which \w takes in


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in LENGTHS for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


def word_counts(text: str | None) -> Counter:
    """How often each run of letters occurs."""
    count = Counter(_words(text.lower())) if text else Counter()
    for w in [w for w in count if not w.isalpha()]:
        n = count.pop(w)
        for run in "".join(c if c.isalpha() else " " for c in w).split():
            count[run] += n
    return count


@dataclass
class Model:
    langs: list[str]
    place: dict[str, int]  # n-gram -> column
    ranks: np.ndarray  # languages x (n-grams + 1); the last column is for n-grams of no profile

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> Model:
        langs = sorted(samples)
        tops = []
        for lang in langs:
            words: Counter = Counter()
            for text in samples[lang]:
                words.update(word_counts(text))
            count: Counter = Counter()
            for w, n in words.items():
                for g in grams(w):
                    count[g] += n
            tops.append([g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]])
        place = {g: i for i, g in enumerate(sorted({g for top in tops for g in top}))}
        ranks = np.full((len(langs), len(place) + 1), -1, np.int64)
        for row, top in zip(ranks, tops, strict=True):
            row[[place[g] for g in top]] = np.arange(len(top))
        return cls(langs, place, ranks)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.seen, self.spare = model, {}, {}

    def columns(self, word: str) -> list[int]:
        got = self.seen.get(word)
        if got is None:
            place, n = self.model.place, len(self.model.place)
            padded = f" {word} "
            all_of = [*word, *map("".join, zip(padded, word)), word[-1] + " ", *map("".join, zip(padded, word, padded[2:]))]  # as grams() gives them
            spare = self.spare
            got = [place[g] if g in place else n + spare.setdefault(g, len(spare)) for g in all_of]
            if len(self.seen) >= WORDS:
                self.seen.clear()
            if len(word) < 64:
                self.seen[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and how much nearer it is than the second, from 0 to 1; `und`, 0 without letters."""
        words = word_counts(text)
        if not words or not self.model.langs:
            return "und", 0.0
        if len(self.spare) > SPARE:
            self.spare, self.seen = {}, {}
        columns, parts = self.columns, []
        sizes = []
        for w in words:
            got = columns(w)
            parts += got
            sizes.append(len(got))
        weights = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
        counts = np.bincount(np.array(parts, np.int64), weights, len(self.model.place) + len(self.spare))
        ids = np.flatnonzero(counts)
        order = np.lexsort((ids, -counts[ids]))[:TOP]  # of equals those of no profile last; they are alike for the distance
        top = np.minimum(ids[order], len(self.model.place))
        ranks = self.model.ranks[:, top]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(away))  # of equals the first by name
        if len(away) == 1:
            return self.model.langs[0], 1.0 - float(away[0]) / (PROFILE * len(top))
        second = float(np.partition(away, 1)[1])
        return self.model.langs[best], (second - float(away[best])) / second if second else 0.0


def fit(docs: DataFrame, mod: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE, id_col: str = "doc_id") -> Model:
    """Profiles of each lang, from at most 2 * per_language documents of it that are not held out (a fixed sample by hash of the id)."""
    spark = docs.sparkSession
    learn = docs.where((fold(id_col, mod) != held_out) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Model.fit({})
    shares = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in counts.items()], "lang string, share double")
    rolled = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) / 1e6
    rows = learn.select("lang", text_of().alias("text"), rolled.alias("roll")).join(F.broadcast(shares), "lang").where("roll < share").select("lang", "text")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))  # about per_language rows each
    samples: dict[str, list[str]] = {k: [] for k in counts}
    for r in rows.withColumn("no", first).where(F.col("no") <= 2 * per_language).collect():
        samples[r["lang"]].append(r["text"])
    return Model.fit({k: sorted(v) for k, v in samples.items()})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score. Null texts and texts without a letter are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.predict(t.as_py()) for t in b.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + ["lang_pred string", "score double"])
    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias(own_names(rest, "text")[0])).mapInArrow(run, schema)
