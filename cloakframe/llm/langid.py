"""Language identification by the nearest of several clustered centroids.

A text's letters, lower-cased, with one space for anything between them, give byte n-grams of one to three bytes, hashed to
``DIMENSIONS``. Their damped counts times idf, normalised, are compared by cosine with ``CLUSTERS`` spherical k-means
centroids for each language. A text of ``MIN_LETTERS`` letters or more that is farther from its nearest centroid than the
language's radius is rejected. The radius is a high quantile of the distances of training texts from centroids fitted
without them, plus a margin; so neither single odd texts nor the size of the sample widen it.

The model is fitted on a bounded sample: ``sample`` labelled rows of each language in expectation, chosen by a hash of doc_id and text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_name, crc32_remainder, give_back, occupies

DIMENSIONS = 8192
CLUSTERS = 4
#: Texts with fewer letters are too short for their distance to say anything.
MIN_LETTERS = 20
#: Parts of the training texts of which each is held out once to measure distances.
FOLDS = 5
#: Short texts lie farther out; this over the number of letters is added to the radius.
SHORT = 2.0
UNKNOWN = "und"
_SHIFT = np.uint32(32 - 13)
_GAPS = re.compile(r"[\W\d_]+")


def _letters_only(text: str | None) -> str:
    """A text in lower case, with one space for each run of anything but letters; number signs such as ½ or Ⅷ are no letters."""
    folded = _GAPS.sub(" ", (text or "").lower())
    odd = "".join(c for c in set(folded) if c != " " and not c.isalpha())
    return (re.sub(f"[{re.escape(odd)} ]+", " ", folded) if odd else folded).strip()


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, or None if it has no letter."""
    folded = _letters_only(text)
    if not folded:
        return None
    b = np.frombuffer(f" {folded} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(DIMENSIONS, dtype=np.int32)
    gram = b.copy()
    for n in range(1, 4):
        if n > 1:
            gram = gram[:-1] * np.uint32(256) + b[n - 1 :]
        out += np.bincount(((gram + np.uint32(n << 28)) * np.uint32(2654435761)) >> _SHIFT, minlength=DIMENSIONS).astype(np.int32)
    return out


def letters(text: str | None) -> int:
    folded = _letters_only(text)
    return len(folded) - folded.count(" ")


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray  # one row for each centroid, unit length
    languages: tuple[str, ...]  # of each centroid
    radius: dict[str, float]  # cosine distance beyond which a long text is rejected

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text; the score is the cosine with the nearest centroid."""
        found = [(UNKNOWN, 0.0, True)] * len(texts)
        for begin in range(0, len(texts), 256):
            rows = [(i, c) for i in range(begin, min(begin + 256, len(texts))) if (c := counts(texts[i])) is not None]
            if not rows or not self.languages:
                continue
            near = vectors(np.stack([c for _, c in rows]), self.idf) @ self.centroids.T
            for (i, _), best, score in zip(rows, near.argmax(1), near.max(1), strict=True):
                lang = self.languages[best]
                found[i] = (lang, float(min(1.0, max(0.0, score))), bool((n := letters(texts[i])) >= MIN_LETTERS and 1 - score > self.radius[lang] + SHORT / n))
        return found


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf, dtype=np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _cluster(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row, then always the row farthest from the centroids so far."""
    chosen = [int((v @ v.mean(0)).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _held_out_distances(v: np.ndarray, clusters: int) -> np.ndarray:
    """Distance of each row from the nearest centroid of the other parts' rows. Rows are in the order of their texts, so copies share a part."""
    parts = np.array_split(np.arange(len(v)), min(FOLDS, len(v)))
    if len(parts) < 2:
        return np.empty(0, np.float32)
    return np.concatenate([1 - (v[part] @ _cluster(np.delete(v, part, axis=0), clusters).T).max(1) for part in parts])


def fit(texts: list[str | None], langs: list[str], clusters: int = CLUSTERS, quantile: float = 0.95, margin: float = 0.2) -> LanguageModel:
    """A model of labelled texts, in any order; texts without letters are left out.

    A radius is ``margin`` beyond the ``quantile`` of the language's own held-out distances or of all languages', whichever
    is larger, since few texts say little. Where nothing can be held out, no text is rejected for its distance.
    """
    rows = sorted((lang, t) for lang, t in zip(langs, texts, strict=True) if letters(t))
    if not rows:
        return LanguageModel(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), (), {})
    tf = np.empty((len(rows), DIMENSIONS), np.int32)
    for i, (_, t) in enumerate(rows):
        tf[i] = counts(t)
    held = sum(((tf[i : i + 32] > 0).sum(0) for i in range(0, len(rows), 32)), np.zeros(DIMENSIONS, np.int64))
    idf = (np.log((1 + len(rows)) / (1 + held)) + 1).astype(np.float32)
    # The vectors take the place of the counts: the driver holds one such table, not five.
    v, own = tf.view(np.float32), np.array([lang for lang, _ in rows])
    for i in range(0, len(rows), 32):
        v[i : i + 32] = vectors(tf[i : i + 32], idf)
    long_enough = np.array([letters(t) >= MIN_LETTERS for _, t in rows])
    centroids, languages, held_out = [], [], {}
    for lang in sorted(set(own)):
        # Short texts are no good centres, but a language may have no others.
        mine = v[(own == lang) & long_enough] if ((own == lang) & long_enough).any() else v[own == lang]
        c = _cluster(mine, clusters)
        centroids.append(c)
        languages += [lang] * len(c)
        held_out[lang] = _held_out_distances(mine, clusters)
    every = np.concatenate(list(held_out.values()))
    radius = {lang: float(min(0.98, max(np.quantile(d, quantile) for d in (own_d, every) if len(d)) + margin)) if len(every) else 1.0 for lang, own_d in held_out.items()}
    return LanguageModel(idf, np.concatenate(centroids), tuple(languages), radius)


def fit_languages(labelled: DataFrame, sample: int = 400, most: int = 1000, **options) -> LanguageModel:
    """Fit on (doc_id, text, lang): about ``sample`` rows of each non-null lang, by a hash of doc_id and text, or all where there are fewer.

    Languages are the ``most`` most frequent ones, so that a column of other things than languages doesn't fill the driver.
    """
    known = labelled.where("lang is not null").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    shares = sizes.select("lang", (F.least(F.lit(1.0), F.lit(sample) / F.col("n")) * 1_000_000).alias("share"))
    point = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("language sample")), F.lit(1_000_000))
    rows = known.join(F.broadcast(shares), "lang").where(point < F.col("share")).select("text", "lang").collect()  # ``most`` rows are broadcast
    model = fit([r["text"] for r in rows], [r["lang"] for r in rows], **options)
    del rows
    give_back()  # the driver keeps the counts' memory otherwise
    return model


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``docs`` with lang_pred, score (0 to 1) and rejected added; columns of these names, in any case, are replaced.

    lang_pred is a language of the model, or ``und`` (score 0, rejected) where the text is null or has no letter or the
    model is empty. Whole texts are read; repeated rows get the same answer; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        occupies("langid")
        return pd.DataFrame(shared.value.predict([t if isinstance(t, str) else None for t in texts]), columns=["lang_pred", "score", "rejected"])

    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    found = column_name(docs, "_found")
    return docs.select(*own, predict("text").alias(found)).select(*own, f"{found}.*")


def held_in(doc_id: Column) -> Column:
    """Rows that a model of the query may learn from: crc32(doc_id as text) mod 3 is not 1."""
    return crc32_remainder(doc_id, 3) != 1
