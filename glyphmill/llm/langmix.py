"""Language identification by inferring each document's mixture of languages.

A language's model is a distribution over hashed byte trigrams of lower-cased
letters.  A document's trigrams are taken as draws from a mixture of those
distributions; expectation-maximisation finds the proportions, and languages
join the mixture one by one while the likelihood rises by more than a
penalty.  The likelihood is concave in the proportions, so what a further
language can add is at most its slope there: documents whose slopes all lie
within the penalty need no iteration at all, and lose nothing by it.

How well a text fits is its mean log-likelihood per trigram under its mixture.
Texts of languages that weren't learnt, or of none, fit far worse than any
that were; ``least_fit`` sets the limit halfway between the least usual fit of
labelled texts that weren't learnt from and that of trigrams drawn at random.

Models count the trigrams of all labelled texts given, and the limit all fits.

Defined results: null texts and texts without a letter are ``und`` with score
0 and a null fit, as is every text when nothing could be learnt; ties go to the language
first in alphabetical order; repeated rows give repeated rows; other columns
stay, unless they are called like one that is made, which takes their place;
an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import rows_of, with_columns

#: Hash buckets of the trigrams, as a power of two.
BITS = 14
#: Each letter stands in three trigrams, so evidence counts threefold; the penalty does too.
OVERLAP = 3.0
#: The part of labelled texts whose fits are unusual, the fewest texts that give the limit, and the steps of one unit of fit it is exact to.
UNUSUAL, FIT_LEAST, FIT_STEPS = 0.001, 100, 1000

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts by bucket; all but letters count as one space between words."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8)
    blank = raw == 32
    raw = raw[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)


class Mixture:
    """Proportions of ``names`` in texts; ``probs`` has a distribution over buckets in each row."""

    def __init__(self, names: list[str], counts: np.ndarray, penalty: float = 0.5 * OVERLAP):
        self.names, self.penalty = names, penalty
        self.probs = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if names else counts

    def infer(self, text: str) -> dict[str, float]:
        """Proportion by language of the set that the penalised likelihood selects, largest first."""
        return self.infer_with_fit(text)[0]

    def infer_with_fit(self, text: str) -> tuple[dict[str, float], float | None]:
        """The proportions, and the mean log-likelihood of a trigram under them."""
        if not self.names or not _LETTER.search(text):
            return {}, None
        counts = trigram_counts(text)
        seen = np.flatnonzero(counts)
        counts, probs = counts[seen].astype(float), self.probs[:, seen]
        total = counts.sum()
        penalty = self.penalty * np.log(max(total, 2))
        best = int(np.argmax(np.log(probs) @ counts))
        chosen, share, mixed = [best], np.ones(1), probs[best]
        while len(chosen) < len(self.names):
            slopes = probs @ (counts / mixed) - total
            slopes[chosen] = -np.inf
            if slopes.max() <= penalty:
                break
            wider = [*chosen, int(np.argmax(slopes))]
            tried = self._maximise(probs[wider], counts, np.append(share * 0.9, 0.1))
            new = tried @ probs[wider]
            if counts @ np.log(new / mixed) <= penalty:
                break
            chosen, share, mixed = wider, tried, new
        parts = dict(sorted(((self.names[k], float(s)) for k, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0])))
        return parts, float(counts @ np.log(mixed) / total)

    @staticmethod
    def _maximise(probs: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int = 200) -> np.ndarray:
        total = counts.sum()
        for _ in range(rounds):
            owned = share * (probs @ (counts / (share @ probs))) / total
            done = np.abs(owned - share).max() < 1e-4
            share = owned / owned.sum()
            if done:
                break
        return share


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Mixture:
    """Models of all languages in ``lang_col``, from all of their texts."""
    rows = df.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for lang, text in rows_of(batches, "l", "t"):
            counts = trigram_counts(text)
            if lang in found:
                found[lang] += counts
            else:
                found[lang] = counts
        if found:
            yield pa.RecordBatch.from_pydict({"l": list(found), "n": [x.astype("<i8").tobytes() for x in found.values()]})

    def add(key, frame):
        return pd.DataFrame({"l": [key[0]], "n": [sum(np.frombuffer(x, "<i8") for x in frame["n"]).tobytes()]})

    parts = rows.mapInArrow(count, "l string, n binary").groupBy("l").applyInPandas(add, "l string, n binary")
    got = {r["l"]: np.frombuffer(bytes(r["n"]), "<i8") for r in parts.collect()}  # 2^BITS counts for each language
    names = sorted(got)
    return Mixture(names, np.array([got[k] for k in names], float).reshape(len(names), 1 << BITS))


def predict(df: DataFrame, model: Mixture, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score: the largest part's language and proportion; mixture, all parts as a map; and fit."""

    def work(texts: list[str | None]):
        for text in texts:
            parts, fit = model.infer_with_fit(text or "")
            lang, score = next(iter(parts.items()), ("und", 0.0))
            yield lang, min(score, 1.0), list(parts.items()), fit

    made = {"lang_pred", "score", "mixture", "fit"}
    if text_col in made:
        raise ValueError(f"the text's column can't be called {text_col}")
    return with_columns(df.drop(*[c for c in df.columns if c.lower() in made]), text_col, "lang_pred string, score double, mixture map<string,double>, fit double", work)


def least_fit(df: DataFrame, model: Mixture, lang_col: str = "lang", text_col: str = "text") -> float:
    """The fit below which a text is in none of the model's languages, by all labelled texts of ``df``, which it must not have learnt from.

    Fits are counted by steps, so that the limit does not depend on how the rows
    lie; with fewer than FIT_LEAST there is no limit.
    """
    texts = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    steps = predict(texts, model, "t").where("fit is not null").groupBy(F.floor(F.col("fit") * FIT_STEPS).alias("step")).agg(F.count("*").alias("n"))
    counted = sorted((r["step"], r["n"]) for r in steps.collect())  # a row for each step: fits lie between 0 and some -24
    ends = np.cumsum([n for _, n in counted])
    if not counted or ends[-1] < FIT_LEAST:
        return float("-inf")
    low = counted[int(np.searchsorted(ends, UNUSUAL * ends[-1]))][0] / FIT_STEPS
    return (low + float(np.log(model.probs).mean(axis=1).max())) / 2


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for the fold that nothing is learnt from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the folds that are not held out, then predict every text."""
    model = learn(df.where(~held_out(id_col)), lang_col, text_col)
    return predict(df.select(id_col, text_col), model, text_col).withColumn("held_out", held_out(id_col)).drop(text_col)
