"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows.

Each statistic counts by how far it goes beyond what nearly all good labelled
documents have, so usual documents fall together near the origin.  (A forest
over the bare statistics, which differ among good documents far more than they
tell bad ones apart, finds 4 of 100 bad documents where this finds all.)
Trees of random splits are grown on labelled documents; one that stands apart
is alone after few splits, so its paths are short.  Every second labelled row
gives the limits and the trees; on the others, of which neither has seen any,
the score is set from which a document is rejected: it rejects the most bad
ones while it rejects at most ``spare`` of the good ones.

Defined results: a null text has no words; documents that fail the base rules
are not kept; where no labels fit, only the base rules decide; several labels
of a document count as the lowest; a score equal to the threshold rejects;
equal statistics have equal scores; repeated rows give repeated rows; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import rows_of

#: At most so many labelled rows (those with the smallest hashes of their ids) are learnt from.
LEARN_ROWS = 8000
TREES, TREE_ROWS = 100, 256
#: A limit lies beyond the largest usual value by this much of that value's distance from the median.
MARGIN = 1.0

SYMBOLS, BLANKS = b"#*$%&|<>", bytes([0x20, *range(0x09, 0x0E)])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each is larger in worse texts.
FEATURES = ("symbols_per_char", "dup_lines_per_line", "repeats_per_word", "chars_per_word", "words_per_new_word", "digits_per_char")

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and FEATURES of a text."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    chars = len(text) - len(raw) + len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines, seen, dup = raw.split(b"\n"), set(), 0
    for line in lines:
        if line.strip():
            dup += line in seen
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    repeat = 0
    if n > 5:
        mixed = sum(np.bitwise_xor(x := (ids[k : n - 4 + k] + np.uint64(1)) * _MIX[k], x >> np.uint64(29)) * _MIX[4 - k] for k in range(5))
        _, back, often = np.unique(mixed, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(often[back] > 1)
        if len(starts):
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + 5, -1)
            repeat = int((np.cumsum(cover) > 0).sum())
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    most = max(n, 1)
    return (n, chars, symbols, dup, repeat), (symbols / max(chars, 1), dup / max(len(seen) + dup, 1), repeat / most, min(chars / most, 50.0), n**0.8 / max(len(number), 1), digits / max(chars, 1))


def base_failed(counts) -> bool:
    n_words, *_, repeat = counts
    return n_words < 10 or 100 * repeat > 20 * n_words


class Forest:
    """Isolation trees as flat arrays: split feature (-1 at a leaf), split value, first child, path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        tree_rows = min(tree_rows, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(tree_rows, 2)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), tree_rows, replace=False)], rng) for _ in range(trees)]
        self.usual = self.average(tree_rows)

    @staticmethod
    def average(n: int) -> float:
        """Mean path length of an unsuccessful search in a binary search tree of n entries."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, value, child, length = [], [], [], []
        level = [(rows, 0)]
        at = 1
        while level:
            below = []
            for part, depth in level:
                spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
                length.append(depth + self.average(len(part)))
                if depth >= self.depth or len(part) < 2 or not len(spread):
                    feature.append(-1), value.append(0.0), child.append(0)
                    continue
                f = int(rng.choice(spread))
                v = rng.uniform(part[:, f].min(), part[:, f].max())
                feature.append(f), value.append(v), child.append(at)
                at += 2
                below += [(part[part[:, f] < v], depth + 1), (part[part[:, f] >= v], depth + 1)]
            level = below
        return np.array(feature), np.array(value), np.array(child), np.array(length)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1; usual rows have about 0.5 or less."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, value, child, length in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, child[node] + (rows[each, f] >= value[node]))
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(self.usual, 1e-9))


class Rules:
    """The usual limits of the features, a forest over what goes beyond them, and the score from which a document is rejected."""

    def __init__(self, limits: np.ndarray, forest: Forest | None, threshold: float):
        self.limits, self.forest, self.threshold = limits, forest, threshold

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.forest.scores(np.maximum(0, features - self.limits)) if self.forest and len(features) else np.zeros(len(features))


def fit(features: np.ndarray, good: np.ndarray, spare: float = 0.002) -> Rules:
    """Limits and trees from every second row, the threshold from the others.  Rows that fail the base rules don't belong here."""
    train = np.arange(len(good)) % 2 == 0
    if not (train & good).any() or not (~train & good).any():
        return Rules(np.zeros(len(FEATURES)), None, np.inf)
    usual = np.quantile(features[train & good], 1 - spare, axis=0)
    rules = Rules(usual + MARGIN * (usual - np.median(features[train & good], axis=0)), None, np.inf)
    rules.forest = Forest(np.maximum(0, features[train] - rules.limits))
    scores, good = rules.scores(features[~train]), good[~train]
    of_good = np.sort(scores[good])
    most_good = of_good[max(0, len(of_good) - 1 - int(spare * len(of_good)))]
    if len(bad_above := np.sort(scores[~good & (scores > most_good)])):
        rules.threshold = (most_good + bad_above[0]) / 2
    return rules


def _measure(df: DataFrame, id_col: str, text_col: str, rules: Rules | None) -> DataFrame:
    names = [*COUNTS, "base_failed", "anomaly", "kept"] if rules else [*FEATURES, "base_failed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, "i", "t")
        while part := [(i, *statistics(t or "")) for i, t in itertools.islice(rows, 1000)]:
            ids, counts, features = zip(*part, strict=True)
            features, failed = np.array(features), np.array([base_failed(c) for c in counts])
            if rules is None:
                yield pa.RecordBatch.from_pydict({"i": pa.array(ids, pa.int64()), **{n: features[:, k] for k, n in enumerate(FEATURES)}, "base_failed": failed})
                continue
            scores = rules.scores(features)
            columns = {n: pa.array([c[k] for c in counts], pa.int64()) for k, n in enumerate(COUNTS)}
            yield pa.RecordBatch.from_pydict({"i": pa.array(ids, pa.int64()), **columns, "base_failed": failed, "anomaly": scores, "kept": ~failed & (scores < rules.threshold)})

    kinds = ["long"] * 5 + ["boolean", "double", "boolean"] if rules else ["double"] * len(FEATURES) + ["boolean"]
    schema = ", ".join(["i long", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))])
    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("i", id_col)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_rows: int = LEARN_ROWS) -> Rules:
    """Rules from at most ``learn_rows`` labelled documents; a label of 1 is good, 0 bad."""
    drawn = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("d")).agg(F.min(label_col).alias("good")).orderBy(F.xxhash64("d"), "d").limit(learn_rows)
    part = df.join(F.broadcast(drawn), df[id_col] == drawn["d"], "left_semi")  # at most learn_rows rows are broadcast
    measured = _measure(part, id_col, text_col, None)
    rows = sorted(measured.where("not base_failed").join(F.broadcast(drawn), measured[id_col] == drawn["d"]).drop("d").collect(), key=lambda r: r[id_col])
    return fit(np.array([[r[n] for n in FEATURES] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["good"] == 1 for r in rows], bool))


def judge(df: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, base_failed, anomaly, kept) of every document."""
    return _measure(df, id_col, text_col, rules)
