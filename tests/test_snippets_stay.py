"""Snippets are found where the texts are: no row for a word is shuffled."""

import random
import re

from pyspark.sql import functions as F

from glyphmill.operators import postings
from tests.test_blocks import shuffled

WEIGHTS = {"aa": 3, "ab": 2, "aba": 2, "b": 1}


def slow(text, width):
    best = None
    for n, line in enumerate(text.split("\n")):
        parts = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+|[\W_]+", line)]
        matches = [(a, b, WEIGHTS[p.lower()]) for a, b, p in parts if p.lower() in WEIGHTS]
        for a, *_ in matches:
            own = [w for x, y, w in matches if x >= a and (y <= a + width or x == a)]
            body = "".join(p for x, y, p in parts if x >= a and (y <= a + width or x == a))
            found = (-sum(own), n, a, len(own), ("[...]" if a else "") + body + ("[...]" if a + len(body) < len(line) else ""))
            best = min(best or found, found)
    return best and best[1:]


def test_only_snippets_are_shuffled(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abAB\U00010400é", [8, 6, 2, 2, 1, 1], k=rng.randint(1, 4)))
    texts = ["".join(word() + rng.choice([" ", " ", ", ", "-", "\n", "\r\n", " \n\n"]) for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(120)]
    df = spark.createDataFrame([*enumerate(texts), (500, None), (501, "\n"), (502, "ab")], "doc long, text string")
    for width in (1, 12, 60):
        sent, got = shuffled(spark, lambda width=width: {r.doc: (r.line, r.start, r.n_matches, r.snippet) for r in postings.snippets(df, "doc", "text", F.lower, WEIGHTS, width).collect()})
        want = {k: slow(t, width) for k, t in [*enumerate(texts), (502, "ab")]}
        assert got == {k: v for k, v in want.items() if v}
        assert sent < 400  # of more than 10,000 words
