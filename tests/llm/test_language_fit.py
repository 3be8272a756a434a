"""Texts that fit no learnt language go, all others stay."""

import random

import numpy as np

import corpus_pipeline
from glyphmill.llm import langmix

DATA = "/root/testdata/sf0.01"

FOREIGN = [
    "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства.",
    "いろはにほへと ちりぬるを わかよたれそ つねならむ うゐのおくやま けふこえて",
    "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία, και όλα τα άλλα που δεν ξέρω",
    "qzxj vwkp zzkq jxvq wqkz pxjv kqzw vjxq kzqj xwvp",
    "".join(random.Random(1).choices("bcdfghjklmnpqrstvwxz  ", k=800)),
]


def test_foreign_texts_and_gibberish_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    strange = spark.createDataFrame([(-1 - k, t, None, "s", len(t)) for k, t in enumerate(FOREIGN)], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(strange), DATA).select("doc_id").collect()}
    assert not [i for i in got if i < 0]
    lettered = {r.doc_id for r in docs.collect() if langmix._LETTER.search(r.text or "")}
    assert got == lettered  # every document of the table is in one of its four languages


def test_fit_is_the_mean_log_likelihood(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    model = langmix.learn(docs)
    for r in langmix.predict(docs.limit(20), model).collect():
        counts = langmix.trigram_counts(r.text)
        p = sum(s * model.probs[model.names.index(k)] for k, s in r.mixture.items())
        assert abs(r.fit - sum(n * float(x) for n, x in zip(counts, np.log(p), strict=True)) / counts.sum()) < 1e-9
    assert langmix.least_fit(docs.limit(50), model) == float("-inf")
    assert langmix.least_fit(docs.limit(0), langmix.learn(docs.limit(0))) == float("-inf")
    assert langmix.predict(spark.createDataFrame([(1, None), (2, "1 2")], "doc_id long, text string"), model).where("fit is null and score = 0").count() == 2


def test_models_and_limit_come_from_all_labelled_texts(spark):
    pick, words = random.Random(3), ["casa", "perro", "verde", "luna", "tres", "mesa"]
    texts = [" ".join(pick.choices(words, k=8)) for _ in range(26_000)]
    odd = pick.sample(range(len(texts)), 60)
    for n, k in enumerate(odd):  # ever less of a text is in the language
        texts[k] = "".join(pick.choices("bcdfghjklm", k=n + 5)) + " " + texts[k]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'xx' as lang")
    model = langmix.learn(docs)
    counts = sum(map(langmix.trigram_counts, texts)) + 0.5
    assert model.names == ["xx"] and np.array_equal(model.probs, (counts / counts.sum())[None])
    fits = np.sort([model.infer_with_fit(t)[1] for t in texts])
    least = np.floor(fits[26 - 1] * langmix.FIT_STEPS) / langmix.FIT_STEPS  # 0.1 % of the texts fit no better
    assert langmix.least_fit(docs, model) == langmix.least_fit(docs.repartition(7), model) == (least + np.log(model.probs).mean(axis=1).max()) / 2
