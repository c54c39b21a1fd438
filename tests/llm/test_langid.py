import numpy as np
from pyspark.sql import functions as F

from veritab.llm import langid


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).join(docs.withColumnRenamed("doc_id", "id"), "id").withColumn("out", langid.held_out(F.col("id"))).collect()
    test = [r for r in rows if r["out"]]
    right = [r["lang_pred"] == r["lang"] for r in test]
    assert len(test) > 200 and np.mean(right) > 0.98
    assert abs(np.mean([r["score"] for r in test]) - np.mean(right)) < 0.1 and all(0 <= r["score"] <= 1 for r in rows)
    assert (model.weights != 0).mean() < 0.5


def test_defined_cases(spark):
    kinds = "doc_id long, text string, lang string, letters boolean"
    rows = [(k, t, x, True) for k in range(40) for t, x in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    odd = [(None, None, "en", True), (-1, "", None, True), (-2, "123 !?", "de", True), (-3, "the " * 90_000, None, False), (-4, "a", None, None)]
    docs = spark.createDataFrame(rows + odd, kinds)
    got = {r["id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [got[k]["lang_pred"] for k in (None, -1, -2)] == ["und"] * 3 and got[-3]["lang_pred"] == "en" and got[-4]["lang_pred"] in ("en", "de")
    empty = docs.limit(0)
    assert langid.fit(empty) is None and langid.predict(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, langid.fit(docs)).count() == 0


def test_blocks_do_not_change_counts(monkeypatch):
    text = "Ein längerer Text " * 300
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 101)
    assert np.array_equal(langid.counts(text), whole) and whole.sum() == 3 * (len(text) + 2) - 3


def test_the_sample_is_bounded_for_any_ids(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_ROWS", 50)
    monkeypatch.setattr(langid, "CALIBRATE_ROWS", 10)
    rows = [(7, f"text {k}", "en") for k in range(3000)] + [(None, f"wort {k}", "de") for k in range(3000)] + [(8, "copy", "fr")] * 500 + [(9, f"t{k}", "es") for k in range(12)]
    got = langid._sample(spark.createDataFrame(rows, "id long, text string, lang string").repartition(6)).collect()
    count = lambda lang, use: sum(r["lang"] == lang and r["use"] == use for r in got)
    assert all((count(x, "fit"), count(x, "calibrate")) == (50, 10) for x in ("en", "de", "fr")) and (count("es", "fit"), count("es", "calibrate")) == (10, 2)


def test_training_is_plain_follow_the_regularised_leader():
    import pyarrow as pa

    labels, rows = ["a", "b"], [("abab", "a"), ("bcbc", "b"), ("abac", "a"), ("ccb", "b"), ("aab", "a")]
    idf = np.linspace(1, 2, langid.DIM)
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [x for _, x in rows]})
    out = next(iter(langid._train(labels, idf)(iter([batch])))).to_pylist()
    got = {(r["bucket"], r["label"]): r["w"] for r in out if r["bucket"] >= 0}
    z, g2, order = {}, {}, np.random.default_rng(4)

    def weight(i, k):
        s = z.get((i, k), 0.0)
        return 0.0 if abs(s) <= langid.L1 else -(s - np.sign(s) * langid.L1) / ((langid.BETA + np.sqrt(g2.get((i, k), 0.0))) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for j in order.permutation(len(rows)):
            n = langid.counts(rows[j][0])
            x = {int(i): langid.SCALE * n[i] / n.sum() * idf[i] for i in np.flatnonzero(n)} | {langid.DIM: 1.0}
            p = langid.softmax(np.array([sum(v * weight(i, k) for i, v in x.items()) for k in (0, 1)]))
            for i, v in x.items():
                for k in (0, 1):
                    w, g, old = weight(i, k), v * (p[k] - (labels[k] == rows[j][1])), g2.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / langid.ALPHA * w
                    g2[i, k] = old + g * g
    want = {key: weight(*key) for key in z if weight(*key)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
