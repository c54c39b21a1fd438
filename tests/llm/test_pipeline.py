import re
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_ngramjoin import set_of
from veritab.llm import pii, quality
from veritab.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(docs.collect())
        assert docs.columns == columns or k == 4
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    verdicts = {r["doc_id"]: r["kept"] for r in QUERIES["op10_quality_rules"](spark, SF).collect()}
    kept = {i: t for i, t in start.items() if verdicts[i]}
    assert {r["doc_id"]: r["text"] for r in outs[0]} == kept
    first = {}
    for i, t in sorted(kept.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert {r["doc_id"]: r["text"] for r in outs[1]} == {i: kept[i] for i in first.values()}
    sets, left, group = {i: set_of(kept[i], 5) for i in first.values()}, defaultdict(set), {}
    for i in sorted(sets):
        for j in sets:
            if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                left[i].add(j)
    for i in sorted(sets):
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += left[x]
    assert {r["doc_id"] for r in outs[2]} == set(group.values())
    source = spark.createDataFrame([(r["doc_id"], r["text"]) for r in outs[2]], "doc_id long, text string")
    private = {r["doc_id"]: r["text"] for r in pii.pseudonymise(source).collect()}
    assert {r["doc_id"]: r["text"] for r in outs[3]} == private and all(r["n_chars"] == len(r["text"]) for r in outs[3])
    ids = defaultdict(list)
    for r in sorted(outs[4], key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    t = Tokenizer.from_file(vocabulary())
    assert ids == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in private.items()}


def test_odd_documents_pass_every_stage(spark, tmp_path):
    long = " ".join(f"w{k * k % 991}" for k in range(120))
    rows = [(None, None, None, None, None), (None, long, "en", "s", 5), (1, "", "en", "s", 0), (2, long, None, None, 9), (2, long, None, None, 9), (3, long + " more", "en", "s", 1), (3, "x" * 20_000, "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, SF).write.parquet(f"{tmp_path}/{empty}{k}")
            now = spark.read.parquet(f"{tmp_path}/{empty}{k}")
        assert {r["doc_id"] for r in now.collect()} == (set() if empty else {2})


def test_quality_query_agrees_with_its_base_checks(spark):
    for r in QUERIES["op10_quality_rules"](spark, SF).collect():
        assert r["base_failed"] == (r["n_words"] < quality.MIN_WORDS or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
