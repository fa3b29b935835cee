import re
from collections import Counter

import corpus_pipeline as P
from brackwater.llm import mixing, packing, pii

from test_corpus import groups
from test_native import verdicts

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages_take_effect_one_after_another(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, last = docs.columns, None
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
        if name == "quality rules":
            rows = [(r["doc_id"], r["text"], None) for r in before.collect()]
            labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
            assert ids(docs) == Counter(i for i, _, kept, _ in verdicts(rows, labels) if kept) and 0 < docs.count() < before.count()
        if name == "near-duplicates":
            found = groups([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert ids(docs) == Counter(i for i, _, _, kept in found.elements() if kept)
            assert len({group for _, _, group, _ in found}) == docs.count()
        if name == "personal data":
            assert docs.filter("n_chars <> length(text)").count() == before.filter("n_chars <> length(text)").count() == 0
            assert ids(docs) == ids(before) and pii.find(docs).filter("size(pii.base) > 0").count() == 0
            plain = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in docs.collect():  # what stands between replaced spans is left alone
                parts = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|IBAN|SECRET|SSN|LOCAL_PHONE|MASKED_EMAIL)\]", r["text"] or "")
                assert re.fullmatch(".*?".join(map(re.escape, parts)), plain[r["doc_id"]] or "", re.S)
        if name == "mixing":
            sizes, words = Counter(), Counter()
            for r in before.collect():
                sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
            for r in docs.collect():
                words[r["source"]] += len(WORD.findall(r["text"]))
            order = sorted(sizes, key=lambda x: (x is None, x or ""))
            weight, left, open_, target = {x: (5, 2, 1)[n % 3] for n, x in enumerate(order)}, 1.5 * sum(sizes.values()), set(order), {}
            while open_ and (over := {x for x in open_ if weight[x] * left / sum(weight[y] for y in open_) > 2 * sizes[x]}):
                target |= {x: 2.0 * sizes[x] for x in over}
                left, open_ = left - sum(2.0 * sizes[x] for x in over), open_ - over
            target |= {x: weight[x] * left / sum(weight[y] for y in open_) for x in open_}
            assert all(abs(words[x] - target[x]) <= 1 for x in order)
            whole = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all(whole[r["doc_id"]] == r["text"] or WORD.findall(whole[r["doc_id"]])[: len(WORD.findall(r["text"]))] == WORD.findall(r["text"]) for r in docs.collect())
        if name == "packing":
            assert ids(docs) == ids(before)
            lengths = Counter(len(WORD.findall(r["text"] or "")) + 1 for r in before.collect())
            ends = sorted({r["bucket_length"] for r in docs.collect()})
            assert ends == packing.boundaries(sorted(lengths), [lengths[x] for x in sorted(lengths)], 16)
            assert all(r["bucket_length"] == min(e for e in ends if e >= r["n_tokens"]) for r in docs.collect())
        last = docs
    again = P.run(spark, sf_dir)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(again) == rows(last) and [n for n, _ in P.STAGES][-1] == "packing" 


def test_stages_on_empty_and_odd_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a b " * 40, None, None, 160), (2, "a b " * 40, None, None, 160)], docs.schema)
    for j, df in enumerate((docs, odd)):
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{j}-{k}")
            df = spark.read.parquet(f"{tmp_path}/{j}-{k}")
