import collections

import corpus_pipeline as pipeline

from tessera.llm import crf, mixing, pii, simhash
from tessera.llm.common import materialize


def test_stages_in_order():
    assert [f.__name__ for _, f in pipeline.STAGES] == ["language_stage", "near_duplicate_stage", "privacy_stage", "mixing_stage", "packing_stage"]


def test_each_stage_works_on_what_its_predecessor_kept(spark, sf, documents):
    """Every stage against its operator or brute force on the same input."""
    known = {r["doc_id"]: r for r in documents.collect()}

    docs = materialize(pipeline.language_stage(spark, documents, sf), "t")
    assert docs.columns == documents.columns
    labelled = crf.predict(documents, crf.learn(documents)).collect()
    assert {r["doc_id"] for r in docs.collect()} == {
        r["doc_id"] for r in labelled if r["lang_pred"] != "und" and r["score"] >= pipeline.LEAST_LANGUAGE_SCORE}
    assert docs.count() >= 0.97 * documents.count()

    single = materialize(pipeline.near_duplicate_stage(spark, docs, sf), "t")
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in docs.collect()}
    low = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps.items():
            for j, b in fps.items():
                if low[j] < low[i] and (a ^ b).bit_count() <= 4:
                    low[i], changed = low[j], True
    assert single.columns == documents.columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(low.values()))

    private = materialize(pipeline.privacy_stage(spark, single, sf), "t")
    want = {r["doc_id"]: r["text"] for r in pii.replace_pii(single, pii.session_key(spark)).collect()}
    assert private.columns == documents.columns and {r["doc_id"]: r["text"] for r in private.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["source"] == known[r["doc_id"]]["source"] for r in private.collect())

    mixed = materialize(pipeline.mixing_stage(spark, private, sf), "t")
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert copies == {r["doc_id"]: r["copies"] for r in mixing.mix(private).collect() if r["copies"]}

    pieces = materialize(pipeline.packing_stage(spark, mixed, sf), "t").collect()
    assert collections.Counter(r["doc_id"] for r in pieces if r["start"] == 0) == copies
    sizes = collections.Counter()
    for r in pieces:
        sizes[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert sorted(sizes.values())[1:] == [4096] * (len(sizes) - 1)


def test_run_gives_the_same_rows_again(spark, sf):
    rows = sorted(pipeline.run(spark, sf).drop("ids").collect())
    assert rows and rows == sorted(pipeline.run(spark, sf).drop("ids").collect())


def test_odd_and_no_documents(spark, sf, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        docs = docs.drop("score", "fp", "size").withColumn("n_chars", docs["doc_id"])
        for _, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), "t")
        assert docs.count() > 0 or docs.isEmpty()
