import itertools
import zlib

import numpy as np

from tessera.llm import crf


def test_forward_backward_equals_all_paths():
    rng = np.random.RandomState(0)
    for length in (1, 2, 5):
        scores, moves, start = rng.randn(length, 3), rng.randn(3, 3), rng.randn(3)
        weight = np.zeros((length, 3))
        pairs = np.zeros((3, 3))
        total = 0.0
        for path in itertools.product(range(3), repeat=length):
            w = np.exp(start[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                weight[i, y] += w
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w
        got, moved, first = crf.marginals(scores, np.array([length]), moves, start, pairs=True)
        assert np.allclose(got, weight / total) and np.allclose(moved, pairs / total) and np.allclose(first, weight[0] / total)


def test_chains_of_different_lengths_do_not_touch():
    rng = np.random.RandomState(1)
    scores, moves, start = rng.randn(12, 2), rng.randn(2, 2), rng.randn(2)
    lengths = np.array([3, 1, 6, 2])
    whole = crf.marginals(scores, lengths, moves, start)[0]
    at = 0
    for n in lengths:
        assert np.allclose(whole[at:at + n], crf.marginals(scores[at:at + n], np.array([n]), moves, start)[0])
        at += n


def test_words_of_code_switched_text():
    english = "the cat and the dog went with this thing into that house for nothing but the weather".split()
    german = "der hund und die katze gingen nicht mit diesem ding in das haus für nichts als wetter".split()
    rng = np.random.RandomState(2)
    texts, labels = [], []
    for _ in range(60):
        for words, name in ((english, "en"), (german, "de")):
            texts.append(" ".join(rng.permutation(words)))
            labels.append(name)
    model = crf.train(texts, labels)
    shares, counts = crf.label_words(model, ["the dog went into that house der hund und die katze gingen nicht"])
    guess = [model.languages[i] for i in shares.argmax(axis=1)]
    assert guess == ["en"] * 6 + ["de"] * 7 and counts.tolist() == [13]
    assert model.moves[0, 0] > model.moves[0, 1] and model.moves[1, 1] > model.moves[1, 0]


def test_features_do_not_depend_on_the_batch():
    one = [crf.word_features([w]) for w in ("a", "straße", "x" * 40)]
    grams, counts, whole = crf.word_features(["a", "straße", "x" * 40])
    assert [x[1][0] for x in one] == counts.tolist() and [x[2][0] for x in one] == whole.tolist()
    assert np.concatenate([x[0] for x in one]).tolist() == grams.tolist()


def test_held_out_accuracy(documents):
    rows = crf.op5_language_crf(documents).collect()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    model = crf.learn(odd_documents)
    out = crf.predict(odd_documents, model)
    assert out.columns.count("score") == 1 and set(odd_documents.columns) | {"lang_pred"} == set(out.columns)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 10
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0.0 for i in (1, 2, 4, 5))
    assert rows[0]["lang_pred"] in ("en", "de") and rows[3]["score"] > 0
    assert crf.learn(no_documents) is None and crf.predict(no_documents, None).collect() == []
    assert {r["lang_pred"] for r in crf.predict(odd_documents, None).collect()} == {"und"}
    nothing = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert crf.op5_language_crf(nothing).first()["lang_pred"] == "und"
