import itertools
import random
import zlib

import numpy as np

from tessera.llm import toxicity as tox


def grammar():
    return tox.Grammar({"idiot": 1.0}, {"blur": 0.5})


def pattern_of(text):
    found = grammar().patterns(text)
    return {p: round(float(found[i]), 3) for p, i in tox.PLACE.items() if found[i]}


def test_clauses_not_isolated_words():
    assert pattern_of("What an idiot. You see.") == {("insult", False, False, False): 1.0}
    assert pattern_of("You are an idiot.") == {("insult", True, False, False): 1.0}
    assert pattern_of("An idiot, you know") == {("insult", True, False, False): 1.0}
    assert pattern_of("Not an idiot at all") == {("insult", False, True, False): 1.0}
    assert pattern_of("Not one of all of those idiot things") == {("insult", False, False, False): 1.0}  # out of the negation's reach
    assert pattern_of('The label "idiot" appears') == {("insult", False, False, True): 1.0}
    assert pattern_of('The "label" idiot appears') == {("insult", False, False, False): 1.0}
    assert pattern_of("She said you are not an idiot") == {("insult", True, True, True): 1.0}
    assert pattern_of("I will kill you! idiot blurring") == {("threat", True, False, False): 1.0, ("insult", False, False, False): 1.5}
    assert pattern_of("idiotic blur skill overkill kill-joy") == {("violence", False, False, False): 1.0}
    assert pattern_of(None) == pattern_of("") == pattern_of("nothing here") == {}


def test_threats_need_subject_verb_and_object():
    assert pattern_of("We are gonna strangle them") == {("threat", True, False, False): 1.0}
    assert pattern_of("They kill time") == {("violence", True, False, False): 1.0}
    assert pattern_of("I will kill the lights") == {("violence", False, False, False): 1.0}  # no person as object
    assert pattern_of("Kill the process. You wait.") == {("violence", False, False, False): 1.0}  # the person is in the next clause


def test_reported_speech_goes_over_clause_ends():
    direct, reported = {("insult", True, False, False): 1.0}, {("insult", True, False, True): 1.0}
    assert pattern_of("He said: you are an idiot.") == reported
    assert pattern_of('"Go away. You idiot," he wrote.') == reported
    assert pattern_of("„Geh weg!\nDu idiot“, rief jemand.") == reported
    assert pattern_of("He said: go. You are an idiot.") == direct  # the sentence that the colon introduced is over
    assert pattern_of('"Go away." You idiot.') == direct
    assert pattern_of('An unclosed " mark.\n\nYou idiot.') == direct  # a quotation ends with its paragraph
    assert pattern_of("Note: you are an idiot") == direct


def test_composition_equals_running_the_machines_side_by_side():
    rng = random.Random(0)
    for whole, machines in ((tox.FORWARD, (tox.INSULTING, tox.THREATENING, tox.AIMED, tox.NEGATED, tox.REPORTED)), (tox.BACKWARD, (tox.AIMED, tox.OBJECT))):
        for _ in range(200):
            classes = [rng.randrange(tox.CLASSES) for _ in range(rng.randrange(14))]
            alone = [m.run(classes) for m in machines]
            want = [(rows[0][0], tuple(itertools.chain(*(out for _, out in rows)))) for rows in zip(*alone)]
            assert whole.run(classes) == want


def test_the_target_comes_from_the_machine_in_both_directions():
    """Against a plain rule: some target stands in the clause of the term."""
    rng = random.Random(2)
    for _ in range(300):
        classes = [rng.choice([tox.WORD, tox.INSULT, tox.TARGET, tox.END, tox.COLON, tox.SAID]) for _ in range(rng.randrange(1, 25))]
        for i, (_, aimed, _, _) in tox.read(classes):
            a = max((j for j in range(i) if classes[j] in (tox.END, tox.COLON)), default=-1) + 1
            b = next((j for j in range(i, len(classes)) if classes[j] in (tox.END, tox.COLON)), len(classes))
            assert aimed == (tox.TARGET in classes[a:b])


def test_long_labelled_texts_are_learned_by_excerpt(spark):
    rows = [(i, ("plain words here " * 2000 + "zork ") if i % 2 else f"plain words number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = tox.fit
    try:
        tox.fit = lambda texts, toxic: seen.extend(texts) or plain(texts, toxic)
        tox.learn(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    finally:
        tox.fit = plain
    learned = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows)
    assert len(seen) == learned and max(len(t) for t in seen) == tox.EXCERPT


def test_terms_are_learned_by_contexts_and_not_by_copies():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts, toxic = [], []
    for _ in range(60):
        texts.append(" ".join([*(word() for _ in range(20)), "zork", *(word() for _ in range(9)), "grumpf" + word()]))
        toxic.append(1)
    texts += ["copied uniquely here with xylophone inside"] * 40
    toxic += [1] * 40
    for _ in range(300):
        texts.append(" ".join(word() for _ in range(30)))
        toxic.append(0)
    words, stems = tox.learn_terms(texts, toxic)
    assert "zork" in words and "grumpf" in stems and "xylophone" not in words and not any("xylophone".startswith(s) for s in stems)
    g = tox.fit(texts, toxic)
    score = g.score(np.stack([g.patterns(t) for t in ("aaaa zork bbbb grumpfel cccc", "aaaa bbbb", None)]))
    assert score[0] > 0.9 and score[1] < 0.3 and score[1] == score[2]


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.op8_toxicity_grammar(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    score, label, guess = (np.array(x) for x in zip(*held))
    assert auc(score, label) > 0.93
    assert (guess[label == 0] == 0).mean() > 0.99 and (guess[label == 1] == 1).mean() > 0.85


def test_the_held_out_fold_is_not_learned_from(spark):
    rows = [(i, f"plain text number {i} zork{i % 7} here") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, int(i in held)) for i, _ in rows], "doc_id long, toxic int")
    learned = tox.learn(docs, labels)
    assert not learned.stems and set(learned.words) <= tox.INSULTS


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    rows = tox.op8_toxicity_grammar(odd_documents, labels).collect()
    assert len(rows) == 10 and len({r["score"] for r in rows if r["doc_id"] in (1, 2, 4, 5)}) == 1
    assert tox.op8_toxicity_grammar(no_documents, labels).collect() == []
    assert len(tox.op8_toxicity_grammar(odd_documents, labels.where("false")).collect()) == 10
