import hashlib
import random

from tessera.llm import ctph


def plain_distance(a, b):
    """Edit distance with insertions and deletions, by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def some_text(seed, n=600):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(10 ** 6)}" for _ in range(n))


def test_edit_distance_equals_the_table():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(70))] for _ in range(2))
        both = len(a) + len(b)
        assert abs(ctph._alike(a, b) - (1 - plain_distance(a, b) / both if both else 0)) < 1e-12


def test_chunks_are_found_again_after_an_insertion():
    text = some_text(1)
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint("inserted words " + text)) > 0.9
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(some_text(2))) < 0.3
    long = some_text(5, 40_000)  # several stretches
    assert len(long) > 4 * ctph._STRETCH
    assert ctph.likeness(ctph.fingerprint(long), ctph.fingerprint("x" + long)) > 0.9


def test_compatible_block_sizes_only():
    text = some_text(1, 2000)
    one, two, four = (ctph.fingerprint(text[: len(text) * k // 4]) for k in (1, 2, 4))
    assert {int(f.split(":")[0]) for f in (one, two, four)} == {64, 128, 256} or len({f.split(":")[0] for f in (one, two, four)}) == 3
    assert ctph.likeness(one, four) == 0.0 and ctph.likeness(two, four) > 0.3 and ctph.likeness(four, two) == ctph.likeness(two, four)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        f, e, n = ctph.fingerprint(text), ctph.fingerprint(changed), ctph.fingerprint(after)
        out[doc] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), f, e, ctph.likeness(f, e), ctph.likeness(f, n))
    return out


def test_query_against_plain_loop(documents):
    got = {r["doc_id"]: tuple(r[1:]) for r in ctph.op4_ctph(documents).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert sum(v[4] > v[5] for v in got.values()) >= 0.98 * len(got)


def test_same_rows_in_one_range_and_in_many(spark, documents):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(ctph.op4_ctph(documents).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert sorted(ctph.op4_ctph(documents).collect()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = ctph.op4_ctph(odd_documents).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == "4::" and by_id[1]["near_next"] == 1.0
    assert by_id[0]["fingerprint"] == by_id[6]["fingerprint"] == by_id[None]["fingerprint"]
    assert by_id[7]["n_chars"] == 5007 and 0 <= by_id[3]["near_edited"] <= 1
    # The null id is last, and the first document follows it: equal texts.
    assert by_id[None]["near_next"] == 1.0 and by_id[None]["near_edited"] > 0
    assert ctph.op4_ctph(no_documents).collect() == []
    alone = ctph.op4_ctph(spark.createDataFrame([(9, "only document here")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 18
