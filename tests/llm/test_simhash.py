import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def slow_fingerprint(text, n=4):
    """The definition, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=4):
    """Smallest row of each component of (row, fingerprint), by comparing all pairs."""
    low = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps.items():
            for j, b in fps.items():
                if (a ^ b).bit_count() <= radius and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_fingerprint_is_the_definition():
    for text in [None, "", " ", "one", "One two THREE", "a b c d", "a b c d e a b c d", "É é À\x0bb\x1cc d e f", "x " * 300]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_query_against_all_pairs(spark, documents):
    rows = {r["doc_id"]: r for r in simhash.op1_simhash_bk(documents).collect()}
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in documents.collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in rows.items()} == fps
    assert all(len(r["fingerprint"]) == 16 for r in rows.values())
    assert {i: r["component_id"] for i, r in rows.items()} == slow_components(fps)


def test_bk_tree_finds_all_neighbours():
    rng = np.random.RandomState(0)
    base = rng.randint(0, 2 ** 63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.randint(0, 64, 20).astype(np.uint64)) for _ in range(20)]))
    found = {(int(q), int(t)) for near, t in simhash.BkTree(values).search(values, 4) for q in near}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 4}
    assert found == want


def test_every_close_pair_shares_a_shard():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in simhash.bands(4))


def test_split_shards_lose_no_link(spark):
    """A chain of neighbours and a large ball around one value, in trees of five members at most."""
    rng = random.Random(2)
    center = rng.getrandbits(64)
    values = {center} | {center ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    step = rng.getrandbits(64)
    for i in range(0, 40, 4):
        step ^= 0b1111 << i
        values.add(step)
    values |= {rng.getrandbits(64) for _ in range(30)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(i, signed(v)) for i, v in enumerate(sorted(values))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    want = slow_components({i: v % (1 << 64) for i, v in rows})
    for size in (5, 8192):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, shard_size=size).collect()}
        assert got == want


def test_too_few_rounds_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        simhash.components(edges, rounds=2)
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_odd_rows(spark, odd_documents, no_documents):
    rows = simhash.op1_simhash_bk(odd_documents).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == "0" * 16 and by_id[4]["component_id"] == 1
    assert by_id[None]["component_id"] == 0 and by_id[6]["component_id"] == 0
    assert simhash.op1_simhash_bk(no_documents).collect() == []
    only_null = spark.createDataFrame([(None, "a b c d e")], "doc_id long, text string")
    assert simhash.op1_simhash_bk(only_null).first()["component_id"] is None


def test_keep_one_of_each_component(odd_documents):
    out = simhash.keep_one(odd_documents)
    assert out.columns == odd_documents.columns
    kept = out.collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(0) == 1 and 6 not in ids and None not in ids and ids.count(1) == 1
