import zlib

import numpy as np

from pyspark.sql import functions as F
from tessera.llm import packing


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_by_word_equals_whole_texts():
    texts = ["", "a b", " x\ty'll don't 12,3!! \x1c é́ Ñandú <|endoftext|> z.", "İstanbul. ΣΑΣ, ok.... Dž.  b", "can't.  they've!", "\n\n",
             "A b ć ﬁ 漢字。 ok;;", "x" * 300 + "."]
    ids, counts = packing.WordTokenizer(packing.default_tokenizer()).encode(texts, 2)
    ends = np.cumsum(counts)
    assert [ids[e - n:e].tolist() for e, n in zip(ends, counts)] == plain_ids(texts)


def test_pieces_with_one_hash_keep_their_own_ids():
    """Thue-Morse strings and their complements collide under any polynomial hash modulo 2^64."""
    for size in (1024, 2048, 4096):
        one = "".join("ab"[i.bit_count() & 1] for i in range(size))
        two = one.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer((one + two).encode(), dtype=np.uint8)
        h = packing._range_hashes(data, np.array([0, size]), np.array([size, 2 * size]))
        assert h[0] == h[1]
        t = packing.WordTokenizer(packing.default_tokenizer())
        for texts in ([one, two, "plain " + two, one + " " + two], [two, one], ["an ordinary text"]):
            ids, counts = t.encode(texts, 2)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == plain_ids(texts)


def test_hilbert_curve_moves_one_step_at_a_time():
    for dims, bits in ((2, 4), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def check_pieces(rows, docs):
    """Pieces and (id, text) pairs: every id once, sequences gapless and full but for the last."""
    want = sorted(zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) for ids in plain_ids([t for _, t in docs]))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    sizes = []
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert all(n == 4096 for n in sizes[:-1]) and (not sizes or 0 < sizes[-1] <= 4096)
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(sizes)
    return want


def test_query_returns_every_id_once(spark, documents):
    rows = packing.op2_pack_hilbert(documents).collect()
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    check_pieces(rows, list(docs.items()))
    ids = dict(zip(docs, plain_ids(docs.values())))
    seen = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(own) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}


def test_neighbours_on_the_curve_are_alike(spark, documents):
    """Copies follow each other: pieces of equal texts are next to each other in the stream."""
    doubled = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 10_000))
    tokens = packing.materialize(packing.tokenize(doubled, packing.default_tokenizer()), "t")
    place = {r["doc_id"]: r["sequence_id"] * 4096 + r["offset"] for r in packing.pack(tokens).collect() if r["start"] == 0}
    order = sorted(place, key=place.get)
    rank = {d: i for i, d in enumerate(order)}
    gaps = [abs(rank[d] - rank[d + 10_000]) for d in rank if d < 10_000]
    assert np.median(gaps) <= 3


def test_sequences_are_the_joined_pieces(spark, documents):
    tokens = packing.materialize(packing.tokenize(documents, packing.default_tokenizer()), "t")
    pieces = packing.materialize(packing.pack(tokens, capacity=512), "t")
    for r in packing.sequences(pieces).collect():
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= 512


def test_odd_rows(odd_documents, no_documents):
    rows = packing.op2_pack_hilbert(odd_documents).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    assert sum(r["start"] == 0 for r in rows) == 10
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2, 4)} == {1}
    assert packing.op2_pack_hilbert(no_documents).collect() == []
