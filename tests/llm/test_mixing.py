import re

from pyspark.sql import functions as F

from tessera.llm import mixing


def plain_targets(sizes, weights, budget, most):
    """Share, cap, and share the excess again among those below their caps, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: most * n for s, n in sizes.items()}
    full = set()
    while True:
        free = [s for s in order if s not in full]
        rest = budget * sum(sizes.values()) - sum(cap[s] for s in full)
        total = sum(weight[s] for s in free)
        target = {s: cap[s] if s in full else rest * weight[s] / total for s in order}
        above = {s for s in free if target[s] > cap[s] * (1 + 1e-12)}
        if not above:
            return target
        full |= above


def sizes_of(rows):
    out = {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        out[r["source"]] = out.get(r["source"], 0) + n
    return out


def test_query_against_plain_resharing(documents):
    rows = documents.collect()
    sizes = sizes_of(rows)
    target = plain_targets(sizes, (3, 1, 2), 1.5, 2)
    got = {r["doc_id"]: r for r in mixing.op9_mix_sources(documents).collect()}
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        g = got[r["doc_id"]]
        assert g["source_size"] == sizes[r["source"]] and abs(g["target"] - target[r["source"]]) < 1e-6 * (1 + g["target"])
        assert g["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and g["taken"] <= 2 * g["size"]
        rate = g["target"] / g["source_size"]
        assert g["taken"] in (int(rate) * g["size"], (int(rate) + 1) * g["size"])
        taken[r["source"]] += g["taken"]
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.1


def test_reruns_agree(documents):
    assert sorted(mixing.op9_mix_sources(documents).collect()) == sorted(mixing.op9_mix_sources(documents.repartition(7)).collect())


def test_many_sources_in_code_point_order(spark):
    names = [None, "", "a", "B", "é", "z", "\U0001d11e", "￮", "aa", "Z"] + [f"s{i}" for i in range(40)]
    rows = [(i, "w " * (1 + i * 37 % 50), n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain_targets(sizes_of(df.collect()), (3, 1, 2), 1.5, 2)
    for r in mixing.mix(df).collect():
        assert abs(r["target"] - want[r["source"]]) < 1e-9 * (1 + r["target"])


def test_copies_are_emitted(spark):
    rows = [(i, "one two three four", "big" if i % 2 else "small") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    want = mixed.agg(F.sum("copies")).first()[0]
    out = mixing.emit(mixed, df.columns)
    assert out.columns == df.columns and out.count() == want and 400 < want < 800
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2


def test_odd_rows(spark, odd_documents, no_documents):
    out = mixing.mix(odd_documents)
    assert out.columns.count("size") == 1 and set(odd_documents.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == 10 and {r["size"] for r in rows if r["doc_id"] in (1, 2, 4)} == {0}
    assert all(r["copies"] >= 0 and r["rate"] <= 2 for r in rows)
    assert len({r["copies"] for r in rows if r["doc_id"] == 6}) == 1
    assert mixing.mix(no_documents).collect() == [] and mixing.op9_mix_sources(no_documents).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.op9_mix_sources(empty).collect()] == [(0.0, 0), (0.0, 0)]


def test_native_plan(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
