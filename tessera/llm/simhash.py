"""SimHash near-duplicates by BK-trees.

Fingerprints are made for every whole text; equal fingerprints are merged first,
so a group of copies costs one entry.  The distinct fingerprints are dealt to
shards: 64 bits are cut into ``radius + 2`` bands, and two fingerprints within
``radius`` bits agree in at least two of them, so a shard is one pair of bands
with its bits and a pair of neighbours always meets in a shard.  Each shard is a
BK-tree (children keyed by the integer Hamming distance to the parent); a search
follows only the edges within the radius of the distance to the node.  A shard
that is larger than ``shard_size`` is split into several trees and its members
are sent to each of them, so no task holds more than one tree.  A task emits a
spanning set of the links that it finds, never all pairs of a group.

Components come from alternating large-star and small-star steps over the links.

Defined cases: a null text is like an empty one (fingerprint zero); a null id
never becomes a component id while the component has an id, and is null if it
has none; rows are never merged, so repeated rows and ids keep one result row
each; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessera.llm.common import materialize

SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD_SIZE = 8192
#: Parts of a join key that may be hot (the centre of a large component).
SALTS = 16
P = "__sim_"

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text as an unsigned integer."""
    import xxhash

    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text, shingle: int = SHINGLE):
    """The fingerprint as a signed long column."""

    @pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return simhash(text)


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def bands(radius: int) -> list[int]:
    """Masks of the band pairs: any two 64-bit values within ``radius`` bits agree under at least one mask."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in itertools.combinations(single, 2)]


class BkTree:
    """A BK-tree over an array of unsigned 64-bit values.

    The subtree of a node is an array of positions: the first is the node, the
    others are grouped by their distance to it.  Searches walk down together, a
    whole array of queries at a time.
    """

    def __init__(self, values: np.ndarray):
        self.values = values

    def search(self, queries: np.ndarray, radius: int):
        """Yield (positions of queries, position in the tree) for all pairs within the radius."""
        values = self.values
        todo = [(np.arange(len(values)), np.arange(len(queries)))]
        while todo:
            nodes, asked = todo.pop()
            root, rest = nodes[0], nodes[1:]
            far = np.bitwise_count(queries[asked] ^ values[root]).astype(np.int16)
            near = asked[far <= radius]
            if len(near):
                yield near, root
            if not len(rest):
                continue
            edges = np.bitwise_count(values[rest] ^ values[root]).astype(np.int16)
            order = np.argsort(edges, kind="stable")
            rest, edges = rest[order], edges[order]
            starts = np.flatnonzero(np.r_[True, edges[1:] != edges[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(edges)]):
                follow = asked[np.abs(far - edges[a]) <= radius]
                if len(follow):
                    todo.append((rest[a:b], follow))


def _spanning_links(tree: np.ndarray, asked: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (value, smallest value of its local component) that connect what the search connects."""
    if len(tree) == 2 and len(asked) == 2:  # the usual shard: a root and one child
        a, b = sorted((int(tree[0]), int(tree[1])))
        return [(b, a)] if (a ^ b).bit_count() <= radius else []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    for near, root in BkTree(tree).search(asked, radius):
        top = find(int(tree[root]))
        for q in asked[near].tolist():
            other = find(q)
            if other != top:
                low, high = (top, other) if top < other else (other, top)
                parent[high] = low
                top = low
    return [(x, find(x)) for x in list(parent) if find(x) != x]


def _shard_links(radius: int):
    def run(batches):
        held: list[pd.DataFrame] = []

        def finish(rows: pd.DataFrame):
            found = []
            key = rows[["band", "bits", "tree"]].to_numpy()
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            fps, own = rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy()
            for a, b in zip(cut, np.r_[cut[1:], len(rows)]):
                if b - a > 1:
                    found += _spanning_links(fps[a:b][own[a:b]], fps[a:b], radius)
            return pd.DataFrame({"a": np.array([x for x, _ in found], dtype=np.uint64).view(np.int64),
                                 "b": np.array([y for _, y in found], dtype=np.uint64).view(np.int64)})

        for batch in batches:
            if not len(batch):
                continue
            last = batch.iloc[-1][["band", "bits", "tree"]].to_list()
            same = ((batch["band"] == last[0]) & (batch["bits"] == last[1]) & (batch["tree"] == last[2])).to_numpy()
            head = batch[~same]
            if len(head):  # the shard that ends the batch may go on in the next one
                yield finish(pd.concat([*held, head]) if held else head)
                held = [batch[same]]
            elif held and held[-1].iloc[-1][["band", "bits", "tree"]].to_list() != last:
                yield finish(pd.concat(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield finish(pd.concat(held))

    return run


def links(fingerprints: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links ``a, b`` (signed longs) that connect all distinct values of ``fp`` within ``radius`` bits of each other."""
    masks = [m - (1 << 64) if m >> 63 else m for m in bands(radius)]
    shards = fingerprints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])).alias("s")
    ).select("fp", "s.band", "s.bits")
    # Only shards that need more than one tree; usually none, so that Spark sees a small table.
    large = shards.groupBy("band", "bits").agg(F.count("*").alias("n")).where(F.col("n") > shard_size).select(
        "band", "bits", F.ceil(F.col("n") / shard_size).cast("int").alias("trees"))
    dealt = shards.join(large, ["band", "bits"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("fp", F.lit("tree")), F.col("trees")).cast("int"))
    asked = dealt.select("fp", "band", "bits", "home", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    asked = asked.select("fp", "band", "bits", "tree", (F.col("home") == F.col("tree")).alias("own"))
    keys = ["band", "bits", "tree"]
    found = asked.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_shard_links(radius), "a long, b long")
    return found.distinct()


def with_fact(rows: DataFrame, facts: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """The rows joined to the one row of their key; a hash of ``by`` deals a key's rows to ``salts`` parts, so none is one task's input."""
    dealt = rows.withColumn(P + "salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = facts.withColumn(P + "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, P + "salt"]).drop(P + "salt")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node, root`` for all nodes of the links ``a, b``: alternating large-star and small-star steps until nothing changes."""
    unsigned = lambda c: F.col(c)  # noqa: E731  any total order serves
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    mark = None
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = with_fact(both, low, "a", "b").where(unsigned("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_fact(large, low, "a", "b").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
        small = small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        edges = materialize(small, "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still changed after {rounds} rounds; give more rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(fingerprinted: DataFrame, doc_id: str = "doc_id", fp: str = "fp", radius: int = RADIUS,
                    shard_size: int = SHARD_SIZE) -> DataFrame:
    """The rows with ``component_id`` (the smallest id reachable) and ``component_key`` (a fingerprint, the same in the whole component).

    ``fingerprinted`` is read more than once: pass a table or a materialised DataFrame.
    """
    rest = fingerprinted.drop(*[c for c in ("component_id", "component_key") if c not in (doc_id, fp)])
    distinct = rest.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("low"))
    roots = components(links(distinct.select("fp"), radius, shard_size))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("id"))
    named = materialize(with_fact(named, lowest, "root", "fp").select(
        F.col("fp").alias(P + "fp"), F.col("root").alias("component_key"), F.col("id").alias("component_id")), "sim-names")
    return rest.join(named, F.col(fp) == F.col(P + "fp")).drop(P + "fp")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, unchanged: the one with the smallest id (a row without an id only if none has one).

    Rows are told apart by 128 bits over all columns, so that only ids, fingerprints
    and these keys go through the search; texts are shuffled once, for the last join.
    """
    keys = {P + "k1": F.xxhash64(*docs.columns), P + "k2": F.xxhash64(F.lit("second"), *docs.columns)}
    slim = docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), shingle).alias("fp"), *[c.alias(k) for k, c in keys.items()])
    named = near_duplicates(materialize(slim, "sim-fps"), radius=radius)
    best = named.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("w"))
    best = materialize(best.select(*[F.col(f"w.{k}").alias(k) for k in keys]), "sim-kept")
    kept = docs.withColumns(keys).join(best, list(keys), "left_semi")
    return kept.dropDuplicates(list(keys)).select(*docs.columns)


def op1_simhash_bk(docs: DataFrame) -> DataFrame:
    fps = materialize(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp")), "sim-fps")
    return near_duplicates(fps).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
