"""Context-triggered piecewise hashing of whole texts.

A rolling hash over the last seven bytes ends a chunk wherever it hits the block
size (chunks have a quarter of a block to four blocks); each chunk gives one symbol of 24 bits; a fingerprint is
``block:symbols at block:symbols at twice the block``.  Two fingerprints are
compared by edit distance (insertions and deletions; a change is both) at
compatible block sizes, that is equal ones or one twice the other, and
``likeness = 1 - distance / (symbols of both)``.

The block size starts where about 64 chunks are expected and is halved while
there are fewer than 32, down to 4.  Equal texts have equal fingerprints, and
equal fingerprints have likeness 1.

Defined cases: a null text is an empty one, whose fingerprint ``4::`` is like
itself only; ids are ordered ascending, nulls last, ties by a hash of the text;
repeated rows are documents of their own (next to each other); an only document
is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bucket_of, cut_points, shuffle_partitions
from tessera.session import ship_package

WINDOW = 7
LEAST_BLOCK = 4
EXPECTED, ENOUGH = 64, 32
DIGITS = 4  # base-64 digits of a symbol
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_MULTIPLIER = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Powers of both for positions inside a stretch of the text.
_STRETCH = 1 << 16


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_STRETCH, base, dtype=np.uint64)]))


_UP, _DOWN = _powers(_MULTIPLIER), _powers(_INVERSE)
_ASCII = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the last seven."""
    h = np.zeros(len(data), dtype=np.uint32)
    wide = data.astype(np.uint32)
    for k in range(min(WINDOW, len(data))):
        h[k:] += wide[: len(data) - k] * np.uint32(pow(0x01000193, k + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def _symbols(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 24-bit hash of each chunk; ``ends`` are the positions after the chunks' last bytes."""
    starts = np.concatenate([[0], ends[:-1]])
    total = np.zeros(len(ends), dtype=np.uint64)
    shift = 1
    stretch = pow(_MULTIPLIER, _STRETCH, 1 << 64)
    for at in range(0, len(data), _STRETCH):
        part = data[at:at + _STRETCH].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * _UP[: len(part)], dtype=np.uint64)])
        a, b = np.clip(starts - at, 0, len(part)), np.clip(ends - at, 0, len(part))
        total += (sums[b] - sums[a]) * np.uint64(shift)
        shift = shift * stretch % (1 << 64)
    # Bring every chunk to position 0: multiply by the inverse power of its start.
    blocks, rest = starts // _STRETCH, starts % _STRETCH
    back = np.array([pow(_INVERSE, int(k) * _STRETCH, 1 << 64) for k in range(int(blocks.max(initial=0)) + 1)], dtype=np.uint64)
    total *= back[blocks] * _DOWN[rest]
    total += (ends - starts).astype(np.uint64)
    return (_mixed(total) >> np.uint64(40)).astype(np.uint32)


def _ends(hits: np.ndarray, n: int, block: int) -> np.ndarray:
    """Chunk ends from the hits: chunks of a quarter of the block at least, so that a short period that always hits does not
    flood the fingerprint, and of four blocks at most, so that one that never hits is not a single symbol."""
    least, most = block // 4, 4 * block
    ends = hits + 1
    if len(ends) and (np.diff(ends, prepend=0) < least).any():
        kept, last = [], 0
        for e in ends.tolist():
            if e - last >= least:
                kept.append(e)
                last = e
        ends = np.array(kept, dtype=np.int64)
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    pieces = -(-(ends - starts) // most)
    if pieces.max() == 1:
        return ends
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
    return np.minimum(np.repeat(starts, pieces) + step * most, np.repeat(ends, pieces))


def _written(symbols: np.ndarray) -> str:
    digits = (symbols[:, None] >> np.array([18, 12, 6, 0], dtype=np.uint32)) & np.uint32(63)
    return _ASCII[digits].tobytes().decode()


def fingerprint_bytes(raw: bytes) -> str:
    data = np.frombuffer(raw, dtype=np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    hashes = _rolling(data)
    block = LEAST_BLOCK
    while block * EXPECTED < n:
        block *= 2
    hits = np.flatnonzero(hashes & np.uint32(LEAST_BLOCK - 1) == 0)  # those of any block are among them
    chosen = hashes[hits]
    while True:
        at = hits[chosen & np.uint32(block - 1) == 0]
        if len(at) + 1 >= ENOUGH or block == LEAST_BLOCK:
            break
        block //= 2
    twice = hits[chosen & np.uint32(2 * block - 1) == 0]
    parts = [_written(_symbols(data, _ends(cut, n, size))) for cut, size in ((at, block), (twice, 2 * block))]
    return f"{block}:{parts[0]}:{parts[1]}"


def _parsed(fingerprint: str) -> tuple[int, list[str], list[str]]:
    block, one, two = fingerprint.split(":")
    return int(block), [one[i:i + DIGITS] for i in range(0, len(one), DIGITS)], [two[i:i + DIGITS] for i in range(0, len(two), DIGITS)]


def _kept(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    where: dict[str, int] = {}
    for i, s in enumerate(a):
        where[s] = where.get(s, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for s in b:
        hit = row & where.get(s, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: list[str], b: list[str]) -> float:
    both = len(a) + len(b)
    distance = both - 2 * _kept(a, b)
    return 1.0 - distance / both if both else 0.0


def likeness(x: str, y: str) -> float:
    """0 to 1: one less the edit distance for each symbol, at the compatible block size where it is higher."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = _parsed(x), _parsed(y)
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2))
    if bx == 2 * by:
        return _alike(x1, y2)
    if by == 2 * bx:
        return _alike(x2, y1)
    return 0.0


def fingerprint(text: str | None) -> str:
    return fingerprint_bytes((text or "").encode("utf-8", "surrogatepass"))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, each, schema: T.StructType, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Map every document with the next one by id: ``each(ids, texts, following) -> list of column lists`` over slices.

    Ranges of ids go to one task each.  A task also gets a copy of the first row
    of the following range (of the first range for the last), so it needs no
    other task's rows.  What the driver holds is one id and hash a range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))  # nulls last
    parts = shuffle_partitions(spark)
    cuts = cut_points(base.select(order.alias("o")), "o", parts)
    dealt = base.withColumn("o", order).withColumn("h", F.xxhash64("text"))
    dealt = dealt.withColumn("part", bucket_of("o", cuts))
    # Ranges and their first rows, from the ids alone; the hash is needed for equal ids only.
    firsts = {r["part"]: r["f"] for r in dealt.groupBy("part").agg(F.min("o").alias("f")).collect()}  # at most `parts` rows
    filled = sorted(firsts)
    previous = {firsts[p]: filled[i - 1] for i, p in enumerate(filled)}
    to = F.create_map(*[F.lit(x) for kv in previous.items() for x in kv]) if previous else F.create_map(F.lit(0).cast("long"), F.lit(0))
    heads = dealt.where(F.col("o").isin(list(previous))).withColumn("part", F.element_at(to, F.col("o")))
    rows = dealt.withColumn("head", F.lit(0)).unionByName(heads.withColumn("head", F.lit(1)))

    def run(batches):
        held_id, held_text, done = None, None, False
        for batch in batches:
            ids, texts, head = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if done or not texts:
                continue
            stop = head.index(1) + 1 if 1 in head else len(texts)
            done = 1 in head
            all_ids = ids.slice(0, stop) if held_id is None else pa.concat_arrays([held_id, ids.slice(0, stop)])
            all_texts = texts[:stop] if held_id is None else [held_text, *texts[:stop]]
            for a in range(0, len(all_texts) - 1, 256):
                b = min(a + 256, len(all_texts) - 1)
                yield each(all_ids.slice(a, b - a), all_texts[a:b], all_texts[a + 1:b + 1])
            held_id, held_text = all_ids.slice(len(all_texts) - 1, 1), all_texts[-1]

    own = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "head", "o", "h")
    return own.select("doc_id", "text", "head").mapInArrow(run, schema)


def edit_probe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to the edited text and to the next document."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def each(ids, texts, following):
        prints = [fingerprint(t) for t in [*texts, following[-1]]]
        changed = [edited(t, f).encode("utf-8", "surrogatepass") for t, f in zip(texts, following)]
        after = [fingerprint_bytes(c) for c in changed]
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array(prints[:-1]),
            pa.array(after), pa.array([likeness(x, y) for x, y in zip(prints, after)], pa.float64()),
            pa.array([likeness(x, y) for x, y in zip(prints, prints[1:])], pa.float64())], names=schema.names)

    return neighbours(docs, each, schema, text, doc_id)


def op4_ctph(docs: DataFrame) -> DataFrame:
    return edit_probe(docs)
