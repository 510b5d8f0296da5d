"""Packing along a space-filling curve.

A document's tokens are hashed into a vector, the vector is projected to four
dimensions, and the Hilbert key of the projection orders the documents, so that
neighbours on the curve use similar words.  Ranges of keys (ties between copies
broken by a hash of the id, so a group of copies can be split) go to one task
each; with the token totals of the ranges every document knows its place in one
long stream, which is cut every ``capacity`` tokens.  Only the last sequence of
the whole stream is shorter.

Defined cases: a null text is an empty one, which is the end token alone; a null
id sorts first and stays null; repeated rows are packed once each; an empty
table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bucket_of, cut_points, materialize, shuffle_partitions
from tessera.session import ship_package

CAPACITY = 4096
END_ID = 2
DIMENSIONS, BITS, TIE_BITS = 4, 12, 14
BUCKETS = 256
#: Texts are tokenised in groups of about this many characters, and a worker remembers about this many pieces.
GROUP_CHARS, REMEMBERED = 400_000, 800_000

_TOKENIZERS: dict = {}
#: Letters that stay one letter in lower case, so that a word of them is one word to the tokenizer.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Of each byte: 0 blank, 1 letter, 2 mark that ends a clause, 3 other.
_KINDS = np.full(256, 3, dtype=np.uint8)
_KINDS[list(b" \t\n\r")] = 0
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KINDS[list(b".,;:!?")] = 2
_MULTIPLIER = 0x5851F42D4C957F2D
_POWERS: tuple = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


class WordTokenizer:
    """A tokenizer that never joins characters across white space: distinct pieces of text are encoded once.

    ``encode(text)`` equals the concatenation over the pieces between blanks,
    tabs and line ends, and between a letter and a mark after it, because the
    vocabulary's pre-tokenizer drops white space and parts letters from marks.
    Pieces are found and hashed (64 bits) with array operations on the bytes;
    only pieces with a new hash become strings.  Each piece is compared, byte by byte, with the remembered one of
    its hash; a text with a piece that differs is encoded whole.  Words of letters end with the
    one token that has the word-end mark, so that many are encoded in one call
    and parted there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)  # by ascending hash
        self.flat = np.zeros(0, np.uint32)
        self.text, self.text_start, self.text_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the bytes of each piece

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another and the number of each."""
        single = np.array([bool(_LETTERS.fullmatch(p)) for p in pieces], dtype=bool)
        words = [p for p, s in zip(pieces, single) if s]
        other = [p for p, s in zip(pieces, single) if not s]
        lines = [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]
        got = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.zeros(0, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            raise ValueError("the vocabulary does not mark the ends of words")
        each = [e.ids for e in self.tokenizer.encode_batch(other, add_special_tokens=False)]
        sizes, starts = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        sizes[single], sizes[~single] = np.diff(last, prepend=-1), [len(x) for x in each]
        starts[single] = np.cumsum(sizes[single]) - sizes[single]
        starts[~single] = len(ids) + np.cumsum(sizes[~single]) - sizes[~single]
        return np.concatenate([ids, np.array([i for x in each for i in x], dtype=np.uint32)]), np.stack([starts, sizes])

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, (starts, sizes) = self._ids(pieces)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.start, self.size = np.insert(self.start, at, starts + len(self.flat)), np.insert(self.size, at, sizes)  # fewer than 2**31 ids
        self.flat = np.concatenate([self.flat, ids])
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        self.text_start, self.text_size = np.insert(self.text_start, at, len(self.text) + np.cumsum(lengths) - lengths), np.insert(self.text_size, at, lengths)
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(raw), dtype=np.uint8)])

    def _differ(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Ranges of bytes that are not the remembered piece of the same hash."""
        size = stop - begin
        wrong = size != self.text_size[piece]
        own = np.flatnonzero(~wrong)
        if len(own):
            size, first = size[own], np.cumsum(size[own]) - size[own]
            step = np.arange(int(size.sum()))
            unlike = data[np.repeat(begin[own] - first, size) + step] != self.text[np.repeat(self.text_start[piece[own]] - first, size) + step]
            if unlike.any():
                wrong[own] = np.add.reduceat(unlike, first) > 0
        return np.flatnonzero(wrong)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end id after each, and the number of ids of each text."""
        odd = [i for i, t in enumerate(texts) if "<|" in t]  # may hold a special token, which is matched before lower-casing
        plain = [b"" if "<|" in t else t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() changes A-Z only
        ids, counts, unlike = self._encode_bytes(plain, end_id)
        odd = sorted({*odd, *unlike})
        if not odd:
            return ids, counts
        each = np.split(ids, np.cumsum(counts)[:-1])
        for i, e in zip(odd, self.tokenizer.encode_batch([texts[i] for i in odd], add_special_tokens=False)):
            each[i] = np.array([*e.ids, end_id], dtype=np.uint32)
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)

    def _encode_bytes(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """As ``encode``, and the texts with a piece that shares the hash of another one, whose ids are not right."""
        if len(self.hashes) > REMEMBERED:
            self.clear()
        raw = b"\n".join([b"", *texts, b""])  # so that each text stands between line ends
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = _KINDS[data]
        blank = kind == 0
        letter_end = kind == 1
        letter_end[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # Latin-1 letters
        parted = np.zeros(len(data), dtype=bool)
        parted[1:] = blank[:-1] | (kind[1:] == 2) & letter_end[:-1]
        begin = np.flatnonzero(parted & ~blank)
        last = np.flatnonzero(~blank[:-1] & (parted[1:] & ~blank[1:] | blank[1:]))
        stop = last + 1
        hashes = _range_hashes(data, begin, stop)
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        if not known.all():
            at = first[~known]
            self._learn(distinct[~known], [raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(begin[at].tolist(), stop[at].tolist())])
            place = np.searchsorted(self.hashes, distinct)
        piece = place[where]
        text_ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
        unlike = set(np.searchsorted(text_ends, begin[self._differ(data, begin, stop, piece)], side="right").tolist())
        sizes = self.size[piece].astype(np.int64)
        pieces_before = np.searchsorted(begin, np.concatenate([[0], text_ends]))
        before = np.concatenate([[0], np.cumsum(sizes)])
        totals = np.diff(before[pieces_before]) + 1
        # Where each piece's ids go: after those before it, and after the end ids of the texts before it.
        out = np.full(int(totals.sum()), end_id, dtype=np.uint32)
        at = before[:-1] + np.repeat(np.arange(len(texts)), np.diff(pieces_before))
        step = np.arange(int(sizes.sum())) - np.repeat(before[:-1], sizes)
        out[np.repeat(at, sizes) + step] = self.flat[np.repeat(self.start[piece], sizes) + step]
        return out, totals, unlike


def _range_hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes: differences of running sums, brought to position 0 by an inverse power."""
    global _POWERS
    if len(_POWERS[0]) < len(data) + 1:
        size = 1 << len(data).bit_length()
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        _POWERS = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, dtype=np.uint64)])) for x in (_MULTIPLIER, inverse))
    up, down = _POWERS
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    h = (sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of integer points (rows) with ``bits`` bits a dimension, for whole arrays (Skilling's transform)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for part in x:
            key = (key << 1) | (((part ^ turn) >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document: hashed token counts, damped and normalised, under a fixed random projection."""
    doc = np.repeat(np.arange(len(counts)), counts)
    bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
    vectors = np.sqrt(np.bincount(doc * BUCKETS + bucket, minlength=len(counts) * BUCKETS)).reshape(-1, BUCKETS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    plane = np.random.RandomState(7).standard_normal((BUCKETS, DIMENSIONS))
    flat = np.clip((vectors @ plane + 3.0) / 6.0, 0.0, 1.0)
    return hilbert_keys(np.minimum((flat * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _groups(texts: list[str]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def tokenize(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """``doc_id, n, curve, ids``: the ids as little-endian unsigned 16-bit numbers, the end id last."""
    ship_package(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField("curve", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches):
        tokenizer = tokenizer_at(tokenizer_path)
        if len(tokenizer.ends) > 1 << 16:
            raise ValueError("the vocabulary has ids of more than 16 bits")
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups(texts):
                ids, counts = tokenizer.encode(texts[a:b], end_id)
                narrow = ids.astype("<u2")
                ends = np.cumsum(counts)
                blobs = [narrow[e - n:e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts), pa.array(curve_keys(ids, counts)), pa.array(blobs, pa.binary())],
                    names=["doc_id", "n", "curve", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of rows from :func:`tokenize`; ids as 32-bit numbers.

    ``tokens`` is read more than once: pass a table or a materialised DataFrame.
    """
    spark = tokens.sparkSession
    parts = shuffle_partitions(spark)
    tie = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    keyed = tokens.withColumn("key", F.shiftleft("curve", TIE_BITS).bitwiseOR(tie))
    cuts = cut_points(keyed.select("key"), "key", parts)
    dealt = keyed.withColumn("part", bucket_of("key", cuts))
    totals = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # at most `parts` rows
    before, base = 0, {}
    for p in sorted(totals):
        base[p], before = before, before + totals[p]
    schema = T.StructType([tokens.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in (
        "start", "length", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType())])

    def run(batches):
        at = None
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            if at is None:
                at = base[batch.column(2)[0].as_py()]
            counts = batch.column(1).to_numpy()
            first = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            n = (first + counts - 1) // capacity - first // capacity + 1  # pieces of each document
            row = np.repeat(np.arange(len(counts)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sequence = first[row] // capacity + k
            begin = np.maximum(sequence * capacity, first[row])
            end = np.minimum((sequence + 1) * capacity, (first + counts)[row])
            start = begin - first[row]
            blobs = batch.column(3)
            ids = [np.frombuffer(blobs[r].as_buffer(), "<u2", m, 2 * s).astype("<u4").tobytes()
                   for r, s, m in zip(row.tolist(), start.tolist(), (end - begin).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(counts[row]), pa.array(sequence),
                 pa.array(begin - sequence * capacity), pa.array(ids, pa.binary())],
                names=[f.name for f in schema])

    columns = dealt.select("doc_id", "n", "part", "ids", "key")
    return columns.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "doc_id", "n").mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the pieces of each sequence joined (a sequence is bounded by its capacity)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p"))
    return whole.select("sequence_id", "length", F.aggregate(
        "p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_pack_hilbert(docs: DataFrame) -> DataFrame:
    tokens = materialize(tokenize(docs, default_tokenizer()), "pack-tokens")
    return pack(tokens).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
