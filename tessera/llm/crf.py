"""Language identification by a linear-chain conditional random field over words.

Features of a word are its byte n-grams (one to five bytes) with a mark at each
end, so that the grams at the ends are its affixes, and the word itself where it
is in the learned lexicon.  Transitions and start weights are learned too, from
chains that are spliced from documents of different languages, as in
code-switched text.  Forward-backward gives each word's probabilities; a
document gets the language with the largest sum, and its mean as the score.

A chain covers ``CHAIN`` words; the next words of a text begin a new chain with
the start weights, so all words of a text are labelled and memory is bounded.

The model is fitted on a bounded sample of labelled rows, ``SAMPLE`` documents a
language with at most ``EXCERPT`` characters each; everything else reads every
document whole.

Defined cases: a null text, or one without letters, is ``und`` with score 0, and
so is every text if nothing can be learned; rows are labelled alike if their
texts are, and all kept; an empty table gives an empty result; other columns are
not read by the model.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm.common import hash_fraction, held_out
from tessera.session import ship_package

UNKNOWN = "und"
CHAIN = 128
SAMPLE, EXCERPT = 300, 1800
GRAMS = 5
HASH_BITS = 17
LEXICON_LEAST, LEXICON_MOST = 4, 20_000
STEPS = 40
GROUP_CHARS = 1_000_000
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isascii() or any(c.isalpha() for c in w)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words one after another, their number for each word, and a 64-bit hash of each word."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(lens), lens)
    at = np.arange(len(data))
    gram = np.zeros(len(data), dtype=np.uint64)
    all_grams, all_rows = [], []
    row = np.repeat(np.arange(len(words)), lens)
    for n in range(1, min(GRAMS, len(data)) + 1):
        gram = gram[: len(data) - n + 1] * np.uint64(257) + data[n - 1:] + np.uint64(1)
        fits = at[: len(data) - n + 1] + n <= ends[: len(data) - n + 1]
        all_grams.append(_mix(gram[fits] * np.uint64(8) + np.uint64(n)) >> np.uint64(64 - HASH_BITS))
        all_rows.append(row[: len(data) - n + 1][fits])
    rows = np.concatenate(all_rows)
    order = np.argsort(rows, kind="stable")
    power = np.cumprod(np.concatenate([[1], np.full(int(lens.max(initial=1)), 0x100000001B3, dtype=np.uint64)]).astype(np.uint64))
    inside = at - (ends - np.repeat(lens, lens))
    whole = _mix(np.add.reduceat(_mix(data + np.uint64(7)) * power[inside], np.cumsum(lens) - lens)) if len(words) else np.zeros(0, np.uint64)
    return np.concatenate(all_grams)[order].astype(np.int64), np.bincount(rows, minlength=len(words)), whole


class Model:
    """Weights: hashed grams, lexicon words (sorted hashes), transitions, start; ``languages`` names the labels."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.grams = np.zeros((1 << HASH_BITS, n), dtype=np.float32)
        self.words = np.zeros((len(lexicon) + 1, n), dtype=np.float32)  # the last: not in the lexicon
        self.moves = np.zeros((n, n), dtype=np.float32)
        self.start = np.zeros(n, dtype=np.float32)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        out = []
        for a in range(0, len(words), 20_000):
            grams, counts, hashes = word_features(words[a:a + 20_000])
            sums = np.add.reduceat(self.grams[grams], np.cumsum(counts) - counts, axis=0)
            known = self.words[self.place(hashes)]
            known[self.place(hashes) == len(self.lexicon)] = 0
            out.append(sums / np.sqrt(counts, dtype=np.float32)[:, None] + known)
        return np.concatenate(out)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over chains that stand one after another in ``scores`` (a row a word).

    Returns each word's label probabilities and, if asked, the expected number of
    each transition and of each first label.
    """
    n, k = scores.shape
    if not n:
        return scores, np.zeros((k, k)), np.zeros(k)
    order = np.argsort(-lengths, kind="stable")
    long = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step, first = np.exp(moves), np.exp(start)
    ahead = np.empty_like(emit)
    alive = np.searchsorted(-long, -np.arange(long[0]), side="left")  # chains longer than t
    for t in range(long[0]):
        rows = begin[: alive[t]] + t
        now = emit[rows] * (first if t == 0 else ahead[rows - 1] @ step)
        ahead[rows] = now / now.sum(axis=1, keepdims=True)
    back = np.ones_like(emit)
    moved = np.zeros((k, k))
    for t in range(long[0] - 2, -1, -1):
        rows = begin[: alive[t + 1]] + t
        after = emit[rows + 1] * back[rows + 1]
        if pairs:
            joint = ahead[rows][:, :, None] * step[None] * after[:, None, :]
            moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        now = after @ step.T
        back[rows] = now / now.sum(axis=1, keepdims=True)
    both = ahead * back
    both /= both.sum(axis=1, keepdims=True)
    return both, moved, both[begin].sum(axis=0)


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model | None:
    """Maximum likelihood with a small penalty, by Adam over all chains of the sample."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.RandomState(seed)
    pieces = []  # (words, label)
    for text, label in zip(texts, labels):
        own = words_of(text)
        for a in range(0, len(own), 48):
            pieces.append((own[a:a + 48], languages.index(label)))
    pieces = [p for p in pieces if p[0]]
    if not pieces:
        return None
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    tokens: list[str] = []
    truth: list[int] = []
    lengths: list[int] = []
    for i in range(0, len(pieces), 2):  # half of the chains switch language once or more, where the pieces differ
        chain = pieces[i:i + 2]
        if i % 4 or len(chain) == 1:
            for own, y in chain:
                tokens += own
                truth += [y] * len(own)
                lengths.append(len(own))
        else:
            (a, x), (b, y) = chain
            cut_a, cut_b = rng.randint(1, len(a) + 1), rng.randint(1, len(b) + 1)
            for own, z in ((a[:cut_a], x), (b, y), (a[cut_a:], x)) if cut_b % 2 else ((a, x), (b, y)):
                tokens += own
                truth += [z] * len(own)
            lengths.append(len(a) + len(b))
    codes, distinct = pd.factorize(np.array(tokens, dtype=object))
    y = np.array(truth)
    n, k = len(tokens), len(languages)
    chain_lengths = np.array(lengths, dtype=np.int64)
    starts = np.cumsum(chain_lengths) - chain_lengths
    grams, counts, hashes = word_features(list(distinct))
    often = np.bincount(codes)
    known = np.sort(hashes[often >= LEXICON_LEAST][np.argsort(-often[often >= LEXICON_LEAST], kind="stable")[:LEXICON_MOST]])
    model = Model(languages, known)
    place = model.place(hashes)
    real = (place < len(known)).astype(np.float64)
    scale = 1.0 / np.sqrt(counts)
    row_of_gram = np.repeat(np.arange(len(distinct), dtype=np.int32), counts)
    grams, begins = grams.astype(np.int32), np.cumsum(counts) - counts
    onehot = np.zeros((n, k))
    onehot[np.arange(n), y] = 1
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    seen_first = onehot[starts].sum(axis=0)
    values = [np.zeros(w.shape) for w in (model.grams, model.words, model.moves, model.start)]
    m, v = [np.zeros_like(w) for w in values], [np.zeros_like(w) for w in values]
    for turn in range(1, STEPS + 1):
        # A label at a time, which bounds the driver's memory.
        sums = np.stack([np.add.reduceat(values[0][:, j][grams], begins) for j in range(k)], axis=1)
        emit = sums * scale[:, None] + values[1][place] * real[:, None]
        got, moved, first = marginals(emit[codes], chain_lengths, values[2], values[3], pairs=True)
        miss = onehot - got
        by_type = np.stack([np.bincount(codes, miss[:, j], minlength=len(distinct)) for j in range(k)], axis=1)
        spread = by_type * scale[:, None]
        slopes = [np.stack([np.bincount(grams, spread[row_of_gram, j], minlength=1 << HASH_BITS) for j in range(k)], axis=1),
                  np.stack([np.bincount(place, by_type[:, j] * real, minlength=len(known) + 1) for j in range(k)], axis=1),
                  seen - moved, seen_first - first]
        for i, (w, g) in enumerate(zip(values, slopes)):
            g = g - 0.02 * w
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.98 * v[i] + 0.02 * g * g
            w += 0.1 * (m[i] / (1 - 0.9 ** turn)) / (np.sqrt(v[i] / (1 - 0.98 ** turn)) + 1e-6)
    model.grams, model.words, model.moves, model.start = [w.astype(np.float32) for w in values]
    return model


def label_words(model: Model, texts: list[str | None], known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of all words of the texts, and the number of words of each text."""
    known = {} if known is None else known
    counts, words = np.zeros(len(texts), dtype=np.int64), []
    for i, t in enumerate(texts):
        own = words_of(t) if t else []
        counts[i] = len(own)
        words += own
    if not words:
        return np.zeros((0, len(model.languages))), counts
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    new = [w for w in distinct if w not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list(distinct)
    known.update(zip(new, model.emissions(new)))
    scores = np.stack([known[w] for w in distinct])[codes]
    chains = -(-counts // CHAIN)
    lengths = np.full(chains.sum(), CHAIN, dtype=np.int64)
    some = counts > 0
    lengths[(np.cumsum(chains) - 1)[some]] = counts[some] - (chains[some] - 1) * CHAIN
    return marginals(scores, lengths, model.moves, model.start)[0], counts


def label_documents(model: Model | None, texts: list[str | None], known: dict | None = None) -> tuple[list[str], np.ndarray]:
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    names, scores = [], np.zeros(len(texts))
    at, size, todo = 0, 0, []
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP_CHARS or i == len(texts) - 1:
            todo.append((at, i + 1))
            at, size = i + 1, 0
    for a, b in todo:
        shares, counts = label_words(model, texts[a:b], known)
        total = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(shares, axis=0, dtype=np.float64)])
        ends = np.cumsum(counts)
        mean = (total[ends] - total[ends - counts]) / np.maximum(counts, 1)[:, None]
        best = mean.argmax(axis=1)
        names += [model.languages[j] if c else UNKNOWN for j, c in zip(best, counts)]
        scores[a:b] = np.clip(np.where(counts > 0, mean.max(axis=1), 0.0), 0.0, 1.0)
    return names, scores


def learn(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, excerpt: int = EXCERPT):
    """Fit on about ``sample`` documents a language, chosen by a hash of the id; never from the held-out fold."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    counts = {r["l"]: r["n"] for r in rows.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    chosen = rows.where(hash_fraction(ident, "crf-sample") < F.element_at(share, F.col(label)))
    size = F.greatest(F.length(text) - excerpt, F.lit(0))
    begin = (hash_fraction(ident, "crf-place") * size).cast("int") + 1
    got = chosen.select(F.col(text).substr(begin, F.lit(excerpt)).alias("t"), F.col(label).alias("l"),
                        F.xxhash64(text, doc_id).alias("h")).limit(4 * sample * len(counts)).toPandas().sort_values(["h", "l"])
    return train(got["t"].tolist(), got["l"].tolist())


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**HASH_BITS + LEXICON_MOST weights a language
    got = docs.drop(*[c for c in ("lang_pred", "score") if c != text]).withColumn("__crf", _iterator_udf(shared)(F.col(text)))
    return got.select(*[c for c in got.columns if c != "__crf"], "__crf.lang_pred", "__crf.score")


def _iterator_udf(shared):
    from collections.abc import Iterator

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for texts in batches:
            names, scores = label_documents(shared.value, texts.tolist(), known)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    label.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Not to be evaluated again where a filter uses the result.
    return pandas_udf(label, "lang_pred string, score double").asNondeterministic()


def op5_language_crf(docs: DataFrame) -> DataFrame:
    model = learn(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
