"""Main text of web pages, with a suffix array for each host.

A page is cut into blocks at block-level tags.  Markup decides what it can:
scripts, menus, headers, footers, sidebars, forms, notices, adverts and reader
comments are boilerplate, and where the page has an ``article`` or ``main``
element, only blocks inside count as text.  A form or an element that a class or
id names as boilerplate does not count as such if it holds the article or main
element of the page.  End tags that may be left out are implied.

What markup leaves open is decided by the host: the token streams of all blocks
outside such elements are concatenated, a suffix array over them (built by prefix
doubling until all suffixes are ordered) with the lengths of their common prefixes
gives the repeats of ``MIN_RUN`` tokens or more, those on at least ``MIN_PAGES`` pages
with different contents count, and the tokens they cover are removed; unique runs stay.  A host of any
size is dealt to shards of bounded size, each with an array of its own, and the
counts of equal runs are added up over the shards, so the result is that of one
array a host.

Repeats inside an ``article`` or ``main`` element are content (quoted passages,
licences, mirrored stories) and stay.

Defined cases: null html is empty and gives an empty text; a null url or one
without a host is host ""; repeated rows are extracted alike and all kept; equal
contents count as one page in the search for repeats; unclosed and cut off tags
end with the page; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize

MIN_RUN = 6
MIN_PAGES = 2
SHARD_TOKENS = 50_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_RAW = frozenset("script style template noscript textarea iframe svg annotation annotation-xml object xmp title".split())
_BOILERPLATE = frozenset("nav footer aside button select dialog menu head".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAME = (r"(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|gdpr|menu|modal|nav|navbar|navigation"
         r"|newsletter|notice|notices|notification|pagination|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget%s)")
_BEFORE = (r"(?:site|page|post|entry|article|main|top|bottom|left|right|header|primary|secondary|global|google|dfp|gpt|js|wp|mobile|desktop|sticky|floating|inline|skip"
           r"|legal|privacy|user|reader)")
_AFTER = (r"(?:box|block|container|wrapper|wrap|slot|unit|area|section|bar|lists?|links?|buttons?|btns?|items?|inner|outer|top|bottom|left|right|group|icons?|media|panel"
          r"|zone|frame|holder|thread|posts?|articles?|stories|form|body|signup|message|overlay|widgets?|primary|secondary|trail|tools|\d+)")
# A whole class or id: a name, alone or with other names and words of place and layout; "with-sidebar" and "related-work" are none.
_WHOLE = rf"(?:{_BEFORE}[_-]+)*{_NAME}(?:[_-]+(?:{_NAME}|{_AFTER}))*"
_NAMES = re.compile(_WHOLE.replace("%s", ""), re.I)
_OUTSIDE_NAMES = re.compile(_WHOLE.replace("%s", "|header|masthead|topbar"), re.I)
_COMMENTS = re.compile(r"comments?(?:[_-](?:list|area|section))?|commentlist|disqus(?:[_-]thread)?", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_HEAD = frozenset("head base link meta title script style noscript template".split())
# Start tags that end an open p, and for each element whose end tag may be left out: what its start tag ends, and what that search does not cross.
_ENDS_P = _BLOCK - frozenset("body caption head html legend option tbody tfoot thead tr".split())
_ITEM_SCOPE = _BLOCK - frozenset("address div p li dt dd".split())
_ENDS = {
    "li": ({"li"}, _ITEM_SCOPE), "dt": ({"dt", "dd"}, _ITEM_SCOPE), "dd": ({"dt", "dd"}, _ITEM_SCOPE), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{x: ({"thead", "tbody", "tfoot", "tr"}, {"table"}) for x in ("thead", "tbody", "tfoot")}}
_P_SCOPE = frozenset("button caption table td th".split())
_FOLLOWED = _BLOCK - {"html", "body"} | {"td", "th"}

OPEN, INSIDE, BOILERPLATE = 0, 1, 2
SOFT = 3


def _named(tag: str, classes: str, name: str, inside: bool) -> bool:
    """Whether a class or the id names boilerplate; ids of headings, and of sections inside a container, are slugs of their titles."""
    if tag in _HEADINGS:
        name = ""
    elif inside and (tag in ("section", "a", "dt") or "section" in classes.split()) and not _COMMENTS.fullmatch(name):
        name = ""
    names = _NAMES if inside else _OUTSIDE_NAMES
    return any(names.fullmatch(x) for x in f"{classes} {name}".split())


def _marks(tag: str, text: str, inside: bool) -> int:
    """INSIDE for a container of the text, BOILERPLATE, SOFT for boilerplate unless it holds the container, or OPEN."""
    given = {}
    if "=" in text or "hidden" in text:
        for m in _ATTRIBUTE.finditer(text):
            given.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    role = given.get("role", "").lower()
    if tag in ("article", "main") or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody":
        return INSIDE
    if tag in _BOILERPLATE or role in _ROLES or (tag == "header" and not inside):
        return BOILERPLATE
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return BOILERPLATE
    if tag == "form" or tag not in ("html", "body") and _named(tag, given.get("class", ""), given.get("id", ""), inside):
        return SOFT
    return OPEN


class _Element:
    """An open element; ``holds`` is whether a container is inside (for SOFT)."""

    __slots__ = ("name", "mark", "holds")

    def __init__(self, name: str, mark: int):
        self.name, self.mark, self.holds = name, mark, False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with OPEN, INSIDE (of an article or main element) or BOILERPLATE."""
    page = page or ""
    out: list[tuple[str, int, tuple]] = []
    held: list[str] = []
    open_tags: list[_Element] = []
    names: Counter = Counter()  # of open_tags
    marks = [0, 0, 0, 0]

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            soft = tuple(x for x in open_tags if x.mark == SOFT) if marks[SOFT] else ()
            out.append((text, BOILERPLATE if marks[BOILERPLATE] else INSIDE if marks[INSIDE] else OPEN, soft))

    def end(at: int):
        """Ends the elements from number ``at`` on."""
        if any(x.mark for x in open_tags[at:]):
            flush()
        for x in open_tags[at:]:
            names[x.name] -= 1
            marks[x.mark] -= 1
        del open_tags[at:]

    def imply_end(kinds, scope):
        if not any(names[x] for x in kinds):
            return
        found = None
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i].name in kinds:
                found = i
            elif open_tags[i].name in scope or open_tags[i].mark == INSIDE:
                break
            if found is not None and len(kinds) == 1:
                break
        if found is not None:
            end(found)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        data = page[at:m.start() if m else len(page)]
        if data:
            held.append(entities.unescape(data))
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:  # a comment or declaration
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if name in _BLOCK:
            flush()
        elif name in ("br", "td", "th"):
            held.append(" ")
        if closing:
            if names[name]:
                i = max(i for i, x in enumerate(open_tags) if x.name == name)
                x = open_tags[i]
                if x.mark and not x.holds or not any(y.mark == INSIDE for y in open_tags[i + 1:]):  # a stray end tag does not end a container
                    end(i)
            continue
        if names["head"] and name not in _HEAD:
            imply_end({"head"}, ())
        if name in _ENDS_P:
            imply_end({"p"}, _P_SCOPE)
        if name in _ENDS:
            imply_end(*_ENDS[name])
        if name in _RAW:
            closed = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = closed.end() if closed else len(page)
            continue
        if name in _VOID or attributes.endswith("/"):
            continue
        mark = _marks(name, attributes, marks[INSIDE] > 0)
        if mark == INSIDE and not marks[INSIDE]:
            for x in open_tags:
                x.holds = True
        if mark or name in _FOLLOWED or names[name]:
            if mark:
                flush()
            open_tags.append(_Element(name, mark))
            names[name] += 1
            marks[mark] += 1
    flush()

    def label(kind, soft, spared):
        return BOILERPLATE if any(x not in spared for x in soft) else kind

    # A form around the container is not boilerplate; nor is a named element, if there is no text in containers outside such elements.
    spared = {x for _, _, soft in out for x in soft if x.holds and x.name == "form"}
    if not any(label(kind, soft, spared) == INSIDE for _, kind, soft in out):
        spared = {x for _, _, soft in out for x in soft if x.holds}
    return [(text, label(kind, soft, spared)) for text, kind, soft in out]


def is_decided(found: list[tuple[str, int]]) -> bool:
    """Markup alone decides if some block is inside a container, or none is open."""
    kinds = {k for _, k in found}
    return INSIDE in kinds or OPEN not in kinds


def _stream(found: list[tuple[str, int]]) -> np.ndarray:
    """Hashes of the tokens outside containers, a mark before and after each block."""
    import xxhash

    tokens = ["\n"]
    for text, kind in found:
        if kind != INSIDE:
            tokens += text.split(" ")
            tokens.append("\n")
    return np.array([xxhash.xxh64_intdigest(t) for t in tokens], dtype=np.uint64) if len(tokens) > 1 else np.zeros(0, np.uint64)


def run_hashes(tokens: np.ndarray) -> np.ndarray:
    """A hash of the run of MIN_RUN tokens at each position that has one."""
    n = len(tokens) - MIN_RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(MIN_RUN):
        h = (h ^ tokens[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` tokens at least, and for each whether its class differs from the one before."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < depth:
        step = min(width, depth - width)
        later = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])
        pair = rank * (int(rank.max()) + 1) + later
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
        width += step
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    return order, np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and for each the number of leading tokens it shares with the one before (0 for the first)."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [rank.astype(np.int32)], 1   # levels[k]: equal for suffixes that share 2^k tokens
    while rank.max() < n:
        later = np.concatenate([rank[width:], np.zeros(min(width, n), np.int64)])
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank.astype(np.int32))
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero((a < n) & (b < n))
        same = same[levels[k][a[same]] == levels[k][b[same]]]
        a[same] += 1 << k
        b[same] += 1 << k
        shared[same + 1] += 1 << k
    return order, shared


def _repeated_in_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """``host, run, pages``: for each class of neighbouring suffixes that share MIN_RUN tokens or more the number of pages of the shard."""
    rows = rows.drop_duplicates("page")
    streams = [np.frombuffer(s, dtype=np.uint64) for s in rows["tokens"]]
    tokens, owner, fits = [], [], []
    for i, s in enumerate(streams):
        tokens.append(s)
        owner.append(np.full(len(s), i))
        fits.append(np.arange(len(s)) <= len(s) - MIN_RUN)  # a run stays on its page
    tokens, owner, fits = np.concatenate(tokens), np.concatenate(owner), np.concatenate(fits)
    order, shared = suffix_array(tokens)
    new = shared < MIN_RUN
    kind = (np.cumsum(new) - 1)[fits[order]]
    order = order[fits[order]]
    if not len(order):
        return pd.DataFrame({"host": [], "run": [], "pages": []}).astype({"host": object, "run": "int64", "pages": "int64"})
    seen = np.unique(np.stack([kind, owner[order]]), axis=1)[0]  # a page once a class
    classes, pages = np.unique(seen, return_counts=True)
    first = np.unique(kind, return_index=True)[1]
    start = order[first]
    h = np.zeros(len(start), dtype=np.uint64)
    for k in range(MIN_RUN):
        h = (h ^ tokens[start + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return pd.DataFrame({"host": rows["host"].iloc[0], "run": h.view(np.int64), "pages": pages})


def main_text(found: list[tuple[str, int]], repeated: set[int] | None = None) -> str:
    """The text of a page from its blocks; ``repeated`` are the runs that repeat on its host, for pages that markup does not decide."""
    if INSIDE in {k for _, k in found}:
        return "\n".join(t for t, k in found if k == INSIDE)
    if not repeated:
        return "\n".join(t for t, k in found if k == OPEN)
    tokens = _stream(found)
    covered = np.zeros(len(tokens), dtype=bool)
    for i in np.flatnonzero([x in repeated for x in run_hashes(tokens).view(np.int64).tolist()]):
        covered[i:i + MIN_RUN] = True
    out, at = [], 1
    for text, kind in found:
        words = text.split(" ")
        gone = covered[at:at + len(words)]
        if not gone.all():  # of a run that ends in this block a few words may be covered by chance: only whole runs go
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
            for a, b in zip(edges[::2], edges[1::2]):
                gone[a:b] = b - a >= MIN_RUN
        kept = [w for w, c in zip(words, gone) if not c]
        at += len(words) + 1
        if kind == OPEN and kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def repeated_runs(streams: DataFrame, min_pages: int = MIN_PAGES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``host, run`` for the runs on at least ``min_pages`` pages, of rows ``host, page, n, tokens``."""
    sizes = streams.groupBy("host").agg(F.ceil(F.sum("n") / shard_tokens).cast("int").alias("shards"))
    dealt = streams.join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("page"), F.col("shards")))
    # Pages of one content have one key and so meet in one shard; shards are bounded, hosts are not.
    counted = dealt.groupBy("host", "shard").applyInPandas(_repeated_in_shard, "host string, run long, pages long")
    return counted.groupBy("host", "run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages).select("host", "run")


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("page", F.xxhash64("html"))
    id_type, url_type = base.schema["page_id"].dataType, base.schema["url"].dataType
    result = T.StructType([T.StructField("page_id", id_type), T.StructField("url", url_type), T.StructField("text", T.StringType())])

    def streams(batches):
        for batch in batches:
            found = [blocks(x) for x in batch.column(2).to_pylist()]
            tokens = [_stream(f) for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array([not is_decided(f) for f in found]),
                pa.array([t.tobytes() for t in tokens], pa.binary())], names=["host", "page", "n", "open", "tokens"])

    def decided(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [blocks(x) for x in part.column(2).to_pylist()]
                done = [is_decided(f) for f in found]
                at = pa.array([i for i, d in enumerate(done) if d], pa.int64())
                texts = pa.array([main_text(f) for f, d in zip(found, done) if d], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), texts], names=result.names)

    def undecided(batches):
        for batch in batches:
            texts = [main_text(blocks(x), set(r or [])) for x, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=result.names)

    stream = materialize(base.select("host", "page", "html").mapInArrow(
        streams, "host string, page long, n long, open boolean, tokens binary"), "html-streams")
    runs = materialize(repeated_runs(stream.where("n > 0")), "html-runs")
    waiting = stream.where("open").dropDuplicates(["host", "page"])
    grams = waiting.select("host", "page", "tokens").mapInArrow(_page_runs, "host string, page long, run long")
    covered = grams.join(runs, ["host", "run"]).groupBy("host", "page").agg(F.collect_set("run").alias("runs"))  # at most a page's own runs
    covered = materialize(waiting.select("host", "page").join(covered, ["host", "page"], "left"), "html-covered")
    first = base.select("page_id", "url", "html").mapInArrow(decided, result)
    rest = base.join(covered, ["host", "page"]).select("page_id", "url", "html", "runs").mapInArrow(undecided, result)
    return first.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))


def _page_runs(batches):
    for batch in batches:
        for host, page, raw in zip(*[c.to_pylist() for c in batch.columns]):
            runs = np.unique(run_hashes(np.frombuffer(raw, dtype=np.uint64))).view(np.int64)
            if len(runs):
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(runs), pa.string()), pa.array([page] * len(runs), pa.int64()), pa.array(runs)],
                                                 names=["host", "page", "run"])


def op6_html_suffix_array(pages: DataFrame) -> DataFrame:
    return extract(pages)
