"""Main text of web pages by a suffix array over what a host repeats, and by structure.

A page becomes a token stream: the words of its blocks of text in page order, a token for each block's
beginning that tells what structure says of it, and an end of its own. Scripts, styles, comments of the
markup and tags are no text. The streams of a host's pages are concatenated, and a suffix array
sorted to the depth of `LENGTH` tokens finds the long substrings that recur on distinct pages. Pages that share
nearly all of their text with an earlier one (by a hash of the row) are copies of it and count with it, so copies do not erase each other.

A host with much html is cut into shards, each with a suffix array of its own, that stay where they are stored. Shards
exchange the hashes of their distinct substrings: the first bits of all, as many as tell most apart, then the 64 bits of those that several shards seem to have. So it is
known which page of the host is the first with each, which pages are copies, and on how many distinct pages each
is: counts are those of the host, however it is cut. What shards tell each other is packed by parts of the hashes; hashes are made anew from the stored tokens, not stored.

What recurs on enough distinct pages of a host is boilerplate: its words go, the unique runs of a block
stay. Structure is evidence of how many pages are enough: two where element or class name stands for a menu, an
advert or the like, a share where nothing is marked, a larger share inside an article or main part, as articles quote each
other. Then structure decides what no search can see because a page has it alone: elements and
class names that stand for such are left out, and a page that marks its main part has no other text.

Null html is an empty page. Pages without a host share one. Repeated rows are copies. Ties do not arise: the
order of pages is that of a hash of the whole row. A page of any length is read whole, in one task. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import only, put_by, shared_dir, shuffles_dropped, tidy, unstage
from folio.llm.suffix_array import ranks_to_depth

#: Tokens of a substring that counts as long, a power of two.
LENGTH = 8
#: Share of a page's windows that it has in common with one earlier page if it is a copy of that.
COPY = 0.9
#: Bytes of html whose pages make a shard, and hosts with more than a shard that are sent to all tasks.
SHARD, HOSTS = 4 << 20, 100_000

# Names of elements and words of class, id and role attributes.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "xmp", "noembed", "noframes"}
CHROME = {"nav", "footer", "aside", "form", "dialog", "menu", "select", "button", "fieldset", "header"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
TRACKED = {"div", "section", "article", "main", "ul", "ol", "dl", "table", "figure", "body", "span", "p", "center", "td", "tr", "li", "blockquote", "details"} | CHROME
CHROME_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "newsletter", "subscribe", "subscription", "signup", "sidebar", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "toolbar", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "disqus", "replies", "respond", "popup", "modal", "overlay", "pagination", "pager", "skip", "copyright", "login", "search"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
MAIN_WORDS = {"article-body", "article-content", "articlebody", "post-content", "post-body", "entry-content", "main-content"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)

#: What a block is by structure: left out, in the marked part, or undecided.
OUT, IN, OPEN = 0, 1, 2
#: By what a block is: the share of a host's distinct pages on which boilerplate recurs, and pages at least.
ENOUGH = {OUT: (0.0, 2), IN: (0.8, 8), OPEN: (0.1, 2)}


def words_of(value: str) -> set[str]:
    """Class names and, of those with hyphens or underscores, their first and last part."""
    found = set()
    for name in value.lower().split():
        parts = re.split("[-_]+", name)
        found.add(name)
        if parts[0] in ("has", "no", "with", "is"):
            continue
        # an article's own header holds its title
        found |= {parts[-1]} - {"header"} if parts[0] in ("post", "article", "entry", "main", "page") else {parts[0], parts[-1]}
    return found


def kind_of(tag: str, attributes: str, inside: int) -> int:
    """What an element makes of what it holds, given what surrounds it."""
    if inside == OUT:
        return OUT
    if tag in CHROME and not (tag == "header" and inside == IN):
        return OUT
    if attributes:
        value = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = words_of(f"{value.get('class', '')} {value.get('id', '')}")
        role = value.get("role", "").lower()
        if tag not in ("body", "html", "main") and (role in CHROME_ROLES or (names & CHROME_WORDS and not (tag == "article" and not names & {"comment", "comments", "ad", "related"})) or HIDDEN.search(value.get("style", ""))):
            return OUT
        if role in ("main", "article") or value.get("itemprop", "").lower() == "articlebody" or names & MAIN_WORDS:
            return IN
    return IN if tag in MAIN else inside


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    kind, text = OPEN, []
    at = 0

    def close() -> None:
        nonlocal text
        if text:
            found = " ".join(html.unescape("".join(text)).split())
            if found:
                out.append((kind, found))
            text = []

    end = len(page)
    lower = None
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            close()
            # what a new block ends without saying so
            ends = ("p", "li") if tag == "li" else ("p", "td", "tr") if tag in ("td", "tr") else ("p",)
            while not m[1] and stack and stack[-1][0] in ends:
                stack.pop()
                kind = stack[-1][1] if stack else OPEN
        if m[1]:
            if tag in TRACKED:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if tag == "span":
                            close()
                        del stack[k:]
                        kind = stack[-1][1] if stack else OPEN
                        break
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag in ("script", "style", "title"):
                lower = lower if lower is not None else page.lower() if len(page.lower()) == end else None
                gone = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at) if lower is None else None
                stop = lower.find(f"</{tag}", at) if lower is not None else (gone.start() if gone else -1)
                if stop < 0:
                    break
                at = page.find(">", stop) + 1 or end
            continue
        if tag in VOID or tag not in TRACKED:
            continue
        inner = kind_of(tag, m[3], kind)
        if tag in ("span", "p", "li", "td", "tr"):
            if inner == kind:
                # unclosed paragraphs are common: only those that change something are tracked
                continue
            close()
        elif m[3].endswith("/"):
            continue
        stack.append((tag, inner))
        kind = inner
    close()
    return out


def host_of(url: Column) -> Column:
    """The host of a url in lower case, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def dealt(pages: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """page_id, url and html with host (hashed), at (the place in the order of pages) and unit: those of hosts with little html, in groups of whole hosts; and of those with much, in shards of a host (None if there are none), and the most shards that a host has."""
    named = pages.withColumn("host", F.xxhash64(host_of(F.col("url")))).withColumn("at", F.xxhash64("page_id", "url", "html"))
    held = named.groupBy("host").agg(F.sum(F.octet_length("html")).alias("held"))
    large = held.where(F.col("held") > SHARD).select("host", F.ceil(F.col("held") / F.lit(SHARD)).alias("shards"))
    total, hosts, most = held.agg(F.sum("held"), F.count(F.when(F.col("held") > SHARD, True)), F.max("held")).first()
    whole = F.pmod("host", F.lit(max(1, -(-int(total or 0) // SHARD))))
    columns = ["page_id", "url", "html", "host", "at"]
    if not hosts:
        return named.select(*columns, whole.alias("unit")), None, 0
    large = F.broadcast(large) if hosts <= HOSTS else large
    # shards are ranges of the order, so that a page of a lower shard comes earlier
    shard = F.least(F.floor((F.col("at").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.col("shards")), F.col("shards") - 1)
    return named.join(large, "host", "left_anti").select(*columns, whole.alias("unit")), named.join(large, "host").select(*columns, shard.alias("unit")), -(-int(most) // SHARD)


BLOCKS = "page_id long, url string, host long, at long, unit long, kinds binary, texts array<string>"


def in_blocks(pages: DataFrame) -> DataFrame:
    """The kind (a byte) and text of each block of a page, in place of its html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts = [], []
            for page in batch.column("html"):
                found = blocks_of(page.as_py() or "")
                kinds.append(bytes(k for k, _ in found))
                texts.append([t for _, t in found])
            names = ["page_id", "url", "host", "at", "unit"]
            columns = [batch.column(c) for c in names]
            columns += [pa.array(kinds, pa.binary()), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "kinds", "texts"])

    return pages.mapInArrow(tidy(run), BLOCKS)


@dataclass
class Streams:
    """The token streams of some pages, one after the other: for each token its number, page, block's kind and whether it is a word; the distinct words; and the blocks that can be main text (page, begin, text)."""

    tokens: np.ndarray
    page: np.ndarray
    kind: np.ndarray
    word: np.ndarray
    words: list[str]
    blocks: list[tuple[int, int, str]]


def streams_of(pages: list[list[tuple[int, str]]]) -> Streams:
    """A token before each block (its kind) and one after each page; words are numbered from 3."""
    blocks = [(p, k, t.split(" ")) for p, found in enumerate(pages) for k, t in found]
    sizes = np.array([len(w) for _, _, w in blocks], np.int64)
    of = np.array([p for p, _, _ in blocks], np.int64)
    kinds = np.array([k for _, k, _ in blocks], np.int64)
    n = np.bincount(of, weights=sizes + 1, minlength=len(pages)).astype(np.int64) + 1
    start = np.cumsum(n) - n
    begin = np.cumsum(sizes + 1) - (sizes + 1) + of
    total = int(n.sum())
    tokens = np.empty(total, np.int64)
    word = np.ones(total, bool)
    word[begin] = False
    word[start + n - 1] = False
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    spoken = np.fromiter(map(numbers.__getitem__, chain.from_iterable(w for _, _, w in blocks)), np.int64, int(sizes.sum()))
    tokens[word] = spoken + 3
    tokens[begin] = kinds
    tokens[start + n - 1] = 3 + len(numbers) + np.arange(len(pages))
    page = np.repeat(np.arange(len(pages)), n)
    kind = np.full(total, OUT)
    kind[np.repeat(begin, sizes + 1) + np.arange(int((sizes + 1).sum())) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)] = np.repeat(kinds, sizes + 1)
    main = np.zeros(len(pages), bool)
    main[of[kinds == IN]] = True
    said = chain.from_iterable([t for _, t in found] for found in pages)
    return Streams(tokens, page, kind, word, list(numbers), [(p, b, t) for (p, k, _), b, t in zip(blocks, begin.tolist(), said, strict=True) if k == (IN if main[p] else OPEN)])


def windows_of(tokens: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of `length` tokens of one page start, which of the distinct ones each is, and the first that is each."""
    rank = ranks_to_depth(tokens, length)
    # a window that reaches over the end of its page occurs once
    ends = np.searchsorted(page, page, "right")
    inside = np.flatnonzero(np.arange(len(tokens)) + length < ends)
    _, first, which = np.unique(rank[inside], return_index=True, return_inverse=True)
    return inside, which, first


def distinct_of(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by a sort, which for many numbers takes less time than np.unique."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)]]


def copies_of(of: np.ndarray, lead: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int]]:
    """(page, number of an earlier page) of the pages that are nearly another. of, lead: for each window outside of menus and the like its page, and the number of the first with it."""
    total = np.bincount(of, minlength=len(number))
    other = lead != number[of]
    of, lead = of[other], lead[other]
    leads, at = np.unique(lead, return_inverse=True)
    pair, n = np.unique(of * len(leads) + at, return_counts=True)
    mine, like = pair // max(1, len(leads)), leads[pair % max(1, len(leads))]
    order = np.lexsort((like, -n, mine))
    mine, like, n = mine[order], like[order], n[order]
    most = np.append(True, mine[1:] != mine[:-1])[: len(mine)]
    copies = most & (n >= COPY * total[mine])
    return zip(mine[copies].tolist(), like[copies].tolist(), strict=True)


def pages_with(which: np.ndarray, stands: np.ndarray, distinct: int) -> np.ndarray:
    """On how many distinct pages each of the distinct windows is. stands: the page that each window's page counts as."""
    n = np.bincount(which, minlength=distinct)
    many = n[which] > 1
    which = which[many]
    known, at = np.unique(stands[many], return_inverse=True)
    return np.minimum(n, 1) + np.maximum(np.bincount(distinct_of(which * max(1, len(known)) + at) // max(1, len(known)), minlength=distinct) - 1, 0)


def covered(start: np.ndarray, seen: np.ndarray, kind: np.ndarray, distinct: int, length: int) -> np.ndarray:
    """Whether each token lies in a window that is on enough of the `distinct` pages. seen: on how many each window is."""
    out = np.zeros(len(kind), bool)
    for what, (share, least) in ENOUGH.items():
        hit = start[seen >= max(least, share * distinct)]
        step = np.zeros(len(kind) + 1, np.int64)
        step[hit] += 1
        step[hit + length] -= 1
        out |= (np.cumsum(step[:-1]) > 0) & (kind == what)
    return out


def unique_runs(words: list[str], gone: np.ndarray, length: int) -> list[str]:
    """The words of a block outside of its repeated runs; a run shorter than `length` goes only if it is the whole block."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    kept, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= min(length, len(words)):
            kept += words[at:a]
            at = b
    return kept + words[at:]


def left_of(blocks: list[tuple[int, int, str]], gone: np.ndarray, pages: int, length: int) -> list[str]:
    """The text of each page: its blocks (page, begin, text) without what recurs."""
    out: list[list[str]] = [[] for _ in range(pages)]
    for p, b, text in blocks:
        words = text.split(" ")
        mine = gone[b + 1 : b + 1 + len(words)]
        left = unique_runs(words, mine, length) if mine.any() else words
        if left:
            out[p].append(" ".join(left))
    return [" ".join(t) for t in out]


def texts_of(pages: list[list[tuple[int, str]]], length: int) -> list[tuple[str, int, int]]:
    """For each page of a whole host, in order: its main text, the words of its stream, and those of them that recur."""
    s = streams_of(pages)
    start, which, first = windows_of(s.tokens, s.page, length)
    of = s.page[start]
    own = s.kind[start] != OUT
    stands = np.arange(len(pages))
    for p, q in copies_of(of[own], of[first][which[own]], stands):
        stands[p] = stands[q]
    seen = pages_with(which, stands[of], len(first))
    gone = covered(start, seen[which], s.kind, len(np.unique(stands)), length)
    said = np.bincount(s.page[s.word], minlength=len(pages))
    spread = np.bincount(s.page[gone & s.word], minlength=len(pages))
    return list(zip(left_of(s.blocks, gone, len(pages), length), said.tolist(), spread.tolist(), strict=True))


TEXTS = "page_id long, url string, text string, n_words long, n_repeated long"


def texts_table(rows: pa.Table, found: list[tuple[str, int, int]]) -> pa.Table:
    text, words, repeated = zip(*found, strict=True)
    return pa.table({"page_id": rows["page_id"], "url": rows["url"], "text": pa.array(text, pa.string()), "n_words": pa.array(words, pa.int64()), "n_repeated": pa.array(repeated, pa.int64())})


def blocks_in(rows: pa.Table) -> list[list[tuple[int, str]]]:
    return [list(zip(k, t, strict=True)) for k, t in zip(rows["kinds"].to_pylist(), rows["texts"].to_pylist(), strict=True)]


def texts_of_hosts(blocks: DataFrame, length: int) -> DataFrame:
    """TEXTS of hosts that lie whole in a unit."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("host", "ascending"), ("at", "ascending")])
        hosts = table["host"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(hosts)) + 1).tolist(), len(hosts)]
        found = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            found += texts_of(blocks_in(table.slice(a, b - a)), length)
        return texts_table(table, found)

    return blocks.groupBy("unit").applyInArrow(search, TEXTS)


#: Bits of a page's number on its host below its shard's.
PAGE_BITS = 32
#: Parts that the hashes of a host's windows are dealt to, by their first bits.
PARTS, PART_BITS = 256, 8
#: First bits of hashes that shards exchange, besides those of the number of a host's shards: few windows agree in them by chance.
SEEN_BITS = 28
#: The pages of a shard, in order: the kinds of tokens, their numbers (the first bytes of all, then the second, and so on), the windows that start there (differences of their numbers); the first has the distinct words of all.
SHARDED = "host long, unit long, page long, page_id long, url string, kinds binary, tokens binary, windows binary, words string"
#: What shards are told: of the windows of a part (their numbers, and a number for each), of pages, and of the host.
TOLD = "host long, unit long, part int, windows binary, numbers binary, page long, n long, shared boolean"
UNIT = ["host", "unit"]
PART = ["host", "part"]


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as the compressed bytes of their differences, the first byte of all, the second of all, and so on."""
    step = np.diff(numbers.astype(np.int64), prepend=0)
    return zlib.compress(((step << 1) ^ (step >> 63)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(pack: bytes) -> np.ndarray:
    step = np.frombuffer(zlib.decompress(pack), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum((step >> np.uint64(1)).astype(np.int64) ^ -(step & np.uint64(1)).astype(np.int64))


def all_of(packs: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *packs])


def cut_at(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """`values` in pieces of these sizes."""
    return np.split(values, np.cumsum(sizes)[:-1])


def hashes_of(tokens: np.ndarray, words: list[str], start: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window that starts at `start`: the sum of its tokens' digests, each by the power of its place, mixed. tokens: 0 to 2 for the kinds of blocks, then words."""
    digests = pd.util.hash_array(np.array([f"block {k}" for k in range(3)] + words, object), categorize=False)
    said = digests[np.minimum(tokens, len(digests) - 1)]
    out = np.zeros(len(start), np.uint64)
    for k in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + said[start + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def sharded(blocks: DataFrame, length: int) -> DataFrame:
    """SHARDED, stored in buckets by shard, so that what is told of a shard goes to where its pages are."""
    spark = blocks.sparkSession

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n, base = table.num_rows, table["unit"][0].as_py() << PAGE_BITS
        s = streams_of(blocks_in(table))
        start, which, first = windows_of(s.tokens, s.page, length)
        # numbered as they come
        order = np.argsort(first)
        number = np.empty(len(first), np.int64)
        number[order] = np.arange(len(first))
        at = np.full(len(s.tokens), -1, np.int64)
        at[start] = number[which]
        at = np.diff(at, prepend=0).astype("<i4")
        ends = np.searchsorted(s.page, np.arange(n + 1)).tolist()
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        # an end of a page is in no window
        numbers = np.where(s.tokens < 3 + len(s.words), s.tokens, 0).astype("<i4").view(np.uint8).reshape(-1, 4)
        said = [numbers[a:b].T.tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        columns = {c: table[c] for c in ("host", "unit", "page_id", "url")} | {"page": pa.array(np.arange(n) + base)}
        columns |= {"kinds": cut(s.kind.astype(np.int8)), "tokens": pa.array(said, pa.binary()), "windows": cut(at), "words": pa.array([" ".join(s.words)] + [None] * (n - 1), pa.string())}
        return pa.table({f.split(" ")[0]: columns[f.split(" ")[0]] for f in SHARDED.split(", ")})

    found = blocks.groupBy(*UNIT).applyInArrow(run, SHARDED)
    name, buckets = f"shards_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = found.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    with shuffles_dropped(spark):
        writer.bucketBy(buckets, *UNIT).saveAsTable(name)
    return spark.table(name)


@dataclass
class Shard:
    """What a task holds of a shard: its pages in order, their first tokens, tokens' kinds, and where windows start, which each is and on which page."""

    pages: pa.Table
    number: np.ndarray
    begin: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    which: np.ndarray
    of: np.ndarray


def shard_of(pages: pa.Table) -> Shard:
    pages = pages.sort_by("page")
    kinds, windows = (pages[c].to_pylist() for c in ("kinds", "windows"))
    sizes = np.array([len(k) for k in kinds], np.int64)
    at = np.cumsum(np.frombuffer(b"".join(windows), "<i4").astype(np.int64))
    start = np.flatnonzero(at >= 0)
    return Shard(pages, pages["page"].to_numpy(), np.cumsum(sizes) - sizes, np.frombuffer(b"".join(kinds), np.int8), start, at[start], np.repeat(np.arange(len(sizes)), sizes)[start])


def first_of(s: Shard) -> np.ndarray:
    """Where among the windows of the shard each distinct one is first."""
    return np.unique(s.which, return_index=True)[1]


def first_pages(s: Shard) -> np.ndarray:
    """The number of the first page of the shard with each window."""
    return s.number[s.of[first_of(s)]]


def said_in(s: Shard) -> tuple[np.ndarray, list[str]]:
    """The tokens of a shard and its distinct words, as `streams_of` gives them but for the ends of pages, which are 0."""
    tokens = [np.frombuffer(x, np.uint8).reshape(4, -1).T for x in s.pages["tokens"].to_pylist()]
    return np.concatenate(tokens).copy().view("<i4").ravel(), [w for w in s.pages["words"][0].as_py().split(" ") if w]


def hashes_in(s: Shard, length: int) -> np.ndarray:
    """The hash of each distinct window of the shard."""
    return hashes_of(*said_in(s), s.start[first_of(s)], length)


def rows_of(rows: pa.Table, *names: str) -> dict[str, pa.ChunkedArray]:
    return {c: rows[c] for c in names}


def met(stored: DataFrame, length: int, bits: int) -> DataFrame:
    """(host, unit, part, some): those of the first `bits` bits of hashes, below the part's, that other shards of the host have, too."""
    low = bits - PART_BITS
    schema = "host long, unit long, part int, some binary"

    def deal(pages: pa.Table) -> pa.Table:
        s = shard_of(pages)
        some = distinct_of((hashes_in(s, length) >> np.uint64(64 - bits)).astype(np.int64))
        ends = np.searchsorted(some, np.arange(PARTS + 1) << low)
        packs = [packed(some[a:b] & ((1 << low) - 1)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        host, shard = (s.pages[c][0].as_py() for c in UNIT)
        return pa.table({"host": pa.array([host] * PARTS, pa.int64()), "unit": pa.array([shard] * PARTS, pa.int64()), "part": pa.array(range(PARTS), pa.int32()), "some": pa.array(packs, pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        packs = [unpacked(x) for x in rows["some"].to_pylist()]
        known = np.sort(np.concatenate(packs))
        several = distinct_of(known[1:][known[1:] == known[:-1]])
        several = cut_at(np.isin(np.concatenate(packs), several), [len(x) for x in packs])
        return pa.table(rows_of(rows, *UNIT, "part") | {"some": pa.array([packed(x[y]) for x, y in zip(packs, several, strict=True)], pa.binary())})

    dealt = stored.select(*UNIT, "page", "kinds", "tokens", "windows", "words").groupBy(*UNIT).applyInArrow(deal, schema)
    return dealt.groupBy(*PART).applyInArrow(meet, schema)


def leads_of(pages: DataFrame, length: int, bits: int) -> DataFrame:
    """(host, unit, part, windows, ids, leads): the windows of a shard that others have, too; a number of each in the host's part, and of the host's first page with it."""
    low = bits - PART_BITS

    def suspects(pages: pa.Table, told: pa.Table) -> pa.Table:
        s = shard_of(pages)
        hashes = hashes_in(s, length)
        some = all_of([(k << low) + unpacked(x) for k, x in zip(told["part"].to_pylist(), told["some"].to_pylist(), strict=True)])
        mine = np.flatnonzero(np.isin((hashes >> np.uint64(64 - bits)).astype(np.int64), some))
        part = (hashes[mine] >> np.uint64(64 - PART_BITS)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        mine, parts, sizes = mine[order], *np.unique(part, return_counts=True)
        lead = s.of[first_of(s)][mine]
        host, shard = (s.pages[c][0].as_py() for c in UNIT)
        columns = {"host": pa.array([host] * len(parts), pa.int64()), "unit": pa.array([shard] * len(parts), pa.int64()), "part": pa.array(parts, pa.int32())}
        columns |= {k: pa.array([packed(x) for x in cut_at(v, sizes)][: len(parts)], pa.binary()) for k, v in (("windows", mine), ("pages", lead))}
        return pa.table(columns | {"hashes": pa.array([x.tobytes() for x in cut_at(hashes[mine], sizes)][: len(parts)], pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        windows, of = ([unpacked(x) for x in rows[c].to_pylist()] for c in ("windows", "pages"))
        number = np.concatenate([(u << PAGE_BITS) + x for u, x in zip(rows["unit"].to_pylist(), of, strict=True)])
        _, which, n = np.unique(np.frombuffer(b"".join(rows["hashes"].to_pylist()), "<u8"), return_inverse=True, return_counts=True)
        lead = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(lead, which, number)
        ids = np.cumsum(n > 1) - 1
        sizes = [len(x) for x in windows]
        several, ids, lead = (cut_at(x, sizes) for x in ((n > 1)[which], ids[which], lead[which]))
        found = {k: pa.array([packed(x[y]) for x, y in zip(v, several, strict=True)], pa.binary()) for k, v in (("windows", windows), ("ids", ids), ("leads", lead))}
        return pa.table(rows_of(rows, *UNIT, "part") | found)

    found = pages.select(*UNIT, "page", "kinds", "tokens", "windows", "words").groupBy(*UNIT).cogroup(met(pages, length, bits).groupBy(*UNIT))
    some = found.applyInArrow(suspects, "host long, unit long, part int, windows binary, pages binary, hashes binary")
    return some.groupBy(*PART).applyInArrow(meet, "host long, unit long, part int, windows binary, ids binary, leads binary")


def column(told: pa.Table, name: str) -> np.ndarray:
    return told[name].to_numpy().astype(np.int64)


def of_windows(told: pa.Table) -> tuple[pa.Table, list[np.ndarray], np.ndarray]:
    """What is told of windows: its rows, the windows of each, and the numbers of all."""
    rows = told.filter(pa.compute.is_valid(told["windows"]))
    return rows, [unpacked(x) for x in rows["windows"].to_pylist()], all_of([unpacked(x) for x in rows["numbers"].to_pylist()])


def in_shards(pages: DataFrame, told: DataFrame, run, schema: str) -> DataFrame:
    """What `run` makes of each shard and what it is told."""

    def meet(pages: pa.Table, told: pa.Table) -> pa.Table:
        return run(shard_of(pages), told)

    return pages.groupBy(*UNIT).cogroup(told.select(*[f.split(" ")[0] for f in TOLD.split(", ")]).groupBy(*UNIT)).applyInArrow(meet, schema)


def told(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows of TOLD with these columns, and the host and unit of `rows`; the others are null."""
    fields = dict(f.split(" ") for f in TOLD.split(", "))
    return rows.select(*[columns.get(n, F.col(n) if n in UNIT else F.lit(None)).cast(k).alias(n) for n, k in fields.items()])


def roots(pairs: DataFrame) -> DataFrame:
    """(host, page, like) with the first page of each chain as like; twice as far along it in each round."""
    while True:
        further = pairs.select("host", F.col("page").alias("like"), F.col("like").alias("beyond"))
        joined = put_by(pairs.join(further, ["host", "like"], "left").select("host", "page", F.coalesce("beyond", "like").alias("like"), F.col("beyond").isNotNull().alias("moved")), "stands")
        pairs = joined.select("host", "page", "like")
        if joined.where("moved").isEmpty():
            return pairs


def seen_of(per: DataFrame) -> DataFrame:
    """(host, unit, part, windows, seen): on how many distinct pages of the host each window is. per: what each shard counts alone, and the pages that others have, too."""

    def meet(rows: pa.Table) -> pa.Table:
        ids, here, sizes, shared = ([unpacked(x) for x in rows[c].to_pylist()] for c in ("ids", "here", "sizes", "shared"))
        which, known = np.concatenate(ids), np.unique(np.concatenate(shared))
        seen = np.bincount(which, weights=np.concatenate(here)).astype(np.int64)
        pairs = distinct_of(np.repeat(which, np.concatenate(sizes)) * max(1, len(known)) + np.searchsorted(known, np.concatenate(shared)))
        seen += np.bincount(pairs // max(1, len(known)), minlength=len(seen))
        return pa.table(rows_of(rows, *UNIT, "part", "windows") | {"seen": pa.array([packed(seen[x]) for x in ids], pa.binary())})

    return per.groupBy(*PART).applyInArrow(meet, "host long, unit long, part int, windows binary, seen binary")


def texts_of_shards(blocks: DataFrame, length: int, shards: int) -> DataFrame:
    """TEXTS of hosts that lie in several shards (`shards` at most), from the counts of each whole host."""
    pages = sharded(blocks, length)
    held = pages.select(*UNIT, "page", "kinds", "windows")
    # the first page of the host with each window, told to shards if several have it
    leads = put_by(leads_of(pages, length, min(56, SEEN_BITS + shards.bit_length())), "leads")

    def copies(s: Shard, told: pa.Table) -> pa.Table:
        lead = first_pages(s)
        _, windows, numbers = of_windows(told)
        lead[all_of(windows)] = numbers
        own = s.kind[s.start] != OUT
        pairs = [(s.number[p], q) for p, q in copies_of(s.of[own], lead[s.which[own]], s.number)]
        mine, like = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(0, np.int64)] * 2
        return pa.table({"host": pa.array([s.pages["host"][0].as_py()] * len(mine), pa.int64()), "page": mine, "like": like})

    known = told(leads, part=F.col("part"), windows=F.col("windows"), numbers=F.col("leads"))
    stands = roots(put_by(in_shards(held, known, copies, "host long, page long, like long"), "copies"))
    of = lambda page: F.shiftright(page, PAGE_BITS)
    # pages that stand for some of other shards are not counted in each shard, but listed
    spread = stands.where(of("page") != of("like")).select("host", "like").distinct()
    shared = stands.join(spread.withColumn("shared", F.lit(True)), ["host", "like"], "left").select("host", "page", "like", F.coalesce("shared", F.lit(False)).alias("shared"))
    shared = shared.unionByName(spread.select("host", F.col("like").alias("page"), "like", F.lit(True).alias("shared")))
    of_pages = told(put_by(shared.withColumn("unit", of("page")), "shared"), page=F.col("page"), n=F.col("like"), shared=F.col("shared"))

    def stood(s: Shard, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """What each page counts as, and whether that is shared."""
        rows = told.filter(pa.compute.is_valid(told["shared"]))
        stands, shared = s.number.copy(), np.zeros(len(s.number), bool)
        at = np.searchsorted(s.number, column(rows, "page"))
        stands[at] = column(rows, "n")
        shared[at] = rows["shared"].to_numpy().astype(bool)
        return stands, shared

    def counts(s: Shard, told: pa.Table) -> pa.Table:
        stands, shared = stood(s, told)
        rows, windows, _ = of_windows(told)
        asked = all_of(windows)
        n = int(s.which.max(initial=-1)) + 1
        mine = ~shared[s.of]
        here = pages_with(s.which[mine], stands[s.of][mine], n)[asked]
        known, at = np.unique(stands[s.of][~mine], return_inverse=True)
        pairs = distinct_of(s.which[~mine] * max(1, len(known)) + at)
        window, listed = pairs // max(1, len(known)), known[pairs % max(1, len(known))]
        ends = np.searchsorted(window, np.arange(n + 1))
        sizes = ends[asked + 1] - ends[asked]
        listed = listed[np.repeat(ends[asked] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        packs = [len(x) for x in windows]
        of_packs = [int(x.sum()) for x in cut_at(sizes, packs)][: len(packs)]
        found = {k: pa.array([packed(x) for x in cut_at(v, p)][: len(packs)], pa.binary()) for k, v, p in (("here", here, packs), ("sizes", sizes, packs), ("shared", listed, of_packs))}
        return pa.table(rows_of(rows, *UNIT, "part", "windows") | {"ids": rows["numbers"]} | found)

    asked = told(leads, part=F.col("part"), windows=F.col("windows"), numbers=F.col("ids"))
    per = in_shards(held, asked.unionByName(of_pages), counts, "host long, unit long, part int, windows binary, ids binary, here binary, sizes binary, shared binary")
    seen = put_by(seen_of(per), "seen")
    unstage(leads)
    distinct = held.groupBy("host").count().join(stands.groupBy("host").agg(F.count(F.lit(1)).alias("copies")), "host", "left").select("host", (F.col("count") - F.coalesce("copies", F.lit(0))).alias("distinct"))
    of_hosts = held.select(*UNIT).distinct().join(distinct, "host")

    def cut(s: Shard, told: pa.Table) -> pa.Table:
        stands, _ = stood(s, told)
        n = int(s.which.max(initial=-1)) + 1
        seen = pages_with(s.which, stands[s.of], n)
        _, windows, numbers = of_windows(told)
        seen[all_of(windows)] = numbers
        whole = told.filter(pa.compute.and_(pa.compute.is_null(told["windows"]), pa.compute.is_null(told["page"])))
        gone = covered(s.start, seen[s.which], s.kind, whole["n"][0].as_py(), length)
        tokens, words = said_in(s)
        word = tokens >= 3
        # where blocks begin and pages end, each with the next; pages with a marked part have no other text
        edge = np.flatnonzero(~word)
        page, kind = np.searchsorted(s.begin, edge, "right") - 1, s.kind[edge]
        main = np.zeros(len(s.number), bool)
        size = np.diff(edge, append=len(tokens)) - 1
        main[page[(kind == IN) & (size > 0)]] = True
        mine = np.flatnonzero((size > 0) & (kind == np.where(main[page], IN, OPEN)))
        names = np.array(words, object)
        blocks = [(p, b, " ".join(names[tokens[b + 1 : b + 1 + n] - 3])) for p, b, n in zip(page[mine].tolist(), edge[mine].tolist(), size[mine].tolist(), strict=True)]
        said, spread = (np.add.reduceat(x.astype(np.int64), s.begin) for x in (word, word & gone))
        return texts_table(s.pages, list(zip(left_of(blocks, gone, len(s.number), length), said.tolist(), spread.tolist(), strict=True)))

    every = told(seen, part=F.col("part"), windows=F.col("windows"), numbers=F.col("seen")).unionByName(of_pages).unionByName(told(of_hosts, n=F.col("distinct")))
    return in_shards(pages.select(*UNIT, "page", "kinds", "tokens", "windows", "words", "page_id", "url"), every, cut, TEXTS)


def main_texts(pages: DataFrame, length: int = LENGTH) -> DataFrame:
    """page_id, url, text and n_chars of every page; n_words of its stream, and how many of them recur on its host."""
    rows = only(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    small, large, shards = dealt(rows)
    found = texts_of_hosts(in_blocks(small), length)
    if large is not None:
        found = found.unionByName(texts_of_shards(in_blocks(large), length, shards))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_words", "n_repeated")
