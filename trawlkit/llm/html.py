"""Main text of web pages: page structure first, then a suffix array per host for what structure leaves open.

Structure. A page is cut into blocks of text in page order. An ``article`` (else
``main``) names the text; navigation, headers outside it, footers, sidebars,
forms, scripts and hidden parts are left out by element or role, and notices,
adverts, comments and the like by words of class or id, unless the word is
denied (``no-sidebar``) or stands on the article itself. An inline part that is
left out does not cut the block around it. Where an article has less than a
third of the text that its page's ``main`` has besides, ``main`` is the text. An
article of which marks would leave nothing keeps its marked blocks.

Suffix array. A page that names no article is open: whichever of its blocks
repeat over the host's pages are boilerplate. The token streams of the pages of
hosts with open pages (all blocks outside articles) are concatenated, with a
separator of its own after each page, and the suffix array of the whole is
sorted by prefix doubling, with the common prefixes of neighbours. A range of
suffixes that share ``run_tokens`` tokens and come from at least ``min_pages``
different pages is a long repeated substring: the tokens it covers are taken out
of open pages, and unique runs stay. Pages of equal streams count once, so a
copied page does not wipe out its own text, nor do two near copies.

A host's tokens are hashed together with its name, so that one array may serve
many small hosts. A host of more than ``shard_tokens`` is dealt over several
arrays by page; windows that repeat in none of them are counted over all of the
host's arrays by their hashes, summed map-side, so that no repeat is missed and
a hot host never meets in one task.

Defined cases: null html is empty; an empty or text-less page gives the empty
text; unclosed elements end with their parents; an unclosed comment, script or
style runs to the end; a page without a host (null or odd url) is of the host
``""``; repeated rows give equal rows; extra columns are ignored; three or more
near copies of a page that names no article lose what they share.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import drop_saved, frugal, group_edges, saved, whole_groups
from trawlkit.llm.decontaminate import suffix_array

RUN_TOKENS, MIN_PAGES, SHARD_TOKENS = 8, 3, 250_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_LEFT_OUT = frozenset("nav footer aside form label script style noscript template button select option textarea iframe svg canvas object audio video dialog menu head search datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr "
    "notice notices newsletter subscribe signup popup modal overlay share sharing social related recommended recommendations comment comments commentlist disqus respond replies widget toolbar pagination pager login".split()
)
_DENIED = frozenset("no non not without has have with".split())
_NEVER_MARKED = frozenset("html body article main".split())
#: elements whose start closes an open element of the same or a like kind, within the same list, table or article
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table select article main".split())


class State(NamedTuple):
    """Where text stands: 2 in an article, 1 in main, 0 elsewhere; left out by element or role; left out by a mark."""

    place: int = 0
    strong: bool = False
    weak: bool = False


class Block(NamedTuple):
    text: str
    state: State


def _marked(attrs: dict[str, str]) -> bool:
    for key in ("class", "id"):
        for token in attrs.get(key, "").lower().split():
            words = {*re.split(r"[^a-z0-9]+", token)}
            if words & _MARKS and not words & _DENIED:
                return True
    return False


class _Page:
    """The walk over a page's tags: open elements by name and place, so that no step looks through them all."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.states = [State()]
        self.names = [""]
        #: places of the open elements of each name
        self.open: dict[str, list[int]] = {}
        self.scopes = [0]
        #: text of the running block, by state
        self.parts: dict[State, list[str]] = {}

    def text(self, piece: str) -> None:
        self.parts.setdefault(self.states[-1], []).append(_html.unescape(piece))

    def flush(self) -> None:
        for state, pieces in self.parts.items():
            if text := " ".join("".join(pieces).split()):
                self.blocks.append(Block(text, state))
        self.parts = {}

    def close(self, name: str) -> None:
        """Closes the innermost open element of this name with all that is open in it."""
        places = self.open.get(name)
        if not places:
            return
        at = places[-1]
        for gone in reversed(self.names[at:]):
            self.open[gone].pop()
            if gone in _BLOCKS:
                self.flush()
        del self.names[at:], self.states[at:]
        while self.scopes[-1] >= at:
            self.scopes.pop()

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name in _BLOCKS:
            self.flush()
            if self.open.get("p") and name != "br":
                self.close("p")
        for like in _CLOSES.get(name, ()):
            if (places := self.open.get(like)) and places[-1] > self.scopes[-1]:
                self.close(like)
        if name in _VOID or name in _RAW:
            return
        up, role = self.states[-1], attrs.get("role", "").strip().lower()
        place = max(up.place, 2 if name == "article" or "articlebody" in attrs.get("itemprop", "").lower() else 1 if name == "main" or role == "main" else 0)
        strong = up.strong or name in _LEFT_OUT or name == "header" and place == 0 or name not in _NEVER_MARKED and (role in _ROLES or "hidden" in attrs)
        weak = up.weak and place == up.place or name not in _NEVER_MARKED and _marked(attrs)
        self.open.setdefault(name, []).append(len(self.names))
        if name in _SCOPES:
            self.scopes.append(len(self.names))
        self.names.append(name)
        self.states.append(State(place, strong, weak))


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in page order."""
    walk = _Page()
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            walk.text(page[at:])
            break
        if lt > at:
            walk.text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("/", lt + 1)
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                walk.text("<")
                at = lt + 1
            continue
        name, at = m[0].lower(), m.end()
        attrs: dict[str, str] = {}
        while at < n:
            c = page[at]
            if c == ">":
                at += 1
                break
            m = _ATTR.match(page, at)
            if not m:
                at += 1
                continue
            value = m[2] or ""
            attrs.setdefault(m[1].lower(), _html.unescape(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value))
            at = m.end()
        if closing:
            if name in _BLOCKS:
                walk.flush()
            walk.close(name)
            continue
        walk.start(name, attrs)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
    walk.flush()
    return walk.blocks


def article_blocks(found: list[Block]) -> list[str] | None:
    """The text of a page that names its article; None for an open page."""
    size = lambda texts: sum(map(len, texts))
    kept = {place: [b.text for b in found if b.state == (place, False, False)] for place in (1, 2)}
    if kept[2] and 3 * size(kept[2]) >= size(kept[1]):
        return kept[2]
    if kept[1]:
        return [b.text for b in found if b.state.place and not b.state.strong and not b.state.weak]
    for place in (2, 1):
        marked = [b.text for b in found if b.state == (place, False, True)]
        if marked:
            return marked
    return None if any(not b.state.strong and not b.state.weak for b in found) else []


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def token_hashes(host: str, tokens: list[str]) -> np.ndarray:
    """A host's tokens as 64-bit words, which tokens of other hosts do not share."""
    seed = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed) for t in tokens), dtype=np.uint64, count=len(tokens))


def common_prefixes(a: np.ndarray, order: np.ndarray) -> np.ndarray:
    """[k]: how many tokens the suffixes ``order[k - 1]`` and ``order[k]`` begin with in common; 0 first."""
    text, sa = a.tolist(), order.tolist()
    n = len(text)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    out = [0] * n
    h = 0
    for i, r in enumerate(rank.tolist()):
        if not r:
            h = 0
            continue
        j = sa[r - 1]
        stop = n - max(i, j)
        while h < stop and text[i + h] == text[j + h]:
            h += 1
        out[r] = h
        h = max(0, h - 1)
    return np.array(out, dtype=np.int64)


def repeated_starts(streams: list[np.ndarray], pages: list[bytes], depth: int = RUN_TOKENS, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each stream, the places where a window of ``depth`` tokens begins that stands on at least ``min_pages`` different pages."""
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    values, ids = np.unique(np.concatenate(streams) if streams else np.zeros(0, dtype=np.uint64), return_inverse=True)
    # a separator of its own ends each page: no common prefix reaches over it
    a = np.arange(len(values), len(values) + len(streams) + len(ids), dtype=np.int64)
    owner = np.repeat(np.arange(len(streams)), lengths + 1)
    token = np.ones(len(a), dtype=bool)
    token[starts + lengths] = False
    a[token] = ids
    a[~token] = len(values) + np.arange(len(streams))
    order = suffix_array(a)
    ranges = np.cumsum(common_prefixes(a, order) < depth)
    kinds = np.unique(np.array(pages, dtype=object).astype(str), return_inverse=True)[1] if streams else np.zeros(0, dtype=np.int64)
    met = np.unique(np.stack((ranges, kinds[owner[order]])), axis=1)
    wide = np.bincount(met[0], minlength=int(ranges[-1]) + 1 if len(ranges) else 0) >= min_pages
    found = order[wide[ranges]]
    found = np.sort(found[token[found]])
    cut = np.searchsorted(found, np.append(starts, len(a)))
    return [found[lo:hi] - s for lo, hi, s in zip(cut, cut[1:], starts)]


def window_hashes(stream: np.ndarray, depth: int) -> np.ndarray:
    held = np.zeros(max(0, len(stream) - depth + 1), dtype=np.uint64)
    for k in range(depth):
        held = (held ^ (held >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + stream[k : k + len(held)]
    return held ^ (held >> np.uint64(32))


_PARSED = "`key` {key}, url string, host string, text string, is_open boolean, outside array<string>"


def parsed(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """A row per page: text (of the article), whether it is open, and the blocks outside articles (an open page's: those not left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2)):
                found = blocks(page.as_py() or "")
                own = article_blocks(found)
                outside = [b.text for b in found if not b.state.strong and not b.state.weak] if own is None else [b.text for b in found if not b.state.place]
                rows.append((url, host_of(url), "\n".join(own or ()), own is None, outside))
            cols = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["key", "url", "host", "text", "is_open", "outside"])

    return pages.select(key, "url", "html").mapInArrow(frugal(run), _PARSED.format(key=dict(pages.dtypes)[key]))


def _streams(found: DataFrame) -> DataFrame:
    """(host, row, page, stream, n): each page's hashed tokens; ``page`` names the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [token_hashes(h or "", [w for b in o for w in b.split()]) for h, o in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            raw = [s.tobytes() for s in streams]
            names = [hashlib.blake2b(r, digest_size=8).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, type=pa.binary()), pa.array(raw, type=pa.binary()), pa.array([len(s) for s in streams], type=pa.int64())], names=["host", "row", "page", "stream", "n"])

    return found.select("host", "row", "outside").mapInArrow(frugal(run), "host string, row long, page binary, stream binary, n long")


_STARTS = "row long, page binary, starts array<int>, windows array<long>, known array<long>"
_STARTS_ARROW = pa.schema([("row", pa.int64()), ("page", pa.binary()), ("starts", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64())), ("known", pa.list_(pa.int64()))])


def _arrays(depth: int, min_pages: int, shard_tokens: int):
    """One suffix array for each run of whole groups of up to ``shard_tokens`` tokens; rows are (bucket, shard, split, row, page, stream) in order."""

    def solved(part: list[tuple]) -> pa.RecordBatch:
        streams = [np.frombuffer(s, dtype=np.uint64) for *_, s in part]
        rows = []
        known: list[np.ndarray] = []
        for (split, row, page, _), stream, starts in zip(part, streams, repeated_starts(streams, [p.hex() for _, _, p, _ in part], depth, min_pages)):
            windows: list[int] = []
            if split:
                hashes = window_hashes(stream, depth).view(np.int64)
                known.append(hashes[starts])
                hashes = hashes.copy()
                windows = hashes.tolist()
                for s in starts.tolist():
                    windows[s] = None
            rows.append({"row": row, "page": page, "starts": starts.tolist(), "windows": windows, "known": []})
        if known and rows:
            rows[0]["known"] = np.unique(np.concatenate(known)).tolist()
        return pa.RecordBatch.from_pylist(rows, schema=_STARTS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        held = 0
        for batch in whole_groups(batches, 2):
            cols = [batch.column(i).to_pylist() for i in range(6)]
            cuts = [*np.flatnonzero(group_edges([np.array(c) for c in cols[:2]])).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                group = [tuple(c[i] for c in cols[2:]) for i in range(lo, hi)]
                n = sum(len(g[3]) // 8 for g in group)
                if part and held + n > shard_tokens:
                    yield solved(part)
                    part, held = [], 0
                part += group
                held += n
        if part:
            yield solved(part)

    return run


def repeated(found: DataFrame, depth: int, min_pages: int, shard_tokens: int) -> DataFrame:
    """(row, starts): where the windows begin that repeat over a host's pages."""
    streams = saved(_streams(found), "streams")
    sizes = streams.groupBy("host").agg(F.sum("n").alias("all")).select("host", F.greatest(F.ceil(F.col("all") / shard_tokens), F.lit(1)).cast("int").alias("shards"))
    # a host's pages lie together: its hash is its bucket
    dealt = streams.join(sizes, "host").select(F.xxhash64("host").alias("bucket"), F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"), (F.col("shards") > 1).alias("split"), "row", "page", "stream")
    ordered = dealt.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard")
    told = saved(ordered.mapInArrow(_arrays(depth, min_pages, shard_tokens), _STARTS), "starts")
    starts = told.select("row", "starts")
    one_each = sizes.filter("shards > 1").isEmpty()
    drop_saved(streams)
    if one_each:
        return starts
    open_at = told.select("row", "page", F.posexplode("windows").alias("at", "window")).filter("window is not null")
    wide = open_at.select("window", "page").distinct().groupBy("window").count().filter(F.col("count") >= min_pages).select("window")
    wide = wide.union(told.select(F.explode("known").alias("window"))).distinct()
    more = open_at.join(wide, "window", "left_semi").groupBy("row").agg(F.collect_list("at").alias("more"))
    return starts.join(more, "row", "left").select("row", F.concat("starts", F.coalesce("more", F.array().cast("array<int>"))).alias("starts"))


def unique_runs(outside: list[str], covered: list[int], depth: int) -> str:
    """The blocks without the tokens that windows starting at ``covered`` reach."""
    gone = {p + i for p in covered for i in range(depth)}
    out, at = [], 0
    for block in outside:
        words = block.split()
        kept = [w for i, w in enumerate(words) if at + i not in gone]
        at += len(words)
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def main_text(pages: DataFrame, *, key: str = "page_id", run_tokens: int = RUN_TOKENS, min_pages: int = MIN_PAGES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per page: the key, url, text, n_chars."""
    found = saved(parsed(pages, key).withColumn("row", F.monotonically_increasing_id()), "parsed")
    done = found.filter("not is_open").select("key", "url", "text")
    loose = found.filter("is_open")
    if not loose.isEmpty():
        hosts = loose.select("host").distinct()
        starts = repeated(found.join(hosts, "host", "left_semi"), run_tokens, min_pages, shard_tokens)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [unique_runs(o.as_py(), c.as_py() or [], run_tokens) for o, c in zip(b.column(2), b.column(3))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, type=pa.string())], names=["key", "url", "text"])

        met = loose.join(starts, "row", "left").select("key", "url", "outside", "starts")
        done = done.unionByName(met.mapInArrow(run, f"key {dict(found.dtypes)['key']}, url string, text string"))
    return done.select(F.col("key").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))
