"""Benchmark decontamination by suffix arrays over the training text.

Each task cuts the documents it reads into shards of at most ``shard_words``
words (a longer document is a shard of its own) and builds a suffix array of
the shard: the start positions, ordered by the words that follow, compared to
the depth of one window. Only suffixes that could match are kept, those that
start a run of benchmark words as long as the shortest window, so the sort
costs little where nothing leaks. Every test suffix is then binary-searched in
the array; the range it finds holds every verbatim occurrence. From each
hit that could begin a longer one, the longest verbatim match is read off the benchmark's own
suffix array, where it must stand next to the searched suffix.

The benchmark is the stated query set. It is read in blocks of at most
``block_words`` words, each broadcast once; ``pass_blocks`` of them at most are
scanned in one pass over the documents' text, which bounds what a task holds.
Texts are never shuffled.

Defined cases: null and word-less texts have no words and no hits; a null
item text adds no window; repeated items count once per distinct ``item_id``;
a null ``item_id`` is reported as the text ``null``; an empty benchmark finds
nothing; documents of equal id are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import frugal

WINDOW = 10
#: Letters, digits and everything beyond ASCII stay (A-Z lower-cased); the rest separates.
_WORDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def suffix_array(a: np.ndarray) -> np.ndarray:
    """Start positions of ``a``'s suffixes in order, by prefix doubling."""
    n = len(a)
    if not n:
        return np.zeros(0, dtype=np.int64)
    rank = np.unique(a, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[: max(0, n - width)] = rank[width:]
        order = np.lexsort((second, rank))
        step = (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)
        rank[order] = np.concatenate(([0], np.cumsum(step)))
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


class TestSet:
    """One block of benchmark items: windows, their items, and the block's own suffix array."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        seqs: list[tuple[str, list[int]]] = []
        for item_id, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            if seq:
                seqs.append((item_id, seq))
        #: depth -> {window key: sorted item ids}; items of fewer words are windows of their own depth
        found: dict[int, dict[bytes, set[str]]] = {}
        for item_id, seq in seqs:
            depth = min(window, len(seq))
            a = np.asarray(seq, dtype=">u4")
            for i in range(len(seq) - depth + 1):
                found.setdefault(depth, {}).setdefault(a[i : i + depth].tobytes(), set()).add(item_id)
        self.windows: dict[int, tuple[np.ndarray, list[tuple[str, ...]]]] = {}
        for depth, keys in found.items():
            ordered = sorted(keys)
            self.windows[depth] = (np.frombuffer(b"".join(ordered), dtype=f"S{4 * depth}"), [tuple(sorted(keys[k])) for k in ordered])
        self.shortest = min(found, default=0)
        #: the block's words, a 0 after each item, and their suffix array
        self.text = np.asarray([w for _, seq in seqs for w in (*seq, 0)], dtype=np.int64)
        self.order = suffix_array(self.text)
        self.items = [item_id for item_id, _ in seqs]
        self.starts = np.cumsum([0, *(len(seq) + 1 for _, seq in seqs)])

    def _common(self, tail: np.ndarray, at: int) -> int:
        n = min(len(tail), len(self.text) - at)
        differ = np.flatnonzero(self.text[at : at + n] != tail[:n])
        return int(differ[0]) if len(differ) else n

    def longest(self, tail: np.ndarray) -> tuple[int, str, int]:
        """Longest prefix of ``tail`` that stands verbatim in an item: (words, item, offset)."""
        lo, hi = 0, len(self.order)
        while lo < hi:
            mid = (lo + hi) // 2
            at = int(self.order[mid])
            n = self._common(tail, at)
            if n < len(tail) and (n == len(self.text) - at or self.text[at + n] < tail[n]):
                lo = mid + 1
            else:
                hi = mid
        n, at = max((self._common(tail, int(self.order[k])), -int(self.order[k])) for k in (lo - 1, lo) if 0 <= k < len(self.order))
        item = int(np.searchsorted(self.starts, -at, side="right") - 1)
        return n, self.items[item], int(-at - self.starts[item])


def _keys(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes' first ``depth`` words as big-endian bytes, which compare as the words do."""
    grid = ids[at[:, None] + np.arange(depth)[None, :]].astype(">u4")
    return np.ascontiguousarray(grid).view(f"S{4 * depth}").reshape(-1)


def scan_shard(test: TestSet, docs: list[list[bytes]]) -> list[tuple[list[int], set[str], tuple[int, str, int, int]]]:
    """For each document: hit word positions, items found, (longest words, item, offset in item, offset in document)."""
    out: list[tuple[list[int], set[str], tuple[int, str, int, int]]] = [([], set(), (0, "", -1, -1)) for _ in docs]
    if not test.shortest:
        return out
    get = test.ids.get
    lengths = np.fromiter((len(d) for d in docs), dtype=np.int64, count=len(docs))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # one separator after each document
    ids = np.zeros(starts[-1] + test.window, dtype=np.uint32)
    for d, s, n in zip(docs, starts, lengths):
        if n:
            ids[s : s + n] = np.fromiter((get(w, 0) for w in d), dtype=np.uint32, count=n)
    # length of the run of benchmark words that starts at each position
    stops = np.flatnonzero(ids == 0)
    live = np.flatnonzero(ids)
    if not len(live):
        return out
    run = stops[np.searchsorted(stops, live)] - live
    hit = np.zeros(len(ids) + 1, dtype=np.int32)
    begins: list[np.ndarray] = []
    for depth, (windows, items) in test.windows.items():
        at = live[run >= depth]
        if not len(at):
            continue
        keys = _keys(ids, at, depth)
        order = np.argsort(keys, kind="stable")  # the shard's suffix array to this depth
        suffix_keys, at = keys[order], at[order]
        lo = np.searchsorted(suffix_keys, windows, side="left")
        hi = np.searchsorted(suffix_keys, windows, side="right")
        for w in np.flatnonzero(hi > lo):
            where = at[lo[w] : hi[w]]
            np.add.at(hit, where, 1)
            np.add.at(hit, where + depth, -1)
            begins.append(where)
            for d in np.unique(np.searchsorted(starts, where, side="right") - 1).tolist():
                out[d][1].update(items[w])
    if not begins:
        return out
    covered = np.flatnonzero(np.cumsum(hit) > 0)
    of = np.searchsorted(starts, covered, side="right") - 1
    edges = np.flatnonzero(np.diff(of)) + 1
    for part, d in zip(np.split(covered, edges), of[np.concatenate(([0], edges))].tolist()):
        out[d][0].extend((part - starts[d]).tolist())
    first = np.unique(np.concatenate(begins))
    last = first[np.concatenate((np.diff(first) > 1, [True]))]
    for p, end in zip(first.tolist(), last[np.searchsorted(last, first)].tolist()):
        d = int(np.searchsorted(starts, p, side="right") - 1)
        if end - p + test.window <= out[d][2][0]:  # all windows of a longer match would be hits
            continue
        stop = int(stops[np.searchsorted(stops, p)])
        n, item, offset = test.longest(ids[p:stop].astype(np.int64))
        if n > out[d][2][0]:
            out[d] = (out[d][0], out[d][1], (n, item, offset, int(p - starts[d])))
    return out


_FOUND = "struct<hit:array<int>,items:array<string>,n_words:long,longest:int,longest_item:string,longest_item_at:int,longest_at:int>"
_FOUND_ARROW = pa.struct([("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("n_words", pa.int64()), ("longest", pa.int32()), ("longest_item", pa.string()), ("longest_item_at", pa.int32()), ("longest_at", pa.int32())])


def _merged(new: dict, old: dict) -> dict:
    out = new | {"hit": sorted({*new["hit"], *old["hit"]}), "items": sorted({*new["items"], *old["items"]})}
    if old["longest"] >= new["longest"]:
        out |= {k: old[k] for k in ("longest", "longest_item", "longest_item_at", "longest_at")}
    return out


def _scanner(blocks: list, text_at: int, shard_words: int, first: bool, drop_text: bool, found: str):
    """Scans every document for all ``blocks``; what an earlier pass has found is in the last column unless this is the ``first``."""

    def scanned(shard: list[list[bytes]]) -> list[dict]:
        rows: list[dict] = []
        for block in blocks:
            new = [
                {"hit": hit, "items": sorted(items), "n_words": len(d), "longest": longest[0], "longest_item": longest[1] or None, "longest_item_at": longest[2], "longest_at": longest[3]}
                for d, (hit, items, longest) in zip(shard, scan_shard(block.value, shard))
            ]
            rows = [_merged(n, o) for n, o in zip(new, rows)] if rows else new
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            shard: list[list[bytes]] = []
            held = 0
            for text in batch.column(text_at):
                shard.append(words(text.as_py()))
                held += len(shard[-1])
                if held >= shard_words:
                    rows += scanned(shard)
                    shard, held = [], 0
            rows += scanned(shard)
            if not first:
                rows = [_merged(n, o) for n, o in zip(rows, batch.column(batch.num_columns - 1).to_pylist())]
            keep = [i for i in range(batch.num_columns - (0 if first else 1)) if not (drop_text and i == text_at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(rows, type=_FOUND_ARROW)], names=[*(batch.schema.names[i] for i in keep), found])

    return run


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size, one partition at a time on the driver."""
    block: list[tuple[str, str | None]] = []
    held = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").alias("t")).toLocalIterator(prefetchPartitions=False):
        n = len(row.t or "") // 4 + 1
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", keep_text: bool = True, shard_words: int = 250_000, block_words: int = 200_000, pass_blocks: int = 8, found: str = "_leak") -> DataFrame:
    """``docs`` with a struct column ``found``: hit word positions, items, word count, the longest match and its places."""
    spark = docs.sparkSession
    out = docs
    blocks = [spark.sparkContext.broadcast(TestSet(items, window)) for items in item_blocks(benchmark, block_words)] or [spark.sparkContext.broadcast(TestSet([], window))]
    for at in range(0, len(blocks), pass_blocks):
        first, last = at == 0, at + pass_blocks >= len(blocks)
        run = _scanner(blocks[at : at + pass_blocks], docs.columns.index(text), shard_words, first, last and not keep_text, found)
        fields = [f for f in docs.schema.fields if not (last and not keep_text and f.name == text)]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{found}` {_FOUND}"
        out = out.mapInArrow(frugal(run), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    found = "_leak"
    while found in docs.columns:
        found += "_"
    scanned = find_leaks(docs, benchmark, found=found, **options)
    return scanned.filter(F.size(F.col(f"{found}.hit")) == 0).select(*docs.columns)


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: the contract's columns, then the longest verbatim match."""
    scanned = find_leaks(docs.select("doc_id", "text"), benchmark, keep_text=False, **options)
    leak = F.col("_leak")
    return scanned.select(
        "doc_id",
        leak["n_words"].alias("n_words"),
        F.size(leak["hit"]).cast("long").alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"),
        (F.size(leak["hit"]) > 0).alias("contaminated"),
        leak["longest"].cast("long").alias("longest_words"),
        leak["longest_item"].alias("longest_item"),
        leak["longest_item_at"].alias("longest_item_at"),
        leak["longest_at"].alias("longest_at"),
    )
