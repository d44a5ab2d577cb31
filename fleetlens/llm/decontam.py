"""Benchmark passages in documents, by a generalised suffix automaton of the test items (operator 3).

Items and texts are lower-cased (A-Z) and cut into words.  The automaton takes all items, each word
by its number in the items' vocabulary.  Words of a text that no item has can't lie in a match, so
only runs of known words are streamed through it; the length of the longest match that ends at each
word decides.  A match of `window` words or more, or of a whole shorter item, is an occurrence.
Matched words are compared byte by byte before they count.

Items go to automata of bounded size, by a hash of their id and text; up to AT_ONCE of them pass
over a block of documents one after the other, without a shuffle.  Should the items need more, the
documents are stored between passes.

Defined results: a null, empty or wordless text has no hit; a null, empty or wordless item occurs
nowhere.  Items without an id are found but not listed.  Repeated items count once by their id.
Repeated documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm.scratch import store

AT_ONCE = 8


class Automaton:
    """Generalised suffix automaton over word numbers.  State 0 is the root."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.window = window
        words = bw.split_words(pa.array([t for _, t in items], pa.string()), bw.ALNUM, lower=True)
        hashes = bw.hash_words(words)
        self.vocabulary, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
        self.spelling = [words.buf[words.start[i]:words.start[i] + words.length[i]].tobytes() for i in first]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        numbers = numbers.tolist()
        paths = []
        for k, (name, _) in enumerate(items):
            path = numbers[words.first[k]:words.first[k + 1]]
            paths.append((name, path))
            last = 0
            for w in path:
                last = self._extend(last, w)
        #: items of the windows that end in a state, by the state of exactly that length
        self.windows: dict[int, set] = {}
        self.shorts: dict[int, tuple[int, set]] = {}
        for name, path in paths:
            if 0 < len(path) < window:
                state = 0
                for w in path:
                    state = self.next[state][w]
                self.shorts.setdefault(state, (len(path), set()))[1].add(name)
            elif path:
                for state, length in self.stream(path):
                    if length >= window:
                        self.windows.setdefault(self.cut(state), set()).add(name)
        self.short_at = self._nearest()
        self.least = min([window] * bool(self.windows) + [n for n, _ in self.shorts.values()], default=0)

    def _extend(self, last: int, w: int) -> int:
        there = self.next[last].get(w)
        if there is not None and self.len[there] == self.len[last] + 1:
            return there
        if there is not None:
            return self._clone(last, w, there)
        state = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return state

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _nearest(self) -> list[int]:
        """For each state the nearest on its suffix path, itself included, that is a whole short item; 0: none."""
        out = [0] * len(self.len)
        if self.shorts:
            for state in sorted(range(1, len(self.len)), key=self.len.__getitem__):
                out[state] = state if state in self.shorts else out[self.link[state]]
        return out

    def stream(self, path: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = length = 0
        for w in path:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield state, length

    def cut(self, state: int) -> int:
        """The state of the last `window` words of what a state matches."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def known_runs(self, words: bw.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of runs of known words inside a document that are long enough to match; numbers of all words."""
        hashes = bw.hash_words(words)
        number = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[number] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        begins, ends = known.copy(), known.copy()
        begins[1:] &= ~known[:-1]
        ends[:-1] &= ~known[1:]
        inner = words.first[:-1][words.per_doc > 0]
        begins[inner] = known[inner]
        inner = words.first[1:][words.per_doc > 0] - 1
        ends[inner] = known[inner]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        enough = end - begin >= self.least
        return begin[enough], end[enough], number

    def matches(self, words: bw.Words) -> Iterator[tuple[int, int, set]]:
        """(first word, number of words, items) of every occurrence in a block, by word index."""
        if not self.least:
            return
        begin, end, number = self.known_runs(words)
        for lo, hi in zip(begin.tolist(), end.tolist()):
            path = number[lo:hi].tolist()
            for k, (state, length) in enumerate(self.stream(path), lo + 1):
                if length >= self.window and (items := self.windows.get(self.cut(state))):
                    if self._same(words, number, k - self.window, k):
                        yield k - self.window, self.window, items
                short = self.short_at[state]
                while short:
                    n, items = self.shorts[short]
                    if n <= length and self._same(words, number, k - n, k):
                        yield k - n, n, items
                    short = self.short_at[self.link[short]]

    def _same(self, words: bw.Words, number: np.ndarray, lo: int, hi: int) -> bool:
        return all(words.buf[words.start[i]:words.start[i] + words.length[i]].tobytes() == self.spelling[number[i]]
                   for i in range(lo, hi))


def automata(benchmark: DataFrame, item_col: str, text_col: str, window: int, shard_bytes: int) -> list:
    """Broadcast automata over all items, each over about shard_bytes of text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(
        "text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(-(-total // shard_bytes))
    context = benchmark.sparkSession.sparkContext
    out = []
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).collect()
        out.append(context.broadcast(Automaton([(r.item, r.text) for r in part], window)))
    return out


def _scan(automaton: Automaton, block: pa.RecordBatch) -> pa.RecordBatch:
    """Adds to the columns hits (packed word positions) and items of a block."""
    words = bw.split_words(block.column("_text"), bw.ALNUM, lower=True)
    hits = [x.as_py() for x in block.column("hits")]
    items = [x.as_py() for x in block.column("items")]
    docs = words.first[1:]
    found: dict[int, tuple[set, set]] = {}
    for first, n, names in automaton.matches(words):
        at, seen = found.setdefault(int(np.searchsorted(docs, first, "right")), (set(), set()))
        at.update(range(first, first + n))
        seen |= names
    for k, (at, seen) in found.items():
        own = np.fromiter(at, np.int64) - words.first[k]
        hits[k] = np.union1d(np.frombuffer(hits[k], "<i4"), own).astype("<i4").tobytes()
        items[k] = sorted({*items[k], *seen} - {None})
    return pa.RecordBatch.from_arrays(
        [*(block.column(c) for c in block.schema.names[:-3]), pa.array(words.per_doc, pa.int64()),
         pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], block.schema.names)


def _scanned(docs: DataFrame, benchmark: DataFrame, columns: list, item_col: str, bench_text: str, window: int,
             shard_bytes: int) -> DataFrame:
    rows = docs.select(*columns, F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("hits"),
                       F.array().cast("array<string>").alias("items"))
    shards = automata(benchmark, item_col, bench_text, window, shard_bytes)
    if not shards:  # the words are counted all the same
        shards = [docs.sparkSession.sparkContext.broadcast(Automaton([], window))]
    for lo in range(0, len(shards), AT_ONCE):
        def run(batches: Iterator[pa.RecordBatch], group=shards[lo:lo + AT_ONCE]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in bw.blocks(batch, "_text", bw.SMALL_BLOCK):
                    for shard in group:
                        block = _scan(shard.value, block)
                    yield block
        if lo:
            rows = store(rows, "scanned")
        rows = rows.mapInArrow(run, rows.schema)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", bench_text: str = "text", window: int = 10,
                  shard_bytes: int = 400_000) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, items (sorted ids of the items found in it)."""
    rows = _scanned(docs, benchmark, [F.col(id_col).alias("_id"), F.col(text_col).alias("_text")], item_col,
                    bench_text, window, shard_bytes)
    return rows.select(F.col("_id").alias(id_col), "n_words",
                       (F.octet_length("hits") / 4).cast("long").alias("n_hit"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  bench_text: str = "text", window: int = 10, max_coverage: float = 0.3,
                  shard_bytes: int = 400_000) -> DataFrame:
    """The documents, all columns, without benchmark passages.

    A document of whose words more than the share max_coverage is hit goes as a whole (0: any hit).  From the others the matched
    words are cut, with what stands between neighbours among them.
    """
    others = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = _scanned(docs, benchmark, [others.alias("_row"), F.col(text_col).alias("_text")],
                    item_col, bench_text, window, shard_bytes)
    rows = rows.where(F.octet_length("hits") <= 4 * max_coverage * F.col("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _without_hits(batch)

    if max_coverage > 0:
        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*[(F.col("_text") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _without_hits(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("_text").to_pylist()
    for k, hits in enumerate(batch.column("hits")):
        at = np.frombuffer(hits.as_py(), "<i4")
        if not len(at):
            continue
        words = bw.split_words(batch.column("_text").slice(k, 1), bw.ALNUM, lower=True)
        raw, parts, done = texts[k].encode(), [], 0
        for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
            parts.append(raw[done:words.start[run[0]]])
            done = words.start[run[-1]] + words.length[run[-1]]
        texts[k] = b"".join([*parts, raw[done:]]).decode()
    names = batch.schema.names
    return batch.set_column(names.index("_text"), "_text", pa.array(texts, pa.string()))
