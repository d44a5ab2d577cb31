"""How the sources of a language differ in their terms (operator 11).

Terms are runs of letters and non-ASCII bytes, A-Z lower-cased.  A language keeps the terms that
`least` of its documents hold; every source is then compared with every other one, and with its
language, over smoothed shares of the kept terms.

Kept terms are found by refining byte prefixes, as an iceberg query does.  The texts are read once;
each block leaves one packed table for each language (its terms, the documents of each, how often).
A level counts the distinct documents of all prefixes of its length (a shorter term is a prefix of
its own), adds the counts of all blocks and discards what stays below `least`.  The next level, of
double length, looks only at terms whose prefix was left.  A term that ends before its level's
length is complete and decided; levels end when no longer prefix is left.  A prefix has at least the
documents of any term it begins, so no kept term is lost.

What a level leaves reaches the tasks as a bitmap of `filter_bits` hashed prefixes, 2 MB at any
size of the corpus.  It only spares rows their way to the count: a prefix that slips through is
counted as well and discarded by its own number.

Counts by source are partial sums before any shuffle, over kept terms only.  Pairs of sources meet
in blocks of `source_block` by `source_block` sources and about `term_block` terms, as numpy
matrices; terms that a block's sources lack altogether count through one product at the end.  The
answer itself has a row for each pair of sources of a language; no other all-pairs table is made.

Defined results: null text, language or source is the empty one.  Every row is a document of its
own, whatever its id.  A language without kept terms has V = 0: its pairs have value 0, in the order
of the items, and it has no `term` rows.  An empty table gives no row.  A source alone in its language
has no `pair` rows.  Other columns play no part.  Inside a block, terms and prefixes are told apart
by 64 bits of hash; across blocks they are compared themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm.scratch import store

LETTERS = np.zeros(256, bool)  # terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+ of lower-cased text
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

SHARE = 1_000_000_000


def _put(values: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest of them takes, with their number and width."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return np.array([len(values), width], "<i8").tobytes() + values.astype(f"<u{width}").tobytes()


def _get(data: memoryview) -> tuple[np.ndarray, memoryview]:
    n, width = np.frombuffer(data[:16], "<i8").tolist()
    end = 16 + n * width
    return np.frombuffer(data[16:end], f"<u{width}").astype(np.int64), data[end:]


class TermTable:
    """Terms of one language in one block: for each its bytes, the documents it is in and how often it is in each."""

    def __init__(self, lang: str, payload: pa.Buffer) -> None:
        data = memoryview(payload)
        self.lengths, data = _get(data)
        self.per_term, data = _get(data)
        self.doc, data = _get(data)
        self.times, data = _get(data)
        self.source_of, data = _get(data)
        self.buf = bw.padded(np.frombuffer(data, np.uint8))
        self.start = np.cumsum(self.lengths) - self.lengths
        self.seed = xxhash.xxh64_intdigest(lang.encode(), seed=42)

    @staticmethod
    def packed(words: bw.Words, doc: np.ndarray, source_of: np.ndarray) -> bytes:
        """From the terms' places in a buffer, the document of each and the source of each document."""
        h = bw.hash_words(words)
        _, first, term = np.unique(h, return_index=True, return_inverse=True)
        pair, times = np.unique(term * len(source_of) + doc, return_counts=True)
        per_term = np.bincount(pair // len(source_of), minlength=len(first))
        length = words.length[first]
        return b"".join([_put(length), _put(per_term), _put(pair % len(source_of)), _put(times), _put(source_of),
                         words.buf[bw.ragged(words.start[first], length)].tobytes()])

    def hashes(self, length: int | None = None) -> np.ndarray:
        """Of the first `length` bytes of each term, equal to xxhash64(lang, prefix) of Spark."""
        size = self.lengths if length is None else np.minimum(self.lengths, length)
        with np.errstate(over="ignore"):
            return bw.xxh64(self.buf, self.start, size, self.seed)

    def select(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all (term, document) pairs of these terms, and the term of each by its place in `terms`."""
        first = np.cumsum(self.per_term) - self.per_term
        n = self.per_term[terms]
        return bw.ragged(first[terms], n), np.repeat(np.arange(len(terms)), n)

    def prefix_documents(self, terms: np.ndarray, length: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct prefixes of these terms and the number of documents of each."""
        _, first, prefix = np.unique(self.hashes(length)[terms], return_index=True, return_inverse=True)
        at, own = self.select(terms)
        docs = len(self.source_of)
        pair = np.unique(prefix[own] * docs + self.doc[at])
        some = terms[first]
        size = np.minimum(self.lengths[some], length)
        return self.slices(some, size, pa.binary()), np.bincount(pair // docs, minlength=len(first))

    def slices(self, terms: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        data = self.buf[bw.ragged(self.start[terms], size)]
        return pa.Array.from_buffers(kind, len(terms), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _tables(block: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, sources, payload) for each language of a block of (lang, source, text)."""
    langs, sources = (block.column(k).dictionary_encode() for k in (0, 1))
    lang, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (langs, sources))
    names = sources.dictionary.to_pylist()
    words = bw.split_words(block.column(2), LETTERS, lower=True)
    doc = words.doc()
    out = []
    for k, name in enumerate(langs.dictionary.to_pylist()):
        own = np.flatnonzero(lang == k)
        local = np.full(len(lang), -1, np.int64)
        local[own] = np.arange(len(own))
        at = np.flatnonzero(lang[doc] == k)
        if not len(at):
            continue
        some, source_of = np.unique(source[own], return_inverse=True)
        part = bw.Words(words.buf, words.start[at], words.length[at], np.zeros(1, np.int64))
        out.append((name, [names[s] for s in some], TermTable.packed(part, local[doc[at]], source_of)))
    columns = list(zip(*out)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.string())),
         pa.array(columns[2], pa.binary())], ["lang", "sources", "payload"])


def term_tables(rows: DataFrame) -> DataFrame:
    """The packed tables of (lang, source, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 2):
                yield _tables(block)

    return rows.mapInArrow(run, "lang string, sources array<string>, payload binary")


def _bitmap(left: DataFrame, term: str, filter_bits: int) -> np.ndarray:
    """One bit for each hash of (lang, term) modulo filter_bits, a power of two; filter_bits / 8 bytes reach the driver."""
    bit = F.pmod(F.xxhash64("lang", term), F.lit(filter_bits))
    parts = left.groupBy(F.shiftright(bit, 15).alias("part")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    out = np.zeros((max(filter_bits >> 15, 1), 4096), np.uint8)
    for r in parts.collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()[:filter_bits >> 3]


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)  # Spark's pmod by a power of two
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def kept_terms(tables: DataFrame, least: int = 10, first_length: int = 3, filter_bits: int = 1 << 24) -> DataFrame:
    """(lang, term, docs) of the terms that at least `least` documents of the language hold, by prefix refinement."""
    spark = tables.sparkSession
    length, before, passed, kept = first_length, 0, None, None
    while True:
        def count(batches: Iterator[pa.RecordBatch], length=length, before=before, passed=passed
                  ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, payload in zip(batch.column(0).to_pylist(), batch.column(2)):
                    table = TermTable(lang, payload.as_buffer())
                    alive = table.lengths >= before
                    if passed is not None:
                        alive &= _passes(passed.value, table.hashes(before))
                    prefix, docs = table.prefix_documents(np.flatnonzero(alive), length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(prefix), pa.string()), prefix, pa.array(docs, pa.int64())],
                        ["lang", "prefix", "docs"])

        counted = tables.mapInArrow(count, "lang string, prefix binary, docs long")
        left = counted.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        left = store(left, f"prefixes-{length}")
        complete = left.where(F.octet_length("prefix") < length).select("lang", F.col("prefix").cast("string").alias("term"), "docs")
        kept = complete if kept is None else kept.unionByName(complete)
        longer = left.where(F.octet_length("prefix") == length)
        if longer.isEmpty():
            return kept
        passed = spark.sparkContext.broadcast(_bitmap(longer, "prefix", filter_bits))
        length, before = 2 * length, length


def term_counts(tables: DataFrame, kept: DataFrame, filter_bits: int = 1 << 24) -> DataFrame:
    """(lang, source, term, n): how often each kept term occurs in each source that has it."""
    passed = tables.sparkSession.sparkContext.broadcast(_bitmap(kept, "term", filter_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sources, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                table = TermTable(lang, payload.as_buffer())
                terms = np.flatnonzero(_passes(passed.value, table.hashes()))
                at, own = table.select(terms)
                cell, inverse = np.unique(own * len(sources) + table.source_of[table.doc[at]], return_inverse=True)
                n = np.zeros(len(cell), np.int64)
                np.add.at(n, inverse, table.times[at])
                some = terms[cell // len(sources)]
                names = pa.array(sources, pa.string()).take(pa.array(cell % len(sources)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(cell), pa.string()), names,
                     table.slices(some, table.lengths[some], pa.string()), pa.array(n, pa.int64())],
                    ["lang", "source", "term", "n"])

    found = tables.mapInArrow(count, "lang string, source string, term string, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(
        kept.select("lang", "term"), ["lang", "term"], "left_semi")


def _share(n: str, total: str, terms: str) -> F.Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact in decimals; 0 where a language keeps no term."""
    return F.expr(f"if({terms} = 0, 0L, 1L + (cast({SHARE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0)))"
                  f" div cast({total} + 2 * {terms} as decimal(20,0)))")


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of 64-bit numbers up to 10^9 + 1; 0 where both are 0."""
    d = p - q
    d *= d
    d //= np.maximum(p + q, 1)
    return d


def pair_sums(cells: DataFrame, sources: DataFrame, terms: int, source_block: int, term_block: int) -> DataFrame:
    """(lang, i, j, value) for all i < j: the sum of distances over all V kept terms of the language.

    cells: (lang, i, term, p) where a source has the term; sources: (lang, i, p0, terms), p0 the share of absent terms.
    """
    parts = max(1, -(-terms // term_block))
    size = sources.groupBy("lang").agg(F.floor((F.max("i") / source_block)).cast("int").alias("last"))

    def met(rows: DataFrame) -> DataFrame:
        """Each row once for each pair of source blocks that its own block belongs to."""
        own = F.floor(F.col("i") / source_block).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("last")))
        rows = rows.join(size, "lang").withColumn("own", own).withColumn("other", other)
        return rows.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))

    absent = met(sources).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    names = ["lang", "a", "b", "part", "i", "term", "p"]
    rows = met(cells).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).select(*names)
    rows = rows.unionByName(absent.select("lang", "a", "b", "part", "i", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p")))

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        lang, a, b = (k.as_py() for k in key[:3])
        term = table.column("term").combine_chunks()
        source, p = (table.column(c).to_numpy() for c in ("i", "p"))
        base = term.is_null().to_numpy(zero_copy_only=False)
        index, order = source[base], np.argsort(source[base])
        index, p0 = index[order], p[base][order]
        coded = term.dictionary_encode()
        width = len(coded.dictionary)
        matrix = np.repeat(p0[:, None], width, axis=1)
        code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)
        matrix[np.searchsorted(index, source[~base]), code[~base]] = p[~base]
        block = index // source_block
        out: list[tuple[np.ndarray, ...]] = []
        for x in np.flatnonzero(block == a):
            others = np.flatnonzero((block == b) & (index > index[x]))
            alone = _distances(p0[x], p0[others])
            more = _distances(matrix[x], matrix[others]).sum(axis=1) - width * alone
            out.append((np.full(len(others), index[x]), index[others], more, alone))
        i, j, more, alone = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 4))
        return pa.table([pa.array([lang] * len(i), pa.string()), *(pa.array(c, pa.int64()) for c in (i, j, more, alone))],
                        ["lang", "i", "j", "more", "alone"])

    found = rows.groupBy("lang", "a", "b", "part").applyInArrow(sums, "lang string, i long, j long, more long, alone long")
    found = found.groupBy("lang", "i", "j").agg(F.sum("more").alias("more"), F.max("alone").alias("alone"))
    return found.join(sources.select("lang", "terms").distinct(), "lang").select(
        "lang", "i", "j", (F.col("more") + F.col("terms") * F.col("alone")).alias("value"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               least: int = 10, top: int = 10, source_block: int = 64, term_block: int = 4096) -> DataFrame:
    """lang, source, part, item, value and rank: `pair` rows for all other sources, `term` rows for the `top` terms."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in
                         ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    tables = store(term_tables(rows), "term-tables")
    kept = store(kept_terms(tables, least), "kept-terms")
    counts = store(term_counts(tables, kept), "term-counts")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.groupBy("lang", "source").agg(F.lit(True)).select("lang", "source")
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"),
        F.coalesce("terms", F.lit(0).cast("long")).alias("terms"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("i"))
    groups = store(groups, "sources")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))

    cells = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))
    words = int(sizes.agg(F.max("terms")).first()[0] or 0)
    pairs = pair_sums(cells.select("lang", "i", "term", "p"),
                      groups.select("lang", "i", _share("0", "total", "terms").alias("p0"), "terms"),
                      words, source_block, term_block)
    pairs = pairs.union(pairs.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    pairs = pairs.join(groups.select("lang", "i", "source"), ["lang", "i"]).join(
        groups.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                         F.row_number().over(ordered).alias("rank"))

    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    terms = cells.join(of_lang, ["lang", "term"]).join(whole, "lang").withColumn("q", _share("lang_n", "lang_total", "terms"))
    terms = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
