"""Audit of how the sources of a language diverge (operator 11), by in-mapper stripes.

Terms are maximal runs of ASCII letters and of all characters beyond ASCII, with A-Z lower-cased. A language keeps the
terms in at least ``min_docs`` of its documents (V of them). A (language, source) group or a whole language gives a kept
term with ``count`` occurrences there the share ``1 + floor(10^9 (count + 5) / (N + 5 V))``, N its count over all kept
terms. Reported per group: the summed difference of shares to every other source of the language (part ``pair``), and the
terms it uses more than the language does, by difference, up to ``top`` ranks (part ``term``).

1. **Stripes.** Each task folds whole documents into a hash table term -> {document frequency, count of each source}. A
   table that reaches ``SPILL`` cells is written out and begun again. A language's groups travel as the stripe of the
   empty term, so that groups without terms are known.
2. **Merge.** Stripes are dealt out and sorted by (language, term) and merged one after another. As a task has counted
   before, a term in every document is one stripe a spill, not one row a document. Stripes of too few documents end
   there; the others are written in blocks of ``BLOCK`` terms with the counts by source.
3. **Divergences.** Blocks meet their language's one row (sources, N of each, V), and each task sums the pairs' differences
   of its blocks in tiles of ``TILE`` x ``TILE`` sources (written out when they exceed ``TILES``) and keeps the best terms
   a group. Partial sums are added, ranks are windows over a group's pairs or candidates. The row of a language is as long
   as its sources, the square root of what the ``pair`` part returns for it.

All arithmetic is in whole numbers, exact for N + 5 V below 9 * 10^15. Null text, language and source are empty strings.
Empty texts hold no term. Texts of any length are read whole, in pieces. Ties of value rank by item (UTF-8 bytes). Every
row is a document, repeated ones too. Other columns, ids included, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.base import hot_keys, salted_lookup, stage

SPILL, PIECE, FOLD = 250_000, 1 << 20, 4 << 20
BLOCK, TILE, TILES, KEEP = 256, 256, 64, 100_000
SCALE_STEPS, PRIOR = 3, 5  # shares are in units of 1000^-3
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

STRIPE = "lang string, term binary, held long, sources array<string>, counts array<long>"
BLOCKS = ("lang string, terms array<binary>, sizes array<int>, at array<int>, counts array<long>, "
          "names array<string>, totals array<long>")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each piece of about PIECE bytes."""
    plain = text.translate(_TERMS)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


class Stripes:
    """(language, term) -> {source: count, None: documents}, spilled as Arrow batches."""

    def __init__(self):
        self.table: dict[tuple[str, bytes], dict] = {}
        self.cells = 0
        self.counts: dict[tuple[str, str], Counter] = {}
        self.held: dict[str, Counter] = {}
        self.size = 0

    def document(self, lang: str, source: str, text: bytes) -> None:
        counts = self.counts.setdefault((lang, source), Counter())
        own: set[bytes] = {b""}
        counts[b""] += 1
        for terms in pieces(text):
            counts.update(terms)
            own.update(terms)
        self.held.setdefault(lang, Counter()).update(own)
        self.size += len(text) + 64
        if self.size > FOLD:
            self.fold()

    def fold(self) -> None:
        for lang, held in self.held.items():
            for term, n in held.items():
                stripe = self.table.setdefault((lang, term), {None: 0})
                stripe[None] += n
        for (lang, source), counts in self.counts.items():
            for term, n in counts.items():
                stripe = self.table[lang, term]
                if source in stripe:
                    stripe[source] += n
                else:
                    stripe[source] = n
                    self.cells += 1
        self.counts, self.held, self.size = {}, {}, 0

    def spill(self) -> Iterator[pa.RecordBatch]:
        rows, self.table, self.cells = self.table, {}, 0
        yield from stripe_batches((*key, stripe.pop(None), stripe) for key, stripe in rows.items())


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32),
                                    pa.array(values, kind))


def stripe_batches(rows, at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    langs, terms, held, sizes, sources, counts = ([] for _ in range(6))
    for lang, term, n, stripe in rows:
        langs.append(lang)
        terms.append(term)
        held.append(n)
        sizes.append(len(stripe))
        sources.extend(stripe)
        counts.extend(stripe.values())
        if len(langs) == at_once:
            yield _stripe_batch(langs, terms, held, sizes, sources, counts)
            langs, terms, held, sizes, sources, counts = ([] for _ in range(6))
    if langs:
        yield _stripe_batch(langs, terms, held, sizes, sources, counts)


def _stripe_batch(langs, terms, held, sizes, sources, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(terms, pa.binary()), pa.array(held, pa.int64()),
         _lists(sources, sizes, pa.string()), _lists(counts, sizes, pa.int64())],
        ["lang", "term", "held", "sources", "counts"])


def fold_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            stripes.document(lang, source, text.as_py())
            if stripes.cells > SPILL:
                yield from stripes.spill()
    stripes.fold()
    yield from stripes.spill()


class Blocks:
    """Kept stripes of one language at a time, written as one row a block."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.begin(None)

    def begin(self, lang: str | None) -> None:
        self.lang, self.terms, self.sizes, self.at, self.counts = lang, [], [], [], []
        self.names: dict[str, int] = {}
        self.totals: list[int] = []

    def add(self, lang: str, term: bytes, stripe: dict[str, int]) -> None:
        if lang != self.lang or len(self.terms) == BLOCK:
            self.end()
            self.begin(lang)
        if term:
            self.terms.append(term)
            self.sizes.append(len(stripe))
        for source, n in stripe.items():
            i = self.names.setdefault(source, len(self.names))
            if i == len(self.totals):
                self.totals.append(0)
            if term:
                self.at.append(i)
                self.counts.append(n)
                self.totals[i] += n

    def end(self) -> None:
        if self.names:
            self.rows.append((self.lang, self.terms, self.sizes, self.at, self.counts, list(self.names), self.totals))
        self.begin(None)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()),
                 pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)],
            ["lang", "terms", "sizes", "at", "counts", "names", "totals"])


def merge_stripes(min_docs: int):
    """Of sorted stripes, merged by key: blocks of the terms held by enough documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, stripe, blocks = None, 0, {}, Blocks()

        def close() -> None:
            if key is not None and (held >= min_docs or not key[1]):
                blocks.add(*key, stripe)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lang, term = batch.column(0), batch.column(1)
            same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1]))
            starts = np.concatenate(([0], np.flatnonzero(~np.asarray(same.to_numpy(zero_copy_only=False), bool)) + 1))
            starts = starts.astype(np.int64)
            sums = np.add.reduceat(batch.column(2).to_numpy(), starts)
            stops = np.append(starts[1:], n)
            offsets = batch.column(3).offsets.to_numpy()
            base = offsets[0]
            sources, counts = batch.column(3).flatten(), batch.column(4).flatten().to_numpy()
            for i, (a, b, total) in enumerate(zip(starts.tolist(), stops.tolist(), sums.tolist())):
                # a run inside the batch is whole; the first may go on with what was held back, the last is held back
                if 0 < i < len(starts) - 1 and total < min_docs and len(term[a].as_py()):
                    if key is not None:
                        close()
                        key = None
                    continue
                own = (lang[a].as_py(), term[a].as_py())
                if own != key:
                    close()
                    key, held, stripe = own, 0, {}
                held += total
                lo, hi = offsets[a] - base, offsets[b] - base
                for s, c in zip(sources[lo:hi].to_pylist(), counts[lo:hi].tolist()):
                    stripe[s] = stripe.get(s, 0) + c
            yield blocks.batch()
        close()
        blocks.end()
        yield blocks.batch()

    return run


def shares(counts: np.ndarray, totals) -> np.ndarray:
    """1 + floor(1000^3 (count + 5) / total), in steps that stay inside 64 bits."""
    rest, out = counts + PRIOR, 0
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out, rest = out * 1000 + rest // totals, rest % totals
    return out + 1


RESULT = "lang string, source string, part string, item binary, value long"


def diverge(top: int):
    """Of blocks joined with their language's row: partial pair sums and the best terms a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple, np.ndarray] = {}
        sources: dict[str, list[str]] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}
        kept = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, i0, j0), tile in tiles.items():
                names = sources[lang]
                rows = []
                for i, j in zip(*np.nonzero(np.ones(tile.shape, bool))):
                    a, b, v = names[i0 + i], names[j0 + j], int(tile[i, j])
                    if a != b:
                        rows.append((lang, a, "pair", b.encode("utf-8", "surrogatepass"), v))
                        if i0 != j0:
                            rows.append((lang, b, "pair", a.encode("utf-8", "surrogatepass"), v))
                yield _result(rows)
            for (lang, source), terms in best.items():
                yield _result([(lang, source, "term", t, -v) for v, t in sorted(terms)[:top]])
            tiles.clear()
            sources.clear()
            best.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                lang, terms, sizes, at, counts, names, groups, v = [
                    batch.column(c)[row].as_py() for c in ("lang", "terms", "sizes", "at", "counts", "names", "groups", "v")]
                all_names = sources.setdefault(lang, [g["name"] for g in groups])
                place = {g["name"]: i for i, g in enumerate(groups)}
                totals = np.array([g["n"] for g in groups], np.int64)
                table = np.zeros((len(terms), len(groups)), np.int64)
                column = np.array([place[n] for n in names], np.int64)
                table[np.repeat(np.arange(len(terms)), sizes), column[at] if at else []] = counts
                p = shares(table, totals + PRIOR * v) if v else table
                for i0 in range(0, len(groups), TILE):
                    for j0 in range(i0, len(groups), TILE):
                        left, right = p[:, i0:i0 + TILE], p[:, j0:j0 + TILE]
                        tile = tiles.setdefault((lang, i0, j0), np.zeros((left.shape[1], right.shape[1]), np.int64))
                        for i in range(left.shape[1]):
                            tile[i] += np.abs(right - left[:, i:i + 1]).sum(0)
                        if len(tiles) > TILES:
                            yield from out()
                            sources[lang], kept = all_names, 0
                if len(terms):
                    over = p - shares(table.sum(1), int(totals.sum()) + PRIOR * v)[:, None]
                    for t, s in zip(*np.nonzero((table > 0) & (over > 0))):
                        best.setdefault((lang, all_names[s]), []).append((-int(over[t, s]), terms[t]))
                        kept += 1
                    if kept > KEEP:
                        for key, found in best.items():
                            best[key] = sorted(found)[:top]
                        kept = sum(map(len, best.values()))
                        if kept > KEEP // 2:
                            yield from out()
                            kept = 0
        yield from out()

    return run


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)],
                                      ["lang", "source", "part", "item", "value"])


def term_blocks(docs: DataFrame, min_docs: int, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The kept terms of each language with their counts by source, in blocks (see ``BLOCKS``)."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    stripes = rows.mapInArrow(fold_documents, STRIPE)
    merged = stripes.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return stage(merged.mapInArrow(merge_stripes(min_docs), BLOCKS))


def source_divergences(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text",
                       lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a group, part and item: lang, source, part, item, value, rank."""
    blocks = term_blocks(docs, min_docs, text_col, lang_col, source_col)
    groups = blocks.select("lang", F.explode(F.arrays_zip("names", "totals")).alias("g")).groupBy(
        "lang", F.col("g.names").alias("name")).agg(F.sum("g.totals").alias("n"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias("groups")).join(
        blocks.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("v"), F.count(F.lit(1)).alias("n_blocks")),
        "lang")
    langs = stage(langs)
    hot = hot_keys(langs, ["lang"], blocks.count(), "n_blocks")
    work = salted_lookup(blocks.drop("totals"), langs.drop("n_blocks"), ["lang"], F.col("terms"), hot=hot)
    parts = work.mapInArrow(diverge(top), RESULT)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
