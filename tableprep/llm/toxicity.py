"""Toxicity by class-conditional Kneser-Ney models of words (operator 5).

Each class (toxic, ordinary) has an interpolated Kneser-Ney model that spells words letter by letter: the letter after a
word's beginning h is drawn with

    p_c(w | h) = max(n_c(hw) - D, 0) / n_c(h) + D * t_c(h) / n_c(h) * p(w | last two letters of h)

where n_c are the class's counts, t_c(h) the number of different letters seen after h, and the backoff p is shared: a
continuation model pooled over both classes (in how many different beginnings a letter follows two others). A rare
expression gets the same backoff probability in both classes, so it does not decide. Beginnings go up to ``DEPTH``
letters, so inflected and compound forms share the counts of their stem; a later letter follows the ``CONTEXT`` letters
before it, counted anywhere in words, and the end of a word is a letter too. Every letter of a word so has a likelihood.

A text's features are length-normalised log-likelihood ratios: the mean a word, the mean of its three highest words, the
mean and the root-normalised sum of what words have above ``EXCESS``, and the logarithm of its words. A logistic model
on a fold of its own turns them into a score. All counts are Spark aggregates over all training rows, and all ratios stay
a Spark table: the distinct words of the texts are joined with it, letter by letter. Of the rated words the most frequent
(``HEAD`` at most, with their whole hashes) reach the tasks as a broadcast, the rest are joined with the documents that
hold them, and so it is with the ratios of letters and the words; which way one goes does not change a ratio. Ratios are added as whole numbers (``UNIT``), in any order.

Null and empty texts have zero features and get the score of such a text. Repeated labels of one document count once
(toxic if one says so); labels other than 0 and 1 are ignored; if one class is missing, all scores are the smoothed share
of the other. Null ids are scored but teach nothing. Only ids, texts and the labels' toxic column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import BitMap, _powers, mix, odd_constants, salted_lookup, signed, stage
from tableprep.llm.chars import letter_stream
from tableprep.llm.langid import fold
from tableprep.llm.token_blocks import _small_batches

DEPTH, CONTEXT, DISCOUNT, EXCESS, ALPHABET = 9, 4, 0.8, 1.5, 50
HEAD, UNIT = 1 << 20, 1 << 24  # rows of 16 bytes; units of one in a fixed-point ratio
BATCH_LETTERS, BATCH_ROWS = 4_000_000, 1_000_000  # a letter that teaches has up to three rows
BROADCAST_LABELS = 2_000_000  # rows of 12 bytes
_INNER = odd_constants(1, "inner")[0]
_UNSEEN = odd_constants(1, "unseen")[0]  # tells the key of an unseen letter after h from the key of h
FEATURES = ["mean_ratio", "top_ratio", "mean_excess", "root_excess", "log_words"]


def _nodes(stream: np.ndarray) -> tuple[np.ndarray, ...]:
    """Letters with the running sums of beginnings: word number, depth, and a function from (start, end) to hashes."""
    c = stream.astype(np.uint64)
    n = len(c)
    up, down = _powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c + np.uint64(7)) * up)))
    space = c == 32
    word = np.cumsum(space) - 1
    first = np.flatnonzero(space)
    depth = np.arange(n) - first[word]

    def name(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * down[start] + (end - 1 - start).astype(np.uint64))

    return c, word, depth, name


def beginnings(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each letter up to DEPTH of each word: hash of the word up to it, hash before it (0: none), the letter with
    the two before it, and the word's number."""
    c, word, depth, name = _nodes(stream)
    at = np.flatnonzero((depth >= 1) & (depth <= DEPTH))
    deep = depth[at] > 1
    start = at - depth[at]
    low = c[at] | (c[at - 1] << np.uint64(21)) | (np.where(deep, c[at - 2], 0).astype(np.uint64) << np.uint64(42))
    return name(start, at + 1), np.where(deep, name(start, at), np.uint64(0)), low, word[at]


def word_ends(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for the end (a space) of each word of less than DEPTH letters: it follows the whole word."""
    c, word, depth, name = _nodes(stream)
    at = np.flatnonzero((c[1:] == 32) & (depth[:-1] >= 1) & (depth[:-1] < DEPTH)) + 1
    start = at - 1 - depth[at - 1]
    low = c[at] | (c[at - 1] << np.uint64(21)) | (c[at - 2] << np.uint64(42))
    return name(start, at + 1), name(start, at), low, word[at - 1]


def inner_letters(stream: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for each letter and end of a word with more than ``after`` places: it follows the CONTEXT letters before
    it, wherever in a word they are."""
    c, word, depth, name = _nodes(stream)
    at = np.flatnonzero(depth[:-1] >= after) + 1
    start = at - CONTEXT
    low = c[at] | (c[at - 1] << np.uint64(21)) | (c[at - 2] << np.uint64(42))
    return mix(name(start, at + 1) ^ _INNER), mix(name(start, at) ^ _INNER), low, word[at - 1]


def all_letters(stream: np.ndarray, after: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All that a word's likelihood is made of; what is learned has the inner letters ``after`` CONTEXT."""
    parts = beginnings(stream), word_ends(stream), inner_letters(stream, after)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, parent, low, toxic count, ordinary count), added up over some million letters at a time."""
    held, rows = ([], []), 0

    def flush() -> pa.RecordBatch:
        toxic = np.repeat([1, 0], [sum(len(p[0]) for p in side) for side in held])
        names, first, inverse = np.unique(np.concatenate([p[0] for side in held for p in side]), return_index=True,
                                          return_inverse=True)
        t = np.bincount(inverse, toxic).astype(np.int64)
        both = np.bincount(inverse)
        parent, low = (np.concatenate([p[k] for side in held for p in side])[first].view(np.int64) for k in (1, 2))
        return pa.RecordBatch.from_pydict({"h": names.view(np.int64), "parent": parent, "low": low, "t": t, "o": both - t})

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            stream = letter_stream(text)
            if len(stream):
                held[0 if toxic else 1].append(all_letters(stream, CONTEXT)[:3])
                rows += len(held[0 if toxic else 1][-1][0])
            if rows > BATCH_ROWS:
                yield flush()
                held, rows = ([], []), 0
    if rows:
        yield flush()


def learn_ratios(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, ratio, n) of all seen beginnings and (h, ratio, n) for an unseen letter after h, from (text, toxic)."""
    d = F.lit(DISCOUNT)
    counts = stage(labelled.mapInArrow(_count, "h long, parent long, low long, t long, o long")
                   .groupBy("h", "parent", "low").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    parents = stage(counts.groupBy("parent").agg(
        F.sum("t").alias("nt"), F.sum("o").alias("no"), F.sum((F.col("t") > 0).cast("long")).alias("kt"),
        F.sum((F.col("o") > 0).cast("long")).alias("ko")))
    follow = counts.groupBy("low").agg(F.count(F.lit(1)).alias("cont")).withColumn(
        "two", F.shiftrightunsigned("low", 21))
    sums = follow.groupBy("two").agg(F.sum("cont").alias("all"), F.count(F.lit(1)).alias("kinds"))
    shared = follow.join(sums, "two").select("low", (
        F.greatest(F.col("cont") - d, F.lit(0.0)) / F.col("all") + d * F.col("kinds") / F.col("all") / ALPHABET).alias("p"))

    def chance(n: str, total: str, kinds: str):
        seen = F.greatest(F.col(n) - d, F.lit(0.0)) / F.col(total) + d * F.col(kinds) / F.col(total) * F.col("p")
        return F.when(F.col(total) > 0, seen).otherwise(F.col("p"))

    def left_over(total: str, kinds: str):
        return F.when(F.col(total) > 0, d * F.col(kinds) / F.col(total)).otherwise(F.lit(1.0))

    seen = counts.join(parents, "parent").join(stage(shared), "low").select(
        "h", F.log(chance("t", "nt", "kt") / chance("o", "no", "ko")).alias("ratio"), (F.col("t") + F.col("o")).alias("n"))
    unseen = parents.select(F.col("parent").alias("h"), F.log(left_over("nt", "kt") / left_over("no", "ko")).alias("ratio"),
                            (F.col("nt") + F.col("no")).alias("n"))
    return seen, unseen


def words_of(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first letter and end of each word."""
    c = stream.astype(np.uint64)
    up, down = _powers(len(c))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c + np.uint64(7)) * up)))
    space = np.flatnonzero(c == 32)
    some = np.diff(space) > 1
    start, end = space[:-1][some] + 1, space[1:][some]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w, n, letters) of distinct words, added up over some million letters at a time."""
    held, letters = [], 0

    def flush() -> pa.RecordBatch:
        parts = [words_of(s) for s in held]
        shift = np.repeat(np.cumsum([0] + [len(s) for s in held[:-1]]), [len(p[0]) for p in parts])
        flat = np.concatenate(held)
        names, first, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
        start = (np.concatenate([p[1] for p in parts]) + shift)[first]
        end = (np.concatenate([p[2] for p in parts]) + shift)[first]
        spelt = [flat[a:b].tobytes().decode("utf-32-le") for a, b in zip(start.tolist(), end.tolist())]
        return pa.RecordBatch.from_pydict({"w": signed(names), "n": n.astype(np.int64), "letters": pa.array(spelt, pa.string())})

    for batch in batches:
        for text in batch.column(0).to_pylist():
            stream = letter_stream(text)
            if len(stream):
                held.append(stream)
                letters += len(stream)
            if letters > BATCH_LETTERS:
                yield flush()
                held, letters = [], 0
    if letters:
        yield flush()


def head_count(rated: DataFrame) -> int:
    """The least number of occurrences from which at most ``HEAD`` words are left (powers of the eighth root of two)."""
    bins = rated.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("bin")).count().collect()
    total, least = 0, 1 << 62
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["count"]
        if total > HEAD:
            break
        least = int(np.ceil(2 ** (r["bin"] / 8) - 1e-9))
    return least


def broadcast_head(table: DataFrame, key: str, least: int):
    """Sorted keys and ratios of the rows that come ``least`` times or more, for use in tasks."""
    got = table.where(F.col("n") >= least).select(key, "ratio").toArrow()
    names, ratio = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(names)
    return table.sparkSession.sparkContext.broadcast((names[order], ratio[order]))


def _find(head: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the head, and its ratio (0: not there)."""
    names, ratio = head
    distinct, back = np.unique(keys, return_inverse=True)
    at = np.searchsorted(names, distinct)
    hit, value = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64)
    inside = np.flatnonzero(at < len(names))
    hit[inside] = names[at[inside]] == distinct[inside]
    value[hit] = ratio[at[hit]]
    return hit[back], value[back]


def rate_words(texts: DataFrame, seen: DataFrame, unseen: DataFrame) -> DataFrame:
    """(w, n, ratio) of all distinct words of a text column: the occurrences and the log-likelihood ratio in ``UNIT``s."""
    other = F.lit(int(_UNSEEN.astype(np.int64)))
    table = stage(seen.select(F.col("h").alias("key"), "ratio", "n").unionByName(
        unseen.select(F.col("h").bitwiseXOR(other).alias("key"), "ratio", "n")).select(
        "key", F.round(F.col("ratio") * UNIT).cast("long").alias("ratio"), "n"))
    bit_map = BitMap(table, "key", table.count())
    head = broadcast_head(table, "key", head_count(table))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word's sum over letters in the head, and keys to join: what a letter may find, and its fallback if the
        map let a strange one through."""
        may_hold = bit_map.holds()
        for batch in batches:
            for i, j in _small_batches(batch.column(2)):
                spelt = " ".join(["", *batch.column(2).slice(i, j - i).to_pylist(), ""])
                h, parent, _, word = all_letters(np.frombuffer(spelt.encode("utf-32-le"), np.uint32))
                after = parent ^ _UNSEEN
                hit, value = _find(head.value, h)
                key, left = h.copy(), np.zeros(len(h), bool)
                rest = np.flatnonzero(~hit)
                left[rest] = may_hold(h[rest])
                strange = rest[~left[rest]]
                known, value[strange] = _find(head.value, after[strange])
                key[strange] = after[strange]
                strange = strange[~known]
                left[strange] = may_hold(after[strange])
                left = np.flatnonzero(left)
                left = left[np.argsort(word[left], kind="stable")]
                bounds = np.searchsorted(word[left], np.arange(j - i + 1)).astype(np.int32)
                ratio = np.bincount(word, value, j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(ratio),
                     *[pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(x[left]))) for x in (key, after)]],
                    ["w", "n", "ratio", "keys", "fallbacks"])

    vocabulary = texts.mapInArrow(_vocabulary, "w long, n long, letters string").groupBy("w").agg(
        F.sum("n").alias("n"), F.first("letters").alias("letters"))
    spelt = stage(vocabulary.mapInArrow(spell, "w long, n long, ratio long, keys array<long>, fallbacks array<long>"))
    letters = spelt.select("w", F.explode(F.arrays_zip("keys", "fallbacks")).alias("z")).select(
        "w", F.col("z.keys").alias("key"), F.col("z.fallbacks").alias("fallback"))
    first = salted_lookup(letters, table.select("key", "ratio"), ["key"], F.col("w"), "left")
    again = F.when(F.col("ratio").isNull() & (F.col("key") != F.col("fallback")), F.col("fallback"))
    sums = stage(first.groupBy("w").agg(F.sum("ratio").alias("more"), F.collect_list(again).alias("again")))
    missed = stage(sums.select("w", F.explode("again").alias("key")))
    last = salted_lookup(missed, table.select("key", "ratio"), ["key"], F.col("w")).groupBy("w").agg(
        F.sum("ratio").alias("last"))
    zero = F.lit(0).cast("long")
    return spelt.select("w", "n", "ratio").join(sums.select("w", "more"), "w", "left").join(last, "w", "left").select(
        "w", "n", (F.col("ratio") + F.coalesce("more", zero) + F.coalesce("last", zero)).alias("ratio"))


def _features(n: int, total: int, excess: int, top: np.ndarray) -> tuple[float, ...]:
    if not n:
        return (0.0,) * len(FEATURES)
    excess /= UNIT
    return total / UNIT / n, float(top.sum()) / UNIT / 3, 10 * excess / n, excess / float(np.sqrt(n)), float(np.log(n))


def _sums(ratio: np.ndarray, n: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Sum, sum above EXCESS, and the three highest of words with these ratios that come n times each."""
    high = np.argsort(ratio, kind="stable")[-3:]
    return (int((ratio * n).sum()), int((np.maximum(ratio - int(EXCESS * UNIT), 0) * n).sum()),
            np.repeat(ratio[high], np.minimum(n[high], 3))[-3:])


def measure(rows: DataFrame, rated: DataFrame) -> DataFrame:
    """(doc_id, fold, features) of (doc_id, text, fold) with the words' ratios."""
    least = head_count(rated)
    head = broadcast_head(rated, "w", least)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                stream = letter_stream(text)
                w, n = np.unique(words_of(stream)[0], return_counts=True) if len(stream) else (
                    np.empty(0, np.uint64), np.empty(0, np.int64))
                hit, value = _find(head.value, w)
                total, excess, top = _sums(value[hit], n[hit])
                out.append((int(n.sum()), total, excess, top.tolist(), signed(w[~hit]).tolist(), n[~hit].tolist()))
            columns = list(zip(*out)) if out else [[]] * 6
            lists = pa.list_(pa.int64())
            types = [pa.int64()] * 3 + [lists] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(x, t) for x, t in zip(columns, types)]],
                ["doc_id", "fold", "words", "total", "excess", "top", "rare", "times"])

    summed = stage(rows.select("doc_id", "text", "fold").mapInArrow(
        add_up, "doc_id long, fold long, words long, total long, excess long, top array<long>, rare array<long>, "
                "times array<long>").withColumn("row", F.monotonically_increasing_id()))
    rare = stage(summed.select("row", F.explode(F.arrays_zip("rare", "times")).alias("z")).select(
        "row", F.col("z.rare").alias("w"), F.col("z.times").alias("times")))
    tail = rated.where(F.col("n") < least).select("w", "ratio")
    found = salted_lookup(rare, tail, ["w"], F.col("row")).groupBy("row").agg(
        F.collect_list(F.struct("ratio", "times")).alias("found"))  # no more than the document's own words

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["words", "total", "excess", "top", "found"]).to_pylist():
                total, excess, top = r["total"], r["excess"], np.array(r["top"], np.int64)
                if r["found"]:
                    pairs = np.array([(x["ratio"], x["times"]) for x in r["found"]], np.int64)
                    a, b, c = _sums(pairs[:, 0], pairs[:, 1])
                    total, excess, top = total + a, excess + b, np.sort(np.concatenate((top, c)))[-3:]
                out.append(_features(r["words"], total, excess, top))
            got = np.array(out).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), *[pa.array(x) for x in got.T]],
                                             ["doc_id", "fold", *FEATURES])

    return stage(summed.drop("rare", "times").join(found, "row", "left").mapInArrow(
        finish, "doc_id long, fold long, " + ", ".join(f"{f} double" for f in FEATURES)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Fold 0 is held out, fold 4 calibrates, the rest teach."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       fold(id_col).alias("fold"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    marks = marks.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = stage(marks.where(fold("doc_id") != 0))
    small = taught.count() <= BROADCAST_LABELS
    side = F.broadcast(taught) if small else taught
    labelled = rows.where("fold in (1, 2, 3) and text is not null").join(side, "doc_id").select("text", "toxic")
    rated = stage(rate_words(rows.select("text"), *learn_ratios(labelled)))
    measured = measure(rows, rated)
    weights, base = _calibrate(measured.where("fold = 4").join(side, "doc_id"))
    linear = F.lit(base)
    for f, w in zip(FEATURES, weights):
        linear = linear + F.col(f) * F.lit(w)
    value = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(linear, F.lit(500.0)), F.lit(-500.0))))
    return measured.select("doc_id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"),
                           value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _calibrate(rows: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept of a logistic model on the features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    ones, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if ones == 0 or ones == n:
        return [0.0] * len(FEATURES), float(np.log((ones + 0.5) / (n - ones + 0.5)))
    data = rows.select(array_to_vector(F.array(*FEATURES)).alias("features"), F.col("toxic").cast("double").alias("label"))
    fit = LogisticRegression(regParam=1e-4, maxIter=100).fit(data.persist())
    data.unpersist()
    return [float(w) for w in fit.coefficients], float(fit.intercept)
