"""Spelling variants: words one edit apart, found by an index of variable-length grams.

1. ``corpus_words`` counts the letter runs of whole texts in Spark: (word, n).
2. A gram dictionary: all grams of SHORT characters, and longer ones, up to LONG, whose beginning occurs in more than a
   share of the words. At most DICTIONARY grams, the most frequent, are kept and sent to the tasks with their counts;
   grams outside count as rare.
3. A word, with a sign before and behind it, is decomposed: at every place the longest gram of the dictionary, without
   grams that lie inside an earlier one. ``affected`` bounds from above how many of these grams one edit can change, wherever
   it falls. So words one edit apart keep at least (grams - affected) grams, in one order, whichever word one starts from.
4. Lists are merged by grams in the order of their counts: with k kept grams, the first k that two words keep stand among
   the first (affected + k) of either word. A word with a bound of k or more enters one list for each k of these, k at most
   MERGED; one with a smaller bound also enters the lists of fewer grams, for others like it. No two words one edit apart
   miss each other. Words whose bound is zero also meet through plain grams of SHORT characters, whose bound is positive.
5. Inside a list, words of equal or neighbouring lengths are verified on their characters.

Lists hold distinct words, however often the corpus repeats them, and they share their three rarest grams; no pair leaves
a list unless it is verified. Every word is its own row, so null words take no part and rows repeating a word are added up.
Without words nothing is returned. A word's form is its near word of largest n (ties: smallest in code-point order), if that n
is at least ``ratio`` times its own; chains of forms end after few steps, as n grows tenfold in each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import dealt, keep

SHORT, LONG = 2, 3
FREQUENT = 0.001
"""Share of the words above which a gram's continuations enter the dictionary."""
DICTIONARY = 1 << 16
MERGED = 3
RATIO = 10
LEAST_LENGTH, LEAST_COUNT = 7, 2
TYPO_EVERY = 31
HELD_ROWS = 1 << 17
PAIRS = 1 << 17
PADDED = 64
"""Longer words are compared one by one, others as rows of a matrix."""
BEFORE, BEHIND = "\x02", "\x03"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def corpus_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    typo_every: int | None = TYPO_EVERY,
) -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least ``least_length``, A-Z lower-cased, that occur ``least_count`` times.

    With ``typo_every`` set, a run whose crc32 of ``<id>:<run>`` it divides loses one character; runs of rows without id stay as they are.
    """
    runs = docs.select(
        F.col(id_col).cast("string").alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    word = F.col("run")
    if typo_every:
        hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        place = (hashed % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
        word = F.when(hashed % typo_every == 0, shorter).otherwise(word)
    return (
        runs.select(word.alias("word")).where(F.length("word") >= least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    )


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter[str] = Counter()
        for word in batch.column(0).to_pylist():
            s = BEFORE + word + BEHIND
            for size in range(SHORT, LONG + 1):
                found.update(s[i : i + size] for i in range(len(s) - size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])


class Grams:
    """The dictionary: grams with their counts, and the beginnings and ends by which an edit can lengthen or hide a gram."""

    def __init__(self, counts: dict[str, int], words: int, frequent: float = FREQUENT, longest: int = LONG):
        self.counts, self.longest = counts, longest
        long_ones: set[str] = set()
        for size in range(SHORT + 1, longest + 1):
            long_ones |= {
                g for g in counts
                if len(g) == size and counts.get(g[:-1], 0) > frequent * words and (size == SHORT + 1 or g[:-1] in long_ones)
            }
        self.long = long_ones
        self.beginnings = {g[:i] for g in long_ones for i in range(SHORT, len(g))}
        self.ends = {g[i:] for g in long_ones for i in range(1, len(g) - SHORT + 1)}

    def decompose(self, s: str) -> list[tuple[int, int]]:
        """Ranges of the grams of a padded word, in order."""
        out, reach, long_ones, n = [], 0, self.long, len(s)
        for p in range(n - SHORT + 1):
            end = p + SHORT
            for size in range(min(self.longest, n - p), SHORT, -1):
                if s[p : p + size] in long_ones:
                    end = p + size
                    break
            if end > reach:
                out.append((p, end))
                reach = end
        return out

    def affected(self, s: str, grams: list[tuple[int, int]]) -> int:
        """No single edit of the word changes more than this many of its grams."""
        most, n = 0, len(s)
        for i in range(1, n):  # x = s[:i] stays; behind it stays s[i:] (insertion) or s[i + 1:]
            low = i - SHORT + 1
            for p in range(max(0, i - self.longest + 1), low):
                if s[p:i] in self.beginnings:  # a longer gram may start here now, and hide those behind
                    low = p
                    break
            for y in (i, i + 1):
                if y < n:
                    high = y + SHORT - 1
                    for k in range(min(self.longest - 1, n - y), SHORT - 1, -1):
                        if s[y : y + k] in self.ends:  # a gram that ends here may now start before y
                            high = y + k
                            break
                    count = 0
                    for a, b in grams:
                        if (low <= a < y) or (a >= y and b <= high):
                            count += 1
                    if count > most:
                        most = count
        return most


def list_keys(word: str, grams: Grams, merged: int = MERGED) -> tuple[list[int], int]:
    """Keys of the lists a word enters, and how many grams it keeps at least."""
    s = BEFORE + word + BEHIND
    ranges = grams.decompose(s)
    changed = grams.affected(s, ranges)
    kept = len(ranges) - changed
    counts = grams.counts
    ordered = [g for _, g, _ in sorted((counts.get(s[a:b], 0), s[a:b], a) for a, b in ranges)]
    keys = set()
    for size in range(min(max(kept, 1), merged), merged + 1):
        for chosen in combinations(ordered[: changed + size], size):
            keys.add(xxhash.xxh3_64_intdigest("\0".join(chosen), seed=size))
    return list(keys), kept


def enter_lists(grams, plain):
    """(key, word, n) for each list of a word; ``plain`` is the dictionary without long grams, for words with a bound of zero."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            keys: list[int] = []
            lengths = np.zeros(len(words), np.int64)
            for i, word in enumerate(words.to_pylist()):
                found, kept = list_keys(word, grams.value)
                if kept <= 0:
                    found += [k ^ 1 << 63 for k in list_keys(word, plain.value)[0]]
                lengths[i] = len(found)
                keys += found
            rows = pa.array(np.repeat(np.arange(len(words)), lengths))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), words.take(rows), batch.column(1).take(rows)], names=["key", "word", "n"]
            )

    return enter


def one_edit(a: str, b: str) -> bool:
    """Whether two different words differ by one inserted, deleted or replaced character."""
    least = min(len(a), len(b))
    if max(len(a), len(b)) - least > 1:
        return False
    front = next((i for i in range(least) if a[i] != b[i]), least)
    back = next((i for i in range(least) if a[-1 - i] != b[-1 - i]), least)
    return front + back >= max(len(a), len(b)) - 1


def _matrices(words: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the words, aligned left and right, of those of at most PADDED characters."""
    width = int(length[length <= PADDED].max(initial=1))
    left, right = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(length) - length
    for size in np.unique(length[length <= PADDED]).tolist():
        rows = np.flatnonzero(length == size)
        block = flat[start[rows][:, None] + np.arange(size)[None, :]]
        left[rows, :size] = block
        right[rows, width - size :] = block
    return left, right


def near_in_lists(keys: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of places (i, j) in whole lists; each pair of words once."""
    coded = words.dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    length = np.array([len(w) for w in distinct], np.int64)
    left, right = _matrices(distinct, length)
    width = left.shape[1]
    size = length[code]
    _, group = np.unique(keys, return_inverse=True)
    order = np.lexsort((size, group))
    place = group[order].astype(np.int64) << 32 | size[order]
    upto = np.searchsorted(place, place + 1, "right")  # same list, at most one longer
    count = upto - np.arange(len(order)) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
        rows = np.arange(i, j)
        a = np.repeat(rows, count[i:j])
        b = np.arange(len(a)) - np.repeat(total[i:j] - total[i], count[i:j]) + a + 1
        a, b = code[order[a]], code[order[b]]
        other = a != b
        a, b = a[other], b[other]
        short = np.maximum(length[a], length[b]) <= PADDED
        p, q = a[short], b[short]
        least = np.minimum(length[p], length[q])
        differs = left[p] != left[q]
        front = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        differs = (right[p] != right[q])[:, ::-1]
        back = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        near = np.minimum(front, least) + np.minimum(back, least) >= np.maximum(length[p], length[q]) - 1
        pairs = np.stack([p[near], q[near]], axis=1)
        more = [(x, y) for x, y in zip(a[~short].tolist(), b[~short].tolist()) if one_edit(distinct[x], distinct[y])]
        both = np.concatenate([pairs, np.array(more, np.int64).reshape(-1, 2)])
        found.append(np.unique(np.sort(both, axis=1), axis=0))
        i = j
    pairs = np.unique(np.concatenate(found), axis=0)
    first = np.zeros(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first[pairs[:, 0]], first[pairs[:, 1]]


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, word, n) sorted by key to (word, near, near_n), both ways."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        words, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
        i, j = near_in_lists(rows.column("key").to_numpy(), words)
        one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        return pa.RecordBatch.from_arrays([words.take(one), words.take(two), n.take(two)], names=["word", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < HELD_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield work(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
    if held:
        yield work(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words one edit apart, both ways. words: (word, n), each word once."""
    spark = words.sparkSession
    counts = (
        words.select("word").mapInArrow(count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "gram").limit(DICTIONARY)
    )
    known = {r.gram: r.n for r in counts.toLocalIterator()}
    total = words.count()
    grams, plain = Grams(known, total), Grams(known, total, longest=SHORT)
    enter = enter_lists(spark.sparkContext.broadcast(grams), spark.sparkContext.broadcast(plain))
    lists = dealt(words.select("word", "n"), "word").mapInArrow(enter, "key long, word string, n long")
    found = dealt(lists, "key").sortWithinPartitions("key").mapInArrow(verify, "word string, near string, near_n long")
    return dealt(found, "word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form that can be reached; paths double in each round."""
    now = keep(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = keep(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per distinct word of (word, n); see the module text."""
    plain = words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    plain = keep(plain, "words")
    near = near_words(plain).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    met = plain.join(near, "word", "left")
    frequent = -F.col("best.less") >= ratio * F.col("n")
    judged = keep(
        met.select("word", F.when(frequent, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, -F.col("best.less")).alias("form_n")),
        "forms",
    )
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
