"""Repeated windows of words, by super-k-mers.

A window is 20 consecutive words of one document. Each word that a window covers goes when the same word sequence starts earlier
too: in a document with a smaller id, or earlier in the same document. Windows are judged on the input.

1. A window's minimiser is the smallest hash of its 6-word runs. Equal windows have equal minimisers. A first pass counts
   minimisers; those that occur once cannot repeat, and a bitmap of fixed size names the others.
2. Consecutive windows that share a minimiser travel as one packed string (their words, joined by a space) to the
   minimiser's bucket. Equal strings are one row with their first place; of every later copy all windows are repeats.
3. A bucket's windows are sorted by content and place: all but the first of equal windows are repeats. Neighbours with equal
   window hashes are compared by the 64-bit hashes of their words.
4. A bucket is sorted in groups of about GROUP strings, each where it falls. Where a bucket has several groups, the windows
   that stay as a group's first go on, if a count says that they occur more than once in the bucket: packed again, consecutive
   windows together, into the finer buckets of a minimiser of longer runs. This repeats until each bucket is one group. What
   goes on grows with groups and distinct repeated windows, not with copies; a whole window is the last minimiser, whose
   buckets shrink by GROUP in every round.
5. The repeats meet the texts again by document id.

Rows without ``doc_id`` take no part: nothing of them is removed. Nulls have no words. Repeated rows of one id and text stand at
the same place, so neither is earlier than the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import bitmap_of, in_bitmap, keep
from tallybook.llm.words import SEPARATOR, Words, groups, utf8, window_hashes, words_of

WINDOW = 20
MINIMISER = 6
LONGER = (12, WINDOW)
"""Runs of the minimisers that divide buckets of several groups, the last one again and again."""
GROUP = 1024
HELD_BYTES = 2 << 20
"""Whole groups are sorted together up to about this size."""


def packed(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of each text joined by single spaces, one text after the other, and where each word starts and ends."""
    inside = ~SEPARATOR[words.data]
    inside[np.minimum(words.end, len(inside) - 1)] = True  # one place for the space after each word
    at = np.cumsum(inside) - inside
    start = at[words.start]
    end = start + (words.end - words.start)
    out = words.data[inside]
    return np.where(SEPARATOR[out], np.uint8(0x20), out).tobytes(), start, end


def minimisers(words: Words, size: int, part: int) -> np.ndarray:
    """Smallest hash of the ``part``-word runs in the window that starts at each word."""
    low, have = window_hashes(words.hashes, part), 1
    while have < size - part + 1:
        step = min(have, size - part + 1 - have)
        low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
        have += step
    return low


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of each window, in order."""
    count = np.maximum(np.diff(words.bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    return text, words.bounds[:-1][text] + np.arange(count.sum()) - (np.cumsum(count) - count)[text]


def runs_of(words: Words, size: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one text that share a minimiser: first window, number of windows, minimiser."""
    text, place = windows_of(words, size)
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return runs_among(text, place, minimisers(words, size, part)[place])


def runs_among(text: np.ndarray, place: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same among some windows, in order: a run ends where a window is missing, too."""
    new = np.ones(len(place), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    return place[begin], np.diff(np.append(begin, len(place))), values[begin]


def repeats_inside(words: Words, size: int, part: int, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a run of windows may hold equal ones, as in periodic text: its minimiser then occurs in it more than once."""
    short = window_hashes(words.hashes, part)
    again = np.zeros(len(short), np.int64)
    for p in range(1, size - part + 1):
        again[:-p] |= short[:-p] == short[p:]
    upto = np.concatenate([[0], np.cumsum(again)])
    return (upto[first + n - 1] > upto[first]) | (n > size - part + 1)


def count_minimisers(size: int, part: int):
    """(minimiser, n) of the runs of windows; a run that may repeat itself counts twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            found, twice = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for i, j in groups(offsets):
                words = words_of(data, offsets[i : j + 1])
                first, n, values = runs_of(words, size, part)
                found.append(values)
                if len(first):
                    twice.append(values[repeats_inside(words, size, part, first, n)])
            values, n = np.unique(np.concatenate(found + twice), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["minimiser", "n"])

    return count


STRINGS = "doc_id long, start int, n int, bucket long, digest binary, packed binary"


def super_kmers(size: int, part: int, bitmap):
    """Packed strings of the runs whose minimiser may occur more than once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for i, j in groups(offsets):
                words = words_of(data, offsets[i : j + 1])
                first, n, values = runs_of(words, size, part)
                again = in_bitmap(bitmap.value, values)
                first, n, values = first[again], n[again], values[again]
                if not len(first):
                    continue
                joined, start, end = packed(words)
                text = np.searchsorted(words.bounds, first, "right") - 1
                strings = [joined[a:b] for a, b in zip(start[first].tolist(), end[first + n + size - 2].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i:j][text]),
                        pa.array((first - words.bounds[text]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(values.view(np.int64)),
                        pa.array([xxhash.xxh3_128_digest(s) for s in strings], pa.binary()),
                        pa.array(strings, pa.binary()),
                    ],
                    names=["doc_id", "start", "n", "bucket", "digest", "packed"],
                )

    return cut


def _text(column: pa.Array) -> pa.Array:
    return column.cast(pa.string())


SORTED = "digest binary, offset int, doc_id long, start int, bucket long, packed binary"


def sort_groups(size: int, part: int, bitmap):
    """Rows sorted by group to (digest, offset) of its repeats and, in buckets of several groups, packed rows that go on.

    Equal windows are in one bucket. ``bitmap`` holds the windows that occur more than once in buckets of several groups;
    windows of other groups that happen to be at hand are compared as well.
    """

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(_text(rows.column("packed").combine_chunks()))
        words = words_of(data, offsets)
        string, place = windows_of(words, size)
        within = place - words.bounds[:-1][string]
        hashes = window_hashes(words.hashes, size)[place]
        doc = rows.column("doc_id").to_numpy()[string]
        start = rows.column("start").to_numpy()[string] + within
        order = np.lexsort((start, doc, hashes))
        same = np.zeros(len(order), bool)
        same[1:] = hashes[order[1:]] == hashes[order[:-1]]
        later = np.flatnonzero(same)
        equal = np.ones(len(later), bool)
        a, b = place[order[later]], place[order[later - 1]]
        for k in range(size):
            equal &= words.hashes[a + k] == words.hashes[b + k]
        found = np.sort(order[later[equal]])
        digests, base = rows.column("digest").combine_chunks(), rows.column("offset").to_numpy()
        yield batch(digests, string[found], base[string[found]] + within[found])
        stays = rows.column("groups").to_numpy()[string] > 1
        stays[found] = False
        if bitmap is not None and stays.any():
            stays[stays] = in_bitmap(bitmap.value, hashes[stays])
        keep_on = np.flatnonzero(stays)
        if not len(keep_on):
            return
        first, n, values = runs_among(string[keep_on], place[keep_on], minimisers(words, size, part)[place[keep_on]])
        joined, left, right = packed(words)
        strings = [joined[p:q] for p, q in zip(left[first].tolist(), right[first + n + size - 2].tolist())]
        at = np.searchsorted(words.bounds, first, "right") - 1
        within_first = first - words.bounds[:-1][at]
        yield batch(
            digests, at, base[at] + within_first, rows.column("doc_id").to_numpy()[at], rows.column("start").to_numpy()[at] + within_first,
            values.view(np.int64), strings,
        )

    def batch(digests, rows, offset, doc=None, start=None, bucket=None, strings=None) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(rows), kind)
        columns = [
            digests.take(pa.array(rows)), pa.array(offset.astype(np.int32)), none(pa.int64()) if doc is None else pa.array(doc),
            none(pa.int32()) if start is None else pa.array(start.astype(np.int32)), none(pa.int64()) if bucket is None else pa.array(bucket),
            pa.array(strings or [None] * len(rows), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["digest", "offset", "doc_id", "start", "bucket", "packed"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the groups that are not complete yet
        size_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size_held += batch.nbytes
            if size_held < HELD_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            group = rows.column("group").to_numpy()
            other = np.flatnonzero((group[1:] != group[:-1]) | (np.diff(rows.column("bucket").to_numpy()) != 0))
            if len(other):
                yield from work(rows.slice(0, int(other[-1]) + 1))
                held = rows.slice(int(other[-1]) + 1).to_batches()
            size_held = sum(x.nbytes for x in held)
        if held:
            yield from work(pa.Table.from_batches(held))

    return scan


def repeats_in_buckets(strings: DataFrame, size: int, longer: tuple[int, ...] = LONGER, group: int | None = None) -> DataFrame:
    """(digest, offset): windows that are not the first of their content. strings: (bucket, digest, offset, doc_id, start, packed)."""
    context, group = strings.sparkSession.sparkContext, group or GROUP  # of two strings or more, so that rounds end
    found = None
    while True:
        sizes = strings.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
        large = keep(sizes.select("bucket", F.ceil(F.col("n") / group).cast("int").alias("groups")), "large")
        divided = not large.isEmpty()
        bitmap = None
        if divided:
            windows = strings.join(large, "bucket", "left_semi").select(F.col("packed").cast("string")).mapInArrow(count_minimisers(size, size), "minimiser long, n long")
            again = windows.groupBy("minimiser").agg(F.sum("n").alias("n")).where("n > 1").select("minimiser")
            bitmap = context.broadcast(bitmap_of(keep(again, "windows"), "minimiser"))
        groups = F.coalesce("groups", F.lit(1))
        rows = strings.join(large, "bucket", "left").select(
            "bucket", "digest", "offset", "doc_id", "start", "packed", groups.alias("groups"), F.pmod(F.xxhash64("digest", "offset"), groups).cast("int").alias("group")
        )
        sorted_ = rows.repartition("bucket", "group").sortWithinPartitions("bucket", "group").mapInArrow(sort_groups(size, longer[0], bitmap), SORTED)
        out = keep(sorted_, "sorted")
        repeats = out.where("packed is null").select("digest", "offset")
        found = repeats if found is None else found.union(repeats)
        if not divided:
            return found
        strings, longer = out.where("packed is not null"), longer[1:] or longer


def remove_words(size: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            starts, counts = batch.column(2), batch.column(3)
            total, gone, sums = [], [], []
            for i, j in groups(offsets):
                words = words_of(data, offsets[i : j + 1])
                joined, left, right = packed(words)
                for k in range(i, j):
                    a, b = int(words.bounds[k - i]), int(words.bounds[k - i + 1])
                    total.append(b - a)
                    change = np.zeros(b - a + 1, np.int64)
                    if starts[k].is_valid:
                        s, n = starts[k].values.to_numpy(), counts[k].values.to_numpy()
                        np.add.at(change, s, 1)
                        np.add.at(change, s + n + size - 1, -1)
                    stays = np.cumsum(change)[:-1] == 0
                    gone.append(b - a - int(stays.sum()))
                    edge = np.diff(np.concatenate([[0], stays.astype(np.int8), [0]]))
                    parts = [
                        joined[left[a + p] : right[a + q - 1]]
                        for p, q in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
                    ]
                    sums.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return remove


def repeated_ranges(plain: DataFrame, size: int = WINDOW, part: int = MINIMISER) -> DataFrame:
    """(doc_id, start, n): runs of n windows, from word ``start`` on, that occur earlier too. plain: (doc_id, text)."""
    named = plain.where("doc_id is not null")
    counted = named.select("text").mapInArrow(count_minimisers(size, part), "minimiser long, n long")
    again = keep(counted.groupBy("minimiser").agg(F.sum("n").alias("n")).where("n > 1").select("minimiser"), "minimisers")
    bitmap = plain.sparkSession.sparkContext.broadcast(bitmap_of(again, "minimiser"))
    found = keep(named.mapInArrow(super_kmers(size, part, bitmap), STRINGS), "super-kmers")
    place = F.min(F.struct("doc_id", "start"))
    strings = keep(
        found.groupBy("bucket", "digest")
        .agg(place.alias("first"), F.first("packed").alias("packed"))
        .select("bucket", "digest", "first.doc_id", "first.start", "packed"),
        "strings",
    )
    inner = repeats_in_buckets(strings.withColumn("offset", F.lit(0)), size).groupBy("digest").agg(F.collect_list("offset").alias("offsets"))
    known = keep(
        strings.select("digest", F.col("doc_id").alias("first_id"), F.col("start").alias("first_start")).join(inner, "digest", "left"),
        "repeats",
    )
    is_first = (F.col("doc_id") == F.col("first_id")) & (F.col("start") == F.col("first_start"))
    met = found.select("digest", "doc_id", "start", "n").join(known, "digest")
    copies = met.where(~is_first).select("doc_id", "start", "n")
    inside = met.where(is_first & F.col("offsets").isNotNull()).select(
        "doc_id", "start", F.explode("offsets").alias("offset")
    ).select("doc_id", (F.col("start") + F.col("offset")).alias("start"), F.lit(1).alias("n"))
    return copies.union(inside)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of docs; see the module text."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = repeated_ranges(plain, size).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    met = plain.join(ranges, "doc_id", "left").select("doc_id", "text", F.col("found.start").alias("starts"), F.col("found.n").alias("counts"))
    return met.mapInArrow(remove_words(size), "doc_id long, n_words long, n_removed long, kept_sha256 string")
