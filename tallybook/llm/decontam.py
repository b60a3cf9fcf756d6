"""Benchmark decontamination by templates: finds benchmark items in documents, also with other numbers, names and units.

Tokens are words without the ASCII punctuation around them, lower-cased; words of punctuation alone do not count. A number
becomes the placeholder of numbers, a capitalised word inside a sentence that of names, a unit behind a number that of units. A
capitalised word that opens a sentence may be a name or not, so each text is read in two ways: such words as they are, and as names. A
window is 8 consecutive tokens of the template (the whole item where it is shorter; items of fewer than 4 tokens cannot be told
from other text and take no part); with fewer than 3 literal tokens its own
tokens stand in it, so that tables of numbers match only exactly. A window with placeholders also stands with its own tokens,
so that a copy is found where capitals or sentence starts hide a name. Windows of documents whose hash may be in the benchmark (a
bitmap of fixed size) are joined with the benchmark's by hash.

The slots of an alignment agree when, in one reading of the item, each slot value of the item stands for one value everywhere in the
document's copy. Windows that match by their own tokens need no slots. A document holds an item when, on alignments whose slots agree, one covers at least 30 % of the item's windows, or
windows that match by their own tokens cover 30 % on all of them together or RUN consecutive tokens on one. All texts and windows
count; nothing is sampled.

Rows with a null text or without ``doc_id`` are looked at like others (their id is null in the result). Equal rows give one result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import bitmap_of, in_bitmap, keep, lists
from tallybook.llm.words import LOWER, groups, mix, range_hashes, utf8, window_hashes, words_of

WINDOW = 8
LITERALS = 3
MIN_TOKENS = 4
MIN_SHARE = 0.3
RUN = 13
"""So many consecutive tokens of an item are a leak, whatever their share of it."""
BROADCAST_WINDOWS = 200_000
"""Up to this many benchmark windows (some 20 MB) are sent to all tasks; beyond, both sides are shuffled by hash."""
UNITS = """
mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs min mins h hr hrs ms ns hz khz mhz ghz w kw mw kwh v a
pa kpa bar k c f kb mb gb tb bit bits byte bytes second seconds minute minutes hour hours day days week weeks month months
year years meter meters metre metres kilometer kilometers mile miles foot feet inch inches yard yards gram grams kilogram
kilograms pound pounds ounce ounces ton tons tonne tonnes liter liters litre litres gallon gallons dollar dollars cent
cents euro euros degree degrees percent mph kmh
""".split()
NUMBER, NAME, UNIT = (mix(np.array([k], np.uint64))[0] for k in (11, 12, 13))
_ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _ALNUM[_a : _b + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_IN_NUMBER = _DIGIT.copy()
_IN_NUMBER[[ord(c) for c in ".,:/-"]] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:"]] = True


def _before(mask: np.ndarray) -> np.ndarray:
    """Number of set places before each place."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _unit_hashes() -> np.ndarray:
    joined = np.frombuffer("".join(UNITS).encode(), np.uint8)
    end = np.cumsum([len(u) for u in UNITS])
    return np.sort(range_hashes(joined, end - [len(u) for u in UNITS], end))


_UNIT_HASHES = _unit_hashes()


def lower_bytes(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lower-cased bytes of the texts, place by place; characters whose length changes with their case stay as they are."""
    small, small_offsets = utf8(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    out = LOWER[data]
    same = np.diff(small_offsets) == np.diff(offsets)
    if same.all():
        out[offsets[0] : offsets[-1]] = small[small_offsets[0] : small_offsets[-1]]
    else:
        for k, fits in enumerate(same.tolist()):
            if fits:
                own = small[small_offsets[k] : small_offsets[k + 1]]
            else:
                text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                kept = "".join(low if len((low := c.lower()).encode()) == len(c.encode()) else c for c in text)
                own = np.frombuffer(kept.encode(), np.uint8)
            out[offsets[k] : offsets[k + 1]] = own
    return out


def templates(data: np.ndarray, offsets: np.ndarray, lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts: own hash of each token, its template hash in both readings, and per text the range of its tokens."""
    words = words_of(data, offsets)
    data, lowered = words.data, lowered[offsets[0] : offsets[-1]]
    solid = _before(_ALNUM[data])
    has = solid[words.end] > solid[words.start]
    places = np.flatnonzero(_ALNUM[data])
    start = places[solid[words.start[has]]]
    end = places[solid[words.end[has]] - 1] + 1
    bounds = np.concatenate([[0], np.cumsum(has)])[words.bounds]
    own = range_hashes(lowered, start, end)
    if not len(own):
        return own, own, own, bounds
    digits, numeric, lowers = (_before(mask[data]) for mask in (_DIGIT, _IN_NUMBER, _SMALL))
    number = (digits[end] > digits[start]) & (numeric[end] - numeric[start] == end - start)
    changed = data != lowered
    second = np.minimum(start + 1, len(data) - 1)
    capital = (changed[start] | (changed[second] & (data[start] >= 128))) & (lowers[end] > lowers[start])
    last, lines = words.end[has], _before(data == 10)
    ends = _before(_ENDS[data])
    opens = np.ones(len(own), bool)  # at the start of a sentence, line or text
    opens[1:] = (ends[last[:-1]] > ends[end[:-1]]) | (lines[start[1:]] > lines[end[:-1]])
    opens[bounds[:-1][bounds[:-1] < len(own)]] = True
    template, named = own.copy(), own.copy()
    template[capital & ~opens] = NAME
    named[capital] = NAME
    behind = np.flatnonzero(number[:-1]) + 1
    at = np.minimum(np.searchsorted(_UNIT_HASHES, own[behind]), len(_UNIT_HASHES) - 1)
    for reading in (template, named):
        reading[behind[_UNIT_HASHES[at] == own[behind]]] = UNIT
        reading[number] = NUMBER
    return own, template, named, bounds


def windows(size: int, lengths: tuple[int, ...], bitmap=None, whole: bool = False):
    """Template windows: (id, digest, place, key, slots, n, length, readings, literal). readings: bits of the readings
    of the text that have the window; literal: it stands with its own tokens. whole: only windows of the text's own length, if shorter than size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = utf8(batch.column(1))
            lowered = lower_bytes(batch.column(1), data, offsets)
            for i, j in groups(offsets):
                own, *readings, bounds = templates(data, offsets[i : j + 1], lowered)
                slots_before = [_before(own != template) for template in readings]
                slot_values = [own[own != template].view(np.int64) for template in readings]
                for length in lengths:
                    if len(own) < length:
                        continue
                    exact = mix(window_hashes(own, length) + np.uint64(length))
                    keys, held = [], []
                    for template, before in zip(readings, slots_before):
                        held.append(before[length:] - before[: len(exact)])
                        keys.append(np.where(length - held[-1] < LITERALS, exact, mix(window_hashes(template, length) + np.uint64(length))))
                    # The window in the first reading, in the second where it differs, and (with slots) by its own tokens.
                    for key, k, at in (
                        (keys[0], 0, np.arange(len(exact))),
                        (keys[1], 1, np.flatnonzero((keys[1] != keys[0]) & (keys[1] != exact))),
                        (exact, None, np.flatnonzero(keys[0] != exact)),
                    ):
                        if bitmap is not None:
                            at = at[in_bitmap(bitmap.value, key[at])]
                        text = np.searchsorted(bounds, at, "right") - 1
                        inside = at + length <= bounds[text + 1]
                        if whole:
                            inside &= np.minimum(bounds[text + 1] - bounds[text], size) == length
                        at, text = at[inside], text[inside]
                        if not len(at):
                            continue
                        n = np.zeros(len(at), np.int64) if k is None else held[k][at]
                        flat = np.repeat(slots_before[k or 0][at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        both = sum((keys[bit][at] == key[at]).astype(np.int32) << bit for bit in (0, 1))
                        digests = {t: hashlib.md5(data[offsets[i + t] : offsets[i + t + 1]].tobytes()).hexdigest() for t in np.unique(text).tolist()}
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(i + text)),
                                pa.array([digests[t] for t in text.tolist()], pa.string()),
                                pa.array((at - bounds[text]).astype(np.int32)),
                                pa.array(key[at].view(np.int64)),
                                lists(slot_values[k or 0][flat], n),
                                pa.array((bounds[text + 1] - bounds[text] - length + 1).astype(np.int32)),
                                pa.array(np.full(len(at), length, np.int32)),
                                pa.array(both),
                                pa.array(key[at] == exact[at]),
                            ],
                            names=["id", "digest", "place", "key", "slots", "n", "length", "readings", "literal"],
                        )

    return cut


WINDOWS = "id long, digest string, place int, key long, slots array<long>, n int, length int, readings int, literal boolean"


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(doc_id, item_id, n_windows, share, reparameterised, text_md5): one row per document and item found in it.

    share: matched part of the item's windows, on the alignment that shows most or by own tokens on all; reparameterised: a slot differs from the item's; text_md5: MD5 of the text, so
    that rows of one id (or none) can be told apart.
    """
    spark = docs.sparkSession
    lengths = tuple(range(MIN_TOKENS, WINDOW + 1))
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    known = keep(items.mapInArrow(windows(WINDOW, lengths, whole=True), WINDOWS), "benchmark-windows")
    total = known.count()
    bitmap = spark.sparkContext.broadcast(bitmap_of(known, "key"))
    used = tuple(sorted(r.length for r in known.select("length").distinct().collect()))  # at most WINDOW numbers
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = plain.mapInArrow(windows(WINDOW, used or (WINDOW,), bitmap), WINDOWS)
    item = known.select(
        F.col("id").alias("item_id"), F.col("digest").alias("item"), F.col("place").alias("item_place"), "key",
        F.col("slots").alias("item_slots"), F.col("n").alias("item_n"), F.col("readings").alias("item_readings"),
    ).distinct()
    met = found.join(F.broadcast(item) if total <= BROADCAST_WINDOWS else item, "key")
    # A window that matches by its own tokens counts in both readings; slots only in the readings that have them.
    reads = [F.col("item_readings").bitwiseAND(F.lit(1 << k)) > 0 for k in (0, 1)]
    pairs = lambda k: F.array_distinct(F.flatten(F.collect_set(F.when(reads[k], F.arrays_zip("item_slots", "slots")))))
    aligned = met.groupBy("id", "digest", "item_id", "item", "item_n", (F.col("place") - F.col("item_place")).alias("shift")).agg(
        *(F.countDistinct(F.when(reads[k] | F.col("literal"), F.col("item_place"))).alias(f"n{k}") for k in (0, 1)),
        *(pairs(k).alias(f"pairs{k}") for k in (0, 1)),
        F.array_sort(F.collect_set(F.when(F.col("literal"), F.col("item_place")))).alias("literal"),
    )
    stands_for_one = [F.size(f"pairs{k}") == F.size(F.array_distinct(f"pairs{k}.item_slots")) for k in (0, 1)]
    differs = [F.exists(f"pairs{k}", lambda p: p.item_slots != p.slots) for k in (0, 1)]
    best = [F.when(stands_for_one[k], F.struct(F.col(f"n{k}").alias("n_windows"), (~differs[k]).alias("same"))) for k in (0, 1)]
    steps = RUN - WINDOW
    later = F.slice("literal", steps + 1, F.greatest(F.size("literal") - steps, F.lit(0)))
    run = F.exists(F.zip_with("literal", later, lambda a, b: b - a), lambda d: F.coalesce(d == steps, F.lit(False)))
    judged = (
        aligned.groupBy("id", "digest", "item_id", "item", "item_n")
        .agg(
            F.max(F.greatest(*best)).alias("one"),
            F.size(F.array_distinct(F.flatten(F.collect_list("literal")))).cast("long").alias("own"),
            F.max(run).alias("run"),
        )
    )
    # Windows that match by their own tokens decide without slots: an alignment whose slots disagree only loses its templates.
    most = F.greatest("one", F.struct(F.col("own").alias("n_windows"), F.lit(True).alias("same")))
    return (
        judged.select("id", "digest", "item_id", "run", most.n_windows.alias("n_windows"), (most.n_windows / F.col("item_n")).alias("share"), most.same.alias("same"))
        .where(F.col("run") | (F.col("share") >= min_share))
        .groupBy(F.col("id").alias("doc_id"), "item_id", F.col("digest").alias("text_md5"))
        .agg(F.max(F.struct("n_windows", "share", "same")).alias("best"))
        .select("doc_id", "item_id", "best.n_windows", "best.share", (~F.col("best.same")).alias("reparameterised"), "text_md5")
    )
