"""Near-duplicate documents: MinHash bands find candidates, odd sketches screen them, full shingle sets confirm them.

A document's set holds its distinct 5-word shingles (lower-cased A-Z); with fewer words the whole sequence is its one shingle;
without words the set is empty and linked with nothing. Two documents are linked when their sets have a Jaccard similarity of
75 % or more.

1. Documents of equal sets form one class; from here on a class is one row, however many copies it has.
2. 128 MinHash samples make 32 bands of 4: at 75 % similarity a pair shares no band with probability 5e-6. The samples also
   flip bits of a 1024-bit parity bitmap (odd sketch); the XOR of two sketches estimates the similarity.
3. Each bucket (one band value) compares its members with its hub, the smallest member: pairs grow with the members.
   Pairs whose XOR count fits a similarity of at least about 50 % (6 standard errors below the limit) are confirmed.
4. Buckets that still hold several components compare what is outside their largest component with all members, in blocks of
   at most 256 against 256. A block screens by sketch, confirms on full sets and returns links that join components; it
   never emits the pairs of a group.

Rows without ``doc_id`` take no part (component null, kept). Repeated rows are copies of each other. Nulls and empty texts
have n_shingles 0. Rows with one id and different texts are separate members that share the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import components, keep, lists
from tallybook.llm.words import groups, mix, utf8, window_hashes, words_of

SHINGLE_WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
SCREEN = 0.5
"""Estimated similarity below which a candidate is not confirmed."""
CHUNK = 256
_random = np.random.default_rng(7)
_MULTIPLY = (_random.integers(0, 2**31, SAMPLES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _random.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_BAND = _random.integers(0, 2**63, BANDS, dtype=np.uint64)
_SAMPLE = _random.integers(0, 2**63, SAMPLES, dtype=np.uint64)

SIGNATURE = "doc_id long, digest binary, n_shingles long, bands array<long>, sketch array<long>"
SHINGLES = "doc_id long, digest binary, shingles array<long>"


def xor_limit(similarity: float) -> int:
    """Largest expected XOR count of two odd sketches at this similarity."""
    differing = 2 * SAMPLES * (1 - similarity)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing)))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    for i, j in groups(offsets):
        words = words_of(data, offsets[i : j + 1], lower=True)
        windows = window_hashes(words.hashes, SHINGLE_WORDS)
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            if b - a >= SHINGLE_WORDS:
                yield np.unique(windows[a : b - SHINGLE_WORDS + 1])
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(words.hashes[a:b].tobytes(), seed=int(b - a))], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    low = shingles.astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for c in range(0, len(low), 2048):
        part = _MULTIPLY[:, None] * low[None, c : c + 2048] + _ADD[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    x = sampled.astype(np.uint64).reshape(BANDS, ROWS)
    first = mix((x[:, 0] << np.uint64(32) | x[:, 1]) + _BAND)
    return mix(first ^ (x[:, 2] << np.uint64(32) | x[:, 3]))


def odd_sketch(sampled: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 16 64-bit words."""
    place = mix(sampled.astype(np.uint64) + _SAMPLE) & np.uint64(SKETCH_BITS - 1)
    parity = (np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes, bands, sketches = [], [], [], []
        for found in shingle_sets(batch.column(1)):
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            if len(found):
                sampled = samples(found)
                bands.append(band_keys(sampled))
                sketches.append(odd_sketch(sampled))
        filled = np.array(sizes, np.int64) > 0
        flat = lambda parts: np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(digests, pa.binary()),
                pa.array(np.array(sizes, np.int64)),
                lists(flat(bands), filled * BANDS),
                lists(flat(sketches), filled * (SKETCH_BITS // 64)),
            ],
            names=["doc_id", "digest", "n_shingles", "bands", "sketch"],
        )


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                lists(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64), np.array([len(s) for s in sets], np.int64)),
            ],
            names=["doc_id", "digest", "shingles"],
        )


def xor_count(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def links_in_block(percent: int):
    """Links between members of different components, from one block; enough to join what is connected."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        left = np.flatnonzero(block["outside"].to_numpy())
        right = np.flatnonzero(~block["outside"].to_numpy())
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in block["shingles"]]  # in the order that shingle_sets sorts by
        labels, group = np.unique([bytes(c) for c in block["label"]], return_inverse=True)
        bits = np.unpackbits(np.stack(block["sketch"].to_numpy()).astype(np.int64).view(np.uint8), axis=1).astype(np.float32)
        weight = bits.sum(axis=1)
        shared = bits[left] @ bits[right].T
        apart = weight[left][:, None] + weight[right][None, :] - 2 * shared
        near = (apart <= xor_limit(SCREEN)) & (group[left][:, None] != group[right][None, :])
        root = list(range(len(labels)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i in np.flatnonzero(near.any(axis=1)):
            a = sets[left[i]]
            others = right[near[i]]
            members = np.concatenate([sets[j] for j in others])
            place = np.minimum(np.searchsorted(a, members), len(a) - 1)
            lengths = np.array([len(sets[j]) for j in others])
            common = np.add.reduceat((a[place] == members).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            for j in others[100 * common >= percent * (len(a) + lengths - common)]:
                p, q = find(group[left[i]]), find(group[j])
                if p != q:
                    root[p] = q
                    found.append((block["digest"].iat[left[i]], block["digest"].iat[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return compare


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; the sketches screen first."""
    sketch = classes.select("digest", "sketch")
    met = (
        pairs.join(sketch.select(F.col("digest").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        .join(sketch.select(F.col("digest").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        .where(xor_count(F.col("sketch_a"), F.col("sketch_b")) <= xor_limit(SCREEN))
        .select("a", "b")
    )
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        keep(met, "screened").join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("set_b")), "b")
        .where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common))
        .select("a", "b")
    )


def residual_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the hubs did not show: per bucket, members outside the largest component against all members, in blocks."""
    named = members.join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").select(
        "key", "digest", F.coalesce("label", "digest").alias("label")
    )
    named = keep(named, "members")
    counts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = keep(
        counts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("parts"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
        .where("parts > 1")
        .select("key", "main", F.ceil((F.col("n") - F.col("most")) / CHUNK).cast("int").alias("lefts"), F.ceil(F.col("n") / CHUNK).cast("int").alias("rights")),
        "buckets",
    )
    entries = named.join(mixed, "key")
    at = lambda n: F.pmod(F.xxhash64("digest", "key"), F.col(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = entries.where("label != main").select("key", "digest", "label", F.lit(True).alias("outside"), at("lefts").alias("l"), across("rights").alias("r"))
    rights = entries.select("key", "digest", "label", F.lit(False).alias("outside"), across("lefts").alias("l"), at("rights").alias("r"))
    return (
        lefts.union(rights)
        .join(classes.select("digest", "sketch"), "digest")
        .join(sets.select("digest", "shingles"), "digest")
        .groupBy("key", "l", "r")
        .applyInPandas(links_in_block(percent), "a binary, b binary")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs; see the module text."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = keep(plain.mapInArrow(sign, SIGNATURE), "signed")
    classes = keep(
        signed.where("doc_id is not null and n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    entries = classes.select(F.explode("bands").alias("key"), "digest")
    hubs = entries.groupBy("key").agg(F.min("digest").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    members = keep(entries.join(hubs, "key"), "members")
    shared = members.select("digest").distinct().join(classes.select("digest", "first_id"), "digest")
    wanted = keep(shared.select(F.col("first_id").alias("doc_id"), F.col("digest").alias("wanted")), "wanted")
    sets = keep(
        plain.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        .mapInArrow(full_sets, SHINGLES)
        .join(wanted, "doc_id")
        .where("digest = wanted")
        .dropDuplicates(["digest"])
        .select("digest", "shingles"),
        "sets",
    )
    pairs = members.where("digest != hub").select(F.col("digest").alias("a"), F.col("hub").alias("b")).distinct()
    links = keep(confirmed(pairs, classes, sets, percent), "confirmed")
    more = keep(residual_links(members, components(links), classes, sets, percent), "residual")
    labels = components(links.union(more)) if not more.isEmpty() else components(links)
    joined = classes.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", "first_id", F.coalesce("label", "digest").alias("label")
    )
    lowest = joined.groupBy("label").agg(F.min("first_id").alias("component"))
    named = keep(joined.join(lowest, "label").select("digest", "component"), "components")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return signed.select("doc_id", "digest", "n_shingles").join(named, "digest", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )
