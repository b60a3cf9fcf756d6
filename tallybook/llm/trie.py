"""Prefix trie of conversations from a global sort: nodes are intervals of sorted rows, found by range minima over LCPs.

A conversation is its sequence of turns (role, text). A node of depth d is a distinct sequence of d turns; the conversations that
start with it are its members.

1. A turn becomes a token of 20 bytes: a digest of role and text, and the number of words of the text. A conversation is the
   binary string of its tokens. Rows are range partitioned and sorted by (sequence, conv_id), so copies of one conversation,
   however many, spread over partitions by id.
2. A partition is read as a stream of blocks of bounded size. In a block the longest common prefixes of neighbours make a sparse
   table of range minima. Each prefix that a row does not share with the row before is a candidate; its left and right
   extent are found independently, by a binary search of log n steps each over the table, without a stack.
3. Counts of a node are differences of running sums over its interval. Nodes that reach over an end of their block give
   partial sums under a digest of their prefix, at most two paths for each block; these are added up in Spark. What the
   ends of partitions share is known only when all are sorted; one row for each partition gives the corrections.
4. Conversation ids that end at a node are hashed in a stream; of a node over several blocks, block by block in order.

Null role or text counts as empty; turns are ordered by ``turn`` (null first), ties by token. Rows without conv_id take no part.
An empty table has no node. One conversation's tokens (20 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import keep, partitions

TOKEN = 20
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NODES = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " ends_sha256 string, key binary, parent_key binary, block string, ends_first long, ends_text string, part int, first binary, last binary"
)
COMPLETE, HANGING, PARTIAL, EDGE = 0, 1, 2, 3
"""Kinds of rows: node in one block, the same below a node that is in several, part of a node, first and last row of a partition."""


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, tokens): the tokens of each conversation in order, as hexadecimal texts."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    token = F.concat(digest, F.lower(F.lpad(F.hex(words.cast("long")), 8, "0")))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), token.alias("token"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "token")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.col("turns.token").alias("tokens"))


def with_shared_heads(seqs: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Conversation c with its first h tokens replaced by those of c - c % family, h being crc32 of c's digits modulo ``heads``."""
    first = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("tokens", 1, heads).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    met = seqs.join(first, seqs["conv_id"] - seqs["conv_id"] % family == first["base"], "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<string>"))
    return met.select("conv_id", F.concat(head, F.slice("tokens", h + 1, F.size("tokens"))).alias("tokens"))


def shared(a: bytes, b: bytes) -> int:
    """Tokens at the beginning that two sequences share."""
    n = min(len(a), len(b)) // TOKEN
    if not n:
        return 0
    same = (np.frombuffer(a, np.uint8, n * TOKEN) == np.frombuffer(b, np.uint8, n * TOKEN)).reshape(n, TOKEN).all(axis=1)
    return n if same.all() else int(same.argmin())


def prefix_keys(sequence: bytes, upto: int) -> list[bytes]:
    """Digests of the first 0, 1, ... ``upto`` tokens."""
    running = xxhash.xxh3_128()
    keys = [running.digest()]
    for d in range(upto):
        running.update(sequence[d * TOKEN : (d + 1) * TOKEN])
        keys.append(running.digest())
    return keys


class Minima:
    """Sparse table: minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def right(self, place: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Last row reachable from each place over neighbours that share ``least`` or more (value j joins rows j - 1 and j)."""
        at, n = place.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at + (1 << k) < n
            ok = fits & (level[np.where(fits, at + 1, 0)] >= least)
            at[ok] += 1 << k
        return at

    def left(self, place: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First row reachable from each place."""
        at = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at - (1 << k) >= 0
            ok = fits & (level[np.where(fits, at - (1 << k) + 1, 0)] >= least)
            at[ok] -= 1 << k
        return at

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum of each range [left, right]."""
        power = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(left), self.levels[0].dtype)
        for k in np.unique(power).tolist():
            rows = power == k
            out[rows] = np.minimum(self.levels[k][left[rows]], self.levels[k][right[rows] - (1 << k) + 1])
        return out


def common_prefixes(tokens: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Tokens that each row shares with the row before; 0 for the first."""
    out = np.zeros(len(length), np.int64)
    both = np.minimum(length[1:], length[:-1])
    rows = np.flatnonzero(both) + 1
    if not len(rows):
        return out
    n = both[rows - 1]
    starts = np.cumsum(n) - n
    ramp = np.arange(n.sum()) - np.repeat(starts, n)
    same = (tokens[np.repeat(offset[rows], n) + ramp] == tokens[np.repeat(offset[rows - 1], n) + ramp]).all(axis=1)
    mismatch = np.where(same, np.iinfo(np.int64).max, ramp)
    out[rows] = np.minimum(np.minimum.reduceat(mismatch, starts), n)
    return out


def block_nodes(ids: np.ndarray, rows: list[bytes], before: bytes | None, after: bytes | None, name: str) -> pa.Table:
    """Nodes of one block of sorted rows; ``before`` and ``after`` are the neighbours, None at an end of the partition."""
    m = len(rows)
    length = np.array([len(r) for r in rows], np.int64) // TOKEN
    offset = np.cumsum(length) - length
    tokens = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, TOKEN)
    words = np.concatenate([[0], np.cumsum(tokens[:, TOKEN - 4 :].copy().view(">u4").ravel().astype(np.int64))])
    upto = lambda row, d: words[offset[row] + d] - words[offset[row]]  # noqa: E731  words of a row's first d turns
    lcp = common_prefixes(tokens, offset, length)
    joined = lcp.copy()
    joined[0] = -1
    lcp[0] = 0 if before is None else shared(before, rows[0])
    following = np.append(lcp[1:], 0 if after is None else shared(rows[-1], after))
    table = Minima(joined)

    lowest = lcp + 1  # a row's candidates start behind what it shares with the row before
    lowest[0] = 0
    count = length - lowest + 1
    base = np.cumsum(count) - count
    row = np.repeat(np.arange(m), count)
    depth = np.arange(count.sum()) - base[row] + lowest[row]
    left, right = table.left(row, depth), table.right(row, depth)

    new = depth > lcp[row]
    above = np.maximum(depth - 1, 0)
    parent_row = table.left(row, above)
    parent = base[parent_row] + above - lowest[parent_row]
    children = np.bincount(parent[new & (depth > 0)], minlength=len(row))
    leaves = np.concatenate([[0], np.cumsum(length > following)])
    all_words = np.concatenate([[0], np.cumsum(upto(np.arange(m), length))])
    new_words = np.concatenate([[0], np.cumsum(upto(np.arange(m), length) - upto(np.arange(m), lcp))])
    members = right - left + 1
    start = np.maximum(np.maximum(depth, 1), lcp[left] + 1)
    distinct = new_words[right + 1] - new_words[left + 1] + upto(left, length[left]) - upto(left, start - 1)
    saved = all_words[right + 1] - all_words[left] - members * upto(left, np.maximum(depth, 1) - 1) - distinct

    known_left, known_right = before is not None, after is not None
    crosses = (row == 0) & ((depth <= lcp[0]) | (not known_left))
    crosses |= (right == m - 1) & ((depth <= following[-1]) | (not known_right))
    deepest = int(depth[crosses].max(initial=0))
    first_keys = prefix_keys(rows[0], min(deepest, int(length[0])))
    last_keys = prefix_keys(rows[-1], min(deepest, int(length[-1])))
    key: list[bytes | None] = [None] * len(row)
    for i in np.flatnonzero(crosses).tolist():
        key[i] = first_keys[depth[i]] if row[i] == 0 and depth[i] < len(first_keys) else last_keys[depth[i]]

    same = np.zeros(m, bool)
    same[1:] = (lcp[1:] == length[1:]) & (length[1:] == length[:-1])
    run = np.flatnonzero(~same)
    run_end = np.append(run[1:], m)
    end_of = dict(zip(run.tolist(), run_end.tolist()))
    lowest_id = Minima(ids).least(left, right)
    kind = np.where(crosses, PARTIAL, np.where(crosses[parent] & (depth > 0), HANGING, COMPLETE))
    hashes: list[str | None] = [EMPTY] * len(row)
    texts: list[str | None] = [None] * len(row)
    ends_first = np.zeros(len(row), np.int64)
    for i in np.flatnonzero(length[left] == depth).tolist():
        a = int(left[i])
        text = ",".join(map(str, ids[a : end_of[a]].tolist()))
        if crosses[i]:
            texts[i], ends_first[i] = text, ids[a]
        else:
            hashes[i] = hashlib.sha256(text.encode()).hexdigest()
    nothing = pa.nulls(len(row), pa.int64())
    known_parent = pa.array(lowest_id[parent], mask=(kind != COMPLETE) | (depth == 0))
    columns = {
        "kind": pa.array(kind.astype(np.int32)), "conv_id": pa.array(lowest_id), "depth": pa.array(depth), "parent_conv_id": known_parent,
        "n_convs": pa.array(members), "n_children": pa.array(children), "n_leaves": pa.array(leaves[right + 1] - leaves[left]),
        "saved_tokens": pa.array(saved), "ends_sha256": pa.array(hashes, pa.string()), "key": pa.array(key, pa.binary()),
        "parent_key": pa.array([key[p] if d else None for p, d in zip(parent.tolist(), depth.tolist())], pa.binary()),
        "block": pa.array([name] * len(row)), "ends_first": pa.array(ends_first), "ends_text": pa.array(texts, pa.string()),
        "part": nothing.cast(pa.int32()), "first": nothing.cast(pa.string()).cast(pa.binary()), "last": nothing.cast(pa.string()).cast(pa.binary()),
    }
    return pa.table(columns)


def nodes_of_partition(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, sequence) to rows of NODES, block by block."""
    part = TaskContext.get().partitionId()
    ids: list[int] = []
    rows: list[bytes] = []
    size, number, before = 0, 0, None
    first: bytes | None = None

    def finish(after: bytes | None) -> pa.Table:
        nonlocal ids, rows, size, number, before
        out = block_nodes(np.array(ids, np.int64), rows, before, after, f"{part}-{number}")
        before, ids, rows, size, number = rows[-1], [], [], 0, number + 1
        return out

    for batch in batches:
        for conv, sequence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if size >= BLOCK_BYTES or len(rows) >= block_rows:
                yield from finish(sequence).to_batches()
            if first is None:
                first = sequence
            ids.append(conv)
            rows.append(sequence)
            size += len(sequence)
    if first is None:
        return
    last = rows[-1]
    out = finish(None)
    yield from out.to_batches()
    ends = {"kind": pa.array([EDGE], pa.int32()), "part": pa.array([part], pa.int32()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary())}
    yield pa.RecordBatch.from_arrays([ends[f.name] if f.name in ends else pa.nulls(1, f.type) for f in out.schema], names=out.schema.names)


CORRECTIONS = "key binary, n_children long, n_leaves long, saved_tokens long"


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What was counted twice where a partition's first row shares its beginning with the last row before."""
    for batch in batches:
        keys, children, leaves, saved = [], [], [], []
        for last, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            common = shared(last, first)
            counted_leaf = int(common == len(last) // TOKEN and common > 0)
            weights = np.frombuffer(first, np.uint8).reshape(-1, TOKEN)[:, TOKEN - 4 :].copy().view(">u4").ravel().astype(np.int64)
            words = np.concatenate([[0], np.cumsum(weights)])
            for d, key in enumerate(prefix_keys(first, common)):
                keys.append(key)
                children.append(-1 if d < common else 0)
                leaves.append(-counted_leaf)
                saved.append(int(words[common] - words[max(d, 1) - 1]) if common else 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(children, pa.int64()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())],
            names=["key", "n_children", "n_leaves", "saved_tokens"],
        )


def hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) sorted by key and first id to (key, hash of the texts joined by commas), holding one text at a time."""
    now, running = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            key = key.as_py()
            if key != now:
                if running is not None:
                    yield done()
                now, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.as_py().encode())
    if running is not None:
        yield done()


def prefix_trie(seqs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per node of the trie over (conv_id, tokens); see the module text. Each conv_id stands once.

    conv_id: smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves (childless nodes below or at the node);
    saved_tokens: words that prefix sharing saves below or at the node; ends_sha256: of the sorted ids that end here.
    """
    rows = seqs.select("conv_id", F.unhex(F.array_join("tokens", "")).alias("sequence"))
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    nodes = keep(ordered.mapInArrow(lambda batches: nodes_of_partition(batches, block_rows), NODES), "nodes")
    parts = nodes.where(F.col("kind") == PARTIAL)
    neighbours = nodes.where(F.col("kind") == EDGE).select(F.lag("last").over(Window.orderBy("part")).alias("last"), "first").where("last is not null")
    changes = neighbours.mapInArrow(corrections, CORRECTIONS)
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    added = keep(
        parts.select("key", "parent_key", "depth", "conv_id", *sums).unionByName(changes, allowMissingColumns=True)
        .groupBy("key")
        .agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *[F.sum(s).alias(s) for s in sums]),
        "joined",
    )
    texts = parts.where("ends_text is not null").select("key", "ends_text", "ends_first")
    hashes = texts.repartition("key").sortWithinPartitions("key", "ends_first").select("key", "ends_text").mapInArrow(hash_chunks, "key binary, ends_sha256 string")
    names = added.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    whole = (
        added.join(names, "parent_key", "left").join(hashes, "key", "left")
        .withColumns({"ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY)), "n_leaves": F.greatest("n_leaves", F.lit(1))})  # a root alone is a leaf
    )
    in_block = parts.select("block", "key").join(added.select("key", F.col("conv_id").alias("found")), "key").withColumnRenamed("key", "parent_key")
    hanging = nodes.where(F.col("kind") == HANGING).join(in_block, ["block", "parent_key"], "left").withColumn("parent_conv_id", F.col("found"))
    complete = nodes.where(F.col("kind") == COMPLETE)
    return complete.select(*FIELDS).union(hanging.select(*FIELDS)).union(whole.select(*FIELDS))
