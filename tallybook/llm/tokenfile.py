"""Token files: ids of all texts, Re-Pair compressed per shard, with random access to each document.

A shard holds up to SHARD_IDS ids (or one longer document) of documents in ascending id order. Re-Pair replaces frequent pairs of
neighbours by new symbols: a round counts all pairs inside documents and replaces those that occur MIN_COUNT times or more, where
pairs overlap the more frequent one; rounds repeat on the shorter sequence until no pair is frequent or a round saves less than 0.5 %. A pair never crosses the end
of a document.

A shard is one self-describing block of bytes (little endian), stored as one row of a Parquet table so that Spark can write it to
any store: header of 8 int64 (magic, documents, terminals, rounds, rules, symbols, bytes per symbol, 0), document ids (int64) and null flags
(uint8), first symbol of each document and the end (int64), rules per round (int64), rules (uint32 pairs), expansion length of each rule
(uint32), symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.tokens import encode_column, vocabulary

END_ID = 2
SHARD_IDS = 1 << 19
MIN_COUNT = 16
MIN_GAIN = 0.005
"""Rounds end when one saves less than this share of the ids: its rules would take the room it gains."""
MAGIC = 0x3152494150455242
_BUCKETS = 18
_HEADER = 8
SHARDS = "part int, shard int, n_docs long, n_ids long, block binary"


def compress(ids: np.ndarray, starts: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """(symbols, first symbol of each document and the end, rule pairs of each round, number of terminals)."""
    symbols = ids.astype(np.uint32)
    ends = np.zeros(len(symbols), bool)
    ends[starts[1:] - 1] = True  # a document has one id at least, its end
    terminals = int(symbols.max()) + 1 if len(symbols) else 0
    following, rounds = terminals, []
    open_ = ~ends  # places whose pair with the next symbol may be frequent; an infrequent pair never becomes frequent
    saved = len(ids)
    while saved >= MIN_GAIN * len(ids):
        at = np.flatnonzero(open_)
        pair = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
        bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKETS)).astype(np.int64)
        maybe = np.bincount(bucket, minlength=1 << _BUCKETS)[bucket] >= min_count
        at, pair, bucket = at[maybe], pair[maybe], bucket[maybe]
        open_ = np.zeros(len(symbols), bool)
        open_[at] = True
        holder = np.zeros(1 << _BUCKETS, np.uint64)
        holder[bucket] = pair  # a bucket counts one of its pairs; the others have their turn in a later round
        mine = holder[bucket] == pair
        at, bucket = at[mine], bucket[mine]
        counts = np.bincount(bucket, minlength=1 << _BUCKETS)
        mine = counts[bucket] >= min_count
        at, bucket = at[mine], bucket[mine]
        if not len(at):
            break
        rank = np.zeros(len(symbols) + 2, np.int64)
        own = counts[bucket] << _BUCKETS | bucket
        rank[at + 1] = own
        wins = (own > rank[at]) & (own >= rank[at + 2])
        at, bucket = at[wins], bucket[wins]
        used = np.zeros(1 << _BUCKETS, bool)
        used[bucket] = True
        number = np.cumsum(used) - 1
        pairs = holder[used]
        rounds.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        symbols[at] = following + number[bucket]
        ends[at] = ends[at + 1]
        open_[at] = True
        open_[at[at > 0] - 1] = True
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, ends = symbols[stay], ends[stay]
        open_ = open_[stay] & ~ends
        following += len(pairs)
        saved = len(at)
    return symbols, np.concatenate([[0], np.flatnonzero(ends) + 1]), rounds, terminals


def expansions(rounds: list[np.ndarray], terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol's ids start in a table, how many they are, and the table."""
    start, length, table = np.arange(terminals, dtype=np.int64), np.ones(terminals, np.int64), np.arange(terminals, dtype=np.uint32)
    for pairs in rounds:
        left, right = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)
        both = np.stack([left, right], axis=1).ravel()
        n = length[left] + length[right]
        start = np.concatenate([start, len(table) + np.cumsum(n) - n])
        table = np.concatenate([table, expand(both, start, length, table)])
        length = np.concatenate([length, n])
    return start, length, table


def expand(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = length[symbols]
    total = np.cumsum(n)
    return table[np.repeat(start[symbols] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]


def write_block(doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> bytes:
    symbols, first, rounds, terminals = compress(ids, starts)
    length = expansions(rounds, terminals)[1][terminals:]
    top = terminals + sum(map(len, rounds))
    width = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
    raw = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    rules = np.concatenate([np.zeros((0, 2), np.uint32), *rounds])
    header = np.array([MAGIC, len(doc_ids), terminals, len(rounds), len(rules), len(symbols), width, 0], "<i8")
    parts = [header, doc_ids.astype("<i8"), nulls.astype(np.uint8), first.astype("<i8"), np.array([len(r) for r in rounds], "<i8")]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (*parts, rules.astype("<u4"), length.astype("<u4"), raw))


class Block:
    """Reads a shard; ``document(k)`` decodes one document from its own symbols."""

    def __init__(self, raw: bytes):
        header = np.frombuffer(raw, "<i8", _HEADER)
        if len(header) < _HEADER or header[0] != MAGIC:
            raise ValueError("not a token shard")
        _, docs, self.terminals, n_rounds, n_rules, n_symbols, width, _ = (int(x) for x in header)
        at = 8 * _HEADER

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls = take("<i8", docs), take("u1", docs).astype(bool)
        self.first, sizes = take("<i8", docs + 1), take("<i8", n_rounds)
        rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.rule_lengths = take("<u4", n_rules)
        packed = take("u1", n_symbols * width).reshape(-1, width)
        wide = np.zeros((n_symbols, 4), np.uint8)
        wide[:, :width] = packed
        self.symbols = wide.view("<u4").ravel().astype(np.int64)
        self.start, self.length, self.table = expansions(np.split(rules, np.cumsum(sizes)[:-1]) if n_rounds else [], self.terminals)

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.first[k] : self.first[k + 1]], self.start, self.length, self.table)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and where each document starts, with the end."""
        before = np.concatenate([[0], np.cumsum(self.length[self.symbols])])
        return expand(self.symbols, self.start, self.length, self.table), before[self.first]


def write_shards(path: str, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        docs, nulls, texts, sizes, held = [], [], [], [], 0

        def close():
            nonlocal shard, held
            ids, starts = np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)])
            block = write_block(np.array(docs, np.int64), np.array(nulls, bool), ids, starts)
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(docs)]), pa.array([len(ids)]), pa.array([block], pa.binary())]
            for x in (docs, nulls, texts, sizes):
                x.clear()
            shard, held = shard + 1, 0
            return pa.RecordBatch.from_arrays(row, names=["part", "shard", "n_docs", "n_ids", "block"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            row, keys = 0, batch.column(0)
            missing, known = keys.is_null().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy(zero_copy_only=False)
            for ids, counts in encode_column(batch.column(1), path):
                stop = np.cumsum(counts)
                for a, b in zip((stop - counts).tolist(), stop.tolist()):
                    if held and held + b - a + 1 > shard_ids:
                        yield close()
                    docs.append(known[row])
                    nulls.append(missing[row])
                    texts += [ids[a:b], end]
                    sizes.append(b - a + 1)
                    held += b - a + 1
                    row += 1
        if held:
            yield close()

    return write


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the token table of docs: rows (part, shard, n_docs, n_ids, block), documents in ascending id order (nulls first)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = ordered.mapInArrow(write_shards(vocabulary_path or vocabulary(), end_id, shard_ids), SHARDS)
    rows.write.option("compression", "none").parquet(path)


def numbered(shards: DataFrame) -> DataFrame:
    """Shards with ``base``, the ids of all shards before: summed per part, then within each part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inner = Window.partitionBy("part").orderBy("shard")
    places = shards.select("part", "shard", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("within"))
    bases = places.join(before, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("base"))
    return shards.join(bases, ["part", "shard"])


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, base in zip(batch.column(0), batch.column(1).to_pylist()):
            block = Block(raw.as_buffer().to_pybytes())
            ids, starts = block.ids()
            data = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.doc_ids, mask=block.nulls),
                    pa.array(base + starts[:-1]),
                    pa.array(np.diff(starts)),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token table, decoded from its blocks."""
    shards = numbered(spark.read.schema(SHARDS).parquet(path))
    return shards.select("block", "base").mapInArrow(read_blocks, "doc_id long, start long, n_tokens long, ids_crc32 long")
