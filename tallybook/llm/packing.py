"""Vector best fit: texts packed into sequences under residual tokens, documents and attention cost.

A text's ids and an end id are cut into pieces of at most CAPACITY tokens. A piece needs (its tokens, one document, its tokens
squared); a sequence offers (tokens, documents, attention). Pieces are taken longest first; of the open sequences that can take
it under every constraint, a piece goes to the one whose residual is smallest afterwards: the weighted norm of the residual
vector, each part divided by its capacity. (choose="dot": the largest weighted dot product of need and residual.)

Pieces are dealt out to groups of about GROUP by a number of their own, so copies and hot sources do not meet in one task; a
group leaves about one sequence that is not full. Nulls are empty texts; rows without ``doc_id`` or repeated rows are packed like
others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import keep
from tallybook.llm.tokens import encode_column, vocabulary

CAPACITY = 2048
END_ID = 0
GROUP = 16384
WEIGHTS = (1.0, 1e-6, 1e-6)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for ids, counts in encode_column(batch.column(1), path):
                data, at = ids.astype("<u4").tobytes(), 0
                for n in counts.tolist():
                    own = data[4 * at : 4 * (at + n)] + end
                    at += n
                    for piece, start in enumerate(range(0, n + 1, capacity)):
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(min(capacity, n + 1 - start))
                        sums.append(zlib.crc32(own[4 * start : 4 * (start + capacity)]))
                    row += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], choose: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    limit = np.array(capacities, float)
    scale = np.array(weights, float) / limit**2
    rest = np.zeros((3, n))  # residual tokens, documents, attention of the open sequences
    name = np.zeros(n, np.int64)
    opened = alive = 0
    for k in order:
        size = float(lengths[k])
        need = np.array([size, 1.0, size * size])
        if (need > limit).any():
            raise ValueError("a piece does not fit into an empty sequence")
        fits = np.flatnonzero((rest[0, :alive] >= need[0]) & (rest[1, :alive] >= need[1]) & (rest[2, :alive] >= need[2]))
        if len(fits):
            left = rest[:, fits]
            score = -(scale @ (left - need[:, None]) ** 2) if choose == "norm" else (scale * need) @ left
            at = int(fits[np.argmax(score)])
        else:
            at = alive
            rest[:, at] = limit
            name[at] = opened
            opened, alive = opened + 1, alive + 1
        bins[k], offsets[k] = name[at], int(limit[0] - rest[0, at])
        rest[:, at] -= need
        if rest[0, at] < least or rest[1, at] < 1 or rest[2, at] < least * least:  # nothing fits any more
            alive -= 1
            rest[:, at], name[at] = rest[:, alive], name[alive]
    return bins, offsets


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    choose: str = "norm",
    vocabulary_path: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    max_documents and max_attention (sum of squared piece lengths) do not bind by default.
    """
    capacities = (capacity, max_documents or capacity, max_attention or capacity**2)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = plain.mapInArrow(cut_pieces(vocabulary_path or vocabulary(), capacity, end_id), PIECES)
    pieces = keep(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(pieces.count() / GROUP))

    def place(group: pa.Table) -> pa.Table:
        bins, offsets = best_fit(group["length"].to_numpy(), capacities, weights, choose)
        sequences = (group["bucket"].to_numpy().astype(np.int64) << 32) + bins
        out = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))

    return (
        pieces.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(groups)))
        .groupBy("bucket")
        .applyInArrow(place, f"{PIECES}, sequence_id long, offset long")
    )
