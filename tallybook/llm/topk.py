"""Exact top-k by inner product with the threshold algorithm over sorted lists, one per dimension.

Candidates are dealt out to blocks of about BLOCK_ROWS by a hash of their id, so copies do not meet; a block is packed into one row. In
a block every dimension has a list sorted by value; a query reads the lists from the top where its own component is positive and
from the bottom where it is negative, in growing steps. What a step shows for the first time is scored in full. After each step
the bound is the score of a vector that had the last read value in every dimension; once the bound is below the k-th best score,
nothing unread can enter, and the query stops. Ties go to the smaller id, so the bound must be smaller, not equal.

Queries are packed by QUERY_ROWS; each pack meets each block once (a stated query set against all rows, in blocks). Before, each
query has run on the block that is its own, which gives its first k-th best score; the other blocks stop earlier for it. The
queries of a pack read the lists together: what a step shows to one of them is scored for all that have not stopped.

Packs and blocks meet in cells, a group of packs by a slice of the blocks. A cell is one partition, its packs sorted before its
blocks, and neither is joined: a pack is sent once per slice and a block once per group, to executors only, and nothing that
holds vectors is broadcast or passes the driver. A group holds at most GROUP_BYTES of queries, a cell about CELL_PAIRS pairs.

Vectors that are null or hold a null or non-finite component take no part, as query or candidate, nor do rows without id or of
another length than the most common one. Repeated rows of one id are candidates each; a query's own id is none of its
candidates. Components are floor(256 * x).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import keep, partitions

SCALE = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 256
FIRST_STEP = 16
GROUP_BYTES = 1 << 26
CELL_PAIRS = 1 << 33
NO_FLOOR = -(2**63)
PACKED = "bucket long, ids binary, vectors binary"
HITS = "query_id long, vec_id long, score long"


def whole_numbers(bound: float, size: int) -> type:
    """The fastest type in which inner products of vectors up to ``bound`` stay whole."""
    most = bound * bound * size
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them and their negatives."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    return values.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.int64))


def ranked(asker: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(asker, ids, scores, whether it is the k-th) of the k best hits per asker, ties to smaller ids."""
    order = np.lexsort((ids, -scores, asker))
    asker, ids, scores = asker[order], ids[order], scores[order]
    place = np.arange(len(asker)) - np.searchsorted(asker, asker, "left")
    good = place < k
    return asker[good], ids[good], scores[good], place[good] == k - 1


class SortedLists:
    """A block's lists: per dimension the rows by falling value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.ascontiguousarray(np.argsort(-self.vectors, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.bound = float(np.abs(self.vectors).max(initial=0))
        self.tables: dict[type, np.ndarray] = {}

    def table(self, kind: type) -> np.ndarray:
        if kind not in self.tables:
            self.tables[kind] = self.vectors.astype(kind)
        return self.tables[kind]

    def top(self, query_id: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, list entries read) of the k best of this block that are not below ``floor``, ties to smaller ids."""
        _, ids, scores, read = self.best(np.array([query_id]), query[None], k, np.array([NO_FLOOR if floor is None else floor]))
        return ids, scores, read

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(place of the query, ids, scores, list entries read) of each query's k best of this block that are not below its floor."""
        n, size = self.vectors.shape
        kind = whole_numbers(max(self.bound, float(np.abs(queries).max(initial=0))), size)
        table, own, queries = self.table(kind), queries.astype(kind), queries.astype(np.int64)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        mine = np.stack([np.searchsorted(self.ids, query_ids, side) for side in ("left", "right")])
        least, active = floors.astype(np.int64), np.arange(len(queries))
        asker, rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(n, bool)
        depth = read = 0
        while depth < n and len(active) and not seen.all():
            top, bottom = (np.flatnonzero(side[active].any(axis=0)) for side in (up, down))
            stop = min(n, max(FIRST_STEP, 4 * depth)) if len(top) + len(bottom) else n
            fresh = np.zeros(n, bool)
            fresh[self.order[top, depth:stop]] = True  # from the top
            fresh[self.order[bottom, n - stop : n - depth]] = True  # from the bottom
            if stop == n:
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            scored = own[active] @ table[new].T
            good = scored >= least[active].astype(kind)[:, None]
            begins, ends = np.searchsorted(new, mine[:, active])
            for place in np.flatnonzero(begins < ends):
                good[place, begins[place] : ends[place]] = False
            for place in np.flatnonzero(good.sum(axis=1) > 4 * k):  # rows are in the order of ids: of ties the first stay
                columns = np.flatnonzero(good[place])
                line = scored[place, columns]
                least_kept = np.partition(line, len(line) - k)[len(line) - k]
                above = columns[line > least_kept]
                good[place] = False
                good[place, above] = True
                good[place, columns[line == least_kept][: k - len(above)]] = True
            place, column = np.nonzero(good)
            hits = zip((asker, rows, scores), (active[place], new[column], scored[place, column].astype(np.int64)))
            asker, rows, scores, last = ranked(*map(np.concatenate, hits), k)
            least[asker[last]] = np.maximum(least[asker[last]], scores[last])
            read += (stop - depth) * (len(top) + len(bottom))
            depth = stop
            bound = up[active] @ self.sorted[:, stop - 1].astype(np.int64) + down[active] @ self.sorted[:, n - stop].astype(np.int64)
            active = active[bound >= least[active]]
        return asker, self.ids[rows], scores, read


class Pack:
    """Queries with the k best hits of the blocks that they have met; the k-th best so far is the floor in the next block."""

    def __init__(self, home: int, ids: np.ndarray, vectors: np.ndarray, floors: bytes | None):
        self.home, self.ids, self.vectors = home, ids, vectors
        self.floors = np.full(len(ids), NO_FLOOR) if floors is None else np.frombuffer(floors, np.int64).copy()
        self.found: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def meet(self, block: SortedLists, k: int) -> None:
        *hits, _ = block.best(self.ids, self.vectors, k, self.floors)
        *self.found, last = ranked(*map(np.concatenate, zip(self.found, hits)), k)
        asker, _, scores = self.found
        self.floors[asker[last]] = np.maximum(self.floors[asker[last]], scores[last])

    def hits(self) -> tuple[np.ndarray, ...]:
        asker, ids, scores = self.found
        return self.ids[asker], ids, scores


def packed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows (id, vector) as one row per bucket: (bucket, ids, vectors)."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        vectors = narrow(np.stack(group["vector"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"bucket": [group["bucket"].iat[0]], "ids": [group["id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})

    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).groupBy("bucket").applyInPandas(pack, PACKED)


def unpacked(ids: bytes, vectors: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, f"i{len(vectors) // (n * size)}").reshape(n, size)


def search(k: int, size: int, at_home: bool):
    """Hits of the packs of each cell in its blocks: in those where they are at home, or in all others."""

    def hits(packs: list[Pack]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*(pack.hits() for pack in packs))))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, packs = None, []
        for batch in batches:
            for row in batch.itertuples():
                if row.cell != cell:
                    if packs:
                        yield hits(packs)
                    cell, packs = row.cell, []
                if not row.is_block:
                    packs.append(Pack(row.home, *unpacked(row.ids, row.vectors, size), row.floors))
                elif asking := [pack for pack in packs if (pack.home == row.home) == at_home]:
                    block = SortedLists(*unpacked(row.ids, row.vectors, size))
                    for pack in asking:
                        pack.meet(block, k)
        if packs:
            yield hits(packs)

    return run


def met(packs: DataFrame, blocks: DataFrame, cells: int) -> DataFrame:
    """Packs and blocks, each with its cell, as one partition per cell in which the packs come first."""
    columns = ["cell", "is_block", "home", "ids", "vectors", "floors"]
    both = packs.withColumn("is_block", F.lit(False)).select(columns)
    both = both.union(blocks.withColumns({"is_block": F.lit(True), "home": F.col("bucket"), "floors": F.lit(None).cast("binary")}).select(columns))
    return both.repartitionById(cells, F.col("cell").cast("int")).sortWithinPartitions("cell", "is_block")


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits per query, as an array of (score, vec_id): every task keeps k."""
    order = F.struct((-F.col("score")).alias("minus"), F.col("vec_id"))
    kept = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return kept


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query."""

    def usable(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        fine = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
        return df.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(SCALE * v.cast("double"))).alias("vector"))

    candidates = usable(vectors)
    sizes = candidates.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes or sizes[0]["size"] == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size, n = sizes[0]["size"], sizes[0]["count"]
    wanted = usable(queries).where(F.size("vector") == size).dropDuplicates(["id"])
    count, n_wanted = math.ceil(n / block_rows), wanted.count()
    n_packs = max(1, math.ceil(n_wanted / query_rows))
    blocks = keep(packed(candidates.where(F.size("vector") == size), count), "blocks")
    asked = keep(packed(wanted, n_packs).withColumnRenamed("bucket", "pack").withColumn("home", F.pmod(F.col("pack"), F.lit(count))), "queries")
    first = asked.withColumns({"cell": F.col("home"), "floors": F.lit(None).cast("binary")})
    homes = blocks.where(F.col("bucket") < n_packs).withColumn("cell", F.col("bucket"))
    hits = keep(met(first, homes, min(count, n_packs)).mapInPandas(search(k, size, True), HITS), "hits")
    if count > 1:
        floors = best(hits, k).select("query_id", F.when(F.size("best") == k, -F.element_at("best", k)["minus"]).otherwise(NO_FLOOR).alias("floor"))

        def attach(asked_pack: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            floor = dict(zip(known["query_id"].tolist(), known["floor"].tolist()))
            ids = np.frombuffer(asked_pack["ids"].iat[0], np.int64)
            values = [floor.get(i, NO_FLOOR) for i in ids.tolist()]
            return asked_pack.assign(floors=[np.array(values, np.int64).tobytes()])

        ready = asked.groupBy("pack").cogroup(floors.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(n_packs))).groupBy("pack")).applyInPandas(
            lambda a, b: attach(a, b) if len(a) else a.assign(floors=None), "pack long, ids binary, vectors binary, home long, floors binary"
        )
        ready = keep(ready, "queries")
        groups = max(1, math.ceil(8 * size * n_wanted / GROUP_BYTES))
        slices = min(count, math.ceil(max(partitions(vectors.sparkSession), n * n_wanted / CELL_PAIRS) / groups))
        each = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
        packs = ready.withColumn("slice", each(slices)).withColumn("cell", F.pmod(F.col("pack"), F.lit(groups)) * slices + F.col("slice"))
        others = blocks.withColumn("group", each(groups)).withColumn("cell", F.col("group") * slices + F.pmod(F.col("bucket"), F.lit(slices)))
        hits = hits.union(met(packs, others, groups * slices).mapInPandas(search(k, size, False), HITS))
    ranks = best(hits, k).select("query_id", F.posexplode("best").alias("place", "hit"))
    return ranks.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
