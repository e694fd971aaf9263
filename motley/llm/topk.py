"""Exact top-k by inner product over whole-number vectors, with block-at-a-time pruning.

Each component of a vector is a pair of terms (its positive and its negative part), so documents are non-negative
term vectors. Documents are cut into ranges (blocks) of like vectors with a forward index: the block's vectors as one
matrix, and the greatest weight of each of its terms. Per query, blocks are ordered by the sum of the query's weights times
the block's maxima; they are scored in that order until the next bound is below the k-th score.

A first round scores every query against a bounded sample of the vectors: its k-th score there is one that the answer reaches, and
goes with the query. Vectors stand in shards of a fixed size; queries are sent to the shards and pass through them in a stream. A
vector is sent once for every QUERY_GROUP queries. Each query's best of all shards are merged by rank.

How much is pruned depends on the vectors: of clusters most blocks are left out; of vectors spread evenly over all directions of 64
dimensions none can be, as every block's maxima reach far beyond any score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motley.llm.common import least_hashed, partitions, released, stored

SHARD = 16384
QUERY_GROUP = 1 << 17
BLOCK = 128
#: Vectors of the first round, and steps by which the vectors of a shard are put with their like.
SAMPLE, STEPS = 2048, 3
#: Products of larger numbers could lose a unit in 64-bit floats; whole-number arithmetic is used there.
EXACT_FLOAT = float(1 << 52)


def whole_numbers(vectors: DataFrame, column: str, scale: float) -> DataFrame:
    """id, v (array of long: floor(scale * component)) of the vectors that are not null and have no null, NaN or infinite component."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.col(column).isNotNull() & F.coalesce(sound, F.lit(False)))
    return kept.select("id", F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; a shorter one is filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(bounds[0], bounds[-1]) - np.repeat(bounds[:-1], sizes)] = flat[bounds[0] : bounds[-1]]
    return out


def blocks_of(vectors: np.ndarray, ids: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of blocks of at most `size`: vectors that are nearest to the same centre, which moves to their mean."""
    if not len(ids):
        return []
    x = vectors.astype(np.float32)
    start = np.lexsort((ids, *x.T[:: max(1, x.shape[1] // 8)]))
    centres = x[start[np.linspace(0, len(ids) - 1, -(-len(ids) // size)).astype(int)]]
    for _ in range(STEPS):
        far = (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)
        own = far.argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)
    order = np.lexsort((ids, own))
    edges = np.flatnonzero(np.diff(own[order])) + 1
    out = []
    for part in np.split(order, edges):
        out += [(ids[p], vectors[p]) for p in np.array_split(part, -(-len(part) // size))]
    return out


class Shard:
    """The forward index of some vectors, and the block maxima of their terms."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, block: int = BLOCK):
        self.size, self.largest, self.width = len(ids), float(np.abs(vectors).max(initial=0)), max(1, vectors.shape[1])
        self.cut = blocks_of(vectors, ids, block)
        self.scored = self.blocks = 0  # of all searches

    def _kind(self, queries: np.ndarray) -> type:
        largest = float(np.abs(queries).max(initial=0)) * self.largest * self.width
        return np.float64 if largest < EXACT_FLOAT else np.int64 if largest < 2.0**62 else object

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(query id, vector id, score) of each query's k best, its own id left out; ties to the smaller id. With `least`, a score that k
        others are known to reach (null: none), those below it are left out."""
        if not self.size:
            return []
        kind = self._kind(queries)
        queries, cut = queries.astype(kind), [(i, v.astype(kind)) for i, v in self.cut]
        # the greatest weight of each block's positive and negative terms
        most, low = (np.stack([f(v, axis=0) for _, v in cut]) for f in (np.max, np.min))
        bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ low.T
        out = []
        for n, (q, own, bound) in enumerate(zip(queries, query_ids, bounds, strict=True)):
            floor = None if least is None or least[n] is None else least[n]
            found_ids, found = np.zeros(0, np.int64), np.zeros(0, kind)
            order = np.argsort(-bound, kind="stable")
            at, step = 0, 1
            while at < len(order):
                if len(found) == k:
                    floor = found[-1] if floor is None else max(floor, found[-1])
                if floor is not None:
                    ahead = order[at:]
                    if bound[ahead[0]] < floor:
                        break
                    step = max(1, int((bound[ahead[:16]] >= floor).sum()))
                chosen = order[at : at + step]
                at += step
                near = np.concatenate([cut[b][0] for b in chosen])
                scores = np.concatenate([cut[b][1] @ q for b in chosen])
                kept = near != own
                if floor is not None:
                    kept &= scores >= floor
                near, scores = np.concatenate((found_ids, near[kept])), np.concatenate((found, scores[kept]))
                best = np.lexsort((near, -scores))[:k]
                found_ids, found = near[best], scores[best]
            self.scored, self.blocks = self.scored + at, self.blocks + len(order)
            out += [(int(own), int(i), int(s)) for i, s in zip(found_ids, found, strict=True)]
        return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, query_group: int = QUERY_GROUP, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    `vectors` and `queries` have id and v (array of long). A vector with the query's id is no candidate; a query id
    that occurs more than once is asked once, with its greatest vector; of vectors with one id each is a candidate. Rows
    without id are left out. Vectors of unequal length, also empty ones, are filled up with zeros. Scores beyond 64 bits fail.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors.where("id is not null"), "vectors")
    queries = queries.where("id is not null").groupBy("id").agg(F.max("v").alias("v"))
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    some = least_hashed(vectors, sample, "id", "v").collect()  # `sample` vectors at most
    width = max(1, width)
    ids = np.array([r["id"] for r in some], np.int64)
    first = matrix(pa.array([r["v"] for r in some], pa.list_(pa.int64())), width)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shard(first, ids)
        for batch in batches:
            wide = max([width, *(np.diff(batch.column("v").offsets.to_numpy()).tolist())])
            found: dict[int, list[int]] = {}
            for q, _, s in known.search(matrix(batch.column("v"), wide)[:, :width], batch.column("id").to_numpy(), k):
                found.setdefault(q, []).append(s)
            least = [min(x) if len(x := found.get(q, [])) == k else None for q in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(least, pa.int64())], ["id", "v", "least"])

    queries = stored(queries.mapInArrow(begin, "id long, v array<long>, least long"), "queries")
    asked = queries.count()
    shards, parts = max(1, -(-n // shard)), max(1, -(-asked // query_group))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), each(parts).alias("part"), F.lit(0).alias("asks"), "id", "v", F.lit(None).cast("long").alias("least"))
    sent = queries.select(each(shards).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("asks"), "id", "v", "least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, index = None, [], None
        for batch in batches:
            shard_of, part_of, asks = (batch.column(c).to_numpy() for c in ("shard", "part", "asks"))
            edges = np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(part_of) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in pairwise([0, *edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if (int(shard_of[a]), int(part_of[a])) != place:
                    place, held, index = (int(shard_of[a]), int(part_of[a])), [], None
                rows = batch.slice(a, b - a)
                if not asks[a]:
                    held.append((matrix(rows.column("v"), width), rows.column("id").to_numpy()))
                    continue
                if index is None:
                    index = Shard(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else Shard(np.zeros((0, width), np.int64), np.zeros(0, np.int64))
                    held = []
                wide = max([width, *(np.diff(rows.column("v").offsets.to_numpy()).tolist())])
                found = index.search(matrix(rows.column("v"), wide)[:, :width], rows.column("id").to_numpy(), k, rows.column("least").to_pylist())
                q, i, s = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    dealt = own.unionByName(sent).repartition(max(partitions(spark), shards * parts), "shard", "part").sortWithinPartitions("shard", "part", "asks")
    found = dealt.mapInArrow(released(search), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """top_k of the rows of `embeddings` (vec_id, embedding) whose vec_id is divisible by `every`, against all rows."""
    vectors = whole_numbers(embeddings.select(F.col("vec_id").cast("long").alias("id"), "embedding"), "embedding", scale)
    return top_k(vectors, vectors.where(F.col("id") % every == 0), k)
