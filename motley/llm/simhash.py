"""Near-duplicates by SimHash, pairs discarded by pivot distance tables.

Fingerprints that agree in a key of a few bits meet in a bucket. There, the Hamming distances of each
member to many reference fingerprints stand in a table: by the triangle inequality a pair within distance
d differs by at most d in every column, so pairs are discarded by their largest column difference and only
the survivors are compared. A bucket gives links of a spanning forest, never all its pairs.

Buckets over a bound are cut into chunks, so no task holds more than two. Each chunk is linked within, and with some
members that all chunks of the bucket share. Mostly that joins what belongs together; then, of each bucket, the
members outside of its largest component are compared with all others, chunk by chunk. No pair of members that are not
joined yet is left out, and copies of one text cost a multiple of their number, not its square.

For similar documents the buckets are bands of least hashes and the bound on the bits is loose: both only discard. What
is left is compared by the shingle sets themselves, in the groups that might be linked, cut into chunks in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm.common import MIX_A, MIX_B, STEP, mixed, released, spread, stored, streamed, text_slices, texts_of
from motley.llm.components import components

SEED = 42
PIVOTS = 16
#: Members of a bucket compared in one go.
CHUNK = 1024
#: About so many members of a bucket meet all its chunks.
SHARED = 8
#: Rows whose pairs are looked at together.
SLAB = 256
#: Shingles of a chunk of sets compared in one go.
SET_CHUNK = 1 << 19
#: Standard deviations by which differing bits may exceed what is expected before a pair is discarded.
MARGIN = 6


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, lower-cased in A-Z and joined by spaces; of all words if fewer."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in found])
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, distinct: bool = False, key: str = "doc_id") -> DataFrame:
    """key, lanes (array of 64-bit fingerprints, as signed longs) of every row of `docs`.

    Lane 0 is of the shingles' own hashes, later lanes of hashes mixed from them. A text without words has zeros.
    With `distinct`, a shingle counts once.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for text in texts_of(part.column("text")):
                    h = shingle_hashes(text, words)
                    h = np.unique(h) if distinct else h
                    with np.errstate(over="ignore"):
                        rows.append([majority(h if not i else mixed(h + np.uint64(i) * np.uint64(STEP))) for i in range(lanes)])
                values = np.array(rows, np.uint64).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, lanes, dtype=np.int32)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], [key, "lanes"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(released(prints), f"`{key}` {kind}, lanes array<long>")


def pivot_table(prints: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of fingerprints (n x lanes) to reference fingerprints, by a rule."""
    lanes = prints.shape[1]
    refs = mixed(np.arange(1, pivots * lanes + 1, dtype=np.uint64) * np.uint64(STEP)).reshape(pivots, lanes)
    return np.stack([np.bitwise_count(prints ^ r).sum(axis=1, dtype=np.int16) for r in refs], axis=1)


def near_slabs(prints: np.ndarray, table: np.ndarray, most: int, sides: np.ndarray | None, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within distance `most`, a slab of rows at a time; with sides, of members of different sides only. Pairs that `root` (which
    may change between slabs) has joined are passed over."""
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    upto = np.searchsorted(first, first + most, side="right")
    for begin in range(0, len(order), SLAB):
        rows = np.arange(begin, min(begin + SLAB, len(order)))
        counts = upto[rows] - rows - 1
        i = np.repeat(rows, counts)
        j = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
        i, j = order[i], order[j]
        kept = root[i] != root[j]
        if sides is not None:
            kept &= sides[i] != sides[j]
        i, j = i[kept], j[kept]
        for p in range(1, table.shape[1]):
            if not len(i):
                break
            kept = np.abs(table[i, p] - table[j, p]) <= most
            i, j = i[kept], j[kept]
        kept = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= most
        yield i[kept], j[kept]


def close_links(prints: np.ndarray, table: np.ndarray, most: int, sides: np.ndarray | None = None) -> np.ndarray:
    """The least member that each member is joined to by pairs within distance `most`."""
    root = np.arange(len(prints))
    for i, j in near_slabs(prints, table, most, sides, root):
        if len(i):
            root[:] = forest(len(prints), np.concatenate((np.arange(len(prints)), i)), np.concatenate((root, j)))
    return root


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member that each of n members is linked to."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        now = root.copy()
        np.minimum.at(now, root[i], least)
        np.minimum.at(now, root[j], least)
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        while (now != now[now]).any():
            now = now[now]
        if (now == root).all():
            break
        root = now
    return root


def group_links(held: DataFrame, load: Callable[[DataFrame], DataFrame], work: Callable, chunk: int, set_chunk: int | None = None) -> DataFrame:
    """a, b: links that join all members of a group that `work` would join if it saw the whole group.

    `held`: key, id, size and what `load` needs; `load` adds what `work` compares to rows of key, x, y, id, chunk. `work` gets whole
    groups of key, x, y (see `streamed`); of different x and y it compares members of different chunks only.
    """
    sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("_total")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk) if set_chunk is None else F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("_total") / set_chunk))
    sizes = stored(sizes.select("key", "n", F.col("n").alias("members"), chunks.cast("int").alias("chunks")), "sizes")
    dealt = spread(held, sizes, "key", "id")
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    shared = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("id", F.lit(7)), F.col("members")) < SHARED)
    at = F.explode(F.when(shared, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own)))
    met = lambda df: streamed(load(df), ["key", "x", "y"], work, "a long, b long")
    links = met(dealt.withColumn("x", at).withColumn("y", F.col("x")).withColumn("chunk", F.lit(0)))
    if not sizes.where("chunks > 1").limit(1).count():
        return links
    links = stored(links, "links")
    big = dealt.where("chunks > 1").join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    per = big.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), F.max("members").alias("n"), F.max("chunks").alias("_c"))
    top = per.groupBy("key").agg(F.max("n").alias("n"), F.max("_c").alias("_c"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("top")).where("roots > 1")
    part = lambda k: F.ceil(F.col("_c") * k / F.col("n")).cast("int")  # noqa: E731  chunks of k of the n members
    top = stored(top.select("key", "n", F.col("top.root").alias("most"), part(F.col("n") - F.col("top.k")).alias("few"), part(F.col("top.k")).alias("many")), "divided")
    rest = spread(big, top, "key", "id").withColumn("outside", F.col("root") != F.col("most"))
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("id"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1))
    rest = rest.withColumn("chunk", own).withColumn("other", other).withColumn("x", F.least("chunk", "other")).withColumn("y", F.greatest("chunk", "other"))
    return links.unionByName(met(rest))


def bucket_links(prints: DataFrame, keys: Column, most: int, chunk: int = CHUNK) -> DataFrame:
    """a, b (long ids): links that join all `prints` (id, lanes; ids distinct) within distance `most` that share one of `keys`."""

    def link(rows: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        lanes = rows.column("lanes")
        values = lanes.values.to_numpy()[lanes.offsets[0].as_py() : lanes.offsets[-1].as_py()].view(np.uint64).reshape(rows.num_rows, -1)
        ids, chunks, x, y = (rows.column(c).to_numpy() for c in ("id", "chunk", "x", "y"))
        table, a, b = pivot_table(values), [], []
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]  # most buckets
        if len(two):
            two = two[((x == y)[two] | (chunks[two] != chunks[two + 1])) & (np.abs(table[two] - table[two + 1]).max(axis=1) <= most)]
            two = two[np.bitwise_count(values[two] ^ values[two + 1]).sum(axis=1) <= most]
            a.append(ids[two])
            b.append(ids[two + 1])
        for g in np.flatnonzero(sizes > 2):
            s = slice(bounds[g], bounds[g + 1])
            root = close_links(values[s], table[s], most, chunks[s] if x[bounds[g]] != y[bounds[g]] else None)
            moved = np.flatnonzero(root != np.arange(sizes[g]))
            a.append(ids[s][moved])
            b.append(ids[s][root[moved]])
        yield pa.RecordBatch.from_pydict({"a": np.concatenate([np.zeros(0, np.int64), *a]), "b": np.concatenate([np.zeros(0, np.int64), *b])})

    held = prints.select("id", "lanes", F.lit(1).alias("size"), F.explode(keys).alias("key"))
    return group_links(held, lambda df: df.select("key", "x", "y", "id", "lanes", "chunk"), link, chunk)


def agreeing_keys(most: int, parts: int = 4) -> Column:
    """Keys of 64-bit fingerprints within `most` bits of each other: of `parts` equal parts, all but `most` agree."""
    width = 64 // parts
    cut = [F.shiftrightunsigned(F.col("lanes")[0], width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(parts)]
    keys = []
    for k, chosen in enumerate(combinations(range(parts), parts - most)):
        keys.append(F.xxhash64(F.lit(k), *[cut[i] for i in chosen]) if len(chosen) * width > 56 else sum((F.shiftleft(cut[i], width * at) for at, i in enumerate(chosen)), F.lit(k).cast("long") * F.lit(1 << (len(chosen) * width))))
    return F.array(*keys)


def named(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with root, and of each root: component_id, the least `least` among the nodes that links join, and n, their number)."""
    linked = nodes.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return linked, linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))


def grouped(linked: DataFrame, names: DataFrame) -> DataFrame:
    """id, n, component_id of nodes, from `named`."""
    return spread(linked.select("id", "root", F.col("n").alias("rows")), stored(names, "names"), "root", "id").select("id", F.col("rows").alias("n"), "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row: links at `most` or fewer differing bits.

    A null text is empty; texts without words have fingerprint zero and link like any other. Repeated rows stay.
    A null doc_id takes part, but does not name a component unless all its doc_ids are null (then null).
    """
    prints = stored(fingerprints(docs, words).withColumn("id", F.col("lanes")[0]), "prints")
    nodes = stored(prints.groupBy("id").agg(F.first("lanes").alias("lanes"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    found = grouped(*named(nodes, bucket_links(nodes.select("id", "lanes"), agreeing_keys(most), most)))
    found = spread(prints, stored(found, "components"), "id", "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("lanes")[0]), 16, "0")).alias("fingerprint"), "component_id")


def most_bits(similarity: float, lanes: int, margin: float = MARGIN) -> int:
    """Differing bits that two shingle sets with that Jaccard similarity hardly exceed: those to expect of sets of equal
    size (of unequal ones they are fewer) and `margin` standard deviations."""
    n, p = 64 * lanes, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(n * p + margin * np.sqrt(n * p * (1 - p)))


def set_hash(shingles: np.ndarray) -> int:
    """A set's id: XXH64 of its ascending shingle hashes, as a signed long."""
    x = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def least_hashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of a set under each of n orders; of two sets, one is equal with the probability of their similarity."""
    factors, least = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP)) | np.uint64(1), np.full(n, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1 << 12):
            least = np.minimum(least, (shingles[i : i + (1 << 12), None] * factors).min(axis=0))
    return least


def set_prints(docs: DataFrame, words: int, lanes: int, bands: int, rows: int, key: str) -> DataFrame:
    """key, id (of the set of shingles), size, lanes, keys (one a band of `rows` least hashes; none of a text without words) of every row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [np.unique(shingle_hashes(x, words)) for x in texts_of(part.column("text"))]
                with np.errstate(over="ignore"):
                    values = [[majority(h if not i else mixed(h + np.uint64(i) * np.uint64(STEP))) for i in range(lanes)] for h in sets]
                    least = np.array([least_hashes(h, bands * rows) for h in sets]).reshape(len(sets), bands, rows)
                    band = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(STEP), (len(sets), 1))
                    for r in range(rows):
                        band = mixed(band ^ least[:, :, r])
                keys = [x if len(h) else x[:0] for x, h in zip(band.astype(np.int64), sets, strict=True)]
                columns = [
                    part.column(key),
                    pa.array([set_hash(h) for h in sets], pa.int64()),
                    pa.array([len(h) for h in sets], pa.int32()),
                    pa.array(list(np.array(values, np.uint64).astype(np.int64)), pa.list_(pa.int64())),
                    pa.array(keys, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "id", "size", "lanes", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(released(prints), f"`{key}` {kind}, id long, size int, lanes array<long>, keys array<long>")


def similar_links(prints: np.ndarray, sets: list[bytes], most: int, similarity: float, sides: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links that join all members whose sets are alike by exact Jaccard similarity. Pairs that links already join are not compared."""
    root, a, b = np.arange(len(sets)), [], []
    size = np.array([len(x) for x in sets])
    held: dict[int, set] = {}
    for i, j in near_slabs(prints, pivot_table(prints), most, sides, root):
        sound = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
        i, j = i[sound], j[sound]
        order = np.argsort(np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1), kind="stable")
        i, j = i[order], j[order]
        while len(i):
            found = len(a)
            for x, y in zip(i[:CHUNK].tolist(), j[:CHUNK].tolist(), strict=True):
                for m in (x, y):
                    if m not in held:
                        held[m] = set(np.frombuffer(sets[m], np.uint64).tolist())
                both = len(held[x] & held[y])
                if both >= similarity * (len(held[x]) + len(held[y]) - both) - 1e-9:
                    a.append(x)
                    b.append(y)
            i, j = i[CHUNK:], j[CHUNK:]
            if len(a) > found:
                root[:] = forest(len(sets), np.concatenate((np.arange(len(sets)), a[found:])), np.concatenate((root, b[found:])))
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
    return a, b


def verified_links(docs: DataFrame, nodes: DataFrame, links: DataFrame, words: int, most: int, similarity: float, key: str, chunk: int = CHUNK) -> DataFrame:
    """a, b: links that join all `nodes` (id, size, lanes, least: a row's key) that `links` join and whose shingle sets, made again
    from the texts, have that Jaccard similarity or more."""
    loose = components(links)
    members = loose.select(F.col("node").alias("id"), "root").unionByName(loose.select(F.col("root").alias("id"), "root").distinct())
    held = stored(members.withColumnRenamed("root", "key").join(nodes.select("id", "size", "lanes", "least"), "id"), "members")

    def load(df: DataFrame) -> DataFrame:
        """The rows with their shingles: texts meet the members by key, each once; members that stand for several rows do so by `at`."""
        each = df.groupBy("id", "least").agg(F.collect_list(F.struct("key", "x", "y", "chunk", "lanes")).alias("at"))
        texts = docs.select(F.col(key).alias("_key"), "text").join(each, F.col("_key").eqNullSafe(F.col("least")))
        made = texts.select("id", "at", "text").mapInArrow(released(shingled), "id long, at array<struct<key:long,x:int,y:int,chunk:int,lanes:array<long>>>, shingles binary")
        return made.select("id", "shingles", F.inline("at"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [np.unique(shingle_hashes(x, words)) for x in texts_of(part.column("text"))]
                same = pa.array([set_hash(h) == x for h, x in zip(sets, part.column("id").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("at"), pa.array([h.tobytes() for h in sets], pa.binary())], ["id", "at", "shingles"]).filter(same)

    def link(rows: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            group = rows.slice(at, end - at)
            ids, lanes = group.column("id").to_pylist(), np.array(group.column("lanes").to_pylist(), np.int64).view(np.uint64)
            sides = group.column("chunk").to_numpy() if x[at] != y[at] else None
            i, j = similar_links(lanes, group.column("shingles").to_pylist(), most, similarity, sides)
            a += [ids[k] for k in i]
            b += [ids[k] for k in j]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return group_links(held, load, link, chunk, SET_CHUNK)


def similar_nodes(docs: DataFrame, words: int, similarity: float, lanes: int, bands: int, rows: int, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key and id of every row's shingle set; the sets with their roots; of each root its component_id and n)."""
    most = most_bits(similarity, lanes)
    prints = stored(set_prints(docs, words, lanes, bands, rows, key), "prints")
    nodes = stored(prints.groupBy("id").agg(*[F.first(c).alias(c) for c in ("size", "lanes", "keys")], F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    links = bucket_links(nodes.select("id", "lanes", "keys"), F.col("keys"), most)
    return prints.select(key, "id"), *named(nodes, verified_links(docs, nodes, links, words, most, similarity, key))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 8, bands: int = 20, rows: int = 5, key: str = "doc_id") -> DataFrame:
    """key, component_id: documents linked by a Jaccard similarity of `similarity` or more of their sets of `words`-word shingles.

    The similarity is exact. Pairs meet if one of the bands of `rows` least hashes agrees: of pairs of similarity
    0.8 all but 4 in ten thousand by the defaults, and fewer miss above. Texts without words are alike.
    """
    prints, linked, names = similar_nodes(docs, words, similarity, lanes, bands, rows, key)
    return spread(prints, stored(grouped(linked, names), "components"), "id", key).select(key, "component_id")


def kept_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 8, bands: int = 20, rows: int = 5, key: str = "doc_id") -> DataFrame:
    """key: of each component of `similar_documents` the least one. `key` is distinct and never null."""
    return similar_nodes(docs, words, similarity, lanes, bands, rows, key)[2].select(F.col("component_id").alias(key))
