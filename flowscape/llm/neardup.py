"""Near duplicates by DartMinHash signatures, banded joins and exact verification.

A text is the multiset of its five-word shingles (white-space words, ASCII case folded; a
text of fewer words is one shingle); similarity is the weighted Jaccard of shingle counts
and texts of 0.8 or more are linked.  Classes are the connected components of the links.

Signatures follow DartMinHash: darts fall at unit rate on each element's region, which
is as wide as its weight; a dart carries a rank and a coordinate, and each coordinate keeps
the dart of lowest rank.  Darts are made by hashing (element, unit of weight, rank cell), so
equal elements get equal darts in all texts, and only ranks that a text of its weight needs
are looked at.  Two texts agree in a coordinate with probability equal to their weighted
Jaccard similarity.

Equal texts are one node, numbered by a 64-bit digest of the text (among ten billion distinct texts
about three pairs would share a number).  Nodes meet in ``BANDS`` bands of ``ROWS`` coordinates.

1. Each node is verified with the least node of its buckets that agrees best.  So the bulk of a large group
   of near copies hangs together after one comparison a node.
2. In a bucket that still holds several components, every pair of two components whose signatures
   may be similar is verified on the full shingle sets, inside the task that holds the bucket; the
   task merges components as it goes and puts out the links that merged them, fewer than the
   bucket has nodes.  A pair is left to the first bucket it shares.  After this one pass each pair that shares a bucket is either
   connected or known to be under 0.8: there is no cap, and no node stands for another.
3. A bucket of over ``LARGE`` nodes or ``BYTES`` of text is dealt in blocks and each two blocks that
   may hold two components are a task's group of their own, so no task gets an unbounded group.

Null and empty texts are equal to each other and form one class; repeated rows get the same
class; an id that appears with different texts gets a row and a class for each.  class_id and copy_of are the
least id of the class and of the equal texts that is not null; class_key tells classes apart where all ids
are null.  Texts of any length are read in pieces of 64 KB; a task holds the shingles (8 bytes a word) of two blocks.  Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, drop_saved, mix, save, word_hashes
from .graph import components

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: Agreements (of K) below which 0.8 is out of reach (under one in a million).
MAYBE = 44
#: Nodes and bytes of text of one group in a task.
LARGE, BYTES = 4096, 8 << 20
#: Candidate pairs of one leader that share a verification task.
SALT = 512

_MULT = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) and their counts."""
    words, _, _ = word_hashes(data)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = min(WORDS, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _MULT[i]
    return np.unique(mix(total + np.uint64(n)), return_counts=True)


#: Rank cells: [0, 1/8), then doubling up to 1, then unit cells.
_FINE = 3
_DARTS = mix(np.arange(1000, 1040, dtype=np.uint64))


def _cells(limit: float) -> tuple[np.ndarray, np.ndarray]:
    low = [0.0] + [2.0 ** (e - _FINE) for e in range(_FINE)]
    wide = [2.0**-_FINE] + [2.0 ** (e - _FINE) for e in range(_FINE)]
    unit = np.arange(1, max(1, int(np.ceil(limit))), dtype=float)
    low, wide = np.concatenate([low, unit]), np.concatenate([wide, np.ones(len(unit))])
    keep = low < limit
    return low[keep], wide[keep]


def signature(items: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """k dart ids of a weighted set (weights > 0, whole or not)."""
    whole = np.ceil(weights).astype(np.int64)
    unit = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    item = mix(np.repeat(items, whole) + unit.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    left = np.repeat(weights, whole) - unit
    total = float(weights.sum())
    limit = k * (np.log(k) + 4) / total
    while True:
        low, wide = _cells(limit)
        seeds = mix(np.arange(len(low), dtype=np.uint64) + np.uint64(77))
        cell = mix(item[:, None] ^ seeds[None, :])
        luck = (cell >> np.uint64(11)).astype(np.float64) * 2.0**-53
        found, term, below = [], np.exp(-wide), np.exp(-wide)
        row, column = np.nonzero(luck >= below[None, :])
        cell, luck = cell[row, column], luck[row, column]
        for j in range(1, 40):  # the j-th dart of a cell is there if luck exceeds P(fewer)
            if not len(row):
                break
            found.append((mix(cell + _DARTS[j]), row, low[column], wide[column]))
            term = term * wide / j
            below = below + term
            more = np.flatnonzero(luck >= below[column])
            row, column, cell, luck = row[more], column[more], cell[more], luck[more]
        dart = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
        if len(dart):
            where, start, width = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
            place = mix(dart + np.uint64(3))
            rank = start + width * ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32)
            depth = (place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
            ok = (rank < limit) & (depth < left[where])
            dart, rank = dart[ok], rank[ok]
            slot = (mix(dart + np.uint64(9)) % np.uint64(k)).astype(np.int64)
            order = np.lexsort((rank, slot))
            first = np.flatnonzero(np.diff(slot[order], prepend=-1))
            if len(first) == k:
                return dart[order][first]
        limit *= 2


_SIGNED = "doc_id long, row long, node long, short binary, bands array<long>, n_bytes long"


def _node(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def signatures(documents: DataFrame, key: str = "doc_id", text: str = "text", row=None) -> DataFrame:
    """doc_id, row (as given), number of the text, one byte a coordinate, band keys (null without words), bytes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = mix(np.arange(11, 11 + ROWS, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            nodes, shorts, bands, sizes = [], [], [], []
            for v in batch.column(2):
                data = v.as_buffer().to_pybytes()
                nodes.append(_node(data))
                sizes.append(len(data))
                items, counts = shingles(data)
                if len(items):
                    own = signature(items, counts.astype(float))
                    shorts.append((own & np.uint64(255)).astype(np.uint8).tobytes())
                    bands.append(mix((own.reshape(BANDS, ROWS) * fold).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                else:
                    shorts.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(shorts, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["doc_id", "row", "node", "short", "bands", "n_bytes"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), (F.lit(0).cast("long") if row is None else row).alias("row"), clean_text(text).alias("text")).mapInArrow(sign, _SIGNED)


def _agree(one: str, other: str):
    """Coordinates in which two short signatures agree."""
    parts = [F.when(F.substring(one, i + 1, 1) == F.substring(other, i + 1, 1), 1).otherwise(0) for i in range(K)]
    while len(parts) > 1:
        parts = [sum(parts[i + 1 : i + 4], parts[i]) for i in range(0, len(parts), 4)]
    return parts[0]


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """nodes(node, short, bands, n_bytes) -> (bucket, band, node, short, n_bytes, head) of the buckets
    with two nodes or more; head is the bucket's least node."""
    placed = nodes.where(F.col("bands").isNotNull()).select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = save(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("head")).where("size > 1").select("bucket", "head"), "near-buckets")
    rows = placed.join(shared, "bucket").join(nodes.select("node", "short", "n_bytes"), "node")
    rows = save(rows.select("bucket", "band", "node", "short", "n_bytes", "head"), "near-rows")
    drop_saved(shared)
    return rows


def first_pairs(rows: DataFrame) -> DataFrame:
    """Each node with the one of its buckets' least nodes that agrees best, if it may be similar."""
    tops = save(rows.where("node = head").select("bucket", F.col("short").alias("top")), "near-heads")
    seen = rows.where("node <> head").join(tops, "bucket").withColumn("same", _agree("short", "top")).where(F.col("same") >= MAYBE)
    return seen.groupBy(F.col("node").alias("a")).agg(F.min_by("head", F.struct(-F.col("same"), F.col("head"))).alias("b"))


WITHIN = 2


def _dealt(rows: DataFrame, most: int, size: int) -> DataFrame:
    """rows(bucket, band, node, short, n_bytes, label) -> the same with ``group`` and ``side`` in place of
    bucket: groups of about ``most`` nodes and ``size`` bytes at the most.

    Buckets with one label are left out.  The nodes of a large bucket's commonest label and the others
    are dealt in blocks; each two blocks are a group, but for two of the commonest label, which
    hold no pair.  Nodes of side 0 are compared with side 1 only, those of ``WITHIN`` with all."""
    load = F.lit(1.0 / most) + F.col("n_bytes") / F.lit(float(size))
    counts = save(rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(load).alias("load")), "near-counts")
    top = counts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.max_by("load", F.struct("n", "label")).alias("top_load"), F.sum("load").alias("load"), F.count(F.lit(1)).alias("kinds"))
    half = lambda x: F.greatest(F.lit(1), F.ceil(2 * F.col(x))).cast("int")
    top = top.where("kinds > 1").withColumn("rest_load", F.col("load") - F.col("top_load"))
    top = save(top.select("bucket", F.col("top.label").alias("top"), "load", half("top_load").alias("tops"), half("rest_load").alias("rests")), "near-tops")
    both = rows.join(top, "bucket")
    common, large = F.col("label") == F.col("top"), F.col("load") > 1
    both = both.withColumn("own", F.pmod(F.xxhash64("node"), F.when(common, F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    own, upto = F.col("own"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    across = F.transform(upto("tops"), lambda m: place(0, own, m, F.lit(1)))
    among = F.transform(upto("rests"), lambda r: place(1, F.least(own, r), F.greatest(own, r), F.when(r == own, WITHIN).when(own < r, 0).otherwise(1)))
    whole = F.array(place(2, F.lit(0), F.lit(0), F.lit(WITHIN)))
    places = F.when(~large, whole).when(common, F.transform(upto("rests"), lambda r: place(0, r, own, F.lit(0)))).otherwise(F.concat(across, among))
    spread = both.select("bucket", "band", "node", "short", "n_bytes", "label", F.explode(places).alias("p"))
    return spread.select(F.xxhash64("bucket", "p.kind", "p.i", "p.j").alias("group"), F.col("p.side").alias("side"), "bucket", "band", "node", "short", "label")


class _Group:
    """The nodes of one group, and which pairs of them are for this group to compare."""

    def __init__(self, rows: list):
        # rows: (side, band, node, short, label)
        self.sides = np.array([r[0] for r in rows])
        self.band = rows[0][1]
        self.nodes = [r[2] for r in rows]
        self.short = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), K)
        self.words = np.ascontiguousarray(self.short).view(np.uint32)  # a word a band
        self.labels = np.unique([r[4] for r in rows], return_inverse=True)[1]

    def others(self, i: int, root: np.ndarray) -> np.ndarray:
        """Earlier nodes of another component that may be similar to node i."""
        of = np.flatnonzero((root[self.labels[:i]] != root[self.labels[i]]) & ((self.sides[:i] != self.sides[i]) | (self.sides[i] == WITHIN)))
        if len(of):
            of = of[(self.short[of] == self.short[i]).sum(axis=1) >= MAYBE]
        if len(of) and self.band:
            # The first band in which all four coordinates agree is the pair's own.
            of = of[~(self.words[of, : self.band] == self.words[i, : self.band]).any(axis=1)]
        return of


def _by_group(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list]:
    """Rows (without the group) of each group; the input is sorted by group."""
    now, held = None, []
    for batch in batches:
        for group, *row in zip(*(batch.column(i).to_pylist() for i in range(width + 1)), strict=True):
            if group != now and held:
                yield held
                held = []
            now = group
            held.append(row)
    if held:
        yield held


def _maybe(rows: DataFrame) -> DataFrame:
    """Dealt rows -> distinct (bucket, node) that have a pair to verify there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_group(batches, 6):
            group = _Group(held)
            root, hit = np.arange(group.labels.max() + 1), np.zeros(len(held), bool)
            for i in range(1, len(held)):
                of = group.others(i, root)
                hit[of] = True
                hit[i] |= len(of) > 0
            found = np.flatnonzero(hit).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([held[i][5] for i in found], pa.int64()), pa.array([held[i][2] for i in found], pa.int64())], names=["bucket", "node"])

    dealt = rows.select("group", "side", "band", "node", "short", "label", "bucket").repartition("group").sortWithinPartitions("group", "node")
    return dealt.mapInArrow(work, "bucket long, node long").distinct()


def _similar(bags: tuple, i: int, of: np.ndarray) -> np.ndarray:
    """Exact similarity of bag i with the bags ``of``; bags are (ids, counts, offsets, sums, scratch)."""
    ids, counts, offset, weight, mark = bags
    own = slice(offset[i], offset[i + 1])
    mark[ids[own]] = counts[own]
    if 3 * len(of) > len(offset):
        shared = np.add.reduceat(np.minimum(mark[ids], counts), offset[:-1])[of]
    else:
        n = offset[of + 1] - offset[of]
        at = np.arange(n.sum()) + np.repeat(offset[of] - (np.cumsum(n) - n), n)
        shared = np.add.reduceat(np.minimum(mark[ids[at]], counts[at]), np.cumsum(n) - n)
    mark[ids[own]] = 0
    return shared / (weight[i] + weight[of] - shared)


def _links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Dealt rows, texts(node, packed) -> (a, b): verified links that join the components of a group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for held in _by_group(batches, 6):
            group = _Group(held)
            sets = [shingles(open_.decompress(r[5])) for r in held]
            offset = np.cumsum([0, *(len(s[0]) for s in sets)])
            known, ids = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
            counts = np.concatenate([s[1] for s in sets])
            bags = (ids, counts, offset, np.add.reduceat(counts, offset[:-1]), np.zeros(len(known), np.int64))
            del sets
            root, out = np.arange(group.labels.max() + 1), []
            for i in range(1, len(held)):
                of = group.others(i, root)
                if not len(of):
                    continue
                for j in of[_similar(bags, i, of) >= SIMILAR].tolist():
                    one, two = root[group.labels[i]], root[group.labels[j]]
                    if one != two:
                        root[root == two] = one
                        out.append((group.nodes[i], group.nodes[j]))
                if (root == root[0]).all():
                    break
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    whole = rows.join(texts, "node").select("group", "side", "band", "node", "short", "label", "packed")
    return whole.repartition("group").sortWithinPartitions("group", "node").mapInArrow(work, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b), texts(node, packed) -> (a, b, sim): exact weighted Jaccard of the shingles.

    The pairs of one b are streamed past its shingles; a b with many pairs is split in
    salted parts that each get a copy of its text."""
    count = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(count, "b").withColumn("parts", F.ceil(F.col("n") / SALT).cast("int"))
    sides = salted.select("b", F.pmod(F.hash("a"), F.col("parts")).alias("salt"), "a").join(texts.withColumnRenamed("node", "a"), "a")
    heads = count.select(F.col("b"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SALT).cast("int") - 1)).alias("salt")).join(texts.withColumnRenamed("node", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "packed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, items, counts, weight = zstandard.ZstdDecompressor(), None, None, None, 0
        for batch in batches:
            out = []
            for b, a, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own, n = shingles(open_.decompress(packed.as_py()))
                if a is None:
                    now, items, counts, weight = b, own, n, int(n.sum())
                    continue
                assert b == now, "a pair without its leader's text"
                _, i, j = np.intersect1d(items, own, assume_unique=True, return_indices=True)
                shared = int(np.minimum(counts[i], n[j]).sum())
                out.append((a, b, shared / max(1, weight + int(n.sum()) - shared)))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "sim"])

    both = sides.select("b", "salt", "a", "packed").unionByName(heads)
    dealt = both.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(compare, "a long, b long, sim double")


def _packed(documents: DataFrame, text: str) -> DataFrame:
    """node and its zstd-packed text, so that joins move a third of the bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = [v.as_buffer().to_pybytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(b) for b in bodies], pa.int64()), pa.array([close.compress(b) for b in bodies], pa.binary())], names=["node", "packed"])

    return documents.select(clean_text(text).alias("text")).mapInArrow(pack, "node long, packed binary")


def _roots(links: DataFrame) -> DataFrame:
    """links(a, b < a), one a node at most -> (node, label): an ancestor, the root if it is within eight steps."""
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")))
    labels = save(labels.groupBy("node").agg(F.min("label").alias("label")), "near-roots")
    for _ in range(3):
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = save(labels.join(far, "label").select("node", F.col("far").alias("label")), "near-roots")
    return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label) with the labels that new links(a, b) connect made one."""
    named = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias("l" + side))
    edges = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = save(components(edges), "near-merged")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).withColumn("label", F.col("node"))
    every = save(labels.unionByName(ends).groupBy("node").agg(F.min_by("label", F.when(F.col("label") == F.col("node"), 1).otherwise(0)).alias("label")), "near-every")
    far = merged.select(F.col("node").alias("label"), F.col("label").alias("far"))
    return save(every.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "near-labels")


def classes(nodes: DataFrame, packed: DataFrame) -> DataFrame:
    """nodes(node, short, bands, n_bytes), packed(node, packed) -> (node, label) of the linked nodes."""
    rows = shared_buckets(nodes)
    wanted = rows.select("node").distinct()
    texts = save(packed.join(wanted.hint("merge"), "node", "left_semi").groupBy("node").agg(F.max("packed").alias("packed")), "near-texts")
    pairs = save(first_pairs(rows), "near-pairs")
    first = save(verify(pairs, texts).where(F.col("sim") >= SIMILAR).select("a", "b"), "near-links")
    labels = _roots(first)
    named = save(rows.join(labels, "node", "left").select("bucket", "band", "node", "short", "n_bytes", F.coalesce("label", "node").alias("label")), "near-named")
    drop_saved(rows)
    able = save(_maybe(_dealt(named, LARGE, 1 << 60)), "near-able")
    left = save(named.join(able, ["bucket", "node"]), "near-open")
    drop_saved(named)
    links = save(_links(_dealt(left, LARGE, BYTES), texts), "near-links")
    drop_saved(left)
    drop_saved(texts)
    return _joined(labels, links) if links.limit(1).count() else labels


def _assigned(documents: DataFrame, key: str, text: str, row=None) -> DataFrame:
    """doc_id, row, node, copy_of, class_key, class_id of each document."""
    signed = save(signatures(documents, key, text, row), "near-signed")
    nodes = save(signed.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.first("short").alias("short"), F.first("bands").alias("bands"), F.min("n_bytes").alias("n_bytes")), "near-nodes")
    labels = classes(nodes, _packed(documents, text))
    named = save(nodes.join(labels, "node", "left").select("node", "copy_of", F.coalesce("label", "node").alias("class_key")), "near-named")
    ids = save(named.groupBy("class_key").agg(F.min("copy_of").alias("class_id")), "near-ids")
    of = save(named.join(ids, "class_key"), "near-classes")
    return signed.select("doc_id", "row", "node").join(of, "node")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, class_id (least id of its class), copy_of (least id with
    the same text), class_key (number of the class)."""
    return _assigned(documents, key, text).select("doc_id", "class_id", "copy_of", "class_key")


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one row of each class: the row with the least id that is not null; of
    several rows with that id, the one whose columns have the least hash, and of equal rows one.  A class
    whose ids are all null keeps a row as well."""
    row = F.xxhash64(*documents.columns)
    found = _assigned(documents, key, text, row).groupBy("class_key", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    best = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row", "n")).alias("b"))
    # An id and the hash of a row tell rows apart that are not equal.
    best = save(best.select(F.col("b.row").alias("_row"), F.coalesce("b.doc_id", F.lit(0)).alias("_id"), F.col("b.n").alias("_n")), "near-best")
    told = documents.withColumn("_row", row).withColumn("_id", F.coalesce(F.col(key).cast("long"), F.lit(0)))
    once = told.join(best.where("_n = 1"), ["_row", "_id"], "left_semi")
    several = told.join(best.where("_n > 1"), ["_row", "_id"], "left_semi").dropDuplicates(["_row", "_id"])
    return once.unionByName(several).select(*documents.columns)


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
