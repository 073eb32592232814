"""Benchmark decontamination by latent semantic retrieval, then alignment and answer checks.

1. Document frequencies of hashed words over all documents (partition sums added by word).
2. A randomised SVD of TF-IDF passages: the benchmark's passages and those of all
   documents multiply random vectors partition by partition, once; the sums give ``RANK``
   latent directions (Nystroem's form: the product is that of a symmetric matrix).
3. Windows of every document are projected and searched by cosine, each item by windows of its own length
   (the next power of two, 32 words at least).  A window is a candidate if its latent product
   over its own TF-IDF norm reaches ``COSINE`` of the item's share in the basis, |Pq|, which is what a window
   that is the item would reach.  This is no complete search: an item whose rarest words
   were replaced can fall below.
4. So an exact index adds what step 3 misses.  An item of n words that leaks has at least
   ``LCS`` of them in 2n words of the text, so all but ``(1 - LCS)`` n of any choice of its
   words; its rarest ``(1 - LCS)`` n + r words (r up to ``SURE``) are looked up in every text, and
   r hits within 2n words make a candidate.  No leak of step 5 is missed, whatever the rank or length.
5. A candidate's surroundings are aligned with the item by longest common subsequence of
   words; the item leaks if the share of its words found in order reaches ``LCS`` and its
   answer (the last quarter of its words) is found to ``ANSWER`` - so small edits,
   insertions and re-punctuation don't hide it.

Words are runs of letters and digits, ASCII case folded.  The benchmark is the query set: it is taken in blocks
of at most ``ITEM_BYTES``, and a block alone is sent to the tasks, with the basis.
Texts are read whole, a very long one in overlapping slices of ``SLICE`` words.  Null and empty texts and items leak nothing; items without words
are ignored; repeated items each get rows; repeated documents too, and a null doc_id stays null; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, drop_saved, run_hashes, save

VOCABULARY = 1 << 16
RANK = 64
STEP = 8
PASSAGE = 64
COSINE = 0.6
#: Words of a text that are searched at a time (longer items get longer slices).
SLICE = 1 << 14
#: Rare words of an item that must be met within twice its length (fewer if it is shorter).
SURE = 4
LCS, ANSWER = 0.7, 0.5
ITEM_BYTES = 32 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words_of(data: bytes) -> np.ndarray:
    """64-bit hashes of the words in order."""
    return run_hashes(data, _LETTER, _FOLD)[0]


def _slots(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(VOCABULARY - 1)).astype(np.int64)


def _slot_table(documents: DataFrame) -> DataFrame:
    """slots: those of each text's words in order, two bytes a word, written once for two passes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_slots(words_of(v.as_buffer().to_pybytes())).astype(np.uint16).tobytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["slots"])

    return save(documents.select(clean_text().alias("text")).mapInArrow(work, "slots binary"), "lsa-slots")


def _idf(slots: DataFrame) -> np.ndarray:
    """Inverse document frequency of each slot over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(VOCABULARY, np.int64), 0
        for batch in batches:
            for v in batch.column(0):
                total[np.unique(np.frombuffer(v.as_buffer(), np.uint16))] += 1
                n += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["slot", "n"])

    rows = slots.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most VOCABULARY + 1 rows
    found = dict(zip(rows["slot"], rows["n"], strict=True))
    n = found.pop(-1, 0)
    out = np.full(VOCABULARY, np.log(n + 1.0))
    for slot, seen in found.items():
        out[slot] = np.log((n + 1.0) / (seen + 0.5))
    return np.maximum(out, 1e-3)


def _passage(slots: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, n = np.unique(slots, return_counts=True)
    x = n * idf[own]
    return own, x / max(np.sqrt((x * x).sum()), 1e-9)


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and passage numbers of the texts, about ``SLICE`` words at a time; passages are whole."""
    slots, passages, held, first = [], [], 0, 0
    for v in column:
        own = np.frombuffer(v.as_buffer(), np.uint16)
        for a in range(0, len(own), SLICE // PASSAGE * PASSAGE or PASSAGE):
            part = own[a : a + (SLICE // PASSAGE * PASSAGE or PASSAGE)]
            slots.append(part)
            passages.append(first + np.arange(len(part)) // PASSAGE)
            held, first = held + len(part), first + -(-len(part) // PASSAGE)
            if held >= SLICE:
                yield np.concatenate(slots), np.concatenate(passages)
                slots, passages, held, first = [], [], 0, 0
    if held:
        yield np.concatenate(slots), np.concatenate(passages)


def _added(slots: np.ndarray, passages: np.ndarray, idf: np.ndarray, place: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums): what these passages add to A^T (A probe), A being their TF-IDF rows."""
    key, n = np.unique(passages * VOCABULARY + slots, return_counts=True)
    passage, slot = key // VOCABULARY, key % VOCABULARY
    x = n * idf[slot]
    x /= np.maximum(np.sqrt(np.bincount(passage, x * x)), 1e-9)[passage]
    row = place[slot]
    some = row < len(probe)
    passage, row, x = passage[some], row[some], x[some].astype(np.float32)
    if not len(row):
        return row, np.zeros((0, probe.shape[1]), np.float32)
    edge = np.flatnonzero(np.diff(passage, prepend=-1))
    along = np.add.reduceat(probe[row] * x[:, None], edge, axis=0)
    order = np.argsort(row, kind="stable")
    back = along[np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(row))))[order]] * x[order, None]
    row = row[order]
    edge = np.flatnonzero(np.diff(row, prepend=-1))
    return row[edge], np.add.reduceat(back, edge, axis=0)


def _basis(slots: DataFrame, own: list, place: np.ndarray, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """Orthonormal latent directions (a row for each of the benchmark's slots) by randomised SVD."""
    n = int(place.max())
    rng, width = np.random.default_rng(seed), min(RANK + 16, n)
    probe = np.linalg.qr(rng.normal(size=(n, width)))[0]
    sent = probe.astype(np.float32)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched = np.zeros((n, width)), np.zeros(n, bool)
        for batch in batches:
            for some, passages in _chunks(batch.column(0)):
                rows, sums = _added(some, passages, idf, place, sent)
                total[rows] += sums
                touched[rows] = True
        some = np.flatnonzero(touched)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some), lists], names=["slot", "row"])

    parts = slots.mapInArrow(add, "slot long, row array<double>").groupBy("slot").agg(F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(width)]).alias("row"))
    product, got = np.zeros((n, width)), parts.toPandas()  # at most a row for each of the benchmark's slots
    if len(got):
        product[got["slot"].to_numpy()] = np.stack(got["row"].to_numpy())
        product /= max(np.abs(product).max(), 1e-9)
    # Items weigh as much as the documents: their greatest entry is 1 too.
    mine = np.zeros((n, width))
    for s, x in own:
        mine[place[s]] += x[:, None] * (x @ probe[place[s]])
    product += mine / max(np.abs(mine).max(), 1e-9)
    # product = G probe with G symmetric, so G is about product (probe^T product)^-1 product^T.
    core = probe.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    able = values > 1e-9 * max(values.max(), 1e-30)
    left, _, _ = np.linalg.svd(product @ (vectors[:, able] / np.sqrt(values[able])), full_matrices=False)
    return left[:, :RANK].astype(np.float32)


def lcs(one: list, other: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``one``."""
    places: dict = {}
    for i, w in enumerate(one):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(one)) - 1
    row = full
    for w in other:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(one) - row.bit_count()


_FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double"


def leaks(documents: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = LCS, answer: float = ANSWER) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: one row a document and item that it leaks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), clean_text().alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-total // ITEM_BYTES)
    if not blocks:
        return documents.sparkSession.createDataFrame([], _FOUND)
    slots = _slot_table(documents)
    idf = _idf(slots)
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about ITEM_BYTES
        one = _leaks(documents, slots, [(r[0], words_of(r[1].encode())) for r in rows], idf, cosine, share, answer)
        out = one if out is None else out.unionByName(one)
    drop_saved(slots)
    return out


def _leaks(documents: DataFrame, slots: DataFrame, items: list, idf: np.ndarray, cosine: float, share: float, answer: float) -> DataFrame:
    spark = documents.sparkSession
    items = [(i, w) for i, w in items if len(w)]
    if not items:
        return spark.createDataFrame([], _FOUND)
    # Words that no item has can't add to a cosine's numerator: the latent space has a row
    # for each slot of the benchmark, and one of zeros for all others and for padding.
    own = [_passage(_slots(w), idf) for _, w in items]
    used = np.unique(np.concatenate([s for s, _ in own]))
    place = np.full(VOCABULARY + 1, len(used), np.int32)
    place[used] = np.arange(len(used))
    basis = _basis(slots, own, place, idf)
    query = np.stack([x @ basis[place[s]] for s, x in own]).astype(np.float32)
    kept = np.maximum(np.linalg.norm(query, axis=1), 1e-6)
    query = query / kept[:, None]
    weighted = np.vstack([basis * idf[used, None].astype(np.float32), np.zeros((1, basis.shape[1]), np.float32)])
    by_size: dict[int, list[int]] = {}
    for k, (_, w) in enumerate(items):
        by_size.setdefault(max(32, 1 << (len(w) - 1).bit_length()), []).append(k)
    sizes = {size: (np.array(of), query[of], (cosine * kept[of]).astype(np.float32)) for size, of in by_size.items()}
    overlap = 4 * max(len(w) for _, w in items)
    shipped = spark.sparkContext.broadcast((idf.astype(np.float32), place, weighted, query, sizes, items, _rare(items, idf, share)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, place, weighted, query, sizes, items, rare = shipped.value
        near = lambda words, k: _cosine(words, idf, place, weighted, query[k])
        lists = [w.tolist() for _, w in items]
        for batch in batches:
            keys, best = batch.column(0).to_pylist(), {}
            for rows, words in _slices(batch.column(1), overlap):
                found = [(i, window, k, cos, words[i]) for i, window, k, cos in _windows(words, idf, place, weighted, sizes)]
                found += [(i, window, k, -1.0, words[i]) for i, window, k in _by_rare_words(words, rare)]
                for (i, k), got in _confirm(found, lists, share, answer, near).items():
                    if got[1:] > best.get((rows[i], k), (0.0,) * 3)[1:]:
                        best[rows[i], k] = got
            rows = [(keys[i], items[k][0], *got) for (i, k), got in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return documents.select(F.col("doc_id").cast("long"), clean_text().alias("text")).mapInArrow(search, _FOUND)


def _slices(column: pa.Array, overlap: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Row numbers and words of slices of texts, about ``SLICE`` words at a time; the slices of a longer
    text overlap, so that each run of ``overlap`` words lies in one."""
    wide = max(SLICE, 2 * overlap)
    rows, parts, held = [], [], 0
    for i, v in enumerate(column):
        words = words_of(v.as_buffer().to_pybytes())
        for a in range(0, max(1, len(words) - overlap), wide - overlap):
            part = words[a : a + wide]
            if rows and held + len(part) > wide:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(i)
            parts.append(part)
            held += len(part)
    if rows:
        yield rows, parts


def _windows(words, idf, place, weighted, sizes):
    """(text, (first, last word), item, cosine) of the windows near an item."""
    lengths = np.array([len(w) for w in words])
    blocks = -(-lengths // STEP)
    if not blocks.sum():
        return
    # Each text is padded to whole blocks; the pad slot weighs nothing.
    first = np.cumsum(blocks) - blocks
    slots = np.full(blocks.sum() * STEP, VOCABULARY, np.int64)
    put = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first * STEP, lengths)
    slots[put] = _slots(np.concatenate(words))
    weight = np.append(idf, 0).astype(np.float64)[slots]
    power = weight * weight
    row = place[slots]
    p = np.concatenate([[0.0], np.cumsum(power.reshape(-1, STEP).sum(axis=1))])
    known = np.concatenate([[0.0], np.cumsum(np.where(row < len(weighted) - 1, power, 0).reshape(-1, STEP).sum(axis=1))])
    text = np.repeat(np.arange(len(words)), blocks)
    # A window's cosine is at most the share of its norm that the benchmark's words have.
    able, needed = {}, np.zeros(len(text) + 1, np.int64)
    for size, (_, _, least) in sizes.items():
        n = size // STEP
        lo = np.arange(0, len(text), max(1, n // 4))
        hi = np.minimum(lo + n, (first + blocks)[text[lo]])
        keep = known[hi] - known[lo] >= float(least.min()) ** 2 * (p[hi] - p[lo])
        able[size] = lo[keep], hi[keep]
        np.add.at(needed, lo[keep], 1)
        np.add.at(needed, hi[keep], -1)
    some = np.flatnonzero(np.cumsum(needed)[:-1] > 0)
    if not len(some):
        return
    v = np.zeros((len(text) + 1, weighted.shape[1]))
    by_word = row.reshape(-1, STEP)[some]
    latent = weighted[by_word[:, 0]]
    for j in range(1, STEP):
        latent += weighted[by_word[:, j]]
    v[some + 1] = latent
    np.cumsum(v, axis=0, out=v)
    for size, (of, unit, least) in sizes.items():
        lo, hi = able[size]
        for a in range(0, len(lo), 4096):
            x, y = lo[a : a + 4096], hi[a : a + 4096]
            vec = ((v[y] - v[x]) / np.sqrt(np.maximum(p[y] - p[x], 1e-9))[:, None]).astype(np.float32)
            for b in range(0, len(of), 4096):
                cos = vec @ unit[b : b + 4096].T
                for r, k in zip(*np.nonzero(cos >= least[b : b + 4096]), strict=True):
                    i = text[x[r]]
                    yield int(i), (int(x[r] - first[i]) * STEP, int(y[r] - first[i]) * STEP), int(of[b + k]), float(cos[r, k])


def _cosine(words, idf, place, weighted, unit) -> float:
    """Latent cosine of a run of words with an item."""
    slots = _slots(words)
    return float(weighted[place[slots]].sum(axis=0) @ unit / max(np.sqrt((idf[slots] ** 2).sum()), 1e-9))


def _rare(items: list, idf: np.ndarray, share: float) -> tuple:
    """Postings of the items' rarest words: sorted words, their first posting, item of each
    posting; and of each item how many hits it takes within how many words."""
    words, owner, hits, span = [], [], [], []
    for k, (_, w) in enumerate(items):
        must = max(1, int(np.ceil(share * len(w) - 1e-9)))
        hits.append(min(SURE, must))
        span.append(2 * len(w))
        some = np.unique(w[np.argsort(-idf[_slots(w)], kind="stable")[: len(w) - must + hits[-1]]])
        words.append(some)
        owner.append(np.full(len(some), k, np.int32))
    words, owner = np.concatenate(words), np.concatenate(owner)
    order = np.argsort(words, kind="stable")
    known, first = np.unique(words[order], return_index=True)
    slots = np.zeros(VOCABULARY, bool)
    slots[_slots(known)] = True
    return slots, known, np.append(first, len(order)), owner[order], np.array(hits), np.array(span)


def _by_rare_words(words, rare):
    """(text, (first, last word), item) wherever enough of an item's rare words stand close together."""
    slots, known, first, owner, hits, span = rare
    lengths = np.array([len(w) for w in words])
    every = np.concatenate(words)
    at = np.flatnonzero(slots[_slots(every)])
    entry = np.minimum(np.searchsorted(known, every[at]), len(known) - 1)
    met = known[entry] == every[at]
    at, entry = at[met], entry[met]
    n = first[entry + 1] - first[entry]
    at = np.repeat(at, n)
    item = owner[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[entry], n)]
    order = np.argsort(item, kind="stable")
    at, item = at[order], item[order]
    start = np.cumsum(lengths) - lengths
    text = np.searchsorted(start, at, side="right") - 1
    last = np.arange(len(at)) + hits[item] - 1
    able = np.flatnonzero(last < len(at))
    last = last[able]
    close = able[(item[last] == item[able]) & (text[last] == text[able]) & (at[last] - at[able] < span[item[able]])]
    for c in close.tolist():
        i, k = int(text[c]), int(item[c])
        here = int(at[c] - start[i])
        # _confirm adds the item's length on both sides.
        yield i, (max(0, here - int(span[k]) // 2), min(int(lengths[i]), here + int(span[k]) // 2)), k


def _confirm(found, lists, share, answer, near) -> dict:
    """(text, item) -> (cosine, lcs, answer) of the candidates that pass both checks, the best of each."""
    best: dict = {}
    spans: dict = {}
    for i, (a, b), k, cos, words in found:
        n = len(lists[k])
        spans.setdefault((i, k), (words, []))[1].append((max(0, a - n), min(len(words), b + n), cos))
    for (i, k), (words, parts) in spans.items():
        own = lists[k]
        tail = own[-max(1, len(own) // 4) :]
        known, counts = np.unique(np.array(own, np.uint64), return_counts=True)
        parts.sort()
        merged: list = []
        for a, b, cos in parts:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), max(cos, merged[-1][2]))
            else:
                merged.append((a, b, cos))
        for a, b, cos in merged:
            part = words[a:b]
            # No common subsequence is longer than the words in common, each as often as both have it.
            entry = np.minimum(np.searchsorted(known, part), len(known) - 1)
            shared = known[entry] == part
            if np.minimum(np.bincount(entry[shared], minlength=len(known)), counts).sum() < share * len(own):
                continue
            region = part.tolist()
            # The alignment may not stray over more than twice the item's length; each run of
            # that length lies in one of these pieces.  A shift by t words changes the length of a
            # common subsequence by t at most, so shifts that can't reach what is needed are left out.
            step = max(1, len(own) // 2)
            least, tail_least = int(np.ceil(share * len(own) - 1e-9)), int(np.ceil(answer * len(tail) - 1e-9))
            for s in range(0, max(1, len(region) - len(own)), step):
                wide = region[s : s + 2 * len(own) + step]
                need = max(least, 1 + round(best.get((i, k), (0.0, 0.0, 0.0))[1] * len(own)))
                met = shared[s : s + len(wide)]
                if np.minimum(np.bincount(entry[s : s + len(wide)][met], minlength=len(known)), counts).sum() < need or lcs(own, wide) < need:
                    continue
                t = 0
                while t < step:
                    piece = wide[t : t + 2 * len(own)]
                    got = lcs(own, piece)
                    if got >= need:
                        end = lcs(tail, piece)
                        if end >= tail_least:
                            best[i, k] = (cos if cos >= 0 else near(words[a + s + t : a + s + t + len(piece)], k), got / len(own), end / len(tail))
                            need = got + 1
                        jump = max(1, tail_least - end)
                    else:
                        jump = need - got
                    if need > len(own) or len(wide) <= 2 * len(own) + t:
                        break
                    t += jump
    return best


def op1_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
