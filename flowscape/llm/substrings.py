"""Exact substring dedup: remove every byte covered by a 400-byte string that starts twice.

Texts are UTF-8 bytes, null is empty, matches never cross documents, and all strings are
judged on the input.  Suffixes are sorted in shards; equal strings always meet in one:

1. Every 400-byte string belongs to the least 200-byte hash inside it (its anchor, the first
   of equals).  Equal strings have equal anchors at equal offsets, so a string whose anchor
   occurs once in the corpus is unique.  Strings of a document with one anchor form a segment.
2. Equal segments are counted before anything moves (128-bit hash): one that occurs
   twice is all duplicate, however many copies there are, and only one of each goes on.
3. Segments whose anchor occurs again are gathered into shards by anchor and each shard's suffixes are
   sorted by external induced sorting (``induced``); strings that start twice are neighbours
   that share 400 bytes, as the common-prefix values say.  A shard of any size is sorted in ``MEMORY``,
   its text and all tuples in files of the task.
4. An anchor of over ``LARGE`` distinct segments is split further before sorting: strings go to
   shards by their offset from the anchor and the bytes that all strings of such offsets share (``CORE``),
   so one very common passage is not one task's alone.
5. Duplicate strings are merged to byte runs and cut out.

Repeated rows remove each other; rows that share an id but not the text are separate rows, and so are rows with
a null id, which count like any other; a text shorter than 400 bytes stays; texts of any length are
hashed in windows of ``WINDOW`` bytes; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTES, clean_text, drop_saved, mix, powers, save
from .induced import MEMORY, Scratch, descending

LENGTH = 400
GRAM = 200
LARGE = 2_000
#: Offsets from an anchor that go to one shard where an anchor is split, and the bytes their strings share.
OFFSETS = 25
CORE = LENGTH - OFFSETS + 1
#: Bytes of a shard before it is sorted (a single anchor's segments may need more).
SHARD = 2 << 20
#: Bytes of a text that are hashed at a time.
WINDOW = 1 << 18

_OTHER = mix(BYTES + np.uint64(1))


def _prefix(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * powers(len(raw) + 1)[0][:-1], out=total[1:])
    return total


def segments(text: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """anchor hash, two content hashes, first string, number of strings and anchor's distance of each
    segment, a window at a time.  A segment is cut where a window ends, which changes no string's anchor."""
    for a in range(0, len(text) - LENGTH + 1, WINDOW):
        anchor, s1, s2, start, n, lead = _segments_of(text[a : a + WINDOW + LENGTH - 1])
        yield anchor, s1, s2, start + a, n, lead


def _segments_of(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(raw)
    one, two, down = _prefix(raw, BYTES), _prefix(raw, _OTHER), powers(n + 1)[1]
    gram = mix((one[GRAM:] - one[:-GRAM]) * down[: n - GRAM + 1])
    span, last = LENGTH - GRAM + 1, n - LENGTH  # grams in a string, last string
    anchors, starts, i = [], [], 0
    a = int(gram[:span].argmin())
    while True:
        anchors.append(a)
        starts.append(i)
        # The anchor holds until it leaves the string or a smaller gram enters.
        ahead = gram[i + span : a + span]
        smaller = ahead < gram[a]
        k = int(smaller.argmax()) if len(smaller) else 0
        if len(smaller) and smaller[k]:
            a, i = i + span + k, i + 1 + k
        else:
            i = a + 1
            if i <= last:
                a = i + int(gram[i : i + span].argmin())
        if i > last:
            break
    anchors, starts = np.array(anchors), np.array(starts)
    ends = np.append(starts[1:], last + 1)
    lead, stop = anchors - starts, ends + LENGTH - 1
    s1 = mix((one[stop] - one[starts]) * down[starts] + lead.astype(np.uint64))
    s2 = mix((two[stop] - two[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return gram[anchors], s1, s2, starts, ends - starts, lead


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """A row is told by its hash and its id, where it has one."""
    body = clean_text(text)
    return documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key).isNull(), F.col(key), body).alias("rid"), body.alias("text"))


def _packed(rows: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([close.compress(v.as_buffer().to_pybytes()) for v in batch.column(2)], pa.binary())], names=["doc_id", "rid", "packed"])

    return rows.mapInArrow(pack, "doc_id long, rid long, packed binary")


def _segments(rows: DataFrame) -> DataFrame:
    schema = "id long, rid long, anchor long, s1 long, s2 long, start int, n int, lead int"
    names = ["id", "rid", "anchor", "s1", "s2", "start", "n", "lead"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids, out, held = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            for i, v in enumerate(batch.column(2)):
                if v.as_buffer().size < LENGTH:
                    continue
                for anchor, s1, s2, *rest in segments(np.frombuffer(v.as_buffer(), np.uint8)):
                    m = len(anchor)
                    out.append((np.full(m, ids[i]), np.full(m, rids[i]), anchor.view(np.int64), s1.view(np.int64), s2.view(np.int64), *(x.astype(np.int32) for x in rest)))
                    held += m
                    if held > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "rid", "text").mapInArrow(find, schema)


_RUNS = "s1 long, s2 long, runs array<struct<a:int,b:int>>"


def _flags(flag: np.ndarray, off: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).astype(np.int8)))
    return [{"a": int(a) + off, "b": int(b) + off} for a, b in zip(edge[0::2], edge[1::2], strict=True)]


class Shard:
    """The text of a shard as it is gathered, in a file once it is large."""

    def __init__(self, memory: int):
        self.memory, self.scratch = memory, Scratch(memory)
        self.parts: list[bytes] = []
        self.file, self.size = None, 0

    def add(self, body: bytes) -> int:
        """Where the text begins; a character less than all bytes ends it."""
        at = self.size
        self.parts.append(body)
        self.size += len(body) + 1
        if not self.file and self.size > self.memory // 16:
            self.file = self.scratch.path().open("w+b")
        if self.file:
            self._write()
        return at

    def _write(self) -> None:
        for body in self.parts:
            (np.append(np.frombuffer(body, np.uint8).astype(np.uint16) + 1, np.uint16(0))).tofile(self.file)
        self.parts = []

    def duplicates(self) -> np.ndarray:
        """Which places start a string of ``LENGTH`` that starts elsewhere too.  No string that
        holds an end of a text counts: both its places would, and no place within a text does."""
        if self.file:
            self.file.flush()
            text = np.memmap(self.file.name, np.uint16, "r", shape=(self.size,))
        else:
            text = np.concatenate([np.append(np.frombuffer(b, np.uint8).astype(np.uint16) + 1, np.uint16(0)) for b in self.parts])
        flag, before = self.scratch.array(self.size, bool), None
        for place, shared in descending(text, LENGTH, self.memory):
            same = shared >= LENGTH
            flag[place[same]] = True
            last = place if before is None else np.append(before, place)
            flag[last[:-1][same[1:] if before is None else same]] = True
            before = place[-1:]
        return flag

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.scratch.close()


def _shards(slices: DataFrame, memory: int = MEMORY) -> DataFrame:
    """slices(shard, s1, s2, off, n, body) -> runs of duplicate strings of each segment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        held, now, shard = [], None, None

        def flush() -> Iterator[pa.RecordBatch]:
            flag, out = shard.duplicates(), []
            for s1, s2, off, n, at in held:
                if runs := _flags(np.asarray(flag[at : at + n]), off):
                    out.append((s1, s2, runs))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["s1", "s2", "runs"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["s1", "s2", "runs"])

        try:
            for batch in batches:
                bodies = batch.column(5)
                for i, (group, s1, s2, off, n) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)):
                    if shard and group != now and shard.size > SHARD:
                        yield from flush()
                        shard.close()
                        held, shard = [], None
                    now, shard = group, shard or Shard(memory)
                    held.append((s1, s2, off, n, shard.add(bodies[i].as_py())))
            if shard:
                yield from flush()
        finally:
            if shard:
                shard.close()

    return slices.select("shard", "s1", "s2", "off", "n", "body").repartition("shard").sortWithinPartitions("shard", "s1").mapInArrow(work, _RUNS)


def _pieces(p: dict, body: bytes) -> Iterator[tuple]:
    """(shard, s1, s2, first string, strings, bytes) of a segment: one, or for a large anchor one for
    each ``OFFSETS`` offsets from the anchor."""
    if not p["large"]:
        yield p["anchor"], p["s1"], p["s2"], 0, p["n"], body
        return
    # String j lies lead - j bytes before the anchor.
    for q in range((p["lead"] - p["n"] + 1) // OFFSETS, p["lead"] // OFFSETS + 1):
        a, b = max(0, p["lead"] - (q + 1) * OFFSETS + 1), min(p["n"], p["lead"] - q * OFFSETS + 1)
        if a < b:
            core = body[p["lead"] - q * OFFSETS :][:CORE]
            shard = hashlib.blake2b(p["anchor"].to_bytes(8, "big", signed=True) + bytes([q]) + core, digest_size=8).digest()
            yield int.from_bytes(shard, "big", signed=True), p["s1"], p["s2"], a, b - a, body[a : b + LENGTH - 1]


def duplicate_runs(rows: DataFrame) -> DataFrame:
    """rows(doc_id, rid, text) -> id (0 for null), rid, runs: the byte ranges to remove, unmerged."""
    every = save(_segments(rows), "sub-segments")
    # Written, so that the join below has two plain sides and a hot anchor can be split.
    again = save(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "sub-again")
    shared = save(every.join(again, "anchor"), "sub-shared")
    drop_saved(every)
    distinct = save(shared.groupBy("anchor", "s1", "s2", "n").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "rid", "start", "lead")).alias("at")), "sub-distinct")
    # Where all segments of an anchor occur again, or there is one, nothing is left to sort.
    per = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1").select("anchor", "kinds")
    open_ = distinct.join(save(per, "sub-open"), "anchor").select("at.id", "at.rid", F.struct("anchor", "s1", "s2", "n", F.col("at.start").alias("start"), F.col("at.lead").alias("lead"), (F.col("kinds") > LARGE).alias("large")).alias("part"))
    wanted = save(open_.groupBy("id", "rid").agg(F.collect_list("part").alias("parts")), "sub-wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text, names = zstandard.ZstdDecompressor(), ["shard", "s1", "s2", "off", "n", "body"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for packed, parts in zip(batch.column(0), batch.column(1), strict=True):
                body, out = open_text.decompress(packed.as_py()), []
                for p in parts.as_py():
                    out += _pieces(p, body[p["start"] : p["start"] + p["n"] + LENGTH - 1])
                    if len(out) > 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    packed = _packed(rows).withColumn("id", F.coalesce("doc_id", F.lit(0))).join(wanted, ["id", "rid"]).dropDuplicates(["id", "rid"])
    slices = save(packed.select("packed", "parts").mapInArrow(cut, "shard long, s1 long, s2 long, off int, n int, body binary"), "sub-slices")
    found = save(_shards(slices), "sub-found")
    drop_saved(slices)
    whole = distinct.where("copies > 1").select("s1", "s2", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("runs"))
    partly = found.join(distinct.where("copies = 1").select("s1", "s2"), ["s1", "s2"], "left_semi")
    result = shared.join(save(whole.unionByName(partly), "sub-result"), ["s1", "s2"])
    parts = F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + LENGTH - 1).alias("b")))
    return result.groupBy("id", "rid").agg(F.flatten(F.collect_list(parts)).alias("runs"))


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup_substrings(documents: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (``with_text``) kept, the bytes left."""
    rows = _rows(documents, key, text)
    runs = save(duplicate_runs(rows), "sub-runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, packed, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                body = open_text.decompress(packed.as_py())
                merged: list[list[int]] = []
                for r in sorted((r["a"], r["b"]) for r in runs.as_py() or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                kept, at = [], 0
                for a, b in merged:
                    kept.append(body[at:a])
                    at = b
                kept = b"".join([*kept, body[at:]])
                out.append((doc, len(body), len(body) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = _packed(rows).withColumn("id", F.coalesce("doc_id", F.lit(0))).join(runs, ["id", "rid"], "left").select("doc_id", "packed", "runs")
    done = joined.mapInArrow(remove, _OUT)
    return done if with_text else done.drop("kept")


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
