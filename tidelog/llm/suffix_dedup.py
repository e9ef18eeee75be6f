"""Exact substring dedup by a distributed difference-cover suffix sort, kept to the prefixes that matter.

What is asked of the suffix array is which suffixes share their first ``length``
bytes with one of an earlier document. So it is sorted only as far as that:

1. Sample: suffixes at positions p with p mod v in a difference cover of v. For any
   two suffixes some shift d < v puts both on sampled positions, so if they share
   ``length`` bytes, two sampled suffixes share length - v + 1. These tuples get
   names; names are dealt by their high bits and sorted, and neighbours compared. A
   name that one document alone has ends there: its suffix is decided.
2. Recurse on names: sampled suffixes whose name several documents have are named
   anew by length + v - 1 bytes, sorted and compared again. Where an earlier document
   shares so many, it shares ``length`` bytes of the v suffixes from there on, too:
   these are decided (and any later document that shares them finds the earlier one).
3. Merge: all other suffixes that reach a sample with a shared name by a shift below v
   join the sort by their first ``length`` bytes. Neighbours with equal prefixes are
   compared; a suffix whose prefix an earlier document has is what was asked for.

Texts are worked on in chunks, the rows of a table that is bucketed by chunk, so that
it is never shuffled. A chunk sends each hash range one packed array of sorted names
and gets back one bit for each, by joins on the chunk. A name is sent once by a
chunk, so no passage, however common, makes one range large.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, lean_batches, save_at, table_path, tidy
from .packing import from_planes, pack, planes, unpack
from .shingles import forget_powers, mix, powers_at, sums_before

#: Perfect difference sets (every shift is the difference of one pair), by modulus.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 4_000_000
#: Chunks, or what they send to a bucket, that a task gets at a time.
CHUNK_ROWS = 16
#: Bytes of text for each bucket, which a task sorts in memory; there are MIN_BUCKETS at least, and as many more as the input needs.
BUCKET, MIN_BUCKETS = 8_000_000, 16
#: Bits of the names that decide; those of the sample, which only discards, follow the size of the input.
NAME_BITS = 62
_rng = np.random.Generator(np.random.PCG64(57721566))
_LETTER = _rng.integers(0, 2**64, 256, dtype=np.uint64)


class Chunk:
    """Some texts, one after another."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, sizes: np.ndarray, body: bytes) -> None:
        self.ids, self.rows, self.sizes = ids, rows, sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.raw = np.frombuffer(body, np.uint8)
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.left = np.repeat(self.starts[1:], sizes).astype(np.int32) - np.arange(len(self.raw), dtype=np.int32)  # bytes from here to the end of the text
        self.total: np.ndarray | None = None

    def names(self, at: np.ndarray, width: int) -> np.ndarray:
        """A hash of the ``width`` bytes from each of some positions on, by sums over all bytes before."""
        if self.total is None:
            self.total = sums_before(self.raw, _LETTER)
        return mix((self.total[at + width] - self.total[at]) * powers_at("down", at))

    def sampled(self, length: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the difference cover with length - v + 1 bytes behind them, and the names of these bytes."""
        width = length - v + 1
        inside = np.zeros(v, bool)
        inside[list(COVERS[v])] = True
        at = np.flatnonzero(inside[self.left % v] & (self.left >= width))
        return at, self.names(at, width)

    def near(self, sample: np.ndarray, v: int) -> np.ndarray:
        """Whether a position reaches one of the sampled ones by a shift below v."""
        return _covered(np.maximum(sample - v + 1, 0), sample + 1, len(self.raw))

    def ahead(self, known: np.ndarray, v: int) -> np.ndarray:
        """Whether a position is one of the known ones or less than v behind it."""
        return _covered(known, known + v, len(self.raw))


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n positions lies in one of the ranges; a range may end beyond n."""
    step = np.bincount(begin, minlength=n + 1)[: n + 1]
    step -= np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step, out=step)[:n] > 0


def _send(key: int, names: np.ndarray, least: np.ndarray | None, several: np.ndarray | None, buckets: int, bits: int) -> Iterator[tuple]:
    """One row per bucket: the names, and for each whether several documents have it, or its smallest document."""
    shift = np.uint64(bits - buckets.bit_length() + 1)
    cut = np.searchsorted(names >> shift, np.arange(buckets + 1).astype(np.uint64))
    for b, i, j in zip(range(buckets), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if i < j:
            yield b, key, pack(names[i:j]), np.packbits(several[i:j]).tobytes() if least is None else _documents(least[i:j])


def _documents(least: np.ndarray) -> bytes:
    """Document ids as a table of distinct ids and numbers into it."""
    table, at = np.unique(least, return_inverse=True)
    return len(table).to_bytes(4, "little") + table.astype(np.int64).tobytes() + planes(at.astype(np.uint64))


def _document_ids(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, np.int64, n, 4)[from_planes(data[4 + 8 * n :]).astype(np.int64)]


def _first_sort(chunk: Chunk, length: int, v: int, bits: int) -> tuple[np.ndarray, ...]:
    """Sampled positions, the number of each one's name among the distinct names, these in order, and which several documents have."""
    at, names = chunk.sampled(length, v)
    names = names >> np.uint64(64 - bits)
    order, nth, first = _ranked(names, bits)
    least, most = _ends(chunk.ids[chunk.doc[at]][order], first)
    return at, nth, names[order[first]], least != most


def _sort(chunk: Chunk, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes: the number of each one's prefix among the distinct prefixes, the names of these in order, and their smallest documents."""
    if not len(at):
        return at, np.zeros(0, np.uint64), at
    names = chunk.names(at, width) >> np.uint64(64 - NAME_BITS)
    order, nth, first = _ranked(names)
    least, _ = _ends(chunk.ids[chunk.doc[at]][order], first)
    return nth, names[order[first]], least


def _ranked(names: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of names of so many bits, the number of each name among the distinct ones, and where these begin in that order."""
    spare = len(names).bit_length()
    if bits + spare <= 64:  # name and place in one number: a plain sort is much faster
        both = (names << np.uint64(spare)) | np.arange(len(names), dtype=np.uint64)
        both.sort()
        order, ordered = (both & np.uint64((1 << spare) - 1)).astype(np.int64), both >> np.uint64(spare)
    else:
        order = np.argsort(names)
        ordered = names[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(names) else np.zeros(0, bool)
    nth = np.empty(len(names), np.int64)
    nth[order] = np.cumsum(new) - 1
    return order, nth, np.flatnonzero(new)


def _ends(docs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)) if len(first) else (docs, docs)


def _earlier(chunk: Chunk, at: np.ndarray, nth: np.ndarray, least: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """Which suffixes have their prefix in an earlier document, in another chunk or in this one."""
    return elsewhere[nth] | (chunk.ids[chunk.doc[at]] > least[nth]) if len(at) else np.zeros(0, bool)


def _bits(parts: list[dict] | None, n: int) -> np.ndarray:
    """The answers of all buckets, in order of bucket, as booleans for n names."""
    if n == 0:
        return np.zeros(0, bool)
    out = [np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"]) for p in sorted(parts or [], key=lambda p: p["bucket"])]
    out = np.concatenate(out).view(bool) if out else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError("a chunk is not what it was")
    return out


def _read_chunk(row: dict) -> Chunk:
    import zstandard

    ids, rows, sizes = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "sizes"))
    return Chunk(ids, rows, sizes, zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(sizes.sum()))))


def _write_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, row, text) to chunks: a name of their own, the ids, the rows, the sizes and the compressed bytes."""
    import zstandard

    def made(ids: list[int], rows: list[int], texts: list[bytes]) -> pa.RecordBatch:
        name = int.from_bytes(uuid.uuid4().bytes[:8], "little", signed=True)
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        values = (name, np.array(ids, np.int64).tobytes(), np.array(rows, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), body)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["chunk", "ids", "rows", "sizes", "body"])

    ids, rows, texts, size = [], [], [], 0
    for batch in batches:
        for i, r, t in zip(batch["id"].to_pylist(), batch["row"].to_pylist(), batch["text"], strict=True):
            data = t.as_py().encode() if t.is_valid else b""
            if texts and size + len(data) > CHUNK:
                yield made(ids, rows, texts)
                ids, rows, texts, size = [], [], [], 0
            ids.append(i)
            rows.append(r)
            texts.append(data)
            size += len(data)
    if texts:
        yield made(ids, rows, texts)


def _by_row(make, names: list[str], types: list[pa.DataType]):
    """For mapInArrow: rows as dicts to lists of tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = list(make(batch.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    del rows
        forget_powers()

    return run


_SENT = (["bucket", "chunk", "names", "more"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])
_SENT_SCHEMA, _ANSWER_SCHEMA = "bucket int, chunk long, names binary, more binary", "chunk long, bucket int, n int, bits binary"
_PLACES = (["chunk", "at"], [pa.int64(), pa.binary()])
_DONE = (["id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])


def _compare(second: bool):
    """For applyInArrow on a bucket: puts all chunks' names in order, compares neighbours, and answers each chunk with a bit per name."""

    def run(sent: pa.Table) -> pa.Table:
        names = [unpack(x) for x in sent["names"].to_pylist()]
        sizes = [len(x) for x in names]
        more = sent["more"].to_pylist()
        flat = np.concatenate(names)
        order, nth, first = _ranked(flat)
        if second:
            least = np.concatenate([_document_ids(x) for x in more])
            low, _ = _ends(least[order], first)
            bit = low[nth] < least  # an earlier document elsewhere has this prefix
        else:
            several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).view(bool) for x, n in zip(more, sizes, strict=True)])
            chunks = np.diff(np.append(first, len(flat))) > 1
            own = np.logical_or.reduceat(several[order], first)
            bit = (chunks | own)[nth]
        cut = np.cumsum([0, *sizes])
        bits = [np.packbits(bit[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"chunk": sent["chunk"], "bucket": sent["bucket"], "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _answers(sent: DataFrame, name: str) -> DataFrame:
    """One row per chunk with the answers of all its buckets."""
    out = sent.groupBy("bucket").applyInArrow(_compare(name != "first"), _ANSWER_SCHEMA)
    return out.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name))


def remove_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", v: int = 13, texts: bool = False, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts, also kept (the rest as a string), with row, also row (a column of whole numbers).

    Removed is every byte that is covered by a string of ``length`` bytes (of the
    text's UTF-8) which also starts in a document with a smaller doc_id; strings
    are judged on the input. n_spans counts maximal removed runs. Texts shorter
    than length, empty and null texts (empty) lose nothing. Rows with equal
    doc_id don't act on each other; rows with a null doc_id neither remove nor
    lose anything. kept may cut a character's bytes apart; what can't be read is
    then left out of that string, but not of its hash. Only the named columns
    are read; an empty table gives an empty result.
    """
    if v not in COVERS or length < 2 * v - 12:
        raise ValueError("v must be one of COVERS, and the strings longer")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), (F.col(row).cast("long") if row else F.lit(0).cast("long")).alias("row"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(MIN_BUCKETS, 1 << (total // BUCKET).bit_length())
    bits = min(64, max(24, total.bit_length() + 8))
    name = f"tidelog_chunks_{uuid.uuid4().hex}"
    parts = max(12, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = rows.where("id is not null").mapInArrow(tidy(_write_chunks), "chunk long, ids binary, rows binary, sizes binary, body binary")
    paths = [table_path(spark, "chunks")]
    try:
        chunks.write.bucketBy(parts, "chunk").option("compression", "uncompressed").option("path", paths[0]).saveAsTable(name)
        table = spark.table(name)

        def sample(row: dict) -> Iterator[tuple]:
            _, _, names, several = _first_sort(_read_chunk(row), length, v, bits)
            return _send(row["chunk"], names, None, several, buckets, bits)

        def select(row: dict) -> Iterator[tuple]:
            at, nth, names, _ = _first_sort(_read_chunk(row), length, v, bits)
            at = at[_bits(row["first"], len(names))[nth]]
            yield row["chunk"], planes(np.diff(at, prepend=0).astype(np.uint64))

        def shared(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray]:
            """The chunk, sampled suffixes with a shared name, and those of them that are long enough to be named anew."""
            chunk = _read_chunk(row)
            at = np.cumsum(from_planes(row["at"]).astype(np.int64))
            return chunk, at, at[chunk.left[at] >= length + v - 1]

        def recurse(row: dict) -> Iterator[tuple]:
            chunk, _, long = shared(row)
            _, names, least = _sort(chunk, long, length + v - 1)
            return _send(row["chunk"], names, least, None, buckets, NAME_BITS)

        def remaining(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray]:
            """The chunk, the suffixes that an earlier document is known to share, and those that are still to be compared."""
            chunk, at, long = shared(row)
            nth, names, least = _sort(chunk, long, length + v - 1)
            known = long[_earlier(chunk, long, nth, least, _bits(row["longer"], len(names)))]
            decided = chunk.ahead(known, v)
            return chunk, np.flatnonzero(decided), np.flatnonzero(chunk.near(at, v) & ~decided & (chunk.left >= length))

        def merge(row: dict) -> Iterator[tuple]:
            chunk, _, at = remaining(row)
            _, names, least = _sort(chunk, at, length)
            return _send(row["chunk"], names, least, None, buckets, NAME_BITS)

        def finish(row: dict) -> Iterator[tuple]:
            chunk, decided, at = remaining(row)
            nth, names, least = _sort(chunk, at, length)
            gone = at[_earlier(chunk, at, nth, least, _bits(row["merged"], len(names)))]
            return _cut(chunk, np.concatenate([decided, gone]), length, texts)

        with lean_batches(spark, CHUNK_ROWS, CHUNK):
            for step, name_of in ((sample, "first"), (recurse, "longer"), (merge, "merged")):
                answers, path = save_at(_answers(table.mapInArrow(tidy(_by_row(step, *_SENT)), _SENT_SCHEMA), name_of), name_of)
                paths.append(path)
                if step is sample:  # the places of shared names are written once, so that later passes needn't sort the whole sample again
                    places = table.join(answers, "chunk", "left").mapInArrow(tidy(_by_row(select, *_PLACES)), "chunk long, at binary")
                    answers, path = save_at(places, "places")
                    paths.append(path)
                table = table.join(answers, "chunk", "left")

            done = _DONE if not texts else ([*_DONE[0], "kept"], [*_DONE[1], pa.string()])
            schema = "id long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts
            cut, _ = save_at(table.mapInArrow(tidy(_by_row(finish, *done)), schema), "cut")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in paths:
            drop_table(spark, path)
    body = F.coalesce(F.col("text"), F.lit(""))
    others = rows.where("id is null").select("id", "row", F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), *([body.alias("kept")] if texts else []))
    out = cut.unionByName(others)
    return (out if row else out.drop("row")).withColumnRenamed("id", key)


def _cut(chunk: Chunk, gone: np.ndarray, length: int, texts: bool) -> Iterator[tuple]:
    """What is left of each document without the strings that start at the positions in gone."""
    n = len(chunk.raw)
    removed = _covered(gone, gone + length, n)
    for i, (a, b) in enumerate(zip(chunk.starts[:-1].tolist(), chunk.starts[1:].tolist(), strict=True)):
        out = removed[a:b]
        lost = int(np.count_nonzero(out))
        kept = chunk.raw[a:b].tobytes() if not lost else chunk.raw[a:b][~out].tobytes()
        spans = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1])) if lost else 0
        yield (int(chunk.ids[i]), int(chunk.rows[i]), b - a, lost, spans, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if texts else []))
