"""SentencePiece models on the tokenizers library: encode, decode and a parity check.

The model file's protobuf is read field by field; normaliser, metaspace marker,
scores (unigram) or merges (BPE) and byte fallback are rebuilt as a tokenizers
pipeline. Where no piece has the marker after another character, a text can be
cut before each run of markers without changing a token. Such chunks repeat a
lot, so a worker encodes each new one once, in multithreaded batches.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, tidy

MARK = "▁"
#: Kinds of pieces in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: A worker keeps at most twice so many chunks, of at most so many characters each; those not met lately go first.
CACHE_CHUNKS, CACHE_CHARS = 150_000, 64
#: Texts are handled in groups of about so many characters.
GROUP_CHARS = 1_000_000


@dataclass
class Model:
    """What a model file holds."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    unknown_surface: str = " \u2047 "

    @property
    def atoms(self) -> list[str]:
        """Pieces that are never split or joined."""
        return sorted((p for p, _, kind in self.pieces if kind == USER_DEFINED), key=len, reverse=True)

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def cuts(self) -> bool:
        """True if no piece has the marker after another character, or a line end (which then is a byte)."""
        return self.escape_spaces and self.byte_fallback and not self.atoms and not any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in self.pieces)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse_model(proto: bytes) -> Model:
    model = Model()
    for number, value in _fields(proto):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, 1), bool(spec.get(35, 0))
            model.unknown_surface = spec[44].decode() if 44 in spec else model.unknown_surface
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.remove_extra_spaces, model.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return model


def build_tokenizer(model: Model):
    """The same model as a tokenizers.Tokenizer (normaliser, model and decoder)."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    ids = {p: i for i, (p, _, _) in reversed(list(enumerate(model.pieces)))}
    if model.kind == 1:
        backend = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    elif model.kind == 2:
        merges = []
        for p, score, kind in model.pieces:
            if kind in (NORMAL, USER_DEFINED, UNUSED):
                pairs = sorted((ids[p[:k]], ids[p[k:]]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
                merges += [(-score, ids[p], model.pieces[a][0], model.pieces[b][0]) for a, b in pairs]
        merges.sort(key=lambda m: m[:2])
        backend = models.BPE(ids, [m[2:] for m in merges], unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    else:
        raise ValueError("only unigram and BPE models")
    tokenizer = Tokenizer(backend)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(model.pieces[model.unknown][0], model.unknown_surface), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


def build_decoder(model: Model):
    """As build_tokenizer(), with the control pieces as special tokens, which decoding leaves out."""
    from tokenizers import AddedToken

    tokenizer = build_tokenizer(model)
    tokenizer.add_special_tokens([AddedToken(p, special=True) for p, _, kind in model.pieces if kind == CONTROL])
    return tokenizer


class Codec:
    """Encodes and decodes for one worker; ids are little-endian uint32 in bytes."""

    def __init__(self, proto: bytes, parity: str = "chunks") -> None:
        from tokenizers import normalizers

        self.model = parse_model(proto)
        self.cuts = self.model.cuts
        self.full = build_tokenizer(self.model)
        self.bare = build_tokenizer(self.model)  # for chunks that are normalised already
        self.bare.normalizer = normalizers.Sequence([])
        self.plain = self.model.escape_spaces and not self.model.charsmap and not self.model.remove_extra_spaces
        self.back = build_decoder(self.model)
        atoms = self.model.atoms
        self.atom = re.compile("(" + "|".join(map(re.escape, atoms)) + ")") if atoms else None
        self.atom_ids = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == USER_DEFINED}
        self.byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        self.silent = np.array([kind == CONTROL for _, _, kind in self.model.pieces])
        self.spaced = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])  # such a first piece stands for the dummy prefix
        self.known: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}
        self.said: list[str] = []
        self.rows: dict[bytes, str] = {}
        self.odd: set[str] = set()  # chunks on which the libraries differ
        self.by_chunk = parity == "chunks" and self.cuts
        self.other = None
        if parity != "none":
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=proto)

    def normalise(self, text: str) -> str:
        if not self.plain:
            return self.full.normalizer.normalize_str(text) if text else ""
        return (MARK * self.model.dummy_prefix + text.replace(" ", MARK)) if text else ""

    def chunks(self, text: str) -> list[str]:
        """A text cut before each run of markers and around line ends; no token crosses a cut."""
        return re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", self.normalise(text))

    def _between_atoms(self, texts: list[str]) -> list[bytes]:
        """Texts cut at the pieces that are never split: these have their own ids, what stands between is encoded alone."""
        cut = [self.atom.split(self.normalise(t)) for t in texts]
        rest = iter(self.bare.encode_batch([x for parts in cut for x in parts[::2]], add_special_tokens=False))
        return [np.array([i for k, x in enumerate(parts) for i in ([self.atom_ids[x]] if k % 2 else next(rest).ids)], "<u4").tobytes() for parts in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.atom:
            return self._between_atoms(texts)
        if not self.cuts:
            return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch(texts, add_special_tokens=False)]
        chunks = [self.chunks(t) for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known, self.past = {}, self.known
        new = set().union(*chunks).difference(self.known)
        again = new.intersection(self.past)
        self.known.update((c, self.past[c]) for c in again)
        new = list(new - again)
        self.known.update(zip(new, self._encode_new(new), strict=True))
        out = [b"".join(map(self.known.__getitem__, cs)) for cs in chunks]
        for c in new:
            if len(c) > CACHE_CHARS:
                del self.known[c]
        return out

    def _encode_new(self, chunks: list[str]) -> list[bytes]:
        """Chunks that aren't known, many to a string with line ends between; each is held against sentencepiece if parity is asked for."""
        runs, size, run = [], 0, []
        for c in chunks:
            if c == "\n":
                continue
            run.append(c)
            size += len(c)
            if size > 2000:
                runs, size, run = [*runs, run], 0, []
        runs += [run] if run else []
        end = np.array(self.bare.encode("\n", add_special_tokens=False).ids, "<u4")
        found = {"\n": end.tobytes()}
        strings = ["\n".join(r) for r in runs]
        for r, e in zip(runs, self.bare.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = np.append(np.flatnonzero(ids == end[0]), len(ids))
            starts = np.append(0, stops[:-1] + 1)
            raw = ids.tobytes()
            found.update((c, raw[4 * i : 4 * j]) for c, i, j in zip(r, starts.tolist(), stops.tolist(), strict=True))
        if self.by_chunk:
            start = len(self.other.encode("\n"))
            for r, string, ids in zip(runs, strings, self.other.encode(["\n" + x for x in strings], num_threads=1), strict=True):
                if np.array(ids[start:], "<u4").tobytes() != end.tobytes().join(found[c] for c in r):
                    self.odd.update(r)
        return [found[c] for c in chunks]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids, by the decoder of the tokenizers library.

        Pieces decode one by one, so each is decoded once for a worker; only byte
        pieces in a row depend on each other, and each new such row is decoded whole.
        """
        if not self.said:
            self.said = self.back.decode_batch([[i] for i in range(len(self.model.pieces))], skip_special_tokens=True)
        out = []
        for x in ids:
            x = np.ascontiguousarray(x, "<u4")
            if self.silent[x].any():
                x = x[~self.silent[x]]
            parts = list(map(self.said.__getitem__, x.tolist()))
            edge = np.diff(self.byte[x].astype(np.int8), prepend=0, append=0)
            for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                parts[i:j] = [self._row_of_bytes(x[i:j].tobytes()), *[""] * (j - i - 1)]
            text = "".join(parts)
            out.append(text[1:] if self.model.dummy_prefix and len(x) and self.spaced[x[0]] else text)
        return out

    def _row_of_bytes(self, row: bytes) -> str:
        if row not in self.rows:
            if len(self.rows) > CACHE_CHUNKS:
                self.rows = {}
            self.rows[row] = self.back.decode(np.frombuffer(row, "<u4").tolist(), skip_special_tokens=True)
        return self.rows[row]

    def agrees(self, texts: list[str], ids: list[bytes]) -> list[bool]:
        """Whether sentencepiece itself gives the same ids; by chunks, whether it normalises the text to the same string and gives each chunk the same ids."""
        if self.by_chunk:
            same = [a == b for a, b in zip(self.other.normalize(texts), map(self.normalise, texts), strict=True)]
            return [s and (not self.odd or self.odd.isdisjoint(self.chunks(t))) for s, t in zip(same, texts, strict=True)]
        return [np.array(a, "<u4").tobytes() == b for a, b in zip(self.other.encode(texts, num_threads=1), ids, strict=True)]


def codec(proto: bytes, parity: str) -> Codec:
    """The codec of this worker; it is built once and serves later tasks too, until the worker gets a task of another operator."""
    codecs = kept("sentencepiece")
    if (proto, parity) not in codecs:
        codecs[proto, parity] = Codec(proto, parity)
    return codecs[proto, parity]


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", parity: str = "chunks") -> DataFrame:
    """Adds ids (array of int), n_tokens, decoded (the text that the ids give) and parity to docs.

    parity is whether the sentencepiece library gives the same ids: with "chunks"
    whether it normalises the whole text to the same string and gives the same ids
    for every chunk of it (each is compared when a worker meets it first; no piece
    crosses a cut, so the ids of the chunks are those of the text), with "texts" for
    the whole text at once, with "none" it is null. Control pieces decode to nothing,
    unknown ones to the model's surface for them. Null texts have null in all four columns,
    empty ones no ids. Very long texts are encoded whole; an empty table gives an empty result. Columns of docs that
    have one of the new names are replaced; repeated rows stay.
    """
    with open(model_path, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    new = {"ids": "array<int>", "n_tokens": "int", "decoded": "string", "parity": "boolean"}
    rest = [c for c in docs.columns if c not in new]
    schema = docs.select(*rest, *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(proto.value, parity)
        for batch in batches:
            for part in _groups(batch, text):
                texts = part[text].to_pylist()
                some = [t for t in texts if t is not None]
                ids = own.encode(some)
                arrays = [np.frombuffer(x, "<u4") for x in ids]
                same = own.agrees(some, ids) if own.other else [None] * len(some)
                made = iter(zip(arrays, same, strict=True))
                rows = [(None, None) if t is None else next(made) for t in texts]
                starts = np.cumsum([0] + [0 if a is None else len(a) for a, _ in rows]).astype(np.int32)
                flat = np.concatenate([a for a, _ in rows if a is not None] or [np.zeros(0, "<u4")]).astype(np.int32)
                none = np.array([a is None for a, _ in rows])
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
                if none.any():
                    lists = pa.array([None if n else x for n, x in zip(none, lists.to_pylist(), strict=True)], pa.list_(pa.int32()))
                sizes = pa.array([None if a is None else len(a) for a, _ in rows], pa.int32())
                texts_back = iter(own.decode(arrays))
                back = pa.array([None if a is None else next(texts_back) for a, _ in rows], pa.string())
                agree = pa.array([s for _, s in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([part[c] for c in rest] + [lists, sizes, back, agree], names=[*rest, *new])

    return docs.select(*rest).mapInArrow(tidy(run, "sentencepiece"), schema)


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += int(n)
        if size >= GROUP_CHARS or i + 1 == len(batch):
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
