"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text is cut into chunks that no piece crosses (spaces with the word after them, runs of spaces, line feeds; a chunk of more than LONGEST_CHUNK characters, such
as encoded data without a space, is cut every so many characters). For each distinct chunk of a batch the lattice
of vocabulary pieces is filtered forward: the log weight of all segmentations of each prefix. Each
occurrence then samples a segmentation backward from the end, piece by piece, in proportion to its weight among all
segmentations of the chunk. The random numbers are a hash of the row's key, the chunk's place and the step, so a row gives the
same pieces in any batch, partition or retry.

The model file has merge ranks and no probabilities; a piece weighs (rank + OFFSET) ^ -ALPHA * exp(-PENALTY), Zipf's law with
a preference for few pieces. A character outside the vocabulary becomes its UTF-8 bytes (byte fallback); so does U+2581, which pieces use
for the space. No normalisation takes place: decode(encode(text)) is the text.

Free style (Arrow batches; all chunks of a batch are filtered, and all occurrences sampled, in step). A batch's chunks are worked off in slices of at most
CHARS_AT_ONCE characters, within a text too, so that memory is bounded by the slice and the text itself, however long it is. Edge cases: null text
counts as empty; an empty text has no pieces; null keys share a seed of their own, which no text has; repeated rows with the same key have the same pieces; a very long text takes time
in proportion to its length; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import ship
from ._words import mixed

ship(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, OFFSET, PENALTY = 1.0, 10, 3.0
SEED = 97
#: Characters of a piece at most (the model has none that is longer), and characters sampled at once.
MOST_CHARS, CHARS_AT_ONCE = 16, 2_000_000
#: Characters of a chunk at most: the rounds of a slice, as lattices are filtered character by character, all chunks in step.
LONGEST_CHUNK = 4096
_SPACE = "▁"
_CHUNK = re.compile(r" *[^ \n]+| +|\n")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, end to end the text."""
    found = _CHUNK.findall(text)
    if len(text) > LONGEST_CHUNK and max(map(len, found)) > LONGEST_CHUNK:
        found = [c[i : i + LONGEST_CHUNK] for c in found for i in range(0, len(c), LONGEST_CHUNK)]
    return found


_STEP = np.uint64(0x100000001B3)
_SLOTS = 18


@dataclass
class Vocabulary:
    """A hash table of the pieces by the rolling hash of their characters, their log weights, and the bytes of each id."""

    hashes: np.ndarray
    ids: np.ndarray
    weight: np.ndarray
    out: list[bytes]
    byte_ids: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none. Open addressing, all probes in step."""
        slot = _slot(hashes)
        found = np.where(self.hashes[slot] == hashes, self.ids[slot], -1)
        todo = np.flatnonzero((found < 0) & (self.ids[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOTS) - 1)
            at = slot[todo]
            same = self.hashes[at] == hashes[todo]
            found[todo[same]] = self.ids[at[same]]
            todo = todo[~same & (self.ids[at] >= 0)]
        return found


def _codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _char_hashes(chars: np.ndarray) -> np.ndarray:
    return mixed(chars.astype(np.uint64) + np.uint64(1))


def _rolled(shorter: np.ndarray | None, of_chars: np.ndarray) -> np.ndarray:
    """Hashes of the substrings that end at each character, from those of one character less."""
    out = of_chars.copy()
    if shorter is not None:
        out[1:] += shorter[:-1] * _STEP
    return out


def piece_hash(piece: str) -> np.ndarray:
    """The rolling hash of a whole piece, as an array of one."""
    key = 0
    for c in _char_hashes(_codepoints(piece)).tolist():
        key = (key * int(_STEP) + c) % 2**64
    return np.array([key], np.uint64)


def load(model_file: str = MODEL, alpha: float = ALPHA, offset: float = OFFSET, penalty: float = PENALTY) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    byte_ids, out, plain = np.zeros(256, np.int32), [b""] * n, []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            out[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = piece.replace(_SPACE, " ")
            if len(piece) > MOST_CHARS:
                raise ValueError(f"piece {piece!r} is longer than MOST_CHARS")
            out[i] = piece.encode()
            plain.append((-model.get_score(i), i, piece))
    weight, ids, hashes = np.full(n, -np.inf, np.float32), np.full(1 << _SLOTS, -1, np.int32), np.zeros(1 << _SLOTS, np.uint64)
    for rank, (_, i, piece) in enumerate(sorted(plain), 1):
        weight[i] = -alpha * np.log(rank + offset) - penalty
        key = piece_hash(piece)
        slot = int(_slot(key)[0])
        while ids[slot] >= 0:
            slot = (slot + 1) % (1 << _SLOTS)
        ids[slot], hashes[slot] = i, key[0]
    return Vocabulary(hashes, ids, weight, out, byte_ids)


def _filtered(v: Vocabulary, chunks: list[str]):
    """The lattices of chunks laid end to end: for the node after character p, cumulated shares of the arcs by length, and
    the arcs' ids (-1: the character's bytes)."""
    chars = _codepoints("".join(chunks))
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    ends = np.cumsum(lengths)
    begin = ends - lengths
    inside = np.arange(len(chars)) - np.repeat(begin, lengths)
    n = len(chars)
    share, ids = np.full((n, MOST_CHARS), -np.inf, np.float32), np.full((n, MOST_CHARS), -1, np.int16 if len(v.out) < 2**15 else np.int32)
    of_chars, h = _char_hashes(chars), None
    for k in range(MOST_CHARS):
        h = _rolled(h, of_chars)
        at = np.flatnonzero(inside >= k)
        if not len(at):
            break
        found = v.find(h[at])
        hit = found >= 0
        at, found = at[hit], found[hit]
        share[at, k], ids[at, k] = v.weight[found], found
    alone = ids[:, 0] < 0
    share[alone, 0] = -20.0 - PENALTY  # byte fallback: far less likely than any piece, and always there
    total = np.zeros(n)
    by_length = np.argsort(-lengths, kind="stable")
    starts, longest = begin[by_length], lengths[by_length]
    for e in range(1, int(longest[0]) + 1 if n else 1):
        p = starts[: np.searchsorted(-longest, -e, side="right")] + e - 1
        k = min(e, MOST_CHARS)
        back = p[:, None] - np.arange(1, k + 1)
        w = share[p, :k].astype(np.float64) + np.where(np.arange(1, k + 1) == e, 0.0, total[back])
        top = w.max(1)
        w = np.exp(w - top[:, None])
        c = np.cumsum(w, 1)
        total[p] = top + np.log(c[:, -1])
        share[p, :k] = c / c[:, -1:]  # exactly 1 from the last arc on, above any random number
    return chars, ends - 1, lengths, share, ids


def _slices(texts: list[str]) -> Iterator[list[tuple[int, int, list[str]]]]:
    """(row, place of its first chunk, chunks) in slices of at most about CHARS_AT_ONCE characters; a long text goes into several."""
    part, size = [], 0
    for row, text in enumerate(texts):
        chunks, at = chunks_of(text), 0
        if size + len(text) < CHARS_AT_ONCE:  # most texts fit whole
            part.append((row, 0, chunks))
            size += len(text)
            continue
        while at < len(chunks):
            end = at
            while end < len(chunks) and size < CHARS_AT_ONCE:
                size += len(chunks[end])
                end += 1
            part.append((row, at, chunks[at:end]))
            at = end
            if size >= CHARS_AT_ONCE:
                yield part
                part, size = [], 0
    if part:
        yield part


def _encode(v: Vocabulary, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows, and the ids of all of them."""
    counts, out = np.zeros(len(texts), np.int64), []
    for part in _slices(texts):
        offsets, ids = _encode_chunks(v, [chunks for _, _, chunks in part], seeds[[row for row, _, _ in part]], np.array([at for _, at, _ in part], np.int64))
        np.add.at(counts, [row for row, _, _ in part], np.diff(offsets))
        out.append(ids)
    return np.r_[0, np.cumsum(counts)], np.concatenate(out) if out else np.zeros(0, np.int32)


def _encode_chunks(v: Vocabulary, rows_chunks: list[list[str]], seeds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of rows of chunks, and their ids. first: the place of each row's first chunk in its text."""
    number: dict[str, int] = defaultdict(count().__next__)
    which, rows = [], []
    for chunks in rows_chunks:
        which += map(number.__getitem__, chunks)
        rows.append(len(chunks))
    chars, last, lengths, share, ids = _filtered(v, list(number))
    which, n_chunks = np.array(which, np.int64), np.array(rows, np.int64)
    node, left = last[which], lengths[which]
    place = np.arange(len(node)) - np.repeat(np.cumsum(n_chunks) - n_chunks - first, n_chunks)
    seed = mixed(np.repeat(seeds, n_chunks) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    active, steps, at, got = np.arange(len(node)), [], [], []
    while len(active):
        r = mixed(seed[active] + np.uint64((len(steps) + 1) * 0xD1B54A32D192ED03 % 2**64)) >> np.uint64(40)
        u = np.minimum(r.astype(np.float32) / np.float32(2**24), np.float32(1 - 2.0**-24))
        here = node[active]
        k = (share[here] > u[:, None]).argmax(1)
        steps.append(active)
        at.append(here)
        got.append(ids[here, k])
        node[active] -= k + 1
        left[active] -= k + 1
        active = active[left[active] > 0]
    taken = np.zeros(len(node), np.int64)
    for a in steps:
        taken[a] += 1
    start = np.cumsum(taken) - taken
    piece, place = np.zeros(int(taken.sum()), np.int32), np.zeros(int(taken.sum()), np.int64)
    for k, (a, p, i) in enumerate(zip(steps, at, got, strict=True)):
        to = start[a] + taken[a] - 1 - k
        piece[to], place[to] = i, p
    # bytes for what has no piece
    unknown = np.flatnonzero(piece < 0)
    c = chars[place[unknown]].astype(np.int64)
    n_bytes = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    sizes = np.ones(len(piece), np.int64)
    sizes[unknown] = n_bytes
    ends = np.r_[0, np.cumsum(sizes)]
    out = np.repeat(piece, sizes)
    for k in range(4):
        some = n_bytes > k
        rest = n_bytes[some] - 1 - k  # bytes that follow
        byte = (c[some] >> (6 * rest)) & 0x3F | 0x80
        if k == 0:
            byte = np.where(rest == 0, c[some], (c[some] >> (6 * rest)) | np.array([0, 0xC0, 0xE0, 0xF0])[rest])
        out[ends[unknown[some]] + k] = v.byte_ids[byte]
    per_chunk = ends[np.r_[0, np.cumsum(taken)]]
    return per_chunk[np.r_[0, np.cumsum(n_chunks)]], out


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    """The text that ids stand for."""
    return b"".join(map(vocabulary.out.__getitem__, ids)).decode("utf-8", "surrogatepass")


def _runner(vocabulary: Vocabulary, seed: int, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            k = 0
            while k < len(texts):
                n, size = k, 0
                while n < len(texts) and (n == k or size + len(texts[n]) < CHARS_AT_ONCE):
                    size += len(texts[n])
                    n += 1
                seeds = np.array([xxh3_64_intdigest(b"" if x is None else f"k{x}".encode(), seed) for x in keys[k:n]], np.uint64)
                offsets, ids = _encode(vocabulary, texts[k:n], seeds)
                columns = {"key": batch.column(0)[k:n], "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))}
                if check:
                    listed = ids.tolist()
                    columns["lossless"] = pa.array([decode_ids(vocabulary, listed[a:b]) == t for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), texts[k:n], strict=True)], pa.bool_())
                yield pa.RecordBatch.from_pydict(columns)
                k = n

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model_file: str = MODEL, seed: int = SEED, check: bool = False) -> DataFrame:
    """(key, ids), and with check a column lossless: whether decoding gives the text back."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>" + ", lossless boolean" * check
    return rows.mapInArrow(_runner(load(model_file), seed, check), schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model_file: str = MODEL) -> DataFrame:
    """(key, text)."""
    vocabulary = load(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(vocabulary, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "text": pa.array(texts, pa.string())})

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")
