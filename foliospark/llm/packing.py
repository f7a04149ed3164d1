"""Packing documents into fixed-length sequences along a space-filling curve.

A document's hashed token vector is projected to a few dimensions; documents are
range-sorted by the Hilbert key of that point, so neighbours on the curve are alike, and
are laid end to end into sequences along it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, shuffle_width, slices, split_words

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 2048
#: The id that ends each document.
END_ID = 1
#: Buckets of the hashed document vector, dimensions it is projected to, and bits of each.
BUCKETS, DIMS, BITS = 256, 3, 16
SEED = 7
#: Words whose ids a worker remembers; it forgets those not met lately beyond.
CACHE_WORDS = 500_000

# parts words from each other when many are encoded at once
_FENCE = "☃"
# Marks at a word's end after a letter or digit are one match of the pattern by themselves;
# an apostrophe is left out, for it may begin a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _head(word: str) -> str | None:
    """A word without its last marks, if these are a match by themselves: after an ASCII letter
    or digit, or a letter from U+00C0 to U+00FF."""
    head = word.rstrip(_MARKS)
    if len(head) == len(word) or not head:
        return None
    last = head[-1]
    return head if last.isalnum() and (last < "\x80" or "À" <= last <= "ÿ") else None


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokenizer:
    """Ids of whole texts, by a cache of words.

    The tokenizer lower-cases and drops white space before it merges, and no match of its
    pattern spans white space, so a text's ids are those of its words between ASCII white space,
    one after another, in either case of A-Z.  A new word costs one encoding, done for many at
    once with a fence between them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        #: strings that are one id wherever they stand, in any part of a word, before it is lower-cased
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # signs without case that all of them begin with, by which texts without any are told cheaply
        self.sign = re.match(r"[^\w\s]*", os.path.commonprefix(self.special))[0]
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size()
        self.type = "<u2" if self.size <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fence = np.array(self._ids(_FENCE), self.type)
        # the last token of a match says so, where the vocabulary marks word ends
        self.ends = np.zeros(self.size + 2, bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def table(self, words: list[str]) -> list[bytes]:
        """Ids of each word.  What is kept beyond the call are words without their last marks."""
        if len(self.known) > CACHE_WORDS // 2:
            self.older, self.known = self.known, {}
        known, older, out = self.known, self.older, [b""] * len(words)
        parts: list[tuple[int, str, str]] = []
        later: list[int] = []
        new: set[str] = set()

        def have(w: str) -> bytes | None:
            ids = known.get(w)
            if ids is None:
                ids = older.get(w)
                if ids is not None:
                    known[w] = ids
            return ids

        for i, w in enumerate(words):
            ids = known.get(w)
            if ids is None:
                ids = have(w)
            if ids is not None:
                out[i] = ids
                continue
            head = _head(w)
            if head is None:
                if w:
                    new.add(w)
                    later.append(i)
                continue
            tail = w[len(head) :]
            parts.append((i, head, tail))
            if have(head) is None:
                new.add(head)
            if have(tail) is None:
                new.add(tail)
        self._encode(list(new))
        for i in later:
            out[i] = known[words[i]]
        for i, head, tail in parts:
            out[i] = known[head] + known[tail]
        return out

    def _encode(self, words: list[str]) -> None:
        """Words of letters alone are one match each and end where a token ends a match; others
        are parted by a fence."""
        letters, others = [], []
        for w in words:
            (letters if len(w) <= 200 and w.isalpha() else others).append(w)
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            ids = np.array(self._ids(" ".join(part)), self.type)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                others += part
                continue
            data, width = ids.tobytes(), ids.itemsize
            bounds = [0, *(cuts * width).tolist()]
            self.known.update(zip(part, map(data.__getitem__, map(slice, bounds, bounds[1:])), strict=False))
        self._fenced(others)

    def _fenced(self, words: list[str]) -> None:
        mark, single, many = self.fence.tobytes(), [], []
        for w in words:
            (single if len(w) > 200 or _FENCE in w else many).append(w)
        for at in range(0, len(many), 2000):
            part = many[at : at + 2000]
            ids = np.array(self._ids(f" {_FENCE} ".join(part)), self.type)
            k = len(self.fence)
            hit = np.ones(max(len(ids) - k + 1, 0), bool)
            for i, x in enumerate(self.fence):
                hit &= ids[i : len(ids) - k + 1 + i] == x
            cuts = np.flatnonzero(hit)
            if len(cuts) != len(part) - 1:  # a word that meets the fence's ids by itself
                single += part
                continue
            starts, ends = np.concatenate([[0], cuts + k]), np.concatenate([cuts, [len(ids)]])
            data, width = ids.tobytes(), ids.itemsize
            for w, a, z in zip(part, (starts * width).tolist(), (ends * width).tolist(), strict=True):
                got = data[a:z]
                if mark in got:
                    single.append(w)
                else:
                    self.known[w] = got
        for w in single:
            self.known[w] = np.array(self._ids(w), self.type).tobytes()

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text, ``END_ID`` last.

        Texts are lower-cased, split and numbered by distinct word in Arrow; only distinct words
        meet the tables, and ids are gathered by word number.  A text that holds a special token's
        string in any case goes to the library as it is."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        odd = np.zeros(len(column), bool)
        signed = not self.sign or pc.any(pc.match_substring(column, self.sign)).as_py()
        for t in self.special if signed else ():
            odd |= pc.match_substring(column, t, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
        if odd.any():
            column = pc.if_else(pa.array(odd), pa.scalar(None, pa.string()), column)
        lists = split_words(column)
        coded = lists.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        table = self.table(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, table), "i8", len(table)) // np.dtype(self.type).itemsize
        flat = np.frombuffer(b"".join(table), self.type)
        ends = np.cumsum(sizes[number])
        start = np.cumsum(sizes) - sizes
        ids = np.empty(ends[-1] if len(ends) else 0, self.type)
        done = 0
        for at in range(0, len(number), 100_000):  # some words at a time, for indices are eight bytes an id
            part = number[at : at + 100_000]
            each = sizes[part]
            n = int(each.sum())
            ids[done : done + n] = flat[np.repeat(start[part] - (np.cumsum(each) - each), each) + np.arange(n)]
            done += n
        bounds = np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy()]))]
        end = np.array([END_ID], self.type)
        out = [np.concatenate([ids[a:z], end]) for a, z in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        for k in np.flatnonzero(odd).tolist():
            text = texts[k] if isinstance(texts, list) else texts[k].as_py()
            out[k] = np.array([*self._ids(text), END_ID], self.type)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def gathered(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Both columns of some batches at a time: distinct words are fewer in more text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield tuple(pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1))


@lru_cache(maxsize=2)
def _projection(vocabulary: int, buckets: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, buckets, vocabulary), rng.standard_normal((buckets, dims))


def project(docs: list[np.ndarray], vocabulary: int, buckets: int = BUCKETS, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """Points of documents: hashed counts, scaled to length one, times a Gaussian matrix."""
    bucket, matrix = _projection(vocabulary, buckets, dims, seed)
    v = np.array([np.bincount(bucket[d], minlength=buckets) for d in docs], float).reshape(len(docs), buckets)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v @ matrix


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of non-negative integer coordinates.

    Follows Skilling's transposition (AIP Conf. Proc. 707, 2004), over all rows at once.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of real points, whose coordinates are taken from -4 to 4."""
    return hilbert(np.clip((points + 4.0) / 8.0 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, doc_tokens, curve, ids`` (packed little-endian; two bytes each where the vocabulary allows)."""
    path = path or vocabulary_path()
    picked = docs.select("doc_id", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for doc_ids, column in gathered(batches):
            for first, texts in slices(column):
                ids = tok.encode(texts)
                keys = curve_keys(project(ids, tok.size))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(first, len(texts)), pa.array([len(x) for x in ids], pa.int64()), pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "doc_tokens", "curve", "ids"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, doc_tokens long, curve long, ids binary")


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(docs: DataFrame, scratch: Scratch, sequence: int = SEQUENCE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``sequence`` ids.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked
    for, ``ids array<int>``.  Documents are cut where a sequence is full.  Each range of the
    curve fills its sequences without a gap; what is left at its end goes into
    sequences whose lengths are powers of two, so nothing is padded.  A null or empty
    text is its end id alone; repeated rows are packed each time.  Ranges are cut on
    (curve, doc_id), so a large group of copies spreads over several; rows equal in both lie in one range,
    in no stated order.  An empty table gives no rows; a long text spans as many sequences as it needs; other
    columns, whatever their names, are neither read nor returned.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    encoded = scratch.save(encode_documents(docs, path), "packed-ids")
    id_type = dict(encoded.dtypes)["doc_id"]
    ordered = encoded.repartitionByRange(shuffle_width(spark), "curve", "doc_id").sortWithinPartitions("curve", "doc_id")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = tokenizer(path).type
        sid = TaskContext.get().partitionId() << 40
        open_pieces: list[tuple] = []  # id, start, ids, tokens of the document
        fill, out, id_arrow = 0, [], None

        def close(pieces: list[tuple]) -> None:
            nonlocal sid
            at = 0
            for doc, start, ids, total in pieces:
                wide = ids.astype("<u4")
                out.append((doc, start, len(ids), zlib.crc32(wide.tobytes()), total, sid, at, wide if with_ids else None))
                at += len(ids)
            sid += 1

        def batch() -> pa.RecordBatch:
            c = list(zip(*out, strict=True)) or [()] * 8
            arrays = [pa.array(c[0], id_arrow)] + [pa.array(c[k], pa.int64()) for k in range(1, 7)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays, names = arrays + [pa.array([x.astype("i4") for x in c[7]], pa.list_(pa.int32()))], names + ["ids"]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            id_arrow = b.column(0).type
            for doc, cell in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(cell.as_py(), kind)
                at = 0
                while at < len(ids):
                    take = min(sequence - fill, len(ids) - at)
                    open_pieces.append((doc, at, ids[at : at + take], len(ids)))
                    at, fill = at + take, fill + take
                    if fill == sequence:
                        close(open_pieces)
                        open_pieces, fill = [], 0
                if len(out) >= 5000:
                    yield batch()
        for size in powers(fill):
            part, room = [], size
            while room:
                doc, start, ids, total = open_pieces.pop(0)
                if len(ids) > room:
                    open_pieces.insert(0, (doc, start + room, ids[room:], total))
                    ids = ids[:room]
                part.append((doc, start, ids, total))
                room -= len(ids)
            close(part)
        if out:
            yield batch()

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long" + (", ids array<int>" if with_ids else "")
    return ordered.select("doc_id", "ids").mapInArrow(run, schema)

