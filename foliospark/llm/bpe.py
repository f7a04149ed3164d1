"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

RANKS = "byte_bpe_50k.tiktoken"

#: Texts longer than this many characters are encoded in segments.
SEGMENT_CHARS = 65_536

#: White-space runs of at least so many characters are encoded by themselves.
RUN_CHARS = 1_000

# What the pattern's white space is: Unicode's White_Space, which is not all of Python's.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A white-space run that follows something else always starts a new match of the
# pattern: no alternative takes white space after its first character, and the two
# that start with white space look only to the right.  So a text may be cut there.
_BOUNDARY = re.compile(f"(?<=[^{_SPACES}])(?=[{_SPACES}])")
_RUN = re.compile(f"[{_SPACES}]{{{RUN_CHARS},}}")
# a run of that length covers four of the characters taken in steps of a quarter of it
_STEP = RUN_CHARS // 4
_SAMPLED = re.compile(f"[{_SPACES}]{{4}}")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a local rank file (lines: base64 of the bytes, rank)."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cut a text at safe boundaries into pieces of about ``size`` characters.

    A stretch without a safe boundary (no white space after other text) stays whole.
    """
    at, n = 0, len(text)
    while n - at > size:
        m = _BOUNDARY.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """A text in order, long white-space runs apart (marked true).

    The pattern takes a run that something follows up to its last character as one match, and
    a run at the end whole; the library's search overflows its stack on long ones."""
    at = 0
    for m in _RUN.finditer(text) if _SAMPLED.search(text[::_STEP]) else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


def encode(enc, text: str, size: int = SEGMENT_CHARS) -> np.ndarray:
    """Token ids of a whole text as unsigned 32-bit integers; nothing is special."""
    if len(text) <= min(size, RUN_CHARS):
        return np.asarray(enc.encode_ordinary(text), dtype="<u4")
    out = [np.zeros(0, "<u4")]
    for piece, run in _pieces(text):
        if run:
            out.append(np.asarray(enc._encode_single_piece(piece), dtype="<u4"))
        else:
            out += [np.asarray(enc.encode_ordinary(x), dtype="<u4") for x in segments(piece, size)]
    return np.concatenate(out)


def decode(enc, ids) -> bytes:
    """The raw bytes of ids: any id sequence decodes, valid UTF-8 or not."""
    return enc.decode_bytes(ids.tolist() if hasattr(ids, "tolist") else list(ids))


def encode_documents(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row; a null text is the empty text, which has no ids."""
    rank_file, pattern = rank_file or rank_path(), pattern or default_pattern()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            ids = [encode(enc, t or "").astype("i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    picked = docs.select(F.col(id_col), F.col(text_col))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``(id, decoded binary)`` from ``(id, ids)``; null ids decode to null."""
    rank_file, pattern = rank_file or rank_path(), pattern or default_pattern()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            out = [None if x is None else enc.decode_bytes(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    picked = encoded.select(F.col(id_col), "ids")
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, decoded binary")


def round_trip(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and return counts and digests of both.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``.  The ids live for one document at
    a time, so memory follows the longest text, and a text may be one run of white space.  Null and empty texts have no tokens and
    the digests of no bytes; repeated rows give repeated results; an empty table gives none; other
    columns, whatever their names, are neither read nor returned.
    """
    rank_file, pattern = rank_file or rank_path(), pattern or default_pattern()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            n, ids_sha, out_sha = [], [], []
            for cell in b.column(1):
                ids = encode(enc, cell.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                out_sha.append(hashlib.sha256(decode(enc, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` for every row."""
    rank_file, pattern = rank_file or rank_path(), pattern or default_pattern()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            n = [len(encode(enc, cell.as_py() or "")) for cell in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, n_tokens long")
