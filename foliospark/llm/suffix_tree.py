"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are lower-cased words and one end per text; a context is any run of tokens, which may
begin with the start of the text.  A context becomes a state if it occurs at least ``FLOOR``
times in the training texts and its next-token distribution diverges from that of its longest
suffix that is a state.  Distributions are smoothed towards that suffix (Witten and Bell), the
root is add-one, and each token is scored by the longest state that is a suffix of what
precedes it.  No floor depends on the size of the corpus, so what is gathered grows with it.

The tree is never held in one place.  Texts lie in chunks, a row each, and are tokenized once.
For each length the chunks ask for what they need in sorted packed arrays, one row a
hash bucket: how often a context with its next token occurs in training, and whether a context is a
state, how often it occurs and with how many different next tokens.  The answers come
back to the chunk.  A hot word or passage is one number a chunk, as chunks count first.
A context whose next token is always the same is not made longer, for no longer one differs
from it, nor is one that occurs less than ``FLOOR`` times; so fewer and fewer tokens ask, and
lengths end where no context becomes a state.  The driver sees sums only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, release, slices, split_words

#: Longest context, in tokens.  Lengths end earlier where no context becomes a state; repeated lines
#: and passages with variants go on for as long as they are, for the few tokens at their forks.
DEPTH = 10
#: Least occurrences of a state in the training texts.
FLOOR = 2
#: Least divergence of a state from its parent, in nats per different next token.
DIVERGENCE = 1.0
#: Tokens in a chunk of documents, and in a bucket of questions.
CHUNK_TOKENS, BUCKET_TOKENS = 1_500_000, 4_000_000
#: A length asks in two rounds if more than so many buckets and so large a share of all tokens are left.
SPLIT_BUCKETS, SPLIT_SHARE = 3, 0.5
#: Bytes of texts that are taken apart at once, unless one text has more.
SLICE_BYTES = 2_000_000
#: Chunks that a task works through, one after another.
CHUNKS_A_TASK = 4
#: Rows of an Arrow batch while texts are read, and while chunks move, which have some megabytes each.
TEXT_ROWS, CHUNK_ROWS = 1000, 8
#: Documents whose crc32(id as text) leaves this remainder are held out.
HELD_OUT = (7, 2)

#: Local numbers of the start and the end of a text; words follow.
_START, _END = 0, 1
#: Kinds of rows.
_PAIRS, _CONTEXTS, _WORDS, _CHUNK = range(4)
_U = np.uint64
_LN10 = float(np.log(10.0))
_NAMES = ["shard", "kind", "bucket", "n", "m", "x", "ids"]


def _schema(id_type: str) -> str:
    return f"shard long, kind int, bucket int, n long, m long, x binary, ids array<{id_type}>"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: planes of equal significance lie together, compressed; of unsigned numbers only the planes that hold any bits."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        used = a.itemsize
        if a.dtype.kind == "u":
            used = -(-int(a.max(initial=0)).bit_length() // 8)
        parts = np.ascontiguousarray(a).view("u1").reshape(-1, a.itemsize)
        planes = np.empty((used, len(a)), "u1")
        for j in range(used):
            planes[j] = parts[:, j]
        data = pa.compress(planes, codec="zstd", asbytes=True) if planes.size else b""
        out += [struct.pack("<3sBQQ", a.dtype.str.encode(), used, len(a), len(data)), data]
    return b"".join(out)


def unpack(data: bytes | memoryview, without: tuple[int, ...] = ()) -> list[np.ndarray | None]:
    """The arrays; none in the place of those that are not asked for."""
    out, at, view = [], 1, memoryview(data)
    for place in range(view[0]):
        kind, used, n, packed = struct.unpack_from("<3sBQQ", view, at)
        at += 20
        if place in without:
            out.append(None)
            at += packed
            continue
        kind = np.dtype(kind.decode())
        parts = (np.empty if used == kind.itemsize else np.zeros)((n, kind.itemsize), "u1")
        if n and used:
            planes = np.frombuffer(pa.decompress(view[at : at + packed], decompressed_size=n * used, codec="zstd"), "u1").reshape(used, n)
            for j in range(used):
                parts[:, j] = planes[j]
        at += packed
        out.append(parts.reshape(-1).view(kind))
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order, and which of them each one is.

    Sorts the upper bits with the position in the lower; the few runs of keys that differ in
    their lower bits only are put in order afterwards."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, "i8")
    low = _U((1 << max(n - 1, 1).bit_length()) - 1)
    order = keys & ~low
    order |= np.arange(n, dtype="u8")
    order.sort()
    order &= low
    order = order.view("i8")
    keys = keys[order]
    first = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    behind = np.flatnonzero(first[1:]) + 1
    if len(odd := behind[(keys[behind] ^ keys[behind - 1]) <= low]):
        # all keys with the upper bits of one where they stay and the lower ones change
        upper = keys & ~low
        head = np.unique(upper[odd])
        a, sizes = np.searchsorted(upper, head), np.searchsorted(upper, head, side="right")
        sizes -= a
        run = np.repeat(a - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        right = run[np.argsort(keys[run], kind="stable")]
        keys[run], order[run] = keys[right], order[right]
        np.not_equal(keys[1:], keys[:-1], out=first[1:])
    which = np.empty(n, "i8")
    which[order] = np.cumsum(first) - 1
    return keys[first], which


#: Keys that are mixed at once, so that they stay in the processor's cache.
_BLOCK = 1 << 15


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """Mix keys in place."""
    x *= _U(0x9E3779B97F4A7C15)
    x ^= np.right_shift(x, _U(31), out=spare)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= np.right_shift(x, _U(32), out=spare)


class Chunk:
    """Some documents and what is known of them after a number of lengths."""

    FIELDS = ("words", "sizes", "number", "hashes", "counts", "held", "n_tokens", "n_known", "base", "score", "waiting", "seen", "logp", "asks")

    def __init__(self, **fields: np.ndarray):
        #: tokens of texts, one after another, by local number; later pieces of them, as far as they are needed
        self.words = fields["words"]
        #: tokens (with start and end) of each such text or piece of one, and its document's place among all
        self.sizes, self.number = fields["sizes"], fields["number"]
        #: by local number: hash, from the first length on a number of all words instead, and occurrences in training
        self.hashes, self.counts = fields["hashes"], fields["counts"]
        #: by document
        self.held, self.n_tokens, self.n_known = fields["held"], fields["n_tokens"], fields["n_known"]
        self.base, self.score = fields["base"], fields["score"]
        #: tokens that wait for their context's verdict, how often they follow it, their log10
        #: probability so far (single precision), and which of them ask for a longer context
        self.waiting, self.seen, self.logp, self.asks = fields["waiting"], fields["seen"], fields["logp"], fields["asks"]

    @classmethod
    def load(cls, data: bytes | memoryview, *without: str) -> Chunk:
        """The chunk, whole or without some fields that nobody will read."""
        fields = dict(zip(cls.FIELDS, unpack(data, tuple(map(cls.FIELDS.index, without))), strict=True))
        fields["waiting"] = np.cumsum(fields["waiting"], dtype="i8")
        return cls(**fields)

    def dump(self) -> bytes:
        fields = {k: getattr(self, k) for k in self.FIELDS}
        fields["waiting"] = np.diff(self.waiting, prepend=0).astype("<u4")
        return pack(*fields.values())

    def place(self, n: int = 0, v: int = 0, top: int = 0) -> None:
        """The root is for ``n`` training tokens of ``v`` kinds.  Numbers of words are below ``top``."""
        self.n, self.v, self.top = n, v, top

    @cached_property
    def root(self) -> np.ndarray:
        return np.log10((self.counts + 1.0) / (self.n + self.v + 1.0))

    @cached_property
    def starts(self) -> np.ndarray:
        """Where texts start."""
        return np.cumsum(self.sizes, dtype="i8") - self.sizes

    @cached_property
    def doc(self) -> np.ndarray:
        """Of each token, its text."""
        return np.repeat(np.arange(len(self.sizes), dtype="i4"), self.sizes)

    @cached_property
    def train(self) -> np.ndarray:
        """Of each token, whether it is training text."""
        return np.repeat(self.held[self.number] == 0, self.sizes)

    @cached_property
    def hashed(self) -> np.ndarray:
        return self.hashes[self.words]

    def predicted(self) -> np.ndarray:
        every = np.ones(len(self.words), bool)
        every[self.starts] = False
        return np.flatnonzero(every)

    def keys(self, at: np.ndarray, length: int, follow: bool) -> np.ndarray:
        """Of each token its context of a length, or that and the token."""
        out = np.full(len(at), length, "u8")
        spare = np.empty(min(_BLOCK, len(at)), "u8")
        for k in range(0, len(at), _BLOCK):
            here, key = at[k : k + _BLOCK], out[k : k + _BLOCK]
            for j in range(1, length + 1):
                key += self.hashed[here - j]
                _mix(key, spare[: len(key)])
            if follow:
                key ^= self.hashed[here].astype("u8") * _U(0xA24BAED4963EE407)
                _mix(key, spare[: len(key)])
        return out

    def so_far(self) -> np.ndarray:
        """log10 probability of the tokens that wait, by contexts of the lengths before; by the root it is not stored."""
        return self.logp.astype(float) if len(self.logp) else self.root[self.words[self.waiting]]

    def pairs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens that ask, their distinct (context, next) and which is whose."""
        at = self.predicted() if length == 1 else self.waiting[self.asks > 0]
        return at, *distinct(self.keys(at, length, True))

    def contexts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length == 1:  # a word is its own context, and its number its key, spread over all buckets
            words = self.words[self.waiting - 1]
            used = np.bincount(words, minlength=len(self.hashes)) > 0
            keys, which = distinct(self.hashes[used].astype("u8") << _U(64 - int(self.top).bit_length()))
            place = np.zeros(len(used), "i8")
            place[used] = which
            return keys, place[words]
        return distinct(self.keys(self.waiting, length, False))

    def keep(self, waiting: np.ndarray, reach: int) -> None:
        """Forget all tokens but those that wait and ``reach`` before each, and words met nowhere else.

        What is kept of a text are pieces; a token that waits has ``reach`` before it there, or all."""
        self.waiting = waiting
        if len(waiting) > 0.7 * len(self.words):
            return
        edge = np.bincount(np.maximum(waiting - reach, self.starts[self.doc[waiting]]), minlength=len(self.words) + 1)
        edge[waiting + 1] -= 1
        need = np.cumsum(edge[:-1]) > 0
        if need.mean() > 0.7:
            return
        first = need.copy()
        first[1:] &= ~need[:-1] | (self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(need)
        heads = np.flatnonzero(first[at])
        self.waiting = (np.cumsum(need) - 1)[waiting]
        self.sizes = np.diff(heads, append=len(at)).astype("<u4")
        self.number = self.number[self.doc[at[heads]]]
        used = np.zeros(len(self.hashes), bool)
        used[self.words[at]] = True
        self.words = (np.cumsum(used) - 1).astype("<u4")[self.words[at]]
        self.hashes, self.counts = self.hashes[used], self.counts[used]


def _narrow(n: np.ndarray) -> np.ndarray:
    """Whole numbers of any kind in 32 bits where they fit."""
    return n.astype("<u4" if n.max(initial=0) < 1 << 32 else "<u8")


def _rows(shard: int, kind: int, keys: np.ndarray, buckets: int, *columns: np.ndarray) -> list[tuple]:
    """Questions of one chunk by bucket; buckets are ranges of the hash, so sorted keys stay in order."""
    bounds = np.array([-(-(k << 32) // buckets) << 32 for k in range(buckets)], "u8")
    cuts = [*np.searchsorted(keys, bounds).tolist(), len(keys)]
    out = []
    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if z > a:
            out.append((shard, kind, k, z - a, None, pack(np.diff(keys[a:z], prepend=_U(0)), *(c[a:z] for c in columns)), None))
    return out


def _batch(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [()] * 7
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(ids))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], _NAMES)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one at a time; ids and packed arrays stay in Arrow."""
    for b in batches:
        for k in range(b.num_rows):
            yield (*(b.column(j)[k].as_py() for j in range(5)), memoryview(b.column(5)[k].as_buffer()), b.column(6)[k])


def _ids_type(b: pa.DataType) -> pa.DataType:
    return b.value_type


def chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """The documents in chunks: ``n`` training tokens, ``m`` training documents, ``x`` the chunk."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))
    picked = docs.select("doc_id", "text", held.alias("held"))
    id_type = dict(picked.dtypes)["doc_id"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 24
        coded: list[pa.DictionaryArray] = []
        counts: list[np.ndarray] = []
        marks: list[bool] = []
        ids: list = []
        seen, id_arrow = 0, None

        def close() -> pa.RecordBatch:
            sizes = (np.concatenate(counts) + 2).astype("<u4")
            n = len(sizes)
            # words are numbered in the order they are met
            one = pa.chunked_array(coded).unify_dictionaries()
            kinds = one.chunk(0).dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), "<u8", len(kinds))
            words = np.empty(int(sizes.sum(dtype="i8")), "<u4")
            last = np.cumsum(sizes, dtype="i8") - 1
            inner = np.ones(len(words), bool)
            inner[last] = inner[last + 1 - sizes] = False
            words[inner] = np.concatenate([c.indices.to_numpy() for c in one.chunks]).astype("<u4") + np.uint32(2)
            words[last + 1 - sizes], words[last] = _START, _END
            # the two marks can be no word, as words hold no white space
            hashes = np.concatenate([np.array([xxhash.xxh3_64_intdigest(b" start"), xxhash.xxh3_64_intdigest(b" end")], "<u8"), hashes])
            mark = np.array(marks, "u1")
            none = np.zeros(0, "<u4")
            chunk = Chunk(words=words, sizes=sizes, number=np.arange(n, dtype="<u4"), hashes=hashes, counts=np.zeros(0, "<u8"), held=mark, n_tokens=(sizes - 1).astype("<u4"), n_known=none, base=np.zeros(0), score=np.zeros(n), waiting=none, seen=none, logp=np.zeros(0, "<f4"), asks=np.zeros(0, "u1"))
            train = mark == 0
            return _batch([(shard, _CHUNK, None, int((sizes[train] - 1).sum(dtype="i8")), int(train.sum()), chunk.dump(), ids)], id_arrow)

        for b in batches:
            id_arrow = b.column(0).type
            docs, held = b.column(0).to_pylist(), b.column(2).to_pylist()
            for first, part in slices(b.column(1), SLICE_BYTES):
                lists = split_words(part)
                every = lists.flatten().dictionary_encode()
                flat = every.indices.to_numpy()
                # empty words are no tokens
                full = flat != pc.index(every.dictionary, "").as_py()
                counts.append(np.diff(np.cumsum(full)[np.cumsum(pc.list_value_length(lists).to_numpy()) - 1], prepend=0))
                flat = flat[full]
                coded.append(pa.DictionaryArray.from_arrays(pa.array(flat), every.dictionary))
                marks += held[first : first + len(part)]
                ids += docs[first : first + len(part)]
                seen += len(flat) + 2 * len(part)
                if seen >= chunk_tokens:
                    yield close()
                    shard, seen = shard + 1, 0
                    coded, counts, marks, ids = [], [], [], []
        if counts:
            yield close()

    return picked.mapInArrow(run, _schema(id_type))


def _ask_words(buckets: int):
    """Questions of every chunk: occurrences of its words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            c = Chunk.load(row[5])
            train = np.bincount(c.words[np.repeat(c.held == 0, c.sizes)], minlength=len(c.hashes))[1:]
            order = np.argsort(c.hashes[1:])
            yield _batch(_rows(row[0], _WORDS, c.hashes[1:][order], buckets, train[order].astype("<u8")), _ids_type(row[6].type))

    return run


def _ask(length: int, kinds: tuple[int, ...], buckets: int, n: int, v: int, top: int):
    """Questions of every chunk, of some kinds: occurrences of (context, next) of a length, and its waiting contexts,
    which are one shorter."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            c = Chunk.load(row[5], *(() if _CONTEXTS in kinds else ("counts", "seen", "logp")), "n_tokens", "n_known", "base", "score")
            c.place(n, v, top)
            out = []
            if _PAIRS in kinds:
                at, keys, which = c.pairs(length)
                out += _rows(row[0], _PAIRS, keys, buckets, np.bincount(which, weights=c.train[at], minlength=len(keys)).astype("<u8"))
            if _CONTEXTS in kinds:
                keys, which = c.contexts(length - 1)
                train = c.train[c.waiting].astype(float)
                seen = np.maximum(c.seen.astype(float), 1.0)
                # what the occurrences here add to the context's divergence and to its different next tokens
                more = train * (np.log(seen) - c.so_far() * _LN10)
                total, gain, different = (np.bincount(which, weights=w, minlength=len(keys)) for w in (train, more, train / seen))
                out += _rows(row[0], _CONTEXTS, keys, buckets, total.astype("<u8"), gain.astype("<f4"), different.astype("<f4"))
            if out:
                yield _batch(out, _ids_type(row[6].type))

    return run


def _answer(floor: int, divergence: float, buckets: int):
    """Answers in the order of each question.  Words are numbered: by place in their bucket, buckets
    in turn.  A bucket's first answer says how many different keys it has (``n``) and how many
    of them occur in training (``m``)."""

    def group(rows: list[tuple]) -> list[tuple]:
        kind = rows[0][1]
        parts = [unpack(r[5]) for r in rows]
        keys, which = distinct(np.concatenate([np.cumsum(p[0], dtype="u8") for p in parts]))
        n = np.bincount(which, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys))
        cuts = np.cumsum([0] + [len(p[0]) for p in parts]).tolist()
        if kind != _CONTEXTS:
            found, m = [_narrow(n)], int((n > 0).sum())
            if kind == _WORDS:
                found.append(np.arange(len(keys), dtype="<u8") * _U(buckets) + _U(rows[0][2]))
        else:
            gain, kinds = (np.bincount(which, weights=np.concatenate([p[k] for p in parts]), minlength=len(keys)) for k in (2, 3))
            kinds = np.rint(kinds)
            total = np.maximum(n, 1.0)
            state = (n >= floor) & (gain - total * np.log(total) >= divergence * kinds)
            found, m = [_narrow(n), _narrow(kinds), state.astype("u1")], 0
        out = []
        for k, (r, a, z) in enumerate(zip(rows, cuts, cuts[1:], strict=False)):
            out.append((r[0], kind, r[2], *((len(keys), m) if k == 0 else (0, 0)), pack(*(f[which[a:z]] for f in found)), None))
        return out

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, ids = None, [], None
        for row in _each(batches):
            ids = _ids_type(row[6].type)
            if (row[2], row[1]) != now:
                if rows:
                    yield _batch(group(rows), ids)
                now, rows = (row[2], row[1]), []
            rows.append(row)
        if rows:
            yield _batch(group(rows), ids)

    return run


def _learn(length: int, n: int, v: int, top: int, floor: int, reach: int):
    """Take in the answers about one length; ``n`` of a chunk is then how many tokens have a state
    of the length before, ``m`` how many wait for their context."""

    def step(c: Chunk, answers: dict) -> tuple[int, int]:
        if length == 1:
            order = np.argsort(c.hashes[1:])
            c.counts, numbers = np.zeros(len(c.hashes), "<u8"), np.full(len(c.hashes), top, "<u8")
            c.counts[1:][order], numbers[1:][order] = answers[_WORDS]
        c.place(n, v, top)
        if length == 1:
            c.waiting = at = c.predicted()
            c.asks = np.ones(len(at), "u1")
            c.seen = c.counts[c.words[at]]
            c.base = np.bincount(c.doc[at], weights=c.root[c.words[at]], minlength=len(c.sizes))
            c.n_known = np.bincount(c.doc[at], weights=c.seen > 0, minlength=len(c.sizes)).astype("<u4")
        if not len(c.waiting):
            return 0, 0
        at, _, which = c.pairs(length)
        seen = answers[_PAIRS][0][which] if len(at) else np.zeros(0, "<u4")
        if length == 1:
            c.hashes = numbers.astype("<u4") if top < 1 << 32 else numbers
        logp, asked, states = c.so_far(), c.asks > 0, 0
        longer = asked.copy()
        if length == 1:  # a word is as frequent a context as it is a word; starts are as many as texts
            before = c.words[c.waiting - 1]
            longer = (before == _START) | (c.counts[before] >= floor)
        else:
            _, whose = c.contexts(length - 1)
            total, kinds, state = answers[_CONTEXTS]
            longer &= ((total >= floor) & (kinds >= 2))[whose]
            ruled = np.flatnonzero((state > 0)[whose])
            whose = whose[ruled]
            t, k = total[whose].astype(float), kinds[whose].astype(float)
            logp[ruled] = np.log((c.seen[ruled] + k * np.exp(logp[ruled] * _LN10)) / (t + k)) / _LN10
            states = len(ruled)
        waiting, at = c.waiting, c.waiting[longer]
        seen = seen[longer[asked]]
        # a context occurs as often as its last token follows what is before it
        rare = np.zeros(len(c.words), bool)
        rare[at] = seen < floor
        asks = ~rare[at - 1] & (at - c.starts[c.doc[at]] > length)
        c.score = c.score + np.bincount(c.number[c.doc[waiting[~longer]]], weights=logp[~longer], minlength=len(c.score))
        c.seen = _narrow(seen)
        c.logp = logp[longer].astype("<f4") if length > 1 else np.zeros(0, "<f4")
        c.asks = asks.astype("u1")
        c.keep(at, reach)
        return states, len(at)

    def run(key, state: pa.Table, answers: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        order = np.lexsort((answers.column("bucket").to_numpy(), answers.column("kind").to_numpy()))
        for k in order.tolist():
            parts.setdefault(answers.column("kind")[k].as_py(), []).append(unpack(answers.column("x")[k].as_buffer()))
        found = {kind: [np.concatenate([p[k] for p in some]) for k in range(len(some[0]))] for kind, some in parts.items()}
        c = Chunk.load(state.column("x")[0].as_buffer())
        states, left = step(c, found)
        ids = state.column("ids")
        out = _batch([(state.column("shard")[0].as_py(), _CHUNK, None, states, left, c.dump(), ids[0].as_py())], ids.type.value_type)
        del c, found, parts
        release(collect=False)
        return pa.Table.from_batches([out])

    return run


def score(docs: DataFrame, scratch: Scratch, depth: int = DEPTH, floor: int = FLOOR, divergence: float = DIVERGENCE, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Score every text by a tree learned from the texts that are not held out.

    Columns: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, scores in
    log10.  A null or empty text is its end alone.  A row without id is training text.
    Repeated rows count as often as they occur.  An empty table gives no rows; with
    nothing to learn from, every symbol is equally likely and the base is log10(1) a token.
    A text is never cut, so a chunk holds at least one whole text; memory follows the longest.
    Columns other than ``doc_id`` and ``text`` are not read.

    Chunks are bucketed by number from the first on, so only questions and answers are shuffled, and a
    length's shuffles and tables go before the next but one.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]
    schema = _schema(id_type)
    with scratch.batches(TEXT_ROWS), scratch.plain():
        state = scratch.save_bucketed(chunks(docs, chunk_tokens), "lm-chunks", "shard", max(1, docs.rdd.getNumPartitions()))
    sums = state.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n = sums["n"]
    parts = max(1, -(-sums["chunks"] // CHUNKS_A_TASK))
    buckets = -(-n // bucket_tokens) + 1

    def asked(questions, name: str) -> DataFrame:
        rows = state.mapInArrow(questions, schema).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "shard")
        # written, so that the questions' shuffle can go before the answers' begins
        return scratch.save(rows.mapInArrow(_answer(floor, divergence, buckets), schema), name)

    before = "lm-chunks"
    with scratch.batches(CHUNK_ROWS), scratch.plain():
        words = asked(_ask_words(buckets), "lm-words")
        seen = words.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("v"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        v, top, still = seen["v"], seen["most"] * buckets + 1, n
        for length in range(1, depth + 2):
            # while there are many questions, one kind is answered and its shuffle gone before the other is asked
            rounds = [(_PAIRS,)] if length == 1 else [(_PAIRS, _CONTEXTS)] if buckets <= SPLIT_BUCKETS or still <= SPLIT_SHARE * n else [(_PAIRS,), (_CONTEXTS,)]
            every, names = None, []
            for k, kinds in enumerate(rounds):
                names.append(f"lm-answers-{length}-{k}")
                answers = asked(_ask(length, kinds, buckets, n, v, top), names[-1])
                every = answers if every is None else every.union(answers)
                scratch.sweep()
            if length == 1:
                every, names = every.union(words), [*names, "lm-words"]
            both = state.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(_learn(length, n, v, top, floor, depth + 1), schema)
            state = scratch.save_bucketed(both, f"lm-{length}", "shard", parts)
            scratch.drop(before, *names)
            before = f"lm-{length}"
            del answers, every, both
            scratch.sweep()
            left = state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("states"), F.coalesce(F.sum("m"), F.lit(0)).alias("left")).first()
            if not left["left"] or (length > 1 and not left["states"]):
                break
            still = left["left"]
            buckets = -(-still // bucket_tokens) + 1
        scores = state.mapInArrow(_finish(n, v), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    with scratch.batches(CHUNK_ROWS):
        out = scratch.save(scores, "lm-scores")
    scratch.drop(before)
    return out


def _finish(n: int, v: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            c = Chunk.load(row[5])
            c.place(n, v)
            total = c.score + np.bincount(c.number[c.doc[c.waiting]], weights=c.so_far(), minlength=len(c.score))
            k = len(total)
            out = [pa.array(row[6].as_py(), _ids_type(row[6].type)), pa.array(c.held > 0), pa.array(c.n_tokens, pa.int64()), pa.array(c.n_known, pa.int64()), pa.array([n] * k, pa.int64()), pa.array(c.base, pa.float64()), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run
