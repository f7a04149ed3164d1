"""Quality classifier from weak labels.

Heuristic labellers vote good or bad on a text or abstain.  Expectation-maximisation over
the counts of vote patterns estimates how each labeller votes on hidden kinds of texts, good and
bad ones, with no true label seen.  The posterior of a text's votes is its soft label, and a linear
scorer over hashed word shapes is trained on these; the scorer decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, without

#: Hashed features of the scorer.
DIMS = 1 << 14
#: Texts the scorer is fitted on, drawn by hash.  Votes and EM use all texts.
FIT_ROWS = 8000
#: Score below which a text is rejected.
LEAST = 0.5

#: Words of a window of the variety labeller; texts of fewer words get no opinion of it, nor of the stop words'.
WINDOW = 40

LABELLERS = ("symbols", "capitals", "exclamations", "separators", "repeats", "variety", "stops", "lines", "plain", "marks")

STOP_WORDS = frozenset(
    """the a an and or of to in on at by for from with as is are was be it this that le la les un une des du de et dans sur pour par avec est qui que en au
    der die das ein eine dem den des und oder im mit von zu ist nicht sich auf el los las una del y con por para es no se su""".encode().split()
)
_SYMBOLS = re.compile(rb"[#*$%&|<>~^=+_\\@]")
_PLAIN = re.compile(r"[\"'(“‘«¿¡]*[^\W_]+(?:['’\-.][^\W_]+)*[.,;:!?)\"'”’»…]*")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SHAPE = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


class Kinds(dict):
    """Kinds of words: a shape and what the labellers ask.  A kind is a small number."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most
        self.known: dict[tuple, int] = {}
        self.rows: list[tuple] = []
        self.flags = np.zeros((0, 6), bool)
        self.hashes = np.zeros(0, "u8")

    def settle(self) -> None:
        """Bring the arrays up to the kinds met; call it before they are read."""
        if len(self.rows) > len(self.hashes):
            fresh = self.rows[len(self.hashes) :]
            self.flags = np.vstack([self.flags, np.array([f for f, _ in fresh], bool)])
            self.hashes = np.append(self.hashes, np.array([h for _, h in fresh], "u8"))

    def trim(self) -> None:
        """Forget everything when much is held; numbers given before are void then."""
        if len(self) > self.most or len(self.rows) > self.most:
            self.clear()
            self.known.clear()
            self.rows, self.flags, self.hashes = [], self.flags[:0], self.hashes[:0]

    def __missing__(self, word: bytes) -> int:
        import xxhash

        shape = word
        for find, put in _SHAPE:
            shape = find.sub(put, shape)
        shape = re.sub(rb"([^aA0])\1+", rb"\1\1", shape)
        letters = word.decode("utf-8", "replace")
        flags = (bool(_SYMBOLS.search(word)) and any(x.isalnum() for x in letters), len(word) > 2 and letters.isupper(), b"!" in word, not any(x.isalnum() for x in letters), word.lower().strip(b".,;:!?") in STOP_WORDS, bool(_PLAIN.fullmatch(letters)))
        key = (shape, flags)
        k = self.known.get(key)
        if k is None:
            k = self.known[key] = len(self.rows)
            self.rows.append((flags, xxhash.xxh3_64_intdigest(shape)))
        self[word] = k
        return k


def _vote(share: float, good: float, bad: float) -> str:
    return "b" if share >= bad else "g" if share <= good else "-"


def votes(words: list[bytes], flags: np.ndarray, text: str) -> str:
    """One letter a labeller: g, b or - (no opinion)."""
    n = len(words)
    if not n:
        return "-" * len(LABELLERS)
    symbols, capitals, bangs, bare, stops, plain = (flags.sum(axis=0) / n).tolist()
    repeats = sum(map(eq, words[1:], words)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    # long texts have few different words by nature, windows of them do not
    windows = n // WINDOW
    variety = sum(len(set(words[k * WINDOW : (k + 1) * WINDOW])) for k in range(windows)) / max(windows * WINDOW, 1)
    raw = b"".join(words)
    marks = 1 - len(raw.translate(None, _MARKS)) / len(raw)
    return "".join(
        (
            _vote(symbols, 0.05, 0.25),
            _vote(capitals, 0.1, 0.5),
            _vote(bangs, 0.05, 0.25),
            _vote(bare, 0.02, 0.2),
            _vote(repeats, 0.05, 0.25),
            "-" if not windows else _vote(1 - variety, 0.5, 0.7),
            "-" if not windows else "g" if stops >= 0.1 else "-",
            "-" if len(lines) < 4 else _vote(1 - len(set(lines)) / len(lines), 0.3, 0.6),
            _vote(1 - plain, 0.15, 0.3),
            _vote(marks, 0.07, 0.12),
        )
    )


def features(ids: np.ndarray, repeats: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: root shares of word shapes, of neighbouring shapes, and of repeats."""
    if not len(ids):
        return np.zeros(0, "<u2"), np.zeros(0, "<f4")
    one = hashes[ids]
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    mixed = np.concatenate([one, two * np.uint64(0xD6E8FEB86659FD93)]) >> np.uint64(50)
    at, n = np.unique(mixed, return_counts=True)
    share = np.sqrt(n / len(ids))
    at = np.append(at, np.uint64(DIMS - 1))
    return at.astype("<u2"), np.append(share, np.sqrt(repeats / len(ids))).astype("<f4")


def read(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, votes, at, value`` of every text; a null text is empty."""
    picked = docs.select("doc_id", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds()
        for b in batches:
            out = []
            for cell in b.column(1):
                text = cell.as_py() or ""
                words = text.encode().split()
                kinds.trim()
                ids = np.fromiter(map(kinds.__getitem__, words), "i8", len(words))
                kinds.settle()
                at, value = features(ids, sum(map(eq, words[1:], words)), kinds.hashes)
                out.append((len(words), votes(words, kinds.flags[ids], text), at.tobytes(), value.tobytes()))
            c = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], ["doc_id", "n_words", "votes", "at", "value"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, n_words long, votes string, at binary, value binary")


#: Votes that the prior of a kind adds for each of the two labellers that started it.
SEEN = 30


class LabelModel:
    """How each labeller votes on texts of several hidden kinds, by expectation-maximisation.

    Junk is of several kinds, each seen by a few labellers, so votes are dependent given that a
    text is bad.  They are taken as independent given its kind, and an opinion not given says
    nothing.  The number of kinds is found, too: from one kind on, votes that come together more
    often than the kinds so far explain start another, EM is run to its end, and the kinds grow as
    long as that lowers the Bayesian information criterion, which sets no bound of its own.  A kind is bad
    if some labeller mostly votes bad on it.

    Two labellers that see a kind and eight that do not leave its share and their accuracies on it open:
    many values explain the votes equally well.  A prior settles that: the two votes that started a kind
    count as ``SEEN`` votes more of it, nine in ten of them as cast.
    """

    def __init__(self, counts: dict[str, int], rounds: int = 300):
        patterns = sorted(counts)
        self.n = np.array([counts[p] for p in patterns], float)
        self.hot = self._votes(patterns)
        self.shares, self.theta = np.ones(1), np.full((1, len(LABELLERS), 2), 0.5)
        if len(patterns):
            # one vote of each sort is added a kind and labeller
            prior = np.ones_like(self.theta)
            kept = (*self._run(np.ones((1, len(patterns))), prior, rounds), prior)
            while True:
                tried = ((*self._run(part, prior, rounds), prior) for part, prior in self._splits(*kept))
                better = next((x for x in tried if self._criterion(*x[:2]) < self._criterion(*kept[:2])), None)
                if better is None:
                    break
                kept = better
            self.shares, self.theta, _ = kept
        self.bad = (self.theta[:, :, 1] > 0.5).any(axis=1) if len(patterns) else np.zeros(1, bool)

    @staticmethod
    def _votes(patterns: list[str]) -> np.ndarray:
        """Pattern, labeller, vote good or bad; no opinion is all zero."""
        x = np.array([["gb-".index(v) for v in p] for p in patterns], int).reshape(len(patterns), len(LABELLERS))
        return np.eye(3)[x][:, :, :2]

    def _joint(self, shares: np.ndarray, theta: np.ndarray, hot: np.ndarray) -> np.ndarray:
        return np.log(shares)[:, None] + np.einsum("clv,plv->cp", np.log(theta), hot)

    def _run(self, part: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """EM from how much each pattern belongs to each kind; ``prior`` votes are added."""
        shares = theta = None
        for _ in range(rounds):
            w = part * self.n
            shares = (w.sum(axis=1) + 1) / (w.sum() + len(w))
            theta = np.einsum("cp,plv->clv", w, self.hot) + prior
            theta = theta / theta.sum(axis=2, keepdims=True)
            logs = self._joint(shares, theta, self.hot)
            logs -= logs.max(axis=0)
            fresh = np.exp(logs)
            fresh /= fresh.sum(axis=0)
            if np.abs(fresh - part).max() < 1e-9:
                break
            part = fresh
        return shares, theta

    def _splits(self, shares: np.ndarray, theta: np.ndarray, prior: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The kinds so far and one more, with the prior.  It starts with the texts that have both votes of a
        pair in excess of what the kinds so far lead one to expect, the pair most in excess first."""
        joint = np.exp(self._joint(shares, theta, self.hot))
        part = joint / joint.sum(axis=0)
        flat = self.hot.reshape(len(self.n), -1)
        cast = self.hot.sum(axis=2)
        seen = np.einsum("p,pi,pj->ij", self.n, flat, flat)
        expected = np.zeros_like(seen)
        for k in range(len(shares)):
            # votes expected where both labellers have an opinion
            both = np.einsum("p,pl,pm->lm", self.n * part[k], cast, cast)
            expected += np.repeat(np.repeat(both, 2, 0), 2, 1) * np.outer(theta[k].ravel(), theta[k].ravel())
        same = np.repeat(np.repeat(np.eye(len(LABELLERS), dtype=bool), 2, 0), 2, 1)
        excess = np.where(same, -np.inf, (seen - expected) / np.sqrt(expected + 1.0))
        for at in np.argsort(-excess, axis=None).tolist():
            i, j = np.unravel_index(at, excess.shape)
            if excess[i, j] < 2:
                return
            if i < j:
                new = np.where((flat[:, i] > 0) & (flat[:, j] > 0), 0.9, 0.01)
                own = np.ones((len(LABELLERS), 2))
                for vote in (i, j):
                    own[vote // 2] = SEEN * 0.1
                    own[vote // 2, vote % 2] = SEEN * 0.9
                yield np.vstack([part * (1 - new), new[None]]), np.concatenate([prior, own[None]])

    def _criterion(self, shares: np.ndarray, theta: np.ndarray) -> float:
        logs = self._joint(shares, theta, self.hot)
        top = logs.max(axis=0)
        likelihood = float((self.n * (top + np.log(np.exp(logs - top).sum(axis=0)))).sum())
        return -2 * likelihood + (len(shares) * (len(LABELLERS) + 1) - 1) * np.log(max(self.n.sum(), 1.0))

    def good(self, pattern: str) -> float:
        """Posterior probability that a text with these votes is good."""
        logs = self._joint(self.shares, self.theta, self._votes([pattern]))[:, 0]
        p = np.exp(logs - logs.max())
        return float(p[~self.bad].sum() / p.sum())

    def accuracy(self) -> dict[str, tuple[float, float]]:
        """By labeller: share of good votes on good texts, and of bad votes on bad texts, among votes cast."""
        logs = self._joint(self.shares, self.theta, self.hot) if len(self.n) else np.zeros((1, 0))
        part = np.exp(logs - logs.max(axis=0)) if len(self.n) else logs
        part = part / part.sum(axis=0) * self.n if len(self.n) else part
        cast = np.einsum("cp,plv->clv", part, self.hot)
        good, bad = cast[~self.bad].sum(axis=0), cast[self.bad].sum(axis=0)
        share = lambda x, v: float((x[v] + 1) / (x.sum() + 2))
        return {name: (share(good[i], 0), share(bad[i], 1)) for i, name in enumerate(LABELLERS)}


class Scorer:
    """Logistic regression over hashed features, by accelerated gradient steps."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 400, ridge: float = 1e-4):
        self.w, self.b = np.zeros(DIMS), 0.0
        if not len(rows):
            return
        at = np.concatenate([r[0] for r in rows]).astype("i8")
        value = np.concatenate([r[1] for r in rows]).astype(float)
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        n = len(rows)
        # classes weigh alike, whichever is rare
        weight = target / max(target.sum(), 1.0) + (1 - target) / max((1 - target).sum(), 1.0)
        weight *= 0.5
        norm = np.bincount(row, weights=value**2, minlength=n).max() + 1.0
        step = 4.0 / norm  # the weights sum to one, so the loss bends by norm / 4 at most
        w, b, pw, pb = self.w, self.b, self.w, self.b
        for k in range(1, rounds + 1):
            m = (k - 1) / (k + 2)
            yw, yb = w + m * (w - pw), b + m * (b - pb)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=value * yw[at], minlength=n) + yb, -60, 60)))
            e = weight * (p - target)
            pw, pb = w, b
            w = yw - step * (np.bincount(at, weights=value * e[row], minlength=DIMS) + ridge * yw)
            b = yb - step * e.sum()
        self.w, self.b = w, float(b)

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(value @ self.w[at] + self.b, -60, 60))))


def classify(docs: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS, least: float = LEAST) -> DataFrame:
    """``doc_id, n_words, votes, weak_label, score, kept`` for every row.

    ``weak_label`` is the posterior that the text is good given its votes, ``score`` the
    scorer's probability, ``kept`` whether it reaches ``least``.  Null and empty texts get no
    vote and the score of an empty text; repeated rows get equal scores; an empty table gives no
    rows; texts are read whole; other columns, whatever their names, are neither read nor returned.  The driver gets at most 3^10 vote patterns and ``fit_rows`` feature rows.
    """
    spark = docs.sparkSession
    rows = scratch.save(read(docs), "votes")
    counts = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    model = LabelModel(counts)
    weak = {p: model.good(p) for p in counts}
    # a share of the rows by hash, so each task sends what it has of the sample and no more
    part = min(1.0, 1.3 * fit_rows / max(sum(counts.values()), 1))
    drawn = rows.select("votes", "at", "value", F.xxhash64("doc_id", "at").alias("h")).where(F.pmod("h", F.lit(1_000_000)) < int(part * 1_000_000) + 1)
    drawn = drawn.orderBy("h", "votes").limit(fit_rows).collect()
    scorer = Scorer([(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["value"], "<f4")) for r in drawn], np.array([weak[r["votes"]] for r in drawn]))
    sent = spark.sparkContext.broadcast((weak, scorer))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, scorer = sent.value
        for b in batches:
            marks = [weak[v] for v in b.column(2).to_pylist()]
            scores = [scorer.score(np.frombuffer(a, "<u2"), np.frombuffer(v, "<f4")) for a, v in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(marks, pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= least for s in scores], pa.bool_())], ["doc_id", "n_words", "votes", "weak_label", "score", "kept"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, votes string, weak_label double, score double, kept boolean")


def keep_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns only; rows without id stay."""
    return without(docs, classify(docs, scratch).where("NOT kept").select("doc_id"), scratch, "classifier-rejects")
