"""Language of a text by its words, and by ever shorter parts of words that training has not seen."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, slices

#: Lengths of n-grams, the longest first; a word is read with a space before and behind it.
GRAMS = (5, 4, 3, 2, 1)

#: Levels of the model: words, then n-grams.
LEVELS = (0, *GRAMS)

#: Words and n-grams of the model at most, dealt out evenly to the languages; with their counts they are
#: what is broadcast, about 40 MB.  The languages with the most words are learned, so many at most.
MODEL_ENTRIES = 400_000
MODEL_LANGS = 1_000

#: Distinct (language, item) pairs that a task counts before it passes them on.
HELD = 300_000
#: Entries of words that are added up at once.
CELLS = 2_000_000


def held_out() -> Column:
    """A third of the documents, by id; a null id is learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def grams(word: str, n: int) -> list[str]:
    """N-grams of a word with its ends marked; single ones are its letters."""
    marked = word if n == 1 else f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def split(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words of texts, lower-cased, as codes into their different words, and where each text begins among them.

    A word is letters and the marks behind them; what is no word is the empty one.  A null text has none."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{M}]+", " ")
    lists = pc.split_pattern(plain, " ")
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().dictionary_encode()


def real(word: str) -> str:
    """A word without marks that follow no letter."""
    while word and not word[0].isalpha():
        word = word[1:]
    return word


@lean
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, word) of each few megabytes of (lang, text)."""
    for b in batches:
        for first, texts in slices(b.column(1)):
            starts, words = split(texts)
            langs = b.column(0).slice(first, len(texts)).dictionary_encode()
            whose = np.repeat(langs.indices.to_numpy(), np.diff(starts))
            # a number for each pair, counted where it occurs
            pairs, n = np.unique(whose.astype("i8") * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
            known = pa.array([real(w) for w in words.dictionary.to_pylist()], pa.string())
            columns = [langs.dictionary.take(pa.array(pairs // len(known))), known.take(pa.array(pairs % len(known))), pa.array(n)] if len(known) else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "item", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, item, n``: words of the rows whose text and language are known, lower-cased."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    parts = rows.mapInArrow(_word_counts, "lang string, item string, n long")
    return parts.where("item <> ''").groupBy("lang", "item").agg(F.sum("n").alias("n"))


@lean
def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, n-gram) of a task's counted words, in portions of about ``HELD``."""
    seen: dict[str, Counter] = {}

    def portion() -> pa.RecordBatch:
        rows = [(lang, x, n) for lang, c in seen.items() for x, n in c.items()]
        seen.clear()
        c = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64())], ["lang", "item", "n"])

    for b in batches:
        for lang, word, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
            counter = seen.setdefault(lang, Counter())
            for n in GRAMS:
                for x in grams(word, n):
                    counter[x] += times
        if sum(map(len, seen.values())) > HELD:
            yield portion()
    yield portion()


def count_grams(words: DataFrame) -> DataFrame:
    """``lang, item, n``: n-grams of counted words."""
    parts = words.select("lang", "item", "n").mapInArrow(_gram_counts, "lang string, item string, n long")
    return parts.groupBy("lang", "item").agg(F.sum("n").alias("n"))


class Model:
    """Relative frequencies by language, of words at level 0 and of n-grams by their length.

    ``langs``: learned languages, the one with the most words first.  ``entries``: ``(level, item, lang, n)``;
    ``totals``: ``(level, lang)`` to the sum of all counts; ``full``: ``(level, lang)`` pairs whose list was cut.
    A language without an entry for an item gets a floor: half a count in the largest language of the
    level, or half of its least entry where its list was cut, for then it may have the item.  An entry is kept as
    what it has above the floor, so the model is as large as its entries, whatever the number of languages.
    """

    def __init__(self, langs: list[str], entries: list[tuple[int, str, str, int]], totals: dict[tuple[int, str], int], full: set[tuple[int, str]]):
        self.langs = langs
        place = {lang: i for i, lang in enumerate(langs)}
        least: dict[tuple[int, str], int] = {}
        for level, _, lang, n in entries:
            least[level, lang] = min(n, least.get((level, lang), n))
        self.floor = np.zeros((len(LEVELS), len(langs)))
        for k, level in enumerate(LEVELS):
            bottom = 0.5 / max([totals.get((level, lang), 0) for lang in langs] + [1])
            cut = [0.5 * least[level, lang] / totals[level, lang] if (level, lang) in full and (level, lang) in least else 0.0 for lang in langs]
            self.floor[k] = np.log(np.maximum(cut, bottom))
        #: by level, the items and where their entries begin
        self.slot: list[dict[str, int]] = [{} for _ in LEVELS]
        at, lang_of, above = [0], [], []
        for level, item, lang, n in sorted(entries):
            k = LEVELS.index(level)
            if item not in self.slot[k]:
                self.slot[k][item] = len(at) - 1
                at.append(at[-1])
            at[-1] += 1
            lang_of.append(place[lang])
            above.append(max(float(np.log(n / totals[level, lang])) - self.floor[k][place[lang]], 0.0))
        self.at, self.lang_of, self.above = np.array(at), np.array(lang_of, "i8"), np.array(above)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The level of each word (-1 for none), and by word its entries: (word, language, what it has above the floor).

        A known word has its own frequencies, an unseen one the mean over its longest n-grams of which any is
        known."""
        level = np.full(len(words), -1)
        found = []
        todo = [i for i, w in enumerate(words) if w]
        for k, n in enumerate(LEVELS):
            get, owner, slots = self.slot[k].get, [], []
            for i in todo:
                for x in (words[i],) if n == 0 else grams(words[i], n):
                    if (slot := get(x)) is not None:
                        owner.append(i)
                        slots.append(slot)
            owner, slots = np.array(owner, "i8"), np.array(slots, "i8")
            level[owner] = k
            times = np.bincount(owner, minlength=len(words))
            size = self.at[slots + 1] - self.at[slots]
            of, entry = np.repeat(owner, size), _spans(self.at[slots], size)
            found.append((of, self.lang_of[entry], self.above[entry] / times[of]))
            todo = [i for i in todo if level[i] < 0]
        return level, *(np.concatenate(c) for c in zip(*found, strict=True))

    def read(self, texts: pa.Array) -> list[tuple[str, float]]:
        """Language and its probability of each text; ``und`` and 0 for texts without letters."""
        starts, coded = split(texts)
        words = [real(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        level, of, lang, above = self.look_up(words)
        order = np.argsort(of, kind="stable")
        lang, above = lang[order], above[order]
        first = np.searchsorted(of[order], np.arange(len(words) + 1))
        # each text's different words with their numbers
        whose = np.repeat(np.arange(len(texts)), np.diff(starts))
        pairs, n = np.unique(whose * max(len(words), 1) + coded.indices.to_numpy(), return_counts=True)
        text, word = pairs // max(len(words), 1), pairs % max(len(words), 1)
        width, total = len(self.langs), np.zeros(len(texts) * len(self.langs))
        size = np.diff(first)[word]
        piece = np.cumsum(size) // CELLS
        for k in range(int(piece[-1]) + 1 if len(piece) and width else 0):
            a, b = np.searchsorted(piece, [k, k + 1])
            entry = _spans(first[word[a:b]], size[a:b])
            total += np.bincount(np.repeat(text[a:b], size[a:b]) * width + lang[entry], np.repeat(n[a:b], size[a:b]) * above[entry], len(total))
        at_level = np.bincount(text * (len(LEVELS) + 1) + level[word] + 1, n, len(texts) * (len(LEVELS) + 1)).reshape(len(texts), -1)[:, 1:]
        total = total.reshape(len(texts), width) + at_level @ self.floor
        letters = np.bincount(text, np.array([w != "" for w in words], "f8")[word], len(texts)) > 0
        out = []
        for has, row in zip(letters, total, strict=True):
            if not has or not width:
                out.append(("und", 0.0))
                continue
            best = int(row.argmax())
            out.append((self.langs[best], float(min(1 / np.exp(row - row[best]).sum(), 1.0))))
        return out


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one behind the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def fit(docs: DataFrame, scratch: Scratch, entries: int = MODEL_ENTRIES, langs: int = MODEL_LANGS) -> Model:
    """The model of the rows of ``docs``: all their words and n-grams are counted, the most frequent of each
    language make the model; items that are equally frequent are in it together or not at all.  Rows without text or language and languages without words are not learned."""
    words = scratch.save(count_words(docs), "words")
    known = [(r["lang"], r["n"]) for r in words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()]
    names = [lang for lang, _ in known]
    if not names:
        return Model([], [], {}, set())
    items = scratch.save(words.select(F.lit(0).alias("level"), "*").union(count_grams(words).select(F.length("item").alias("level"), "*")).where(F.col("lang").isin(names)), "items")
    # half of a language's entries are words, the rest is dealt to the lengths of n-grams
    share = max(entries // (2 * len(names)), 50)
    room = F.when(F.col("level") == 0, share).otherwise(share // len(GRAMS))
    # the least count whose items all fit, from how many items have each count: no task sorts a language
    alike = items.groupBy("level", "lang", "n").agg(F.count("*").alias("kinds"))
    upto = F.sum("kinds").over(Window.partitionBy("level", "lang").orderBy(F.desc("n")))
    fits = alike.withColumn("upto", upto).where(F.col("upto") <= room).groupBy("level", "lang").agg(F.min("n").alias("least"))
    top = items.join(F.broadcast(fits), ["level", "lang"]).where("n >= least")
    chosen = [(r["level"], r["item"], r["lang"], r["n"]) for r in top.select("level", "item", "lang", "n").collect()]
    sums = {(r["level"], r["lang"]): (r["n"], r["kinds"]) for r in items.groupBy("level", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    had = Counter((level, lang) for level, _, lang, _ in chosen)
    scratch.drop("words", "items")
    return Model(names, chosen, {k: n for k, (n, _) in sums.items()}, {k for k, (_, kinds) in sums.items() if kinds > had[k]})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select("doc_id", held_out().alias("held_out"), "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [x for _, texts in slices(b.column(2)) for x in sent.value.read(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Learn from the rows not held out and predict every row: ``doc_id, held_out, lang_pred, score``.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be
    learned.  A text whose letters were never seen gets the language with the most words.  Rows with a
    null language are predicted, not learned from; repeated rows count each time in training and get
    equal answers; a null id is not held out; an empty table gives no rows; other columns are not read.
    Texts are read whole, some megabytes at a time; each different word of these is scored once.
    """
    return predict(docs, fit(docs.where(~held_out()), scratch))
