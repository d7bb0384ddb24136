"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm.chargrams import BUCKETS, Words
from ctxspark.llm.common import bound_arrow, cut, text_slices

#: What a change of language costs, in the units of a word's score (mean log probability of its subwords).
SWITCH = 6.0
#: The bounded sample: at most so many languages (those of most texts) and distinct texts of each, none longer than so
#: many characters.
SAMPLE_LANGUAGES = 256
SAMPLE_PER_LANGUAGE = 400
SAMPLE_CHARS = 12_000
#: A script is a language's own if it holds this share of the letters of its sample.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"

#: Code points at which a run of one script begins (0: any script that has no number of its own).
_SCRIPTS = ((0x00, 0), (0x41, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xA00, 0), (0xB80, 9), (0xC00, 0), (0xE00, 10), (0xE80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x1380, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 14), (0x3100, 0), (0x3400, 15), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 15), (0xFB00, 0))
#: The number of letters of any other script; 0 is what has no letter.
OTHER = 16
N_SCRIPTS = 17


@lru_cache(maxsize=1)
def code_scripts() -> np.ndarray:
    """Per code point its script if it is a letter (a Unicode category that begins with L), else 0."""
    starts, of = np.array([a for a, _ in _SCRIPTS]), np.array([s or OTHER for _, s in _SCRIPTS], np.int8)
    code = np.arange(sys.maxunicode + 1)
    return of[np.searchsorted(starts, code, "right") - 1] * np.fromiter(map(str.isalpha, map(chr, code.tolist())), np.int8, len(code))


def word_scripts(words: Words) -> np.ndarray:
    """Per word the highest script number of its letters; 0 if it has none."""
    b = words.bytes.astype(np.int32)
    script, table = np.zeros(len(b), np.int8), code_scripts()
    one = np.flatnonzero((b >= 0x61) & (b <= 0x7A))
    script[one] = 1
    for size, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF5)):
        at = np.flatnonzero((b[: 1 - size] >= low) & (b[: 1 - size] < high))
        code = b[at] - (low if size > 2 else 0xC0)
        for k in range(1, size):
            code = code << 6 | b[at + k] & 0x3F
        script[at] = table[np.minimum(code, sys.maxunicode)]
    if not len(words.start):
        return np.empty(0, np.int8)
    both = np.stack([words.start, words.end], 1).ravel()
    return np.maximum.reduceat(script, both)[::2]


@dataclass
class LanguageModel:
    """tables: per language the log probability of each subword bucket; scripts: which language uses which script."""

    languages: list[str]
    tables: list[np.ndarray]
    scripts: np.ndarray
    switch: float = SWITCH

    def word_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages, whether the word has letters). Languages that don't use the word's script are far
        behind, unless none does, and subwords alone decide; a word without letters says nothing."""
        scores = np.stack(words.word_means(*self.tables), 1).astype(np.float64)
        script = word_scripts(words)
        use = self.scripts[:, script].T
        use[~use.any(1)] = True
        scores -= np.where(use, 0, 4 * self.switch)
        scores[script == 0] = 0
        return scores, script > 0

    def label(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi: the languages of consecutive words, with switch off for each change. One language throughout is the
        best path if no other one gains more than half a switch on it over any stretch, since a path of m stretches has
        m - 1 switches; only else the path is searched."""
        total = scores.sum(0)
        top = int(total.argmax())
        gain = np.cumsum(scores - scores[:, top : top + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(gain, axis=0) - 0.0, 0.0)
        low = np.vstack([np.zeros(gain.shape[1]), low[:-1]])
        if (gain - low).max() <= self.switch / 2:
            return np.full(len(scores), top)
        n, width = scores.shape
        rows, best, cost = scores.tolist(), [0.0] * width, self.switch
        stay, came = np.ones((n, width), bool), np.zeros(n, np.int64)
        span = range(width)
        for t, s in enumerate(rows):
            m = max(best)
            came[t] = best.index(m)
            turn = m - cost
            if min(best) < turn:
                for k in span:
                    if best[k] < turn:
                        best[k] = turn
                        stay[t, k] = False
            best = [best[k] + s[k] for k in span]
        out = np.empty(n, np.int64)
        k = best.index(max(best))
        for t in range(n - 1, -1, -1):
            out[t] = k
            if not stay[t, k]:
                k = int(came[t])
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """(language, score) per text: the language of most words (ties to the first by name) and its share of them. A
        text without any letter is unknown with score 0."""
        words = Words(texts)
        out, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return out, share
        scores, lettered = self.word_scores(words)
        ends = np.cumsum(words.count)
        for i, (b, n) in enumerate(zip(ends.tolist(), words.count.tolist())):
            own = scores[b - n : b][lettered[b - n : b]]
            if len(own):
                votes = np.bincount(self.label(own), minlength=len(self.languages))
                k = int(votes.argmax())
                out[i], share[i] = self.languages[k], votes[k] / len(own)
        return out, share

    def spans(self, text: bytes) -> list[tuple[int, int, str]]:
        """(first word, words, language) of each stretch of one language."""
        words = Words([text])
        scores, _ = self.word_scores(words)
        if not len(scores):
            return []
        path = self.label(scores)
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [(a, b - a, self.languages[path[a]]) for a, b in zip(cuts, cuts[1:])]


def fit(texts: list[bytes], languages: list[str], switch: float = SWITCH) -> LanguageModel:
    """Smoothed log probabilities of subwords per language, each centred on the mean over languages."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], [], np.zeros((0, N_SCRIPTS), bool), switch)
    tables, scripts = [], np.zeros((len(names), N_SCRIPTS), bool)
    for k, name in enumerate(names):
        count, letters = np.zeros(BUCKETS), np.zeros(N_SCRIPTS)
        own = [t for t, x in zip(texts, languages) if x == name]
        for i in range(0, len(own), 100):
            words = Words(own[i : i + 100])
            letters += np.bincount(word_scripts(words), minlength=N_SCRIPTS)
            for bucket, inside in words.grams():
                count += np.bincount(bucket[inside], minlength=BUCKETS)
        letters[0] = 0
        scripts[k] = letters >= SCRIPT_SHARE * max(1, letters.sum())
        scripts[k, 0] = True
        tables.append(np.log((count + 0.5) / (count.sum() + 0.5 * BUCKETS)))
    mean = np.mean(tables, axis=0)
    return LanguageModel(names, [(t - mean).astype(np.float32) for t in tables], scripts, switch)


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, languages: int = SAMPLE_LANGUAGES, chars: int = SAMPLE_CHARS) -> tuple[list[bytes], list[str]]:
    """docs: (text, lang). Of the languages with most distinct texts, so many at most, the per_language distinct texts of
    the smallest hash each, none longer than chars. No more than these reach the driver, however often a text repeats;
    rows with nulls give nothing."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= chars))
    known = known.select("lang", "text", F.xxhash64("text", F.lit(5)).alias("h"))
    texts = cut(known.select("lang", "h").distinct())
    most = texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = texts.join(F.broadcast(most), "lang").withColumn("place", place).where(F.col("place") <= per_language).select("lang", "h")
    # the list is bounded by its two parameters, so it may be broadcast
    rows = known.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).collect()
    return [r.text.encode() for r in rows], [r.lang for r in rows]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): one row per row of docs; null, empty and letterless texts are unknown (letters are what
    Unicode calls so, digits and signs of any script are none). Letters of a script that no language of the sample uses
    are judged by their subwords alone. Other columns are not read; repeated rows stay; an empty table gives an empty
    result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, limit=1 << 20):
            lang, share = model.predict(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64())], ["id", "lang_pred", "score"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def language_spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, span, first_word, n_words, lang): the stretches of one language in each text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, limit=1 << 20):
            found = [(i, k, *s) for i, t in enumerate(texts) for k, s in enumerate(model.spans(t))]
            i, k, a, n, lang = zip(*found) if found else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(i, pa.int64())), *(pa.array(x, pa.int64()) for x in (k, a, n)), pa.array(lang, pa.string())], ["id", "span", "first_word", "n_words", "lang"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, span long, first_word long, n_words long, lang string")
