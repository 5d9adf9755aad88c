"""Toxicity by noisy-channel deobfuscation.

1. Every text of the corpus is counted into a character 4-gram table (Spark sums the tasks' counts); its size is bounded by
   the alphabet, 28 symbols to the fourth power, whatever the corpus.
2. Suspicious spans of a text - words with digits or signs for letters, letters spaced or dotted apart, letters repeated
   three times or more - become lattices: every observed character offers the letters it may stand for, a separator may be
   dropped, a run may be one or two letters. Viterbi picks the path of the best language-model plus channel score.
3. The restored text is scored: a logistic model over the words and word-internal n-grams whose presence goes with the
   label, chosen and weighed on a bounded sample of labelled documents (`sample_rows`, 3000 by default).

Defined results: null and empty texts restore to the empty text and get the score of no evidence; a sample with one class or
none gives every text the smoothed share of label 1; repeated rows are scored independently; an empty table gives an empty
table; a null doc_id is not held out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Symbols of the language model: 0 is a word's border, 1 to 26 are a to z, 27 is any other letter.
SYMBOLS = 28
OTHER = 27

#: Which letters a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "µ": "u",
}

#: Log-probability lost by each channel step.
SIGN_COST, DROP_COST, RUN_COST, DOUBLE_COST = -0.7, -0.2, -0.5, -2.0

_SIGN_CLASS = re.escape("".join(SIGNS))
_SEPARATORS = r"._\-*~,/"
#: Inside a token: a word with signs, or letters with separators between them.
SIGNED = re.compile(rf"(?:[^\W\d_]|[{_SIGN_CLASS}])+")
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_SIGN_CLASS}])(?:[{_SEPARATORS}](?:[^\W_]|[{_SIGN_CLASS}])){{2,}}(?![^\W_])")
#: Three or more tokens of one character each.
SPACED_OUT = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
PLAIN = re.compile(rf"[^\W\d_]*[^\w{_SIGN_CLASS}]*")
RUN = re.compile(r"([^\W\d_])\1\1")
SIGN = re.compile(rf"[{_SIGN_CLASS}]")
WORDS = re.compile(r"[^\W\d_]+")
TOKENS = re.compile(r"\s+|\S+")

#: Distinct tokens that a task remembers at once.
CACHE_TOKENS = 300_000


def _codes() -> np.ndarray:
    """Symbol of each code point of the basic plane: letters by their base letter, all else the border."""
    table = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower()
            table[i] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_codes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 1 << 16, _TABLE[0][np.minimum(points, (1 << 16) - 1)], OTHER).astype(np.int64)


def char_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): the 4-grams of symbols of all texts; gram is the number with these four digits in base 28."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            s = symbols("\n\n\n".join(["", *(x for x in batch[text] if x), "\n"]))  # three borders before each text
            if len(s) > 3:
                gram = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
                total += np.bincount(gram, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "n": total[seen]})

    return docs.select(text).mapInPandas(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """Interpolated 4-gram log-probabilities, indexed by three symbols of context and the next one."""

    log: np.ndarray

    @classmethod
    def of(cls, counts: pd.DataFrame, strength: float = 5.0) -> CharModel:
        table = np.zeros(SYMBOLS**4)
        table[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(1, 5):
            n = table.reshape(-1, SYMBOLS**order).sum(0).reshape(-1, SYMBOLS)
            below = np.broadcast_to(p.reshape(1, -1), (1, SYMBOLS)) if order == 1 else np.tile(p, (n.shape[0] // p.shape[0], 1)) if p.ndim == 2 else np.tile(p, (n.shape[0], 1))
            p = (n + strength * below) / (n.sum(1, keepdims=True) + strength)
        return cls(np.log(p).astype(np.float32))


#: Strings of letters, their symbols, channel score.
Option = tuple[str, tuple[int, ...], float]


@lru_cache(4096)
def codes_of(string: str) -> tuple[int, ...]:
    return tuple(symbols(string).tolist()) if string else ()


def _option(string: str, cost: float) -> Option:
    return string, codes_of(string), cost


def lattice(span: str, spaced: bool) -> Iterator[list[Option]]:
    """Per observed position the strings it may stand for, with their channel scores."""
    for c, run in groupby(span.lower()):
        n = len(list(run))
        if c.isalpha():
            found = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, DOUBLE_COST)] if n == 2 else [(c, RUN_COST), (c * 2, 2 * RUN_COST)]
        elif c in SIGNS:
            found = [(x * k, SIGN_COST + (k - 1) * DOUBLE_COST) for x in SIGNS[c] for k in range(1, min(n, 2) + 1)] + [("", 3 * SIGN_COST)]
        else:
            found = [("", DROP_COST * n)] if spaced else [(" ", 0.0)]
        yield [_option(x, cost) for x, cost in found]


def decode(steps: Iterable[list[Option]], log: Sequence[float]) -> str:
    """The best restored string: Viterbi over the last three symbols, from a word's border to a word's border."""
    alive: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in steps:
        after: dict[int, tuple[float, tuple | None]] = {}
        for context, (score, path) in alive.items():
            for string, codes, cost in options:
                state, value = context, score + cost
                for s in codes:
                    at = state * SYMBOLS + s
                    value += log[at]
                    state = at % SYMBOLS**3
                if state not in after or value > after[state][0]:
                    after[state] = (value, (path, string))
        alive = after
    _, path = max(alive.items(), key=lambda kv: kv[1][0] + log[kv[0] * SYMBOLS])[1]
    parts = []
    while path:
        path, string = path
        parts.append(string)
    return "".join(reversed(parts))


class Restorer:
    """Restores texts. White space parts what is decoded on its own, but for letters that white space spaces out."""

    def __init__(self, model: CharModel) -> None:
        self.log = memoryview(np.ascontiguousarray(model.log, np.float32).ravel())

    def span(self, span: str, spaced: bool) -> str:
        return decode(lattice(span, spaced), self.log)

    def _word(self, word: str) -> str:
        """A run of letters and signs: decoded if it has letters, and either signs before or among them or a long run."""
        core = word.rstrip("!|+(<")
        if not WORDS.search(core) or not (SIGN.search(core) or RUN.search(core)):
            return word
        return self.span(core, False) + word[len(core) :]

    def token(self, token: str) -> str:
        """A lower-case token without white space."""
        if PLAIN.fullmatch(token) and not RUN.search(token):
            return token
        token = SPACED.sub(lambda m: self.span(m[0], True), token)
        return SIGNED.sub(lambda m: self._word(m[0]), token)

    def joined(self, text: str | None) -> str:
        """The text in lower case, spaced-out letters joined and decoded."""
        return SPACED_OUT.sub(lambda m: self.span(m[0], True), text.lower()) if text else ""

    def restore(self, text: str | None) -> str:
        """The text in lower case with its suspicious spans decoded."""
        return "".join(x if x.isspace() else self.token(x) for x in TOKENS.findall(self.joined(text)))


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 3000
    ngrams: tuple[int, ...] = (4, 5)
    least_docs: int = 4
    least_evidence: float = 12.0
    passes: int = 300
    ridge: float = 0.02


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    bias: float
    settings: Settings


def word_features(word: str, ngrams: tuple[int, ...]) -> set[str]:
    marked = f"<{word}>"
    return {marked} | {marked[i : i + n] for n in ngrams for i in range(len(marked) - n + 1)}


def text_features(restored: str, ngrams: tuple[int, ...], known: dict[str, set[str]]) -> set[str]:
    found: set[str] = set()
    for word in set(WORDS.findall(restored)):
        if word not in known:
            known[word] = word_features(word, ngrams)
        found |= known[word]
    return found


def marked_words(words: Iterable[str]) -> str:
    """Distinct words between their marks: every feature of theirs is a piece of this text."""
    return f"<{'><'.join(sorted(set(words)))}>"


def finder_of(names: Sequence[str]) -> ahocorasick.Automaton:
    """Finds the numbers of the named features in marked words."""
    finder = ahocorasick.Automaton()
    for i, name in enumerate(names):
        finder.add_word(name, i)
    finder.make_automaton()
    return finder


def evidence(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio (G squared) of presence in a of n1 toxic and b of n0 other documents."""
    total, n = a + b, n1 + n0
    g = np.zeros(len(a))
    for seen, size in ((a, n1), (b, n0)):
        for x, share in ((seen, total / n), (size - seen, 1 - total / n)):
            g += 2 * np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(size * share, 1e-9)), 0)
    return g


def train(restored: list[str], labels: list[int], chars: CharModel, s: Settings = Settings()) -> Model:
    """Chooses features whose presence goes with label 1 and fits a ridge logistic model on them by Newton-like steps."""
    y = np.array(labels, np.float64)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    bias = float(np.log((n1 + 1) / (n0 + 1)))
    if not n1 or not n0:
        return Model(chars, {}, bias, s)
    known: dict[str, set[str]] = {}
    seen = Counter(f for x, v in zip(restored, y, strict=True) if v for f in text_features(x, s.ngrams, known))
    names = sorted(f for f, n in seen.items() if n >= s.least_docs)
    del known, seen
    if not names:
        return Model(chars, {}, bias, s)
    finder = finder_of(names)
    rows = [np.array(sorted({i for _, i in finder.iter(marked_words(WORDS.findall(x)))}), np.int64) for x in restored]
    a, b = np.zeros(len(names)), np.zeros(len(names))
    for ids, v in zip(rows, y, strict=True):
        (a if v else b)[ids] += 1
    keep = (evidence(a, b, n1, n0) >= s.least_evidence) & (a / n1 > 4 * b / n0)
    number = np.cumsum(keep) - 1
    rows = [number[ids[keep[ids]]] for ids in rows]
    names = [n for n, k in zip(names, keep, strict=True) if k]
    owner, feature = [], []
    for i, ids in enumerate(rows):
        owner += [i] * len(ids)
        feature += ids.tolist()
    owner, feature = np.array(owner, np.int64), np.array(feature, np.int64)
    # a document's features share its evidence, so that a word and its n-grams together count about once
    w, met, met_b = np.zeros(len(names)), np.full(len(names), 1e-8), 1e-8
    for _ in range(s.passes if len(names) else 0):
        z = bias + np.bincount(owner, weights=w[feature], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(feature, weights=error[owner], minlength=len(names)) + s.ridge * len(y) / 100 * w
        met += g * g
        met_b += float(error.sum()) ** 2
        w -= 0.3 * g / np.sqrt(met)
        bias -= 0.3 * float(error.sum()) / np.sqrt(met_b)
    return Model(chars, {f: float(x) for f, x in zip(names, w, strict=True) if x}, bias, s)


def restored(text: Column, chars: CharModel) -> Column:
    """The restored text of a text column."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restore = Restorer(chars).restore
        for texts in batches:
            yield pd.Series([restore(x) for x in texts], dtype=object)

    return decoded(text)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 of a text column, by its restored form."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer, weights = Restorer(model.chars), model.weights
        known: dict[str, frozenset[str]] = {}
        names = list(weights)
        finder = finder_of(names) if names else None

        def found(token: str) -> frozenset[str]:
            if len(known) >= CACHE_TOKENS:
                known.clear()
            words = WORDS.findall(restorer.token(token))
            kept = frozenset(names[i] for _, i in finder.iter(marked_words(words))) if words and finder else frozenset()
            if len(token) <= common.REMEMBERED_CHARS:
                known[token] = kept
            return kept

        def logit(x: str | None) -> float:
            seen: set[str] = set()
            for token in set(restorer.joined(x).split()):
                kept = known.get(token)
                if kept is None:
                    kept = found(token)
                if kept:
                    seen |= kept
            return model.bias + sum(weights[f] for f in sorted(seen))

        for texts in batches:
            z = np.array([logit(x) for x in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return scored(text)


def char_model(docs: DataFrame) -> CharModel:
    """Counts all texts; what comes to the driver is bounded by the alphabet."""
    return CharModel.of(char_counts(docs).toPandas())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Model:
    chars = char_model(docs)
    sample = common.labelled_sample(docs, labels, label, settings.sample_rows)
    rows = sample.select("doc_id", restored(F.col("text"), chars).alias("text"), "label").orderBy("doc_id", "text").toPandas()
    return train(rows["text"].tolist(), rows["label"].tolist(), chars, settings)


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with score and predicted; columns of these names are replaced."""
    return docs.withColumn("score", score(F.col("text"), model)).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def score_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, as the contract of op2 names them."""
    model = fit(docs, labels, "toxic", settings)
    return classify(docs.select("doc_id", "text"), model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
