"""Operator 8: language identification by a linear-chain conditional random field over words.

The chain is a sentence (a line or what ends with . ! or ?), however long. A word's scores come from hashed features (64 bits):
the folded word itself (lexicon), its prefixes and suffixes of one to four characters (affixes), its inner character
bigrams and trigrams (n-grams) and its letter case. Transitions between languages are learned with them, from sentences
of labelled documents and from joins of two sentences of different languages (code-switched text), by
maximum likelihood; forward-backward gives each word's language distribution. A document's language is the one with
the most words in expectation, its score that share.

Training takes a bounded sample of labelled rows (``per_language``, chosen by hash), whole texts; nothing else is
bounded. Defined results: null text or text without a letter is ``und`` with score 0; without any labelled row every
document is ``und``; ties go to the language first in order; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import U, mix, take_over, text_slices

_SENTENCE = re.compile(r"[\n.!?]+")
_EDGE = ".,;:!?()[]\"'|*#&%$"
#: Base of the features' keys, and its inverse modulo 2**64.
_STEP = U(0xD6E8FEB86659FD93)
_BACK = U(pow(int(_STEP), -1, 1 << 64))
#: Characters of words whose features are made at once, in a batch.
_AT_ONCE = 1 << 17


def core(word: str) -> str:
    return word.lower().strip(_EDGE)


def char_values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + U(0x9E3779B97F4A7C15))


def key(feature: str) -> np.uint64:
    """64-bit key of a feature; that of the empty one is 0."""
    values = char_values(np.array(list(map(ord, feature)), dtype=np.uint32))
    return functools.reduce(lambda h, v: U((int(h) * int(_STEP) + int(v)) & (1 << 64) - 1), values[::-1], U(0))


def feature_keys(lows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of folded words' features, word after word, and how many each word has.

    Of a word, in this order: the empty feature, which all have, the word after a w, its first one to four characters
    after a p, its last ones after an s, its bigrams and its trigrams. A string's key is its polynomial in ``_STEP``, so
    sums over all characters give the key of every part.
    """
    n = np.fromiter(map(len, lows), dtype=np.int64, count=len(lows))
    ends = np.cumsum(n)
    starts, most = ends - n, np.minimum(n, 4)
    codes = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    powers = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(codes), _STEP)]))
    back = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(codes), _BACK)]))
    sums = np.concatenate([[U(0)], np.cumsum(char_values(codes) * powers[:-1], dtype=np.uint64)])
    sizes = 2 + 2 * most + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
    at = np.cumsum(sizes) - sizes
    keys = np.zeros(int(sizes.sum()), dtype=np.uint64)
    w, p, s = char_values(np.array(list(map(ord, "wps")), dtype=np.uint32))
    keys[at + 1] = w + _STEP * ((sums[ends] - sums[starts]) * back[starts])
    for i in range(1, 5):
        have = np.flatnonzero(n >= i)
        a, b, to = starts[have], ends[have], at[have] + 1 + i
        keys[to] = p + _STEP * ((sums[a + i] - sums[a]) * back[a])
        keys[to + most[have]] = s + _STEP * ((sums[b] - sums[b - i]) * back[b - i])
    left = np.repeat(ends, n) - np.arange(len(codes))  # characters to the word's end, this one included
    to = np.repeat(at + 2 + 2 * most - starts, n) + np.arange(len(codes))
    for i in (2, 3):
        a = np.flatnonzero(left >= i)
        keys[to[a]] = (sums[a + i] - sums[a]) * back[a]
        to += np.repeat(np.maximum(n - 1, 0), n)
    return keys, sizes


def sentences(text: str) -> list[list[str]]:
    return [w for s in _SENTENCE.split(text) if (w := s.split())]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Word posteriors, expected transition counts and log-likelihood normaliser of chains laid end to end.

    scores: (words, labels) log potentials; chains advance together, longest first, one position a step.
    """
    k, words = scores.shape[1], len(scores)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right") if len(sizes) else np.zeros(0, dtype=np.int64)
    cuts = np.concatenate([[0], np.cumsum(alive)])
    # words by position in their chain, then by chain: a step's words and the words before them lie side by side
    at = starts[np.arange(words) - np.repeat(cuts[:-1], alive)] + np.repeat(np.arange(len(alive)), alive)
    e = np.ascontiguousarray(scores[at].T)
    top = e.max(axis=0) if k else np.zeros(words)
    e = np.exp(e - top)
    t = np.exp(transitions)
    alpha, scale = np.empty_like(e), np.ones(words)
    for i, n in enumerate(alive):
        here = slice(cuts[i], cuts[i] + n)
        a = e[:, here] if i == 0 else e[:, here] * (t.T @ alpha[:, cuts[i - 1] : cuts[i - 1] + n])
        z = a.sum(axis=0)
        alpha[:, here], scale[here] = a / z, z
    beta = np.ones_like(e)
    pairs = np.zeros((k, k))
    e /= scale
    for i in range(len(alive) - 1, 0, -1):
        here, before = slice(cuts[i], cuts[i + 1]), slice(cuts[i - 1], cuts[i - 1] + alive[i])
        weighted = e[:, here] * beta[:, here]
        beta[:, before] = t @ weighted
        pairs += alpha[:, before] @ weighted.T
    alpha *= beta
    alpha /= alpha.sum(axis=0)
    post = np.empty((words, k))
    post[at] = alpha.T
    return post, pairs * t, float(np.log(scale).sum() + top.sum())


class Rows:
    """Weight rows by feature key, ascending; a word's scores are their sum."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, self.weights = keys, weights
        # first row of each bucket of keys with the same leading bits; four buckets a key
        self.shift = 64 - max(1, int(4 * len(keys)).bit_length())
        self.first = np.searchsorted(keys, np.arange(1 << 64 - self.shift, dtype=np.uint64) << U(self.shift)).astype(np.int32)
        self.ending = np.append(keys, U((1 << 64) - 1))

    def __reduce__(self):
        return Rows, (self.keys, self.weights)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rows of keys, -1 where there is none."""
        at = self.first[keys >> U(self.shift)]
        late = np.flatnonzero(self.ending[at] < keys)
        while len(late):
            at[late] += 1
            late = late[self.ending[at[late]] < keys[late]]
        return np.where((self.ending[at] == keys) & (at < len(self.keys)), at, -1)

    def ids(self, lows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words' known features, and how many each has (one at least)."""
        keys, sizes = feature_keys(lows)
        found = self.find(keys)
        known = found >= 0
        return found[known], np.add.reduceat(known, np.cumsum(sizes) - sizes, dtype=np.int64) if len(sizes) else sizes

    def case(self) -> np.ndarray:
        """The rows of a lower and an upper first letter."""
        return self.find(_CASE)

    def scores(self, lows: list[str]) -> np.ndarray:
        out = np.zeros((len(lows), self.weights.shape[1]), dtype=self.weights.dtype)
        ends = np.cumsum(np.fromiter(map(len, lows), dtype=np.int64, count=len(lows)))
        a = 0
        while a < len(lows):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _AT_ONCE, side="right")))
            ids, sizes = self.ids(lows[a:b])
            out[a:b] = np.add.reduceat(self.weights[ids], np.cumsum(sizes) - sizes, axis=0)
            a = b
        return out


_CASE = np.array([key("case-"), key("case+")])


class Tagger:
    """A trained field; remembers the scores of words it has met (bounded)."""

    def __init__(self, languages: list[str], rows: Rows, transitions: np.ndarray, remember: int = 50_000):
        self.languages, self.rows, self.transitions, self.remember = languages, rows, transitions, remember
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # surface -> row of scores
        self.scores = np.zeros((self.remember, len(self.languages)), dtype=np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        distinct = set(words)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > self.remember:
            self.remember = max(self.remember, len(distinct))
            self.clear()
            new = distinct
        if new:
            new = list(new)
            lows = list(map(core, new))
            folded = {low: i for i, low in enumerate(dict.fromkeys(lows))}
            base = self.rows.scores(list(folded))
            at = len(self.known)
            upper = np.fromiter((w[:1].isupper() for w in new), dtype=np.int64, count=len(new))
            case = self.rows.weights[self.rows.case()]
            self.scores[at : at + len(new)] = base[np.fromiter(map(folded.__getitem__, lows), dtype=np.int64, count=len(lows))] + case[upper]
            self.known.update(zip(new, range(at, at + len(new))))
        return self.scores[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text: (words, languages) posteriors, sentence after sentence."""
        chains = [sentences(t) if t else [] for t in texts]
        words = [w for c in chains for s in c for w in s]
        counts = [sum(map(len, c)) for c in chains]
        if not words:
            return [np.zeros((0, len(self.languages))) for _ in texts]
        lengths = np.array([len(s) for c in chains for s in c], dtype=np.int64)
        post, _, _ = forward_backward(self.word_scores(words).astype(np.float64), lengths, self.transitions)
        return np.split(post, np.cumsum(counts)[:-1])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0) for _ in texts]
        out = []
        for text, post in zip(texts, self.tag(texts)):
            if not len(post) or not has_letter(text):
                out.append(("und", 0.0))
                continue
            share = post.mean(axis=0)
            best = int(share.argmax())
            out.append((self.languages[best], float(min(1.0, max(0.0, share[best])))))
        return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.2, chains: int = 256, seed: int = 0) -> tuple[list[str], Rows, np.ndarray]:
    """Fit the field to (text, language) rows: AdaGrad on the log-likelihood of sentences and of their mixtures."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    transitions = np.zeros((k, k))
    if not k:
        return [], Rows(np.sort(np.append(_CASE, U(0))), np.zeros((3, 0))), transitions
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    labelled = []
    for text, lang in sorted(rows):
        for s in sentences(text):
            labelled.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in s]), np.full(len(s), languages.index(lang))))
    lows = list(map(core, vocabulary))
    keys = np.unique(np.concatenate([_CASE, [U(0)], feature_keys(sorted(set(lows)))[0]]))
    rows_ = Rows(keys, np.zeros((len(keys), k)))
    weights = rows_.weights
    for i in range(0, len(labelled) - 1, 4):  # code-switched chains
        j = int(rng.integers(len(labelled)))
        labelled.append(tuple(np.concatenate(x) for x in zip(labelled[i], labelled[j])))
    if not labelled:
        return languages, rows_, transitions
    flat, sizes = rows_.ids(lows)
    ends = np.cumsum(sizes)
    case = rows_.case()[np.fromiter((w[:1].isupper() for w in vocabulary), dtype=np.int64, count=len(vocabulary))]
    flat, sizes = np.insert(flat, ends, case), sizes + 1  # each word's case stands after its features
    cuts = np.cumsum(sizes) - sizes
    g2, t2 = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(labelled))
        for at in range(0, len(order), chains):
            part = [labelled[i] for i in order[at : at + chains]]
            words, gold = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            lengths = np.array([len(p[0]) for p in part])
            used, inverse = np.unique(words, return_inverse=True)
            spans = flat[np.repeat(cuts[used] - np.cumsum(sizes[used]) + sizes[used], sizes[used]) + np.arange(int(sizes[used].sum()))]
            reps = np.repeat(np.arange(len(used)), sizes[used])
            scores = np.add.reduceat(weights[spans], np.cumsum(sizes[used]) - sizes[used], axis=0)
            post, pairs, _ = forward_backward(scores[inverse], lengths, transitions)
            post[np.arange(len(gold)), gold] -= 1
            by_word = np.stack([np.bincount(inverse, post[:, c], len(used)) for c in range(k)], axis=1)
            touched, where = np.unique(spans, return_inverse=True)
            grad = np.stack([np.bincount(where, by_word[reps, c], len(touched)) for c in range(k)], axis=1) / len(part) + 1e-5 * weights[touched]
            g2[touched] += grad**2
            weights[touched] -= rate * grad / np.sqrt(g2[touched])
            inner = np.ones(len(gold), dtype=bool)
            inner[np.cumsum(lengths) - lengths] = False
            gold_pairs = np.zeros((k, k))
            np.add.at(gold_pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
            tg = (pairs - gold_pairs) / len(part) + 1e-4 * transitions
            t2 += tg**2
            transitions -= rate * tg / np.sqrt(t2)
    return languages, rows_, transitions


def labelled_sample(docs: DataFrame, allowed, per_language: int) -> list[tuple[str, str]]:
    """Up to ``per_language`` labelled rows of each language, the least by hash: bounded, the same in every run."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed)
    order = F.xxhash64("doc_id")
    languages = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return []
    keys = functools.reduce(DataFrame.unionByName, [rows.where(F.col("lang") == x).select("lang", order.alias("h")).orderBy("h").limit(per_language) for x in languages])
    most = {r.lang: r.h for r in keys.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    picked = functools.reduce(operator.or_, ((F.col("lang") == x) & (order <= most[x]) for x in languages))
    # equal hashes (rows of one doc_id) could exceed the bound
    return [(r.text, r.lang) for r in rows.where(picked).select("text", "lang").limit(2 * per_language * len(languages)).collect()]


def held_out(modulus: int):
    """The remainder that splits rows: crc32 of doc_id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 2


def fit(docs: DataFrame, *, per_language: int = 150, epochs: int = 4) -> tuple[list[str], Rows, np.ndarray]:
    allowed = ~F.coalesce(held_out(4), F.lit(False))
    return train(labelled_sample(docs, allowed, per_language), epochs)


def tagged(batches: Iterator[pa.RecordBatch], load: Callable[[], tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with the language and score of each row's text; load gives the model."""
    take_over(None)  # what another operator left in the worker goes before the model comes
    tagger = Tagger(*load())
    for part in text_slices(batches, limit=1 << 20, cache=tagger):
        found = tagger.predict(part.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=names)


def identify(docs: DataFrame, model: tuple[list[str], Rows, np.ndarray], *, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, and the language and score of each row's text: one pass, nothing is shuffled."""
    languages, rows, transitions = model
    shipped = docs.sparkSession.sparkContext.broadcast((languages, Rows(rows.keys, rows.weights.astype(np.float32)), transitions))  # bounded by the sample
    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    return docs.mapInArrow(lambda batches: tagged(batches, lambda: shipped.value, schema.names), schema)


def language_id(docs: DataFrame, *, per_language: int = 150, epochs: int = 4) -> DataFrame:
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = identify(wanted, fit(docs, per_language=per_language, epochs=epochs))
    return found.select("doc_id", F.coalesce(held_out(4), F.lit(False)).alias("held_out"), "lang_pred", "score")
