"""Toxicity by weak supervision.

Voters: the words of a fixed lexicon, patterns (disguised spellings, spaced letters, an insult after "you"), and words
and word beginnings induced from labelled rows. A generative label model takes how many voters fire and which they are
for signs of the class, and the label at hand for one more voter; expectation-maximisation estimates all of these and the
class balance. Correlations that the class does not explain are estimated from the residuals, and a voter's say is
divided by the strength of those it has. A linear classifier is trained on the posterior labels and scores all texts.

The fit uses at most about `positives` + `negatives` labelled rows, drawn by a hash of doc_id, of copies one, and at most
`induced` induced voters, the best of the first 4 * `induced` candidates; scoring has no bound.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, map_batches, staged, words

#: The seed lexicon, common English insults.
LEXICON = [
    "airhead", "asshole", "bastard", "bitch", "blockhead", "bonehead", "clown", "coward", "crap", "cretin",
    "creep", "degenerate", "despicable", "dimwit", "dirtbag", "disgusting", "dolt", "dope", "dork", "douche",
    "dullard", "dumb", "dumbass", "dunce", "failure", "fool", "freak", "fuck", "garbage", "halfwit",
    "hideous", "idiot", "idiotic", "ignorant", "imbecile", "inferior", "jackass", "jerk", "lazy", "loathsome",
    "loser", "lowlife", "lunatic", "maggot", "moron", "moronic", "nitwit", "parasite", "pathetic", "pig",
    "psycho", "rat", "repulsive", "scum", "scumbag", "shit", "simpleton", "sleazy", "slob", "stupid",
    "subhuman", "sucker", "swine", "traitor", "trash", "twit", "ugly", "useless", "vermin", "vile",
    "weakling", "weirdo", "whore", "wimp", "worthless", "wretch",
]
#: Digits that stand for letters in disguised spellings.
DISGUISES = [bytes.maketrans(b"013457", b"oleast"), bytes.maketrans(b"013457", b"oieast")]
PATTERNS = ["disguised", "spaced", "addressed", "shouted"]
_STEMS = (4, 5, 6)
_FOLDS = 5


def held_out():
    """Rows never learned from: crc32 of doc_id as text leaves no remainder by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % _FOLDS == 0, F.lit(False))


class Voters:
    """Which voters fire in a text, and how often. Induced words and stems are given as (text, is a stem)."""

    def __init__(self, induced: list[tuple[bytes, bool]]) -> None:
        self.lexicon = {w.encode(): k for k, w in enumerate(LEXICON)}
        n = len(LEXICON)
        self.patterns = {p: n + k for k, p in enumerate(PATTERNS)}
        n += len(PATTERNS)
        self.whole = {w: n + k for k, (w, stem) in enumerate(induced) if not stem}
        self.stems = {w: n + k for k, (w, stem) in enumerate(induced) if stem}
        self.sizes = sorted({len(w.decode("utf-8", "ignore")) for w in self.stems})
        self.count = n + len(induced)
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _of_word(self, word: bytes) -> tuple[int, ...]:
        found = []
        if word in self.lexicon:
            found.append(self.lexicon[word])
        elif any((plain := word.translate(t)) != word and plain in self.lexicon for t in DISGUISES):
            found.append(self.patterns["disguised"])
        if word in self.whole:
            found.append(self.whole[word])
        text = word.decode("utf-8", "ignore")
        for n in self.sizes:
            if len(text) > n and (k := self.stems.get(text[:n].encode())) is not None:
                found.append(k)
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[word] = tuple(found)
        return self.known[word]

    def fire(self, text: bytes | None) -> tuple[int, dict[int, int]]:
        """Number of words, and {voter: times}."""
        tokens, times, get = words(text), {}, self.known.get
        insults = set()
        for w in set(tokens):
            found = get(w)
            if found is None:
                found = self._of_word(w)
            if found:
                n = tokens.count(w)
                for k in found:
                    times[k] = times.get(k, 0) + n
                if w in self.lexicon:
                    insults.add(w)
        if insults:
            said = sum(b in insults and (a == b"you" or a in (b"are", b"re") and p == b"you") for p, a, b in zip([b"", *tokens], tokens, tokens[1:], strict=False))
            if said:
                times[self.patterns["addressed"]] = said
            if n := sum(text.count(w.upper()) for w in insults):
                times[self.patterns["shouted"]] = n
        if text and (runs := _SPACED.findall(text.lower())):
            n = sum(_NOT_LETTER.sub(b"", r) in self.lexicon for r in runs)
            if n:
                times[self.patterns["spaced"]] = n
        return len(tokens), times


_SPACED = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:[a-z][ .*_-]){2,}[a-z](?![0-9a-z\x80-\xff])")
_NOT_LETTER = re.compile(rb"[^a-z]")


def _terms(text: bytes | None) -> set[str]:
    """Words and word beginnings of a text, the latter marked by a trailing *."""
    out = set()
    for w in {t.decode("utf-8", "ignore") for t in words(text)}:
        if 3 <= len(w) <= 40:
            out.add(w)
        out.update(w[:n] + "*" for n in _STEMS if len(w) > n)
    return out


def _sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int) -> DataFrame:
    """doc_id, text, toxic of about so many labelled rows outside the held-out fold; stored."""
    one = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    one = staged(one, "training-labels")
    n = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = one.filter(
        ((F.col("toxic") == 1) & (share < min(1.0, positives / max(1, n.get(1, 0))))) | ((F.col("toxic") == 0) & (share < min(1.0, negatives / max(1, n.get(0, 0)))))
    )
    chosen = staged(chosen, "training-sample-ids")  # its size is bounded by the two parameters, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id that many texts share brings in one of them, so that the sample stays within its bound
    one_text = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")
    rows = rows.groupBy("doc_id", "toxic").agg(one_text).select("doc_id", "first.text", "toxic")
    same = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)  # copies would lend their rare words weight
    rows = rows.groupBy(same, "toxic").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.doc_id", "first.text", "toxic")
    return staged(rows, "training-sample")


def _induced(sample: DataFrame, most: int, support: int) -> list[tuple[bytes, bool]]:
    """The words and stems that speak most clearly for the label, over all sampled rows."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(t, y) for text, y in zip(binary_column(batch, "text"), batch.column(1).to_pylist(), strict=True) for t in _terms(text)]
            return pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in rows], pa.string()), "toxic": pa.array([y for _, y in rows], pa.int64())})

        return each

    total = sample.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not total["p"] or not total["n"]:
        return []
    terms = map_batches(sample.select("text", "toxic"), make, "term string, toxic long")
    least = max(support, total["p"] // 100)  # a term of a few texts may be one text's copies
    seen = terms.groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).filter(F.col("p") >= least)
    odds = F.log((F.col("p") + 0.5) / (total["p"] + 1.0)) - F.log((F.col("n") + 0.5) / (total["n"] + 1.0))
    best = seen.withColumn("score", odds * F.sqrt("p")).filter(odds > 1.5).orderBy(F.desc("score"), "term").limit(4 * most).collect()
    taken: list[tuple[bytes, bool]] = []
    stems: set[str] = set()
    for r in best:
        term = r["term"]
        base = term.rstrip("*")
        if len(taken) < most and not any(base[:n] in stems and base[:n] != base for n in _STEMS):
            taken.append((base.encode(), term.endswith("*")))
            if term.endswith("*"):
                stems.add(base)
    return taken


#: Texts in which no voter fires, one, two, three or four, five to eight, and more.
_LEVELS = (1, 2, 3, 5, 9)


class LabelModel:
    """A generative model of a text's class, its voters and the label given to it.

    By class it has: how many voters fire (in the steps of _LEVELS), which they are, and how often the given label is
    right. The given label is thus one voter among many; its trust has a prior that weighs `prior` rows. A silent voter
    abstains: only their number speaks. The first `seeds` voters are those known beforehand; where one of them fires, or
    the given label says so, a text may be toxic at the start; it likely is where any voter fires and the label says so. Expectation-maximisation does the rest. Correlations are
    estimated twice, as the classes form and once they stand, from what the classes leave unexplained; a voter's say is
    divided by one more than the sum of its correlations of `least` or more.

    votes: rows by voters, 1 where one fires; given: 0 or 1.
    """

    def __init__(self, votes: np.ndarray, given: np.ndarray, seeds: int = 0, rounds: int = 40, prior: float = 20.0, least: float = 0.05) -> None:
        n, m = votes.shape
        level = np.searchsorted(_LEVELS, votes.sum(axis=1), side="right")
        levels = np.eye(len(_LEVELS) + 1)[level]
        known = votes[:, : seeds or m].any(axis=1)
        known |= votes.any(axis=1) & (given == 1)  # else what only induced voters know, as another language's insults, begins as doubtful and ends as clean
        post = 0.03 + 0.6 * known + 0.3 * given
        discount = np.ones(m)
        for step in range(rounds):
            w = np.stack((1 - post, post))
            size = w.sum(axis=1)
            self.balance = np.clip(size[1] / n, 0.01, 0.99)
            self.chance = w @ votes / (size[:, None] + 1e-9)
            self.share = w @ votes + 0.5
            self.share /= self.share.sum(axis=1, keepdims=True)
            self.level = w @ levels + 1
            self.level /= self.level.sum(axis=1, keepdims=True)
            agree = np.array([w[0] @ (given == 0), w[1] @ (given == 1)])
            self.trust = np.clip((agree + 0.95 * prior) / (size + prior), 0.55, 0.995)
            if step in (1, rounds // 2):
                discount = 1 / (1 + self._residual(votes, w, least).sum(axis=1))
            logit = np.log(self.balance / (1 - self.balance)) + np.log(self.level[1] / self.level[0])[level]
            logit += votes @ (discount * np.log(self.share[1] / self.share[0]))
            label = np.where(given == 1, np.log(self.trust[1] / (1 - self.trust[0])), np.log((1 - self.trust[1]) / self.trust[0]))
            post = 1 / (1 + np.exp(-np.clip(logit + label, -30, 30)))
        self.posterior, self.discount = post, discount

    def _residual(self, votes: np.ndarray, w: np.ndarray, least: float) -> np.ndarray:
        """Correlations of what is left of the votes once the class is accounted for; weak ones count as none."""
        rest = votes - w.T @ self.chance
        rest -= rest.mean(axis=0)
        size = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        self.correlation = (rest.T @ rest) / np.outer(size, size)
        np.fill_diagonal(self.correlation, 0)
        return np.where(np.abs(self.correlation) >= least, np.abs(self.correlation), 0)


def _features(votes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """log(1 + times) of each voter, of all together, and of them in a hundred words."""
    total = votes.sum(axis=1)
    return np.column_stack((np.log1p(votes), np.log1p(total), np.log1p(100 * total / np.maximum(n_words, 1))))


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the last weight is the bias."""
    x = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + ridge * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class ToxicityModel:
    def __init__(self, induced: list[tuple[bytes, bool]], weights: np.ndarray | None = None) -> None:
        self.induced, self.weights = induced, weights
        if weights is None:  # nothing to learn from: any lexicon word or pattern decides
            m = Voters(induced).count
            self.weights = np.concatenate((np.full(m, 6.0), np.zeros(2), [-3.0]))

    def scorer(self):
        voters, w = Voters(self.induced), self.weights
        m = voters.count

        def score(texts: list[bytes | None]) -> np.ndarray:
            out = np.full(len(texts), w[-1])
            for k, text in enumerate(texts):
                n, times = voters.fire(text)
                if times:
                    at, c = np.fromiter(times.keys(), int), np.fromiter(times.values(), float)
                    out[k] += np.log1p(c) @ w[at] + np.log1p(c.sum()) * w[m] + np.log1p(100 * c.sum() / max(n, 1)) * w[m + 1]
            return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

        return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, positives: int = 4_000, negatives: int = 8_000, induced: int = 200, support: int = 8) -> ToxicityModel:
    """The model of docs (doc_id, text) and labels (doc_id, toxic). Null labels and ids are passed over; rows that label
    a document twice count by their mean. Without labels of both kinds the fixed lexicon and patterns decide alone."""
    sample = _sample(docs, labels, positives, negatives)
    found = _induced(sample, induced, support)
    if not found and sample.select("toxic").distinct().count() < 2:
        return ToxicityModel([])

    def make():
        voters = Voters(found)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fired = [voters.fire(t) for t in binary_column(batch, "text")]
            return pa.RecordBatch.from_pydict(
                {
                    "toxic": batch.column(1).cast(pa.int64()),
                    "n_words": pa.array([n for n, _ in fired], pa.int64()),
                    "voters": pa.array([list(t) for _, t in fired], pa.list_(pa.int64())),
                    "times": pa.array([list(t.values()) for _, t in fired], pa.list_(pa.int64())),
                }
            )

        return each

    rows = map_batches(sample.select("text", "toxic"), make, "toxic long, n_words long, voters array<long>, times array<long>").collect()  # bounded by the sample
    rows.sort(key=lambda r: (r["toxic"], r["n_words"], r["voters"], r["times"]))  # sums do not depend on the tasks' order
    times = np.zeros((len(rows), Voters(found).count))
    for k, r in enumerate(rows):
        times[k, r["voters"]] = r["times"]
    given = np.array([r["toxic"] for r in rows])
    model = LabelModel((times > 0).astype(float), given, seeds=len(LEXICON) + len(PATTERNS))
    return ToxicityModel(found, fit_linear(_features(times, np.array([r["n_words"] for r in rows])), model.posterior))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts get the score of a text without votes;
    repeated rows are scored each; a null doc_id is not held out; other columns are ignored."""

    def make():
        score = model.scorer()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(score(binary_column(batch, "text")))})

        return each

    scored = map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that the model does not take for toxic, unchanged."""

    def make():
        score = model.scorer()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(score(binary_column(batch, "text")) < 0.5))

        return each

    return map_batches(docs, make, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
