"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two words is the inner product of their gapped subsequences of three and four
letters within ``SPAN`` letters (a mark before the first letter counts as one), each weighted
by ``DECAY`` to the number of letters skipped. So an insult with letters or signs put in
between keeps most of its kernel value.

Landmarks are letter runs that tell toxic from clean sentences in a bounded sample of labelled
rows. A word's features are its kernel values with the landmarks, times the inverse root of
the landmarks' own kernel matrix (Nyström). A sentence (the text of a labelled row) is as toxic as
its worst word, so the linear SVM is trained on sentences with their own labels: of a toxic
sentence at least one word must be beyond the margin, of a clean one every word below it. Which
words those of a toxic sentence are follows from the SVM, and the two are settled in turns
(multiple-instance SVM). The SVM is linear in the subsequences, so it collapses to one
weight a subsequence, which is what the executors look up. A logistic curve, fitted on a part of
the sample that its SVM has not seen, says how likely a sentence is toxic whose worst word has a
given margin; a text's score joins the chances of its ``WORST`` worst words as independent causes
(noisy or).
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPAN, DECAY = 8, 0.5
#: Landmarks, how often each toxic text shall be covered by them, their length, their least log odds.
LANDMARKS, COVER, LANDMARK_LETTERS, LEAST_ODDS = 64, 8, (4, 9), 1.5
#: Words whose margins a text's score looks at, and how much worse a toxic text is to miss than
#: a clean one to accuse.
WORST, MISS_COST = 3, 4
#: Labelled texts of each class that are used to fit.
FIT_TOXIC, FIT_CLEAN = 400, 1000
#: A sentence's words nearest to any landmark, among which its worst is looked for, and turns at most.
NEAREST, TURNS = 12, 8
#: Letters of a long word, and of the pieces in which it is judged.
LONG, PIECE = 32, 16
#: Words whose scores a worker remembers.
KNOWN_WORDS = 400_000

_NO_LETTER = re.compile(r"[\W\d_]+")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]*\s+){2,}[^\W\d_][^\w\s]*(?!\S)")


def tokens(text: str) -> list[str]:
    """Words of a text; letters that stand alone in a row are also taken as one word."""
    low = text.lower()
    return low.split() + ["".join(m[0].split()) for m in _SPELLED.finditer(low)]


def letters(token: str) -> str:
    """The token's letters after a mark for its beginning; nothing if it has none."""
    found = _NO_LETTER.sub("", token)
    return found and "^" + found


_STEPS = [(0, *c) for p in (2, 3) for c in itertools.combinations(range(1, SPAN), p)]


def subsequences(word: str) -> dict[str, float]:
    """The word's features: gapped subsequences and their weights."""
    out: dict[str, float] = {}
    for i in range(len(word)):
        for step in _STEPS:
            if i + step[-1] < len(word):
                u = "".join(word[i + k] for k in step)
                out[u] = out.get(u, 0.0) + DECAY ** (step[-1] + 1 - len(step))
    return out


def kernel(a: str, b: str) -> float:
    x, y = subsequences(a), subsequences(b)
    return sum(v * y[u] for u, v in x.items() if u in y)


class Codes:
    """Rows of the subsequences ``features``, found by number in a hashed table.

    Its size is in proportion to the features, whatever letters they are of."""

    def __init__(self, features: list[str]):
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted({c for u in features for c in u}))}
        self.n = len(self.alphabet) + 1
        self.bits = max(16, (64 * len(features)).bit_length())
        # the last row stands for no feature, and so do all free slots
        self.codes = np.zeros(len(features) + 1, dtype=np.uint64)
        self.slots = np.full(1 << self.bits, len(features), dtype=np.int32)
        for k, u in enumerate(features):
            code = 0
            for c in u:
                code = code * self.n + self.alphabet[c]
            self.codes[k] = code
            at = code * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - self.bits
            while self.slots[at] != len(features):
                at = (at + 1) % len(self.slots)
            self.slots[at] = k

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The row of each code, the number of features for those that are none."""
        none = len(self.codes) - 1
        at = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        row = self.slots[at]
        open_ = np.flatnonzero((row != none) & (self.codes[row] != codes))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            row[open_] = self.slots[at[open_]]
            open_ = open_[(row[open_] != none) & (self.codes[row[open_]] != codes[open_])]
        return row

    def found(self, words: list[str]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, float]]]:
        """Where each word starts on a line of letters, and for each gap pattern the feature row
        at each place of the line (the number of features where there is none) with its weight."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(sizes + SPAN) - sizes - SPAN
        line = np.zeros(int((sizes + SPAN).sum()) + SPAN, dtype=np.uint64)
        inside = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        get, m, n = self.alphabet.get, len(line) - SPAN, np.uint64(self.n)
        line[inside] = np.fromiter((get(c, 0) for w in words for c in w), dtype=np.uint64, count=int(sizes.sum()))

        def patterns() -> Iterator[tuple[np.ndarray, float]]:
            for step in _STEPS:
                code, whole = line[:m], line[:m] > 0
                for k in step[1:]:
                    letter = line[k : k + m]
                    code, whole = code * n + letter, whole & (letter > 0)
                row = np.full(m, len(self.codes) - 1, dtype=np.int32)
                row[whole] = self.rows(code[whole])
                yield row, DECAY ** (step[-1] + 1 - len(step))

        return starts, patterns()


@dataclass
class Model:
    """Weights of subsequences, the SVM's bias, the logistic curve over a word's margin, and the
    share of texts that are toxic for no word."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -1.0
    curve: tuple[float, float] = (-3.0, 0.0)
    leak: float = 0.0
    landmarks: list[str] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)  # of the landmarks' kernel values, which the weights sum up

    def __post_init__(self) -> None:
        self._codes = Codes([*self.weights])
        self._table = np.array([*self.weights.values(), 0.0])
        self._known: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.weights, self.bias, self.curve, self.leak, self.landmarks, self.alphas)

    def margins(self, words: list[str]) -> np.ndarray:
        """SVM outputs of words given as letters; a word that shares nothing gets the bias."""
        if not words:
            return np.zeros(0)
        starts, patterns = self._codes.found(words)
        total = sum(self._table[rows] * weight for rows, weight in patterns)
        return np.add.reduceat(total, starts) + self.bias

    def worst(self, sentences: list[set[str]], most: int = WORST) -> np.ndarray:
        """A sentence's largest margins over its distinct words, the bias where it has fewer."""
        known = self._known
        if len(known) > KNOWN_WORDS:
            known.clear()
        fresh = list({w for ws in sentences for w in ws} - known.keys())
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            known.update(zip(part, self.margins(part).tolist()))
        out = np.full((len(sentences), most), self.bias)
        for k, ws in enumerate(sentences):
            top = heapq.nlargest(most, map(known.__getitem__, ws))
            out[k, : len(top)] = top
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """The chance that one of the worst words makes the text toxic."""
        chance = _sigmoid(self.curve[0] + self.curve[1] * self.worst([sentence(t) for t in texts]))
        return 1 - np.prod(1 - chance, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], limit: int = LANDMARKS) -> list[str]:
    """Letter runs that are likelier in toxic texts than in clean ones, picked greedily by how
    many toxic texts they cover (each counts up to COVER times) and by the odds. Texts are
    given as their sets of words."""
    common = Counter(w for t in clean for w in t)
    rare = [[w for w in t if common[w] <= 0.05 * len(clean)] for t in toxic]
    least = min(max(4, len(toxic) // 100), len(toxic))

    def runs(w: str, n: int) -> Iterator[str]:
        return (w[a : a + n] for a in range(len(w) - n + 1))

    texts: dict[str, set[int]] = {}
    sizes = range(LANDMARK_LETTERS[0], LANDMARK_LETTERS[1] + 1)
    for n in sizes:  # one length at a time, as most runs come once
        counts: Counter = Counter()
        for t in rare:
            counts.update({g for w in t for g in runs(w, n)})
        often = {g for g, c in counts.items() if c >= least}
        for k, t in enumerate(rare):
            for g in {g for w in t for g in runs(w, n)} & often:
                texts.setdefault(g, set()).add(k)
    told = {w: hit for w in common if (hit := {g for n in sizes for g in runs(w, n) if g in texts})}
    against: Counter = Counter()
    for t in clean:
        against.update(set().union(*(told[w] for w in t if w in told)))

    # a run comes by chance in proportion to the words, of which long texts have more
    size = [1 + sum(map(len, side)) for side in (toxic, clean)]
    share = size[0] / sum(size)

    def odds(g: str) -> float:
        return float(np.log((len(texts[g]) + 0.5) / size[0]) - np.log((against[g] + 0.5) / size[1]))

    def ratio(g: str) -> float:
        """Twice the log likelihood ratio of the run's share of toxic texts."""
        a, b = len(texts[g]), against[g]
        return 2 * sum(k * float(np.log(k / (a + b) / p)) for k, p in ((a, share), (b, 1 - share)) if k)

    # so many runs are tried that some look toxic by chance: those that chance would give are left out
    odd, chance = {g: odds(g) for g in texts}, 2 * float(np.log(max(len(texts), 1)))
    queue = [(-len(at) * odd[g], -len(g), g) for g, at in texts.items() if odd[g] >= LEAST_ODDS and ratio(g) > chance]
    heapq.heapify(queue)
    covered, picked = np.zeros(len(toxic), dtype=np.int64), []
    while queue and len(picked) < limit:
        value, size, g = heapq.heappop(queue)
        if any(g in p or p in g for p in picked):
            continue
        at = list(texts[g])
        gain = int((covered[at] < COVER).sum())
        if gain < least:
            continue
        if gain * odd[g] < -value - 1e-9:  # worth less by now
            heapq.heappush(queue, (-gain * odd[g], size, g))
            continue
        covered[at] += 1
        picked.append(g)
    return picked


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, reg: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1]), 0.0
    look_w, look_b, weight = w, b, weight / weight.sum()
    rate = 1 / (2 * float((weight * ((x**2).sum(axis=1) + 1)).sum()) + reg)
    for k in range(1, steps + 1):
        gap = np.maximum(0, 1 - y * (x @ look_w + look_b)) * y * weight
        new_w, new_b = look_w - rate * (reg * look_w - 2 * gap @ x), look_b + rate * 2 * gap.sum()
        look_w, look_b = new_w + (k - 1) / (k + 2) * (new_w - w), new_b + (k - 1) / (k + 2) * (new_b - b)
        w, b = new_w, new_b
    return w, b


def _curve(x: np.ndarray, y: np.ndarray, clean_weight: float = 1.0, rounds: int = 30, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Intercept and slope of the chance that a worst word of margin ``x`` makes its sentence toxic,
    and the chance that a sentence is toxic for another reason.

    The second takes up toxic sentences whose words say nothing (noisy or with a leak, by
    expectation and maximisation); the first is fitted by Newton steps, with Platt's smoothing."""
    pos, neg = float(y.sum()), float((1 - y).sum())
    weight = np.where(y == 1, 1 / pos, clean_weight / neg)
    z = np.column_stack([np.ones(len(x)), (x - x.mean()) / (x.std() + 1e-9)])
    c, leak = np.array([0.0, 1.0]), 0.05
    for _ in range(rounds):
        p = _sigmoid(z @ c)
        either = leak + p - leak * p
        target = np.where(y == 1, np.clip(p / either, 1 / (pos + 2), (pos + 1) / (pos + 2)), 1 / (neg + 2))
        leak = float((weight * y * leak / either).sum() / weight.sum())
        for _ in range(5):
            p = _sigmoid(z @ c)
            grad = z.T @ (weight * (p - target)) + ridge * np.array([0.0, c[1]])
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-6, ridge + 1e-6])
            c = c - np.clip(np.linalg.solve(hess, grad), -1, 1)
    slope = float(c[1] / (x.std() + 1e-9))
    return float(c[0] - slope * x.mean()), slope, leak


def pieces(word: str) -> list[str]:
    """The word itself, or the overlapping pieces of a long one, so that no score grows with a word's length.

    What lies within half a piece and a letter is whole in one of them. Only the first piece has the
    mark, so an insult inside of a long word has less of its kernel value."""
    if len(word) <= LONG:
        return [word]
    return [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


def sentence(text: str | None) -> set[str]:
    """A text's distinct words as letters, long ones in pieces."""
    return {p for t in tokens(text or "") if (w := letters(t)) for p in pieces(w)}


def _features(words: list[str], names: list[str], dense: np.ndarray) -> np.ndarray:
    """Kernel values of words with the landmarks, whose subsequences ``names`` have the columns ``dense``."""
    x = np.zeros((len(words), dense.shape[1]))
    codes = Codes(names)
    for k in range(0, len(words), 5000):
        part = words[k : k + 5000]
        starts, patterns = codes.found(part)
        word = np.repeat(np.arange(len(part)), np.diff(np.append(starts, starts[-1] + len(part[-1]) + SPAN)))
        counts = np.zeros((len(part), len(names)))
        for rows, weight in patterns:
            hit = np.flatnonzero(rows < len(names))
            np.add.at(counts, (word[hit], rows[hit]), weight)
        x[k : k + len(part)] = counts @ dense
    return x


def _fit_sentences(toxic: list[set[str]], clean: list[set[str]]) -> Model:
    """Landmarks and the SVM over sentences; no landmarks give a model without weights."""
    marks = choose_landmarks(toxic, clean)
    if not marks:
        return Model()
    features = [subsequences(m) for m in marks]
    own = np.array([[sum(v * y.get(u, 0.0) for u, v in x.items()) for y in features] for x in features])
    scale = 1 / np.sqrt(np.diag(own))
    value, vector = np.linalg.eigh(own * scale[:, None] * scale)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    names = sorted({u for x in features for u in x})
    axis = {u: k for k, u in enumerate(names)}
    dense = np.zeros((len(names), len(marks)))
    for j, x in enumerate(features):
        for u, v in x.items():
            dense[axis[u], j] = v * scale[j]
    # a word that shares little with every landmark is never a sentence's worst
    words = sorted(set().union(*toxic, *clean))
    likeness = Model({u: float(dense[k].max()) for u, k in axis.items()}, 0.0).margins(words)
    order = dict(zip(words, likeness.tolist()))
    near = [heapq.nlargest(NEAREST, t, key=lambda w: (order[w], w)) for t in [*toxic, *clean]]
    used = sorted(set().union(*near)) or [""]
    at = {w: k for k, w in enumerate(used)}
    x = _features(used, names, dense)
    nearest = x.max(axis=1)
    x = x @ root
    bags = [np.array([at[w] for w in t], dtype=np.int64) for t in near]
    held, free = [b for b in bags[: len(toxic)] if len(b)], np.concatenate([b for b in bags[len(toxic) :] if len(b)] or [np.zeros(0, dtype=np.int64)])
    if not held or not len(free):
        return Model()
    # at first the words that hold a landmark, later those beyond the border, or the nearest word
    marked = np.array([any(m in w for m in marks) for w in used])
    told = [b[marked[b]] if marked[b].any() else b[[np.argmax(nearest[b])]] for b in held]
    for _ in range(TURNS):
        witness, often = np.concatenate(told), np.concatenate([np.full(len(t), 1 / len(t)) for t in told])
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(free))])
        w, b = _svm(x[np.concatenate([witness, free])], y, np.concatenate([often / often.sum(), np.full(len(free), 2 / len(free))]))
        margin = x @ w + b
        new = [bag[margin[bag] > 0] if (margin[bag] > 0).any() else bag[[np.argmax(margin[bag])]] for bag in held]
        if all(map(np.array_equal, new, told)):
            break
        told = new
    alphas = root @ w
    weights = dense @ alphas
    return Model({u: float(weights[k]) for u, k in axis.items()}, float(b), landmarks=marks, alphas=(alphas * scale).tolist())


def without_copies(sentences: list[tuple[str, ...]], sketch: int = 4) -> list[tuple[str, ...]]:
    """Sentences without near copies of earlier ones: those that share all but one of the least
    hashes of their rarer words. Copies would make whatever else they say look toxic."""
    seen = Counter(w for t in sentences for w in t)
    kept, at = [], {}
    for t in sentences:
        rare = [w for w in t if seen[w] <= max(0.05 * len(sentences), sketch)]
        least = heapq.nsmallest(sketch, (hashlib.md5(w.encode()).digest() for w in rare))
        if len(least) == sketch and any(c >= sketch - 1 for c in Counter(k for h in least for k in at.get(h, ())).values()):
            continue
        for h in least:
            at.setdefault(h, []).append(len(kept))
        kept.append(t)
    return kept


def fit(toxic: list[set[str]], clean: list[set[str]], share: float = 0.1) -> Model:
    """Train on sentences of the two classes, given as sets of their words; ``share`` is how many of
    all are toxic.

    The curve comes from every third sentence, with an SVM trained on the others; the SVM is then
    trained on all. Without either class, or without landmarks, every text gets one low score.
    """
    plain = lambda side: sorted(tuple(sorted(t)) for t in side)
    toxic = without_copies(plain(toxic))
    clean = without_copies([t for t in plain(clean) if t not in set(toxic)])
    if not toxic or not clean:
        return Model()
    order = [[set(t) for t in sorted(side, key=lambda t: (hashlib.md5(" ".join(t).encode()).digest(), t))] for side in (toxic, clean)]
    part = _fit_sentences(*[[t for k, t in enumerate(side) if k % 3] for side in order])
    model = _fit_sentences(*order)
    if not part.weights or not model.weights:
        return Model()
    seen = [part.worst([t for t in side[::3]], 1) for side in order]
    x = np.concatenate([m.ravel() for m in seen])
    y = np.repeat([1.0, 0.0], [m.size for m in seen])
    share = min(max(share, 0.01), 0.99)
    start, slope, leak = _curve(x, y, (1 - share) / share / MISS_COST)
    return Model(model.weights, model.bias, (start, max(slope, 0.0)), leak, model.landmarks, model.alphas)


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(sentence(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["label", "words"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> Model:
    """Fit on at most ``fit_toxic`` and ``fit_clean`` labelled texts, those with the least hashed ids.

    Held-out rows are left out, and so are null labels, ids and texts; a row that is labelled
    twice counts as toxic, of rows that repeat an id the least text is taken, and equal texts count
    once. The driver gets
    the distinct words of these texts.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    marked = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    order = F.xxhash64("__id")
    chosen = [marked.filter(F.col("__label") == k).orderBy(order, "__id").limit(n) for k, n in ((1, fit_toxic), (0, fit_clean))]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most fit_toxic + fit_clean rows
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    one = texts.join(picked, "__id").groupBy("__id").agg(F.max("__label").alias("__label"), F.min("__text").alias("__text"))
    one = one.groupBy("__text").agg(F.max("__label").alias("__label"))
    rows = one.select(F.col("__label").cast("int"), "__text").mapInArrow(_words, "label int, words array<string>").collect()
    share = marked.agg(F.avg(F.col("__label").cast("double"))).first()[0]
    return fit([set(r.words) for r in rows if r.label == 1], [set(r.words) for r in rows if r.label == 0], share or 0.1)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.scores([t or "" for t in batch.column(1).slice(k, 256).to_pylist()]) for k in range(0, batch.num_rows, 256)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["__id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``(id, score, predicted)`` for every row of ``docs``.

    A null or empty text scores as one without any toxic word; of a very long one every word is
    looked at, its distinct words once. Ids may be null or repeat;
    further columns are ignored; an empty table gives no rows. The model's size is bounded by
    its landmarks, so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(_scored(shared), f"__id {kind}, score double")
    return scored.select(F.col("__id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, with their columns.

    Null, empty and very long texts are scored as in ``score_toxicity``; repeated rows stay or go
    together; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            parts = [shared.value.scores([t or "" for t in texts.slice(k, 256).to_pylist()]) < threshold for k in range(0, batch.num_rows, 256)]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}

ORACLES: dict[str, str] = {}
