"""Toxicity: subsequence string-kernel SVM with Nystroem landmarks (operator 1).

Kernel.  Two strings are compared by the letter triples they share as subsequences: a
triple that spans s characters weighs ``DECAY``**s (its least gapped occurrence), and up to ``MAX_GAP`` characters may be
inserted between its letters.  Case is folded, look-alike digits and signs count as letters, and
signs inside a token are passed over, so "i.d.i.o.t", "idiiot" and "1d10t" stay close to the
word they hide.  Tokens of one letter each ("i d i o t") are read as one token.

Landmarks.  Strings of 4 to 8 letters that mark toxic training documents.  A sentence's kernel value with a landmark is the best of its tokens', divided by the
landmark's own; values under ``MIN_KERNEL`` count as zero.  That makes scoring cheap and exact: a
triple that no landmark holds adds nothing, so one table look-up per character and gap pattern finds the
few tokens that can reach ``MIN_KERNEL``.

Training.  Sentences of a bounded sample of labelled documents (``MAX_TRAIN_DOCS`` per class,
``MAX_SENTENCES`` per document, both by hash), mapped through K^(-1/2) of the landmarks; sentences and landmarks are
compared with the same landmark points, each landmark's features over its own kernel value.  A document's
label says that some sentence is toxic, so the SVM alternates: fit on the clean documents' sentences and the
most toxic sentence of each toxic document, then choose that sentence again.  A logistic curve
turns a document's largest margin into a probability.

Scoring runs over whole texts in ``mapInArrow``, in pieces of bounded memory, without a shuffle.
Nothing but the text enters a score.

Defined cases: null and empty texts score as texts without any landmark match;
repeated rows score alike; without toxic training rows every score is 0;
labels that are null, or of documents that do not exist, are ignored, and a document with both labels is toxic.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nnspark.llm.common import TAG, tag_rows

DECAY = 0.6
MAX_GAP = 2
MIN_KERNEL = 0.6
MAX_LANDMARKS = 64
MIN_GAIN = 0.01
CLEAN_PENALTY = 2.0
SVM_COST = 100_000
MAX_TRAIN_DOCS = 2000
MAX_SENTENCES = 64
MAX_SENTENCE_CHARS = 500
HELD_OUT_FOLDS = 5
PIECE = 2 << 20

# Characters read as letters.
_LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}


def _letter_codes() -> np.ndarray:
    """Letter code of each UTF-8 byte: 1-26, 27-30 for the last byte of other characters, 0 for none."""
    table = np.zeros(256, np.uint16)
    for i in range(26):
        table[97 + i] = table[65 + i] = i + 1
    for sign, letter in _LOOKALIKE.items():
        table[ord(sign)] = table[ord(letter)]
    for b in range(0x80, 0xC0):
        table[b] = 27 + b % 4
    return table


_CODES = _letter_codes()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places): the letters of a byte array with one 0 between tokens, and where each came from.

    Signs inside a token are dropped, and tokens of one character run together.
    """
    codes, space = _CODES[raw], _SPACE[raw]
    places = np.flatnonzero((codes > 0) | space)
    codes = codes[places]
    codes[space[places]] = 0
    if len(codes) > 4:
        gap = np.concatenate(([True, True], codes == 0, [True, True]))
        lone = gap[2:-2] & gap[:-4] & gap[4:] & ~gap[1:-3] & ~gap[3:-1]
        codes, places = codes[~lone], places[~lone]
    return codes, places


def _gapped(codes: np.ndarray):
    """(weight, triples, reach) of each gap pattern: the triple at every place, and how far it reaches."""
    for a in range(1, MAX_GAP + 2):
        pair = (codes[:-a] << 10) | (codes[a:] << 5)
        for b in range(1, MAX_GAP + 3 - a):
            n = len(codes) - a - b
            if n > 0:
                yield DECAY ** (a + b + 1), pair[:n] | codes[a + b:], a + b


_ALL_LETTERS = np.array([bool(t >> 10 and t >> 5 & 31 and t & 31) for t in range(32768)])


def _triples(codes: np.ndarray, wanted: np.ndarray):
    """(place, triple, weight) of the wanted gapped triples that lie within a token."""
    token = np.cumsum(codes == 0, dtype=np.int32)
    places, triples, weights = [], [], []
    for weight, t, reach in _gapped(codes):
        hit = np.flatnonzero(wanted[t])
        hit = hit[token[hit] == token[hit + reach]]
        places.append(hit)
        triples.append(t[hit])
        weights.append(np.full(len(hit), weight))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint16), np.empty(0)
    return np.concatenate(places), np.concatenate(triples), np.concatenate(weights)


def features_of(word: str) -> dict[int, float]:
    """The explicit gap-weighted feature vector of a short string."""
    codes, _ = _tokens(np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8))
    _, triples, weights = _triples(codes, _ALL_LETTERS)
    out: dict[int, float] = {}
    for t, w in zip(triples.tolist(), weights.tolist()):
        out[t] = max(out.get(t, 0.0), w)
    return out


def kernel(a: dict[int, float], b: dict[int, float]) -> float:
    return sum(w * b[t] for t, w in a.items() if t in b)


@dataclass
class Model:
    """Landmarks with their scaled features, and the scorer over landmark kernel values."""

    landmarks: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros(32768, np.int16))  # triple -> row of ``rows``; 0: in no landmark
    rows: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def over(cls, landmarks: list[str]) -> Model:
        vectors = [features_of(x) for x in landmarks]
        triples = sorted({t for v in vectors for t in v})
        table = np.zeros(32768, np.int16)
        rows = np.zeros((len(triples) + 1, len(landmarks)))
        for r, t in enumerate(triples, 1):
            table[t] = r
            for j, v in enumerate(vectors):
                rows[r, j] = v.get(t, 0.0) / kernel(v, v)
        return cls(list(landmarks), table, rows)

    def sentences(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, kernel values) of the sentences of a byte array that reach MIN_KERNEL with some landmark."""
        empty = np.empty(0, np.int64), np.empty((0, len(self.landmarks)))
        if not self.landmarks or len(raw) < 3:
            return empty
        codes, places = _tokens(raw)
        if len(codes) < 3:
            return empty
        # no landmark's value of a token exceeds the sum of each triple's largest share
        share = self.rows.max(axis=1).astype(np.float32)[self.table]
        reach = np.zeros(len(codes), np.float32)
        for weight, t, _ in _gapped(codes):
            reach[:len(t)] += (share * np.float32(weight)).take(t)
        starts = np.flatnonzero(np.concatenate(([True], codes[:-1] == 0)))
        ends = np.append(starts[1:], len(codes))
        may = np.add.reduceat(reach, starts) >= MIN_KERNEL * 0.999
        if not may.any():
            return empty
        starts, sizes = starts[may], (ends - starts)[may]
        # the few tokens left, one after the other, each closed by a 0
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        left = codes[at]
        hit, triples, weights = _triples(left, self.table > 0)
        unit = np.searchsorted(np.cumsum(sizes), hit, side="right")
        if not len(hit):
            return empty
        # a triple counts once per token, with its least gapped occurrence
        key = unit.astype(np.int64) << 15 | triples
        order = np.lexsort((-weights, key))
        once = order[np.concatenate(([True], np.diff(key[order]) != 0))]
        unit, triples, weights = unit[once], triples[once], weights[once]
        values = _sums(self.rows, self.table[triples].astype(np.int64), weights, unit, len(starts))
        values[values < MIN_KERNEL] = 0.0
        kept = values.any(axis=1)
        values, first = values[kept], places[starts[kept]]
        if not len(first):
            return empty
        after = np.concatenate((_SPACE[raw[1:]], [True]))
        ends = np.flatnonzero((_STOP[raw] & after) | (raw == 10))
        sentence = np.searchsorted(ends, first)
        begin = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
        return first[begin], _best(values, sentence)

    def margins(self, values: np.ndarray) -> np.ndarray:
        return values @ self.weights + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _sums(rows: np.ndarray, row: np.ndarray, weights: np.ndarray, unit: np.ndarray, n: int, step: int = 1 << 18) -> np.ndarray:
    """Weighted sums of ``rows[row]`` per unit; most entries of ``rows`` are zero and are left out."""
    at, column = np.nonzero(rows)
    begins = np.searchsorted(at, np.arange(len(rows) + 1))
    share = rows[at, column]
    out = np.zeros(n * rows.shape[1])
    for k in range(0, len(row), step):
        r = row[k:k + step]
        lens = begins[r + 1] - begins[r]
        entry = np.repeat(begins[r] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        cell = np.repeat(unit[k:k + step] * rows.shape[1], lens) + column[entry]
        out += np.bincount(cell, share[entry] * np.repeat(weights[k:k + step], lens), len(out))
    return out.reshape(n, rows.shape[1])


def _best(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Column-wise maximum per group (sorted group numbers)."""
    begin = np.concatenate(([True], group[1:] != group[:-1]))
    out = values[begin]
    np.maximum.at(out, (np.cumsum(begin) - 1)[~begin], values[~begin])
    return out


# ------------------------------------------------------------------ training

def in_training_fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_FOLDS != 0


def training_sentences(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       label_col: str = "toxic") -> list[tuple[int, list[str]]]:
    """(label, sentences) of the bounded training sample, read from documents outside the held-out fold."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    marked = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & in_training_fold(id_col))
              .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label")))
    sample = None
    for label in (1, 0):
        part = marked.filter(F.col("label") == label).orderBy(key, id_col).limit(MAX_TRAIN_DOCS)
        sample = part if sample is None else sample.union(part)
    sample = sample.select(F.col(id_col).alias("sample_id"), "label")
    pieces = F.split(F.col(text_col), r"(?<=[.!?])\s+|\n")
    # long sentences come in consecutive pieces, cut at white space where there is some
    part = F.lit(rf"(?s).{{1,{MAX_SENTENCE_CHARS - 1}}}(?:\s|$)|.{{1,{MAX_SENTENCE_CHARS}}}")
    short = F.flatten(F.transform(pieces, lambda s: F.when(F.length(s) > MAX_SENTENCE_CHARS, F.regexp_extract_all(s, part, F.lit(0))).otherwise(F.array(s))))
    # MAX_SENTENCES of a text by hash, whatever their order
    chosen = F.slice(F.array_sort(F.transform(short, lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s")))), 1, MAX_SENTENCES)
    # at most 2 * MAX_TRAIN_DOCS rows on the broadcast side
    rows = (docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(sample), F.col(id_col) == F.col("sample_id"))
            .select("sample_id", "label", F.transform(chosen, lambda x: x["s"]).alias("sentences")))
    rows = rows.orderBy(F.xxhash64(F.col("sample_id").cast("string")), "sample_id", F.hash("sentences")).limit(2 * MAX_TRAIN_DOCS)
    return [(r["label"], r["sentences"]) for r in rows.collect()]


def _words(sentence: str) -> set[str]:
    """Lower-case words of 4 to 39 letters, signs left out."""
    found = ("".join(c for c in w if c.isalpha() or c in _LOOKALIKE) for w in sentence.lower().split())
    return {w for w in found if 3 < len(w) < 40}


def _association(n1, n0, total1: int, total0: int):
    """z score of the difference of two document frequencies."""
    p1, p0 = n1 / total1, n0 / total0
    p = (n1 + n0) / (total1 + total0)
    return (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / total1 + 1 / total0))


def choose_landmarks(sample: list[tuple[int, list[str]]]) -> list[str]:
    """Strings of 4 to 8 letters that mark toxic documents."""
    docs = [(label, set().union(*map(_words, sentences))) for label, sentences in sample]
    total = Counter(label for label, _ in docs)
    if not total[1] or not total[0]:
        return []
    seen = {1: Counter(), 0: Counter()}
    for label, words in docs:
        seen[label].update(words)
    marks = [w for w, n1 in seen[1].items() if n1 >= max(2, 0.002 * total[1])
             and _association(n1, seen[0][w], total[1], total[0]) > 1.2
             and n1 / total[1] >= 5 * seen[0][w] / total[0]]
    pieces = {w[i:i + k] for w in marks for k in range(4, 9) for i in range(len(w) - k + 1)}
    pieces = {s for s in pieces if features_of(s)}
    holds = {}
    for w in set(seen[1]) | set(seen[0]):
        found = {w[i:i + k] for k in range(4, 9) for i in range(len(w) - k + 1)} & pieces
        if found:
            holds[w] = found
    # Weighted cover: a document counts half as much each time a picked string marks it again,
    # and words that hold a picked string mark nothing further.
    worth = np.where([label == 1 for label, _ in docs], 1.0, -CLEAN_PENALTY)
    marked_by = [[w for w in words if w in holds] for _, words in docs]
    picked: list[str] = []
    while len(picked) < MAX_LANDMARKS:
        gain, count = Counter(), Counter()
        for d, words in enumerate(marked_by):
            for s in set().union(*(holds[w] for w in words)):
                gain[s] += worth[d]
                count[s] += docs[d][0]
        top = max((g for s, g in gain.items() if count[s] >= 3), default=0.0)
        if top < max(2.0, MIN_GAIN * total[1]):
            break
        # nearly as good and longer is better: the whole word rather than a part of it
        s = max((s for s, g in gain.items() if g >= 0.9 * top and count[s] >= 3), key=lambda s: (len(s), gain[s], s))
        picked.append(s)
        pieces = {t for t, g in gain.items() if g > 0}
        holds = {w: held & pieces for w, held in holds.items() if s not in w and held & pieces}
        for d, words in enumerate(marked_by):
            if docs[d][0] and any(s in w for w in words):
                worth[d] *= 0.5
            marked_by[d] = [w for w in words if w in holds]
    return picked


def _fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the active set."""
    n, d = x.shape
    design = np.hstack((x, np.ones((n, 1))))
    ridge = np.eye(d + 1)
    ridge[d, d] = 1e-6
    w = np.zeros(d + 1)
    active = np.ones(n, bool)
    for _ in range(rounds):
        a, c = design[active], cost[active]
        new = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        now = y * (design @ new) < 1
        w = new
        if np.array_equal(now, active):
            break
        active = now
    return w[:d], float(w[d])


def _fit_logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(toxic | margin), with Platt's softened targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((margin, np.ones_like(margin)), axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, x.T @ (target - p) - np.array([1e-3, 1e-6]) * theta)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(sample: list[tuple[int, list[str]]], rounds: int = 4) -> Model:
    """Landmarks, the SVM over them and the probability curve from (label, sentences) rows."""
    model = Model.over(choose_landmarks(sample))
    if not model.landmarks:
        model.slope, model.offset = 0.0, -1000.0
        return model
    vectors = [features_of(x) for x in model.landmarks]
    own = np.array([kernel(v, v) for v in vectors])
    gram = np.array([[kernel(a, b) for b in vectors] for a in vectors]) / np.outer(own, own)
    values, vecs = np.linalg.eigh(gram)
    root = vecs @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vecs.T
    labels = np.array([label for label, _ in sample])
    bags = []
    for _, sentences in sample:
        raw = np.frombuffer("\n".join(sentences).encode("utf-8", "surrogatepass"), np.uint8)
        found = model.sentences(raw)[1]
        bags.append(np.vstack((found, np.zeros((1, len(model.landmarks))))))  # and a sentence without matches
    clean = np.vstack([b for b, label in zip(bags, labels) if label == 0])
    clean, times = np.unique(clean, axis=0, return_counts=True)
    toxic_bags = [b for b, label in zip(bags, labels) if label == 1 and len(b) > 1]
    scores = [b.max(axis=1) for b in toxic_bags]
    for _ in range(rounds):
        best = np.vstack([b[int(np.argmax(s))] for b, s in zip(toxic_bags, scores)])
        x = np.vstack((best, clean)) @ root
        y = np.concatenate((np.ones(len(best)), -np.ones(len(clean))))
        cost = np.concatenate((np.full(len(best), 1.0 / len(best)), np.minimum(times, 50) / np.minimum(times, 50).sum()))
        w, model.bias = _fit_svm(x, y, cost * SVM_COST)
        model.weights = root @ w
        scores = [model.margins(b) for b in toxic_bags]
    margin = np.array([model.margins(b).max() for b in bags])
    model.slope, model.offset = _fit_logistic(margin, labels)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    return fit(training_sentences(docs, labels, id_col, text_col, label_col))


# ------------------------------------------------------------------- scoring

def _pieces(texts: list[bytes]):
    """(first text, texts or part of one) chunks of about PIECE bytes; a long text is cut between sentences or tokens."""
    held, size, first = [], 0, 0
    for i, raw in enumerate(texts):
        if held and size + len(raw) > PIECE:
            yield first, held
            held, size = [], 0
        if not held:
            first = i
        at = 0
        while len(raw) - at > PIECE:
            if held:
                yield first, held
                held, size = [], 0
            first = i
            # at a sentence's end if there is one, else between tokens: a sentence of more than PIECE bytes is judged in parts
            to = max(raw.rfind(end, at + 1, at + PIECE) + 1 for end in (b". ", b"! ", b"? ", b"\n"))
            to = to or max(raw.rfind(b" ", at + 1, at + PIECE), 0)
            if to <= at:
                ends = [e for e in (raw.find(b" ", at + PIECE), raw.find(b"\n", at + PIECE)) if e >= 0]
                to = min(ends, default=len(raw))
            yield i, [raw[at:to]]
            at = to
        held.append(raw[at:])
        size += len(raw) - at
    if held:
        yield first, held


def margins_of(model: Model, texts: list[bytes]) -> np.ndarray:
    """Largest sentence margin of each text; texts without a match have the bias."""
    out = np.full(len(texts), model.bias)
    if not model.landmarks:
        return out
    for first, parts in _pieces(texts):
        raw = np.frombuffer(b"\n\n\n".join(parts), np.uint8)
        place, values = model.sentences(raw)
        if len(place):
            starts = np.cumsum([0, *(len(p) + 3 for p in parts[:-1])])
            np.maximum.at(out, first + np.searchsorted(starts, place, side="right") - 1, model.margins(values))
    return out


def _scorer(model):
    def make():
        import pyarrow as pa

        def kernel_(texts):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
            return [pa.array(model.value.probability(margins_of(model.value, raw)), pa.float64())]

        return kernel_

    return make


def tag_scores(docs: DataFrame, model: Model, text_col: str = "text", cols: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``cols``) plus struct ``TAG`` with ``score`` in [0, 1]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of landmarks
    return tag_rows(docs, text_col, _scorer(shared), [("score", "double")], cols)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    tagged = tag_scores(docs.select(id_col, text_col), model, text_col, [id_col])
    value = F.col(f"{TAG}.score")
    return tagged.select(id_col, (~in_training_fold(id_col)).alias("held_out"), value.alias("score"),
                         F.when(value >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score stays under ``limit``."""
    return tag_scores(docs, model, text_col).filter(F.col(f"{TAG}.score") < limit).select(*docs.columns)
