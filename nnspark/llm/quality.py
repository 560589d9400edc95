"""Quality classifier from weak labels (operator 4).

Overlapping heuristics vote good, bad or abstain on every document.  Votes are counted by
pattern over the whole corpus (at most 3 to the number of heuristics patterns, whatever the
input), and expectation-maximisation estimates from these counts how each heuristic
votes on good and on bad documents, and so the posterior of every pattern.  The posteriors of a bounded
sample of documents (``MAX_TRAIN_DOCS``, by hash, half from either side where there are enough) train a logistic scorer
over hashed features: byte triples of the text and bins of its statistics, both of whole texts.  No gold label is read.

Votes and scores come from ``mapInArrow`` over whole texts, without a shuffle; only pattern counts and the
sample's feature vectors reach the driver, both of bounded size.

Defined cases: null and empty texts get votes as texts without words and a score like any other; repeated rows are scored alike; an
empty table gives an empty result; if the votes do not tell two classes apart, the posteriors follow the vote majority.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnspark.llm.common import TAG, cut, tag_rows

MAX_TRAIN_DOCS = 2000
BUCKETS = 4096
EM_ROUNDS = 200

# Very common words of the languages at hand.
COMMON = frozenset((
    "the of and to in a is that for it with as was on are by be this from or at an "
    "de la le et les des en un une du dans est pour que qui sur au par avec "
    "der die und das von zu den mit ist im auf ein eine nicht für sich "
    "el los las y un una del por con para se su al lo como").split())

_LETTER = re.compile(r"[^\W\d_]")

# name, statistic, bad beyond, good within; between the two, or without a good limit, a heuristic abstains:
# that a text lacks one kind of fault says little for it
HEURISTICS = (
    ("symbols", "symbol", 0.12, None),
    ("repeats", "adjacent", 0.15, None),
    ("variety", "same", 0.60, 0.35),
    ("capitals", "upper", 0.50, None),
    ("common", "uncommon", 0.97, 0.85),
    ("tables", "bars", 0.20, None),
    ("shouting", "marks", 0.25, None),
    ("length", "odd_length", 5.0, 3.0),
)
VARIETY_WORDS = 200


def statistics(text: str | None) -> np.ndarray:
    """The statistics the heuristics look at, in the order of HEURISTICS."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text) - text.count(" ") - text.count("\n"))
    if not n:
        return np.array([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 10.0])
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    symbols = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
    adjacent = sum(a == b for a, b in zip(words, words[1:])) / n
    # variety of equal stretches, so that long texts are not called monotonous for their length
    same = 1 - np.mean([len(set(words[i:i + VARIETY_WORDS])) / len(words[i:i + VARIETY_WORDS]) for i in range(0, n, VARIETY_WORDS)])
    uncommon = 1 - sum(w in COMMON for w in text.lower().split()) / n
    return np.array([symbols / chars, adjacent, same, upper / max(1, upper + lower), uncommon,
                     kinds[124] / n, kinds[33] / n, abs(chars / n - 5.5)])


def votes_of(stats: np.ndarray) -> str:
    """One letter per heuristic: g(ood), b(ad) or - (abstains)."""
    return "".join("b" if s >= bad else "g" if good is not None and s <= good else "-" for s, (_, _, bad, good) in zip(stats, HEURISTICS))


def estimate(counts: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], np.ndarray]:
    """(posterior of good per pattern, P(vote | class) as [class, heuristic, vote]) by EM over pattern counts.

    Starts from the vote majority; the first class is bad, the second good.
    """
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    vote = np.array([["b-g".index(c) for c in p] for p in patterns])
    onehot = np.eye(3)[vote]
    onehot[:, :, 1] = 0.0  # an abstention is no evidence
    bad, good = (vote == 0).sum(axis=1), (vote == 2).sum(axis=1)
    # one clear fault outweighs several heuristics that see nothing wrong
    post = 1 / (1 + np.exp(-(good - 2.0 * bad)))
    table = None
    for _ in range(rounds):
        resp = np.stack((1 - post, post))
        # add-one smoothing keeps classes from losing a vote for good
        table = np.einsum("cp,p,phv->chv", resp, weight, onehot) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = (resp * weight).sum(axis=1) + 1.0
        logs = np.log(prior / prior.sum())[:, None] + np.einsum("chv,phv->cp", np.log(table), onehot)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(patterns, post.tolist())), table


def features(text: str | None, stats: np.ndarray) -> np.ndarray:
    """Hashed, length-normalised features: byte triples and statistic bins."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(BUCKETS)
    for at in range(0, max(0, len(raw) - 2), 1 << 20):
        part = raw[at:at + (1 << 20) + 2].astype(np.uint32)
        code = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(20), minlength=BUCKETS)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    out = out / norm if norm else out
    for k, (s, (_, _, bad, good)) in enumerate(zip(stats, HEURISTICS)):
        bin_ = int(np.clip(np.floor(8 * s / bad), 0, 15))
        out[(k * 16 + bin_) * 2654435761 % (1 << 32) >> 20] += 0.5
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels, by accelerated gradient steps."""
    design = np.hstack((x, np.ones((len(x), 1))))
    w = look = np.zeros(design.shape[1])
    step = 4.0 / (np.square(design).sum(axis=1).max() + ridge)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-design @ look))
        new = look - step * (design.T @ (p - y) / len(y) + ridge * look)
        look, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def tag_votes(docs: DataFrame, text_col: str = "text", cols: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``cols``) plus struct ``TAG`` with ``votes``."""
    def make():
        import pyarrow as pa

        return lambda texts: [pa.array([votes_of(statistics(t.as_py())) for t in texts], pa.string())]

    return tag_rows(docs, text_col, make, [("votes", "string")], cols)


def _vectors(batches):
    """Votes and features of whole texts."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t.as_py() for t in part.column(2)]
            stats = [statistics(t) for t in texts]
            x = [features(t, s).astype(np.float32).tobytes() for t, s in zip(texts, stats)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([votes_of(s) for s in stats], pa.string()), pa.array(x, pa.binary())],
                names=["a", "b", "votes", "x"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], tuple[np.ndarray, float]]:
    """(posterior per vote pattern, scorer weights)."""
    voted, _ = cut(tag_votes(docs.select(id_col, text_col), text_col, [id_col]).select(F.col(id_col).alias("id"), f"{TAG}.votes"), "quality-votes")
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}, (np.zeros(BUCKETS), 0.0)
    posterior, _ = estimate(counts)
    sides = [[p for p, v in posterior.items() if (v >= 0.5) == side] for side in (False, True)]
    sample = None
    for patterns in sides:
        part = (voted.filter(F.col("votes").isin(patterns) & F.col("id").isNotNull())
                .orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(MAX_TRAIN_DOCS // 2))
        sample = part if sample is None else sample.union(part)
    sample = sample.select(F.col("id").alias("sample_id"), F.lit(True).alias("sampled")).distinct()
    # at most MAX_TRAIN_DOCS ids; a sampled text gives a vector of fixed size, whatever its length
    picked = (docs.join(F.broadcast(sample), F.col(id_col) == F.col("sample_id"))
              .select(F.xxhash64(F.col("sample_id").cast("string")).alias("a"), F.xxhash64(F.col(text_col)).alias("b"), F.col(text_col).alias("text")))
    rows = picked.mapInArrow(_vectors, "a bigint, b bigint, votes string, x binary").orderBy("a", "b").limit(MAX_TRAIN_DOCS).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float) if rows else np.zeros((0, BUCKETS))
    y = np.array([posterior[r["votes"]] for r in rows])
    return posterior, fit_scorer(x, y) if len(rows) else (np.zeros(BUCKETS), 0.0)


def score(docs: DataFrame, posterior: dict[str, float], scorer: tuple[np.ndarray, float], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per document: id, votes, posterior (of its votes), score in [0, 1], predicted (1: good)."""
    shared = docs.sparkSession.sparkContext.broadcast((posterior, scorer))  # fixed size

    def make():
        import pyarrow as pa

        posterior, (w, bias) = shared.value

        def kernel(texts):
            votes, scores = [], []
            for t in texts:
                text = t.as_py()
                s = statistics(text)
                votes.append(votes_of(s))
                scores.append(1 / (1 + np.exp(-np.clip(features(text, s) @ w + bias, -500, 500))))
            return [pa.array(votes, pa.string()), pa.array([posterior.get(v, 0.5) for v in votes], pa.float64()), pa.array(scores, pa.float64())]

        return kernel

    tagged = tag_rows(docs.select(id_col, text_col), text_col, make, [("votes", "string"), ("posterior", "double"), ("score", "double")], [id_col])
    return tagged.select(id_col, f"{TAG}.votes", f"{TAG}.posterior", f"{TAG}.score",
                         F.when(F.col(f"{TAG}.score") >= 0.5, 1).otherwise(0).alias("predicted"))
