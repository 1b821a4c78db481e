"""Quality classifier on supervised subword embeddings (operator 12).

A text's features are its words, the character n-grams inside each word (with a space on both sides), and pairs of
adjacent words; each is hashed to one of ``BUCKETS`` vectors, and all pairs of a word and itself to the same one. A
document is the average of its features' vectors and of ``PADS`` zero vectors, and a softmax over a linear map of that average gives the classes. Vectors and map are learned together by stochastic gradient
descent in numpy on at most ``DOCS`` labelled documents per class, whole texts; a text is at most ``BUCKETS`` counts there.

The map is linear, so scoring adds up, per feature, one number a class: a distinct word's sum over its n-grams is taken
once per block of texts, and a text costs one look-up per word and one per pair.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulearn.llm.frames import chunks, held, thinned

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
DIMS = 16
GRAMS = (2, 3, 4)
DOCS = 1500
EPOCHS, RATE = 8, 4.0
KNOWN = 150_000
BLOCK_CHARS = 2_000_000
# Odd multipliers of the hashes.
STEP, PAIR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
SAME = 0
PADS = 40  # features without weight in every average, so that a few words are weak evidence
PIECE = re.compile(rb"[^\x20\x09-\x0D]+")


def bucket(hashes: np.ndarray) -> np.ndarray:
    h = (hashes ^ (hashes >> np.uint64(32))) * MIX
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_features(words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash per word, word of each feature, bucket of each feature) of words as bytes; a word itself is a feature."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = " " + b" ".join(words).decode("utf-8", "replace") + " "
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    spaces = np.flatnonzero(points == 32)
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(map(len, words)) + 1, STEP, np.uint64))])
    at = np.arange(len(points)) - spaces[np.maximum(np.searchsorted(spaces, np.arange(len(points)), "right") - 1, 0)]
    # A word's hash adds up its letters, each times a power of its place behind the space in front.
    sums = np.cumsum(points * powers[at])
    hashes = sums[spaces[1:] - 1] - sums[spaces[:-1]]
    owners, buckets = [np.arange(len(words))], [bucket(hashes)]
    for n in GRAMS:
        starts = np.arange(max(len(points) - n + 1, 0))
        rank = np.searchsorted(spaces, starts, "right")
        inside = rank < len(spaces)
        starts, rank = starts[inside], rank[inside]
        fits = starts + n - 1 <= spaces[rank]
        starts, rank = starts[fits], rank[fits]
        h = np.full(len(starts), n, np.uint64)
        for k in range(n):
            h = h * STEP + points[starts + k]
        owners.append(rank - 1)
        buckets.append(bucket(h))
    return hashes, np.concatenate(owners), np.concatenate(buckets)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """One per pair of adjacent words; all pairs of a word and itself share one."""
    a, b = hashes[:-1], hashes[1:]
    return np.where(a == b, SAME, bucket(a * PAIR + b))


def feature_counts(text: bytes) -> np.ndarray:
    """How often each bucket occurs in a text."""
    out = np.zeros(BUCKETS)
    last = None
    for words in word_blocks(text):
        place = {}
        codes = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
        hashes, owners, buckets = word_features(list(place))
        out += np.bincount(buckets, np.bincount(codes, minlength=len(place))[owners], BUCKETS)
        row = hashes[codes] if last is None else np.append(last, hashes[codes])
        out += np.bincount(pair_buckets(row), minlength=BUCKETS)
        last = row[-1:]
    return out


def word_blocks(text: bytes):
    """The words of a text in lists of bounded size."""
    if len(text) <= BLOCK_CHARS:
        words = text.split()
        if words:
            yield words
        return
    words = []
    for m in PIECE.finditer(text):
        words.append(m.group())
        if len(words) == KNOWN:
            yield words
            words = []
    if words:
        yield words


class Embeddings:
    """Hashed feature vectors, their map to the classes, and a bias."""

    def __init__(self, classes: list, dims: int = DIMS, seed: int = 12):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.vectors = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims))
        self.map, self.bias = np.zeros((dims, len(classes))), np.zeros(len(classes))

    def softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.map + self.bias
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def gradients(self, buckets: np.ndarray, share: np.ndarray, label: int):
        """Of the log loss of one document: for its buckets' vectors (as share times a row), the map and the bias."""
        hidden = share @ self.vectors[buckets]
        off = self.softmax(hidden)
        off[label] -= 1
        return self.map @ off, np.outer(hidden, off), off

    def train(self, docs: list, labels: list, weights: list, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7):
        """``docs``: (buckets, shares) each. One step a document, in a new order each epoch, at a rate that falls to zero."""
        rng, step, steps = np.random.default_rng(seed), 0, epochs * len(docs)
        prior = np.array([sum(w for y, w in zip(labels, weights) if y == c) for c in range(len(self.classes))])
        self.bias = np.log(np.maximum(prior, 1e-9) / max(prior.sum(), 1e-9))
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                buckets, share = docs[i]
                now = rate * weights[i] * (1 - step / steps)
                row, out, off = self.gradients(buckets, share, labels[i])
                # A share of a long text is small, so its vectors move further.
                self.vectors[buckets] -= now * share[:, None] * row * len(share) ** 0.5
                self.map -= now * 0.1 * out
                self.bias -= now * 0.01 * off
                step += 1
        return self


class Scorer:
    """Per worker: what each bucket adds to each class, and the words met lately."""

    def __init__(self, model: Embeddings):
        self.model = model
        self.adds = model.vectors @ model.map
        self.reset()

    def reset(self):
        self.place, k = {}, self.adds.shape[1]
        self.hashes, self.sums = np.zeros(0, np.uint64), np.zeros((0, k + 1))

    def learn(self, words: set):
        new = words.difference(self.place)
        if len(self.place) + len(new) > KNOWN:
            self.reset()
            new = words
        new = list(new)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        hashes, owners, buckets = word_features(new)
        columns = [np.bincount(owners, self.adds[buckets, c], len(new)) for c in range(self.adds.shape[1])]
        sums = np.column_stack([*columns, np.bincount(owners, minlength=len(new))])
        self.hashes, self.sums = np.concatenate([self.hashes, hashes]), np.concatenate([self.sums, sums])

    def total(self, words: list, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the words and of their pairs, the one with the word before included, and the last hash."""
        codes = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        row = np.concatenate([last, self.hashes[codes]])
        pairs = pair_buckets(row)
        return self.sums[codes].sum(axis=0) + np.append(self.adds[pairs].sum(axis=0), len(pairs)), row[-1:]

    def probabilities(self, texts: list) -> np.ndarray:
        """(text, class) for texts as bytes; without words the bias alone speaks."""
        out = np.zeros((len(texts), self.adds.shape[1]))
        at = 0
        for part in chunks(texts, map(len, texts), BLOCK_CHARS):
            if len(part) == 1:
                total, last = np.zeros(self.adds.shape[1] + 1), np.zeros(0, np.uint64)
                for words in word_blocks(part[0]):
                    self.learn(set(words))
                    more, last = self.total(words, last)
                    total = total + more
                out[at] = total[:-1] / (total[-1] + PADS)
                at += 1
                continue
            split = [t.split() for t in part]
            self.learn(set().union(*split))
            for words in split:
                if words:
                    total, _ = self.total(words, np.zeros(0, np.uint64))
                    out[at] = total[:-1] / (total[-1] + PADS)
                at += 1
        z = out + self.model.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        docs: int = DOCS, **training) -> Embeddings:
    """Learn from at most ``docs`` documents of each label 0 and 1 for which ``learn`` holds.

    An id is one document: of rows that share it the text with the smallest hash is read, and labels that disagree are
    left out. Classes weigh as all their labelled ids do. Without labels of both kinds the prior alone is learned.
    """
    marked = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
    marked = marked.where("label = other")
    totals = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not totals:
        return Embeddings([0, 1])
    mark = F.xxhash64(F.col("id").cast("string"))
    picked = None  # at most two times ``docs`` rows of two numbers, so their copy to every task is bounded
    for label in sorted(totals):
        part = marked.where((F.col("label") == label) & thinned(mark, docs, totals[label])).orderBy(mark, "id").limit(docs)
        picked = part if picked is None else picked.unionByName(part)
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(picked.select("id", "label")), F.col("doc") == F.col("id"))
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))

    def count(batches):
        for batch in batches:
            found = [feature_counts(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            at = [np.flatnonzero(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(at, pa.list_(pa.int32())),
                                              pa.array([f[a] for f, a in zip(found, at)], pa.list_(pa.float64()))], ["id", "label", "at", "n"])

    kind = marked.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(count, f"id {kind}, label int, at array<int>, n array<double>").orderBy("id")
    model, sample, codes, weights = Embeddings(sorted(totals)), [], [], []
    grow = {k: n / min(n, docs) for k, n in totals.items()}
    for r in found.toLocalIterator():
        n = np.array(r["n"])
        sample.append((np.array(r["at"], np.int64), n / (n.sum() + PADS)))
        codes.append(model.classes.index(r["label"]))
        weights.append(grow[r["label"]])
    mean = sum(weights) / max(len(weights), 1)
    return model.train(sample, codes, [w / mean for w in weights], **training) if sample else model


def score(df: DataFrame, model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", positive: int = 1) -> DataFrame:
    """(id_col, score, predicted) per row; ``model`` is a broadcast Embeddings, the score is the probability of ``positive``.

    Whole texts are read, however long. Null and empty texts and those without a word score as the prior says; a
    model that has seen one class alone gives 0 or 1.
    """
    call = f"quality-{id(model)}-{np.random.default_rng().integers(1 << 62)}"

    def run(batches):
        scorer = held(call, lambda: Scorer(model.value))
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            classes = scorer.model.classes
            p = scorer.probabilities(texts)[:, classes.index(positive)] if positive in classes else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], [id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    scored = df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
