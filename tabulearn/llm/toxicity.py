"""Toxicity by a lexicon, misspellings included, and the context of each hit (operator 7).

The lexicon is learned from labelled rows: words, and word beginnings that many different words share, that are far
more frequent in toxic documents. A word of a text is looked up by running its Levenshtein automaton (the sets of its
places reachable with 0, 1 or 2 edits, as bits) along the lexicon's trie. Each hit gets a weight from a window around
it, where quotation marks and words of reporting speak for a quotation. A logistic model turns a document's sums into
a score. The fit reads at most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` labelled documents and takes the ``TERMS`` features
that are in most distinct toxic texts of these, if in ``LEAST_DOCS`` at least; scoring reads whole texts.
"""

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulearn.llm.frames import chunks, held, thinned

TOXIC_DOCS, CLEAN_DOCS = 3000, 6000
TERMS = 2000
LEAST_DOCS, LEAST_SHARE = 5, 0.8
STEMS = range(4, 9)
WINDOW = 60
KNOWN = 300_000
BLOCK_CHARS = 2_000_000
TOKEN = re.compile(r"[\w@$](?:[\w@$*]*\w)?")
RUNS = re.compile(r"(.)\1{2,}")
# Quotation marks, and words that report speech in the four languages of the tables.
OPENING, CLOSING, EITHER = "“„«‹", "”»›", "\""
REPORTING = re.compile(r"\b(said|says|wrote|writes|called|quoted?|quoting|word|term|slur|dit|écrit|mot|terme|sagte|sagt|schrieb|wort|begriff|dijo|dice|escribió|palabra|término)\b")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Trie:
    """Lexicon words by letter; a node knows the edits and lengths that the words below it allow."""

    def __init__(self, words):
        root = {}
        for w in words:
            node = root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.root = self.packed(root)

    def packed(self, node: dict) -> tuple:
        """(edits at this end or -1, most edits below, shortest and longest match, [(letter, node)])."""
        below = [(c, self.packed(n)) for c, n in node.items() if c]
        word = node.get("")
        ends = [] if word is None else [(edits_allowed(word), len(word) - edits_allowed(word), len(word) + edits_allowed(word))]
        known = ends + [n[1:4] for _, n in below]
        return (ends[0][0] if ends else -1, max((k[0] for k in known), default=-1), min((k[1] for k in known), default=0), max((k[2] for k in known), default=-1), below)

    @staticmethod
    def along(word: str, term: str) -> int:
        """Edits of the word's automaton to the end of one branch of the trie, or -1 if they are more than the branch allows."""
        size, allowed = len(word), edits_allowed(term)
        places = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        full, s0, s1, s2 = (1 << size + 1) - 1, 1, 3, 7
        for c in term:
            m = places.get(c, 0)
            t0 = (s0 & m) << 1
            t1 = ((s1 & m) << 1 | s0 | s0 << 1 | t0 << 1) & full
            s2 = ((s2 & m) << 1 | s1 | s1 << 1 | t1 << 1) & full
            s0, s1 = t0, t1
        edits = 0 if s0 >> size & 1 else 1 if s1 >> size & 1 else 2 if s2 >> size & 1 else 3
        return edits if edits <= allowed else -1

    def distance(self, word: str) -> int:
        """Fewest edits to a lexicon word that allows them, or -1."""
        size = len(word)
        if not self.root[2] <= size <= self.root[3]:
            return -1
        places = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        full, end, best = (1 << size + 1) - 1, 1 << size, 3
        todo = [(self.root, 1, 3, 7)]
        while todo:
            (allowed, _, _, _, below), s0, s1, s2 = todo.pop()
            if allowed >= 0:
                hit = 0 if s0 & end else 1 if s1 & end else 2 if s2 & end else 3
                if hit <= allowed and hit < best:
                    best = hit
            for c, node in below:
                if not node[2] <= size <= node[3]:
                    continue
                m = places.get(c, 0)
                t0 = (s0 & m) << 1
                t1 = ((s1 & m) << 1 | s0 | s0 << 1 | t0 << 1) & full
                if node[1] < 2:
                    if t0 if node[1] == 0 else t1:
                        todo.append((node, t0, t1, 0))
                else:
                    t2 = ((s2 & m) << 1 | s1 | s1 << 1 | t1 << 1) & full
                    if t2:
                        todo.append((node, t0, t1, t2))
        return best if best < 3 else -1


# Odd multipliers of the hashes.
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
MASK_BITS = 24
FORMS = 4_000_000  # hashes at once


def shortened(words: list, size: int, most: int) -> np.ndarray:
    """Hashes (word, form) of words of one size with up to ``most`` letters left out."""
    points = np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(len(words), size).astype(np.uint64)
    power = np.array([pow(BASE, i, 2**64) for i in range(size)], np.uint64)
    back = np.uint64(pow(BASE, -1, 2**64))
    sums = np.zeros((len(words), size + 1), np.uint64)
    np.cumsum((points + np.uint64(1)) * power, axis=1, out=sums[:, 1:])
    whole = sums[:, -1:]
    out = [whole]
    if most >= 1:
        out.append(sums[:, :-1] + (whole - sums[:, 1:]) * back)
    if most >= 2 and size >= 2:
        i, j = np.triu_indices(size, 1)
        out.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * back + (whole - sums[:, j + 1]) * np.uint64(pow(BASE, -2, 2**64)))
    out = np.concatenate(out, axis=1) * MIX
    return out ^ (out >> np.uint64(32))


class Neighbours:
    """The hashes of the lexicon's shortened forms with their words, and a mask over the hashes' first bits."""

    def __init__(self, words):
        self.words, hashes, owners = words, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        places = np.array([len(w) for w in words], np.int64)
        for size in np.unique(places).tolist():
            mine = np.flatnonzero(places == size)
            forms = shortened([words[i] for i in mine], size, edits_allowed(words[mine[0]]))
            hashes.append(forms.ravel())
            owners.append(np.repeat(mine, forms.shape[1]))
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.mask = np.zeros(1 << MASK_BITS, bool)
        self.mask[self.hashes >> np.uint64(64 - MASK_BITS)] = True
        sizes = [(len(w) - edits_allowed(w), len(w) + edits_allowed(w)) for w in words]
        self.shortest, self.longest = min((a for a, _ in sizes), default=1), max((b for _, b in sizes), default=0)

    def pairs(self, words: list) -> dict:
        """Per word the lexicon words that share a form with it; none within its edits is missing."""
        by_size, out = {}, {}
        for w in words:
            if self.shortest <= len(w) <= self.longest:
                by_size.setdefault(len(w), []).append(w)
        for size, mine in by_size.items():
            # A word of this size can be within two edits of a word of eight letters, or within one of five.
            most = 2 if size >= 6 else 1 if size >= 4 else 0
            step = max(1, FORMS // (1 + size + size * size // 2))
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                forms = shortened(part, size, most)
                row, place = np.nonzero(self.mask[forms >> np.uint64(64 - MASK_BITS)])
                found = forms[row, place]
                low, high = np.searchsorted(self.hashes, found), np.searchsorted(self.hashes, found, "right")
                n = high - low
                owner = self.owners[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                for pair in np.unique(np.repeat(row, n) * len(self.words) + owner).tolist():
                    out.setdefault(part[pair // len(self.words)], []).append(self.words[pair % len(self.words)])
        return out


class Lexicon:
    """Words and word beginnings, with the weights of the logistic model."""

    def __init__(self, words=(), stems=()):
        self.words, self.stems = sorted(words), sorted(stems)
        self.trie, self.neighbours, self.stem_set = Trie(self.words), None, frozenset(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self.weights, self.bias = np.zeros(len(FEATURES)), -5.0

    def kind(self, word: str) -> int:
        return self.kinds([word])[0]

    def kinds(self, words: list) -> list:
        """Per word 0 for no hit, 1 as in the lexicon, 2 misspelled."""
        if self.neighbours is None:  # made where it is used, so that the mask isn't sent
            self.neighbours = Neighbours(self.words)
        stems, sizes = self.stem_set, self.stem_sizes
        out = [1 if any(w[:n] in stems for n in sizes) else 0 for w in words]
        rest = [i for i, kind in enumerate(out) if not kind]
        run = {i: RUNS.sub(r"\1", words[i]) for i in rest if RUNS.search(words[i])}
        near = self.neighbours.pairs([words[i] for i in rest] + list(run.values()))

        def distance(word):
            return min((d for t in near.get(word, ()) if (d := self.trie.along(word, t)) >= 0), default=-1)

        for i in rest:
            edits = distance(words[i])
            if edits == -1 and i in run:
                edits = distance(run[i])
                edits = edits if edits == -1 else edits + 1
            out[i] = 0 if edits == -1 else 1 if edits == 0 else 2
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ self.weights + self.bias)))


FEATURES = ("plain hits", "misspelled hits", "quoted hits", "hits per hundred words")


def quoted(text: str, start: int, end: int) -> bool:
    """A hit between quotation marks of its paragraph, or next to a word of reporting with a mark in the window."""
    left = text[max(0, start - WINDOW) : start].rpartition("\n")[2]
    right = text[end : end + WINDOW].partition("\n")[0]
    inside = max(map(left.rfind, OPENING)) > max(map(left.rfind, CLOSING)) and any(c in right for c in CLOSING + "“")
    plain = left.count(EITHER) % 2 == 1 and EITHER in right
    return inside or plain or bool(REPORTING.search(left[-30:])) and any(c in left or c in right for c in OPENING + EITHER + "'")


class Scorer:
    """Per worker: the lexicon and the words met lately."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def features(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)))
        at = 0
        for part in chunks(texts, map(len, texts), BLOCK_CHARS):
            lowered = [t.lower() for t in part]
            counts = [Counter(TOKEN.findall(t) if len(t) <= BLOCK_CHARS else (m.group() for m in TOKEN.finditer(t))) for t in lowered]
            self.learn(set().union(*counts))
            for text, count in zip(lowered, counts):
                out[at] = self.of(text, count)
                at += 1
        return out

    def learn(self, words: set):
        if len(self.known) > KNOWN:
            self.known = {}
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.lexicon.kinds(new)))

    def of(self, text: str, count: Counter) -> np.ndarray:
        known = self.known
        hits = {w for w in count if known[w]}
        if not hits:
            return np.zeros(len(FEATURES))
        sums = [0, 0, 0]
        for m in TOKEN.finditer(text):
            if m.group() in hits:
                sums[2 if quoted(text, m.start(), m.end()) else known[m.group()] - 1] += 1
        open_hits = sums[0] + sums[1]
        return np.array([np.log1p(sums[0]), np.log1p(sums[1]), np.log1p(sums[2]), np.log1p(100 * open_hits / sum(count.values()))])


def word_features(text: str) -> set:
    words = set(TOKEN.findall(text.lower()))
    return {w for w in words if len(w) >= 3} | {w[:n] + "…" for w in words for n in STEMS if len(w) > n}


def choose(candidates: list) -> tuple[list, list]:
    """Words and stems from (feature, toxic documents): a stem only where no single word explains it, and the shortest such."""
    docs = dict(candidates)
    top = Counter()
    for f, n in candidates:
        if not f.endswith("…"):
            for size in STEMS:
                top[f[:size]] = max(top[f[:size]], n)
    stems = []
    for f in sorted((f for f in docs if f.endswith("…")), key=lambda f: (len(f), f)):
        stem = f[:-1]
        if top[stem] < 0.5 * docs[f] and not any(stem.startswith(s) for s in stems):
            stems.append(stem)
    words = [f for f in docs if not f.endswith("…") and not any(f.startswith(s) for s in stems)]
    return words, stems


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Lexicon:
    """Learn from at most ``toxic_docs`` and ``clean_docs`` rows labelled 1 and 0 for which ``learn`` holds.

    Without labelled rows of both kinds every document scores near zero.
    """
    spark = df.sparkSession
    marked = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    totals = dict(marked.groupBy("label").count().collect())
    mark = F.xxhash64(F.col("id").cast("string"))
    # At most toxic_docs + clean_docs small rows remain, so their copy to every task is bounded.
    picked = None
    for label, most in ((1, toxic_docs), (0, clean_docs)):
        part = marked.where((F.col("label") == label) & thinned(mark, most, totals.get(label, 0))).orderBy(mark, "id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    sample = docs.join(F.broadcast(picked.select("id", "label")), F.col("doc") == F.col("id")).select("label", "text")

    def count(batches):
        for batch in batches:
            texts, label = batch.column("text").fill_null("").to_pylist(), batch.column("label").to_pylist()
            toxic, clean = Counter(), Counter()
            for t, y in zip(texts, label):
                (toxic if y else clean).update(word_features(t))
            names = list(toxic)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "toxic": pa.array([toxic[f] for f in names], pa.int64()),
                                              "clean": pa.array([clean[f] for f in names], pa.int64())})
            names = [f for f in clean if f not in toxic]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "toxic": pa.array([0] * len(names), pa.int64()),
                                              "clean": pa.array([clean[f] for f in names], pa.int64())})

    both = totals.get(0, 0) and totals.get(1, 0)
    if not both:
        return Lexicon()
    grow_toxic, grow_clean = max(1.0, totals[1] / toxic_docs), max(1.0, totals[0] / clean_docs)
    # Copies of a text count once, or the words of a few copies of one document would be terms.
    sums = sample.dropDuplicates(["label", "text"]).mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = F.col("toxic") * grow_toxic / (F.col("toxic") * grow_toxic + F.col("clean") * grow_clean + 1)
    kept = sums.where((F.col("toxic") >= LEAST_DOCS) & (share >= LEAST_SHARE)).orderBy(F.desc("toxic"), "feature").limit(TERMS)
    lexicon = Lexicon(*choose([(r["feature"], r["toxic"]) for r in kept.collect()]))

    send = spark.sparkContext.broadcast(lexicon)
    rows = np.array([[r["label"], *r["x"]] for r in featured(sample, send, "label").orderBy("label", "x").toLocalIterator()])
    y = rows[:, 0]
    lexicon.weights, lexicon.bias = logistic(rows[:, 1:], y, np.where(y == 1, grow_toxic, grow_clean))
    return lexicon


def featured(df: DataFrame, lexicon, keep: str, text_col: str = "text") -> DataFrame:
    """(keep, x array<double>) per row."""
    call = uuid.uuid4().hex

    def run(batches):
        scorer = held(call, lambda: Scorer(lexicon.value))
        for batch in batches:
            x = scorer.features(batch.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], [keep, "x"])

    return df.select(keep, text_col).mapInArrow(run, f"`{keep}` {df.schema[keep].dataType.simpleString()}, x array<double>")


def score(df: DataFrame, lexicon, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) per row; ``lexicon`` is a broadcast Lexicon. Null and empty texts have no hits."""
    call = uuid.uuid4().hex

    def run(batches):
        scorer = held(call, lambda: Scorer(lexicon.value))
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            scores = scorer.lexicon.score(scorer.features(texts)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    scored = df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
