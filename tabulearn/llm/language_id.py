"""Language ID by a bidirectional gated recurrent network over bytes (operator 5).

The network reads each word's bytes between two spaces, in both directions, and gives every position the
probabilities of the languages; a document's are the mean over all its positions. A word's positions depend on that
word alone, so a distinct word is run once per block of documents and counted as often as it occurs. Training is
backpropagation through time in numpy on a bounded sample of labelled rows: at most ``DOCS`` documents per language
and ``PIECE`` consecutive characters of each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulearn.llm.frames import blocks, chunks, given_back, text_lists, thinned

DOCS = 300
PIECE = 3000
HIDDEN = 16
STEPS = 500
BATCH = 256
WIDTHS = (8, 16, 26)  # word bytes with the two spaces; longer words are read in pieces
KNOWN = 250_000
BLOCK_CHARS = 2_000_000
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.tanh(x * np.float32(0.5), out=x)
    return x * np.float32(0.5) + np.float32(0.5)


class BiGru:
    """Two gated recurrent layers over bytes and a softmax over both states at each position."""

    def __init__(self, languages: list, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
        self.w = {}
        for side in "fb":
            self.w |= {f"{side}E": draw(256, 3 * hidden), f"{side}U": draw(hidden, 2 * hidden), f"{side}C": draw(hidden, hidden),
                       f"{side}O": draw(hidden, len(languages))}
        self.w["bias"] = np.zeros(len(languages), np.float32)

    def layer(self, side: str, x: np.ndarray, keep: list = None) -> np.ndarray:
        """States (time, row, unit) of one direction over bytes (time, row)."""
        E, U, C = (self.w[side + k] for k in "EUC")
        n = C.shape[0]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)):
            a = E[x[t]]
            gates = sigmoid(h @ U + a[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh((r * h) @ C + a[:, 2 * n :])
            if keep is not None:
                keep.append((h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def layer_back(self, side: str, x: np.ndarray, kept: list, d_out: np.ndarray, grads: dict):
        U, C = self.w[side + "U"], self.w[side + "C"]
        n = C.shape[0]
        dh = np.zeros_like(d_out[0])
        d_in = np.empty((*x.shape, 3 * n), np.float32)
        gU, gC = np.zeros_like(U), np.zeros_like(C)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = kept[t]
            dh = dh + d_out[t]
            d_c = dh * z * (1 - c * c)
            d_rh = d_c @ C.T
            d_gates = np.concatenate([dh * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            gC += (r * h).T @ d_c
            gU += h.T @ d_gates
            d_in[t, :, : 2 * n], d_in[t, :, 2 * n :] = d_gates, d_c
            dh = dh * (1 - z) + d_rh * r + d_gates @ U.T
        flat, byte = d_in.reshape(-1, 3 * n), x.ravel()
        grads[side + "E"] = np.column_stack([np.bincount(byte, flat[:, j], 256) for j in range(3 * n)]).astype(np.float32)
        grads[side + "U"], grads[side + "C"] = gU, gC

    def states(self, x: np.ndarray, sizes: np.ndarray, keep=None):
        """Both directions' states per position, the turned bytes, and the place each position has when read backwards."""
        turn = np.maximum(sizes - 1 - np.arange(len(x))[:, None], 0)
        turned = np.take_along_axis(x, turn, 0)
        ahead = self.layer("f", x, keep and keep[0])
        behind = self.layer("b", turned, keep and keep[1])
        return ahead, np.take_along_axis(behind, turn[:, :, None], 0), turned, turn

    def probabilities(self, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        logits = ahead @ self.w["fO"] + behind @ self.w["bO"] + self.w["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=-1, keepdims=True)

    def gradients(self, x: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> dict:
        keep = [[], []]
        turn = np.maximum(sizes - 1 - np.arange(len(x))[:, None], 0)
        turned = np.take_along_axis(x, turn, 0)
        ahead, raw = self.layer("f", x, keep[0]), self.layer("b", turned, keep[1])
        behind = np.take_along_axis(raw, turn[:, :, None], 0)
        d = self.probabilities(ahead, behind)
        known = (np.arange(len(x))[:, None] < sizes)[:, :, None]
        d[:, np.arange(x.shape[1]), label] -= 1
        d = np.where(known, d, 0).astype(np.float32) / np.float32(known.sum())
        flat = d.reshape(-1, d.shape[2])
        grads = {"fO": ahead.reshape(-1, ahead.shape[2]).T @ flat, "bO": behind.reshape(-1, behind.shape[2]).T @ flat, "bias": flat.sum(axis=0)}
        self.layer_back("f", x, keep[0], d @ self.w["fO"].T, grads)
        back = np.where(known, d @ self.w["bO"].T, 0).astype(np.float32)
        self.layer_back("b", turned, keep[1], np.where(known, np.take_along_axis(back, turn[:, :, None], 0), 0).astype(np.float32), grads)
        return grads

    def train(self, words: list, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 9):
        """``words``: a list of word occurrences per language; every step draws equally from all of them."""
        rng = np.random.default_rng(seed)
        pools = [pack(w, WIDTHS[-1]) for w in words]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        each = max(1, batch // max(1, len(pools)))
        for step in range(1, steps + 1):
            picks = [rng.integers(0, len(sizes), each) for _, sizes in pools]
            x = np.concatenate([p[:, i] for (p, _), i in zip(pools, picks)], axis=1)
            sizes = np.concatenate([s[i] for (_, s), i in zip(pools, picks)])
            grads = self.gradients(x[: sizes.max()], sizes, np.repeat(np.arange(len(pools)), each))
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def word_sums(self, words: list) -> np.ndarray:
        """Per word the languages' probabilities summed over its positions, then the number of positions."""
        pieces, owner = [], []
        long = WIDTHS[-1] - 2
        for i, w in enumerate(words):
            if len(w) <= long:
                pieces.append(w)
                owner.append(i)
            else:
                cut = [w[k : k + long] for k in range(0, len(w), long)]
                pieces += cut
                owner += [i] * len(cut)
        owner, sizes = np.array(owner, np.int64), np.fromiter(map(len, pieces), np.int64, len(pieces)) + 2
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for part in np.array_split(rows, -(-len(rows) // 4096) or 1):
                if len(part):
                    x, n = pack([pieces[i] for i in part.tolist()], width)
                    ahead, behind, _, _ = self.states(x, n)
                    p = self.probabilities(ahead, behind)
                    p[np.arange(len(x))[:, None] >= n] = 0
                    np.add.at(out, owner[part], np.column_stack([p.sum(axis=0), n]))
        return out


def pack(words: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with a space on both sides as bytes (time, row), and their sizes."""
    sizes = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), width - 2) + 2
    data = b"".join([(b" " + w[: width - 2] + b" ").ljust(width) for w in words])
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(len(words), width).T).astype(np.int64), sizes


def split_words(text: str) -> list:
    return text.lower().encode("utf-8", "surrogatepass").split()


class Tagger:
    """Per task: the network and the sums of the words met lately."""

    def __init__(self, net: BiGru):
        self.net = net
        self.reset()

    def reset(self):
        self.place, self.sums = {}, np.zeros((0, len(self.net.languages) + 1), np.float32)

    def learn(self, words: set):
        new = words.difference(self.place)
        if len(self.place) + len(new) > KNOWN:
            self.reset()
            new = words
        new = list(new)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.sums = np.concatenate([self.sums, self.net.word_sums(new)])

    def pooled(self, words: list) -> np.ndarray:
        return self.sums[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)

    def label(self, texts: list):
        """(language, score) of each text."""
        if not self.net.languages:
            yield from [(UNKNOWN, 0.0)] * len(texts)
            return
        for part in chunks(texts, map(len, texts), BLOCK_CHARS):
            if len(part) == 1 and len(part[0]) > BLOCK_CHARS:
                total = 0.0
                for block in blocks(split_words(part[0]), KNOWN // 4):
                    self.learn(set(block))
                    total = total + self.pooled(block)
                yield self.verdict(part[0], total)
                continue
            split = [split_words(t) for t in part]
            self.learn(set().union(*split))
            for text, words in zip(part, split):
                yield self.verdict(text, self.pooled(words) if words else None)

    def labels(self, column: pa.Array):
        """(language, score) of each row of a text column."""
        for texts in text_lists(column, BLOCK_CHARS):
            yield from self.label(texts)

    def verdict(self, text: str, total) -> tuple[str, float]:
        if total is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        best = int(total[:-1].argmax())
        return self.net.languages[best], float(min(1.0, total[best] / total[-1]))


def fit(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = DOCS, piece: int = PIECE) -> BiGru:
    """Train on at most ``docs`` rows per non-null language for which ``learn`` holds, ``piece`` characters of each."""
    mark = F.xxhash64(F.col(id_col).cast("string"))
    start = (F.pmod(mark, F.greatest(F.length(text_col) - piece + 1, F.lit(1))) + 1).cast("int")
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), mark.alias("mark"), F.col(text_col).substr(start, F.lit(piece)).alias("text"))
    chosen = F.lit(False)
    for r in rows.groupBy("lang").count().collect():
        chosen = chosen | ((F.col("lang") == r["lang"]) & thinned(F.col("mark"), docs, r["count"]))
    best = rows.where(chosen).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "text"))).where(F.col("place") <= docs)
    words = {}
    for r in best.orderBy("lang", "place").toLocalIterator():
        words.setdefault(r["lang"], []).extend(split_words(r["text"]))
    words = {k: w for k, w in sorted(words.items()) if w}
    return BiGru(list(words)).train(list(words.values())) if words else BiGru([])


def predict(df: DataFrame, net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) per row; ``net`` is a broadcast BiGru.

    Null, empty and blank texts and those without a letter are "und" with score 0, as are all if no language was
    learned. Equal shares go to the language that comes first. Whole texts are read, however long.
    """

    @given_back
    def run(batches):
        tagger = Tagger(net.value)
        for batch in batches:
            found = list(tagger.labels(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             [id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def accepted(df: DataFrame, net, least: float = 0.35, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language with a score of at least ``least``, with their columns."""

    @given_back
    def run(batches):
        tagger = Tagger(net.value)
        for batch in batches:
            found = tagger.labels(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)
