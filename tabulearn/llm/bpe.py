"""BPE encoding and decoding with a given vocabulary file (operator 1).

A pre-token ("word") is held as a contiguous array of its parts and the rank of every adjacent pair. The array is
scanned for the smallest rank, the boundary inside that pair is deleted, and the ranks of the two neighbouring pairs
are refreshed, until no pair has a rank. All new words of a block with about equal length are worked on together, one row
of a matrix each. Words longer than the last of ``WIDTHS`` bytes, where repeated scans would be quadratic, use a heap
instead. A task keeps the words it has met lately, two generations of ``KNOWN``.
"""

import hashlib
import heapq
import json
import re
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabulearn.llm.frames import blocks, chunks, held, text_lists, trimmed

WIDTHS = (8, 16, 64)
KNOWN = 80_000
BLOCK_CHARS = 2_000_000
BLOCK_WORDS = 250_000
NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next code from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Tables of one vocabulary: small (some MB), loaded once on the driver and broadcast."""

    tokens: list  # token text by id
    letters: np.ndarray  # id of a byte inside a word, then of a byte that ends one
    letter_ranks: np.ndarray  # of a byte and the next letter
    pairs: np.ndarray  # left id * 2**32 + right id, ascending
    ranks: np.ndarray
    made: np.ndarray  # id of a merged pair, by rank
    special: dict  # text of a special token -> id
    words: str  # pattern of a pre-token
    lower: bool
    nfc: bool

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max(*vocab.values(), *special.values()))
        for text, i in [*vocab.items(), *special.items()]:
            tokens[i] = text
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        steps = spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = np.array([vocab[c + e] for e in ("", end) for c in byte_letters()], np.int32)
        loaded = cls(
            tokens, letters, None, keys[order], order.astype(np.int32), np.array([vocab[a + b] for a, b in merges], np.int32),
            special, split, any(s["type"] == "Lowercase" for s in steps), any(s["type"] == "NFC" for s in steps),
        )
        loaded.letter_ranks = loaded.rank(letters[:256, None], letters[None, :]).astype(np.int32)
        return loaded

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_RANK)


def merge_rows(vocab: Vocabulary, raw: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of at most ``width`` bytes, a row each; returns the final parts (left-aligned) and how many there are."""
    n = len(raw)
    counts = np.fromiter(map(len, raw), np.int64, n)
    data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in raw]), np.uint8).reshape(n, width).astype(np.int32)
    rows = np.arange(n)
    data[rows, counts - 1] += 256  # a byte that ends a word is a letter of its own
    parts = vocab.letters[data]
    ranks = np.full((n, width), NO_RANK)
    ranks[:, :-1] = vocab.letter_ranks[data[:, :-1] & 255, data[:, 1:]]
    columns = np.arange(width)
    ranks[columns >= counts[:, None] - 1] = NO_RANK
    live = np.flatnonzero(ranks.min(axis=1) != NO_RANK)
    p, r, c = parts[live], ranks[live], counts[live]
    while len(live):
        at = r.argmin(axis=1)
        rows = np.arange(len(live))
        merged = vocab.made[r[rows, at]]
        # Deleting the boundary moves everything behind it one place to the left.
        p[:, :-1] = np.where(columns[:-1] > at[:, None], p[:, 1:], p[:, :-1])
        r[:, :-1] = np.where(columns[:-1] >= at[:, None], r[:, 1:], r[:, :-1])
        p[rows, at] = merged
        r[:, -1] = NO_RANK
        c -= 1
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < c - 1)
        r[left, at[left] - 1] = vocab.rank(p[left, at[left] - 1], merged[left])
        r[rows, at] = NO_RANK
        r[right, at[right]] = vocab.rank(merged[right], p[right, at[right] + 1])
        go = r.min(axis=1) != NO_RANK
        if not go.all():
            done = ~go
            parts[live[done]], counts[live[done]] = p[done], c[done]
            live, p, r, c = live[go], p[go], r[go], c[go]
    return parts, counts


def merge_long(vocab: Vocabulary, parts: list) -> list:
    """The same result for one long word: smallest rank first, the leftmost of equals, by a heap."""
    after = [*range(1, len(parts)), -1]
    before = list(range(-1, len(parts) - 1))
    ranks = vocab.rank(np.array(parts[:-1], np.int32), np.array(parts[1:], np.int32)).tolist()
    heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(ranks) if r != NO_RANK]
    heapq.heapify(heap)

    def push(i):
        if i >= 0 and after[i] >= 0:
            r = int(vocab.rank(np.array([parts[i]]), np.array([parts[after[i]]]))[0])
            if r != NO_RANK:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        parts[i], parts[j] = int(vocab.made[r]), -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        push(before[i])
        push(i)
    return [p for p in parts if p >= 0]


def encode_words(vocab: Vocabulary, words: list) -> list:
    """Token ids (a list) of every word."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    out = [()] * len(words)
    low = 0
    for width in WIDTHS:
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for part in np.array_split(rows, -(-len(rows) * width // 2_000_000) or 1):
            if len(part):
                ids, counts = merge_rows(vocab, [raw[i] for i in part.tolist()], width)
                for i, row, n in zip(part.tolist(), ids.tolist(), counts.tolist()):
                    out[i] = row[:n]
    for i in np.flatnonzero(sizes > low).tolist():
        data = np.frombuffer(raw[i], np.uint8).astype(np.int32)
        data[-1] += 256
        out[i] = merge_long(vocab, vocab.letters[data].tolist())
    return out


def unassigned_letters() -> str:
    """Ranges of the code points that the pattern library takes for letters or digits though Unicode 15 has not assigned them."""
    codes = np.array([c for c in range(0x250, 0x110000) if unicodedata.category(chr(c)) == "Cn"])
    text = "".join(map(chr, codes.tolist()))
    taken = np.array(sorted({ord(c) for c in regex.findall(r"[\p{L}\p{N}]", text)}))
    cuts = np.flatnonzero(np.diff(taken) != 1) + 1
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in np.split(taken, cuts) if len(r))


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Cuts a text into pre-tokens the way the vocabulary's file says; special strings stand alone.

    Known difference: 55 capital letters that Unicode 16 and 17 added are not lower-cased.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.find = regex.compile(vocab.words)
        # Most texts have codes below 256 only; for them the standard library's pattern with the classes written out is faster.
        latin = "".join(map(chr, range(256)))
        classes = {c: "".join(map(re.escape, regex.findall(c, latin))) for c in (r"\s", r"\p{L}", r"\p{N}")}
        narrow = vocab.words
        for name, codes in classes.items():
            narrow = narrow.replace(name, codes)
        self.find_latin = re.compile(narrow)
        odd = unassigned_letters()
        self.odd = re.compile(f"[{odd}]")
        # With such letters in the text, each class loses them; they then count as other signs.
        self.find_odd = regex.compile(
            "(?V1)" + vocab.words.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{odd}]]")
            .replace(r"[\p{L}]", rf"[\p{{L}}--[{odd}]]").replace(r"|[\p{N}]|", rf"|[\p{{N}}--[{odd}]]|"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")") if vocab.special else None
        self.marks = tuple(vocab.special)

    def clean(self, text: str) -> str:
        if self.vocab.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.vocab.lower:
            if "Σ" in text:  # letter by letter, without the rule for a final sigma
                text = text.replace("Σ", "σ")
            text = text.lower()
        return text

    def pieces(self, text: str):
        """(is special, text) in order."""
        if self.special is None or not any(m in text for m in self.marks):
            return [(False, text)]
        return [(i % 2 == 1, p) for i, p in enumerate(self.special.split(text)) if p]

    def words(self, text: str):
        """Lists of pre-tokens, each of bounded length; a special string is a list of its own."""
        for special, piece in self.pieces(text):
            if special:
                yield [piece]
                continue
            text = self.clean(piece)
            if is_latin(text):
                find = self.find_latin
            else:
                find = self.find_odd if self.odd.search(text) else self.find
            if len(piece) <= BLOCK_CHARS:
                yield find.findall(text)
            else:
                yield from blocks((m.group() for m in find.finditer(text)), BLOCK_WORDS)


class Encoder:
    """What ``keeps`` make of the ids of the words met lately, one table for each."""

    def __init__(self, vocab: Vocabulary, *keeps, fixed=()):
        self.vocab, self.keeps, self.splitter = vocab, keeps, Splitter(vocab)
        self.fixed = [{text: keep([i]) for text, i in vocab.special.items()} for keep in keeps]
        for table, more in zip(self.fixed, fixed):
            table.update(more)
        self.reset()

    def reset(self):
        self.known, self.old = [dict(t) for t in self.fixed], [{} for _ in self.keeps]

    def learn(self, words: set) -> list:
        """The tables, with these words in them."""
        new = words.difference(self.known[0])
        if len(self.known[0]) + len(new) > KNOWN + len(self.fixed[0]):
            self.old, self.known = self.known, [dict(t) for t in self.fixed]
            new = words.difference(self.known[0])
        again = new.intersection(self.old[0])
        new = list(new - again)
        ids = encode_words(self.vocab, new)
        for table, old, keep in zip(self.known, self.old, self.keeps):
            table.update((w, old[w]) for w in again)
            table.update(zip(new, map(keep, ids)))
        return self.known

    def texts(self, texts: list):
        """For each text an iterator over blocks of its words, a block being one list of kept values per table."""
        for part in chunks(texts, map(len, texts), BLOCK_CHARS):
            if len(part) == 1 and len(part[0]) > BLOCK_CHARS:
                yield ([[*map(t.__getitem__, ws)] for t in self.learn(set(ws))] for ws in self.splitter.words(part[0]))
                continue
            split = [[*self.splitter.words(t)] for t in part]
            get = [t.__getitem__ for t in self.learn(set().union(*(ws for lists in split for ws in lists)))]
            for lists in split:
                yield [[[*map(g, ws)] for g in get] for ws in lists if ws]


def encode(df: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) per row; ``vocab`` is a broadcast Vocabulary. Null and empty texts have no ids.

    Repeated ids stay separate rows, other columns are left out.
    """

    def run(batches):
        encoder = Encoder(vocab.value, lambda ids: ids)
        for batch in batches:
            at = 0
            for part in chunks(texts := texts_of(batch), map(len, texts), 4 * BLOCK_CHARS):
                ids = [[i for (ws,) in lists for w in ws for i in w] for lists in encoder.texts(part)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])
                at += len(part)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, vocab, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) per row: the tokens' texts joined by one space, special tokens kept. Null ids give null."""

    def run(batches):
        tokens = vocab.value.tokens
        for batch in batches:
            text = [None if ids is None else " ".join([tokens[i] for i in ids]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digest_encoder(vocab: Vocabulary) -> Encoder:
    names, tokens = [str(i) for i in range(len(vocab.tokens))], vocab.tokens
    return Encoder(vocab, lambda ids: " ".join([names[i] for i in ids]), lambda ids: " ".join([tokens[i] for i in ids]))


def digests(df: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and return counts and digests instead of both: no ids leave the worker.

    Columns: id_col, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256. A word's ids and their
    decoding are joined with those of its neighbours, so each distinct word is encoded and decoded once per block.
    """
    call = uuid.uuid4().hex

    def run(batches):
        encoder = held(call, lambda: digest_encoder(vocab.value))
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for blocks_of in (found for texts in text_lists(batch.column(1), BLOCK_CHARS) for found in encoder.texts(texts)):
                n, gap, a, b = 0, "", hashlib.sha256(), hashlib.sha256()
                for ids, text in blocks_of:
                    ids = gap + " ".join(ids)
                    n += ids.count(" ") + (not gap)
                    a.update(ids.encode())
                    b.update((gap + " ".join(text)).encode())
                    gap = " "
                counts.append(n)
                ids_hash.append(a.hexdigest())
                text_hash.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        # The words go with the task: more workers than cores wait in an executor, and each would keep its own.
        encoder.reset()
        trimmed()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def texts_of(batch) -> list:
    return batch.column(1).fill_null("").to_pylist()
