"""Removal of repeated passages by triggers and the order of what surrounds them (operator 9).

This stands in for a prefix-free parse with suffix arrays: phrases are not kept once, but with each occurrence.

Parse: a rolling hash over eight bytes triggers at its minimum in every run of ``REACH`` places, so each string of
``span`` bytes holds a trigger that depends on that string alone, and the triggers cut a document into phrases. A
string belongs to the first trigger that its own bytes determine: it is the end of a phrase (a dictionary suffix) of
at most ``REACH`` bytes, followed by what comes after the trigger (a parse suffix). Equal strings agree in the bytes
behind their trigger, so only triggers whose next bytes occur twice go on.

Order: for these, the phrases are sorted backwards (suffixes of the dictionary) and what follows is sorted forwards
(suffixes of the parse), each with the common prefix lengths of neighbours. Both orders combine into classes of equal
strings of ``span`` bytes for all starting places at once: a start repeats if another one has its phrase suffix and its
continuation. Nothing is compared by hash alone except in groups over ``HOT`` places, where a 128-bit digest of each
string is counted instead so that a very common passage is spread over all tasks.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.llm.frames import given_back, utf8_buffer
from tabulearn.session import checkpointed

REACH = 160
GRAM = 8
TILE = 1 << 19
ORDER_ROWS = 8_000
HOT = 50_000
SALTS = 64


def mixing_constants(n: int, seed: int = 11):
    """Random byte values, and powers of an odd base with their inverses, modulo 2**64."""
    rng = np.random.default_rng(seed)
    letters = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    base = int(rng.integers(1, 2**62)) * 2 + 1
    power = np.full(n, base, np.uint64)
    power[0] = 1
    inverse = np.full(n, pow(base, -1, 2**64), np.uint64)
    inverse[0] = 1
    return letters, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def triggers(flat: np.ndarray, offsets: np.ndarray, span: int, constants):
    """(doc, at, low, high, key) for the documents that lie one after another in ``flat``.

    A trigger ``at`` bytes into document ``doc`` owns the strings that start low to high bytes before it; the key
    stands for the bytes behind the trigger that all of these contain.
    """
    letters, power, inverse = constants
    tail = span - REACH + 1
    for begin in range(0, len(flat), TILE):
        end = min(len(flat), begin + TILE)
        piece = np.zeros(end - begin + span + GRAM, np.uint8)
        have = flat[begin : min(len(flat), end + span)]
        piece[: len(have)] = have
        first, last = np.searchsorted(offsets, [begin, end], "right")
        docs = np.arange(max(first - 1, 0), min(last, len(offsets) - 1))
        opens = np.maximum(offsets[docs], begin)
        shuts = np.minimum(offsets[docs + 1] - span + 1, end)
        docs, opens, shuts = docs[opens < shuts], opens[opens < shuts], shuts[opens < shuts]
        if not len(docs):
            continue
        size = end - begin
        grams = np.ndarray((size + REACH,), np.dtype("<u8"), piece, 0, (1,))
        least = grams * np.uint64(0x9E3779B97F4A7C15)
        least &= np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(len(least), dtype=np.uint64)
        width = 1
        while width * 2 <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < REACH:
            least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
        anchor = (least[:size] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.zeros(size + 1, np.int8)
        edge[opens - begin] += 1
        edge[shuts - begin] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(new)
        over = np.append(starts[1:], size)
        of = np.searchsorted(opens - begin, starts, "right") - 1
        stops = np.minimum(over, shuts[of] - begin) - 1
        at = anchor[starts]
        sums = np.zeros(len(piece) - GRAM + 1, np.uint64)
        np.cumsum(letters[piece[:-GRAM]] * power[: len(piece) - GRAM], out=sums[1:])
        key = (sums[at + tail] - sums[at]) * inverse[at]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        yield docs[of], at + begin - offsets[docs[of]], at - stops, at - starts, key.view(np.int64)


def repeated_starts(group: np.ndarray, context: list, low: np.ndarray, high: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and farthest repeated start before each trigger, or -1.

    ``context`` has the bytes from ``high`` before the trigger to the end of the string that starts ``low`` before it.
    UTF-8 has no byte 255, so bytes are raised by one and zero marks where the known bytes end.
    """
    m = len(group)
    sizes = np.array([len(c) for c in context])
    flat = np.frombuffer(b"".join(context), np.uint8)
    base = np.cumsum(sizes) - sizes
    flat = np.append(flat, 0)

    def matrix(origin, count, step, width):
        places, out = np.arange(width), np.empty((m, width), np.uint8)
        for at in range(0, m, 4096):
            known = places < count[at : at + 4096, None]
            out[at : at + 4096] = np.where(known, flat[np.where(known, origin[at : at + 4096, None] + step * places, 0)] + np.uint8(1), np.uint8(0))
        return out

    def order(rows):
        """Sorted place of each row within its group, and the common prefix of sorted neighbours (-1 between groups)."""
        wide = np.zeros((m, -(-rows.shape[1] // 8) * 8), np.uint8)
        wide[:, : rows.shape[1]] = rows
        words = wide.view(">u8").astype(np.uint64)
        by = np.lexsort((*words.T[::-1], group))
        differs = rows[by[1:]] != rows[by[:-1]]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        common = np.where(group[by[1:]] == group[by[:-1]], common, -1)
        place = np.empty(m, np.int64)
        place[by] = np.arange(m)
        return place, np.concatenate([[-1], common])

    back_place, back_common = order(matrix(base + high - 1, high, -1, REACH))
    next_place, next_common = order(matrix(base + high, sizes - high, 1, span))
    near, far = np.full(m, REACH), np.full(m, -1)
    by_back, by_next = np.argsort(back_place), np.argsort(next_place)
    # One length of the phrase suffix at a time, so that memory is a few numbers per trigger beside its bytes.
    for a in range(int(low.min()), int(high.max()) + 1):
        who = np.flatnonzero((low <= a) & (a <= high))
        if len(who) < 2:
            continue
        phrase, follow = np.empty(m, np.int64), np.empty(m, np.int64)
        phrase[by_back] = np.cumsum(back_common < a)
        follow[by_next] = np.cumsum(next_common < span - a)
        code = phrase[who] * (m + 1) + follow[who]
        by = np.argsort(code, kind="stable")
        same = np.flatnonzero(code[by[1:]] == code[by[:-1]])
        twice = who[np.concatenate([by[same], by[same + 1]])]
        near[twice] = np.minimum(near[twice], a)
        far[twice] = a
    return near, far


def parted(table: pa.Table, most: int):
    """The table in parts of whole keys, of ``most`` rows or one key each."""
    key = table.column("key").to_numpy()
    starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    first = 0
    for k in range(1, len(starts)):
        if k == len(starts) - 1 or starts[k + 1] - starts[first] > most:
            yield table.slice(starts[first], starts[k] - starts[first]).combine_chunks()
            first = k


def whole_groups(batches, least: int):
    """Tables of at least ``least`` rows that end where the key, by which the rows are sorted, changes."""
    held = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def keep_first_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text, row): rows are told apart by id and a 64-bit mark of the text, as ids may repeat or be null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The row carries its text once: as the column beside it.
    row = F.struct(*[F.when(F.col(c).isNotNull(), F.lit("")).alias(c) if c == text_col else F.col(c) for c in df.columns])
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), row.alias("row"))


def by_document(doc, key, place):
    """Places with equal document and key as one row: (doc, key, list of places), places ascending."""
    order = np.lexsort((place, key, doc))
    doc, key, place = doc[order], key[order], place[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    return doc[first], key[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(place))


def contexts_of(text: bytes, places: np.ndarray, span: int) -> dict:
    """{(low, high, bytes): offsets} of one document's triggers with one key; periodic text has few different ones."""
    out = {}
    for at, low, high in zip((places >> 16).tolist(), (places >> 8 & 255).tolist(), (places & 255).tolist()):
        out.setdefault((low, high, text[at - high : at - low + span]), []).append(at)
    return out


def repeated_spans(docs: DataFrame, span: int) -> DataFrame:
    """(id, mark, s, e): byte ranges covered by repeated strings, some per document, overlapping."""
    kind = docs.schema["id"].dataType.simpleString()

    @given_back
    def parse(batches):
        constants = mixing_constants(TILE + span + GRAM)
        for batch in batches:
            flat, offsets = utf8_buffer(batch.column("text"))
            for doc, at, low, high, key in triggers(flat, offsets, span, constants):
                # A place is the trigger's offset, and its nearest and farthest start, in one number.
                doc, key, places = by_document(doc, key, at << 16 | low << 8 | high)
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("mark").take(rows), pa.array(key), places], ["id", "mark", "key", "places"])

    @given_back
    def places_of_keys(batches):
        constants = mixing_constants(TILE + span + GRAM)
        for batch in batches:
            for _, _, _, _, key in triggers(*utf8_buffer(batch.column("text")), span, constants):
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in np.unique(key, return_counts=True)], ["key", "n"])

    # The places of a key are added up before they are dealt out; only then do triggers meet, those of hot keys by a salt.
    counts = checkpointed(docs.select("text").mapInArrow(places_of_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("places_of_key")).where("places_of_key > 1"))
    is_hot = F.col("places_of_key") > HOT
    counts = counts.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    # At most one key for each HOT places of the corpus, so its copy to every task is small.
    hot = counts.where(is_hot & (F.col("salt") == 0)).select(F.col("key").alias("hot_key"))
    found = docs.mapInArrow(parse, f"id {kind}, mark long, key long, places array<long>").join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    salt = F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64("id", "mark"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    found = found.select("id", "mark", "key", "places", salt.alias("salt")).join(counts, ["key", "salt"])

    @given_back
    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column("found").slice(i, 1).flatten()
                text, lists, key = batch.column("text")[i].as_py().encode(), found.field("places"), found.field("key").to_numpy()
                rows, last = [], len(key) - 1
                for k in range(len(key)):
                    for (low, high, context), at in contexts_of(text, lists[k].values.to_numpy(), span).items():
                        rows.append((int(key[k]), low, high, at, context))
                    if k < last and len(rows) < ORDER_ROWS:
                        continue
                    same = pa.array(np.zeros(len(rows), np.int32))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1).take(same), batch.column("mark").slice(i, 1).take(same), *columns],
                                                     ["id", "mark", "key", "low", "high", "at", "context"])
                    rows = []

    def contexts(which):
        listed = found.where(which).groupBy("id", "mark").agg(F.collect_list(F.struct("key", "places")).alias("found"))
        listed = listed.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), "found")
        # The same columns as in the last join of the texts, so that all of these joins read one shuffle of them.
        with_text = docs.join(listed, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))).select("id", "mark", "text", "row", "found")
        return with_text.mapInArrow(cut, f"id {kind}, mark long, key long, low int, high int, at array<long>, context binary")

    @given_back
    def order(batches):
        for table in (part for table in whole_groups(batches, ORDER_ROWS) for part in parted(table, ORDER_ROWS)):
            low, high = table.column("low").to_numpy().astype(np.int64), table.column("high").to_numpy().astype(np.int64)
            near, far = repeated_starts(table.column("key").to_numpy(), table.column("context").to_pylist(), low, high, span)
            at = table.column("at").combine_chunks()
            often = at.value_lengths().to_numpy() > 1  # equal contexts in one document repeat as a whole
            near, far = np.where(often, low, near), np.where(often, high, far)
            hit = np.flatnonzero(far >= 0)
            lists = at.take(pa.array(hit))
            who = np.repeat(hit, lists.value_lengths().to_numpy())
            where = lists.flatten().to_numpy()
            out = table.select(["id", "mark"]).take(pa.array(who))
            out = out.append_column("s", pa.array(where - far[who])).append_column("e", pa.array(where - near[who] + span))
            yield from out.to_batches()

    spans = contexts(F.col("places_of_key") <= HOT).repartition("key").sortWithinPartitions("key").mapInArrow(order, f"id {kind}, mark long, s long, e long")

    @given_back
    def every_start(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                context, low, high, places = (batch.column(c)[i].as_py() for c in ("context", "low", "high", "at"))
                starts = [(at - high + j, hashlib.md5(context[j : j + span]).digest()) for j in range(high - low + 1) for at in places]
                same = pa.array(np.zeros(len(starts), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1).take(same), batch.column("mark").slice(i, 1).take(same),
                                                  pa.array([s for s, _ in starts], pa.int64()), pa.array([d for _, d in starts], pa.binary())], ["id", "mark", "s", "digest"])

    starts = contexts(F.col("places_of_key") > HOT).mapInArrow(every_start, f"id {kind}, mark long, s long, digest binary")
    twice = starts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    hot_spans = starts.join(twice, "digest").select("id", "mark", "s", (F.col("s") + span).alias("e"))
    return spans.unionByName(hot_spans)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal ranges covered by (start, end) rows; touching ranges are one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.column_stack([spans[new, 0], reach[np.append(new[1:] - 1, len(spans) - 1)]])


def with_spans(df: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """(row, text, spans) per row: its columns, its text and the ranges to remove."""
    if not REACH + GRAM <= span <= 2**15:
        raise ValueError(f"span must be at least {REACH + GRAM}")
    docs = keep_first_columns(df, id_col, text_col)
    # Rows with equal id and text are parsed once, and all that is long enough in them repeats.
    repeats = checkpointed(docs.groupBy("id", "mark").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where("n > 1"))
    if repeats.isEmpty():
        spans = repeated_spans(docs, span)
    else:
        again = repeats.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"))
        known = lambda d: d["id"].eqNullSafe(again["of"]) & (d["mark"] == again["of_mark"])
        single = docs.join(again, known(docs), "left_anti").unionByName(docs.join(again, known(docs), "left_semi").dropDuplicates(["id", "mark"]))
        spans = repeated_spans(single, span)
        whole = repeats.where(F.col("size") >= span).select("id", "mark", F.lit(0).cast("long").alias("s"), F.col("size").cast("long").alias("e"))
        spans = spans.join(again, known(spans), "left_anti").unionByName(whole)
    spans = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = spans.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), "spans")
    return docs.join(spans, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left").select("id", "row", "text", "spans")


def gaps(batch):
    """For each row of a batch with text and spans: the text's bytes, and the maximal ranges that go."""
    flat, offsets = utf8_buffer(batch.column("text"))
    raw, lists = memoryview(flat), batch.column("spans")
    for i in range(batch.num_rows):
        gone = np.zeros((0, 2), np.int64)
        if lists[i].is_valid:
            pairs = lists.slice(i, 1).flatten()
            gone = merged(np.column_stack([pairs.field("s").to_numpy(), pairs.field("e").to_numpy()]))
        yield raw[offsets[i] : offsets[i + 1]], gone


def kept_parts(text, gone: np.ndarray) -> list:
    edges = np.concatenate([[0], gone.ravel(), [len(text)]]).tolist()
    return [text[s:e] for s, e in zip(edges[::2], edges[1::2])]


def remove_repeats(df: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) per row.

    Texts are UTF-8 bytes, null is empty. A byte goes if it lies in a string of ``span`` bytes that also starts
    elsewhere, in this text or another; overlapping occurrences count. Repeated rows are documents of their own, so
    both lose what they share, even if their ids are equal. Texts shorter than ``span`` stay as they are.
    """

    @given_back
    def finish(batches):
        for batch in batches:
            rows = []
            for text, gone in gaps(batch):
                digest = hashlib.sha256()
                for part in kept_parts(text, gone):
                    digest.update(part)
                rows.append((len(text), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), digest.hexdigest()))
            n_bytes, removed, n_spans, sha = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
                [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = with_spans(df.select(id_col, text_col), span, id_col, text_col).select("id", "text", "row", "spans")
    kind = df.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(finish, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned_rows(df: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with their columns and the repeated passages cut out of the text.

    Bytes of a letter that was cut in part are dropped. Null texts stay null.
    """
    joined = with_spans(df, span, id_col, text_col)

    @given_back
    def finish(batches):
        for batch in batches:
            text = [b"".join(kept_parts(text, gone)).decode("utf-8", "ignore") for text, gone in gaps(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], ["row", "kept"])

    row_type = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(finish, f"row {row_type}, kept string")
    text = F.when(F.col(f"row.`{text_col}`").isNotNull(), F.col("kept")).alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
