"""Encoding of a corpus with a public tokenizer: content-defined chunks that recur are encoded once, joins are repaired."""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot_aware
from ..session import bind, materialize, spread

#: The ranks of byte_bpe_50k; byte_bpe_50k.json gives the same ids and takes four times as long.
DEFAULT_TOKENIZER = "byte_bpe_50k.tiktoken"
#: Bytes of the rolling hash's window, a chunk's mean length beyond the least one (a power of two), and the least one.
WINDOW, MEAN_CHUNK, LEAST_CHUNK = 16, 256, 128
#: Boundaries kept at either end of a shared chunk, and how many in a row must agree with the text around a join.
EDGES, AGREE = 8, 3


class Tokenizer(NamedTuple):
    """encode: texts -> arrays of ids without special tokens. split: text -> ends of the pieces that the tokenizer never joins.

    split is None where the tokenizer has no such pieces or rewrites the text first; then only whole texts are shared.
    """

    encode: Callable[[list[str]], list[np.ndarray]]
    split: Callable[[str], list[int]] | None


def default_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, kept for the life of the process: a Python worker runs many tasks.

    The package's own module is not that memory: its functions travel to workers by value.
    """
    kept = sys.modules.setdefault("alertmill_loaded_tokenizers", ModuleType("alertmill_loaded_tokenizers")).__dict__
    if path not in kept:
        kept[path] = _read(path)
    return kept[path]


def _covering(ends: list[tuple[int, int]], n: int) -> list[int]:
    """Ends of spans that cover a text of n characters without gaps, else no boundary but its end."""
    at = 0
    for a, b in ends:
        if a != at:
            return [n]
        at = b
    return [b for _, b in ends] if at == n else [n]


def _read(path: str) -> Tokenizer:
    """.tiktoken holds the ranks of a byte-level vocabulary, .json a tokenizers model, .model a sentencepiece one."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        ranked = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pattern = regex.compile(public_tokenizers.PATTERN)
        # without special tokens in the encoding there are none to allow or forbid
        return Tokenizer(lambda texts: [ranked.encode_to_numpy(t, disallowed_special=()).view(np.int32) for t in texts], lambda t: _covering([m.span() for m in pattern.finditer(t)], len(t)))
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Tokenizer(lambda texts: [np.array(i, np.int32) for i in model.encode(texts, num_threads=1)], None)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer as Json

    model = Json.from_file(path)
    model.encode_special_tokens = True  # strings that look like special tokens are ordinary text
    pre = model.pre_tokenizer
    own = [t for t in model.get_added_tokens_decoder().values() if not t.special]
    plain = model.normalizer is None and pre is not None and not own and pre.pre_tokenize_str("a")[0][0] == "a"
    split = (lambda t: _covering([span for _, span in pre.pre_tokenize_str(t)], len(t))) if plain else None
    return Tokenizer(lambda texts: [np.array(e.ids, np.int32) for e in model.encode_batch(texts, add_special_tokens=False)], split)


def encode_once(path: str, texts: list[str]) -> list[np.ndarray]:
    """Token ids of each text, without special tokens; each distinct text is encoded once."""
    once = list(dict.fromkeys(texts))
    ids = dict(zip(once, load(path).encode(once))) if once else {}
    return [ids[t] for t in texts]


def encode_all(path: str, texts: list[str]) -> list[list[int]]:
    """encode_once as plain lists."""
    return [ids.tolist() for ids in encode_once(path, texts)]


def cut(data: bytes, starts: np.ndarray) -> list[list[int]]:
    """Ends of the content-defined chunks of the UTF-8 texts that lie one after another in data, the text's end included.

    A chunk ends where the hash of the last WINDOW bytes meets the mask and a character ends, LEAST_CHUNK bytes after the
    one before at the earliest. starts has one entry more than there are texts.
    """
    b = np.frombuffer(data, np.uint8)
    bounds = starts.tolist()
    ends: list[list[int]] = [[e] if e > s else [] for s, e in zip(bounds, bounds[1:])]
    if len(b) <= LEAST_CHUNK or not (np.diff(starts) > LEAST_CHUNK).any():
        return ends
    h, width, power = b.astype(np.uint64), 1, 0x100000001B3
    while width < WINDOW:  # hashes of twice the width from two of the width
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % 2**64, 2 * width
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MEAN_CHUNK - 1) == 0) + WINDOW
    at = at[at < len(b)]
    at = at[b[at] & 0xC0 != 0x80]
    first = np.searchsorted(at, starts)
    for i in np.flatnonzero((np.diff(first) > 0) & (np.diff(starts) > LEAST_CHUNK)).tolist():
        kept, last = [], bounds[i]
        for e in at[first[i] : first[i + 1]].tolist():
            if e - last >= LEAST_CHUNK and e < bounds[i + 1]:
                kept.append(e)
                last = e
        ends[i] = [*kept, bounds[i + 1]]
    return ends


def _texts(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a column of texts and where each begins; null is empty."""
    whole = pa.concat_arrays([column.fill_null("").cast(pa.large_string())])
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = whole.buffers()[2]
    return (raw.to_pybytes() if raw is not None else b"")[at[0] : at[-1]], at - at[0]


def _hash(raw: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _parts(path: str, column: pa.Array) -> tuple[bytes, list[int], list[list[int]]]:
    """(bytes, starts of the texts, ends of each text's chunks): one chunk a text if the tokenizer gives no boundaries."""
    data, starts = _texts(column)
    bounds = starts.tolist()
    return data, bounds, cut(data, starts) if load(path).split else [[e] if e > s else [] for s, e in zip(bounds, bounds[1:])]


def _chunks(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, th, text -> id, th, a, b, m: the hashes of each text's chunks, of which there are m."""
    for batch in batches:
        data, bounds, ends = _parts(path, batch.column("text"))
        row, a, b, m = [], [], [], []
        for i, es in enumerate(ends):
            last = bounds[i]
            for e in es:
                h = _hash(data[last:e])
                row.append(i)
                a.append(h[0])
                b.append(h[1])
                m.append(len(es))
                last = e
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(take), batch.column("th").take(take), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int32())], ["id", "th", "a", "b", "m"]
        )


class Shared(NamedTuple):
    """A chunk encoded once: its ids, and at both ends boundaries between pieces (characters from its start) with the
    number of ids before each. No boundaries: it can only stand for a whole text."""

    ids: list[int]
    heads: list[int]
    head_ids: list[int]
    tails: list[int]
    tail_ids: list[int]


def encode_chunk(path: str, text: str) -> Shared:
    """The ids of a chunk and its usable boundaries, checked against the ids of its parts."""
    tok = load(path)
    ids = tok.encode([text])[0].tolist()
    ends = tok.split(text)[:-1] if tok.split else []
    if len(ends) < 2 * EDGES:
        return Shared(ids, [], [], [], [])
    heads, tails = ends[:EDGES], ends[-EDGES:]
    marks = [0, *heads, *tails, len(text)]
    parts = tok.encode([text[x:y] for x, y in zip(marks, marks[1:])])
    if [i for p in parts for i in p.tolist()] != ids:
        return Shared(ids, [], [], [], [])
    before = np.cumsum([len(p) for p in parts]).tolist()
    return Shared(ids, heads, before[:EDGES], tails, before[EDGES : 2 * EDGES])


def join_parts(path: str, text: str, spans: list[tuple[int, int, Shared | None]]) -> list[str | list[int]]:
    """The text as strings still to be encoded and ids of shared chunks; their ids in a row are the ids of the text.

    spans: the chunks as character ranges, with what is known of them. From the last sure boundary the tokenizer's own
    splitting is run across the join into the next shared chunk, until AGREE boundaries in a row are those that the chunk
    has by itself: from there on both splittings go the same way, and the chunk's ids hold up to its last boundaries, of
    which the next run must meet the first ones again. Where nothing agrees, the chunk is encoded with what surrounds it.
    """
    split = load(path).split
    out: list[str | list[int]] = []
    sure, expected = 0, []  # the last sure boundary, and boundaries that the splitting from there must meet

    def meets(window: str, base: int) -> list[int] | None:
        ends = [base + e for e in split(window)]
        return ends if ends[: len(expected)] == expected else None

    for start, _, chunk in spans:
        if chunk is None or not chunk.heads:
            continue
        heads = [start + h for h in chunk.heads]
        ends = meets(text[sure : heads[-1]], sure)
        if ends is None:
            return [text]
        have = set(ends)
        at = next((i for i in range(EDGES - AGREE) if all(heads[i + k] in have for k in range(AGREE))), None)
        if at is None:
            continue
        between = text[sure : heads[at]]
        if between and [sure + e for e in split(between)] != [e for e in ends if e <= heads[at]]:
            continue
        tails = [start + t for t in chunk.tails]
        out += [between, chunk.ids[chunk.head_ids[at] : chunk.tail_ids[0]]]
        sure, expected = tails[0], tails[1:AGREE]
    rest = text[sure:]
    if expected and meets(rest, sure) is None:
        return [text]
    return [*out, rest]


def _encode_shared(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, wanted (list of structs a, b, n) -> a, b, n and the fields of Shared."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 5]
    for batch in batches:
        data, bounds, ends = _parts(path, batch.column("text"))
        rows = []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            left = {(w["a"], w["b"]): w["n"] for w in wanted}
            last = bounds[i]
            for e in ends[i]:
                h = _hash(data[last:e])
                if h in left:
                    rows.append((*h, left.pop(h), *encode_chunk(path, data[last:e].decode())))
                last = e
        cols = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["a", "b", "n", *Shared._fields])


def _assemble(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, whole (ids or null), parts (list of shared chunks or null) -> id, ids."""
    for batch in batches:
        whole, parts = batch.column("whole").cast(pa.list_(pa.int32())), batch.column("parts")
        need = np.flatnonzero(whole.is_null().to_numpy(zero_copy_only=False))
        text = batch.column("text").take(pa.array(need))
        mixed = parts.take(pa.array(need)).to_pylist()
        todo: list[list[str | list[int]]] = [[t] if t else [] for t in text.to_pylist()]
        some = [i for i, p in enumerate(mixed) if p]
        if some:
            data, bounds, ends = _parts(path, text.take(pa.array(some)))
            for k, i in enumerate(some):
                known = {(p["a"], p["b"]): Shared(*[p[f] for f in Shared._fields]) for p in mixed[i]}
                spans, last, at = [], bounds[k], 0
                for e in ends[k]:
                    n = len(data[last:e].decode())
                    spans.append((at, at + n, known.get(_hash(data[last:e]))))
                    last, at = e, at + n
                todo[i] = join_parts(path, todo[i][0], spans)
        strings = [x for parts_ in todo for x in parts_ if isinstance(x, str)]
        enc = iter(encode_once(path, strings))
        ids = [[next(enc) if isinstance(x, str) else np.array(x, np.int32) for x in parts_] for parts_ in todo]
        ends_at = np.cumsum([0, *[sum(map(len, x)) for x in ids]]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *[y for x in ids for y in x]])
        done = pa.ListArray.from_arrays(pa.array(ends_at), pa.array(flat))
        order = np.arange(len(whole))
        order[need] = len(whole) + np.arange(len(need))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.concat_arrays([whole, done]).take(pa.array(order))], ["id", "ids"])


def encode_corpus(docs: DataFrame, id_col: str, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of every whole text; ids of a null or empty text are the empty list.

    Chunks cut by content recur wherever passages recur. Their hashes are counted; a chunk that occurs once is encoded
    where it stands, one that recurs is encoded once, by one of the texts that hold it, and its ids are joined back (by
    broadcast where a large part of the corpus shares it). A text that recurs as a whole takes its ids from there, in
    others the joins around shared chunks are repaired by encoding across them until the tokenizer's own boundaries agree
    on both sides. Ids equal those of encoding each text in one go, for any tokenizer file; of one that gives no boundaries
    only whole texts are shared. Rows that repeat an id are encoded each by its own text.
    """
    path = tokenizer or default_path()
    kind = dict(docs.dtypes)[id_col]
    some = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th")))
    rows = materialize(some.mapInArrow(bind(_chunks, path), f"id {kind}, th long, a long, b long, m int"), "chunks")
    counted = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n > 1")
    # a text's list is no longer than the text
    wanted = counted.groupBy("id").agg(F.collect_list(F.struct("a", "b", "n")).alias("wanted"))
    fields = ", ".join(f"{f} array<int>" for f in Shared._fields)
    table = materialize(some.join(wanted, "id").select("text", "wanted").mapInArrow(bind(_encode_shared, path), f"a long, b long, n long, {fields}"), "shared")
    # rows that repeat an id may both have encoded a chunk
    placed = join_hot_aware(rows, table.dropDuplicates(["a", "b"]), ["a", "b"], "n")
    part = F.struct("a", "b", *Shared._fields)
    known = placed.groupBy("id", "th").agg(F.first(F.when(F.col("m") == 1, F.col("ids")), True).alias("whole"), F.collect_list(F.when(F.col("m") > 1, part)).alias("parts"))
    ready = some.join(known, ["id", "th"], "left").select("id", F.when(F.col("whole").isNull(), F.col("text")).alias("text"), "whole", "parts")
    return ready.mapInArrow(bind(_assemble, path), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
