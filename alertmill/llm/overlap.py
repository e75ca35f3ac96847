"""Same or nearly same records across splits: similarity fingerprints, segmented block join, Hamming filter, verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot_aware
from ..session import bind, materialize

#: Bytes of a block. More make blocks rarer among unrelated records and need more of them for the same recall.
SEGMENT = 5
#: Share of the pairs exactly at the threshold that may share no block; pairs above it are missed far more rarely.
MISS = 2e-4
#: Bits of the code whose Hamming distance is checked in the join, and standard deviations that the radius allows.
SKETCH_BITS, DEVIATIONS = 128, 6
_SEED = 20_240_229


class Code(NamedTuple):
    """The similarity hash of a word set: bytes that are the low bits of as many min-wise hashes.

    Bytes of two sets agree with probability J + (1 - J) / 256, their bits with (1 + J) / 2, so the Hamming distance of
    two codes tells the Jaccard similarity J of the sets.
    """

    blocks: int
    radius: int

    @classmethod
    def for_threshold(cls, num: int, den: int) -> Code:
        """Blocks and radius that find a pair of similarity num / den but for a share of MISS."""
        if not 0 < num <= den:
            raise ValueError(f"{num} / {den} is no similarity")
        t = num / den
        agree = (t + (1 - t) / 256) ** SEGMENT
        blocks = 1 if agree >= 1 else max(-(-SKETCH_BITS // SEGMENT), math.ceil(math.log(MISS) / math.log1p(-agree)))
        off = (1 - t) / 2
        return cls(blocks, min(SKETCH_BITS, math.ceil(SKETCH_BITS * off + DEVIATIONS * math.sqrt(SKETCH_BITS * off * (1 - off)))))


def encode_sets(blocks: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a, b (two sums of mixed word hashes), f1, f2 (lowest bits of the code's first 128 bytes) and blocks (its
    segments) to batches with a column words: list<long>, none of them empty."""
    n_bytes = max(blocks * SEGMENT, SKETCH_BITS)
    rng = np.random.default_rng(_SEED)
    mul, add = rng.integers(1, 2**63, n_bytes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n_bytes, dtype=np.uint64)
    golden = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        words = batch.column("words")
        if not len(words):
            continue
        flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
        sums = []
        for k in (0, 1):
            x = (flat ^ (flat >> np.uint64(31))) * mul[k]
            sums.append(np.add.reduceat((x ^ (x >> np.uint64(28))) * golden, starts).view(np.int64))
        low = np.empty((n_bytes, len(starts)), np.uint64)
        for j in range(n_bytes):
            low[j] = np.minimum.reduceat(flat * mul[j] + add[j], starts)
        code = ((low ^ (low >> np.uint64(29))) * golden) >> np.uint64(56)
        bits = code[:SKETCH_BITS] & np.uint64(1)
        prints = [np.bitwise_or.reduce([bits[64 * h + i] << np.uint64(i) for i in range(64)]).view(np.int64) for h in (0, 1)]
        keys = np.empty((len(starts), blocks), np.int64)
        for k in range(blocks):
            key = np.full(len(starts), k, np.uint64)
            for i in range(SEGMENT):
                key = (key << np.uint64(8)) | code[k * SEGMENT + i]
            keys[:, k] = key.view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, blocks, dtype=np.int32)), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in (*sums, *prints)], lists], [*batch.schema.names, "a", "b", "f1", "f2", "blocks"])


#: Class ids whose word sets are fetched by broadcast, 8 bytes each; more are fetched by a shuffled semi-join.
BROADCAST_IDS = 1_000_000


def word_classes(docs: DataFrame, num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (id, side, words array<string>) -> members (id, side, cls), codes and words of one record per class.

    A class holds the records with equal word sets; cls is its least id. Records without a word are left out. codes:
    (cls, n, f1, f2, blocks, in_train, in_eval), made for similarities from num / den; words: (id, words) of all records,
    of which only those of candidates are ever moved. Sets are hashed, coded and written once; what is shuffled to form
    classes is 50 bytes a record. Equal sets are told by their size and two 64-bit sums of mixed word hashes.
    """
    some = docs.filter(F.size("words") > 0).select("id", "side", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    kind = dict(docs.dtypes)["id"]
    coded = some.withColumn("n", F.size("words")).mapInArrow(
        bind(encode_sets, Code.for_threshold(num, den).blocks), f"id {kind}, side string, words array<long>, n int, a long, b long, f1 long, f2 long, blocks array<long>"
    )
    rows = materialize(coded, "words")
    key = ["n", "a", "b"]
    groups = materialize(
        rows.groupBy(*key).agg(
            F.min("id").alias("cls"), F.count(F.lit(1)).alias("m"),
            F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "eval").alias("in_eval"),
        ),
        "classes",
    )
    members = join_hot_aware(rows.select("id", "side", *key), groups.select(*key, "cls", "m"), key, "m").select("id", "side", "cls")
    flags = groups.select("cls", "in_train", "in_eval")
    codes = rows.select(F.col("id").alias("cls"), "n", "f1", "f2", "blocks").join(flags, "cls")
    return members, codes, rows.select("id", "words")


def similar_classes(codes: DataFrame, words: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """(train_cls, eval_cls) of different classes with Jaccard similarity of at least num / den, one in train, one in eval.

    Candidates share a whole segment of their similarity hashes and lie within the Hamming radius; they are verified on
    their word sets. Blocks and radius follow from the threshold (see Code), which must be the one the codes were made
    for. A segment that many classes share is split by AQE's skew join; every candidate is followed, there is no cap.
    """
    codes = materialize(codes, "codes")
    radius = Code.for_threshold(num, den).radius
    side = lambda flag, p: codes.filter(flag).select(
        F.explode("blocks").alias("key"), F.col("cls").alias(f"{p}_cls"), F.col("f1").alias(f"{p}1"), F.col("f2").alias(f"{p}2"), F.col("n").alias(f"{p}_n")
    )
    t, e = side("in_train", "train"), side("in_eval", "eval")
    near = F.bit_count(F.col("train1").bitwiseXOR(F.col("eval1"))) + F.bit_count(F.col("train2").bitwiseXOR(F.col("eval2"))) <= radius
    size_fits = F.least("train_n", "eval_n") * den >= F.greatest("train_n", "eval_n") * num
    cand = t.join(e.hint("merge"), "key").filter(near & size_fits & (F.col("train_cls") != F.col("eval_cls"))).select("train_cls", "eval_cls").distinct()
    cand = materialize(cand, "candidates")
    need = materialize(cand.select(F.col("train_cls").alias("id")).union(cand.select("eval_cls")).distinct(), "need")
    if need.count() <= BROADCAST_IDS:
        need = F.broadcast(need)
    w = materialize(words.join(need, "id", "left_semi"), "needed")
    pairs = (
        cand.join(w.select(F.col("id").alias("train_cls"), F.col("words").alias("tw")), "train_cls")
        .join(w.select(F.col("id").alias("eval_cls"), F.col("words").alias("ew")), "eval_cls")
        .withColumn("common", F.size(F.array_intersect("tw", "ew")))
    )
    union = F.size("tw") + F.size("ew") - F.col("common")
    return pairs.filter(F.col("common") * den >= union * num).select("train_cls", "eval_cls")


def class_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """links (train_cls, eval_cls) and the link of every class with members on both sides to itself."""
    own = members.groupBy("cls").agg(F.max(F.col("side") == "train").alias("t"), F.max(F.col("side") == "eval").alias("e")).filter("t and e")
    return links.unionByName(own.select(F.col("cls").alias("train_cls"), F.col("cls").alias("eval_cls")))


def cross_split_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every train row with every eval row of the same or a linked class."""
    links = class_links(members, links)
    t = members.filter("side = 'train'").select(F.col("id").alias("t_id"), F.col("cls").alias("train_cls"))
    e = members.filter("side = 'eval'").select(F.col("id").alias("e_id"), F.col("cls").alias("eval_cls"))
    return links.join(t, "train_cls").join(e, "eval_cls").select(F.least("t_id", "e_id").alias("id_a"), F.greatest("t_id", "e_id").alias("id_b"))


def overlap_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, n_train): eval rows that also stand in train, with their number of train rows of the same or a linked class.

    Counted from class sizes and links: no pair of rows is made, so a class that holds a third of all rows costs a row.
    """
    size = members.filter("side = 'train'").groupBy(F.col("cls").alias("train_cls")).agg(F.count(F.lit(1)).alias("_n"))
    per = class_links(members, links).join(size, "train_cls").groupBy("eval_cls").agg(F.sum("_n").alias("n_train"))
    rows = members.filter("side = 'eval'").groupBy("cls").agg(F.count(F.lit(1)).alias("_m"))
    known = materialize(rows.join(per, rows["cls"] == per["eval_cls"]).select("cls", "_m", "n_train"), "overlaps")
    return join_hot_aware(members.filter("side = 'eval'").select("id", "cls"), known, ["cls"], "_m").select("id", "n_train")


def equal_key_classes(docs: DataFrame) -> DataFrame:
    """docs (id, side, key) -> members (id, side, cls): records are the same if their keys are; null keys are left out."""
    some = docs.filter(F.col("key").isNotNull())
    return some.select("id", "side", F.col("key").alias("cls"))
