"""File sources and sinks of the evaluation: JSON arrays, JSON lines, tolerant and recovering scans, hashes, CSV."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import valid_label
from ..operators.runlog import refuse_duplicates
from ..operators.skew import number_runs
from ..session import bind, materialize

_CORRUPT = "_corrupt_record"
NULL_TEXT = r"\N"
#: Timestamps in JSON lines, to the microsecond.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


#: Bytes of an array file that a task looks at in one step.
BLOCK = 1 << 23
_SPACE = b" \t\r\n"
#: What a byte means outside strings: 1 opens, -1 closes, 2 separates, 3 is refused (a string of JSON has double quotes).
_KINDS = np.zeros(256, np.int8)
_KINDS[np.frombuffer(b"{[}],'", np.uint8)] = [1, 1, -1, -1, 2, 3]
_SEPARATES, _OPENS, _CLOSES, _ENDS = 1, 2, 3, 4
_TORN = "not one whole JSON array"


def read_array_file(spark: SparkSession, path: str, schema: T.StructType, sha256: str | None = None, in_order: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows of a file that is one JSON array, with row_index = position in it. A pinned hash must match, null or torn input raises.

    With in_order every object must have exactly the schema's fields, in its order. Strings have double quotes, as JSON's do;
    a single quote in place of one raises, and so does anything behind the array. A file of any size is read block by
    block, in parallel: a first pass tells for each block whether it begins inside a string, how deep, and after how many
    elements, a handful of numbers a block; in the second an element belongs to the block in which it begins. No task
    holds more than a block and an element. Compressed files cannot be split: each is streamed by one task. Several files
    are read side by side, each with positions of its own.
    """
    if sha256 is not None:
        got = file_hashes(spark, path).select("sha256").collect()
        if [r[0] for r in got] != [sha256]:
            raise ValueError(f"{path}: sha256 differs from the pin")
    blocks = _dealt(spark, _array_blocks(spark, path, block), "path string, start long, length long, inside int, depth long, index long")
    each = blocks.mapInArrow(bind(_array_elements, block), "row_index int, text binary").withColumn("text", F.col("text").cast("string"))
    if in_order:
        wrong = F.raise_error(F.concat(F.lit("fields differ from the pinned order in row "), F.col("row_index").cast("string"))).cast("string")
        each = each.withColumn("text", F.when(F.json_object_keys("text") == F.array(*[F.lit(f) for f in schema.fieldNames()]), F.col("text")).otherwise(wrong))
    return each.select("row_index", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("row_index", "r.*")


def write_array_file(df: DataFrame, order: str, path: str) -> None:
    """One file that is one JSON array: an object a row, of all columns but order, nulls written; rows by order, nulls last.

    Rows are sorted and written by all tasks. One file has one writer: the driver appends the parts to it, as streams of
    bytes, and removes each that it has appended. The file appears under its name when it is whole.
    """
    by = F.col(order).asc_nulls_last()
    text = F.to_json(F.struct(*[c for c in df.columns if c != order]), {"ignoreNullFields": "false", **_TIMES})
    objects = df.repartitionByRange(by).select(order, text.alias("o")).sortWithinPartitions(by, "o")
    parts = f"{path}-parts-{uuid.uuid4().hex}"
    objects.select(F.concat(F.lit(","), "o").alias("value")).write.options(lineSep="\n", compression="none").text(parts)
    hadoop, conf = df.sparkSession._jvm.org.apache.hadoop, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.fs.Path(path).getFileSystem(conf)
    written = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(hadoop.fs.Path(parts)))
    out = fs.create(whole := hadoop.fs.Path(f"{parts}/_whole"))
    out.write(ord("["))
    for at, name in enumerate(n for n, size in written if n.startswith("part-") and size):
        part = fs.open(source := hadoop.fs.Path(f"{parts}/{name}"))
        if at == 0:
            part.read()  # no comma before the first object
        hadoop.io.IOUtils.copyBytes(part, out, conf, False)
        part.close()
        fs.delete(source, False)
    out.write(ord("]"))
    out.close()
    if not fs.rename(whole, hadoop.fs.Path(path)):
        raise OSError(f"{path}: cannot be written")
    fs.delete(hadoop.fs.Path(parts), True)


def _dealt(spark: SparkSession, blocks: list[tuple], schema: str) -> DataFrame:
    """Blocks over all cores, about 16 a task at most."""
    n = len(blocks)
    return spark.createDataFrame(blocks, schema).repartition(max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n // 16)))))


def _array_blocks(spark: SparkSession, path: str, block: int) -> list[tuple]:
    """(path, start, length, inside, depth, index) of every block: what is known where it begins. Length -1: the whole file."""
    found = spark.read.format("binaryFile").load(path)
    sizes = {_uri(r[0]): r[1] for r in found.select("_metadata.file_path", "_metadata.file_size").collect()}
    sizes |= {n: 0 for n in map(_uri, found.inputFiles()) if n not in sizes}  # empty files, which the scan leaves out
    split = {n for n, size in sizes.items() if size > block and not _compressed(n)}
    blocks = [(n, 0, -1, 0, 0, 0) for n in sizes if n not in split]
    if not split:
        return blocks
    cut = _dealt(spark, [(n, at, min(block, sizes[n] - at)) for n in split for at in range(0, sizes[n], block)], "path string, start long, length long")
    seen = cut.mapInArrow(_array_profiles, "path string, start long, length long, blank boolean, quotes int, outside array<long>, within array<long>").collect()
    name = None
    for r in sorted(seen, key=lambda r: (r["path"], r["start"])):
        if r["path"] != name:
            name, inside, depth, index, begun = r["path"], 0, 0, 0, False
        if begun and not depth and not r["blank"]:
            raise ValueError(f"{name}: {_TORN}")
        blocks.append((name, r["start"], r["length"], inside, depth, index))
        change, low, at_low, above = r["within"] if inside else r["outside"]
        if depth + low < 0:
            raise ValueError(f"{name}: {_TORN}")
        index += (above, at_low)[depth + low] if depth + low < 2 else 0  # an array's own commas are at depth 1
        inside, depth, begun = inside ^ r["quotes"], depth + change, begun or not r["blank"]
        if r["start"] + r["length"] == sizes[name] and (inside or depth or not begun):
            raise ValueError(f"{name}: {_TORN}")
    return blocks


def _compressed(uri: str) -> bool:
    try:
        return bool(pa.Codec.detect(uri))
    except (TypeError, ValueError):  # no codec has this suffix
        return False


def _array_profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with quotes = parity of their quotes and, for a beginning outside and within a string, the change of depth, its
    lowest value, and the commas at that depth and at the next."""
    for batch in batches:
        for path, start, length in zip(*batch.to_pydict().values()):
            store, name = _stored(path)
            with store.open_input_file(name) as f:
                odd = _escaping(f, start)
                f.seek(start)
                piece = f.read(length)
            pos, kinds, before, quotes, _ = _marks(np.frombuffer(piece, np.uint8), odd)
            row = [path, start, length, not piece.strip(_SPACE), quotes]
            for inside in (0, 1):
                k = kinds[before == inside]
                depth = np.cumsum(np.where(np.abs(k) == 1, k, 0), dtype=np.int64)
                low, commas = int(depth.min(initial=0)), depth[k == 2]
                row.append([int(depth[-1]) if len(k) else 0, low, int((commas == low).sum()), int((commas == low + 1).sum())])
            kind = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kind)], ["path", "start", "length", "blank", "quotes", "outside", "within"])


def _marks(b: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """(positions of the bytes with a kind, kinds, parity of the quotes before each, parity of all, odd of what follows).

    b is not empty. odd: an odd number of backslashes stands right before. Outside strings JSON has none, so their runs tell which quotes count.
    """
    quote, slash = b == ord('"'), np.flatnonzero(b == ord("\\"))
    if odd:
        quote[:1] = False
    after = False
    if len(slash):
        first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        last = slash[np.append(first[1:], len(slash)) - 1]
        length = last - slash[first] + 1
        length[0] += odd and slash[0] == 0
        escaped = last[length % 2 == 1] + 1
        after = bool(len(escaped)) and int(escaped[-1]) == len(b)
        quote[escaped[escaped < len(b)]] = False
    parity = np.bitwise_xor.accumulate(quote.view(np.uint8))
    pos = np.flatnonzero(_KINDS[b])
    return pos, _KINDS[b[pos]], parity[pos], int(parity[-1]), after


def _escaping(f, at: int) -> bool:  # noqa: ANN001
    """Whether an odd number of backslashes stands right before a place of a file."""
    n, size = 0, 4096
    while at > 0:
        f.seek(begin := max(0, at - size))
        piece = f.read(at - begin)
        run = len(piece) - len(piece.rstrip(b"\\"))
        n += run
        if run < len(piece):
            break
        at = begin
    return n % 2 == 1


def _array_elements(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_index, text) of the elements that begin in the blocks, in batches of about half a block."""
    index, texts, size = [], [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(texts, pa.binary())], ["row_index", "text"])

    for batch in batches:
        for path, start, length, inside, depth, before in zip(*batch.to_pydict().values()):
            store, name = _stored(path)
            with store.open_input_stream(name) if length < 0 else store.open_input_file(name) as f:
                odd = length >= 0 and _escaping(f, start)
                if length >= 0:
                    f.seek(start)
                try:
                    for i, text in _elements(_pieces(f, block, length), inside, odd, depth, before, length):
                        index.append(i)
                        texts.append(text)
                        size += len(text or b"")
                        if size > block // 2 or len(index) == 4096:
                            yield made()
                            index, texts, size = [], [], 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
    if index:
        yield made()


def _pieces(f, block: int, length: int) -> Iterator[bytes]:  # noqa: ANN001
    """What follows in a file: the block itself, if a length is given, then smaller pieces; otherwise pieces of a block."""
    want = block if length < 0 else length
    while piece := f.read(want):
        yield piece
        want = block if length < 0 else max(1, block // 16)


def _elements(pieces: Iterator[bytes], inside: int, odd: bool, depth: int, index: int, length: int) -> Iterator[tuple[int, bytes | None]]:
    """(index, text) of the array's elements that begin in the first length bytes of the pieces, or of all if it is -1.

    Only a whole array gets through: one value between two commas, nothing but space around the brackets. index: elements
    that end before. What is wrong inside an object is left to its parser.
    """
    held, at, ended, latest = None, 0, False, _SEPARATES
    for piece in pieces:
        b = np.frombuffer(piece, np.uint8)
        pos, kinds, before, quotes, odd = _marks(b, odd)
        pos, kinds = pos[before == inside], kinds[before == inside]
        if (kinds == 3).any():
            raise ValueError("a single quote outside a string")
        level = depth + np.cumsum(np.where(kinds == 2, 0, kinds), dtype=np.int64)
        up, down = kinds == 1, kinds == -1
        what = np.select([(up | (kinds == 2)) & (level == 1), up & (level == 2), down & (level == 1), down & (level == 0)], [_SEPARATES, _OPENS, _CLOSES, _ENDS], 0)
        pos, what = pos[what > 0], what[what > 0]
        if ((what == _OPENS) & (np.append(latest, what[:-1]) != _SEPARATES))[: len(what)].any():
            raise ValueError("two values without a comma")
        cuts = (what == _SEPARATES) | (what == _ENDS)
        places = pos[cuts].tolist()
        if not depth and (piece[: places[0] if places else None].strip(_SPACE) or places and (ended or piece[places[0]] != ord("["))):
            raise ValueError(_TORN)
        begin = 0
        for place, end in zip(places, (what[cuts] == _ENDS).tolist()):
            if held is not None:
                text = b"".join([*held, piece[begin:place]]).strip(_SPACE)
                if text or index or not end:  # not the empty array
                    yield index, _value(text)
                held = None
            if end:
                ended = True
                if piece[place] != ord("]") or piece[place + 1 :].strip(_SPACE):
                    raise ValueError(_TORN)
                break
            if length >= 0 and at + place >= length:
                return
            index += piece[place] == ord(",")
            held, begin = [], place + 1
        if held is not None:
            held.append(piece[begin:])
        at += len(piece)
        if length >= 0 and at >= length and held is None:
            return
        inside, depth, latest = inside ^ quotes, int(level[-1]) if len(level) else depth, int(what[-1]) if len(what) else latest
    if held is not None or length < 0 and not ended:
        raise ValueError(_TORN)


def _value(text: bytes) -> bytes | None:
    """The text of an element, None for null. A string stands for the text in it."""
    if text[:1] == b"{" and text[-1:] == b"}":
        return text
    value = json.loads(text)
    return None if value is None else value.encode() if isinstance(value, str) else text


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line raises."""
    return spark.read.schema(schema).options(mode="FAILFAST", **_TIMES).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in name order; nulls are written. As many files as partitions, committed together."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false", **_TIMES})
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def write_json_report(report: dict, path: str) -> None:
    """A single report, replaced in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False) as f:
        f.write(json.dumps(report, sort_keys=True, ensure_ascii=False, indent=2) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def read_published(spark: SparkSession, path: str, record: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, summaries) of published prediction files, with the file's stem as model.

    rows: model, position, record, true_label, llm_label (null unless one of the two labels); summaries: model, metrics.
    """
    result = T.StructType([T.StructField("record", record), T.StructField("true_label", T.StringType()), T.StructField("llm_label", T.StringType())])
    cells = T.StructType([T.StructField(c, T.LongType()) for c in ("TP", "FP", "TN", "FN")])
    metrics = T.StructType([T.StructField("confusion_matrix", cells), *[T.StructField(c, T.DoubleType()) for c in ("f1_score", "precision", "recall_tpr", "fpr")], T.StructField("valid_eval_count", T.LongType())])
    schema = T.StructType([T.StructField("results", T.ArrayType(result)), T.StructField("summary", T.StructType([T.StructField("metrics", metrics)]))])
    files = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("model", file_stem())
    rows = files.select("model", F.posexplode("results").alias("position", "r")).select(
        "model", "position", "r.record", "r.true_label", valid_label(F.col("r.llm_label")).alias("llm_label")
    )
    return rows, files.select("model", "summary.metrics.*")


def file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, files): every line with file and line_no (from 1), and per file n_lines and torn: it ends without a newline.

    Files may be split into blocks that different tasks read. Lines are counted within their block while they are read,
    and only the counts of the blocks, a handful of numbers a file, are summed up across tasks. Lines end in a line feed.
    """
    where = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_size")]
    read = spark.read.option("lineSep", "\n").text(path).select("value", *where)
    counted = number_runs(read, ["file_path", "file_block_start"])
    blocks = counted.groupBy("file_path", "file_block_start").agg(
        F.max("_pos").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("file_size").alias("size")
    )
    blocks = materialize(blocks, "blocks")
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file_path", "file_block_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    lines = counted.join(starts, ["file_path", "file_block_start"]).select(F.col("file_path").alias("file"), (F.col("_before") + F.col("_pos")).alias("line_no"), "value")
    files = blocks.groupBy(F.col("file_path").alias("file")).agg(F.sum("n").alias("n_lines"), (F.sum("bytes") > F.max("size")).alias("torn"))
    return lines, files


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, bad lines, files): nothing raises and nothing is written to the log.

    Blank lines are skipped but counted. bad: file, line_no, value; files: file, n_lines, torn (the last line has no end).
    """
    marked = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    lines, files = numbered_lines(spark, path)
    parsed = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    bad = F.col(f"r.{_CORRUPT}").isNotNull() | F.col("r").isNull()
    return parsed.filter(~bad).select("r.*").drop(_CORRUPT), parsed.filter(bad).select("file", "line_no", "value"), files


def recover_log(spark: SparkSession, path: str, schema: T.StructType, quarantine: str, on: str = "call_id") -> DataFrame:
    """The calls of a log whose last lines may be torn; the torn ones are set aside in the folder ``quarantine``.

    Only an unfinished last line of a file may be bad: any other bad line raises, and so does a call that stands in the log
    twice. The log itself is left alone; a session that goes on writes the returned rows to a log of its own.
    """
    good, bad, files = read_tolerant(spark, path, schema)
    last = files.filter("torn").select("file", F.col("n_lines").alias("line_no"))
    worse = bad.join(last, ["file", "line_no"], "left_anti").limit(5).collect()
    if worse:
        raise ValueError(f"bad lines: {[(r['file'], r['line_no']) for r in worse]}")
    tails = bad.join(last, ["file", "line_no"], "left_semi")
    if not tails.isEmpty():
        tails.write.mode("append").json(quarantine)
    return refuse_duplicates(good, on)


def append_durably(path: str, record: dict) -> None:
    """One line, on disk before the call returns. For the single-writer log; tables use operators.runlog.append_once."""
    with open(path, "ab") as f:
        f.write(json.dumps(record, sort_keys=True, ensure_ascii=False).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def _uri(uri: str) -> str:
    """A URI with an authority, if only an empty one: Hadoop leaves that out in places."""
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def _stored(uri: str):  # noqa: ANN202
    """(file system, name in it) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(uri))


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, sha256) of every file. Each is streamed in pieces by one task, so its size has no bound."""

    def hashed(batches):  # noqa: ANN001, ANN202
        for b in batches:
            sums = []
            for uri in b["path"]:
                store, name = _stored(uri)
                digest = hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while piece := f.read(1 << 22):
                        digest.update(piece)
                sums.append(digest.hexdigest())
            yield b[["path"]].assign(sha256=sums)

    names = spark.read.format("binaryFile").load(path).inputFiles()  # the listing, which the driver holds anyway; empty files are in it
    parts = max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(parts).mapInPandas(hashed, "path string, sha256 string")


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def write_csv(df: DataFrame, path: str) -> None:
    """Metric tables with a header; null is written as \\N, so that it differs from an empty string."""
    df.write.mode("overwrite").option("header", True).option("nullValue", NULL_TEXT).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", NULL_TEXT).option("mode", "FAILFAST").csv(path)


def nested_key_counts(rows: DataFrame, json_column: str) -> DataFrame:
    """(key, n): how often each top-level key occurs in a JSON column."""
    return rows.select(F.explode(F.json_object_keys(json_column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
