"""Line dedup by content-defined chunks of lines and by all long runs of lines.

Each line gets a 64-bit hash.  A rolling hash over the hashes of neighbouring lines chooses chunk
boundaries, so a boundary depends on the lines next to it alone, and inserting text elsewhere shifts
nothing.  Chunks of several lines are compared.  Chunks miss the margins of a shared passage, so every
least run of lines with more than 50 words is compared too, a single long line among them: together
these runs cover each passage of over 50 words that texts share in whole lines, wherever it starts and ends.

What has a hash that occurs more than once is compared byte for byte; the first occurrence in the corpus
(least id, then place) stays, all others are removed.  Each line removed has an equal line before it, so no
line goes everywhere.

Counting and comparing combine equal cuts before each shuffle, so a passage that a third of all documents
share is one row for each task.  Texts of documents that lose nothing are never rebuilt.

Edge cases: a null text has one empty line and stays null; chunks without a word are never removed, nor empty lines at the ends of a run; a null id
ranks behind every other id; rows that agree in id and text are one document, and all such rows get the same
result; of two equal cuts within one document the first stays; an empty table gives no rows; extra columns
are kept, but one named like an added column is an error, which ``prefix`` avoids.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, content_key, join_hot, shielded, slices

#: A boundary falls behind a line with a chance of 1 in MEAN_LINES.
MEAN_LINES = 4
#: Lines whose hashes the rolling hash covers.
WINDOW = 2
MIN_LINES = 2
#: A run of lines with more words than this is removed wherever it repeats.
MIN_WORDS = 50
CHUNK, RUN = 0, 1
#: The cuts to remove are broadcast if they and their documents number at most so many (under 100 MB); more are joined
#: by shuffle.
BROADCAST_ROWS = 1_000_000
_MASK = (1 << 64) - 1


def line_chunks(text: str, mean_lines: int = MEAN_LINES, window: int = WINDOW) -> list[list[str]]:
    """The lines of a text (with their line ends) in chunks; joined they give the text."""
    import xxhash

    lines = text.split("\n")
    lines[:-1] = [x + "\n" for x in lines[:-1]]
    chunks, chunk = [], []
    rolled = 0
    recent: list[int] = []
    for line in lines:
        h = xxhash.xxh3_64_intdigest(line.rstrip("\n").encode())
        recent.append(h)
        # A polynomial in the hashes: the oldest leaves as the newest enters.
        rolled = (rolled * 0x9E3779B97F4A7C15 + h) & _MASK
        if len(recent) > window:
            rolled = (rolled - recent.pop(0) * pow(0x9E3779B97F4A7C15, window, 1 << 64)) & _MASK
        chunk.append(line)
        if (rolled >> 40) % mean_lines == 0:
            chunks.append(chunk)
            chunk = []
    if chunk:
        chunks.append(chunk)
    return chunks


def body(chunk: list[str]) -> str:
    """What two chunks are compared by: a last chunk's missing line end does not matter."""
    return "".join(chunk).removesuffix("\n")


def long_runs(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(start, end) of least runs of lines with more than ``min_words`` words, at most three for each line with a word.

    From each line the shortest such run that starts there and the shortest that ends there, besides two long lines
    with empty ones between.  Whatever run of more than ``min_words`` words two texts share (from a line with a word
    to one with a word) is the union of such runs, and they depend on its lines alone.
    """
    words = [len(line.split()) for line in text.encode().split(b"\n")]
    full = [i for i, n in enumerate(words) if n]
    out = set()
    end = total = 0
    for a in full:
        while end < len(full) and total <= min_words:
            total += words[full[end]]
            end += 1
        if total <= min_words:
            break
        out.add((a, full[end - 1] + 1))
        total -= words[a]
    start = total = 0
    for e in full:
        total += words[e]
        while total - words[full[start]] > min_words:
            total -= words[full[start]]
            start += 1
        if total > min_words:
            out.add((full[start], e + 1))
    out.update((q, r + 1) for q, r in pairwise(full) if r > q + 1 and min(words[q], words[r]) > min_words)
    return sorted(out)


def cuts(text: str, mean_lines: int, min_lines: int, min_words: int) -> Iterator[tuple[int, int, int, str]]:
    """(kind, start, end, body) of all that is compared: chunks with enough lines and a word, and long runs."""
    lines = text.split("\n")
    at = 0
    for chunk in line_chunks(text, mean_lines):
        if len(chunk) >= min_lines and (content := body(chunk)).strip():
            yield CHUNK, at, at + len(chunk), content
        at += len(chunk)
    for start, end in long_runs(text, min_words):
        yield RUN, start, end, "\n".join(lines[start:end])


def _cut_rows(docs: DataFrame, id_col: str, text_col: str, mean_lines: int, min_lines: int, min_words: int) -> DataFrame:
    """(_k1, _k2, kind, start, end, h) of every chunk and long run, without their bytes."""
    source = docs.select(*content_key(id_col, text_col), F.col(text_col).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            rows: list[tuple[int, int, int, int]] = []
            at: list[int] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for kind, start, end, content in cuts(text or "", mean_lines, min_lines, min_words):
                    rows.append((kind, start, end, xxhash.xxh3_64_intdigest(content.encode(), kind) - (1 << 63)))
                    at.append(i)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(where) for i in range(2)),
                    *(pa.array([r[i] for r in rows], pa.int32()) for i in range(3)),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                ["_k1", "_k2", "kind", "start", "end", "h"],
            )

    return source.mapInArrow(cut, "_k1 long, _k2 long, kind int, start int, end int, h long")


def _with_bytes(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    """(_k1, _k2, _id, kind, start, end, h, body) of the listed cuts of each document."""
    kind = docs.schema[id_col].dataType
    source = docs.select(*content_key(id_col, text_col), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    source = _with_lists(source, spans).select("_k1", "_k2", "_id", "_text", "_list")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple[int, int, int, int, str]] = []
            at: list[int] = []
            for i, (text, spans) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                lines = text.split("\n")
                for x in spans:
                    content = "\n".join(lines[x["start"] : x["end"]])
                    if x["kind"] == CHUNK and x["end"] == len(lines):
                        content = content.removesuffix("\n")  # as body() has it
                    rows.append((x["kind"], x["start"], x["end"], x["h"], content))
                    at.append(i)
            where = pa.array(at, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(where) for i in range(3)), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
                ["_k1", "_k2", "_id", "kind", "start", "end", "h", "body"],
            )

    schema = T.StructType(
        [
            T.StructField("_k1", T.LongType()),
            T.StructField("_k2", T.LongType()),
            T.StructField("_id", kind),
            *(T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")),
            T.StructField("h", T.LongType()),
            T.StructField("body", T.StringType()),
        ]
    )
    return source.mapInArrow(read, schema)


def _with_lists(keyed: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with _k1 and _k2, and the column _list of their document: broadcast if a count says it is small."""
    lists = lists.withColumnsRenamed({"_k1": "_r1", "_k2": "_r2"})
    load = lists.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("_list")), F.lit(0))).first()[0]
    lists = F.broadcast(lists) if load <= BROADCAST_ROWS else lists.hint("merge")
    return keyed.join(lists, (F.col("_k1") == F.col("_r1")) & (F.col("_k2") == F.col("_r2")), how)


def repeated_cuts(
    docs: DataFrame, id_col: str, text_col: str, mean_lines: int, min_lines: int, min_words: int, scratch: Scratch
) -> DataFrame:
    """(_k1, _k2, _list): the chunks and long runs (kind, start, end) to remove from each document that loses any."""
    rows = scratch.put(_cut_rows(docs, id_col, text_col, mean_lines, min_lines, min_words), "cuts")
    # Cuts whose hash occurs once anywhere can't repeat: only repeated ones go on, with their bytes.
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("_h"))
    spans = rows.join(often, F.col("h") == F.col("_h"), "left_semi").groupBy("_k1", "_k2")
    spans = scratch.put(spans.agg(F.collect_set(F.struct("kind", "start", "end", "h")).alias("_list")), "spans")
    scratch.drop("cuts")
    found = _with_bytes(docs, id_col, text_col, spans)
    found = scratch.put(found.select("*", F.xxhash64(F.lit(3), "body").alias("d1"), F.xxhash64(F.lit(5), "body").alias("d2")), "found")
    place = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_k1", "_k2", "start")
    # Grouping by the very bytes is the comparison; equal hashes of different bytes fall apart here.
    groups = found.groupBy("h", "kind", "d1", "d2", "body").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = scratch.put(groups.filter("n > 1"), "groups")
    # If no two groups share a digest, which is proven here, the digest stands for the bytes in the join.
    key = ["h", "kind", "d1", "d2"]
    if groups.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
        key.append("body")
    removed = join_hot(
        found.select(*key, "_k1", "_k2", "start", "end"), groups.select(*key, "first", "n"), key, counted="n"
    ).filter(
        (F.col("_k1") != F.col("first._k1")) | (F.col("_k2") != F.col("first._k2")) | (F.col("start") != F.col("first.start"))
    )
    return scratch.put(
        removed.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("_list")), "removed"
    )


@shielded
def remove_repeated_chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mean_lines: int = MEAN_LINES,
    min_lines: int = MIN_LINES,
    prefix: str = "line_",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """The documents with their columns, the text without repeated chunks and long runs, and under ``prefix`` the
    columns ``n_lines`` (before), ``n_removed`` (lines), ``n_chunks`` (removed), ``n_run_lines`` (removed by long runs
    alone) and ``chunks_sha256`` (of the text without the repeated chunks only, null where that is the text)."""
    added = [f"{prefix}{x}" for x in ("n_lines", "n_removed", "n_chunks", "n_run_lines", "chunks_sha256")]
    if clash := set(added) & set(docs.columns):
        raise ValueError(f"the documents have columns {sorted(clash)}; give another prefix")
    scratch = Scratch(docs.sparkSession, "lines")
    removed = repeated_cuts(docs, id_col, text_col, mean_lines, min_lines, min_words, scratch)
    joined = _with_lists(docs.select("*", *content_key(id_col, text_col)), removed, "left")
    joined = joined.select(F.struct(*(F.col(c) for c in docs.columns if c != text_col)).alias("doc"), F.col(text_col).alias("text"), F.col("_list").alias("gone"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, digests, counts = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                before, digest = (text or "").count("\n") + 1, None
                of_kind: tuple[set[int], set[int]] = (set(), set())
                for x in gone or ():
                    of_kind[x["kind"]].update(range(x["start"], x["end"]))
                drop = of_kind[CHUNK] | of_kind[RUN]
                if drop:
                    lines = text.split("\n")
                    lines[:-1] = [x + "\n" for x in lines[:-1]]
                    if len(drop) > len(of_kind[CHUNK]):
                        digest = sha256("".join(x for i, x in enumerate(lines) if i not in of_kind[CHUNK]).encode()).hexdigest()
                    text = "".join(x for i, x in enumerate(lines) if i not in drop)
                out.append(text)
                digests.append(digest)
                counts.append((before, len(drop), sum(x["kind"] == CHUNK for x in gone or ()), len(drop - of_kind[CHUNK])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(digests, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4))],
                ["doc", "text", "digest", "a", "b", "c", "d"],
            )

    schema = T.StructType(
        [
            joined.schema["doc"],
            *(T.StructField(n, T.StringType()) for n in ("text", "digest")),
            *(T.StructField(n, T.LongType()) for n in ("a", "b", "c", "d")),
        ]
    )
    made = joined.mapInArrow(rebuild, schema)
    return made.select(
        *(F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns),
        F.col("a").alias(f"{prefix}n_lines"),
        F.col("b").alias(f"{prefix}n_removed"),
        F.col("c").alias(f"{prefix}n_chunks"),
        F.col("d").alias(f"{prefix}n_run_lines"),
        F.col("digest").alias(f"{prefix}chunks_sha256"),
    )
