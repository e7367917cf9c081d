"""Line deduplication by pairwise alignment (operator 3).

Lines are pieces of text that end at a line end or a sentence end. Documents overlap if they share an
anchor, a line of some words; each anchor ties every later document to the first one that holds it,
so one of n documents makes n - 1 pairs. Each pair is aligned by patience diff over the anchors that more
than one document has and the lines next to them; what it leaves, as swapped or doubled passages, is matched
with every place of the earlier document. The common blocks, widened by the equal words at their ends, go
from the later document. The first holder of a line always keeps it.

Defined cases: lines are compared as they stand, white space around them aside; words are runs of
anything but ASCII white space. A null or empty text has no lines. Documents are ordered by id; rows of
one id are never compared with each other, each gets its own cuts, and the one with the least text hash
stands for the id where it is the earlier document. Rows with a null id are left as they are. Other
columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import as_bytes, bit_table, map_batches, passes, sliced, stars, stored

_END = re.compile(rb"[.!?][ \t\r]+|\n")
_END_TEXT = re.compile(_END.pattern.decode())
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_CUT = "struct<s0:int,w0:int,s1:int,w1:int>"


def lines_of(text: bytes | None) -> list[bytes]:
    """The lines with a word, white space around them aside."""
    out, at = [], 0
    if text:
        for m in _END.finditer(text):
            if line := text[at : m.end()].strip():
                out.append(line)
            at = m.end()
        if line := text[at:].strip():
            out.append(line)
    return out


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence, by patience sorting."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[pile], last[pile] = v, i
        before.append(last[pile - 1] if pile else -1)
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: pairs of places of equal lines, rising in both.

    In a stretch, equal ends are matched first; then the lines that stand once in either stretch are
    the anchors, their longest rising sequence is kept, and the stretches between are done alike.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where: dict = {}
        for i in range(a0, a1):
            where[a[i]] = -1 if a[i] in where else i
        seen: dict = {}
        for j in range(b0, b1):
            seen[b[j]] = -1 if b[j] in seen else j
        anchors = sorted((j, where[x]) for x, j in seen.items() if j >= 0 and where.get(x, -1) >= 0)
        kept = [anchors[k] for k in longest_rising([i for _, i in anchors])]
        if not kept:
            continue
        i0, j0 = a0, b0
        for j, i in kept:
            out.append((i, j))
            work.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        work.append((i0, a1, j0, b1))
    return sorted(out)


def common_blocks(a: tuple[list, list, list], b: tuple[list, list, list], min_words: int) -> list[tuple[int, int, int, int]]:
    """Blocks of b of at least min_words words that a has too: (line, word) where one starts and ends.

    a, b: numbers, keys and words (one value a word) of lines. A block is a run of matched lines that
    follow each other in both; the equal words just before and after it belong to it. What the alignment
    leaves, as passages in another order or more than once, is matched with all places of a.
    """
    out: list[tuple[int, int, int, int]] = []
    run: list[tuple[int, int]] = []
    taken: set[int] = set()  # lines of b that stand whole in a block

    def close() -> None:
        if run:
            emit(run[0], run[-1])

    def emit(start_at: tuple[int, int], end_at: tuple[int, int]) -> None:
        (i, j), (k, m) = start_at, end_at
        n = sum(len(b[2][x]) for x in range(j, m + 1))
        start, end = (b[0][j], 0), (b[0][m], len(b[2][m]))
        if i and j and a[0][i - 1] == a[0][i] - 1 and b[0][j - 1] == b[0][j] - 1:
            before = _alike(a[2][i - 1][::-1], b[2][j - 1][::-1])
            n += before
            if before:
                start = (b[0][j - 1], len(b[2][j - 1]) - before)
        if k + 1 < len(a[0]) and m + 1 < len(b[0]) and a[0][k + 1] == a[0][k] + 1 and b[0][m + 1] == b[0][m] + 1:
            after = _alike(a[2][k + 1], b[2][m + 1])
            n += after
            if after:
                end = (b[0][m + 1], after)
        if n >= min_words:
            out.append((*start, *end))
            taken.update(range(j, m + 1))

    for i, j in aligned(a[1], b[1]):
        if run and (a[0][i] != a[0][run[-1][0]] + 1 or b[0][j] != b[0][run[-1][1]] + 1):
            close()
            run = []
        run.append((i, j))
    close()
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a[1]):
        where.setdefault(x, []).append(i)
    left = [j for j, x in enumerate(b[1]) if j not in taken and x in where]
    open_at: dict[int, tuple[int, int]] = {}  # by the place in a of a run's last line: where it starts
    for n, j in enumerate(left):
        if n and left[n - 1] != j - 1 or j and b[0][j - 1] != b[0][j] - 1:
            for i, at in open_at.items():
                emit(at, (i, left[n - 1]))
            open_at = {}
        here = {}
        for i in where[b[1][j]]:
            follows = i and a[0][i - 1] == a[0][i] - 1
            here[i] = open_at.pop(i - 1, (i, j)) if follows else (i, j)
        for i, at in open_at.items():
            emit(at, (i, j - 1))
        open_at = here
    for i, at in open_at.items():
        emit(at, (i, left[-1]))
    return sorted(set(out))


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """How many values are equal from the start."""
    n = min(len(x), len(y))
    unlike = np.flatnonzero(x[:n] != y[:n])
    return int(unlike[0]) if len(unlike) else n


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h")).where("doc_id IS NOT NULL AND text <> ''")


def is_anchor(line: bytes, anchor_words: int) -> bool:
    return line.count(b" ") + 1 >= anchor_words


def in_reach(repeated: list[bool], short: list[bool]) -> list[bool]:
    """The lines that a block can hold or end at: repeated anchors, the short lines that follow each other
    next to one, and the line after those, on either side."""
    near = list(repeated)
    for order in (range(len(near)), range(len(near) - 1, -1, -1)):
        reach = False
        for i in order:
            near[i] |= reach
            reach = repeated[i] or (reach and short[i])
    return near


def _key(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def anchors(docs: DataFrame, anchor_words: int) -> DataFrame:
    """(hash, first, last): smallest and largest id of the lines of at least anchor_words words, where they differ."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            keys, ids = [], []
            for i, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"])):
                own = {_key(x) for x in lines_of(text) if is_anchor(x, anchor_words)}
                keys += own
                ids += [i] * len(own)
            return {"hash": pa.array(np.array(keys, np.uint64).view(np.int64)), "doc_id": pa.array(ids, pa.int64())}

        return run

    each = map_batches(_rows(docs).select("doc_id", "text"), make, "hash long, doc_id long")
    return each.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")


def repeated_lines(docs: DataFrame, table: np.ndarray, anchor_words: int) -> DataFrame:
    """doc_id, h and, of the anchors that the bit table lets through and the lines in their reach, numbers
    (32 bits each), hashes (64), sizes in words (32) and words (a hash of 32 bits each) as binary; and
    the hashes of the anchors."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))  # fixed size

    def make():
        bits, word = np.unpackbits(shared.value).view(bool), xxhash.xxh32_intdigest

        def run(batch: pa.RecordBatch) -> dict | None:
            rows, numbers, hashes, sizes, words, anchors = [], [], [], [], [], []
            for r, text in enumerate(as_bytes(batch["text"])):
                lines = lines_of(text)
                keys = np.fromiter(map(_key, lines), np.uint64, len(lines))
                maybe = passes(bits, keys)
                if not maybe.any():
                    continue
                long = np.fromiter((is_anchor(x, anchor_words) for x in lines), bool, len(lines))
                maybe &= long
                if not maybe.any():
                    continue
                near = np.flatnonzero(in_reach(maybe.tolist(), (~long).tolist()))
                own = [lines[i].split() for i in near.tolist()]
                rows.append(r)
                numbers.append(near.astype(np.uint32).tobytes())
                hashes.append(keys[near].tobytes())
                sizes.append(np.array(list(map(len, own)), np.uint32).tobytes())
                words.append(np.fromiter((word(w) for x in own for w in x), np.uint32).tobytes())
                anchors.append(keys[maybe].view(np.int64))
            if not rows:
                return None
            take = pa.array(rows)
            return {
                "doc_id": batch["doc_id"].take(take), "h": batch["h"].take(take), "numbers": pa.array(numbers, pa.binary()), "hashes": pa.array(hashes, pa.binary()),
                "sizes": pa.array(sizes, pa.binary()), "words": pa.array(words, pa.binary()), "anchors": pa.array(anchors, pa.list_(pa.int64())),
            }

        return run

    return map_batches(_rows(docs).select("doc_id", "h", "text"), make, "doc_id long, h long, numbers binary, hashes binary, sizes binary, words binary, anchors array<long>")


def _sequence(numbers: bytes, hashes: bytes, sizes: bytes, words: bytes) -> tuple[list[int], list[int], list[np.ndarray]]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint32))
    return np.frombuffer(numbers, np.uint32).tolist(), np.frombuffer(hashes, np.uint64).tolist(), np.split(np.frombuffer(words, np.uint32), ends[:-1])


def repeated_blocks(docs: DataFrame, min_words: int = 8, anchor_words: int = 5) -> DataFrame:
    """doc_id, h, cuts: (line, word) bounds of the blocks that earlier documents have too, a row for each
    document with such a block."""
    first = stored(anchors(docs, anchor_words), "anchors")
    shared = stored(repeated_lines(docs, bit_table(first.select("hash")), anchor_words), "shared")
    holds = shared.select("doc_id", F.explode("anchors").alias("hash"))
    pairs = holds.join(first.select("hash", F.col("first").alias("c")), "hash").where("doc_id > c").select("c", F.col("doc_id").alias("m"))
    rows = stars(pairs, shared.drop("anchors"), "doc_id", "h").select("c", "side", "doc_id", "h", "numbers", "hashes", "sizes", "words")

    def make():
        held: list = [None, None]

        def run(batch: pa.RecordBatch) -> dict:
            ids, hs, cuts = [], [], []
            for c, side, doc, h, *lines in zip(*(batch[i].to_pylist() for i in range(8))):
                if side == 0:
                    if held[0] != c:  # of rows with one id the first stands for it
                        held[:] = [c, _sequence(*lines)]
                    continue
                if held[0] != c:
                    raise ValueError(f"the row of centre {c} is missing")
                found = common_blocks(held[1], _sequence(*lines), min_words)
                if found:
                    ids.append(doc)
                    hs.append(h)
                    cuts.append([dict(zip(("s0", "w0", "s1", "w1"), x)) for x in found])
            return {"doc_id": pa.array(ids, pa.int64()), "h": pa.array(hs, pa.int64()), "cuts": pa.array(cuts, pa.list_(pa.struct([(k, pa.int32()) for k in ("s0", "w0", "s1", "w1")])))}

        return run

    found = map_batches(rows, make, f"doc_id long, h long, cuts array<{_CUT}>")
    return found.groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("cuts"))  # of a document's own lines


def cut_spans(text: str, cuts: list) -> list[tuple[int, int]]:
    """The characters (start, end) that the cuts take, merged; each reaches to the word after it."""
    first: list[int] = []  # number of each line's first word
    words: list[int] = []  # where each word starts
    at = 0
    for m in [*_END_TEXT.finditer(text), None]:
        end = m.end() if m else len(text)
        own = [w.start() for w in _WORD.finditer(text, at, end)]
        if own:
            first.append(len(words))
            words += own
        at = end
    words.append(len(text))
    gone: list[tuple[int, int]] = []
    for c in cuts:
        a, b = words[first[c["s0"]] + c["w0"]], words[first[c["s1"]] + c["w1"]]
        if gone and a <= gone[-1][1]:
            gone[-1] = (gone[-1][0], max(b, gone[-1][1]))
        else:
            gone.append((a, b))
    return gone


def without_repeats(docs: DataFrame, min_words: int = 8, anchor_words: int = 5, cuts: str = "cuts") -> DataFrame:
    """docs with the text that is left, and a column named by cuts, which takes the place of one of docs
    of that name: the characters (start, end) of the old text that went."""
    found = repeated_blocks(docs, min_words, anchor_words).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("cuts").alias("__cuts"))
    text = F.col("text").cast("string")
    joined = docs.join(found, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__h")), "left")

    made = joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != cuts), "__cuts")
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema if f.name != cuts] + [T.StructField(cuts, _SPANS)])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = batch.schema.get_field_index("text")
            out, spans = batch["text"].to_pylist(), []
            for r, c in enumerate(batch["__cuts"].to_pylist()):
                gone = cut_spans(out[r], c) if c else []
                if gone:
                    ends = [0, *(x for span in gone for x in span), len(out[r])]
                    out[r] = "".join(out[r][a:b] for a, b in zip(ends[::2], ends[1::2]))
                spans.append([{"start": a, "end": b} for a, b in gone])
            kept = batch.drop_columns(["__cuts"]).set_column(at, "text", pa.array(out, pa.string()))
            yield kept.append_column(cuts, pa.array(spans, spans_type))

    return made.mapInArrow(run, schema)
