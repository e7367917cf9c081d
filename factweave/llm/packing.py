"""Packing documents into fixed-length sequences by shortest-pack-first over lengths (operator 6).

Documents are cut into pieces of at most ``limit`` tokens; a histogram of piece lengths (at most
``limit`` rows, whatever the input) is packed on the driver, longest length first, each into the
emptiest open pack that still has room; packs of the same make-up are one pattern with a count.
Patterns go back to pieces by the rank of a piece among those of its length.

Defined cases: a null or empty text has the end token only. Repeated rows are documents of their own
and are packed each. A null id is kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import ROWS, map_batches, scan_parts, stored

#: Words, and letter runs, that a worker remembers in its younger generation; the older one holds as many at most.
_MEMO = 1 << 18
#: Words that the tokenizer splits at the end of their letters only, and whose letters it maps one by one.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([%s]*)" % re.escape(_PUNCTUATION.decode()))
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordCodes(dict):
    """The token ids of a word (UTF-8, no ASCII white space) as 32-bit numbers, remembered.

    A plain word goes to the tokenizer's model at once: its letters through the normaliser's and
    pre-tokenizer's own values for single letters, and its end as a word of its own.
    """

    def __init__(self, encoder) -> None:  # noqa: ANN001
        super().__init__()
        self.encoder, self.letters, self.older, self.older_letters = encoder, {}, {}, {}
        alphabet = [chr(c) for c in range(256) if _PLAIN.fullmatch(chr(c))]
        self.mapped = str.maketrans({c: "".join(x for x, _ in encoder.pre_tokenizer.pre_tokenize_str(encoder.normalizer.normalize_str(c))) for c in alphabet})
        self.simple = all(self.mapped[ord(c)] == c.lower() for c in alphabet if c.isascii())

    def __missing__(self, word: bytes) -> bytes:
        code = self.older.get(word)
        if code is None:
            code = self.fresh(word)
        if len(self) >= _MEMO:  # words not met since the last change of generation go
            self.older = dict(self)
            self.clear()
        self[word] = code
        return code

    def fresh(self, word: bytes) -> bytes:
        core = word.rstrip(_PUNCTUATION)
        if self.simple and core.isalpha():  # ASCII letters
            code = self.run(core.lower().decode())
            return code + self[word[len(core) :]] if len(core) < len(word) else code
        text = word.decode()
        plain = _PLAIN.fullmatch(text)
        if not plain:
            return self.encode(text)
        code = self.run(plain[1].translate(self.mapped))
        return code + self[plain[2].encode()] if plain[2] else code

    def encode(self, text: str) -> bytes:
        return array("I", self.encoder.encode(text, add_special_tokens=False).ids).tobytes()

    def run(self, letters: str) -> bytes:
        code = self.letters.get(letters)
        if code is None:
            code = self.older_letters.get(letters)
            if code is None:
                code = array("I", [t.id for t in self.encoder.model.tokenize(letters)]).tobytes()
            if len(self.letters) >= _MEMO:
                self.letters, self.older_letters = {}, self.letters
            self.letters[letters] = code
        return code


def token_ids(texts: pa.Array, codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text ends in them), by way of the distinct words of the texts. A null is empty."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    words = split.flatten().cast(pa.binary()).dictionary_encode()
    known = [codes[w] if w else b"" for w in words.dictionary.to_pylist()]
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    table, at = np.frombuffer(b"".join(known), np.uint32), np.cumsum(size) - size
    word = words.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(size[word])])
    take = np.arange(ends[-1]) + np.repeat(at[word] - ends[:-1], size[word])
    return table[take], ends[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]


def pieces(docs: DataFrame, tokenizer: str, limit: int = 4096, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of at most limit tokens: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    tokenizer: a file of the tokenizers library whose model never joins tokens across ASCII white
    space and drops it, splits letters from what follows them and normalises Latin letters one by
    one; the ids of a text are then those of its words one after another, and a worker encodes each
    distinct word once.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        codes, last = WordCodes(Tokenizer.from_str(model.value)), np.array([end], np.uint32)

        def run(batch: pa.RecordBatch) -> dict:
            rows = []
            ids, ends = token_ids(batch["text"], codes)
            for doc, a, b in zip(batch["doc_id"].to_pylist(), [0, *ends], ends):
                code = np.concatenate([ids[a:b], last])
                for start in range(0, len(code), limit):
                    part = code[start : start + limit]
                    rows.append((doc, start, len(part), zlib.crc32(part), len(code), part.view(np.int32) if with_ids else None))
            columns = list(zip(*rows))
            out = {k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), columns)}
            return out | ({"ids": pa.array(columns[5], pa.list_(pa.int32()))} if with_ids else {})

        return run

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(chosen, make, PIECES + (", ids array<int>" if with_ids else ""), rows=3 * ROWS)


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with the number of packs of each.

    The same as placing the pieces one at a time, longest first, each into the pack with the most room
    that holds it, or else into a new one; equal packs are moved together.
    """
    packs: list[tuple[int, int, tuple, int]] = []  # (-room, tie, pattern, count)
    done: list[tuple[tuple, int]] = []
    tie = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, _, pattern, count = heapq.heappop(packs)
                moved = min(left, count)
                grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
                fresh = [(room + length, grown, moved), (room, pattern, count - moved)]
            else:
                each = limit // length
                full, rest = divmod(left, each)
                moved = left
                fresh = [(-(limit - each * length), ((length, each),), full), (-(limit - rest * length), ((length, rest),), int(rest > 0))]
            left -= moved
            for room, pattern, count in fresh:
                if count and room:
                    tie += 1
                    heapq.heappush(packs, (room, tie, pattern, count))
                elif count:
                    done.append((pattern, count))
    return done + [(pattern, count) for _, _, pattern, count in sorted(packs)]


def places(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, times, first sequence, first offset) of each run of equal lengths in
    each pattern: rank r of it lies in sequence first + (r - first rank) // times."""
    seen: Counter[int] = Counter()
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            out.append((length, seen[length], count * times, times, sequence, offset))
            seen[length] += count * times
            offset += length * times
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, limit: int = 4096, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset, gapless from 0 in each sequence of at most limit tokens."""
    spark = docs.sparkSession
    buckets = 4 * scan_parts(docs)
    cut = stored(pieces(docs, tokenizer, limit, end, with_ids), "pieces").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limit rows
    found = places(shortest_pack_first(histogram, limit))
    place = spark.createDataFrame(found or [(0,) * 6], "length long, first long, ranks long, times long, sequence long, at long")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(own)).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    r = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(place), "length").where((r >= 0) & (r < F.col("ranks")))  # bounded: two patterns a length at most
    sequence = F.col("sequence") + F.floor(r / F.col("times")).cast("long")
    offset = F.col("at") + (r % F.col("times")) * F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), sequence.alias("sequence_id"), offset.alias("offset"))


def sequences(packed: DataFrame, limit: int = 4096, pad: int = 0) -> DataFrame:
    """sequence_id, ids (limit of them, padded), and the pieces in order, of pack(..., with_ids=True)."""
    part = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(part.alias("p"))  # a group holds limit tokens at most
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    padded = F.concat(ids, F.array_repeat(F.lit(pad), (F.lit(limit) - F.size(ids)).cast("int")))
    return grouped.select("sequence_id", padded.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["start"], x["offset"], x["length"])).alias("pieces"))
