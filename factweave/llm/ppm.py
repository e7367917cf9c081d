"""Scoring documents by prediction by partial matching over bytes (operator 2).

Byte contexts up to ``order`` long are learned from the training documents. A byte is coded in
the longest context known; a byte not seen there escapes to the next shorter one, where the bytes seen
in the longer one are excluded (escape estimation by method D: half a count of each distinct byte goes
to the escape). Beside it stands a word model with additive smoothing, whose counts are exact.

All counts are Spark tables of any size. What a byte scores depends on its context and itself alone, so
each part of the documents sends its distinct runs of order + 1 bytes and its distinct words, and gets
back the score of each by a join. Runs the training documents have are scored beside their context's other
runs; the rest goes down the orders by joins, level by level. Only orders 0 and 1, which have 2**16 nodes
at most, are broadcast. A caller may drop rare nodes by ``resolution``; nothing is dropped by default.

Defined cases: a null text is empty; an empty text is its end alone. Texts are UTF-8, begun and ended by
the byte 0xFF, which UTF-8 never holds. Every row gives a row, repeated ids included; a null id is
training. Without training rows every byte has probability 1/256 and every word's term is log10 1 = 0.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import as_bytes, map_batches, mixed, scan_parts, sliced, stored

_EDGE = 0xFF
#: Bytes of text handled at a time, distinct contexts a worker adds up before it sends them, those not yet
#: added up, and those sent at once.
_CHUNK = 1 << 20
_HELD = 1 << 22
_PENDING = 1 << 20
_SENT = 1 << 16
#: Bytes of text of a part of the documents: what a worker holds grows with these, not with the input's splits.
_PART = 1 << 24
#: Bytes of text scored at a time.
_PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word hashed together with the other words'; a longer word is hashed by itself.
_LONG = 64
#: Masks of the first bytes, 0 to 8, of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def contexts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last order + 1 bytes at each byte of the texts and at their ends, as one number each, and
    where each text's numbers begin."""
    edge = bytes([_EDGE])
    raw = np.frombuffer(b"".join(edge * order + t + edge for t in texts), np.uint8)
    code = np.zeros(len(raw) - order, np.uint64)
    for j in range(order + 1):
        code <<= np.uint64(8)
        code |= raw[j : j + len(code)]
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    # Numbers whose last byte is one of a text's leading edges are left out.
    keep = np.ones(len(code), bool)
    for k in range(1, len(texts)):
        at = starts[k] + k * order
        keep[at - order : at] = False
    return code[keep], starts


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts, A-Z lower-cased, each text's followed by that of its end, the
    empty word; and where each text's hashes begin. Eight bytes of all words are hashed at a time, but for long ones."""
    joined = b"".join(t + b" " for t in texts).lower() + bytes(8)
    raw = np.frombuffer(joined, np.uint8, len(joined) - 8)
    blank = (raw == 32) | (raw - np.uint8(9) < 5)
    turns = np.flatnonzero(np.diff(blank, prepend=True))  # where a word begins, where it ends, and so on
    at, left = turns[::2], turns[1::2] - turns[::2]
    eights = np.ndarray(len(raw) + 1, "<u8", joined, strides=(1,))  # the eight bytes from each byte on
    hashes = mixed(left.astype(np.uint64) * _ODD + (eights[at] & _FIRST[np.minimum(left, 8)]))
    for i in np.flatnonzero(left > _LONG).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(memoryview(joined)[at[i] : at[i] + left[i]])
    more = np.flatnonzero((left > 8) & (left <= _LONG))
    at, left = at[more], left[more]
    while len(more):
        at, left = at + 8, left - 8
        hashes[more] = mixed(hashes[more] * _ODD + (eights[at] & _FIRST[np.minimum(left, 8)]))
        longer = left > 8
        more, at, left = more[longer], at[longer], left[longer]
    ends = np.searchsorted(turns[::2], np.cumsum([len(t) + 1 for t in texts]))
    starts = np.concatenate([[0], ends[:-1]]) + np.arange(len(texts))
    return np.insert(hashes, ends, mixed(np.zeros(1, np.uint64))[0]), starts


def chunks(texts: Iterator[bytes], most: int = _CHUNK) -> Iterator[list[bytes]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t) + 1
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


class Index:
    """Positions of 64-bit keys, looked up for whole arrays: open addressing in a table half full at most."""

    def __init__(self, keys: np.ndarray) -> None:
        self.size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.keys, self.at = keys, np.full(self.size, -1, np.int32)
        for low in range(0, len(keys), _SENT):  # a slice at a time, as sorting needs several copies
            left = np.arange(low, min(low + _SENT, len(keys)))
            slot = self.place(keys[left])
            while len(left):
                free = self.at[slot] < 0
                chosen, first = np.unique(slot[free], return_index=True)
                mine = np.flatnonzero(free)[first]
                self.at[chosen] = left[mine]
                rest = np.ones(len(left), bool)
                rest[mine] = False
                left, slot = left[rest], (slot[rest] + 1) & (self.size - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(65 - self.size.bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self.place(keys)
        got = self.at[slot]
        if not len(self.keys):
            return got
        left = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & (self.size - 1)
            got[left] = at = self.at[slot[left]]
            left = left[(at >= 0) & (self.keys[at] != keys[left])]
        return got


def _low(column: str, bytes_: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << 8 * bytes_) - 1)) if bytes_ < 8 else F.col(column)


def _context(column: str) -> Column:
    return F.call_function("shiftrightunsigned", column, F.lit(8))


def _low_context(k: int) -> Column:
    return _context("code").bitwiseAND(F.lit((1 << 8 * k) - 1))


def _down(state: DataFrame) -> DataFrame:
    """state (code, out, gone, seen) with the facts of a context (total, kept, distinct, below; null where it
    is not known) after the escape from it."""
    known = F.coalesce(F.col("distinct") > 0, F.lit(False))
    escape = 0.5 * (F.col("distinct") - F.col("seen")) + F.col("total") - F.col("kept")
    out = F.when(known & (escape > 0), F.col("out") + F.log10(escape / (F.col("total") - F.col("gone")))).otherwise(F.col("out"))
    return state.select("code", out.alias("out"), F.when(known, F.coalesce("below", F.lit(0.0))).otherwise(F.col("gone")).alias("gone"), F.when(known, F.col("distinct").cast("double")).otherwise(F.col("seen")).alias("seen"))


def _below(kept: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """(context, below): the count that a context's kept nodes of order k have in the next shorter one."""
    m = shorter.select(F.col("code").alias("low"), F.col("m").cast("double").alias("its"))
    return kept.select(_context("code").alias("context"), _low("code", k).alias("low")).join(m, "low").groupBy("context").agg(F.sum("its").alias("below"))


def _shorter(nodes: DataFrame, k: int) -> DataFrame:
    return stored(nodes.groupBy(_low("code", k).alias("code")).agg(F.sum("n").alias("n"), F.count("*").alias("m")), "contexts")


def missed_scores(missed: DataFrame, open_nodes: DataFrame, nodes: DataFrame, order: int, least: int) -> DataFrame:
    """(code, score) of runs that have no node of their own.

    missed: code, and total, kept and distinct of its context. open_nodes: code of the kept nodes in these
    contexts. nodes: (code, n) of all training runs.
    """
    levels = {order: nodes}
    for k in range(order, 0, -1):
        levels[k - 1] = _shorter(levels[k], k)
    start = missed.withColumns({"out": F.lit(0.0), "gone": F.lit(0.0), "seen": F.lit(0.0), "context": _context("code")})
    state = _down(start.join(_below(open_nodes, levels[order - 1], order), "context", "left") if order else start.withColumn("below", F.lit(0.0)))
    done: list[DataFrame] = []
    for k in range(order - 1, 1, -1):
        state = stored(state, "missed")
        kept = F.col("n") >= least
        wanted = state.select(_low_context(k).alias("context")).distinct()
        own = levels[k].withColumn("context", _context("code")).join(wanted, "context", "left_semi")
        facts = own.groupBy("context").agg(F.sum("m").alias("total"), F.coalesce(F.sum(F.when(kept, F.col("m"))), F.lit(0)).alias("kept"), F.count(F.when(kept, 1)).alias("distinct"))
        facts = facts.join(_below(own.where(kept), levels[k - 1], k), "context", "left")
        nodes_k = levels[k].where(kept).select(F.col("code").alias("node"), "m")
        at = state.withColumn("context", _low_context(k)).withColumn("node", _low("code", k + 1)).join(facts, "context", "left").join(nodes_k, "node", "left")
        at = stored(at, "missed")
        done.append(at.where("m IS NOT NULL").select("code", (F.col("out") + F.log10((F.col("m") - 0.5) / (F.col("total") - F.col("gone")))).alias("score")))
        state = _down(at.where("m IS NULL"))
    rows = {k: levels[k].select("code", "m").toPandas() for k in range(min(order, 2))}  # 2**16 rows at most
    m = {k: np.zeros(1 << 8 * (k + 1)) for k in rows}
    for k, r in rows.items():
        m[k][r["code"].to_numpy(np.int64)] = r["m"].to_numpy(np.float64)
    shared = state.sparkSession.sparkContext.broadcast(m)

    def make():
        tables = []
        for k in sorted(shared.value, reverse=True):
            own = shared.value[k].reshape(-1, 256)
            below = (own > 0) @ shared.value[0] if k else np.zeros(1)
            tables.append((k, own, own.sum(axis=1), (own > 0).sum(axis=1).astype(np.float64), below))

        def run(batch: pa.RecordBatch) -> dict:
            code = batch["code"].to_numpy()
            out, gone, seen = (batch[c].to_numpy().copy() for c in ("out", "gone", "seen"))
            todo = np.arange(len(code))
            for k, own, total, distinct, below in tables:
                byte = code[todo] & 0xFF
                context = (code[todo] >> 8) & 0xFF if k else np.zeros(len(todo), np.int64)
                here, left = own[context, byte], total[context] - gone[todo]
                hit = here > 0
                out[todo[hit]] += np.log10((here[hit] - 0.5) / left[hit])
                escape = 0.5 * (distinct[context] - seen[todo])
                known = ~hit & (distinct[context] > 0)
                some = known & (escape > 0)  # else the context has nothing but excluded bytes
                out[todo[some]] += np.log10(escape[some] / left[some])
                gone[todo[known]], seen[todo[known]] = below[context[known]], distinct[context[known]]
                todo = todo[~hit]
            out[todo] -= np.log10(256 - seen[todo])
            return {"code": batch["code"], "score": pa.array(out)}

        return run

    scored = map_batches(state, make, "code long, score double")
    for other in done:
        scored = scored.unionByName(other)
    return scored


def held_out(modulus: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))


def _features(parts: DataFrame, order: int) -> DataFrame:
    """(part, word, key, n): the distinct words (word true) of each part and its distinct runs of order + 1
    bytes, and their number in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held, size = {}, {}, 0
        bounds: dict[tuple[int, bool], np.ndarray] = {}  # where the buckets of a part's words or runs begin
        texts: dict[tuple[int, bool], list] = {}  # the texts of a part not yet cut into words and runs, and their bytes

        def put(part: int, word: bool, keys: np.ndarray, n: np.ndarray) -> None:
            nonlocal size
            pending.setdefault((part, word), []).append((keys, n))
            size += len(keys)

        def fold() -> int:
            """Adds up what is pending, in 16 buckets of keys one after the other, as sorting needs several copies; says how much is held.
            The keys pending are in order, so that a bucket is a slice; the first of them set where buckets begin."""
            nonlocal size
            while pending:
                key, own = pending.popitem()
                if key not in bounds:
                    first = max((k for k, _ in own), key=len)
                    bounds[key] = first[np.arange(1, 16) * len(first) // 16]
                sums = held.setdefault(key, [(own[0][0][:0], own[0][1][:0])] * 16)
                cuts = [[0, *np.searchsorted(k, bounds[key]).tolist(), len(k)] for k, _ in own]
                for b in range(16):
                    sums[b] = _added([sums[b], *((k[c[b] : c[b + 1]], n[c[b] : c[b + 1]]) for (k, n), c in zip(own, cuts))])
            size = 0
            return sum(len(k) for sums in held.values() for k, _ in sums)

        def cut(part: int, out: bool) -> None:
            own, _ = texts.pop((part, out))
            for word, made in ((True, words(own)[0]), (False, contexts(own, order)[0])):
                keys, n = np.unique(made, return_counts=True)
                put(part, word, keys, n * (not out))

        def send() -> Iterator[pa.RecordBatch]:
            while held:
                (part, word), sums = held.popitem()
                for keys, n in ((k[i : i + _SENT], n[i : i + _SENT]) for k, n in sums for i in range(0, len(k), _SENT)):
                    yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(keys), part, np.int32)), "word": pa.array(np.full(len(keys), word)), "key": keys.view(np.int64), "n": n})

        for batch in sliced(batches):
            for part, out, text in zip(batch["part"].to_pylist(), batch["held_out"].to_pylist(), as_bytes(batch["text"])):
                own = texts.setdefault((part, out), [[], 0])
                own[0].append(text or b"")
                own[1] += len(text or b"") + 1
                if own[1] >= _CHUNK:
                    cut(part, out)
                if size > _PENDING and fold() > _HELD:
                    yield from send()
        for part, out in list(texts):
            cut(part, out)
        fold()
        yield from send()

    return parts.select("part", "held_out", "text").mapInArrow(run, "part int, word boolean, key long, n long")


def _needs(parts: DataFrame, order: int, resolution: int | None) -> DataFrame:
    """(part, key, value, flag): the term of each word of a part (flag 0: not in training, 1: it is, 3: and
    this part is the first with it) and the score of each of its runs (flag -1)."""
    group = F.when(F.col("word"), F.col("key")).otherwise(_context("key"))
    each = _features(parts, order).withColumn("group", group).repartition("word", "group")
    # The group is the first column in order, as its bits nearly settle a comparison, and the finest order is made first, as it serves all windows.
    of_key, of_group = Window.partitionBy("group", "word", "key"), Window.partitionBy("group", "word")
    each = each.withColumn("first", F.row_number().over(of_key.orderBy("part", "n")) == 1).withColumn("c", F.sum("n").over(of_key))
    least = 1
    if resolution:
        each = stored(each, "features")
        least = max(1, -(-(each.where("NOT word").agg(F.sum("n")).first()[0] or 0) // resolution))
    limit = least if order > 1 else 1
    node = F.col("first") & (F.col("c") >= limit)
    sized = each.withColumns({
        "total": F.sum("n").over(of_group),
        "kept": F.coalesce(F.sum(F.when(node, F.col("c"))).over(of_group), F.lit(0)), "distinct": F.count(F.when(node, 1)).over(of_group),
        "open": F.min("c").over(of_group) < limit,
    })
    sized = stored(sized.select("part", "word", "key", "c", "first", "total", "kept", "distinct", "open"), "sized")
    runs = sized.where("NOT word").withColumnRenamed("key", "code")
    missed = runs.where(F.col("first") & (F.col("c") < limit)).select("code", "total", "kept", "distinct")
    nodes = runs.where("first AND c > 0").select("code", F.col("c").alias("n"))
    scored = missed_scores(missed, runs.where(F.col("open") & node).select("code"), nodes, order, least)
    known = sized.where(F.col("word") | (F.col("c") >= limit)).select(
        "part", "key", F.when(F.col("word"), F.log10(F.col("c") + 0.1)).otherwise(F.log10((F.col("c") - 0.5) / F.col("total"))).alias("value"),
        F.when(~F.col("word"), -1).when(F.col("c") == 0, 0).when(F.col("first"), 3).otherwise(1).alias("flag"))
    rest = runs.where(F.col("c") < limit).select("part", "code").join(stored(scored, "missed"), "code").select("part", F.col("code").alias("key"), F.col("score").alias("value"), F.lit(-1).alias("flag"))
    return known.unionByName(rest)


def n_parts(docs: DataFrame, most: int) -> int:
    """Number of parts of the documents: no fewer than tasks that read them, and about most bytes of text in each."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(12, scan_parts(docs), -(-size // most))


def language_scores(docs: DataFrame, order: int = 5, resolution: int | None = None, modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Learns from the rows whose crc32(doc_id) mod modulus is not 0. base_score: sum over words and the end of
    log10((c + 0.1) / (N + 0.1 (V + 1))). score: log10 probability of the bytes and the end by contexts.
    resolution, if given: nodes of order 2 and more are used only if they stand for one in so many training bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(modulus))
    n = n_parts(docs, _PART)
    placed = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    parts = placed.repartition(n, "part")
    needs = _needs(placed.repartitionById(n, F.col("part")), order, resolution)

    def run(docs: pa.Table, needs: pa.Table) -> pa.Table:
        batches = needs.to_batches()
        of_runs = [b["flag"].to_numpy() < 0 for b in batches]

        def column(name: str, kind: type, runs: bool) -> np.ndarray:
            return np.concatenate([b[name].to_numpy()[own == runs] for b, own in zip(batches, of_runs)]) if batches else np.zeros(0, kind)

        index, score = Index(column("key", np.int64, True).view(np.uint64)), column("value", np.float64, True)
        word, term, flag = column("key", np.int64, False).view(np.uint64), column("value", np.float64, False), column("flag", np.int32, False)
        of_words = Index(word)
        out: dict[str, list] = {k: [np.zeros(0, kind)] for k, kind in (("n_tokens", np.int64), ("n_known", np.int64), ("words", np.float64), ("score", np.float64))}
        for texts in chunks((t or b"" for batch in sliced(docs.select(["text"]).to_batches()) for t in as_bytes(batch["text"])), _PIECE):
            codes, starts = contexts(texts, order)
            out["score"].append(np.add.reduceat(score[index.find(codes)], starts))
            hashes, starts = words(texts)
            at = of_words.find(hashes)
            out["n_tokens"].append(np.diff(starts, append=len(at)))
            out["n_known"].append(np.add.reduceat((flag[at] > 0).astype(np.int64), starts))
            out["words"].append(np.add.reduceat(term[at], starts))
        first = int((flag == 3).sum())
        # One more row tells how many of the corpus's words this part is the first to hold.
        add = lambda column, value, kind: pa.concat_arrays([column.combine_chunks() if isinstance(column, pa.ChunkedArray) else pa.array(np.concatenate(column), kind), pa.array([value], kind)])
        return pa.table({
            "doc_id": add(docs["doc_id"], None, pa.int64()), "held_out": add(docs["held_out"], True, pa.bool_()),
            "n_tokens": add(out["n_tokens"], 0, pa.int64()), "n_known": add(out["n_known"], 0, pa.int64()), "words": add(out["words"], 0.0, pa.float64()), "score": add(out["score"], 0.0, pa.float64()),
            "own": add([np.zeros(len(docs), np.int64)], first, pa.int64()), "stat": add([np.zeros(len(docs), bool)], True, pa.bool_()),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, words double, score double, own long, stat boolean"
    made = stored(parts.groupBy("part").cogroup(needs.groupBy("part")).applyInArrow(run, schema), "scores")
    totals = made.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("own"), F.lit(0)).alias("v"))
    unit = F.log10(F.col("train_tokens") + 0.1 * (F.col("v") + 1))
    joined = made.where("NOT stat").crossJoin(F.broadcast(totals))  # one row
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.col("words") - F.col("n_tokens") * unit).alias("base_score"), "score")
