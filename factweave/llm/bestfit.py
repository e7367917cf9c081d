"""Packing documents into as few sequences as possible by linear grouping (operator 13).

Documents longer than ``limit`` tokens are cut into pieces of ``limit``. A histogram of piece lengths
(at most ``limit`` rows, whatever the input) is planned on the driver: the large lengths, sorted, are
dealt into groups of equal cardinality and rounded up to the longest of their group; for these few
sizes the best mix of configurations (how many of each size lie in one sequence) is found by column
generation; the actual lengths take the places of the rounded ones; what is left over, small lengths
above all, goes longest first into the fullest sequence that has room. All steps work on counts of
equal sequences, so the plan's size depends on ``limit`` alone. Several bounds between large and small
are tried and the plan with the fewest sequences is kept. Pieces find their place by their rank among
those of their length.

Defined cases: a null or empty text has the end token only. Repeated rows are documents of their own
and are packed each. A null id is kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, scan_parts, stored
from .packing import pieces, places

#: A plan: patterns ((length, times), ...) with the number of sequences of each.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def grouped(large: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """The lengths, longest first, in about as many groups of equal cardinality: runs (length, count).
    Groups of one longest length are one group."""
    total = sum(large.values())
    out: list[list[tuple[int, int]]] = []
    taken = 0
    for length in sorted(large, reverse=True):
        left = large[length]
        while left:
            group = taken * groups // total
            most = min(left, -(-(group + 1) * total // groups) - taken)
            if not out or (group > (taken - 1) * groups // total and out[-1][0][0] != length):
                out.append([])
            runs = out[-1]
            if runs and runs[-1][0] == length:
                runs[-1] = (length, runs[-1][1] + most)
            else:
                runs.append((length, most))
            taken += most
            left -= most
    return out


def fullest(sizes: np.ndarray, values: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The configuration (times of each size, within limit) of the highest total value."""
    best, last = np.zeros(limit + 1), np.full(limit + 1, -1)
    for room in range(int(sizes.min()), limit + 1):
        fits = np.flatnonzero(sizes <= room)
        gains = best[room - sizes[fits]] + values[fits]
        k = int(gains.argmax())
        best[room], last[room] = (gains[k], fits[k]) if gains[k] > best[room - 1] else (best[room - 1], -1)
    times, room = np.zeros(len(sizes), int), limit
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            times[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[limit]), times


def configurations(sizes: np.ndarray, counts: np.ndarray, limit: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, for the fewest sequences: the linear programme over all
    configurations, rounded down. Column generation starts from sequences of one size and brings in the
    configuration worth most at the present prices while it is worth more than its one sequence."""
    columns = np.diag(limit // sizes).astype(float)
    amounts = np.linalg.solve(columns, counts)
    for _ in range(50 * len(sizes)):
        worth, times = fullest(sizes, np.linalg.solve(columns.T, np.ones(len(sizes))), limit)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(columns, times)
        limits = np.where(step > 1e-12, amounts / np.where(step > 1e-12, step, 1), np.inf)
        columns[:, int(limits.argmin())] = times
        amounts = np.maximum(np.linalg.solve(columns, counts), 0)
    return [(columns[:, i].round().astype(int), int(amounts[i] + 1e-6)) for i in range(len(sizes)) if amounts[i] >= 1 - 1e-6]


def _substitute(chosen: list[tuple[np.ndarray, int]], groups: list[list[tuple[int, int]]]) -> Plan:
    """Sequences of actual lengths: each place of a group takes the longest of it that is left. Changes groups to the rest."""
    out: Plan = []
    for times, count in chosen:
        used = [(g, int(k)) for g, k in enumerate(times) if k]
        while count:
            alike = min((groups[g][0][1] // k if groups[g] else 0) for g, k in used)
            moved = max(1, min(count, alike))
            parts: Counter[int] = Counter()
            for g, k in used:
                left = k * moved
                while left and groups[g]:
                    length, n = groups[g][0]
                    taken = min(n, left)
                    parts[length] += taken
                    left -= taken
                    groups[g][0] = (length, n - taken)
                    if n == taken:
                        groups[g].pop(0)
            count -= moved
            if parts:
                out.append((tuple((length, n // moved) for length, n in sorted(parts.items(), reverse=True)), moved))
    return out


def best_fit(opened: Plan, rest: dict[int, int], limit: int) -> Plan:
    """The plan with the rest placed, longest first, each into the fullest sequence that has room, else into a
    new one. Equal sequences are filled together: one that fits a length stays the fullest until it is full."""
    by_room: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(pattern: tuple, count: int, room: int) -> None:
        if count:
            if room not in by_room:
                insort(rooms, room)
            by_room.setdefault(room, []).append((pattern, count))

    for pattern, count in opened:
        put(pattern, count, limit - sum(n * k for n, k in pattern))
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else limit
            each = room // length
            if at < len(rooms):
                pattern, count = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                pattern, count = (), max(1, left // each)
            times = min(each, left)
            moved = min(count, left // times)
            put(pattern, count - moved, room)
            put((*pattern, (length, times)), moved, room - length * times)
            left -= times * moved
    return [x for room in rooms for x in by_room[room]]


def plan(histogram: dict[int, int], limit: int, groups: int = 64, shares: tuple[int, ...] = (2, 3, 4, 6, 8)) -> Plan:
    """Sequences for lengths with their counts: the plan with the fewest over several bounds between small and
    large, which is limit / share for each of shares; none is tried once a plan comes within a thousandth of what
    the tokens need at least."""
    least = -(-sum(n * k for n, k in histogram.items()) // limit)
    best: Plan = []
    for share in shares:
        found = _plan(histogram, limit, groups, share)
        if not best or _size(found) < _size(best):
            best = found
        if 1000 * _size(best) <= 1001 * least:
            break
    return best


def _size(plan: Plan) -> int:
    return sum(count for _, count in plan)


def _plan(histogram: dict[int, int], limit: int, groups: int, share: int) -> Plan:
    """One plan. There are at most ``groups`` rounded sizes, and no more than the square root of the number of large pieces."""
    full = histogram.get(limit, 0)
    large = {n: k for n, k in histogram.items() if limit < n * share and n < limit}
    rest = Counter({n: k for n, k in histogram.items() if n * share <= limit and n < limit})
    opened: Plan = [(((limit, 1),), full)] if full else []
    if large:
        dealt = grouped(large, max(1, min(groups, int(sum(large.values()) ** 0.5))))
        sizes = np.array([runs[0][0] for runs in dealt])
        counts = np.array([sum(n for _, n in runs) for runs in dealt], float)
        opened += _substitute(configurations(sizes, counts, limit), dealt)
        for runs in dealt:
            for length, n in runs:
                rest[length] += n
    return best_fit(opened, rest, limit)


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece (and ids): pieces lie
    gapless from offset 0 in sequences of at most limit tokens. tokenizer: as for packing.pieces."""
    buckets = 4 * scan_parts(docs)
    cut = stored(pieces(docs, tokenizer, limit, end, with_ids), "pieces").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limit rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(own)).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    chosen = ["doc_id", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else [])]
    return _placed(ranked.select(*chosen), places(plan(histogram, limit)), limit)


def _placed(ranked: DataFrame, found: list[tuple[int, int, int, int, int, int]], limit: int) -> DataFrame:
    """Pieces with the place of their rank among those of their length."""
    table = np.array(sorted(found), np.int64).reshape(-1, 6)
    shared = ranked.sparkSession.sparkContext.broadcast(table)  # its size depends on limit, not on the input

    def make():
        length, first, _, times, sequence, at = shared.value.T
        starts = length * (1 << 44) + first

        def run(batch: pa.RecordBatch) -> dict:
            n, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = np.searchsorted(starts, n * (1 << 44) + rank, "right") - 1
            r = rank - first[row]
            start = batch["start"].to_numpy()
            out = {"doc_id": batch["doc_id"], "piece": (start // limit).astype(np.int32), "start": start, "length": n, "ids_crc32": batch["ids_crc32"]}
            out |= {"sequence_id": sequence[row] + r // times[row], "offset": at[row] + r % times[row] * n}
            return out | ({"ids": batch["ids"]} if "ids" in batch.schema.names else {})

        return run

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked, make, schema + (", ids array<int>" if "ids" in ranked.columns else ""))
