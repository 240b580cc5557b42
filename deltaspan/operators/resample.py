"""Bootstrap and regression.

Frozen forms repeat Python's generators draw by draw: they are for reports, and their results depend on the order of
the items. The generator is walked once for a group and its places are dealt over tasks, which redo the rounds. Portable forms make each draw from a hash of its
round and number, so that rounds are dealt over the cluster and any engine gets the same numbers; a task adds up the
draws of many rounds over packed values.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

SEED = 20260722
BROADCAST_GROUPS = 100_000


def order_bounds(rounds: int, level: float = 0.05) -> tuple[int, int]:
    """The places, from 0, of the two bounds among sorted draws."""
    return int(level / 2 * rounds), int((1 - level / 2) * rounds)


def mean_interval_py(values: list[float], rounds: int = 2000, seed: int = SEED) -> tuple[float | None, float | None]:
    if not values:
        return None, None
    rng, n = random.Random(seed), len(values)
    means = sorted(sum(rng.choices(values, k=n)) / n for _ in range(rounds))
    low, high = order_bounds(rounds)
    return means[low], means[high]


def paired_py(a: list[float], b: list[float], rounds: int = 2000, seed: int = SEED) -> dict:
    """Difference of means with its interval and a two-sided p; items are drawn in pairs."""
    if len(a) != len(b):
        raise ValueError("the two sides differ in length")
    n = len(a)
    if not n:
        return {"n": 0, "mean_a": None, "mean_b": None, "diff": None, "lo": None, "hi": None, "p": None}
    rng = random.Random(seed)
    first, second = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    draws = np.sort([(first[i] - second[i]).mean() for i in (np.fromiter((rng.randrange(n) for _ in range(n)), dtype=np.int64, count=n) for _ in range(rounds))])
    low, high = order_bounds(rounds)
    diff = float(first.mean() - second.mean())
    beyond = (draws <= 0).mean() if diff >= 0 else (draws >= 0).mean()
    return {"n": n, "mean_a": float(first.mean()), "mean_b": float(second.mean()), "diff": diff, "lo": float(draws[low]), "hi": float(draws[high]), "p": float(min(1.0, 2 * beyond))}


class Stream:
    """The 32-bit numbers of Python's generator from some place on, by NumPy, many at a time."""

    CHUNK = 1 << 16

    def __init__(self, key: np.ndarray, pos: int, at: int = 0) -> None:
        self.source = np.random.MT19937()
        self.source.state = {"bit_generator": "MT19937", "state": {"key": np.asarray(key, dtype=np.uint32), "pos": pos}}
        self._fill()
        self.at = at

    @classmethod
    def seeded(cls, seed: int) -> Stream:
        *key, pos = random.Random(seed).getstate()[1]
        return cls(np.array(key, dtype=np.uint32), pos)

    def _fill(self) -> None:
        self.mark = self.source.state["state"]
        self.words, self.at = self.source.random_raw(self.CHUNK), 0

    def place(self) -> tuple[bytes, int, int]:
        """The generator before the chunk, and what of the chunk is used up: arguments of another Stream."""
        return np.asarray(self.mark["key"], dtype=np.uint32).tobytes(), int(self.mark["pos"]), self.at

    def _next(self, most: int) -> np.ndarray:
        if self.at == len(self.words):
            self._fill()
        out = self.words[self.at : self.at + most]
        self.at += len(out)
        return out

    def choices(self, n: int, count: int) -> np.ndarray:
        """Places below n as random.choices draws them: two words each."""
        words, have = [], 0
        while have < 2 * count:
            words.append(self._next(2 * count - have))
            have += len(words[-1])
        pairs = np.concatenate(words).reshape(-1, 2) if words else np.zeros((0, 2), dtype=np.uint64)
        unit = ((pairs[:, 0] >> np.uint64(5)).astype(np.float64) * 67108864.0 + (pairs[:, 1] >> np.uint64(6)).astype(np.float64)) / 9007199254740992.0
        return np.floor(unit * float(n)).astype(np.int64)

    def below(self, n: int, count: int) -> np.ndarray:
        """Places below n as random.randrange draws them: the upper bits of a word, again where they are too large."""
        shift, got, have = np.uint64(32 - n.bit_length()), [], 0
        while have < count:
            own = self._next(self.CHUNK) >> shift
            fits = np.flatnonzero(own < n)
            if len(fits) > count - have:
                fits = fits[: count - have]
            if have + len(fits) == count and len(fits):
                self.at -= len(own) - int(fits[-1]) - 1
            got.append(own[fits])
            have += len(fits)
        return np.concatenate(got).astype(np.int64) if got else np.zeros(0, dtype=np.int64)


#: Rounds of a task, and items of a group at most: frozen forms are for reports, whose items a task holds at once.
SLICE, FROZEN_ITEMS = 125, 20_000_000
#: Tasks for each slice of rounds of the frozen regression, over which its groups are dealt.
SLICE_TASKS = 8


def _frozen_rounds(groups: DataFrame, by: list[str], draw: str, statistic: Callable[[list[list[float]], np.ndarray], float], rounds: int, seed: int) -> DataFrame:
    """by, turn and the draw m of each round, as Python's generator gives them when it starts anew for each group.

    groups: by and items, an array of arrays of numbers, in order. The generator is walked once for a group, without its
    items; its places, every SLICE rounds, are dealt out with the items, and the rounds made in as many tasks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["n"] > FROZEN_ITEMS:
                    raise ValueError(f"{row['n']} items are too many for a frozen form")
                stream, out = Stream.seeded(seed), []
                for first in range(0, rounds, SLICE):
                    own = min(SLICE, rounds - first)
                    out.append({c: row[c] for c in by} | dict(zip(("first", "rounds", "key", "pos", "at"), (first, own, *stream.place()), strict=True)))
                    if first + own < rounds:
                        for _ in range(own):
                            getattr(stream, draw)(row["n"], row["n"])
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*[batch.schema.field(c) for c in by], ("first", pa.int32()), ("rounds", pa.int32()), ("key", pa.binary()), ("pos", pa.int32()), ("at", pa.int32())]))

    slices = groups.select(*by, F.size("items").alias("n")).where("n > 0").mapInArrow(walk, f"{keys}, first int, rounds int, key binary, pos int, at int")
    # a slice is a task's work, however few bytes it has
    slices = slices.repartition(max(1, -(-rounds // SLICE)), "first", *by)

    def redo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                stream, items = Stream(np.frombuffer(row["key"], dtype=np.uint32), row["pos"], row["at"]), row["items"]
                m = [statistic(items, getattr(stream, draw)(len(items), len(items))) for _ in range(row["rounds"])]
                columns = {c: pa.array([row[c]] * len(m), type=batch.schema.field(c).type) for c in by}
                yield pa.RecordBatch.from_pydict(columns | {"turn": pa.array(range(row["first"], row["first"] + len(m)), type=pa.int32()), "m": pa.array(m, type=pa.float64())})

    return slices.join(F.broadcast(groups.select(*by, "items")), by).mapInArrow(redo, f"{keys}, turn int, m double")


def _in_order(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """by and items, the values of each group by their order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.array(*[F.col(v).cast("double") for v in values]).alias("v"))))
    return df.groupBy(*by).agg(F.transform(items, lambda x: x["v"]).alias("items"))


def _mean_of(items: list[list[float]], at: np.ndarray) -> float:
    return sum([items[i][0] for i in at.tolist()]) / len(items)


def _difference_of(items: list[list[float]], at: np.ndarray) -> float:
    own = np.asarray(items)[at]
    return float((own[:, 0] - own[:, 1]).mean())


def mean_interval_frozen(df: DataFrame, by: str, value: str, order: str, rounds: int = 2000, seed: int = SEED) -> DataFrame:
    """by, n and the bounds that mean_interval_py gives for each group's values in order, its rounds dealt over tasks."""
    groups = _in_order(df.where(F.col(value).isNotNull()), [by], order, [value])
    drawn = _frozen_rounds(groups, [by], "choices", _mean_of, rounds, seed)
    out = groups.select(by, F.size("items").cast("long").alias("n")).join(bounds(drawn, [by], "m", rounds), by)
    return out.select(by, "n", F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi"))


def paired_frozen(aligned: DataFrame, order: str, rounds: int = 2000, seed: int = SEED) -> DataFrame:
    """For each pair (hi, lo) of aligned values what paired_py gives, and whether its interval is above zero."""
    by = ["hi", "lo"]
    groups = _in_order(aligned, by, order, ["value_hi", "value_lo"])
    drawn = _frozen_rounds(groups, by, "below", _difference_of, rounds, seed)
    mean = lambda i: F.aggregate("items", F.lit(0.0), lambda a, x: a + x[i]) / F.size("items")
    point = groups.select(*by, F.size("items").cast("long").alias("n"), mean(0).alias("mean_hi"), mean(1).alias("mean_lo")).withColumn("diff", F.col("mean_hi") - F.col("mean_lo"))
    tails = drawn.groupBy(*by).agg(F.avg((F.col("m") <= 0).cast("double")).alias("below"), F.avg((F.col("m") >= 0).cast("double")).alias("above"))
    p = F.least(F.lit(1.0), 2 * F.when(F.col("diff") >= 0, F.col("below")).otherwise(F.col("above")))
    return point.join(bounds(drawn, by, "m", rounds), by).join(tails, by).select(*by, "n", "mean_hi", "mean_lo", "diff", "ci_lo", "ci_hi", p.alias("p"), F.when(F.col("ci_lo") > 0, "PASS").otherwise("fail").alias("gate"))


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with pos from 0 within their group and its size n.

    The rows are sorted over all tasks by ranges; a row's number is its task's offset and its place there, so that a
    group may have any number of rows. They are checkpointed, as both passes must see the same ranges.
    """
    own = cut(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)).withColumn("__at", F.monotonically_increasing_id())
    task, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    total, offset = 0, []
    for r in own.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():  # a row for each task
        offset.append((r["task"], total))
        total += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(offset, "__task long, __offset long"))
    own = own.withColumn("__task", task).join(offsets, "__task").withColumn("__at", F.col("__offset") + place).drop("__task", "__offset")
    group = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    few = group.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return own.join(F.broadcast(group) if few else group, by).withColumn("pos", F.col("__at") - F.col("__first")).drop("__at", "__first")


def hashed_place(turn: Column, number: Column, n: Column) -> Column:
    """A place below n for a draw."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", turn.cast("string"), number.cast("string"))), 1, 8), 16, 10).cast("long") % n


def quick_place(turn: Column, number: Column, n: Column) -> Column:
    """The same by a hash that costs a fiftieth, and that few other engines have."""
    return F.pmod(F.xxhash64(turn.cast("long"), number.cast("long")), n)


Place = Callable[[Column, Column, Column], Column]

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SINE_WORDS = [np.uint32(x) for x in _SINES]
_SHIFT_WORDS = [(np.uint32(x), np.uint32(32 - x)) for x in _SHIFTS]
#: Hashes made at a time.
HASHES = 1 << 15
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_first(words: list[np.ndarray], length: int, room: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of many texts of one length, of 55 bytes at most; words: the texts' own words with the closing bit; room: six rows to work in, which memory is thus touched only once."""
    message: list = [*words, *[0] * (14 - len(words)), length * 8, 0]
    a, b, c, d, f, g = room
    for row, start in zip(room, _MD5_START, strict=False):
        row[:] = start
    for i in range(61):  # the last three steps leave the first word as it is
        if i < 32:
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            f &= x
            f ^= z
            k = i if i < 16 else (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            k = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            k = 7 * i % 16
        a += f
        if isinstance(message[k], int):
            a += np.uint32((_SINES[i] + message[k]) & 0xFFFFFFFF)
        else:
            a += message[k]
            a += _SINE_WORDS[i]
        left, right = _SHIFT_WORDS[i]
        np.right_shift(a, right, out=g)
        a <<= left
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(_MD5_START[0])
    return b.byteswap()


def _remainder(x: np.ndarray, n: int) -> np.ndarray:
    if n > np.iinfo(x.dtype).max:  # only of hashes of 32 bits
        return x
    out = x // x.dtype.type(n)
    out *= x.dtype.type(n)
    return np.subtract(x, out, out=out)


def hashed_numbers(turns: range, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each turn with the first of a block of numbers below n and their hashes, of which hashed_place takes the remainder; these are the same for every group."""
    first, room = 0, np.empty((6, HASHES), dtype=np.uint32)
    while first < n:
        digits = len(str(first))
        last = min(n, first + HASHES, 10**digits)
        number, rest = np.zeros((digits, last - first), dtype=np.uint32), np.arange(first, last)
        for i in range(digits - 1, -1, -1):
            number[i] = rest % 10 + 48
            rest //= 10
        for width, own in itertools.groupby(turns, lambda t: len(str(t))):
            length = width + 1 + digits
            plain = np.zeros((length // 4 + 1, last - first), dtype=np.uint32)
            for i, byte in [*((width + 1 + i, x) for i, x in enumerate(number)), (length, 128)]:
                plain[i // 4] |= np.left_shift(byte, 8 * (i % 4), dtype=np.uint32)
            for turn in own:
                words = list(plain)
                for i in range(0, width + 1, 4):
                    words[i // 4] = plain[i // 4] | np.uint32(int.from_bytes(f"{turn}|".encode()[i : i + 4], "little"))
                yield turn, first, _md5_first(words, length, room[:, : last - first])
        first = last


_XX = tuple(np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, k: int) -> None:
    high = x >> np.uint64(64 - k)
    x <<= np.uint64(k)
    x |= high


def _xx_term(x: np.ndarray) -> np.ndarray:
    out = x.astype(np.uint64) * _XX[1]
    _rotate(out, 31)
    out *= _XX[0]
    return out


def _xx_long(term: np.ndarray, seed: int) -> np.ndarray:
    """xxhash64 of longs, as Spark has it, from their terms."""
    h = term ^ np.uint64((seed + int(_XX[4]) + 8) % 2**64)
    _rotate(h, 27)
    h *= _XX[0]
    h += _XX[3]
    h ^= h >> np.uint64(33)
    h *= _XX[1]
    h ^= h >> np.uint64(29)
    h *= _XX[2]
    h ^= h >> np.uint64(32)
    return h


def quick_numbers(turns: range, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The same for quick_place."""
    seeds = {t: int(_xx_long(_xx_term(np.array([t])), 42)[0]) for t in turns}
    for first in range(0, n, 1 << 15):
        term = _xx_term(np.arange(first, min(n, first + (1 << 15))))
        for turn in turns:
            yield turn, first, _xx_long(term, seeds[turn]).view(np.int64)


def _places(numbers: Callable[[range, int], Iterator[tuple[int, int, np.ndarray]]]) -> Callable[[range, int], Iterator[tuple[int, np.ndarray]]]:
    """Each turn with the places of its numbers below n, a block of numbers at a time."""
    return lambda turns, n: ((turn, _remainder(hashes, n)) for turn, _, hashes in numbers(turns, n))


#: The hashes of many draws at a time, and their places, for each rule by which a draw's place is found.
NUMBERS = {hashed_place: hashed_numbers, quick_place: quick_numbers}
PLACES = {place: _places(numbers) for place, numbers in NUMBERS.items()}
#: Numbers that a task holds at once (671 MB), those in a packed row, draws that are worth a task, and tasks that share a group's rounds.
HELD_ITEMS, PACKED, TASK_DRAWS, TASK_SHARES = 5 << 24, 512, 1 << 25, 12
#: Groups that are planned one by one, groups of a task, and tasks.
OWN_GROUPS, TASK_GROUPS, TASKS = 10_000, 256, 1_024


def _packed(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows in order as packed rows, checkpointed: by, __task, __at, __m and the values of __m items that follow one another, up to PACKED, as bytes, with their sum and how many aren't null.

    The rows are sorted over all tasks by ranges, so that a group may have any number of rows. A packed row begins __at
    items after the group's first one in its task. Only packed rows are written and read again, a few for each thousand
    items. Rows without a group are in none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = range(len(values))
    own = df.dropna(subset=by).select(*dict.fromkeys([*by, *order]), *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)])
    own = own.persist(StorageLevel.DISK_ONLY)  # for the ranges' bounds rows are read before they are dealt

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(1, dtype=np.int64)
            for c in by:
                codes = batch.column(c).dictionary_encode().indices.to_numpy()
                new = np.union1d(new, np.flatnonzero(np.diff(codes)) + 1)
            groups = zip(*[batch.column(c).take(pa.array(new)).to_pylist() for c in by], strict=True)
            starts, at = [], []
            for group, (a, b) in zip(groups, itertools.pairwise([*new.tolist(), batch.num_rows]), strict=True):
                if repr(group) != last:
                    last, seen = repr(group), 0
                starts += range(a, b, PACKED)
                at += range(seen, seen + b - a, PACKED)
                seen += b - a
            ends = [*starts[1:], batch.num_rows]
            columns = [*[batch.column(c).take(pa.array(starts)) for c in by], pa.array([task] * len(at), type=pa.int32()), pa.array(at, type=pa.int64()), pa.array(np.subtract(ends, starts), type=pa.int64())]
            for i in names:
                column = batch.column(f"__v{i}")
                own = column.fill_null(0.0).to_numpy()
                columns += [pa.array([own[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], type=pa.binary()), pa.array(np.add.reduceat(own, starts)), pa.array(np.add.reduceat(column.is_valid().to_numpy(zero_copy_only=False), starts, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "__task", "__at", "__m", *[f"__{c}{i}" for i in names for c in "vsk"]])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "__task int, __at long, __m long", *[f"__v{i} binary, __s{i} double, __k{i} long" for i in names]])
    ranges = own.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    packed = cut(ranges.select(*by, *[f"__v{i}" for i in names]).mapInArrow(pack, schema))
    own.unpersist()
    return packed


def _means(packed: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, n and the mean of the first of the values."""
    return packed.groupBy(*by).agg(F.sum("__m").alias("n"), F.try_divide(F.sum("__s0"), F.sum("__k0")).alias(name))


def _dealt(packed: DataFrame, by: list[str], rounds: int, most: int) -> DataFrame:
    """Packed rows once for each task that needs them, with n, __block, __at from the block's first place, __task and __share of __shares: which rounds are the task's.

    Groups that a task can hold together share its tasks, as a draw's hash is the same for all of them. most: items of a block.
    """
    parts = packed.groupBy(*by, "__task").agg(F.sum("__m").alias("m"))
    few = parts.limit(OWN_GROUPS + 1).collect()
    if len(few) > OWN_GROUPS:
        group = Window.partitionBy(*by)
        before = F.sum("m").over(group.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
        plan = parts.select(*by, "__task", F.coalesce(before, F.lit(0)).alias("__first"), F.sum("m").over(group).alias("n"), F.lit(-1).alias("__to"), F.lit(1).alias("__shares"))
    else:
        sizes, first = Counter(), []
        for r in sorted(few, key=lambda r: r["__task"]):
            own = tuple(r[c] for c in by)
            first.append((own, r["__task"], sizes[own]))
            sizes[own] += r["m"]
        together: list[list] = []
        for own, n in sizes.most_common():
            if not together or len(together[-1]) == TASK_GROUPS or sum(sizes[x] for x in together[-1]) + n > most:
                together.append([])
            together[-1].append(own)
        tasks, to = 0, {}
        for owns in together:
            total = sum(sizes[x] for x in owns)
            shares = max(1, min(TASK_SHARES, rounds, -(-total * rounds // TASK_DRAWS)))
            to |= {x: (tasks, shares) for x in owns}
            tasks += shares * -(-total // most)
        kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
        plan = [(*own, task, at, sizes[own], *to[own]) for own, task, at in first]
        plan = F.broadcast(packed.sparkSession.createDataFrame(plan, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "__task int, __first long, n long, __to int, __shares int"])))
    first, end = F.col("__first") + F.col("__at"), F.col("__first") + F.col("__at") + F.col("__m") - 1
    block = lambda place: F.floor(place / most)
    shared = packed.join(plan, [*by, "__task"]).withColumn("__block", F.explode(F.sequence(block(first), block(end)))).withColumn("__at", first - F.col("__block") * most)
    shared = shared.withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)))
    if len(few) > OWN_GROUPS:
        shared = shared.withColumn("__task", F.col("__to"))
    else:
        shared = shared.withColumn("__task", (F.col("__to") + F.col("__block") * F.col("__shares") + F.col("__share")).cast("int"))
    shared = shared.select(*by, "n", "__block", "__at", "__task", "__share", "__shares", *[c for c in packed.columns if c.startswith("__v")])
    if len(few) > OWN_GROUPS:
        return shared.repartition(TASKS, *by, "__block").sortWithinPartitions(*by, "__block")
    return shared.repartitionById(max(1, min(tasks, TASKS)), F.col("__task")).sortWithinPartitions("__task")


def draws(items: DataFrame, by: list[str], values: list[str], rounds: int, place: Place = hashed_place) -> DataFrame:
    """Sums of the values over each round's draws of numbered rows, n draws of n items for each group, all groups by the same hash."""
    return _drawn(_packed(items, by, ["pos"], values), by, values, rounds, place)


def _drawn(packed: DataFrame, by: list[str], values: list[str], rounds: int, place: Place) -> DataFrame:
    """The same of packed rows.

    A draw is never a row: a task holds the values of groups' items as numbers, HELD_ITEMS of them at most, makes
    the hashes of its rounds' draws once for all of its groups and adds up what lies at the places that they give. Only
    values are shuffled, once for each of a group's few tasks. A group of more items than a task holds is dealt over blocks
    of places, each of which goes over all draws of its rounds, so that memory stays bounded.
    """
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    names, numbers, most = [f"__v{i}" for i in range(len(values))], NUMBERS[place], max(1, HELD_ITEMS // len(values))
    dealt = _dealt(packed, by, rounds, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, types = None, {}, []

        def drawn() -> Iterator[pa.RecordBatch]:
            *_, share, shares = key
            turns = range(rounds * share // shares, rounds * (share + 1) // shares)
            sums = {own: np.zeros((len(values), len(turns))) for own in held}
            for turn, first, hashes in numbers(turns, max(n for *_, n, _ in held)):
                for (*group, n, block), parts in held.items():
                    if first >= n:
                        continue
                    at = _remainder(hashes[: n - first], n).astype(np.int64, copy=False)
                    if n > most:
                        at = at - block * most
                        at = at[(at >= 0) & (at < most)]
                    for i, part in enumerate(parts):
                        sums[(*group, n, block)][i, turn - turns[0]] += part.take(at, mode="wrap").sum()  # places are within; this mode is the quickest
            for (*group, n, _), own in sums.items():
                columns = [*[pa.array([c] * len(turns), type=t) for c, t in zip(group, types, strict=True)], pa.array(turns, type=pa.int32()), pa.array([n] * len(turns), type=pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, own)], names=[*by, "turn", "n", *names])

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            owners = zip(*batch.select([*by, "n", "__block"]).to_pydict().values(), strict=True)
            shares = zip(*batch.select(["__task", "__share", "__shares"]).to_pydict().values(), strict=True)
            packed = [batch.column(v) for v in names]
            for row, (own, (task, *share), at) in enumerate(zip(owners, shares, batch.column("__at").to_pylist(), strict=True)):
                together = (task if task >= 0 else own, *share)
                if together != key:
                    if key is not None:
                        yield from drawn()
                    key, held = together, {}  # what was held goes before the next is made
                if own not in held:
                    *_, n, block = own
                    held[own] = np.zeros((len(values), min(most, n - block * most)))
                for i, column in enumerate(packed):
                    part, room = np.frombuffer(column[row].as_buffer(), dtype=np.float64), held[own][i]
                    room[max(at, 0) : at + len(part)] = part[max(-at, 0) : len(room) - at]  # a packed row may lie in two blocks
        if key is not None:
            yield from drawn()

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "turn int, n long", *[f"{v} double" for v in names]])
    return dealt.mapInArrow(run, schema).groupBy(*by, "turn").agg(*[F.sum(v).alias(own) for v, own in zip(names, values, strict=True)], F.max("n").alias("n"))


def bounds(drawn: DataFrame, by: list[str], value: str, rounds: int, upper_less: int = 0) -> DataFrame:
    """The draws at the two bounds' places; rounds are few, so a window over a group's draws is small."""
    low, high = order_bounds(rounds)
    k = F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1
    return drawn.withColumn("k", k).groupBy(*by).agg(F.max(F.when(F.col("k") == low, F.col(value))).alias("ci_lo"), F.max(F.when(F.col("k") == high - upper_less, F.col(value))).alias("ci_hi"))


def mean_interval_portable(df: DataFrame, by: str, value: str, order: list[str], rounds: int, place: Place = hashed_place) -> DataFrame:
    packed = _packed(df.where(F.col(value).isNotNull()), [by], order, [value])
    drawn = _drawn(packed, [by], [value], rounds, place).withColumn("m", F.col(value) / F.col("n"))
    return _means(packed, [by], "mean").join(bounds(drawn, [by], "m", rounds), by)


def paired_portable(aligned: DataFrame, order: list[str], rounds: int, groups: list[str] | None = None, place: Place = hashed_place) -> DataFrame:
    """The difference of aligned values by pair, or by other columns, with its interval, p and whether it is above zero."""
    by = groups or ["hi", "lo"]
    packed = _packed(aligned.withColumn("d", F.col("value_hi") - F.col("value_lo")), by, order, ["d"])
    point = _means(packed, by, "diff")
    # rounded before they are compared and ordered, so that the order of sums can't tell draws apart
    drawn = _drawn(packed, by, ["d"], rounds, place).withColumn("m", F.round(F.col("d") / F.col("n"), 6))
    tail = drawn.join(point.select(*by, "diff"), by).groupBy(*by).agg(F.avg(F.when(F.col("diff") >= 0, F.col("m") <= 0).otherwise(F.col("m") >= 0).cast("double")).alias("tail"))
    out = point.join(bounds(drawn, by, "m", rounds), by).join(tail, by)
    return out.select(*by, "n", "diff", "ci_lo", "ci_hi", F.least(F.lit(1.0), 2 * F.col("tail")).alias("p"), F.when(F.col("ci_lo") > 0, "PASS").otherwise("fail").alias("gate"))


def ratio_portable(df: DataFrame, by: str, top: str, bottom: str, order: list[str], rounds: int, place: Place = hashed_place) -> DataFrame:
    """Interval of a ratio of sums; its upper bound is one place lower than elsewhere, by the definition of this rate."""
    drawn = _drawn(_packed(df, [by], order, [top, bottom]), [by], [top, bottom], rounds, place).withColumn("m", F.round(F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom)), F.lit(0.0)), 6))
    mean = drawn.groupBy(by).agg(F.avg("m").alias("mean"))
    return mean.join(bounds(drawn, [by], "m", rounds, 1), by)


def ratio_frozen_py(pools: dict[str, list[tuple[int, int]]], rounds: int, seed: int = SEED) -> dict[str, tuple[float, float, float]]:
    """Mean and bounds of a ratio of sums for each pool in order; one stream of draws serves all pools."""
    rng, out = random.Random(seed), {}
    low, high = order_bounds(rounds)
    for name, pool in pools.items():
        if not pool:
            continue
        data, n, got = np.array(pool, dtype=float), len(pool), []
        for _ in range(rounds):
            top, bottom = data[[rng.randrange(n) for _ in range(n)]].sum(axis=0)
            got.append(top / bottom if bottom else 0.0)
        got.sort()
        out[name] = (round(sum(got) / rounds, 4), round(got[low], 4), round(got[high - 1], 4))
    return out


def random_floor_py(sentences: list[dict], widths: list[int], rounds: int = 200, seed: int = SEED) -> dict[str, tuple[float, float, float]]:
    """Recall by category (any overlap, half overlap, exact) of as many random spans as were predicted.

    sentences: category, length, budget, gold (a list of occurrences for each gold span), in order.
    """
    rng = random.Random(seed)
    hits: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        for s in sentences:
            spans = []
            for _ in range(s["budget"]):
                w = min(rng.choice(widths), max(1, s["length"]))
                a = rng.randrange(max(1, s["length"] - w + 1))
                spans.append((a, a + w))
            own = hits.setdefault(s["category"], np.zeros(4))
            for occurrences in s["gold"]:
                share = [(min(b, d) - max(a, c), b - a + d - c) for a, b in occurrences for c, d in spans]
                own += [any(x > 0 for x, _ in share), any(x > 0 and 2 * x >= total - x for x, total in share), any(o == f for o in occurrences for f in spans), 1]
    return {c: tuple(round(float(h / v[3]), 4) if v[3] else 0.0 for h in v[:3]) for c, v in hits.items()}  # type: ignore[misc]


def _design(rows: pd.DataFrame, categories: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Names, columns and values: categories against the first one present, standardised length and edit distance; nothing for too few rows."""
    rows = rows[rows["delta"].notna()]
    present = [c for c in categories if (rows["category"] == c).any()]
    if len(rows) < len(present) + 3:
        return None

    def standard(v: pd.Series) -> np.ndarray:
        x = v.to_numpy(dtype=float)
        return (x - x.mean()) / x.std() if x.std() > 1e-9 else np.zeros(len(x))

    table = {"intercept": np.ones(len(rows))} | {f"cat={c}": (rows["category"] == c).to_numpy(dtype=float) for c in present[1:]}
    table |= {"length_z": standard(rows["length"]), "editdist_z": standard(rows["edit_distance"])}
    return list(table), np.column_stack(list(table.values())), rows["delta"].to_numpy(dtype=float)


def _table_of(items: pa.StructArray, columns: list[str]) -> pd.DataFrame:
    """Items as columns of numbers and codes: none of them becomes an object of Python's."""
    out = {}
    for c in columns:
        own = items.field(c)
        if pa.types.is_floating(own.type):
            out[c] = own.to_numpy(zero_copy_only=False)
        else:
            own = own.dictionary_encode()
            out[c] = pd.Categorical.from_codes(own.indices.fill_null(-1).to_numpy(zero_copy_only=False), own.dictionary.to_pylist())
    return pd.DataFrame(out)


def _solved(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares; the least of all solutions where a draw is short of rank."""
    return np.linalg.lstsq(x, y, rcond=None)[0]


def regression_py(rows: pd.DataFrame, categories: list[str], rounds: int = 1000, seed: int = SEED) -> pd.DataFrame:
    """Least squares of delta on categories, standardised length and edit distance, with percentile intervals.

    The first category present is the baseline. Too few rows give no coefficients.
    """
    if (made := _design(rows, categories)) is None:
        return pd.DataFrame(columns=["name", "estimate", "lo", "hi", "excludes_zero"])
    names, x, y = made
    rng = np.random.default_rng(seed)
    drawn = np.array([_solved(x[i], y[i]) for i in (rng.integers(0, len(y), len(y)) for _ in range(rounds))])
    lo, hi = np.quantile(drawn, [0.025, 0.975], axis=0)
    return pd.DataFrame({"name": names, "estimate": _solved(x, y), "lo": lo, "hi": hi, "excludes_zero": (lo > 0) | (hi < 0)})


def regression(df: DataFrame, by: str, categories: list[str], order: str, rounds: int = 1000, seed: int = SEED) -> DataFrame:
    """The regression of each group as regression_py has it, its rounds dealt over tasks.

    The generator is walked once for a group; its states, every SLICE rounds, are dealt out with the group's rows.
    """
    kind, columns = df.schema[by].dataType.simpleString(), ["category", "length", "edit_distance", "delta"]
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("category").cast("string").alias("category"), *[F.col(c).cast("double").alias(c) for c in columns[1:]])))
    groups = df.where(F.col("delta").isNotNull()).groupBy(by).agg(items.alias("items")).withColumn("items", F.transform("items", lambda x: x.dropFields("o")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["n"] > FROZEN_ITEMS:
                    raise ValueError(f"{row['n']} items are too many for a frozen form")
                rng, out = np.random.default_rng(seed), []
                for first in range(0, rounds, SLICE):
                    own = min(SLICE, rounds - first)
                    out.append({by: row[by], "first": first, "rounds": own, "state": json.dumps(rng.bit_generator.state)})
                    if first + own < rounds:
                        for _ in range(own):
                            rng.integers(0, row["n"], row["n"])
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field(by), ("first", pa.int32()), ("rounds", pa.int32()), ("state", pa.string())]))

    slices = groups.select(by, F.size("items").alias("n")).mapInArrow(walk, f"`{by}` {kind}, first int, rounds int, state string")
    # few slices of groups meet in a task
    slices = slices.repartition(max(1, SLICE_TASKS * -(-rounds // SLICE)), "first", by)

    def redo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.select([by, "first", "rounds", "state"]).slice(i, 1).to_pylist()[0]
                if (made := _design(_table_of(batch.column("items").slice(i, 1).flatten(), columns), categories)) is None:
                    continue
                names, x, y = made
                rng = np.random.default_rng()
                rng.bit_generator.state = json.loads(row["state"])
                turns = range(row["first"], row["first"] + row["rounds"])
                drawn = [(t, _solved(x[at], y[at])) for t in turns for at in [rng.integers(0, len(y), len(y))]]
                if not row["first"]:
                    drawn.append((-1, _solved(x, y)))
                n = len(drawn) * len(names)
                yield pa.RecordBatch.from_pydict({by: pa.array([row[by]] * n, type=batch.schema.field(by).type), "turn": pa.array([t for t, _ in drawn for _ in names], type=pa.int32()), "name": names * len(drawn), "b": pa.array(np.concatenate([b for _, b in drawn]))})

    drawn = slices.join(F.broadcast(groups), by).mapInArrow(redo, f"`{by}` {kind}, turn int, name string, b double")
    own = lambda p: F.percentile(F.when(F.col("turn") >= 0, F.col("b")), p)
    out = drawn.groupBy(by, "name").agg(F.max(F.when(F.col("turn") < 0, F.col("b"))).alias("estimate"), own(0.025).alias("lo"), own(0.975).alias("hi"))
    return out.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def sample_by_hash(df: DataFrame, key: str, k: int) -> DataFrame:
    """k rows by the order of a hash of their key: a top-k, that never gathers more."""
    return df.withColumn("__h", F.md5(F.col(key).cast("string"))).orderBy("__h", key).limit(k).drop("__h")


def sample_frozen(positions: int, k: int, seed: int = SEED) -> list[int]:
    """The positions, in order, that Python's generator draws."""
    return random.Random(seed).sample(range(positions), k)


