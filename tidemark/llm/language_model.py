"""Class-based n-gram language model: Brown classes found by exchange clustering.

A word's chance is that of its class after the class before, times that of the word within its class. Every training
document is counted. Words move between classes while that raises the likelihood of the corpus's class bigrams: the most
frequent ones start the classes, exchanged one by one in memory; then all frequent words (MOST_IDS at most) are exchanged
over distributed bigram counts, many at a time, until a round gains next to nothing; then every other word that is seen
twice or more joins the class that raises the likelihood most, as words enter the window of Brown's algorithm. Words seen
once or never take the class that words with their ending most often have. Classes grow in number with the cube root of
the vocabulary. Held in memory are tables of classes by classes and the frequent words; all else meets the texts in joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, rows_of, small_batches, written


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of whole texts, A-Z lower-cased, one text's after the other, and how many each text has (null: none)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten().cast(pa.string())
    ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    full = pc.not_equal(flat, "")  # white space at either end of a text leaves an empty word there
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    return flat.filter(full), np.diff(before[ends])


def count_words(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """(word binary, c) over all rows: summed in each task first (in parts of ``most`` words), then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.set_column(0, "word", table["word"].cast(pa.binary()))
            yield from table.to_batches(max_chunksize=20_000)

        for batch in batches:
            counts = words_of(batch.column(0))[0].value_counts()
            held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
            if sum(map(len, held)) > 2 * most:
                held = [summed()]
                if len(held[0]) > most:
                    yield from out(held[0])
                    held = []
        if held:
            yield from out(summed())

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


#: Ids of words are 16-bit numbers, so that two neighbours are one 32-bit key.
MOST_IDS = 65_000
_PACKED = "bucket int, keys binary, counts binary"


class _Sums:
    """Counts by key, added up whenever many have come: holds the distinct keys and at most as many again."""

    def __init__(self, kind: type = np.uint32, least: int = 2_000_000):
        self.keys, self.counts, self.held, self.due, self.least = [np.zeros(0, kind)], [np.zeros(0, np.int64)], 0, least, least

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.due:
            keys, counts = self.result()
            self.keys, self.counts, self.held, self.due = [keys], [counts], len(keys), 2 * len(keys) + self.least

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, sorted, with the sums of their counts."""
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _dealt(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys, counts), the keys and counts of each bucket packed."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, ends = keys[order], counts[order], np.cumsum(np.bincount(bucket, minlength=n))
    out = [(i, keys[a:b].tobytes(), counts[a:b].tobytes()) for i, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())) if b > a]
    for i in range(0, len(out), 256):
        b, x, y = zip(*out[i : i + 256])
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["bucket", "keys", "counts"])


def _read(batches: Iterator[pa.RecordBatch], kind: type = np.uint32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for keys, counts in rows_of(batch, 16):
            yield np.frombuffer(keys, kind), np.frombuffer(counts, np.int64)


def neighbours(sequences: DataFrame, rest: int, end: int, first_rest: int, tokens: int, flush_at: int = 2_000_000) -> DataFrame:
    """(words int, right binary, right_n binary, left binary, left_n binary): of words, the words after and before them, with counts.

    sequences: one binary column of 16-bit ids, the text's end at both ends; ids from first_rest on count as rest.
    Pairs are added up in each task, then by pair (however frequent, a pair comes once from each flush), and only then
    dealt to the words on either side, which have at most MOST_IDS different neighbours each. Keys are 65,536 times the
    word, plus the neighbour; a row holds whole words.
    """
    n = int(min(4096, max(64, tokens // 1_500_000)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from _dealt(keys, counts, ((keys * np.uint32(2654435761)) >> np.uint32(8)).astype(np.int64) % n, n)

        for batch in batches:
            for (s,) in rows_of(batch):
                ids = np.frombuffer(s, np.uint16).astype(np.uint32)
                ids[(ids >= first_rest) & (ids != end)] = rest
                held.append(ids[:-1] << np.uint32(16) | ids[1:])
                size += len(ids)
                if size > flush_at:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for keys, counts in _read(batches):
            sums.add(keys, counts)
        keys, counts = sums.result()
        a, b = keys >> np.uint32(16), keys & np.uint32(0xFFFF)
        # The side is the last bit of the bucket: the words after a, the words before b.
        yield from _dealt(keys, counts, (a % n * 2).astype(np.int64), 2 * n)
        yield from _dealt(b << np.uint32(16) | a, counts, (b % n * 2 + 1).astype(np.int64), 2 * n)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (_Sums(), _Sums())
        for batch in batches:
            for bucket, keys, counts in rows_of(batch, 16):
                sides[bucket & 1].add(np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.int64))
        (rk, rc), (lk, lc) = (s.result() for s in sides)
        words = np.unique(np.concatenate([rk, lk]) >> np.uint32(16))
        ends = np.searchsorted(rk, (words.astype(np.uint64) + 1) << np.uint64(16)) + np.searchsorted(lk, (words.astype(np.uint64) + 1) << np.uint64(16))
        for part in np.split(words, np.flatnonzero(np.diff(ends // 100_000)) + 1) if len(words) else []:
            low, high = int(part[0]) << 16, (int(part[-1]) + 1) << 16
            r, l = (slice(*np.searchsorted(k.astype(np.uint64), [low, high])) for k in (rk, lk))
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(part)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (rk[r], rc[r], lk[l], lc[l]))],
                names=["words", "right", "right_n", "left", "left_n"],
            )

    pairs = sequences.mapInArrow(count, _PACKED).repartition("bucket").select("keys", "counts").mapInArrow(deal, _PACKED)
    own = (F.col("bucket") / 2).cast("int")
    return pairs.repartition(own).mapInArrow(gather, "words int, right binary, right_n binary, left binary, left_n binary")


def steps_between(pairs: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """k x k table of how often a word of each class comes after one of each, under the classes ``of`` of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for keys, counts in _read(batches):
            np.add.at(total, of[keys >> np.uint32(16)].astype(np.int64) * k + of[keys & np.uint32(0xFFFF)], counts)
        f = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f // k, pa.int32()), pa.array(f % k, pa.int32()), pa.array(total[f], pa.int64())], names=["a", "b", "n"])

    got = pairs.select("right", "right_n").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((k, k))
    if got.num_rows:
        out[got["a"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    return out


def exchange(counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word, from counts of word bigrams; the last row and column, the text's end, keep a class of their own.

    Starts from words dealt out by frequency, and moves one word at a time to the class that raises the sum of
    N(c,d) log N(c,d) - N(c) log N(c) - N(d) log N(d) most, until a round moves none. Ties go to the lower class.
    """
    n = counts.shape[0] - 1
    classes = min(classes, max(n, 1))
    k = classes + 1
    of = np.append(np.arange(n) % classes, classes)
    to_class = np.zeros((n + 1, k))  # words x classes of the next word, and of the one before
    from_class = np.zeros((n + 1, k))
    member = np.eye(k)[of]
    to_class[:], from_class[:] = counts @ member, counts.T @ member
    table = member.T @ to_class
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-12)), 0.0)
    while True:
        moved = 0
        for w in range(n):
            old, both = of[w], counts[w, w]
            right, left = to_class[w].copy(), from_class[w].copy()
            right[old] -= both
            left[old] -= both
            t = table.copy()
            t[old] -= right
            t[:, old] -= left
            t[old, old] -= both
            row, col = t.sum(1) + left, t.sum(0) + right  # tokens of the classes, w's own left out
            # Gain of adding w to each class: only that class's row and column change.
            gain = (xlogx(t + right[None, :]) - xlogx(t)).sum(1) + (xlogx(t + left[:, None]) - xlogx(t)).sum(0)
            i = np.arange(k)
            gain -= xlogx(t[i, i] + right) - xlogx(t[i, i]) + xlogx(t[i, i] + left) - xlogx(t[i, i])
            gain += xlogx(t[i, i] + right + left + both) - xlogx(t[i, i])
            out, into = right.sum() + both, left.sum() + both
            gain -= xlogx(row + out) - xlogx(row) + xlogx(col + into) - xlogx(col)
            new = int(np.argmax(np.round(gain[:classes], 6)))
            if new != old and gain[new] > gain[old] + 1e-6:
                of[w], moved = new, moved + 1
                t[new] += right
                t[:, new] += left
                t[new, new] += both
                table = t
                to_class[:, old] -= counts[:, w]
                to_class[:, new] += counts[:, w]
                from_class[:, old] -= counts[w]
                from_class[:, new] += counts[w]
        if not moved:
            return of


def ending(word: Column) -> Column:
    """What a word seen once or never is classed by: its last three bytes and whether it has bytes beyond ASCII."""
    return F.concat(F.substring(word, -3, 3), F.when(F.length(word) > F.length(word.cast("string")), F.lit(b"\xff")).otherwise(F.lit(b"")))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-12)), 0.0)


#: Up to this count of one pair, gains are looked up in tables.
_FEW = 8


def few_steps(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What (x + n) log (x + n) is above x log x, for n up to _FEW and the pairs x of classes: of the transposed table, and of the table."""
    n = np.arange(_FEW + 1.0)[:, None, None]
    step = _xlogx(table + n) - _xlogx(table)
    return np.ascontiguousarray(step.transpose(0, 2, 1)), step


def better(table: np.ndarray, old: np.ndarray, right: np.ndarray, left: np.ndarray, steps: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The class that raises the likelihood most for each of some words, each moved alone; its own if none does better.

    The last class but one holds the words that have no class yet: these always move.

    right and left: words x classes, counts of the classes after and before each word. table: classes x classes, with
    the words where they are. A word's pairs with itself are counted with its old class. steps: few_steps(table).
    """
    k, i = len(table), np.arange(len(old))
    row, col, known = table.sum(1), table.sum(0), _xlogx(table)
    gain = np.zeros((len(old), k))
    for own, other, t, before, step in zip((right, left), (left, right), (table.T, table), (known.T, known), steps or few_steps(table)):
        w, d = np.nonzero(own)
        n = own[w, d]
        # What a class has with d grows by n; looked up, or counted where n is large or the word's own pairs are d's too.
        counted = (n > _FEW) | (d == old[w])
        part = step[np.where(counted, 0, n).astype(np.int64), d]
        rows = np.flatnonzero(~counted)
        x = np.maximum(t[d[rows], old[w[rows]]] - n[rows], 0)
        part[rows, old[w[rows]]] = _xlogx(x + n[rows]) - _xlogx(x)  # its own class has n less
        rows = np.flatnonzero(counted)
        if len(rows):
            v, e, m = w[rows], d[rows], n[rows]
            cells, less = t[e], before[e]
            at = np.arange(len(rows))
            cells[at, old[v]] -= m
            same = np.flatnonzero(e == old[v])
            cells[same] -= other[v[same]]
            np.maximum(cells, 0, out=cells)
            less[at, old[v]] = _xlogx(cells[at, old[v]])
            less[same] = _xlogx(cells[same])
            cells += m[:, None]  # at least n, so that the logarithm is defined
            part[rows] = cells * np.log(cells) - less
        # Sums by word: of all words the first pair's gains, then the second's, and so on.
        size = np.bincount(w, minlength=len(old))
        start, have = np.cumsum(size) - size, np.flatnonzero(size)
        for j in range(size.max(initial=0)):
            have = have[size[have] > j]
            gain[have] += part[start[have] + j]
    for total, n in ((row, right.sum(1)), (col, left.sum(1))):
        each, which = np.unique(n, return_inverse=True)
        part = (_xlogx(total + each[:, None]) - _xlogx(total))[which]
        x = total[old] - n
        part[i, old] = _xlogx(x + n) - _xlogx(x)
        gain -= part
    # A class's pairs with itself grow on both sides at once.
    both = np.nonzero((right > 0) & (left > 0))
    r, l, own = right[both], left[both], np.diag(table)[both[1]]
    own = np.maximum(own - np.where(both[1] == old[both[0]], r + l, 0), 0)
    gain[both] += _xlogx(own + r + l) - _xlogx(own + r) - _xlogx(own + l) + _xlogx(own)
    gain = np.round(gain, 6)
    new = np.argmax(gain[:, : k - 2], 1)  # the last two classes are of the words that have none yet, and of the text's end
    return np.where((gain[i, new] > gain[i, old] + 1e-6) | (old == k - 2), new, old)


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def exchange_all(pairs: DataFrame, of: np.ndarray, k: int, least: float = 0.01) -> np.ndarray:
    """Classes of all ids, exchanged until a round for each half of the words gains under ``least`` of all gain so far.

    In each round, every word's best class is sought given the last round's classes; after the first, half of the words
    move, by turns, so that neighbours don't change places for ever. A round that lowers the likelihood is undone.
    """
    first = last = None
    turn = still = 0
    while True:
        table = steps_between(pairs, of, k)
        value = likelihood(table)
        first = value if first is None else first
        if last is not None:
            if value < last:
                return kept  # noqa: F821
            still = still + 1 if value - last < least * max(value - first, 1e-9) else 0
            if still == 2:  # both halves have had their turn
                return of
        last, kept = value, of

        def run(batches: Iterator[pa.RecordBatch], table=table, turn=turn, of=of) -> Iterator[pa.RecordBatch]:
            steps = few_steps(table)
            for batch in batches:
                for row in rows_of(batch, 1):
                    right, right_n, left, left_n = (np.frombuffer(x, kind) for x, kind in zip(row, (np.uint32, np.int64) * 2))
                    words = np.unique(np.concatenate([right, left]) >> np.uint32(16)).astype(np.int64)
                    words = words[(of[words] < k - 2) & ((turn == 0) | ((words & 1) == turn % 2))]
                    for at in range(0, len(words), 100):
                        some = words[at : at + 100]
                        place = np.full(1 << 16, -1, np.int64)
                        place[some] = np.arange(len(some))
                        vectors = []
                        for keys, n in ((right, right_n), (left, left_n)):
                            low, high = np.searchsorted(keys, [int(some[0]) << 16, min((int(some[-1]) + 1) << 16, (1 << 32) - 1)])
                            part, n = keys[low:high], n[low:high]
                            at_word = place[part >> np.uint32(16)]
                            own = at_word >= 0
                            cell = at_word[own] * k + of[part[own] & np.uint32(0xFFFF)]
                            vectors.append(np.bincount(cell, n[own], len(some) * k).reshape(len(some), k))
                        new = better(table, of[some].astype(np.int64), *vectors, steps)
                        moved = new != of[some]
                        yield pa.RecordBatch.from_arrays([pa.array(some[moved], pa.int32()), pa.array(new[moved], pa.int32())], names=["id", "class"])

        moves = pairs.select("right", "right_n", "left", "left_n").mapInArrow(run, "id int, class int").toArrow()
        of = of.copy()
        of[moves["id"].to_numpy()] = moves["class"].to_numpy()
        turn += 1


def _hash48(word: bytes) -> int:
    """The upper 48 bits of Spark's 64-bit hash. Words that share them, one pair in 2^48, share a class."""
    return xxhash.xxh64_intdigest(word, 42) >> 16


def inserted(texts: DataFrame, of: np.ndarray, table: np.ndarray, tokens: int, flush_at: int = 1_000_000) -> DataFrame:
    """(h, class): each word of the column words that is seen twice or more joins the class that raises the likelihood most.

    texts: (s, words, at), the ids of a text, its words without an id of their own, and their places. What comes before
    and after a word is added up in each task, then by word: at most a number for each class and side.
    """
    k, n = len(table), int(min(65536, max(64, tokens // 1_000_000)))
    bounds = np.array([(i << 48) // n << 16 for i in range(1, n)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            # Buckets are ranges of hashes, so that what is sorted is dealt already.
            ends = np.searchsorted(keys, bounds).tolist()
            out = [(i, keys[a:b].tobytes(), counts[a:b].tobytes()) for i, (a, b) in enumerate(zip([0, *ends], [*ends, len(keys)])) if b > a]
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 256]), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "counts"])

        for batch in batches:
            ids, starts = _ids(batch.column(0))
            words, at = (batch.column(i).flatten() for i in (1, 2))
            at = np.repeat(starts, batch.column(1).value_lengths().to_numpy(zero_copy_only=False)) + at.to_numpy()
            h = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist(), repeat(42)), np.uint64, len(words)) & ~np.uint64(0xFFFF)  # _hash48, shifted
            classes = of[ids].astype(np.uint64)
            held += [h | (classes[at - 1] + np.uint64(k)), h | classes[at + 1]]
            size += 2 * len(words)
            if size > flush_at:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(np.uint64, 1_000_000)
        for keys, counts in _read(batches, np.uint64):
            sums.add(keys, counts)
        keys, counts = sums.result()
        words, first = np.unique(keys >> np.uint64(16), return_index=True)
        often = np.add.reduceat(np.where((keys & np.uint64(0xFFFF)) < k, counts, 0), first) > 1 if len(words) else np.zeros(0, bool)
        kept = np.repeat(often, np.diff(np.append(first, len(keys))))
        keys, counts, words = keys[kept], counts[kept], words[often]
        first = np.append(np.searchsorted(keys, words << np.uint64(16)), len(keys))
        steps = few_steps(table)
        for i in range(0, len(words), 200):
            some = words[i : i + 200]
            low, high = first[i], first[i + len(some)]
            w = np.repeat(np.arange(len(some)), np.diff(first[i : i + len(some) + 1]))
            cell = w * (2 * k) + (keys[low:high] & np.uint64(0xFFFF)).astype(np.int64)
            vectors = np.bincount(cell, counts[low:high], len(some) * 2 * k).reshape(len(some), 2 * k)
            new = better(table, np.full(len(some), k - 2), vectors[:, :k], vectors[:, k:], steps)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(new, pa.int32())], names=["h", "class"])

    sent = texts.select("s", "words", "at").mapInArrow(send, _PACKED)
    return sent.repartition("bucket").select("keys", "counts").mapInArrow(place, "h long, class int")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit ids of all rows of a binary column, and where each row's begin."""
    ends = np.append(0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) // 2))
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16), ends[:-1]


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each row the list in a column, null as empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for a, b in zip((ends - lengths).tolist(), ends.tolist()):
        yield flat[a:b]


def least_count(words: dict[int, int], most: int) -> int:
    """The least count such that at most ``most`` words have it or more, from the numbers of words by count. Words of one count are all in or all out."""
    total, least = 0, max(words, default=0) + 1
    for c in sorted(words, reverse=True):
        total += words[c]
        if total > most:
            break
        least = c
    return least


def score(docs: DataFrame, trains: Column, clustered: int = 600, classes: int = 48, frequent: int = 60_000, smooth: float = 0.1, most_broadcast: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row.

    ``trains`` is a condition on a column doc_id: the rows learned from. base_score is the smoothed unigram model's
    log10 probability; score the class model's, perplexity 10 to the power of -score / n_tokens. Every text ends with
    a token for its end, so null and empty texts have one token. Null ids and repeated rows stay, each scored alone;
    other columns are not read; an empty table gives an empty result; with nothing to learn from, all words are unknown.
    ``classes`` and ``clustered`` are the least numbers of classes and of words that start them: both grow with the
    vocabulary. ``frequent`` words (at most MOST_IDS) are exchanged until nothing moves any more and are looked up in
    memory; all other words that are seen twice or more join the classes in one step, distributed, by the same measure.
    Words of equal count rank by their bytes, and classes of equal gain by number.
    """
    small_batches(docs.sparkSession)
    spark, frequent = docs.sparkSession, min(frequent, MOST_IDS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    chosen = F.coalesce(trains, F.lit(False))
    learned = rows.where(chosen)
    vocabulary = written(count_words(learned), "lm-words")
    total, distinct, repeated = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") > 1)).first()
    ends = learned.count()
    n_all, v_all = total + ends, distinct + (ends > 0)
    unigram = -math.log10(n_all + 0.1 * (v_all + 1))

    least = least_count({r["c"]: r["n"] for r in vocabulary.groupBy("c").agg(F.count("*").alias("n")).collect()}, frequent)
    top = sorted(((bytes(r[0]), r[1]) for r in vocabulary.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))
    rest, end = len(top), len(top) + 1

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, end_base = pa.array([w for w, _ in top], pa.binary()).cast(pa.string()), math.log10(ends + 0.1) + unigram
        counts = np.array([c for _, c in top], float)
        base_log, model_log = (np.append(np.log10(counts + x), 0.0) for x in (0.1, smooth))
        for batch in batches:
            words, n = words_of(batch.column(3))
            own = pc.index_in(words, known_words).fill_null(rest).to_numpy()
            at = np.flatnonzero(own == rest)
            last = np.cumsum(n)
            first = last - n
            low = np.searchsorted(at, np.append(first, len(own)))
            # Each text's ids, with the text's end before and after them.
            s = np.full(len(own) + 2 * len(n), end, np.uint16)
            s[np.arange(len(own)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = own
            places = at - np.repeat(first, np.diff(low)) + 1
            base, model = base_log[own], model_log[own]
            offsets = pa.array(low, pa.int32())
            # The counts and classes of the rare words are still to come.
            out = pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, 2 * (last + 2 * np.arange(1, len(n) + 1))).astype(np.int32)), pa.py_buffer(s)]),
                    pa.array(int(ends > 0) + n - np.diff(low), pa.int64()),
                    pa.array([end_base + (b - a) * unigram + float(base[a:b].sum()) for a, b in zip(first.tolist(), last.tolist())], pa.float64()),
                    pa.array([float(model[a:b].sum()) for a, b in zip(first.tolist(), last.tolist())], pa.float64()),
                    pa.ListArray.from_arrays(offsets, words.take(pa.array(at)).cast(pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
                ],
                names=["key", "doc_id", "learns", "s", "known", "base", "model", "words", "at"],
            )
            for i in range(0, len(n), 128):
                yield out.slice(i, 128)

    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", chosen.alias("learns"), "text")
    parts = keyed.mapInArrow(parted, f"key long, doc_id {kind}, learns boolean, s binary, known long, base double, model double, words array<binary>, at array<int>")
    parts = written(parts, "lm-parts", "zstd")

    # Classes of the frequent words: the most frequent start them, then all are exchanged.
    n_exchanged = sum(c > 1 for _, c in top)
    classes = max(classes, round(repeated ** (1 / 3)))
    pairs = written(neighbours(parts.where("learns").select("s"), rest, end, n_exchanged, n_all), "lm-pairs")
    m = min(n_exchanged, max(clustered, 4 * classes))
    # Words that don't start the classes stand between those that do as one more word, so that pairs don't close up over them.
    fewer = np.full(1 << 16, m, np.int64)
    fewer[:m], fewer[end] = np.arange(m), m + 1
    started = exchange(steps_between(pairs, fewer, m + 2), classes)
    k = int(started[: m + 1].max()) + 3
    of = np.full(1 << 16, started[m], np.int32)
    of[:m] = started[:m]
    of[n_exchanged:end], of[end] = k - 2, k - 1
    if n_exchanged:
        of = exchange_all(pairs, of, k)
    table = steps_between(pairs, of, k)
    dropped(pairs)

    n_rare = n_all - ends - sum(c for _, c in top)
    joined = inserted(parts.where(F.col("learns") & (F.size("words") > 0)), of, table, n_rare)
    exchanged = spark.createDataFrame([(_hash48(w), int(of[i])) for i, (w, _) in enumerate(top[:n_exchanged])], "h long, class int")
    found = exchanged.unionAll(joined).groupBy("h").agg(F.min("class").alias("class"))
    # The classes of all words: their own, or for words seen once that of their ending.
    often = vocabulary.where(F.col("c") > 1).withColumn("h", F.shiftrightunsigned(F.xxhash64("word"), 16))
    own_class = written(often.join(found, "h", "left").select("word", "c", "class", ending(F.col("word")).alias("ending")), "lm-own", "zstd")
    by_ending = own_class.where("class is not null").groupBy("ending", "class").agg(F.sum("c").alias("n"))
    # The most frequent class, of equal ones the least: the greatest of one number, so that the sums need no sort.
    by_ending = by_ending.groupBy("ending").agg(F.max(F.col("n") * 65536 + (65535 - F.col("class"))).alias("n")).select("ending", (65535 - F.pmod("n", F.lit(65536))).cast("int").alias("e_class"))
    by_ending = written(by_ending, "lm-endings")
    few_endings = by_ending.count() <= most_broadcast
    by_ending = F.broadcast(by_ending) if few_endings else by_ending
    other = int(np.argmax(np.bincount(of[:n_exchanged], minlength=k)[: k - 2])) if n_exchanged else 0
    once = vocabulary.where(F.col("c") == 1).select("word", "c", F.lit(None).cast("int").alias("class"), ending(F.col("word")).alias("ending"))
    lexicon = own_class.unionByName(once).join(by_ending, "ending", "left").select("word", "c", F.coalesce("class", "e_class", F.lit(other)).alias("class"))
    lexicon = written(lexicon, "lm-lexicon", "zstd")
    dropped(vocabulary)
    dropped(own_class)

    types = np.ones(k)  # distinct words of each class; one more for those not met
    for r in lexicon.groupBy("class").count().collect():
        types[r["class"]] += r["count"]
    class_of = of.copy()
    if n_exchanged < len(top):
        class_of[:rest] = [r[2] for r in sorted((-r["c"], bytes(r["word"]), r["class"]) for r in lexicon.where(F.col("c") >= least).collect())]

    own = parts.select("key", "doc_id", "learns", "s", "known", "base", "model")
    rare_words = lexicon.where(F.col("c") < least)
    rare = parts.select("key", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("at").alias("at"))))
    rare = rare.join(rare_words.hint("shuffle_hash"), "word", "left")
    # Only words never met need their ending; where endings are shuffled, all keep it, so that one null key doesn't gather the rest.
    sought = F.when(F.col("class").isNull(), ending(F.col("word"))) if few_endings else ending(F.col("word"))
    rare = rare.withColumn("ending", sought).join(by_ending, "ending", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = rare.groupBy("key").agg(
        F.count_if(c > 0).alias("r_known"), F.sum(F.log10(c + 0.1)).alias("r_base"), F.sum(F.log10(c + smooth)).alias("r_model"),
        F.collect_list(F.col("at").cast("long") * 65536 + F.coalesce("class", "e_class", F.lit(other))).alias("r_classes"),
    )
    sums = [(F.col(x) + F.coalesce(f"r_{x}", F.lit(0))).alias(x) for x in ("known", "base", "model")]
    both = written(own.join(rare, "key", "left").select("doc_id", "learns", "s", *sums, "r_classes"), "lm-classed", "zstd")
    dropped(parts)

    def classed(batch: pa.RecordBatch, s: int, to: int) -> Iterator[np.ndarray]:
        """The classes of each text of a batch, from columns with its ids, and 65,536 times the places plus the classes of its rare words."""
        for ids, rare in zip(batch.column(s), _lists(batch.column(to))):
            out = class_of[np.frombuffer(ids.as_py(), np.uint16)].astype(np.int64)
            out[rare >> 16] = rare & 0xFFFF
            yield out

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k * k, np.int64)
        for batch in batches:
            steps = [x[:-1] * k + x[1:] for x in classed(batch, 0, 1)]
            if steps:
                n += np.bincount(np.concatenate(steps), minlength=k * k)
        f = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(f // k, pa.int32()), pa.array(f % k, pa.int32()), pa.array(n[f], pa.int64())], names=["a", "b", "n"])

    got = both.where("learns").select("s", "r_classes").mapInArrow(counting, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    steps = np.zeros((k, k))
    if got.num_rows:
        steps[got["a"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    log_step = np.log10((steps + smooth) / (steps.sum(1, keepdims=True) + smooth * k))
    log_class = -np.log10(steps.sum(0) + smooth * types)  # a word's chance in its class is (c + smooth) times this

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, extra = [], []
            for x in classed(batch, 1, 2):
                n.append(len(x) - 1)
                extra.append(float(log_step[x[:-1], x[1:]].sum()) + float(log_class[x[1:-1]].sum()))
            n, model = np.array(n, np.int64), batch.column(5).to_numpy(zero_copy_only=False) + np.array(extra)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), batch.column(3), pa.array(np.full(len(n), n_all)), batch.column(4), pa.array(model), pa.array(10 ** (-model / n))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    out = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return both.select("doc_id", "s", "r_classes", "known", "base", "model").mapInArrow(scored, out)
