"""Jaccard self-join of texts on their word n-grams, by prefix trees.

1. Texts with the same n-gram set are one class; only its id goes on.
2. Sets are put in one global order: n-grams that are frequent somewhere last, by rising frequency, the others by hash.
   Which ones count as frequent only decides how much work is saved: any order gives the same links. If two sets are similar enough, long enough prefixes of them
   share n-grams; how many at least follows from the sizes. Prefixes are dealt out by n-gram in packed blocks, and the
   classes that share fewer n-grams with any other than a link would need are set aside: they link with nothing.
3. What is left falls into groups that share a part: n-grams are dealt to parts by hash, about two of a set in each, and
   sets that link are the same in more of them than they can differ in others. So a shared n-gram alone seldom joins
   two groups. A group's sets are stored in a prefix tree (most frequent n-gram first, so that similar sets share paths), and each
   query set walks it once: overlaps are counted once for each shared path, and subtrees whose remaining lengths can't
   bring the overlap needed are pruned. In groups of more than a few sets only the ways to those sets are walked that
   share a rare n-gram and enough of the common ones with the query set.
4. Groups above a size are sliced first: n-grams are dealt to slices by hash, and sets that link do so in one slice at
   least, by the mean. Sets that link in no slice part; each n-gram moves once. What then still is above the size is
   cut into blocks, and each pair of blocks has a tree of its own; in groups that would need very
   many blocks, sets meet by prefix n-gram instead. Exact for groups of any size. Both copy sets; the copies move in
   rounds, so that those on disk at once stay below a part of the input, however large the groups are.

Links within a component aren't all checked: a pair that is connected already is left out, which alters no component.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, dropped, flat_map_rows, rows_of, small_batches, written
from .components import Forest, components
from .shingles import shingle_set

N = 5
#: Two sets link when LINK[1] * intersection >= LINK[0] * union.
LINK = (75, 100)
#: Part of a set's size by which prefixes are longer than one common n-gram would ask for.
WIDER = 0.15
MASK_SIG, MASK_GRAM = (1 << 48) - 1, np.uint64((1 << 40) - 1)


def least_common(n: int, link: tuple[int, int] = LINK) -> int:
    """The overlap that a set of n needs with any set it links with."""
    return -(-link[0] * n // link[1])


def wider(n: int) -> int:
    return max(1, int(WIDER * n))


def prefix_length(n: int, link: tuple[int, int] = LINK) -> int:
    """So long that two linked sets of sizes n and m share wider(min(n, m)) n-grams within their prefixes."""
    return min(n, n - least_common(n, link) + wider(n))


def least_shared(n: int, link: tuple[int, int] = LINK) -> int:
    """How many n-grams of its prefix a set of n shares at least with a set it links with, the smallest of which is considered."""
    return wider(least_common(n, link))


class Order:
    """The global order: the frequent n-grams, given with the most frequent last, come after all others."""

    def __init__(self, frequent: np.ndarray):
        by_hash = np.argsort(frequent)
        self.frequent, self.rank = frequent[by_hash], by_hash

    def ranks(self, grams: np.ndarray) -> np.ndarray:
        """The place of each n-gram among the frequent ones, -1 for all others."""
        if not len(self.frequent):
            return np.full(len(grams), -1, np.int64)
        at = np.minimum(np.searchsorted(self.frequent, grams), len(self.frequent) - 1)
        return np.where(self.frequent[at] == grams, self.rank[at], -1)

    def sorted(self, grams: np.ndarray) -> np.ndarray:
        """A set that is sorted by hash, in the global order."""
        if not len(self.frequent):
            return grams
        at = np.minimum(np.searchsorted(self.frequent, grams), len(self.frequent) - 1)
        hit = self.frequent[at] == grams
        late = grams[hit]
        return np.concatenate([grams[~hit], late[np.argsort(self.rank[at[hit]])]])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Parts:
    """Keys of sets, of which two that link have one in common.

    Sizes fall into classes so wide that linked sets are of the same or neighbouring ones; a band is two neighbouring
    classes. For each of its two bands a set's n-grams are dealt to parts by hash, and the n-grams of a part make a key.
    Linked sets differ in at most d = most_apart() n-grams of the smaller, so in at most d parts: if one of them has more
    than d parts with n-grams, a part is the same in both, and one such is among the first d + 1 of each in any order of all
    keys. First come parts with an n-gram that isn't frequent, large ones before small ones. Sets with too few parts
    give the n-grams of their prefix as keys too, by which two such sets meet.
    """

    def __init__(self, order: Order, link: tuple[int, int] = LINK):
        self.order, self.link, self.begins = order, link, [1]

    def most_apart(self, n: int) -> int:
        return n * (self.link[1] - self.link[0]) // self.link[0]

    def size_class(self, n: int) -> int:
        while len(self.begins) < 3 or self.begins[-3] <= n:
            self.begins.append(self.begins[-1] * self.link[1] // self.link[0] + 1)
        return bisect.bisect_right(self.begins, n) - 1

    def parts(self, band: int) -> int:
        """How many parts the sets of a band have; 0: each n-gram is one."""
        top = self.begins[band + 2] - 1
        return 0 if top < 60 else round(top / (1.5 if top < 200 else 2.2))

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """grams: a set that is sorted by hash."""
        n = len(grams)
        own, mixed, ranks, out, few = self.size_class(n), _mixed(grams), self.order.ranks(grams), [], False
        for band in range(max(0, own - 1), own + 1):
            parts, sums, first, size = self.parts(band), mixed, ranks, np.ones(n, np.int64)
            if parts:
                part = grams % np.uint64(parts)
                by = np.argsort(part, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(part[by]) != 0))
                sums, first, size = np.add.reduceat(mixed[by], starts), np.minimum.reduceat(ranks[by], starts), np.diff(np.append(starts, n))
                few |= len(starts) <= self.most_apart(n)
            sums = _mixed(sums + np.uint64(band + 1))
            out.append(sums[np.lexsort((sums, -size, first))[: self.most_apart(n) + 1]])
        if few:
            out.append(self.order.sorted(grams)[: n - least_common(n, self.link) + 1])
        return np.unique(np.concatenate(out))


class Sieve:
    """64-bit numbers in 16 to 32 bits each: what was put in is found, other numbers about once in 400 times at most."""

    def __init__(self, numbers: np.ndarray):
        self.digits = max(16, (16 * len(numbers)).bit_length())
        bits = np.zeros(1 << (self.digits - 3), np.uint8)
        h = numbers.astype(np.int64).view(np.uint64)
        step = _mixed(h) | np.uint64(1)
        for k in range(4):
            at = _mixed(h + np.uint64(k) * step) >> np.uint64(64 - self.digits)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        self.bits = bits

    def has(self, numbers: np.ndarray) -> np.ndarray:
        h = numbers.astype(np.int64).view(np.uint64)
        step, found = _mixed(h) | np.uint64(1), np.ones(len(h), bool)
        for k in range(4):
            at = _mixed(h + np.uint64(k) * step) >> np.uint64(64 - self.digits)
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def signature(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _pack(grams: np.ndarray, sigs: np.ndarray) -> tuple[bytes, bytes]:
    """40 bits of each n-gram and 48 of each signature, little-endian."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(a), 8), np.uint8)
    out[:, :width] = a
    return out.view("<u8").ravel()


def _described(rows: DataFrame, ngram: int, flush_at: int = 2_000_000, often: int = 3) -> DataFrame:
    """(doc_id, n_shingles, sig) of each row, and among them rows (gram, c) of n-grams that several classes of a part have."""
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_shingles", pa.int64()), ("sig", pa.int64()), ("gram", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, seen, size = WordHashes(), [], set(), 0

        def frequent() -> Iterator[pa.RecordBatch]:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            grams, counts = grams[counts >= often], counts[counts >= often]
            none = lambda t: pa.nulls(len(grams), t)
            if len(grams):
                yield pa.RecordBatch.from_arrays([none(schema[0].type), none(pa.int64()), none(pa.int64()), pa.array(grams.view(np.int64)), pa.array(counts)], schema=schema)

        for batch in batches:
            out = []
            for doc_id, text in rows_of(batch):
                grams = shingle_set(text, hashes, ngram)
                sig = signature(grams) if len(grams) else None
                out.append((doc_id, len(grams), sig, None, None))
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    held.append(grams)
                    size += len(grams)
                    if size > flush_at:
                        yield from frequent()
                        held, seen, size = [], set(), 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if held:
            yield from frequent()

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_shingles long, sig long, gram long, c long")


def _blocks(rows: DataFrame, n_buckets: int, link: tuple[int, int], ngram: int, order: Order, flush_at: int = 500_000) -> DataFrame:
    """(bucket, grams, sigs, shared, sig_counts): prefixes in packed blocks.

    Within a block, an n-gram of several classes is sent once, marked as shared; the classes that have it are counted on
    the spot. So what meets for one n-gram is at most an entry for each block, however frequent it is.
    """
    schema = pa.schema([("bucket", pa.int32()), ("grams", pa.binary()), ("sigs", pa.binary()), ("shared", pa.binary()), ("counted", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams = np.concatenate(list(held.values()))
            sigs = np.repeat(np.fromiter(held.keys(), np.int64, len(held)).view(np.uint64) & np.uint64(MASK_SIG), [len(g) for g in held.values()])
            bucket = (grams % np.uint64(n_buckets)).astype(np.int32)
            by = np.lexsort((grams, bucket))
            grams, sigs, bucket = grams[by], sigs[by], bucket[by]
            first = np.append(True, grams[1:] != grams[:-1])
            run_of = np.cumsum(first) - 1
            many = np.bincount(run_of) > 1
            counted, counts = np.unique(sigs[many[run_of]], return_counts=True)
            g, s, m, b = grams[first], sigs[first], many, bucket[first]
            cuts = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
            out = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                out.append((int(b[i]), *_pack((g[i:j] // np.uint64(n_buckets)) & MASK_GRAM, s[i:j]), m[i:j].tobytes(), b"", b""))
            # The counts made here go along in parts, one to each bucket.
            for i, part in enumerate(np.array_split(np.arange(len(counted)), n_buckets)):
                if len(part):
                    out.append((i, b"", b"", b"", counted[part].astype("<u8").tobytes(), counts[part].astype("<u4").tobytes()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for (text,) in rows_of(batch):
                grams = shingle_set(text, hashes, ngram)
                if len(grams) and (sig := signature(grams)) not in held:
                    held[sig] = order.sorted(grams)[: prefix_length(len(grams), link)]
                    size += len(held[sig])
                    if size > flush_at:
                        yield from flush()
                        held, size = {}, 0
        if held:
            yield from flush()

    return rows.select("text").mapInArrow(run, "bucket int, grams binary, sigs binary, shared binary, counted binary, counts binary")


def _shared_counts(table: pa.Table, parts: int) -> pa.Table:
    """For one bucket: how many n-grams each class (48 bits of its signature) shares with another, block-wise counts included.

    Classes and counts leave packed, a row for each part of the classes, to be added up over the buckets by part.
    """
    rows = table.to_pydict()
    grams = np.concatenate([_unpack(x, 5) for x in rows["grams"]] or [np.zeros(0, np.uint64)])
    sigs = np.concatenate([_unpack(x, 6) for x in rows["sigs"]] or [np.zeros(0, np.uint64)])
    shared = np.concatenate([np.frombuffer(x, bool) for x in rows["shared"]] or [np.zeros(0, bool)])
    order = np.lexsort((sigs, grams))
    grams, sigs, shared = grams[order], sigs[order], shared[order]
    found = np.zeros(0, np.uint64)
    if len(grams):
        first = np.append(True, grams[1:] != grams[:-1])
        starts = np.flatnonzero(first)
        run_of = np.cumsum(first) - 1
        low, high = np.minimum.reduceat(sigs, starts), np.maximum.reduceat(sigs, starts)
        met = (low != high) | np.logical_or.reduceat(shared, starts)
        take = met[run_of] & ~shared  # what was marked shared has been counted in its block
        take &= np.append(True, (sigs[1:] != sigs[:-1]) | first[1:])
        found = sigs[take]
    counted = np.concatenate([np.frombuffer(x, "<u8") for x in rows["counted"]] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]] or [np.zeros(0, np.uint32)])
    every, where = np.unique(np.concatenate([found, counted]), return_inverse=True)
    total = np.bincount(where, np.concatenate([np.ones(len(found)), counts]), len(every)).astype(np.int64)
    of = every % np.uint64(parts)
    packed = [(p, every[of == p].astype("<u8").tobytes(), total[of == p].astype("<u4").tobytes()) for p in np.unique(of).tolist()]
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([x[i] for x in packed], kinds[i]) for i in range(3)], names=["part", "sigs", "counts"])


def _summed_counts(table: pa.Table) -> pa.Table:
    """(sig48, shared) of one part of the classes, the buckets' counts added up."""
    rows = table.to_pydict()
    every, where = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in rows["sigs"]]), return_inverse=True)
    total = np.bincount(where, np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]]), len(every))
    return pa.table({"sig48": pa.array(every.astype(np.int64)), "shared": pa.array(total.astype(np.int64))})


class PrefixTree:
    """Sets as paths of n-gram ranks, with one-way stretches in one node."""

    def __init__(self, paths: list[np.ndarray], sizes: list[int]):
        self.grams: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.sets: list[list[int]] = []
        self.longest: list[int] = []
        self.smallest: list[int] = []
        self.above: list[int] = []
        self.place = [0] * len(paths)  # the node at which each set ends
        self.paths, self.sizes = paths, sizes
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self._build(order)

    def _node(self, grams: np.ndarray) -> int:
        self.grams.append(grams)
        self.children.append([])
        self.sets.append([])
        self.longest.append(0)
        self.smallest.append(1 << 60)
        self.above.append(-1)
        return len(self.grams) - 1

    def _build(self, order: list[int]) -> None:
        """Sets come sorted, so each joins the tree along the right-most path."""
        root = self._node(np.zeros(0, np.int64))
        right = [(root, 0)]  # nodes of the right-most path, each with the depth at which it ends
        last = np.zeros(0, np.int64)
        for i in order:
            path = self.paths[i]
            m = min(len(path), len(last))
            differ = np.flatnonzero(path[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            while len(right) > 1 and right[-2][1] >= common:
                right.pop()
            node, end = right[-1]
            if end > common:  # the common part ends within this node: cut it in two
                keep = len(self.grams[node]) - (end - common)
                low = self._node(self.grams[node][keep:])
                self.children[low], self.sets[low] = self.children[node], self.sets[node]
                self.grams[node], self.children[node], self.sets[node] = self.grams[node][:keep], [low], []
                right[-1] = (node, common)
            if len(path) > common:
                new = self._node(path[common:])
                self.children[node].append(new)
                right.append((new, len(path)))
                node = new
            self.sets[node].append(i)
            last = path
        stack = [(root, False)]
        while stack:
            node, done = stack.pop()
            if not done:
                stack.append((node, True))
                stack += [(c, False) for c in self.children[node]]
                continue
            for c in self.children[node]:
                self.above[c] = node
            for i in self.sets[node]:
                self.place[i] = node
            self.smallest[node] = min([self.sizes[i] for i in self.sets[node]] + [self.smallest[c] for c in self.children[node]], default=1 << 60)
            self.longest[node] = max([len(self.grams[c]) + self.longest[c] for c in self.children[node]], default=0)

    def towards(self, sets: list[int]) -> dict[int, list[int]]:
        """The children, by node, that lie on the ways from the root to the given sets."""
        ways: dict[int, list[int]] = {}
        for i in sets:
            node = self.place[i]
            new = node not in ways
            ways.setdefault(node, [])
            while new and node:
                up = self.above[node]
                new = up not in ways
                ways.setdefault(up, []).append(node)
                node = up
        return ways

    def linked(self, path: np.ndarray, size: int, vocabulary: int, link: tuple[int, int], among: list[int] | None = None) -> Iterator[int]:
        """The sets that link with a query set of the given size, whose n-grams that others share are in path.

        among: sets of which no other one can link; only the ways to them are walked.
        """
        children = self.children if among is None else self.towards(among)
        inside = np.zeros(vocabulary + 1, bool)
        inside[path] = True
        left = len(path) - np.cumsum(inside)  # the query's n-grams after each rank
        a, b = link
        stack = [(0, 0, len(path))]
        while stack:
            node, overlap, rest = stack.pop()
            grams = self.grams[node]
            if len(grams):
                overlap += int(np.count_nonzero(inside[grams]))
                rest = int(left[grams[-1]])
            # b * o >= a * (size + other - o)  <=>  (a + b) * o >= a * (size + other)
            if (a + b) * (overlap + min(rest, self.longest[node])) < a * (size + self.smallest[node]):
                continue
            for i in self.sets[node]:
                if (a + b) * overlap >= a * (size + self.sizes[i]):
                    yield i
            stack += [(c, overlap, rest) for c in children[node]]


class Candidates:
    """For each set of a group those that it can link with, by two bounds that hold for all links.

    Rarest first, two sets that link share one of the first n - least_common(n) + 1 n-grams of each. How many sets have
    an n-gram is known exactly within a group, so few sets share one of these even where most of their n-grams are common.
    And the n-grams that most sets have, about twice as many as a set's, are held as bits: what two sets share of them is
    counted at once for all sets, and of the others they share no more than either has. This parts near copies of one text.
    """

    def __init__(self, paths: list[np.ndarray], sizes: list[int], vocabulary: int, link: tuple[int, int]):
        # Of a set's n-grams those that no other set has come first, then its path from the end.
        self.rare = [p[min(len(p), least_common(n, link) - 1) :] for p, n in zip(paths, sizes)]
        ranks, self.owners = np.concatenate(self.rare), np.repeat(np.arange(len(paths)), [len(x) for x in self.rare])
        self.owners, self.starts = self.owners[np.argsort(ranks, kind="stable")], np.append(0, np.cumsum(np.bincount(ranks, minlength=vocabulary)))
        self.sizes, self.link = np.array(sizes), link
        held = -(-2 * sum(sizes) // (64 * len(sizes))) * 64
        bits = np.zeros((len(paths), held), bool)
        common = [p[: np.searchsorted(p, held)] for p in paths]
        bits[np.repeat(np.arange(len(paths)), [len(x) for x in common]), np.concatenate(common)] = True
        self.bits = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)  # a row for 64 n-grams
        self.others = np.array([len(p) - len(x) for p, x in zip(paths, common)])

    def of(self, i: int) -> list[int]:
        first = self.starts[self.rare[i]]
        counts = self.starts[self.rare[i] + 1] - first
        total, (a, b) = int(counts.sum()), self.link
        if total < len(self.sizes):
            at: np.ndarray | slice = np.unique(self.owners[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(total)])
        else:
            at = slice(None)
        most = np.bitwise_count(self.bits[:, at] & self.bits[:, i : i + 1]).sum(0, dtype=np.int32) + np.minimum(self.others[at], self.others[i])
        hit = np.flatnonzero((a + b) * most >= a * (self.sizes[at] + self.sizes[i]))
        found = hit if isinstance(at, slice) else at[hit]
        return found[found != i].tolist()


def join_group(sets: list[np.ndarray], link: tuple[int, int] = LINK, few: int = 64) -> list[int]:
    """For each set the least index of a set that links reach from it, itself included.

    A set is looked up in the tree unless all sets not yet looked up are connected with it. In groups of more than a few
    sets only the ways to its candidates are walked.
    """
    n = len(sets)
    forest = Forest(n)
    if n < 2:
        return list(range(n))
    grams, where, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(grams), np.int64)
    place[np.lexsort((grams, -df))] = np.arange(len(grams))
    ranks, shared = place[where], (df > 1)[where]
    ends = np.cumsum([len(s) for s in sets])
    paths = [np.sort(ranks[e - len(s) : e][shared[e - len(s) : e]]) for s, e in zip(sets, ends)]
    sizes = [len(s) for s in sets]
    tree, vocabulary = PrefixTree(paths, sizes), int((df > 1).sum())
    candidates = Candidates(paths, sizes, vocabulary, link) if n > few else None
    asked = [False] * n

    def ask(i: int) -> None:
        asked[i] = True
        if (link[0] + link[1]) * len(paths[i]) >= 2 * link[0] * least_common(sizes[i], link):
            among = candidates.of(i) if candidates else None
            for j in tree.linked(paths[i], sizes[i], vocabulary, link, among) if among != [] else ():
                forest.join(i, j)

    begun: set[int] = set()
    for i in range(n):
        if forest.root(i) == i or forest.root(i) not in begun:
            ask(i)
            begun.add(forest.root(i))
    left: dict[int, list[int]] = {}
    for i in range(n):
        if not asked[i]:
            left.setdefault(forest.root(i), []).append(i)
    for members in sorted(left.values(), key=len)[:-1]:
        for i in members:
            ask(i)
    return [forest.root(i) for i in range(n)]


def _grouped(rows: DataFrame, keys: list[str], link: tuple[int, int]) -> DataFrame:
    """(a, b): each class of a group with the least class that links reach from it there. Groups are of bounded size."""
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "sig", "grams")
    k = len(keys)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sigs, sets, seen, out = None, [], [], set(), []

        def close() -> None:
            order = sorted(range(len(sigs)), key=sigs.__getitem__)
            roots = join_group([sets[i] for i in order], link)
            out.extend((sigs[order[i]], sigs[order[r]]) for i, r in enumerate(roots))

        for batch in batches:
            for row in rows_of(batch):
                if row[:k] != key:
                    if sigs:
                        close()
                    key, sigs, sets, seen = row[:k], [], [], set()
                if row[k] not in seen:  # rows that repeat an id may repeat a class
                    seen.add(row[k])
                    sigs.append(row[k])
                    sets.append(np.frombuffer(row[k + 1], np.uint64))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if sigs:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return sorted_rows.mapInArrow(run, "a long, b long")


def _roots(sigs: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures, for each the least one that n-grams or keys connect it with, and where each of sigs is among them."""
    every, at = np.unique(sigs, return_inverse=True)
    order = np.lexsort((at, grams))
    grams, sorted_at = grams[order], at[order]
    same = np.flatnonzero(grams[1:] == grams[:-1])
    forest = Forest(len(every))
    pairs = np.unique(sorted_at[same] * len(every) + sorted_at[same + 1])
    for i in range(0, len(pairs), 10_000):
        for pair in pairs[i : i + 10_000].tolist():
            forest.join(*divmod(pair, len(every)))
    return every, every[np.array([forest.root(i) for i in range(len(every))], np.int64)], at


def _dealt(whole: DataFrame, buckets: int, order: Order, link: tuple[int, int], flush_at: int = 250_000) -> DataFrame:
    """(bucket, sigs, at, keys, a, b): keys of parts dealt to buckets, and links a to b found on the way.

    What keys connect within a block of sets is linked on the spot and goes on as one, so that at most an entry for each
    block meets for a key, however many sets have it. Of a key 48 bits go on besides its bucket, and the place of its
    set among the sigs of the row: keys that are alike by chance only make a group larger.
    """
    schema = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("at", pa.binary()), ("keys", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held_sigs, held, size = Parts(order, link), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            every, roots, at = _roots(np.repeat(np.array(held_sigs, np.int64), [len(g) for g in held]), keys)
            none = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([none(len(every), f.type) for f in list(schema)[:4]] + [pa.array(every), pa.array(roots)], schema=schema)
            owners = roots[at]
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((owners, keys, bucket))
            keys, owners, bucket = keys[by], owners[by], bucket[by]
            first = np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1]))
            keys, owners, bucket = keys[first], owners[first], bucket[first]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            rows = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                sigs, place = np.unique(owners[i:j], return_inverse=True)
                low = (keys[i:j] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((int(bucket[i]), sigs.tobytes(), place.astype("<u2" if len(sigs) <= 1 << 16 else "<u4").tobytes(), low.tobytes(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for sig, packed in rows_of(batch):
                held_sigs.append(sig)
                held.append(of.keys(np.frombuffer(packed, np.uint64)))
                size += len(held[-1])
                if size > flush_at:
                    yield from flush()
                    held_sigs, held, size = [], [], 0
        if held:
            yield from flush()

    return whole.select("sig", "grams").mapInArrow(run, "bucket int, sigs binary, at binary, keys binary, a long, b long")


def _group_edges(table: pa.Table) -> pa.Table:
    """For one bucket: each class with the least class that keys connect it with there."""
    rows, sigs = table.to_pydict(), []
    keys = [_unpack(x, 6) for x in rows["keys"]]
    for own, at, k in zip(rows["sigs"], rows["at"], keys):
        sigs.append(np.frombuffer(own, np.int64)[np.frombuffer(at, "<u2" if len(at) == 2 * len(k) else "<u4")])
    every, roots, _ = _roots(np.concatenate(sigs), np.concatenate(keys))
    return pa.table({"a": pa.array(every), "b": pa.array(roots)})


def _block_pairs(rows: DataFrame, keys: list[str], most_in_group: int) -> DataFrame:
    """Sets of groups too large for one tree, dealt to pairs of blocks (i, j): every two of a group meet in one of them."""
    cuts = F.ceil(2.0 * F.col("total") / most_in_group).cast("int")
    cut = F.pmod(F.xxhash64("sig"), cuts).cast("int")
    pairs = rows.withColumn("block", cut).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    return pairs.select(*keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", *[c for c in rows.columns if c == "grams"])


def _in_rounds(pairs: DataFrame, keys: list[str], link: tuple[int, int], moved: int, most_moved: int, sets: DataFrame | None = None) -> DataFrame:
    """(a, b): links within the groups of pairs, as many groups at once as have about most_moved of the moved n-grams.

    What a round has moved is gone when the next one begins. Where pairs has no n-grams, sets gives them.
    """
    rounds, found = max(1, -(-moved // most_moved)), []
    for k in range(rounds):
        now = pairs.where(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == k) if rounds > 1 else pairs
        if sets is not None:
            now = now.join(sets.select("sig", "grams"), "sig")
        found.append(written(_grouped(now, keys, link).where("a <> b"), "join-round"))
    return reduce(DataFrame.unionAll, found)


def _slices(rows: DataFrame, most_in_group: int) -> DataFrame:
    """(root, slice, sig, grams): the n-grams of large groups dealt to slices, each of about the size of one tree.

    Overlap and sizes of two sets add up over slices. If they link, then the overlap in some slice is as large a part
    of their sizes there: in it they link too.
    """

    def cut():
        def one(row):
            root, total, sig, packed = row
            grams = np.frombuffer(packed, np.uint64)
            of = ((_mixed(grams) >> np.uint64(32)) % np.uint64(-(-total // most_in_group))).astype(np.int64)
            grams, of = grams[(by := np.argsort(of, kind="stable"))], of[by]
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(of) != 0)), len(of)).tolist()
            return [(root, int(of[i]), sig, grams[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]

        return one

    return flat_map_rows(rows.select("root", "total", "sig", "grams"), cut, "root long, slice int, sig long, grams binary")


def _by_prefix(rows: DataFrame, order: Order, link: tuple[int, int], most_in_group: int, most_moved: int) -> DataFrame:
    """(a, b): links within groups too large for blocks of the whole group: sets meet by prefix n-gram instead.

    Two sets that link share an n-gram of their prefixes. A set is copied as often as its prefix is long, not as often
    as the group has blocks; what still is too large for one tree, of one n-gram, is cut into blocks.
    """

    def keys():
        def one(row):
            grams = order.sorted(np.frombuffer(row[2], np.uint64))
            return [(row[0], int(g), row[1], len(grams)) for g in grams[: len(grams) - least_common(len(grams), link) + 1].view(np.int64)]

        return one

    narrow = flat_map_rows(rows.select("root", "sig", "grams"), keys, "root long, gram long, sig long, n long")
    sizes = narrow.groupBy("root", "gram").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1")
    placed = written(narrow.join(sizes, ["root", "gram"]).select("root", "gram", "sig", "n", "total"), "join-prefixes")
    moved = placed.agg(F.coalesce(F.sum(F.col("n") * F.ceil(2.0 * F.col("total") / most_in_group)), F.lit(0))).first()[0]
    edges = _in_rounds(_block_pairs(placed, ["root", "gram"], most_in_group), ["root", "gram", "i", "j"], link, moved, most_moved, rows)
    dropped(placed)
    return edges


def _sieved(rows: DataFrame, left: DataFrame, ngram: int) -> DataFrame:
    """(sig, n, grams) of the rows of the classes in left, and of a few others."""
    spark = rows.sparkSession
    wanted = left.select(F.xxhash64("least").alias("id"), "sig").toArrow()
    sieves = spark.sparkContext.broadcast([Sieve(wanted[c].to_numpy()) for c in ("id", "sig")])
    del wanted
    schema = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (ids, sigs) = WordHashes(), sieves.value
        for batch in batches:
            out = []
            for (text,) in rows_of(batch.filter(pa.array(ids.has(batch["id"].to_numpy()))).select(["text"])):
                grams = shingle_set(text, hashes, ngram)
                if len(grams):
                    out.append((signature(grams), len(grams), grams.tobytes()))
            if out:
                found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                yield found.filter(pa.array(sigs.has(found["sig"].to_numpy())))

    return rows.select(F.xxhash64("doc_id").alias("id"), "text").mapInArrow(run, "sig long, n long, grams binary")


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: tuple[int, int] = LINK, ngram: int = N, most_in_group: int = 2_500_000, most_ids: int = 500_000, most_frequent: int = 300_000, most_blocks: int = 16) -> DataFrame:
    """(doc_id, n_shingles, sig, component_id) for each row; see components_of() for what the columns mean."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(_described(rows, ngram), "join-rows")
    described = found.where("n_shingles is not null").select("doc_id", "n_shingles", "sig")
    counts = found.where("gram is not null").groupBy("gram").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "gram").limit(most_frequent).collect()
    order = Order(np.array([r[0] for r in reversed(top)], np.int64).view(np.uint64))
    classes = written(described.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n")), "join-classes")
    n_grams, n_classes = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # A bucket holds 400,000 prefix n-grams, on very large inputs up to ten times as many, and a block some for each bucket.
    prefix_grams = n_grams * 0.4
    n_buckets = max(8, int(prefix_grams / min(4_000_000, max(400_000, prefix_grams / 20_000))))
    block = min(4_000_000, max(500_000, 64 * n_buckets))

    # Classes that share enough n-grams with others for a link.
    n_parts = max(12, -(-n_classes // 100_000))
    counted = _blocks(rows, n_buckets, link, ngram, order, block).groupBy("bucket").applyInArrow(lambda t: _shared_counts(t, n_parts), "part int, sigs binary, counts binary")
    met = counted.groupBy("part").applyInArrow(_summed_counts, "sig48 long, shared long")
    low48 = F.col("sig").bitwiseAND(F.lit(MASK_SIG))
    need_common = F.ceil(F.col("n") * link[0] / link[1])
    need = F.greatest(F.lit(1), F.floor(need_common * F.lit(WIDER) - 1e-9))
    left = classes.join(met, low48 == F.col("sig48")).where(F.col("shared") >= need).select("sig", "least", "n")
    left = written(left, "join-left")
    n_left = left.count()
    few = lambda df: F.broadcast(df) if n_left <= most_ids else df  # noqa: E731  for tables of at most a row for each class left

    # Their whole sets. Where the ids are few they are found by a broadcast join, else by sieves: no text is shuffled,
    # and a set that a sieve lets through by mistake is in no group.
    def sets():
        hashes = WordHashes()

        def one(row):
            grams = shingle_set(row[0], hashes, ngram)
            return [(signature(grams), len(grams), grams.tobytes())] if len(grams) else []

        return one

    if n_left <= most_ids:
        ids = left.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
        picked = rows.join(few(ids), "doc_id", "left_semi")
        if left.where("least is null").limit(1).count():  # classes that only rows with a null id have
            picked = picked.unionAll(rows.where("doc_id is null"))
        whole = flat_map_rows(picked.select("text"), sets, "sig long, n long, grams binary", 256).join(few(left.select("sig")), "sig", "left_semi")
    else:
        whole = _sieved(rows, left, ngram)
    whole = written(whole, "join-sets")
    buckets = max(12, int(left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 0.7 / 1_500_000))

    near = written(_dealt(whole, buckets, order, link, min(1_000_000, max(250_000, 2000 * buckets))), "join-keys")
    # Each block and bucket links a class to a root of its own. Most agree; only where they don't are there links
    # between roots left to follow.
    met = near.where("bucket is not null").select("bucket", "sigs", "at", "keys").groupBy("bucket").applyInArrow(_group_edges, "a long, b long")
    stars = met.unionAll(near.where("a is not null").select("a", "b")).groupBy("a").agg(F.min("b").alias("r"), F.collect_set("b").alias("bs"))
    stars = written(stars, "join-stars")
    dropped(near)
    between = components(stars.select(F.explode("bs").alias("a"), F.col("r").alias("b")).where("a <> b"))
    groups = stars.select("a", "r").join(few(between), F.col("r") == F.col("v"), "left").select(F.col("a").alias("v"), F.coalesce("root", "r").alias("root"))
    # Which group each class is in, and how large that is; the sets themselves move once, to their groups.
    of_group = groups.join(few(left.select("sig", "n")), F.col("sig") == F.col("v")).select("sig", "n", "root")
    sizes = of_group.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1")
    placed = written(of_group.join(few(sizes), "root").select("sig", "root", "total"), "join-groups")
    largest, most_by_blocks = placed.agg(F.max("total")).first()[0] or 0, max(most_in_group, most_blocks * most_in_group // 2)
    if largest > most_in_group:
        sliced = whole.join(few(placed.where(F.col("total") > most_in_group)), "sig")
        again = components(_grouped(_slices(sliced, most_in_group), ["root", "slice"], link)).join(few(left.select("sig", "n")), F.col("sig") == F.col("v")).select("sig", "n", "root")
        again = written(again, "join-again")
        sizes = again.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1")
        placed = written(placed.where(F.col("total") <= most_in_group).unionAll(again.join(few(sizes), "root").select("sig", "root", "total")), "join-groups")
        largest = placed.agg(F.max("total")).first()[0] or 0
    sized = whole.join(few(placed), "sig")
    edges = _grouped(sized.where(F.col("total") <= most_in_group), ["root"], link)
    if largest > most_in_group:
        most_moved, in_blocks = max(8 * most_in_group, n_grams // 2), (F.col("total") > most_in_group) & (F.col("total") <= most_by_blocks)
        moved = placed.where(in_blocks).select("root", "total").distinct().agg(F.coalesce(F.sum(F.col("total") * F.ceil(2.0 * F.col("total") / most_in_group)), F.lit(0))).first()[0]
        large = _in_rounds(_block_pairs(sized.where(in_blocks), ["root"], most_in_group), ["root", "i", "j"], link, moved, most_moved)
        if largest > most_by_blocks:
            large = large.unionAll(_by_prefix(sized.where(F.col("total") > most_by_blocks), order, link, most_in_group, most_moved))
        edges = edges.unionAll(components(large).select(F.col("v").alias("a"), F.col("root").alias("b")))
    roots = written(edges.where("a <> b"), "join-roots")
    named = classes.join(roots, F.col("sig") == F.col("a"), "left").select("sig", "least", F.coalesce("b", "sig").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(names, "root").select("sig", "component_id")
    dropped(whole)
    return described.join(of_class, "sig", "left").select("doc_id", "n_shingles", "sig", F.coalesce("component_id", "doc_id").alias("component_id"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: tuple[int, int] = LINK, ngram: int = N) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the set's size, and the smallest id that links reach.

    Texts of fewer than ``ngram`` words have their whole sequence as their one n-gram; null texts and those without
    words have none and link with nothing. Rows link, not ids: rows that repeat an id each have their own text. Rows
    with a null id link too but name no component; a component of null ids alone has a null component_id. Other columns
    are not read; an empty table gives an empty result.
    """
    return linked_classes(docs, id_col, text_col, link, ngram).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_ids: int = 1_000_000) -> DataFrame:
    """The rows of docs that stay when one of each component does: the one with the smallest id. Columns are kept.

    Rows without n-grams and rows with a null id stay. Rows that repeat an id stay or go together, and of those with
    the same text too one stays. The ids that go are broadcast where they are few, else joined by a shuffle.
    """
    found = components_of(docs, id_col, text_col).where("doc_id is not null")
    ids = written(found.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("n")), "join-ids")
    gone, twice = ids.where("stays = 0").select(F.col("doc_id").alias("_id")), ids.where("stays = 1 and n > 1").select(F.col("doc_id").alias("_id"))
    n_gone, n_twice = gone.count(), twice.count()
    few = lambda side, n: F.broadcast(side) if n <= most_ids else side
    kept = docs.join(few(gone, n_gone), docs[id_col] == gone["_id"], "left_anti")
    if n_twice:
        once = kept.join(few(twice, n_twice), kept[id_col] == twice["_id"], "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(few(twice, n_twice), kept[id_col] == twice["_id"], "left_anti").unionAll(once)
    return kept
