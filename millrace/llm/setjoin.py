"""N-gram Jaccard join: exact links between shingle sets and their components, with set-relation skipping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, make_room, numbered, partitions, release, slices, small, table, utf8, work_dir, written
from .components import components

#: Words of a shingle; similarity as a fraction; most sets one block of the local join holds; 64-bit words of a sketch.
SHINGLE, NUM, DEN, BLOCK, SKETCH = 5, 3, 4, 1024, 4
#: Word hashes one task remembers; entries a task sends on at once; entries a partition is made for; longest list of one task.
MAX_WORDS, CHUNK_ENTRIES, MAX_ENTRIES, LONG = 150_000, 1_500_000, 2_000_000, 4096
#: Pairs that are looked at at once.
MANY = 2_000_000

_U = np.uint64
_MULT = [_U(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1) for k in range(SHINGLE)]
#: Odd factors of the two hash orders of the bucket rounds.
_ORDERS = (_U(1), _U(0x9E3779B97F4A7C15))

_OWNER = np.dtype([("r", "<i8"), ("n", "<u4")])
#: An element and its owner's number in the low half of ``i``; the high half is 1 for an element known to be shared, _TOLD for a count in place of an element.
_ENTRY, _TOLD = np.dtype([("t", "<u8"), ("i", "<u4")]), np.uint32(2)
_SUMMED = np.dtype([("k", "<u4"), ("i", "<u4")])
_COUNTED = np.dtype([("t", "<u8"), ("d", "<u8")])
_SIGNED = np.dtype([("r", "<i8"), ("c", "<i8"), ("n", "<u4"), ("m", "<u4"), ("s", "<u8", (SKETCH,))])
#: List, place in the set's order, owner, and which block of a long list the owner is in (_ALONE: the list is not split here).
_PLACED, _ALONE = np.dtype([("t", "<u8"), ("p", "<u4"), ("i", "<u4"), ("g", "<u4")]), (1 << 32) - 1


def least_overlap(n: np.ndarray | int):
    """Fewest elements a set of ``n`` shares with any set it links to."""
    return -(-NUM * n // DEN)


def _extra(n):
    """How many of a pair's common elements the counted prefix of a set of ``n`` holds for certain."""
    return np.maximum(1, n // 4)


def least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Fewest common elements that link sets of ``n`` and ``m``."""
    return -(-NUM * (n + m) // (NUM + DEN))


class Shingler:
    """Texts to sorted 64-bit shingle hashes."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def _hash(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > MAX_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), _U, len(words))

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, _U)
        if len(words) < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U)
        h = self._hash(words)
        n = len(h) - SHINGLE + 1
        s = np.zeros(n, _U)
        for k in range(SHINGLE):
            s = (s ^ h[k : k + n]) * _MULT[k]
            s ^= s >> _U(29)
        return np.unique(s)


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one after another."""
    size = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches [a, b) of ``sizes`` that add up to MANY at most, or have one element."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, MANY + (ends[a - 1] if a else 0), side="right")))
        yield a, b
        a = b


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def block_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, which come in order of size.

    Lists of the local index hold members in order of size, so for each set only the stretch of admissible
    sizes is read and the rest of a list skipped by position. A set much like one whose overlaps are known gets
    its own from them: with d elements of X not in L and e of L not in X, overlap(X, Z) lies between
    overlap(L, Z) - e and overlap(L, Z) + d; only sets between the bounds are looked at again. Members already
    known to hang together are skipped.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(np.arange(m), n)
    keys = np.sort(ids.astype(np.int64) * m + own)
    members = keys % m
    start = np.concatenate([[0], np.cumsum(n)])
    by_set = [ids[start[i] : start[i + 1]].astype(np.int64) for i in range(m)]
    forest, out = Forest(m), []
    known: dict[int, tuple[int, np.ndarray]] = {}  # component root: a set and its overlaps

    def counts(i: int, lo: int, hi: int) -> np.ndarray:
        a, b = np.searchsorted(keys, by_set[i] * m + lo), np.searchsorted(keys, by_set[i] * m + hi)
        return np.bincount(members[_ranges(a, b)], minlength=m)

    for i in range(m):
        hi = int(np.searchsorted(n, DEN * n[i] // NUM, side="right"))
        root = forest.find(i)
        if root in known:
            lead, overlaps = known[root]
            common = int(overlaps[i])
            d, e = int(n[i]) - common, int(n[lead]) - common
            both = n[i] + n[i + 1 : hi]
            has = overlaps[i + 1 : hi]
            sure = (NUM + DEN) * np.minimum(has - e, n[i + 1 : hi]) >= NUM * both
            maybe = ~sure & ((NUM + DEN) * (has + d) >= NUM * both)
            found = (np.flatnonzero(sure) + i + 1).tolist()
            for j in (np.flatnonzero(maybe) + i + 1).tolist():
                if forest.find(i) != forest.find(j) and (NUM + DEN) * len(np.intersect1d(by_set[i], by_set[j], assume_unique=True)) >= NUM * (n[i] + n[j]):
                    found.append(j)
        else:
            lo = int(np.searchsorted(n, least_overlap(int(n[i]))))
            overlaps = counts(i, lo, m)
            known[root] = (i, overlaps)
            js = np.arange(i + 1, hi)
            found = js[(NUM + DEN) * overlaps[js] >= NUM * (n[i] + n[js])].tolist()
        for j in found:
            keep = known.get(forest.find(i)) or known.get(forest.find(j))
            if forest.join(i, j):
                out.append((i, j))
                known[forest.find(i)] = keep
    return out


def pack_by_part(parts: int, owners: np.ndarray, entries: np.ndarray, part: np.ndarray, keep: int = 0) -> pa.RecordBatch:
    """Entries as one row for each part: the owners they point to, renumbered, and the entries. ``keep``: bits of ``i`` that stay."""
    order = np.argsort(part, kind="stable")
    entries, part = entries[order], part[order]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    ids, own, ent = [], [], []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        e = entries[a:b].copy()
        used, i = np.unique(e["i"] & ~np.uint32(keep), return_inverse=True)
        e["i"] = i.astype(np.uint32) | e["i"] & np.uint32(keep)
        ids.append(int(part[a]))
        own.append(owners[used].tobytes())
        ent.append(e.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(own, pa.binary()), pa.array(ent, pa.binary())], names=["part", "own", "ent"])


def unpack(batches: Iterator[pa.RecordBatch], owner: np.dtype, entry: np.dtype, low: int = 0xFFFFFFFF) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a partition, and the owner of each; ``low``: bits of ``i`` that number the owner."""
    owners, entries = [], []
    for batch in batches:
        for o, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            e = np.frombuffer(e, entry)
            entries.append(e)
            owners.append(np.frombuffer(o, owner)[e["i"] & np.uint32(low)])
    if not entries:
        return np.zeros(0, owner), np.zeros(0, entry)
    return np.concatenate(owners), np.concatenate(entries)


_PACKED = "part int, own binary, ent binary"


def _dealt(df: DataFrame, parts: int, fn: Callable, schema: str) -> DataFrame:
    return df.repartitionById(parts, "part").mapInArrow(fn, schema)


def _part_of(t: np.ndarray, parts: int) -> np.ndarray:
    return ((t * _U(0xC2B2AE3D27D4EB4F)) >> _U(33)) % _U(parts)


def _runs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values in sorted ``t``."""
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(t)))


def _prefix(n):
    """How many elements of a set of ``n``, in hash order, are counted."""
    return np.minimum(n, n - least_overlap(n) + _extra(least_overlap(n)))


#: The same for SQL, over a column n.
_PREFIX_SQL = "least(n, n - (3 * n + 3) div 4 + greatest(1, ((3 * n + 3) div 4) div 4))"


def parts_for(spark, entries: int) -> int:
    """Partitions of at most MAX_ENTRIES entries on average, and no fewer than the session shuffles to."""
    return max(partitions(spark), -(-entries // MAX_ENTRIES))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, n, the set's 128-bit key (k1, k2) and ``pre``, the elements of its hash-ordered prefix."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t"))

    def run(batches):
        make_room()
        shingle = Shingler()
        for batch in slices(batches):
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()), pa.array([s[: int(_prefix(len(s)))].tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ], names=["id", "n", "k1", "k2", "pre"],
            )

    return src.mapInArrow(run, "id bigint, n int, k1 bigint, k2 bigint, pre binary")


def _partnered(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (k1): the sets whose hash-ordered prefix shares so many elements with other sets' that they may link.

    A task counts first what its own sets share with each other: of an element that several of them have, it sends on
    one entry, marked as shared, and the sets' counts, so that a frequent element costs its own task one entry from
    each sender. Equal sets of one chunk count once. A set met by two senders may be counted twice, which lets more
    sets pass, never fewer. Counts go from the elements' tasks to the sets' as packed columns.
    """

    def packed(some: dict[int, tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        own = np.array([(k, n) for k, (n, _) in some.items()], _OWNER)
        sets = [np.frombuffer(b, _U) for _, b in some.values()]
        t, i = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(t, kind="stable")
        t, i = t[order], i[order]
        first, size = _runs(t)
        shared = np.repeat(size, size) >= 2
        told = np.bincount(i[shared], minlength=len(sets))
        sent = ~shared
        sent[first] = True
        mark = shared[sent].astype(np.uint32)
        ent = np.zeros(int(sent.sum()) + int((told > 0).sum()), _ENTRY)
        k = len(mark)
        ent["t"][:k], ent["i"][:k] = t[sent], i[sent] | mark << np.uint32(16)
        ent["i"][k:] = np.flatnonzero(told) | _TOLD << np.uint32(16)
        ent["t"][k:] = told[told > 0]
        part = _part_of(ent["t"], parts)
        part[k:] = _part_of(own["r"].view(_U), parts)[told > 0]
        yield pack_by_part(parts, own, ent, part, keep=0xFFFF0000)

    def emit(batches):
        make_room()
        some, held = {}, 0
        for batch in batches:
            for k1, n, pre in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if n and k1 not in some:
                    some[k1] = (n, pre)
                    held += len(pre) >> 3
                    if held >= CHUNK_ENTRIES or len(some) == 1 << 16:
                        yield from packed(some)
                        some, held = {}, 0
        if some:
            yield from packed(some)

    def count(batches):
        own, ent = unpack(batches, _OWNER, _ENTRY, 0xFFFF)
        kind = ent["i"] >> np.uint32(16)
        ready = kind == _TOLD
        t, k, n, mark = ent["t"][~ready], own["r"][~ready], own["n"][~ready], kind[~ready] == 1
        order = np.lexsort((~mark, k, t))
        t, k, n, mark = t[order], k[order], n[order], mark[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]) if len(t) else np.zeros(0, bool)
        t, k, n, mark = t[new], k[new], n[new], mark[new]
        first, size = _runs(t)
        counts = (np.repeat(size, size) >= 2) & ~mark
        if len(first):
            counts |= np.repeat(np.logical_or.reduceat(mark, first), size) & ~mark
        k, n, c = np.concatenate([k[counts], own["r"][ready]]), np.concatenate([n[counts], own["n"][ready]]), np.concatenate([np.ones(int(counts.sum()), np.int64), ent["t"][ready].astype(np.int64)])
        if len(k):
            keys, first, which = np.unique(k, return_index=True, return_inverse=True)
            owners = np.zeros(len(keys), _OWNER)
            owners["r"], owners["n"] = keys, n[first]
            out = np.zeros(len(keys), _SUMMED)
            out["k"], out["i"] = np.bincount(which, weights=c), np.arange(len(keys))
            yield pack_by_part(parts, owners, out, _part_of(keys.view(_U), parts))

    def total(batches):
        own, ent = unpack(batches, _OWNER, _SUMMED)
        order = np.argsort(own["r"], kind="stable")
        own, k = own[order], ent["k"][order].astype(np.int64)
        first, _ = _runs(own["r"])
        if len(first):
            need = _extra(least_overlap(own["n"][first].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(own["r"][first][np.add.reduceat(k, first) >= need])], names=["k1"])

    rows = _dealt(rows.select("k1", "n", "pre").mapInArrow(emit, _PACKED), parts, count, _PACKED)
    return _dealt(rows, parts, total, "k1 bigint")


def _bucket_links(sets: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) among sets that meet in a bucket: sound, and most of all that there are.

    A bucket is the least element of a set under one of two hash orders. Buckets are dealt by range of (bucket,
    size, id), so a large bucket spreads over tasks; each task joins blocks of at most BLOCK sets and carries one
    set of each component into the bucket's next block, as long as half a block stays free for new ones: the largest
    sets, which alone can link to what follows. This pass only gathers copies; the lists find what it leaves out.
    """

    def emit(batches):
        for batch in batches:
            rows = []
            for r, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(b, _U)
                rows += [(int((s * m).min().view(np.int64)) ^ k, len(s), r, b) for k, m in enumerate(_ORDERS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "n", "r", "s"])

    def join(batches):
        held, bucket, out = [], None, []

        def close() -> list:
            """Joins the block; one set of each component goes on."""
            links = block_links([s for _, s in held]) if len(held) > 1 else []
            out.extend((held[i][0], held[j][0]) for i, j in links)
            led = {j for _, j in links}
            return [x for k, x in enumerate(held) if k not in led][-max(1, BLOCK // 2) :]

        for batch in batches:
            for b, r, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != bucket:
                    close()
                    held, bucket = [], b
                elif len(held) >= max(2, BLOCK):
                    held = close()
                held.append((r, np.frombuffer(s, _U)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    rows = sets.select("r", "s").mapInArrow(emit, "bucket bigint, n int, r bigint, s binary")
    keys = ["bucket", "n", "r"]
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(join, "a bigint, b bigint").distinct()


def skip_pairs(t: np.ndarray, c: np.ndarray, n: np.ndarray, p: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of entries of one list that may link, in portions; entries come in order of (t, n, c, p).

    A list is cut into blocks of one size and one component, in order of place. Against a block of larger sets only
    the sizes up to 4/3 are read; blocks of the same component are skipped; and as sets of sizes n and m need
    ceil(3 (n + m) / 7) common elements, of both blocks only the first stretch is read: an entry at a later place has
    too few elements left, and so has every entry after it.
    """
    if not len(t):
        return
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (c[1:] != c[:-1])])
    start = np.flatnonzero(new)
    block = np.cumsum(new) - 1
    bt, bn, bc = np.unique(t, return_inverse=True)[1][start].astype(np.int64), n[start].astype(np.int64), c[start]
    by_place = block.astype(np.int64) << 32 | p
    last = np.searchsorted(bt << 32 | bn, bt << 32 | DEN * bn // NUM, side="right")
    for lo, hi in _portions(last - np.arange(len(start)) - 1):
        x, y = np.repeat(np.arange(lo, hi), last[lo:hi] - np.arange(lo, hi) - 1), _ranges(np.arange(lo, hi) + 1, last[lo:hi])
        apart = bc[x] != bc[y]
        x, y = x[apart], y[apart]
        need = least_common(bn[x], bn[y])
        kx = np.searchsorted(by_place, (x << 32) + np.maximum(bn[x] - need, -1), side="right") - start[x]
        ky = np.searchsorted(by_place, (y << 32) + np.maximum(bn[y] - need, -1), side="right") - start[y]
        some = (kx > 0) & (ky > 0)
        x, y, kx, ky = start[x[some]], start[y[some]], kx[some], ky[some]
        for u, v in _portions(kx):  # a row for each entry of the x side, with the stretch of y that it meets
            ex, ey, ek = _ranges(x[u:v], x[u:v] + kx[u:v]), np.repeat(y[u:v], kx[u:v]), np.repeat(ky[u:v], kx[u:v])
            for k, m in _portions(ek):
                i, j = np.repeat(ex[k:m], ek[k:m]), _ranges(ey[k:m], ey[k:m] + ek[k:m])
                ok = (g[i] == _ALONE) | (g[i] != g[j])
                yield i[ok], j[ok]


def _candidates(sets: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, ca, na, b, cb, nb) of sets in different components that may link: all of them, by skipping lists.

    Elements are ordered by how many sets have them, rarest first. Two sets that link share one of the first
    n - ceil(3n/4) + 1 elements of each; elements that no other set has come first and join nothing. How many sets
    have an element is summed from one count a task. Each list is joined by :func:`skip_pairs`; pairs that pass are
    held against the exact bound that sketches of the shared elements give on the overlap. A list of more than LONG
    sets is dealt in blocks, each pair of blocks a list of its own.
    """
    dealt = sets.select("r", "c", "s", F.pmod(F.xxhash64("r"), F.lit(parts)).cast("int").alias("part"))

    def tell(batches):
        make_room()
        by_part: dict[int, list[bytes]] = {}
        for batch in batches:
            for s, part in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                by_part.setdefault(part, []).append(s)
        for part, some in by_part.items():
            t, d = np.unique(np.frombuffer(b"".join(some), _U), return_counts=True)
            ent = np.empty(len(t), _COUNTED)
            ent["t"], ent["d"] = t, d
            to = _part_of(t, parts)
            order = np.argsort(to, kind="stable")
            ent, to = ent[order], to[order]
            first, size = _runs(to)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[first].astype(np.int32)), pa.array([part] * len(first), pa.int32()), pa.array([ent[a : a + k].tobytes() for a, k in zip(first.tolist(), size.tolist(), strict=True)], pa.binary())],
                names=["part", "back", "ent"],
            )

    def answer(batches):
        back, ents = [], []
        for batch in batches:
            back += batch.column(1).to_pylist()
            ents += [np.frombuffer(e, _COUNTED) for e in batch.column(2).to_pylist()]
        if not ents:
            return
        every = np.concatenate(ents)
        t, which = np.unique(every["t"], return_inverse=True)
        d = np.bincount(which, weights=every["d"]).astype(np.uint64)
        ends = np.cumsum([0, *map(len, ents)])
        out = []
        for k, e in enumerate(ents):
            own = d[which[ends[k] : ends[k + 1]]]
            e = e[own >= 2].copy()
            e["d"] = own[own >= 2]
            out.append(e.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(back, pa.int32()), pa.array(out, pa.binary())], names=["part", "ent"])

    def sign(batches):
        """Entries of each set's first elements, from the partition's sets and what its elements' tasks have answered."""
        r, c, s, told = [], [], [], []
        for batch in batches:
            for x in batch.to_pylist():
                if x["ent"] is not None:
                    told.append(np.frombuffer(x["ent"], _COUNTED))
                else:
                    r.append(x["r"])
                    c.append(x["c"])
                    s.append(np.frombuffer(x["s"], _U))
        told = np.concatenate(told) if told else np.zeros(0, _COUNTED)
        if not r or not len(told):
            return
        order = np.argsort(told["t"], kind="stable")
        known, counts = told["t"][order], told["d"][order]
        n = np.array([len(x) for x in s], np.int64)
        t, which = np.concatenate(s), np.repeat(np.arange(len(s)), n)
        at = np.minimum(np.searchsorted(known, t), len(known) - 1)
        shared = known[at] == t
        t, which, d = t[shared], which[shared], counts[at[shared]]
        order = np.lexsort((t, d, which))
        t, which, d = t[order], which[order], d[order]
        m = np.bincount(which, minlength=len(s))
        owners = np.zeros(len(s), _SIGNED)
        owners["r"], owners["c"], owners["n"], owners["m"] = r, c, n, m
        bit = t >> _U(20)
        np.bitwise_xor.at(owners["s"], (which, (bit >> _U(6)) % _U(SKETCH)), _U(1) << (bit & _U(63)))
        rank = np.arange(len(t)) - np.concatenate([[0], np.cumsum(m)[:-1]])[which]
        kept = rank < (m - least_overlap(n) + 1)[which]
        t, which, d, p = t[kept], which[kept], d[kept], (rank + (n - m)[which])[kept]
        blocks = (d.astype(np.int64) + LONG - 1) // LONG  # 1 for an ordinary list
        x = np.repeat(np.arange(len(t)), blocks)
        other = _ranges(np.zeros(len(t), np.int64), blocks)
        mine = (_part_of(owners["r"].view(_U), 1 << 30)[which] % np.maximum(blocks, 1).astype(_U)).astype(np.int64)[x]
        lo, hi = np.minimum(mine, other).astype(_U), np.maximum(mine, other).astype(_U)
        out = np.empty(len(x), _PLACED)
        out["t"] = np.where(blocks[x] > 1, (t[x] ^ (lo << _U(32) | hi)) * _MULT[1], t[x])
        out["p"], out["i"], out["g"] = p[x], which[x], np.where(lo == hi, _ALONE, mine)
        for a in range(0, len(out), MANY):
            yield pack_by_part(parts, owners, out[a : a + MANY], _part_of(out["t"][a : a + MANY], parts))

    def pair(batches):
        own, ent = unpack(batches, _SIGNED, _PLACED)
        order = np.lexsort((ent["p"], own["c"], own["n"], ent["t"]))
        own, ent = own[order], ent[order]
        found, held = [], 0
        for x, y in skip_pairs(ent["t"], own["c"], own["n"], ent["p"], ent["g"]):
            a, b = own[x], own[y]
            apart = np.bitwise_count(a["s"] ^ b["s"]).sum(1).astype(np.int64)
            most = (a["m"].astype(np.int64) + b["m"] - apart) // 2
            ok = most >= least_common(a["n"].astype(np.int64), b["n"].astype(np.int64))
            a, b = a[ok], b[ok]
            turn = a["r"] > b["r"]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            found.append(np.stack([a["r"], a["c"], a["n"].astype(np.int64), b["r"], b["c"], b["n"].astype(np.int64)], 1))
            held += len(a)
            if held > 500_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                if len(found[0]) > 250_000:
                    yield pairs_of(found[0])
                    found = []
                held = sum(map(len, found))
        if found:
            yield pairs_of(np.unique(np.concatenate(found), axis=0))

    names = ["a", "ca", "na", "b", "cb", "nb"]

    def pairs_of(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(6)], names=names)

    counts = _dealt(dealt, parts, tell, "part int, back int, ent binary")
    counts = _dealt(counts, parts, answer, "part int, ent binary")
    both = dealt.withColumn("ent", F.lit(None).cast("binary")).unionByName(counts, allowMissingColumns=True)
    rows = _dealt(both, parts, sign, _PACKED)
    return _dealt(rows, parts, pair, ", ".join(f"{n} bigint" for n in names)).distinct()


def _overlaps(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the number ``o`` of elements that the sets named in columns ``a`` and ``b`` have in common."""

    names = pairs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index
            o = [len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True)) for x, y in zip(batch.column(at("sx")).to_pylist(), batch.column(at("sy")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in names), pa.array(o, pa.int64())], names=[*names, "o"])

    left, right = sets.select(F.col("r").alias("rx"), F.col("s").alias("sx")), sets.select(F.col("r").alias("ry"), F.col("s").alias("sy"))
    both = pairs.join(left, F.col(a) == F.col("rx")).join(right, F.col(b) == F.col("ry")).select(*names, "sx", "sy")
    return both.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("o", T.LongType())]))


def _answers(pairs: DataFrame, named: DataFrame, folder: str) -> DataFrame:
    """Links (ca, cb) between components, from pairs of sets that may link.

    The first set of a component, its lead, gets its answers by comparison. A set's own answers are derived from its
    lead's: with d elements that the lead lacks and e of the lead's missing, its overlap with a set of another
    component lies between the leads' overlap less both e and the same with both d added. Only pairs between the
    bounds are compared, and only while their components are not linked.
    """
    enough = lambda o: F.expr(f"{NUM + DEN} * ({o}) >= {NUM} * (na + nb)")
    leads = pairs.select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).distinct()
    sizes = named.select("r", F.expr("octet_length(s) div 8").alias("n"))
    known = _overlaps(leads, named, "x", "y").join(sizes.toDF("x", "na"), "x").join(sizes.toDF("y", "nb"), "y")
    known = written(known.select("x", "y", "o", enough("o").alias("linked")), f"{folder}/leads")
    apart = named.where("r != c AND more").select("r", "c")
    apart = _overlaps(apart, named, "r", "c").join(sizes, "r").join(sizes.toDF("c", "nc"), "c")
    apart = written(apart.select("r", F.expr("n - o").alias("d"), F.expr("nc - o").alias("e")), f"{folder}/apart")
    rest = pairs.where("a != ca OR b != cb").withColumns({"x": F.least("ca", "cb"), "y": F.greatest("ca", "cb")})
    rest = rest.join(small(known.where("NOT linked").drop("linked"), 3), ["x", "y"])
    for r, k in (("a", "1"), ("b", "2")):
        rest = rest.join(small(apart, 3).toDF(f"r{k}", f"d{k}", f"e{k}"), F.col(r) == F.col(f"r{k}"), "left").fillna(0, [f"d{k}", f"e{k}"])
    rest = rest.withColumn("sure", enough("o - e1 - e2")).where(enough("o + d1 + d2")).select("a", "b", "na", "nb", "x", "y", "sure")
    rest = written(rest, f"{folder}/rest")
    sure = rest.where("sure").select("x", "y").distinct()
    unsure = rest.where("NOT sure").drop("sure").join(sure, ["x", "y"], "left_anti")
    links = known.where("linked").select("x", "y").unionByName(sure).unionByName(_overlaps(unsure, named, "a", "b").where(enough("o")).select("x", "y"))
    return written(links.toDF("ca", "cb").distinct(), f"{folder}/links")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable by links, its own included).

    A document's set is its distinct five-word shingles, words lower-cased in A-Z and cut at ASCII white space;
    with fewer words the whole sequence; two sets link at a Jaccard similarity of 0.75 or more. Null and empty
    texts have no set and link to nothing. Ids are integers; rows that repeat an id are one document with several
    sets; rows without an id have no component unless their set has an id elsewhere. Equal sets are one class, of
    which the smallest id stands for all. Shingles are compared by 64-bit hash. Sets go through the join by their key
    (column r), not by an id; sets of one document are linked at the end.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark)
    docs, (id_, text) = numbered(docs, id_col, text_col)
    rows = written(shingle_sets(docs, id_, text), f"{folder}/rows")
    classes = written(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("r"), F.first("n").alias("n")), f"{folder}/classes")

    partnered = _partnered(rows, parts_for(spark, rows.agg(F.sum(F.expr(_PREFIX_SQL))).first()[0] or 0)).distinct()
    alive = written(classes.where("r IS NOT NULL").join(partnered, "k1").select("r", "k1", "k2"), f"{folder}/alive")
    release(spark)

    def sets_of(batches):
        make_room()
        shingle = Shingler()
        for batch in slices(batches):
            out = []
            for t, k1, k2 in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = shingle(t)
                if set_key(s) == (k1, k2):
                    out.append((k1, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["r", "s"])

    texts = docs.select(F.col(id_).cast("long").alias("r"), utf8(text).alias("t")).join(small(alive, 3), "r")
    sets = written(texts.select("t", "k1", "k2").mapInArrow(sets_of, "r bigint, s binary"), f"{folder}/sets")
    release(spark)

    parts = parts_for(spark, sets.agg(F.sum(F.expr("octet_length(s) div 8"))).first()[0] or 0)
    near = components(_bucket_links(sets, parts), f"{folder}/near")
    named = sets.dropDuplicates(["r"]).join(near, F.col("r") == F.col("node"), "left")
    named = written(named.select("r", "s", F.coalesce("component", "r").alias("c"), F.col("node").isNotNull().alias("more")), f"{folder}/named")
    pairs = written(_candidates(named, parts), f"{folder}/pairs")
    release(spark)
    ends = _answers(pairs, named, folder)
    own = named.select("r", "c")
    ids = rows.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a != b")
    ids = rows.where("n > 0").join(written(ids.select("id", "a"), f"{folder}/several"), "id").where("a != k1").select("a", F.col("k1").alias("b"))
    same = written(ids.distinct(), f"{folder}/same")  # sets of one document
    own = written(own.unionByName(same.select(F.explode(F.array("a", "b")).alias("r")).distinct().join(own, "r", "left_anti").withColumn("c", F.col("r"))), f"{folder}/own")
    ends = ends.unionByName(same.join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b").select("ca", "cb"))
    far = components(ends, f"{folder}/far", "ca", "cb")
    final = own.join(far, own.c == far.node, "left").select(F.col("r").alias("k1"), F.coalesce("component", "c").alias("g"))
    final = written(classes.join(final, "k1").select("k1", "g", F.col("r").alias("least")), f"{folder}/final")
    discard(spark, folder, "alive", "sets", "near", "named", "pairs", "leads", "apart", "rest", "links", "several", "same", "own", "far")
    least = final.groupBy("g").agg(F.min("least").alias("component"))
    final = classes.join(final.join(least, "g").select("k1", "component").distinct(), "k1", "left").select("k1", "k2", F.coalesce("component", "r").alias("component"))
    return (
        rows.select("id", "n", "k1", "k2").join(final, ["k1", "k2"], "left")
        .select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
        .toDF(id_col, "n_shingles", "component_id")
    )


def op2(spark, sf_dir):
    return similar_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END)) r(i)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
c AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x)
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, MIN(y) AS component_id FROM c GROUP BY x) m USING (doc_id)
"""
