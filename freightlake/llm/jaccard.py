"""Op 7, n-gram Jaccard join by universe partition and pigeonhole.

A document's distinct shingles are hashed into segments, as many as its band of sizes needs: two sets that
may link differ in H shingles at most, so among segments whose thresholds (0: equal, 1: one deletion apart)
plus one sum to more than H, some segment is within its threshold. The larger set of a pair indexes the part
of it in each segment, and in bands of small sets their one-deletion neighbourhoods too; the smaller one
probes only the segments that suffice at least cost, by how often their signatures came up. Empty segments
are left to sets that have no other choice.

Sets that meet under a signature are compared by parity bitmaps first: what two bitmaps differ in is never more
than what their sets differ in. Nothing but a spanning forest of what passes leaves a group. Its components
are cells; each cell's texts meet once and are verified exactly, and again only a spanning forest of links
leaves a cell. So neither step emits pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, bytes_array, column, cut, give_back, list_array, mix, named, private, ragged, span_hashes, steps, table
from .components import connected_components

SHINGLE = 5
#: Each band of set sizes is so many times as wide as the one before.
BAND = 1.5
#: Bands of sets up to this size have half as many segments and index one-deletion neighbourhoods.
SMALL = 96
#: Segments beyond those needed, as a share, in the other bands: room to leave out costly ones.
SPARE = 0.25
#: Documents to a bucket of signatures, and the fewest buckets; members of groups to a bucket of groups.
ROWS_TOGETHER, LEAST_BUCKETS, MEMBERS_TOGETHER = 4000, 64, 20_000
#: A larger group or cell is split into parts of this size, and each two parts meet in a task of their own.
GROUP_PART, CELL_PART = 8192, 512
#: Bytes of text that are signed together.
SIGN_BYTES = 2 << 20
PROBES, INDEXED = 1, 2
#: Sets at most that share a number with an unlike one.
MOST_MOVED, _MASK = 100_000, (1 << 64) - 1
_SALT = np.uint64(0xA0761D6478BD642F)
_DELETED = np.uint64(0xE7037ED1A0B428DB)
_PARITY = np.uint64(0x8EBC6AF09C88C6E3)


def shingle_sets(words: Words, size: int = SHINGLE, second: bool = False) -> tuple[np.ndarray, ...]:
    """The distinct shingle hashes of all texts, where each text's begin and end among them, and second hashes of them."""
    bounds = words.bounds
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(n)), n)
    first = ragged(bounds[:-1], n)
    last = first + np.minimum(size, counts[text])
    shingles = span_hashes(words.hashes(), first, last)
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    out = shingles[new], np.searchsorted(text[new], np.arange(len(n) + 1))
    return (*out, span_hashes(words.hashes(second=True), first, last, second=True)[order][new]) if second else out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def node_ids(shingles: np.ndarray, bounds: np.ndarray, bits: int = 64) -> np.ndarray:
    """A number of 64 bits (or fewer) for each set, equal for equal sets."""
    return (mix(_sums(mix(shingles ^ _SALT), bounds) + np.diff(bounds).astype(np.uint64)) >> np.uint64(64 - bits)).view(np.int64)


def renumbered(nodes: np.ndarray, others: np.ndarray, moved: dict[tuple[int, int], int]) -> np.ndarray:
    """The sets' numbers, where unlike sets of one number are told apart by their second numbers."""
    out = nodes.copy()
    for at in np.flatnonzero(np.isin(nodes, [node for node, _ in moved])):
        out[at] = moved.get((int(nodes[at]), int(others[at])), nodes[at])
    return out


def parity_width(n: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmaps of sets of n shingles: a power of 2, two bits for each shingle at least; none for no shingles."""
    return np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(n / 32, 4))).astype(np.int64), 0)


def parities(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sets' bitmaps as bytes, and each one's length: bit b tells whether the shingles hashed to b are odd in number.

    Where two bitmaps differ there is a shingle that one set has alone, and each such shingle makes one difference at most.
    """
    size = np.diff(bounds)
    width = parity_width(size)
    begin = np.cumsum(width) - width
    bits = np.repeat(width * 64, size).astype(np.uint64)
    place = np.repeat(begin * 64, size) + (mix(shingles ^ _PARITY) & (bits - np.uint64(1))).astype(np.int64)
    odd = np.bincount(place, minlength=int(width.sum()) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little"), width * 8


def most_apart(a, percent: int):
    """How many shingles a set of size a and one as large or larger that it links with can differ in."""
    return (100 - percent) * (a + a * 100 // percent) // (100 + percent)


@lru_cache
def bands(percent: int, top: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each band's least size, number of segments, and whether it indexes one-deletion neighbourhoods."""
    low = [1]
    while low[-1] < top:
        low.append(max(low[-1] + 1, int(low[-1] * BAND)))
    low = np.array(low)
    need = most_apart(low[1:] - 1, percent) + 1
    small = low[1:] <= SMALL
    # with so few segments, one more makes it a tenth as likely that too few of them hold shingles
    return low, np.where(small, need // 2 + 1 + (need > 2) * (need < 5), need + np.ceil(SPARE * need).astype(np.int64)), small


def allocate(cost0: list[float], cost1: list[float], need: int) -> list[int]:
    """Thresholds -1 (left out), 0 or 1 for each segment, of least cost, with thresholds plus one summing to need."""
    inf = float("inf")
    best = [0.0] + [inf] * need
    choice = []
    for c0, c1 in zip(cost0, cost1, strict=True):
        now, took = best[:], [-1] * (need + 1)
        for units in range(1, need + 1):
            for t, c in ((0, c0), (1, c1)):
                got = best[max(0, units - t - 1)] + c
                if got < now[units]:
                    now[units], took[units] = got, t
        best = now
        choice.append(took)
    units, out = need, []
    for took in reversed(choice):
        t = took[units]
        out.append(t)
        units = max(0, units - t - 1)
    return out[::-1]


class Signatures:
    """Signatures of sets: (signature, place of the set, PROBES or INDEXED or both)."""

    #: Costs of evidence that is none: an empty segment, and one that a deletion empties.
    EMPTY, EMPTIED = 1e9, 1e8

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.m, self.small = bands(percent)
        self.seen = np.zeros(1 << 21, np.int32)  # how often signatures were indexed in this task: what probing them costs

    def _slots(self, sig: np.ndarray) -> np.ndarray:
        return (sig & np.uint64(len(self.seen) - 1)).astype(np.int64)

    def of(self, shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.diff(bounds)
        own = np.searchsorted(self.low, size, "right") - 1
        least = np.searchsorted(self.low, -(-size * self.percent // 100), "right") - 1
        out = []
        for down in range(int((own - least).max(initial=0)), -1, -1):
            picked = np.flatnonzero((size > 0) & (own - down >= least))
            if len(picked):
                out += self._band(shingles, bounds, picked, own[picked] - down, down == 0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def _band(self, shingles, bounds, picked, band, probes: bool):
        size, m = np.diff(bounds)[picked], self.m[band]
        begin = np.cumsum(m) - m
        token = ragged(bounds[:-1][picked], size)
        which = np.repeat(np.arange(len(picked)), size)
        h = mix(shingles[token] + band[which].astype(np.uint64) * _SALT)
        at = begin[which] + (h % m[which].astype(np.uint64)).astype(np.int64)
        total, n = np.zeros(int(m.sum()), np.uint64), np.bincount(at, minlength=int(m.sum()))
        values = mix(h)
        np.add.at(total, at, values)
        owner = np.repeat(np.arange(len(picked)), m)
        name = (band[owner].astype(np.uint64) << np.uint64(32) | (np.arange(len(owner)) - begin[owner]).astype(np.uint64)) * _SALT
        full = lambda s, k, c: mix(s + name[k] + c.astype(np.uint64) * _DELETED)
        sig = full(total, np.arange(len(owner)), n)
        small = self.small[band]
        role = np.full(len(sig), INDEXED, np.uint8)
        t = np.flatnonzero(small[which])
        smaller = full(total[at[t]] - values[t], at[t], n[at[t]] - 1)  # a segment less one shingle
        neighbours = mix(smaller ^ _DELETED)
        np.add.at(self.seen, self._slots(sig), 1)
        np.add.at(self.seen, self._slots(neighbours), 1)
        out = [(neighbours, picked[which[t]], np.full(len(t), INDEXED, np.uint8))]
        if probes:
            need = most_apart(size, self.percent) + 1
            cost = self.seen[self._slots(sig)] + 4.0 * 0.5 ** np.minimum(n, 60) + np.where(n == 0, self.EMPTY, 0)
            order = np.lexsort((cost, owner))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - begin[owner[order]]
            role[(rank < need[owner]) & ~small[owner]] |= PROBES
            if small.any():
                as_neighbour = mix(sig ^ _DELETED)
                deletions = np.bincount(at[t], weights=self.seen[self._slots(smaller)], minlength=len(sig))
                cost1 = cost + self.seen[self._slots(as_neighbour)] + deletions + n + np.where(n < 2, self.EMPTIED, 0)
                one = np.zeros(len(sig), bool)
                for i in np.flatnonzero(small):
                    own = slice(begin[i], begin[i] + m[i])
                    thresholds = np.array(allocate(cost[own].tolist(), cost1[own].tolist(), int(need[i])))
                    role[own][thresholds >= 0] |= PROBES
                    one[own] = thresholds == 1
                of_one = one[at[t]]
                out.append((smaller[of_one], picked[which[t[of_one]]], np.full(int(of_one.sum()), PROBES, np.uint8)))
                out.append((as_neighbour[one], picked[owner[one]], np.full(int(one.sum()), PROBES, np.uint8)))
        out.append((sig, picked[owner], role))
        return out


def _sketch(bits: int):
    """A row for each text: its set's size, number, a second number of other hashes, and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            shingles, bounds, second = shingle_sets(Words(data, offsets, lower=True), second=True)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "rid"), pa.array(np.diff(bounds), pa.int64()), pa.array(node_ids(shingles, bounds, bits)), pa.array(node_ids(second, bounds)), bytes_array(*parities(shingles, bounds))],
                names=["doc_id", "rid", "n", "node", "other", "bits"],
            )

    return run


def _sign(percent: int, buckets: int, moved: dict[tuple[int, int], int], bits: int):
    """Signatures, packed by bucket: (bucket, sigs, times, nodes), each node once with how many signatures follow for it.

    The lowest two bits of a signature are its role.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(percent)
        for _, data, offsets in steps(batches, step_bytes=SIGN_BYTES):
            shingles, bounds = shingle_sets(Words(data, offsets, lower=True))
            nodes = node_ids(shingles, bounds, bits)
            if moved and np.isin(nodes, [node for node, _ in moved]).any():
                _, _, second = shingle_sets(Words(data, offsets, lower=True), second=True)
                nodes = renumbered(nodes, node_ids(second, bounds), moved)
            _, once = np.unique(nodes, return_index=True)  # equal sets sign once
            size = np.diff(bounds)[once]
            inner = ragged(bounds[:-1][once], size)
            sig, place, role = signatures.of(shingles[inner], np.concatenate([[0], np.cumsum(size)]))
            bucket = (sig % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((place, bucket))
            bucket, place = bucket[order], place[order]
            short = ((sig >> np.uint64(32)) & np.uint64(0xFFFFFFFC) | role).astype(np.uint32).view(np.int32)[order]
            first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (place[1:] != place[:-1])])) if len(order) else np.zeros(0, np.int64)
            present, counts = np.unique(bucket, return_counts=True)
            sets = np.unique(bucket[first], return_counts=True)[1]
            times = np.diff(np.append(first, len(order))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(present), list_array(short, counts, pa.int32()), list_array(times, sets, pa.int32()), list_array(nodes[once][place[first]], sets, pa.int64())], names=["bucket", "sigs", "times", "nodes"])

    return run


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def _meet(rows: pa.Table) -> pa.Table:
    """The groups of one bucket in which some set probes what another indexes: (gid, size, node, role), a row for each member.

    Of groups with the same members one stays.
    """
    sig = rows["sigs"].combine_chunks().flatten().to_numpy().view(np.uint32)
    node = np.repeat(*(rows[k].combine_chunks().flatten().to_numpy() for k in ("nodes", "times")))
    role, sig = (sig & 3).astype(np.uint8), sig >> 2
    order = np.lexsort((node, sig))
    sig, node, role = sig[order], node[order], role[order]
    first = _starts(sig, node)
    sig, node, role = sig[first], node[first], np.bitwise_or.reduceat(role, first) if len(first) else role
    begins = _starts(sig)
    counts = np.diff(np.append(begins, len(sig)))
    some = lambda bit: np.add.reduceat((role & bit > 0).astype(np.int64), begins) > 0 if len(begins) else np.zeros(0, bool)
    live = (counts > 1) & some(PROBES) & some(INDEXED)
    begins, counts = begins[live], counts[live]
    members = mix(_sums(mix(node.view(np.uint64)), np.append(0, np.arange(1, len(node) + 1)))) if len(node) else np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(members)])
    same = total[begins + counts] - total[begins] + counts.astype(np.uint64)
    _, kept, times = np.unique(same, return_index=True, return_counts=True)
    begins, counts = begins[kept], counts[kept]
    at = ragged(begins, counts)
    many = np.repeat(times > 1, counts)
    give_back()
    gid = np.int64(rows["bucket"][0].as_py()) << 30 | sig[at].astype(np.int64)
    return pa.table({"gid": gid, "size": np.repeat(counts, counts), "node": node[at], "role": np.where(many, PROBES | INDEXED, role[at]).astype(np.int32)})


class Bitmaps:
    """Parity bitmaps of some sets, to tell which pairs may link."""

    def __init__(self, bits: pa.Array, n: np.ndarray, percent: int):
        self.n, self.percent, self.width = n, percent, parity_width(n)
        data = bits.buffers()[2]
        self.flat = np.frombuffer(data, np.uint64) if data is not None else np.zeros(0, np.uint64)
        self.begin = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits)] // 8
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _level(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The bitmaps of this width, and those twice as wide folded to it; and each set's row among them."""
        if width not in self.levels:
            own, twice = np.flatnonzero(self.width == width), np.flatnonzero(self.width == 2 * width)
            take = lambda which, w: self.flat[self.begin[which][:, None] + np.arange(w)]
            wide = take(twice, 2 * width)
            place = np.zeros(len(self.n), np.int64)
            place[own], place[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            self.levels[width] = np.concatenate([take(own, width), wide[:, :width] ^ wide[:, width:]]), place
        return self.levels[width]

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair whether it may link."""
        na, nb = self.n[a], self.n[b]
        out = 100 * np.minimum(na, nb) >= self.percent * np.maximum(na, nb)
        apart = na + nb - 2 * -(-self.percent * (na + nb) // (100 + self.percent))
        at = np.flatnonzero(out)
        width = np.minimum(self.width[a[at]], self.width[b[at]])
        for w in np.unique(width):
            bits, place = self._level(int(w))
            some = at[width == w]
            for part in np.split(some, range(max(1, (1 << 19) // w), len(some), max(1, (1 << 19) // w))):
                out[part] = np.bitwise_count(bits[place[a[part]]] ^ bits[place[b[part]]]).sum(1, dtype=np.int64) <= apart[part]
        return out


def _forest(members: np.ndarray, linked) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of members, as (one, others linked with it); linked(x, others) tells which of others x is linked with."""
    todo = members
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            hit = linked(x, todo)
            if hit.any():
                yield x, todo[hit]
                queue.extend(todo[hit])
                todo = todo[~hit]


def _may_link(percent: int):
    """Of groups (gid, i, j, node, role, n, bits): a spanning forest of the pairs that meet and whose bitmaps let them link."""

    def run(rows: pa.Table) -> pa.Table:
        node, role, n, gid, i, j = (rows[c].to_numpy() for c in ("node", "role", "n", "gid", "i", "j"))
        order = np.lexsort((node, j, i, gid))
        bitmaps = Bitmaps(rows["bits"].combine_chunks() if rows["bits"].num_chunks != 1 else rows["bits"].chunk(0), n, percent)
        begins = _starts(gid[order], i[order], j[order])
        counts = np.diff(np.append(begins, len(order)))
        probes, indexed = role & PROBES > 0, role & INDEXED > 0
        meet = lambda a, b: probes[a] & indexed[b] | indexed[a] & probes[b]
        hub = np.repeat(order[begins], counts)
        first = np.zeros(len(order), bool)
        first[begins] = True
        near = first.copy()
        a, b = hub[~first], order[~first]
        near[~first] = bitmaps.close(a, b) & meet(a, b)
        us, vs = [hub[near & ~first]], [order[near & ~first]]
        for g in np.flatnonzero((counts > 2) & ~np.logical_and.reduceat(near, begins)):  # not all are linked by way of the first
            for x, others in _forest(order[begins[g] : begins[g] + counts[g]], lambda x, rest: bitmaps.close(np.full(len(rest), x), rest) & meet(x, rest)):
                us.append(np.full(len(others), x))
                vs.append(others)
        u, v = node[np.concatenate(us)], node[np.concatenate(vs)]
        u, v = np.minimum(u, v), np.maximum(u, v)
        order = np.lexsort((v, u))
        once = order[_starts(u[order], v[order])]
        give_back()
        return pa.table({"u": u[once], "v": v[once]})

    return run


def _links(percent: int):
    """Of sets by cell (cell, i, j, node, text), each cell's rows in a row: a spanning forest of each cell's links, verified exactly."""

    def forest(nodes: list[int], sets: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        size = np.array([len(h) for h, _ in sets])
        h, other = (np.concatenate(x) for x in zip(*sets, strict=True))
        order = np.lexsort((other, h))  # shingles are told apart by 128 bits
        new = np.zeros(len(h), np.int64)
        new[order[_starts(h[order], other[order])[1:]]] = 1
        ids = np.empty(len(h), np.int64)
        ids[order] = np.cumsum(new[order])
        begin, mark = np.cumsum(size) - size, np.zeros(len(h), bool)

        def linked(x: int, rest: np.ndarray) -> np.ndarray:
            mark[ids[begin[x] : begin[x] + size[x]]] = True
            some = mark[ids[ragged(begin[rest], size[rest])]]
            both = np.add.reduceat(some.astype(np.int64), np.cumsum(size[rest]) - size[rest])
            mark[ids[begin[x] : begin[x] + size[x]]] = False
            return 100 * both >= percent * (size[x] + size[rest] - both)

        for x, others in _forest(np.arange(len(sets)), linked):
            yield from ((nodes[x], nodes[y]) for y in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []
        for batch, data, offsets in steps(batches):
            h, bounds, other = shingle_sets(Words(data, offsets, lower=True), second=True)
            found = []
            for k, (key, node) in enumerate(zip(zip(*(column(batch, c).to_pylist() for c in ("cell", "i", "j")), strict=True), column(batch, "node").to_pylist(), strict=True)):
                if key != now:
                    found += forest(nodes, sets) if len(nodes) > 1 else []
                    now, nodes, sets = key, [], []
                if not nodes or nodes[-1] != node:  # rows that repeat are one set
                    nodes.append(node)
                    sets.append((h[bounds[k] : bounds[k + 1]].copy(), other[bounds[k] : bounds[k + 1]].copy()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], []))], names=["u", "v"])
        if len(nodes) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*forest(nodes, sets), strict=True)] or [pa.array([], pa.int64())] * 2, names=["u", "v"])

    return run


def _in_parts(rows: DataFrame, key: str, size: str, part: int) -> DataFrame:
    """rows with i and j: one row where the key's size is one part, else a row for each part that this row's part meets."""
    parts = F.ceil(F.col(size) / part).cast("int")
    own = F.pmod(F.xxhash64("node", key), parts).cast("int")
    pair = lambda a, b: F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    pairs = F.when(parts < 2, F.array(pair(F.lit(0), F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda p: pair(own, p)))
    return rows.withColumn("ij", F.explode(pairs)).select(*[c for c in rows.columns], "ij.i", "ij.j")


def candidate_cells(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component): the sets that some chain of meetings, let pass by their bitmaps, joins."""
    n_buckets = max(LEAST_BUCKETS, met.count() // MEMBERS_TOGETHER)
    parts = _in_parts(met.join(sets.select("node", "n", "bits"), "node"), "gid", "size", GROUP_PART)
    groups = parts.withColumn("bucket", F.pmod(F.xxhash64("gid", "i", "j"), F.lit(n_buckets)))
    may = groups.select("bucket", "gid", "i", "j", "node", "role", "n", "bits").groupBy("bucket").applyInArrow(_may_link(percent), "u long, v long")
    return connected_components(cut(may.distinct(), "may-link", release=True))


def verified(cells: DataFrame, sets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(u, v): a spanning forest of the links of each cell."""
    sizes = cells.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    chosen = cells.join(sizes, "component").join(sets.select("node", "rid"), "node").select("rid", "node", F.col("component").alias("cell"), "size")
    parts = _in_parts(texts.select("rid", "text").join(chosen, "rid"), "cell", "size", CELL_PART)
    dealt = parts.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")
    return dealt.select("cell", "i", "j", "node", "text").mapInArrow(_links(percent), "u long, v long")


def spark_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _moved(sketches: DataFrame, nodes: DataFrame) -> dict[tuple[int, int], int]:
    """A number of its own for each set but one of those that share a number, which is no other set's.

    Of n sets about n squared / 2**65 share one: 11 of 2 * 10**10, and MOST_MOVED only beyond 10**12.
    """
    pairs = sketches.join(nodes, "node").select("node", "other").distinct().limit(MOST_MOVED + 1).collect()
    if len(pairs) > MOST_MOVED:
        raise ValueError(f"over {MOST_MOVED} sets share their 64-bit numbers with others")
    least: dict[int, int] = {}
    for r in pairs:
        least[r["node"]] = min(least.get(r["node"], r["other"]), r["other"])
    todo = {(r["node"], r["other"]) for r in pairs if r["other"] != least[r["node"]]}
    out, turn = {}, 0
    while todo:
        turn += 1
        numbers = np.array([[(node + turn) & _MASK, other & _MASK] for node, other in todo], dtype=np.uint64)
        tried = dict(zip(todo, mix(mix(numbers[:, 0]) ^ numbers[:, 1]).view(np.int64).tolist(), strict=True))
        there = {r[0] for r in spark_rows(sketches, [(x,) for x in tried.values()], "node long").join(sketches.select("node"), "node", "left_semi").collect()}
        seen = {*there, *out.values()}
        for pair, number in tried.items():
            if number not in seen:
                seen.add(number)
                out[pair] = number
        todo -= out.keys()
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(members, links): every row's doc_id, rid, n_shingles and node (its set's number), and linked nodes (u, v).

    Links join nodes to components and leave out pairs that others imply. rid is the row's own hash. Sets are numbered
    by ``bits`` of a hash; unlike sets of one number, told apart by 64 more, get numbers of their own.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    sketches = cut(texts.mapInArrow(_sketch(bits), "doc_id long, rid long, n long, node long, other long, bits binary"), "sketches")
    of_nodes = sketches.groupBy("node").agg(F.min("other").alias("o"), F.max("other").alias("p"), F.sum(F.lit(1)).alias("c"))
    told = of_nodes.agg(F.sum((F.col("o") != F.col("p")).cast("long")).alias("unlike"), F.sum("c").alias("rows")).first()
    moved = _moved(sketches, of_nodes.where("o <> p").select("node")) if told["unlike"] else {}
    if moved:
        new = spark_rows(sketches, [(node, other, to) for (node, other), to in moved.items()], "of long, second long, to long")
        same = (F.col("node") == F.col("of")) & (F.col("other") == F.col("second"))
        sketches = sketches.join(F.broadcast(new), same, "left").withColumn("node", F.coalesce("to", "node")).drop("of", "second", "to")  # MOST_MOVED rows at most
    buckets = max(LEAST_BUCKETS, (told["rows"] or 0) // ROWS_TOGETHER)
    signed = texts.select("text").mapInArrow(_sign(percent, buckets, moved, bits), "bucket int, sigs array<int>, times array<int>, nodes array<long>")
    met = cut(signed.groupBy("bucket").applyInArrow(_meet, "gid long, size long, node long, role int"), "met", release=True)
    own = sketches.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("rid").alias("rid"), F.min_by("bits", "rid").alias("bits"))
    sets = cut(own.join(met.select("node").distinct(), "node", "left_semi"), "sets", release=True)
    cells = candidate_cells(met, sets, percent)
    links = cut(verified(cells, sets, texts, percent), "links", release=True)
    return sketches.select("doc_id", "rid", F.col("n").alias("n_shingles"), "node"), links


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    members, links = near_duplicates(docs, percent)
    label = connected_components(links)
    return members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def with_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every row's doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Letters A-Z count as a-z. Equal texts, and different texts of equal sets, link. Rows without words have no
    shingles and only themselves; so a null id without words has a null component. A component has its
    smallest id that is not null. Repeated rows each return; an empty table gives no rows. Shingles that are
    compared, and whole sets, are told apart by 128 bits. Columns other than doc_id and text aren't read.
    """
    rows = _labelled(docs, percent)
    names = rows.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    rows = rows.join(names, "component", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (nulls last); rows without words all stay.

    Of equal rows of a component one stays. Columns of any name are kept as they are; a long text is one row as
    any other, and an empty table gives no rows.
    """
    rows = _labelled(docs, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    chosen = rows.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("o")).select("o.rid", F.lit(True).alias("one"))
    wordless = rows.where("n_shingles = 0").select("rid", F.lit(False).alias("one")).distinct()
    rid, one, number = private(docs.columns, "rid", "one", "number")
    stay = chosen.unionByName(wordless).toDF(rid, one)
    kept = docs.withColumn(rid, F.xxhash64("doc_id", "text")).join(stay, rid)
    first = F.row_number().over(Window.partitionBy(rid).orderBy(one))
    return kept.withColumn(number, first).where(~F.col(one) | (F.col(number) == 1)).select(*named(*docs.columns))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.8."""
    return with_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = w.doc_id
"""
