"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Equal sets are one vertex, by fingerprint. Small sets enumerate their fixed-size subsets: two of them link
exactly if they share a subset of as many elements as their sizes demand. Large sets, and the small ones near the
boundary, post the rarest elements of their sets to inverted lists, which are scanned for candidates. The boundary
between small and large is where the subsets, by a cost model over the counted small sets and the counted
frequencies of their elements, begin to cost more than the lists.

The first common element, in the order that all sets share, of two sets that link lies among the first of both
(shingles.short_length, shingles.prefix_length), so a pair need only be met in the list of that element. Sets
post a few elements more (shingles.spare), so that sets that link share several lists. A member stays in a list only if
a partner of a fitting size and place is there too, a set stays only if it has so many lists, and of lists with the
same members one stays: sets that share but a phrase or two have gone before any whole set is fetched.

Scanning is done twice. First each set meets others in one list, its first, in blocks of bounded size: members and
work grow in proportion, and families of copies of copies fall into components. Then every list that still holds
different components is scanned whole: those outside its greatest component meet all members, block by block. There
the candidates of a block pair are told from the sets' prefixes alone; only members with a candidate bring their whole
sets, pairs are verified inside the task, and of the links found a spanning forest leaves it. No rows of pairs
are made. A list of k members of which none link costs k * k comparisons and k * k / BLOCK rows.

Everything passes through tables in the shared folder; only the frequency classes (2 ** CLASS_BITS bytes), costs of
small sets by size, a bit table of bounded size and fingerprint collisions (none below some 10 ** 9 documents) go through
the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as S
from .common import discard, light, shipped, table, tidied, written
from .components import components

#: Largest boundary that is considered.
MOST_BOUNDARY = 12
#: Shingles that are counted at a time, and the sum of repeats from which on a class counts as frequent.
COUNT_CHUNK, FREQUENT = 1 << 21, 8
#: A block of a list holds so many members and elements (a larger set is a block of its own).
BLOCK, BLOCK_ELEMENTS = 1024, 1 << 20
#: Rounds in which lists of several blocks are dealt into blocks, by another hash each time.
DEALS = 3
#: Bits of the table that tells which documents' sets are wanted: a multiple of their number, up to a bound. Beyond
#: it more sets are fetched than wanted, at most all of them, and filtered by a join.
BITS_EACH, MOST_BITS, HASHES = 16, 1 << 28, 3
#: Largest table of list members, at 100 bytes a row, that is broadcast to the sets.
BROADCAST_BYTES = 32 << 20

_PROFILE = "kind int, a long, b long, c long, d long, small binary"
_POSTING = "kind int, key long, key2 long, fp long, n int, pos int"


def _batched_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # not all texts of a batch as Python strings at once
            part = batch.slice(i, 256)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


@tidied
def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document (0, doc_id, size, fingerprint, another, elements of a small set); for classes of hashes that
    repeat (1, class, how often)."""
    rows: list[tuple] = []
    pending: list[np.ndarray] = []
    waiting = 0

    def repeats() -> pa.RecordBatch:
        seen, times = np.unique(np.concatenate(pending), return_counts=True)
        many = times > 1
        classes, where = np.unique(seen[many] >> S.U(64 - S.CLASS_BITS), return_inverse=True)
        sums = np.bincount(where, times[many], len(classes)).astype(np.int64)
        n = len(classes)
        return batch_of(np.ones(n, np.int32), classes.astype(np.int64), sums, np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n)

    def batch_of(kind, a, b, c, d, small) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *[pa.array(x, pa.int64()) for x in (a, b, c, d)], pa.array(small, pa.binary())], ["kind", "a", "b", "c", "d", "small"])

    for doc_id, text in _batched_texts(batches):
        s = S.shingle_set(text)
        rows.append((0, doc_id, len(s), *(S.fingerprints(s) if len(s) else (None, None)), s.tobytes() if 0 < len(s) <= MOST_BOUNDARY else None))
        pending.append(s)
        waiting += len(s)
        if waiting >= COUNT_CHUNK:
            yield repeats()
            pending, waiting = [], 0
        if len(rows) >= 2000:
            yield batch_of(*zip(*rows))
            rows = []
    if waiting:
        yield repeats()
    if rows:
        yield batch_of(*zip(*rows))


def frequency_classes(profiles: DataFrame) -> np.ndarray:
    """For each class of hashes the logarithm of how often its shingles repeat, below MOST_CLASSES. It orders elements,
    so it changes what the join costs and never what it finds."""
    sums = profiles.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).filter(F.col("n") >= FREQUENT)
    found = sums.select(F.col("a").cast("int").alias("a"), F.least(F.log2("n"), F.lit(S.MOST_CLASSES - 1)).cast("byte").alias("n")).toArrow()
    out = np.zeros(1 << S.CLASS_BITS, np.uint8)
    out[found["a"].to_numpy()] = found["n"].to_numpy()
    return out


def boundary_by_cost(profiles: DataFrame, classes) -> int:
    """The set size up to which enumerating subsets costs less than posting to lists and scanning them. classes: a
    broadcast of frequency_classes(). A posting costs one, as a subset key does, and as much again as its list, by
    its element's counted frequency, is long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(classes.value, np.uint8)
        lists = np.zeros(MOST_BOUNDARY + 1)
        sets = np.zeros(MOST_BOUNDARY + 1, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                s = np.frombuffer(x, np.uint64)
                sets[len(s)] += 1
                lists[len(s)] += sum(1 + 2.0 ** (k >> 59) for k in S.prefix(s, order).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(MOST_BOUNDARY + 1)), pa.array(sets), pa.array(lists)], ["n", "sets", "lists"])

    small = profiles.filter((F.col("kind") == 0) & F.col("b").between(1, MOST_BOUNDARY)).groupBy("c").agg(F.min("small").alias("small")).select("small")
    found = {r["n"]: r for r in small.mapInArrow(run, "n long, sets long, lists double").groupBy("n").agg(F.sum("sets").alias("sets"), F.sum("lists").alias("lists")).collect()}
    cost = [0.0]
    for n in range(1, MOST_BOUNDARY + 1):
        r = found.get(n)
        cost.append(cost[-1] + (r["sets"] * S.subset_count(n) - r["lists"] if r else 0.0))
    return int(np.argmin(cost))


def _named(s: np.ndarray, clashing: frozenset[int]) -> int:
    """The fingerprint by which a set goes: the second where different sets share the first."""
    first, second = S.fingerprints(s)
    return second if first in clashing else first


def _postings(classes, boundary: int, clashing: frozenset[int]):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(classes.value, np.uint8)
        seen: set[int] = set()
        kinds, keys, twos, marks, sizes, places, held = [], [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            lengths = [len(k) for k in keys]
            spread = lambda x, t: pa.array(np.repeat(np.array(x, t), lengths))
            return pa.RecordBatch.from_arrays([spread(kinds, np.int32), pa.array(np.concatenate(keys)), pa.array(np.concatenate(twos)), spread(marks, np.int64), spread(sizes, np.int32), pa.array(np.concatenate(places))],
                                              ["kind", "key", "key2", "fp", "n", "pos"])

        for _, text in _batched_texts(batches):
            s = S.shingle_set(text)
            n = len(s)
            if not n or (fp := _named(s, clashing)) in seen:
                continue
            if len(seen) < 1 << 20:  # it only spares rows: later stages drop repeats themselves
                seen.add(fp)
            mine = []
            if n <= boundary:
                mine = [(kind, *np.array(k, np.int64).reshape(-1, 2).T, np.zeros(len(k), np.int32)) for kind, k in zip((0, 2), S.subset_keys(s, boundary))]
            if max(S.partner_sizes(n)) > boundary:
                first = S.prefix(s, order)
                mine.append((1, first, np.zeros(len(first), np.int64), np.arange(len(first), dtype=np.int32)))
            for kind, key, two, place in mine:
                if len(key):
                    kinds.append(kind)
                    keys.append(key)
                    twos.append(two)
                    marks.append(fp)
                    sizes.append(n)
                    places.append(place)
                    held += len(key)
            if held > 100_000:
                yield out()
                kinds, keys, twos, marks, sizes, places, held = [], [], [], [], [], [], 0
        if held:
            yield out()

    return run


_SHARED = "kind int, key long, key2 long, fp long, n int, pos int, first long"


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by kind, key, key2, n, fp: each row once, with its list's first, if it has company: in subset
    lists any other member, in lists of kind 1 one before it, posted within its short_length and spare and of a fitting
    size, or, if it is posted so itself, one of a fitting size behind it."""
    names = ["kind", "key", "key2", "fp", "n", "pos"]
    carry = None  # a list's last row, its first fingerprint, whether that row has company before it, the list's last short size before the row (or -1)

    def posted_short(n, pos):
        return pos < S.short_length(n) + S.spare(n)

    def settled(rows: list[np.ndarray], first, before, last: bool) -> Iterator[pa.RecordBatch]:
        """rows, in which the last one waits for its follower unless it is the last of all."""
        kind, key, key2, fp, n, pos = rows
        same = (key[1:] == key[:-1]) & (key2[1:] == key2[:-1]) & (kind[1:] == kind[:-1])
        behind = np.append(same & ((kind[:-1] != 1) | (posted_short(n[:-1].astype(np.int64), pos[:-1]) & (S.LINK_DEN * n[:-1].astype(np.int64) >= S.LINK_NUM * n[1:].astype(np.int64)))), False)
        upto = len(key) if last else len(key) - 1
        good = (before | behind)[:upto]
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:upto][good]) for x in (*rows, first)], [*names, "first"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(6)]
        if carry is not None:
            rows = [np.append(np.array([c], x.dtype), x) for c, x in zip(carry[0], rows)]
        kind, key, key2, fp, n, pos = rows
        same = (key[1:] == key[:-1]) & (key2[1:] == key2[:-1]) & (kind[1:] == kind[:-1])
        fresh = np.append(True, ~(same & (fp[1:] == fp[:-1])))
        kind, key, key2, fp, n, pos = rows = [x[fresh] for x in rows]
        same = (key[1:] == key[:-1]) & (key2[1:] == key2[:-1]) & (kind[1:] == kind[:-1])
        begins = np.append(True, ~same)
        at = np.arange(len(key))
        start = np.maximum.accumulate(np.where(begins, at, 0))
        first = fp[start].copy()
        size = n.astype(np.int64)
        short = np.where(posted_short(size, pos), at, -1)
        earlier = np.append(-1, np.maximum.accumulate(short)[:-1])  # the last short row before, of any list
        shorts = np.where(earlier >= start, size[np.maximum(earlier, 0)], -1)
        company = at > start
        if carry is not None:
            end = int(np.argmax(np.append(begins[1:], True))) + 1  # the rows of the carried list
            first[:end] = carry[1]
            shorts[:end] = np.maximum(shorts[:end], carry[3])
            company[0] = carry[2]
        before = np.where(kind == 1, (shorts >= 0) & (S.LINK_DEN * shorts >= S.LINK_NUM * size), company)
        yield from settled(rows, first, before, False)
        carry = [x[-1] for x in rows], first[-1], bool(company[-1]), int(shorts[-1])
    if carry is not None:
        kind, n = carry[0][0], int(carry[0][4])
        before = np.array([carry[3] >= 0 and S.LINK_DEN * carry[3] >= S.LINK_NUM * n if kind == 1 else carry[2]])
        yield from settled([np.array([x]) for x in carry[0]], np.array([carry[1]]), before, True)


class _Overlaps:
    """For ascending arrays: how many elements each shares with one of them. Elements of one array alone are dropped."""

    def __init__(self, arrays: list[np.ndarray]):
        lengths = np.fromiter(map(len, arrays), np.int64, len(arrays))
        whole = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
        order = np.argsort(whole, kind="stable")
        value = whole[order]
        same = value[1:] == value[:-1]
        shared = np.append(same, False) | np.append(False, same) if len(value) else np.empty(0, bool)
        owner = np.repeat(np.arange(len(arrays)), lengths)[order][shared]
        fresh = np.append(True, ~same)[shared] if len(value) else shared
        begin = np.flatnonzero(fresh)
        number = np.cumsum(fresh) - 1
        self.owner, self.begin, self.length = owner, begin, np.diff(np.append(begin, len(owner)))
        by_owner = np.argsort(owner, kind="stable")
        self.numbers, self.bounds, self.many = number[by_owner], np.searchsorted(owner[by_owner], np.arange(len(arrays) + 1)), len(arrays)

    def __call__(self, i: int) -> np.ndarray:
        mine = self.numbers[self.bounds[i] : self.bounds[i + 1]]
        lengths = self.length[mine]
        before = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) + np.repeat(self.begin[mine] - before, lengths)
        return np.bincount(self.owner[at], minlength=self.many)


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list]]:
    """The rows of each (key, b, c), which sorted rows begin with: the name, and the columns behind as arrays, the last
    one as a list of arrays over its binary values."""
    held, parts = None, []

    def whole() -> list:
        return [*[np.concatenate(c) for c in list(zip(*parts))[:-1]], [x for p in parts for x in p[-1]]]

    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(k).to_numpy() for k in range(3)]
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, batch.num_columns - 1)]
        binary = batch.column(batch.num_columns - 1)
        offsets = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1]
        data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            name = tuple(int(x[lo]) for x in names)
            if name != held and parts:
                yield held, whole()
                parts = []
            held = name
            parts.append([*[x[lo:hi] for x in columns], [data[offsets[i] : offsets[i + 1]].copy().view(np.int64) for i in range(lo, hi)]])
    if parts:
        yield held, whole()


_CANDIDATE = "key long, b int, c int, fp long, comp long, is_left boolean, is_right boolean"


@tidied
def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups (key, b, c; fp, comp, is_left, is_right, n, pos, the prefix before pos): the members of a pair, left
    and right, of different components, whose first common element is the list's and whose sizes and places allow a link."""
    for name, (fp, comp, left, right, n, pos, prefixes) in _by_group(batches):
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        earlier = None
        hit_left, hit_right = np.zeros(len(fp), bool), np.zeros(len(fp), bool)
        short, rest = pos < S.short_length(n), n - 1 - pos
        for x in np.flatnonzero(left):
            lesser = (n < n[x]) | ((n == n[x]) & (fp < fp[x]))  # than x
            ok = right & (comp != comp[x]) & np.where(lesser, short, short[x])
            ok &= S.LINK_DEN * np.minimum(n, n[x]) >= S.LINK_NUM * np.maximum(n, n[x])
            ok &= 1 + np.minimum(rest, rest[x]) >= -(-S.LINK_NUM * (n + n[x]) // (S.LINK_NUM + S.LINK_DEN))
            if not ok.any():
                continue
            if earlier is None:
                earlier = _Overlaps(prefixes)
            ok &= earlier(x) == 0
            hit_left[x] = ok.any()
            hit_right |= ok
        hit = np.flatnonzero(hit_left | hit_right)
        if len(hit):
            spread = [pa.array(np.full(len(hit), v, t)) for v, t in zip(name, (np.int64, np.int32, np.int32))]
            yield pa.RecordBatch.from_arrays([*spread, pa.array(fp[hit]), pa.array(comp[hit]), pa.array(hit_left[hit]), pa.array(hit_right[hit])],
                                             ["key", "b", "c", "fp", "comp", "is_left", "is_right"])


@tidied
def _spanning_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups (key, b, c; fp, comp, is_left, is_right, elements): links (u, v) between a left and a right member, as
    many as join all components that such links join, and no more."""
    us, vs = [], []
    for _, (fp, comp, left, right, elements) in _by_group(batches):
        _, root = np.unique(comp, return_inverse=True)
        n = np.fromiter(map(len, elements), np.int64, len(elements))
        shared = None
        for x in np.flatnonzero(left):
            ok = right & (root != root[x]) & (S.LINK_DEN * np.minimum(n, n[x]) >= S.LINK_NUM * np.maximum(n, n[x]))
            if not ok.any():
                continue
            if shared is None:
                shared = _Overlaps(elements)
            both = shared(x)
            ok &= (both > 0) & (S.LINK_DEN * both >= S.LINK_NUM * (n + n[x] - both))
            linked, one = np.unique(root[ok], return_index=True)
            us += [int(fp[x])] * len(linked)
            vs += fp[np.flatnonzero(ok)[one]].tolist()
            root[np.isin(root, linked)] = root[x]
        if len(us) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
            us, vs = [], []
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _wanted_sets(docs: DataFrame, rows: DataFrame, fps: DataFrame, classes, clashing: frozenset[int]) -> DataFrame:
    """(fp, first, elements) for each fingerprint of a written table: the ordered prefix and the sorted elements, as
    64-bit numbers. rows: the documents' (doc_id, fp). One pass over the texts and no shuffle of sets: the documents
    that are wanted, one for a fingerprint, are told by a Bloom filter of their ids. The few more sets that it lets pass,
    and those of rows that share an id, are in the table too and meet nothing in joins on fp."""
    spark = docs.sparkSession
    need = written(rows.join(fps, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "holders")
    bits = 1 << max(12, int(min(MOST_BITS, BITS_EACH * max(1, need.count()))).bit_length())
    spots = [F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(bits)) for k in range(HASHES)]
    words = need.select(F.explode(F.array(*spots)).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("mask")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[words["word"].to_numpy()] = words["mask"].to_numpy()
    told = spark.sparkContext.broadcast(filled.tobytes())
    del words, filled

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, mask, seen = np.frombuffer(classes.value, np.uint8), np.frombuffer(told.value, np.int64), set()
        rows, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["fp", "first", "elements"])
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for k in range(HASHES):
                at = batch.column(1 + k).to_numpy()
                hit &= ((mask[at >> 6] >> (at & 63)) & 1).astype(bool)
            for text in (batch.column(0)[int(i)].as_py() for i in np.flatnonzero(hit)):
                s = S.shingle_set(text)
                if not len(s) or (fp := _named(s, clashing)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(fp)
                rows.append((fp, S.prefix(s, order).tobytes(), s.tobytes()))
                size += 8 * len(s)
                if size > 1 << 20:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    sets = written(docs.select("text", *[x.alias(f"spot{k}") for k, x in enumerate(spots)]).mapInArrow(run, "fp long, first binary, elements binary"), "sets")
    discard(need)
    return sets


def _with_sets(rows: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """A written table of list members joined with a column of sets on fp: it is broadcast, so that sets do not move, if
    it is small."""
    return light(rows, 100, BROADCAST_BYTES).join(sets.select("fp", column), "fp")


def _blocks_for(many: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(many / BLOCK), F.ceil(weight / BLOCK_ELEMENTS), F.lit(1)).cast("int")


def _dealt(groups: DataFrame, run: Callable, schema: str) -> DataFrame:
    return groups.repartition("key", "b", "c").sortWithinPartitions("key", "b", "c").mapInArrow(run, schema)


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.select(F.col("u").alias("fp"), F.col("v").alias("comp")), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def _links_in_blocks(homes: DataFrame, sets: DataFrame, comps: DataFrame | None, deal: int) -> DataFrame | None:
    """Links between members of a block of a list, of homes(key, fp, n): a set meets others in one list. From the second
    deal on only lists of several blocks and components count; None if there is none."""
    rows = homes.withColumn("comp", F.col("fp")) if comps is None else _labelled(homes, comps)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("weight"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    sizes = sizes.filter("lo < hi").select("key", _blocks_for(F.col("many"), F.col("weight")).alias("blocks"))
    if comps is not None:
        sizes = written(sizes.filter("blocks > 1"), "long-lists")
        if sizes.isEmpty():
            return None
    met = written(rows.join(sizes, "key").select("key", F.pmod(F.xxhash64(F.lit(deal), "fp"), F.col("blocks")).cast("int").alias("b"), F.lit(deal).alias("c"), "fp", "comp"), "met")
    groups = _with_sets(met, sets, "elements").select("key", "b", "c", "fp", "comp", F.lit(True).alias("is_left"), F.lit(True).alias("is_right"), "elements")
    return written(_dealt(groups, _spanning_links, "u long, v long"), "links")


def _links_across(lists: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between different components in any list: its members outside its greatest component meet all of them."""
    rows = written(_labelled(lists.select("key", "fp", "n", "pos"), comps), "list-members")
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    whole = parts.groupBy("key").agg(F.sum("c").alias("many"), F.sum("w").alias("weight"), F.max(F.struct("c", "w", "comp")).alias("top")).filter("many > top.c")
    mixed = written(whole.select("key", F.col("top.comp").alias("major"), _blocks_for(F.col("many"), F.col("weight")).alias("blocks"),
                                 _blocks_for(F.col("many") - F.col("top.c"), F.col("weight") - F.col("top.w")).alias("minors")), "mixed-lists")
    is_minor = F.col("comp") != F.col("major")
    b, c = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.when(is_minor, F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("minors")).cast("int"))
    placed = rows.join(mixed, "key").select("key", "fp", "comp", "n", "pos", "blocks", "minors", b.alias("own_b"), c.alias("own_c"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda x: F.struct(F.col("own_b").alias("b"), x.alias("c")))
    as_left = F.when(F.col("own_c").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("b"), F.col("own_c").alias("c"))))
    at = F.array_distinct(F.concat(as_right, F.coalesce(as_left, F.array().cast("array<struct<b:int,c:int>>"))))
    spread = placed.select("key", "fp", "comp", "n", "pos", "own_b", "own_c", F.explode(at).alias("at")).select(
        "key", "at.b", "at.c", "fp", "comp", F.coalesce(F.col("own_c") == F.col("at.c"), F.lit(False)).alias("is_left"), (F.col("own_b") == F.col("at.b")).alias("is_right"), "n", "pos")
    spread = written(spread, "spread-members")
    begun = _with_sets(spread, sets, "first").select("key", "b", "c", "fp", "comp", "is_left", "is_right", "n", "pos", F.expr("substring(first, 1, 8 * pos)").alias("first"))
    members = written(_dealt(begun, _candidates, _CANDIDATE), "candidates")
    groups = _with_sets(members, sets, "elements").select("key", "b", "c", "fp", "comp", "is_left", "is_right", "elements")
    links = written(_dealt(groups, _spanning_links, "u long, v long"), "links")
    for done in (rows, mixed, spread, members):
        discard(done)
    return links


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text); other columns, whatever their names, are
    ignored.

    component_id is the least doc_id that links reach. Null, empty and blank texts have no shingles and are
    components of their own. Repeated rows are one vertex and come back each; ties do not arise, as the least id is
    unique. A row with a null doc_id takes part like any other and has the least id of its component, or null. Very
    long texts are taken whole, hashed in blocks. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    shipped(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = written(docs.mapInArrow(_profiles, _PROFILE), "profiles", "kind")
    classes = spark.sparkContext.broadcast(frequency_classes(profiles).tobytes())
    boundary = boundary_by_cost(profiles, classes)
    own = profiles.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "c", "d")
    # 64 bits tell 10 ** 9 sets apart; where different sets share them, which is seen here, others take their place
    several = own.groupBy("c").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select("c").toArrow()
    clashing = frozenset(several["c"].to_pylist())
    fp = F.when(F.col("c").isin(*clashing), F.col("d")).otherwise(F.col("c")) if clashing else F.col("c")
    own = own.select("doc_id", "n_shingles", fp.alias("fp"))

    posted = docs.mapInArrow(_postings(classes, boundary, clashing), _POSTING)
    shared = written(posted.repartition("kind", "key", "key2").sortWithinPartitions("kind", "key", "key2", "n", "fp").mapInArrow(_shared_lists, _SHARED), "lists", "kind")
    # of two sizes: whoever shares a subset key with a set of the other size links with it
    two = shared.filter("kind = 2")
    both = two.groupBy("key", "key2").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).filter("lo < hi").select("key", "key2")
    proven = shared.filter("kind = 0").unionByName(two.join(both, ["key", "key2"], "left_semi").select(*shared.columns)).filter("fp <> first")
    edges = proven.select(F.col("fp").alias("u"), F.col("first").alias("v"))

    # of lists with the same members that of the least key stays: it holds the first common element of any two
    spare = lambda n: f"least({S.MOST_SPARE}, ({n}) div {S.SPARE_EACH})"
    least_partner = f"({S.LINK_NUM} * n + {S.LINK_DEN - 1}) div {S.LINK_DEN}"
    large = shared.filter("kind = 1").select("key", "fp", "n", "pos")
    enough = large.groupBy("fp", "n").agg(F.count(F.lit(1)).alias("lists")).filter(f"lists >= 1 + {spare(least_partner)}").select("fp")
    large = written(large.filter(f"pos < n - {least_partner} + 1").join(enough, "fp", "left_semi"), "large-lists")
    signed = large.groupBy("key").agg(F.bit_xor(F.xxhash64("fp")).alias("one"), F.bit_xor(F.xxhash64(F.lit(7), "fp")).alias("two"), F.count(F.lit(1)).alias("many"))
    lists = written(large.join(signed.groupBy("one", "two", "many").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"), "distinct-lists")
    fps = written(lists.select("fp").distinct(), "wanted")
    sets = _wanted_sets(docs, own, fps, classes, clashing)
    homes = written(lists.groupBy("fp", "n").agg(F.min("key").alias("key")), "homes")

    comps = None
    for deal in range(DEALS):
        found = _links_in_blocks(homes, sets, comps, deal)
        if found is None:
            break
        comps = components(found.unionByName(edges if comps is None else comps))
    comps = components(_links_across(lists, sets, comps).unionByName(comps))
    for done in (lists, fps, homes, sets, shared, large):
        discard(done)

    placed = written(own.join(comps.select(F.col("u").alias("fp"), "v"), "fp", "left").select("doc_id", "n_shingles", F.coalesce("v", "fp").alias("comp")), "placed")
    for done in (profiles, comps):
        discard(done)
    least = written(placed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    return placed.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, with all columns, less those that link to one of a lesser id, directly or through others.

    Rows that share a kept doc_id are one document and stay together; rows with a null doc_id stay. What joined() says of
    odd rows holds here.
    """
    dropped = written(joined(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(light(dropped, 32, BROADCAST_BYTES), "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT p.v, r.root FROM r JOIN p ON p.u = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
