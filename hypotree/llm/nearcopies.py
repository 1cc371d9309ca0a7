"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by an exact join.

Every set is ordered alike: shingles that are frequent in a sample last, the most frequent at the end, else by hash. Two
sets as similar as `least` share a shingle of their prefixes (the first n - ceil(least * n) + 1 of n), so pairs are looked
for among the sets that share one, and each is verified on the two whole texts. The sample changes only the speed.

Groups are asked for, and not pairs. So each list of sets with a common prefix shingle is first compared with one of its
members; lists whose members are linked by then are done. In those still open, bitmaps tell which sets of different groups
may be similar, and a list gives a spanning forest of these candidates, no row for each pair. The forests' components are
blocks: each set is in one at most, and any two candidates are in the same. Within a block the whole sets are compared, and
it gives a spanning forest of what is similar. Large lists and blocks are split into cells in one of which any two members meet.

Only hashes of prefixes and the texts of pairs travel: a set is named by 64 bits of its BLAKE2 digest, a text by its
XXH64, and sets are worked out again where they are compared. Frequent shingles are salted and copies of a set within a
task count once, so no task gets all rows of a frequent shingle or of a large group of copies.

Defined results: null and empty texts are one set without shingles, and equal; fewer words than a shingle make one shingle
of all; a group's id is its smallest non-null doc_id; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import SLICE, drop_tables, field, map_texts, slices, write_table
from .tokens import sums

#: A similarity of 4 / 5, in whole numbers.
LEAST = (4, 5)
ROWS = "doc_id long, th long, fp long, sig long, n int, bits binary, rare array<long>, late array<long>"
#: Least and most bytes of a set's bitmap; between them it has a bit for each shingle or more.
BITMAP, BITMAP_MOST = 256, 2048
#: Odd multipliers: of a word's hash by its place in the shingle, and of the mixing.
PLACES, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = found = xxh64_intdigest(word)
        return found


def shingle_set(text: bytes, words: int, known: _WordHashes) -> np.ndarray:
    """The distinct hashes of the runs of so many words, ascending; words as in simhash.shingle_hashes()."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(own))
    total = np.zeros(len(own) - width + 1, np.uint64)
    for k in range(width):
        total += own[k : k + len(total)] * np.uint64(pow(PLACES, k + 1, 1 << 64))
    total = (total ^ (total >> np.uint64(31))) * MIX
    return np.unique((total ^ (total >> np.uint64(29))).view(np.int64))


def prefix_size(n: int, least: tuple[int, int] = LEAST) -> int:
    return n - -(-least[0] * n // least[1]) + 1 if n else 0


def bitmap(hashes: np.ndarray) -> bytes:
    size = 8 * BITMAP
    while size < min(len(hashes), 8 * BITMAP_MOST):
        size *= 2
    out = np.zeros(size, bool)
    out[hashes & (size - 1)] = True
    return np.packbits(out).tobytes()


class _Bitmaps:
    """Tells of which sets the bitmaps allow the similarity; of two sizes the larger bitmap is folded to the smaller."""

    def __init__(self, bits: list[bytes], n: np.ndarray, least: tuple[int, int]) -> None:
        self.n, self.least = n.astype(np.int64), least
        self.level = np.array([(len(x) // BITMAP).bit_length() for x in bits], np.int64)
        self.place, self.maps = np.zeros(len(bits), np.int64), {}
        for level in np.unique(self.level).tolist():
            at = np.flatnonzero(self.level == level)
            self.place[at] = np.arange(len(at))
            own = np.frombuffer(b"".join([bits[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1)
            self.maps[level, level] = own
            self.maps[level, level - 1] = own[:, : own.shape[1] // 2] | own[:, own.shape[1] // 2 :]

    def near(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of js whose sets may be similar to that of i."""
        (up, down), n, level = self.least, self.n, int(self.level[i])
        js = js[up * np.maximum(n[i], n[js]) <= down * np.minimum(n[i], n[js])]
        kept = []
        for other in np.unique(self.level[js]).tolist():
            some, low = js[self.level[js] == other], min(level, other)
            if max(level, other) - low < 2:  # else nothing is ruled out; sizes so far apart are only of another `least`
                differ = np.bitwise_count(self.maps[other, low][self.place[some]] ^ self.maps[level, low][self.place[i]]).sum(1, dtype=np.int64)
                some = some[(down + up) * differ <= (down - up) * (n[i] + n[some])]
            kept.append(some)
        return np.sort(np.concatenate(kept)) if kept else js


def spanning(label: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges (i, j) that join all i and j that are near: no more than there are members. label: equal for those joined already.

    near(i, js): those of js that are near i. Members that edges have joined are not compared again.
    """
    label, out = label.copy(), []
    for i in range(len(label) - 1):
        js = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if len(js) and len(js := near(i, js)):
            joined, at = np.unique(label[js], return_index=True)
            out += [(i, j) for j in js[at].tolist()]
            label[np.isin(label, joined)] = label[i]
    return out


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, th, text): th names the text."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))


def frequent_shingles(docs: DataFrame, *, text: str = "text", words: int = 5, sample: int = 20_000, times: int = 3, most: int = 100_000) -> np.ndarray:
    """The shingles that occur in `times` of about `sample` texts, at most `most` of them, the most frequent last."""
    share = min(1.0, sample / max(1, docs.count()))
    few = _named(docs, text, text).where(F.pmod("th", F.lit(1_000_000)) < int(share * 1_000_000)).select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches, "text", SLICE):
            found = [np.zeros(0, np.int64), *(shingle_set(x, words, known) for x in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["h"])

    found = map_texts(few, run, "h long").groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") >= times)
    return np.array([r.h for r in found.orderBy(F.desc("times"), "h").limit(most).select("h").collect()][::-1], np.int64)


def described(docs: DataFrame, frequent: np.ndarray, *, key: str = "doc_id", text: str = "text", words: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """A row for each row of docs: fp as in op7, sig and size of its set, and the set's prefix, frequent shingles apart.

    Of rows of one task with the same set only the first has the prefix.
    """
    held = docs.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (late, rank), known, seen = held.value, _WordHashes(), set()
        for batch in slices(batches, "text", SLICE):
            known = _WordHashes() if len(known) > 200_000 else known
            seen = set() if len(seen) > 200_000 else seen
            fps, sigs, sizes, bits, parts = [], [], [], [], ([], [])
            for x in batch.column("text").to_pylist():
                fps.append(simhash.fingerprint(simhash.shingle_hashes(x, 3)))
                one = shingle_set(x, words, known)
                sig = int.from_bytes(hashlib.blake2b(one.tobytes(), digest_size=8).digest(), "little", signed=True)
                sigs.append(sig)
                sizes.append(len(one))
                bits.append(bitmap(one))
                size = 0 if sig in seen else prefix_size(len(one), least)
                seen.add(sig)
                if len(late) and size:
                    at = np.minimum(np.searchsorted(late, one), len(late) - 1)
                    is_late = late[at] == one
                    first = one[~is_late][:size]
                    then = one[is_late]
                    parts[1].append(then[np.argsort(rank[at[is_late]])][: size - len(first)])
                else:
                    first = one[:size]
                    parts[1].append(one[:0])
                parts[0].append(first)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, p)]).astype(np.int32)), pa.array(np.concatenate(p))) for p in parts]
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROWS.split(", ")])

    return map_texts(_named(docs, key, text), run, ROWS)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From rows (h, salt, sig) sorted so: for each run of one h and salt with two distinct sets or more its members.

    Runs of shingles that aren't salted, with at most `most` members, give one list each, equal lists once in a task;
    other runs give lists of at most `most` members under their h, also if there is but one set, as other salts may have more.
    """
    seen: set[bytes] = set()
    held = np.zeros((3, 0), np.int64)  # h, salt, sig of the run that may go on
    broken: set[int] = set()  # the shingle of a run that was given in pieces

    def lists(rows: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
        h, salt, sig = rows
        begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]))
        end = np.append(begin[1:], len(h))
        for a, b in zip(*(x[(end - begin > 1) | (salt[begin] >= 0)].tolist() for x in (begin, end))):
            members = np.unique(sig[a:b])
            if salt[a] < 0 and len(members) <= most and h[a] not in broken:
                name = members.tobytes()
                if len(members) > 1 and name not in seen:
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(name)
                    yield None, members
            else:
                for at in range(0, len(members), most):
                    yield int(h[a]), members[at : at + most]

    def out(found: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        offsets = pa.array(np.cumsum([0, *(len(m) for _, m in found)]).astype(np.int32))
        members = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *(m for _, m in found)])))
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), members], ["h", "members"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("h", "salt", "sig")])], axis=1)
        if not rows.shape[1]:
            continue
        last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
        cut = int(np.argmax(last))
        if last.all() and rows.shape[1] > 1 << 20:
            cut, broken = rows.shape[1], {int(rows[0, 0])}
        if cut:
            yield out(list(lists(rows[:, :cut])))
        held = rows[:, cut:]
    if held.shape[1]:
        yield out(list(lists(held)))


def shared_lists(rows: DataFrame, *, most: int = 128) -> DataFrame:
    """(list, sig): members of lists such that any two sets that share a prefix shingle are in one of them."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = F.pmod(F.xxhash64("sig"), F.lit(salts)).cast("long")
    keyed = rows.select(F.explode("rare").alias("h"), F.lit(-1).cast("long").alias("salt"), "sig").union(rows.select(F.explode("late").alias("h"), salted.alias("salt"), "sig"))
    dealt = keyed.repartition("h", "salt").sortWithinPartitions("h", "salt", "sig")
    found = write_table(dealt.mapInArrow(lambda it: _runs(it, most), "h long, members array<long>"), "nearcopies-runs")
    small = found.where("h is null").select(F.xxhash64(F.lit(0), "members").alias("list"), "members").dropDuplicates(["list"])
    large = found.where("h is not null").select(F.xxhash64(F.lit(1), "h").alias("list"), "members")
    members = write_table(small.union(large).select("list", F.explode("members").alias("sig")), "nearcopies-members")
    drop_tables(found)
    return members


def _open_members(members: DataFrame, sizes: DataFrame, roots: DataFrame) -> DataFrame:
    """(list, sig, n, root) of the lists with members of several groups."""
    rooted = members.join(sizes, "sig").join(roots, F.col("sig") == F.col("node"), "left").select("list", "sig", "n", F.coalesce("root", "sig").alias("root"))
    rooted = write_table(rooted, "nearcopies-rooted")
    left = rooted.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("list").alias("same"))
    found = write_table(rooted.join(left, F.col("list") == F.col("same"), "left_semi"), "nearcopies-open")
    drop_tables(rooted)
    return found


def star_pairs(members: DataFrame, turn: int, least: tuple[int, int] = LEAST) -> DataFrame:
    """(a, b), a < b: each list's members with one of them, another at every turn, where groups differ and sizes allow it."""
    order = F.xxhash64("sig", F.lit(turn))
    chosen = members.groupBy("list").agg(F.min_by(F.struct("sig", "n", "root"), order).alias("rep"))
    pairs = members.join(chosen, "list").select("sig", "n", "root", F.col("rep.sig").alias("other"), F.col("rep.n").alias("m"), F.col("rep.root").alias("at"))
    near = least[0] * F.greatest("n", "m") <= least[1] * F.least("n", "m")
    return pairs.where((F.col("root") != F.col("at")) & near).select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b")).distinct()


def _cells(rows: DataFrame, by: str, size: Column, most: int) -> DataFrame:
    """rows in cells (x, y) of each value of `by`, such that any two meet in one; own: the row's part. A value with sizes up to `most` is one cell."""
    total = rows.groupBy(by).agg(F.sum(size).alias("size"))
    own = rows.join(total, by).withColumn("cells", F.when(F.col("size") <= most, 1).otherwise(F.ceil(2 * F.col("size") / most)).cast("int"))
    dealt = own.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "cells", "size")


def candidate_forest(members: DataFrame, names: DataFrame, most: int = 1024, least: tuple[int, int] = LEAST) -> DataFrame:
    """(a, b), a < b: edges that join all sets of a list that are of different groups and whose bitmaps allow the similarity.

    A list, or a cell of a large one, gives less edges than it has members.
    """
    dealt = _cells(members, "list", F.lit(1), most).join(names.select("sig", "bits"), "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, found = batch.column("members"), [np.zeros((2, 0), np.int64)]
            flat, ends = column.values, column.offsets.to_numpy().tolist()
            sig, n, root, own = (flat.field(c).to_numpy() for c in ("sig", "n", "root", "own"))
            bits = flat.field("bits")
            crosses = (batch.column("x").to_numpy() != batch.column("y").to_numpy()).tolist()
            for a, b, cross in zip(ends, ends[1:], crosses):
                order = a + np.argsort(sig[a:b])  # lists with the same members give the same edges
                maps = _Bitmaps([bits[i].as_py() for i in order.tolist()], n[order], least)
                group, part = root[order], own[order]
                apart = lambda i, js: maps.near(i, js[(group[js] != group[i]) & ((part[js] != part[i]) | (not cross))])  # noqa: B023, E731
                pairs = np.array(spanning(np.arange(b - a), apart), np.int64).reshape(-1, 2).T
                found.append(sig[order][pairs])
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    lists = dealt.groupBy("list", "x", "y").agg(F.collect_list(F.struct("sig", "n", "root", "own", "bits")).alias("members"))  # about `most` at most
    return lists.select("x", "y", "members").mapInArrow(run, "a long, b long").distinct()


def _texts(need: DataFrame, docs: DataFrame, text: str, few: int) -> DataFrame:
    """(sig, text) as a table: a text of each set of need (sig, th). The list of texts needed is broadcast only up to `few` rows."""
    wanted = need.select("th", "sig")
    wanted = F.broadcast(wanted) if need.count() <= few else wanted.hint("merge")
    return write_table(_named(docs, text, text).select("th", "text").join(wanted, "th").select("sig", "text").dropDuplicates(["sig"]), "nearcopies-texts")


def similar_forest(block: pa.Table, words: int, least: tuple[int, int]) -> pa.Table:
    """(a, b): edges that join all sets of a cell (x, y, sig, root, own, text) whose similarity is at least `least`, less than the cell has rows."""
    (up, down), known = least, _WordHashes()
    sig, root, own = (block.column(c).to_numpy() for c in ("sig", "root", "own"))
    cross = block.column("x")[0].as_py() != block.column("y")[0].as_py()
    sets = [shingle_set(x.as_py(), words, known) for x in block.column("text")]
    n = np.array([len(x) for x in sets], np.int64)
    maps = _Bitmaps([bitmap(x) for x in sets], n, least)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(n)
    marked = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    each = [codes[b - k : b] for b, k in zip(ends.tolist(), n.tolist())]

    def near(i: int, js: np.ndarray) -> np.ndarray:
        js = maps.near(i, js[own[js] != own[i]] if cross else js)
        if not len(js):
            return js
        marked[each[i]] = True
        both = sums(marked[np.concatenate([each[j] for j in js.tolist()])].astype(np.int64), n[js])
        marked[each[i]] = False
        return js[down * both >= up * (n[i] + n[js] - both)]

    edges = np.array(spanning(np.unique(root, return_inverse=True)[1], near), np.int64).reshape(-1, 2).T
    return pa.table({"a": sig[edges[0]], "b": sig[edges[1]]})


def similar_in_blocks(blocks: DataFrame, roots: DataFrame, docs: DataFrame, names: DataFrame, *, text: str = "text", words: int = 5, least: tuple[int, int] = LEAST, most_bytes: int = 8 << 20, few: int = 2_000_000) -> DataFrame:
    """(a, b): edges that join all similar sets of a block; blocks: (node, root), each set in one; roots: the groups known already.

    A task's group is a cell of about most_bytes of text at most.
    """
    need = write_table(blocks.select(F.col("node").alias("sig"), F.col("root").alias("block")).join(names.select("sig", "th"), "sig"), "nearcopies-need")
    held = _texts(need, docs, text, few)
    group = roots.select(F.col("node").alias("sig"), F.col("root").alias("group"))
    rows = need.select("sig", "block").join(group, "sig", "left").select("sig", "block", F.coalesce("group", "sig").alias("root"))
    rows = rows.join(held.select("sig", F.octet_length("text").cast("long").alias("bytes")), "sig")
    dealt = _cells(rows, "block", F.col("bytes"), most_bytes).join(held, "sig").select("block", "x", "y", "sig", "root", "own", "text")
    found = write_table(dealt.groupBy("block", "x", "y").applyInArrow(lambda t: similar_forest(t, words, least), "a long, b long"), "nearcopies-similar")
    drop_tables(need, held)
    return found


def similar(pairs: DataFrame, docs: DataFrame, names: DataFrame, *, text: str = "text", words: int = 5, least: tuple[int, int] = LEAST, few: int = 2_000_000) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is at least `least`; names: (sig, n, th)."""
    up, down = least
    need = write_table(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(names.select("sig", "th"), "sig"), "nearcopies-need")
    held = _texts(need, docs, text, few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets = _WordHashes(), {}
        for batch in slices(slices(batches, "x", SLICE), "y", SLICE):
            keep = []
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "x", "y")]
            for a, b, x, y in zip(*columns):
                if len(sets) > 256 or len(known) > 200_000:
                    known, sets = _WordHashes(), {}
                one, two = (sets[k] if k in sets else sets.setdefault(k, shingle_set(t, words, known)) for k, t in ((a, x), (b, y)))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(down * both >= up * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = held.select(F.col("sig").alias("a"), F.col("text").alias("x")), held.select(F.col("sig").alias("b"), F.col("text").alias("y"))
    texts = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    found = write_table(map_texts(texts, run, "a long, b long"), "nearcopies-similar")
    drop_tables(need, held)
    return found


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, least: tuple[int, int] = LEAST, most: int = 128, sample: int = 20_000, stars: int = 1) -> DataFrame:
    """(doc_id, component_id), one row for each row of docs: documents linked by near copies, by op7's fingerprints, or both."""
    frequent = frequent_shingles(docs, text=text, words=words, sample=sample)
    rows = write_table(described(docs, frequent, key=key, text=text, words=words, least=least), "nearcopies-rows")
    names = write_table(rows.groupBy("sig").agg(F.min("n").alias("n"), F.min("th").alias("th"), F.first("bits").alias("bits")), "nearcopies-names")
    covered = write_table(rows.select("fp", "sig").distinct(), "nearcopies-covered")
    named = write_table(covered.groupBy("fp").agg(F.min("sig").alias("rep")), "nearcopies-rep")
    near = simhash.links(named.select("fp"))
    a, b = named.select(F.col("fp").alias("a"), F.col("rep").alias("x")), named.select(F.col("fp").alias("b"), F.col("rep").alias("y"))
    by_bits = near.join(a, "a").join(b, "b").select("x", "y").union(covered.join(named, "fp").select("sig", "rep")).where("x <> y").toDF("a", "b")
    edges = write_table(by_bits, "nearcopies-edges")
    drop_tables(covered, named)

    left = shared_lists(rows, most=most)
    for turn in range(stars + 1):
        roots = write_table(simhash.components(edges), "nearcopies-roots")
        still = _open_members(left, names.select("sig", "n"), roots)
        drop_tables(left)
        pairs = write_table(star_pairs(still, turn, least) if turn < stars else candidate_forest(still, names, 8 * most, least), "nearcopies-pairs")
        left = still.select("list", "sig")
        left._written = still._written
        if not pairs.isEmpty():
            if turn < stars:
                found = similar(pairs, docs, names, text=text, words=words, least=least)
            else:
                blocks = write_table(simhash.components(pairs), "nearcopies-blocks")
                found = similar_in_blocks(blocks, roots, docs, names, text=text, words=words, least=least)
                drop_tables(blocks)
            more = write_table(roots.where("node <> root").toDF("a", "b").union(found), "nearcopies-edges")  # groups found before are stars now
            drop_tables(edges, found)
            edges = more
        drop_tables(pairs, roots)
    drop_tables(left)
    roots = write_table(simhash.components(edges), "nearcopies-roots")
    drop_tables(edges)
    rooted = rows.select("doc_id", "sig").join(roots, F.col("sig") == F.col("node"), "left").select("doc_id", F.coalesce("root", "sig").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(firsts, "root").select("doc_id", "component_id")


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, least: tuple[int, int] = LEAST, most: int = 128, sample: int = 20_000) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with the columns of docs; rows with a null key stay, as in simhash.keep_first."""
    found = groups(docs, key=key, text=text, words=words, least=least, most=most, sample=sample)
    name = field(docs.schema, "_gone")
    gone = write_table(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "nearcopies-gone")
    return docs.join(gone, docs[key].cast("long") == gone[name], "left_anti")
