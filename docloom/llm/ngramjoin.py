"""N-gram Jaccard join of documents, as connected components, by prefix filtering and tries.

Documents with equal n-gram sets form one class; all later work is on classes. The n-grams have one
global order, rare first (by a fixed-size sketch of counts over all documents, then by hash). Two sets
that link must share an n-gram of their prefixes, so classes meet in the posting lists of prefix n-grams.

No list is paired out. All lists with the same middle class (the one in most lists) form a group, of the
classes in any of them. A group's classes are dealt over blocks by set size, and within a size at random, of about ``GROUP``
classes or ``GRAMS`` n-grams, whichever is reached first; only blocks whose sizes can link meet. First
the prefixes of a block go into a trie, in which those of the other are looked up: classes that share too few prefix
n-grams with every other are dropped, and only the rest have their whole sets made. A large group's classes are
then dealt out at random, twice, and each block gives only the links that connect it; so large groups of copies grow
together at the cost of shipping each set once a turn. Last the group is finished in pairs of blocks, but for pairs
within its largest component: each two classes of a list are compared once there, unless they are already
connected. So the components are exact, and no task holds more than two blocks.

A trie holds sets from the end of the global order, most frequent n-grams first. It is walked
depth first: sets with a common beginning share its partial overlap with the sets that are looked up, and
a subtree is pruned at its branch when what remains of its sets, or of those looked up, can't reach the overlap that
a link needs.

N-grams are told apart by 64-bit hashes, classes by 128 bits.

Edge cases: texts without words are empty and linked with nothing; null texts too. Repeated rows are equal
sets. Very long texts count whole; one text's n-grams stay together. A null doc_id stays null and is never a component's
id unless the component has no other. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, chosen, drop, only, save, scratch, texts_of, trimmed
from .components import components
from .wordhash import U, mix, shingle_sets, word_batches

COUNTERS = 1 << 20
PIECE = 1 << 16
GROUP = 256
GRAMS = 1 << 20
CELLS = 1 << 21  # of a walk's tables
BLOCK_TURNS = 2
SALTS = 16
NO_ID = np.iinfo(np.int64).max


def class_halves(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit key of each set of hashed n-grams, as two numbers; an empty set's is zero."""
    keys = np.zeros((len(sets), 2), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if some := np.flatnonzero(sizes).tolist():
        grams, starts = np.concatenate([sets[i] for i in some]), np.cumsum(sizes[some]) - sizes[some]
        for place, salt in enumerate((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)):
            keys[some, place] = mix(np.add.reduceat(mix(grams * U(salt) + U(place)), starts) + sizes[some].astype(np.uint64))
    return keys


def class_keys(sets: list[np.ndarray]) -> list[bytes]:
    return [k.tobytes() for k in class_halves(sets).astype(">u8")]


def class_of(high: str, low: str) -> Column:
    """The key of two halves."""
    return F.unhex(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


ROWS = "doc_id long, row binary, class binary, n int, piece int, counts binary"
ROWS_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("class", pa.binary()), ("n", pa.int32()), ("piece", pa.int32()), ("counts", pa.binary())])


def _classes(k: int):
    """Each row's class and size; then the sketch of this task's n-grams, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        sketch = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for i, words, at in word_batches(texts_of(b.column(1))):
                sets = shingle_sets(words, at, k)
                n = len(sets)
                sketch += np.bincount((np.concatenate(sets) & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                yield batch(ROWS_ARROW, doc_id=b.column(0).slice(i, n), row=b.column(2).slice(i, n), **{"class": class_keys(sets)}, n=[len(s) for s in sets], piece=pa.nulls(n), counts=pa.nulls(n))
        for p in range(COUNTERS // PIECE):
            part = sketch[p * PIECE : (p + 1) * PIECE]
            if part.any():
                yield batch(ROWS_ARROW, doc_id=[None], row=[None], **{"class": [None]}, n=[None], piece=[p], counts=[np.minimum(part, 2**31 - 1).astype("<u4").tobytes()])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up sketch pieces in any order; a task holds one sum a piece."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for piece, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
            sums[piece] = sums[piece] + part if piece in sums else part
    for piece, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.minimum(part, 2**31 - 1).astype("<u4").tobytes()], pa.binary())], names=["piece", "counts"])


def prefix(n, num: int, den: int):
    """How many of a set's n first n-grams every set that links with it must share one of: n - ceil(n * num / den) + 1."""
    return n + (-num * n // den) + 1


POSTINGS_ARROW = pa.schema([("gram", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int32())])


def first_grams(grams: np.ndarray, many: int, counts: np.ndarray) -> np.ndarray:
    """The ``many`` first n-grams of a set, given in order of hash, in the global order: by count, then by hash."""
    if many >= len(grams):
        return grams
    rank = counts[(grams & U(COUNTERS - 1)).astype(np.int64)]
    last = np.partition(rank, many - 1)[many - 1]
    before = np.flatnonzero(rank < last)
    return grams[np.concatenate([before, np.flatnonzero(rank == last)[: many - len(before)]])]


def _postings(k: int, sketch, num: int, den: int):
    """The prefix n-grams of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        counts = np.frombuffer(sketch.value, "<u4")
        for b in batches:
            for _, words, at in word_batches(texts_of(b.column(0))):
                sets = [s for s in shingle_sets(words, at, k) if len(s)]
                if sets:
                    first = [first_grams(s, prefix(len(s), num, den), counts) for s in sets]
                    times = [len(f) for f in first]
                    high, low = np.repeat(class_halves(sets).view(np.int64), times, axis=0).T
                    yield batch(POSTINGS_ARROW, gram=np.concatenate(first).view(np.int64), high=high, low=low, n=np.repeat(np.array([len(s) for s in sets], np.int32), times))

    return run


FILTER_BITS = 1 << 24  # of the filter of ids whose sets are made, whatever the input


def filter_places(id: str) -> Column:
    return F.array(*(F.pmod(F.xxhash64(id, F.lit(salt)), F.lit(FILTER_BITS)).cast("int") for salt in (1, 2)))


def id_filter(wanted: DataFrame) -> bytes:
    """A Bloom filter of ids (doc_id) of ``FILTER_BITS`` bits."""
    at = F.explode(filter_places("doc_id")).alias("at")
    some = wanted.select(at).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    bits = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in some.collect():  # at most as many rows as the filter has buckets
        bits[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return bits.tobytes()


def _filtered(found):
    """Rows (doc_id, text, at) whose places are all set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        bits = np.frombuffer(found.value, np.uint8)
        for b in batches:
            at = b.column(2).flatten().to_numpy().reshape(-1, 2)
            hit = (bits[at >> 3] >> (at & 7) & 1).all(axis=1)
            yield b.select(["doc_id", "text"]).filter(pa.array(hit))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        for b in batches:
            for _, words, at in word_batches(texts_of(b.column(0))):
                sets = shingle_sets(words, at, k)
                yield pa.RecordBatch.from_arrays([pa.array(class_keys(sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "grams"])

    return run


def needed(n, m, num: int, den: int):
    """The least overlap o of sets of sizes n and m with den * o >= num * (n + m - o)."""
    return -(-num * (n + m) // (num + den))


class Trie:
    """Sets of hashed n-grams in a trie, from the end of the global order, laid out depth first.

    A set keeps only what it doesn't share with the set before it; ``shared`` says how much that one has. ``counts`` is
    the sketch that the global order goes by.
    """

    def __init__(self, sets: list[np.ndarray], counts: np.ndarray) -> None:
        self.every, place = np.unique(np.concatenate(sets), return_inverse=True)
        by_rank = np.lexsort((self.every, counts[(self.every & U(COUNTERS - 1)).astype(np.int64)]))[::-1]
        self.rank = np.empty(len(self.every), np.int64)
        self.rank[by_rank] = np.arange(len(self.every))
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        paths = [np.sort(p) for p in np.split(self.rank[place], cuts)]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">i8").tobytes())
        self.grams = self.every[by_rank]
        self.paths = [paths[i] for i in self.order]
        self.shared = [0]
        for before, path in zip(self.paths, self.paths[1:], strict=False):
            m = min(len(before), len(path))
            differ = np.flatnonzero(before[:m] != path[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)

    def reach(self, asked: list[np.ndarray], least: np.ndarray) -> np.ndarray:
        """For each set (a row) and each of ``asked`` (a column), whether they share at least ``least`` n-grams.

        One walk for as many of ``asked`` as ``CELLS`` lets it: a node holds the partial overlaps with all of them.
        """
        step = max(1, CELLS // (len(self.grams) + 1))
        return np.concatenate([self._walk(asked[i : i + step], least[:, i : i + step]) for i in range(0, len(asked), step)], axis=1)

    def _walk(self, asked: list[np.ndarray], least: np.ndarray) -> np.ndarray:
        held = np.zeros((len(self.grams), len(asked)), np.int32)
        for column, grams in enumerate(asked):
            at = np.minimum(np.searchsorted(self.every, grams), len(self.every) - 1)
            held[self.rank[at[self.every[at] == grams]], column] = 1
        left = np.cumsum(held[::-1], axis=0, dtype=np.int32)[::-1]  # of each of asked, from a rank on
        shared, lengths = np.array([*self.shared, 0]), np.array([len(p) for p in self.paths])
        need = least[self.order]
        sums = np.zeros((int(lengths.max()) + 1, len(asked)), np.int32)
        found = np.zeros(need.shape, bool)
        i, known = 0, 0  # the partial overlaps of the last path's first ``known`` n-grams stand in sums
        while i < len(self.paths):
            path, at = self.paths[i], min(known, int(shared[i]))
            known = at
            rest = len(path) - at
            bound = left[path[at]] if rest else 0
            if (sums[at] + np.minimum(rest, bound) >= need[i]).any():
                sums[at + 1 : len(path) + 1] = sums[at] + np.cumsum(held[path[at:]], axis=0, dtype=np.int32)
                known = len(path)
                found[i] = sums[known] >= need[i]
                i += 1
                continue
            # all sets that go on as this one does from here: gone at once, if the longest can't reach the least
            end = i + 1 + int(np.argmax(shared[i + 1 :] <= at))
            if end > i + 1 and not (sums[at] + np.minimum(int(lengths[i:end].max()) - at, bound) >= need[i:end].min(axis=0)).any():
                i = end
            else:
                i += 1
        out = np.empty_like(found)
        out[self.order] = found
        return out

    def linked(self, pivot: np.ndarray, num: int, den: int) -> list[int]:
        """Numbers of the sets that link with ``pivot``."""
        at = np.minimum(np.searchsorted(pivot, self.grams), len(pivot) - 1)
        held = (pivot[at] == self.grams).astype(np.int64)
        left = np.concatenate([np.cumsum(held[::-1])[::-1], [0]])  # of the pivot, from a rank on
        found, sums, m = [], np.zeros(1, np.int64), len(pivot)
        i, n = 0, len(self.paths)
        while i < n:
            path, shared = self.paths[i], self.shared[i]
            here = int(sums[shared])  # the overlap that the shared beginning already has
            # at the branch point: at best all that remains of the set, or of the pivot below this gram, is shared
            rest = min(len(path) - shared, int(left[path[shared]]) if shared < len(path) else 0)
            if here + rest >= needed(len(path), m, num, den):
                sums = np.concatenate([sums[: shared + 1], here + np.cumsum(held[path[shared:]])])
                if sums[-1] >= needed(len(path), m, num, den):
                    found.append(self.order[i])
                i += 1
                continue
            # nothing that begins like this set as far as ``shared + 1`` can link unless it is shorter or longer than it
            sums = sums[: shared + 1]
            i += 1
            while i < n and self.shared[i] > shared:
                deep = self.paths[i]
                if here + min(len(deep) - shared, int(left[deep[shared]])) >= needed(len(deep), m, num, den):
                    sums = np.concatenate([sums, here + np.cumsum(held[deep[shared : self.shared[i]]])])
                    break
                i += 1
        return found


LINKS = "a binary, b binary"
LINKS_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary())])


class Parts:
    """Connected parts of the numbers below n, beginning with equal labels."""

    def __init__(self, labels: list[int]) -> None:
        self.of = list(labels)
        self.members: dict[int, list[int]] = {}
        for i, label in enumerate(labels):
            self.members.setdefault(label, []).append(i)

    def join(self, i: int, j: int) -> bool:
        few, many = sorted((self.of[i], self.of[j]), key=lambda x: len(self.members[x]))
        if few == many:
            return False
        for m in self.members[few]:
            self.of[m] = many
        self.members[many] += self.members.pop(few)
        return True


def _connect(num: int, den: int, sketch, all_pairs: bool):
    """Links that connect the classes of a block, or of a pair of blocks (own = first, own = second).

    Without ``all_pairs``, classes in the largest part are looked up no more once it has grown.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        only("powers")
        ids, own = rows["class"].to_pylist(), rows["own"].to_numpy()
        parts, links = Parts(rows["label"].to_pylist()), []
        if len(parts.members) > 1 and own.min() == key[1].as_py() and own.max() == key[2].as_py():
            sets = [np.frombuffer(x, np.uint64) for x in rows["grams"].to_pylist()]
            right = np.flatnonzero(own == key[2].as_py()).tolist()
            trie = Trie([sets[i] for i in right], np.frombuffer(sketch.value, "<u4"))
            # those in the middle first
            for i in sorted(np.flatnonzero(own == key[1].as_py()).tolist(), key=lambda i: (rows["rank"][i].as_py(), ids[i])):
                if len(parts.members) == 1:
                    break
                mine = parts.members[parts.of[i]]
                if not all_pairs and links and len(mine) == max(map(len, parts.members.values())):
                    continue
                if len(mine) >= len(right) and all(parts.of[j] == parts.of[i] for j in right):
                    continue
                for j in trie.linked(sets[i], num, den):
                    if parts.join(i, right[j]):
                        links.append((ids[i], ids[right[j]]))
        return pa.Table.from_arrays([pa.array([x[c] for x in links], pa.binary()) for c in (0, 1)], schema=LINKS_ARROW)

    return run


def _could_link(num: int, den: int, sketch):
    """Classes of a pair of blocks that may link with another, by how many prefix n-grams two of them share.

    Of two sets that link, take the one whose prefix ends first in the global order: all that its prefix shares with
    the other set is in the other's prefix, and at most n - overlap of its n-grams are not shared.
    """
    never = np.iinfo(np.int32).max

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        only("powers")
        ids, n, own = rows["class"].to_pylist(), rows["n"].to_numpy().astype(np.int64), rows["own"].to_numpy()
        left, right = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        kept = rows.select(["mid", "class", "rank", "n"])
        if not len(left) or not len(right) or (len(left) == 1 and ids[left[0]] == ids[right[0]] and len(right) == 1):
            return kept.slice(0, 0)
        grams = [np.sort(x.values.to_numpy().view(np.uint64)) for x in rows["grams"]]
        a, b = n[right][:, None], n[left][None]
        least = np.maximum(needed(a, b, num, den) + np.minimum(np.minimum(prefix(a, num, den), a) - a, np.minimum(prefix(b, num, den), b) - b), 1)
        number = np.unique(np.array(ids, object), return_inverse=True)[1]
        least[(a * den < b * num) | (b * den < a * num) | (number[right][:, None] == number[left][None])] = never
        good = Trie([grams[i] for i in right], np.frombuffer(sketch.value, "<u4")).reach([grams[i] for i in left], least)
        return kept.take(pa.array(np.union1d(left[good.any(axis=0)], right[good.any(axis=1)])))

    return run


def blocks_of(classes: Column, grams: Column) -> Column:
    """How many blocks so many classes and n-grams are dealt over."""
    return F.ceil(F.greatest(classes / GROUP, grams / GRAMS)).cast("int")


KIND_BLOCKS = 1 << 20  # the blocks of the second kind are numbered from here


def deal(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``rows`` (mid, kind, class, n and more) with own, i and j: cells (mid, i, j) in which classes of blocks i and j meet.

    Every two classes of a group whose sizes can link meet in one cell, unless both are of kind 1. A group of one block
    is one cell of a kind; a larger one's blocks are by size, in steps so wide that sizes that link are a step apart at most.
    """
    width = max(math.log(den / num) * 1.0001, 1e-3)
    rows = rows.withColumn("s", F.floor(F.log("n") / width).cast("int"))
    whole, ordered = Window.partitionBy("mid"), Window.partitionBy("mid", "kind").orderBy("s")  # over a row a size, not a class
    sizes = rows.groupBy("mid", "kind", "s").agg(F.count("*").alias("c"), F.sum("n").alias("g"))
    large = blocks_of(F.sum("c").over(whole), F.sum("g").over(whole)) > 1
    sizes = sizes.withColumn("large", large).withColumn("blocks", F.when(F.col("large"), blocks_of(F.col("c"), F.col("g"))).otherwise(1))
    high = F.when(F.col("large"), F.sum("blocks").over(ordered)).otherwise(1).cast("int") + F.col("kind") * KIND_BLOCKS
    sizes = sizes.withColumn("high", high).withColumn("low", F.col("high") - F.col("blocks"))
    near = lambda side, column: F.when(side("s").over(ordered) - F.col("s") == (1 if side is F.lead else -1), side(column).over(ordered))
    sizes = sizes.withColumns({"first": F.coalesce(near(F.lag, "low"), "low"), "end": F.coalesce(near(F.lead, "high"), "high")})
    step = F.explode(F.when(F.col("large"), F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)).otherwise(F.sequence(F.lit(0), F.lit(0))))
    others = sizes.select("mid", "large", (1 - F.col("kind")).alias("kind"), step.alias("t"), "low", "high")
    others = others.groupBy("mid", "kind", "t").agg(F.min("low").alias("other_first"), F.max("high").alias("other_end"))
    at = F.when(F.col("large"), F.col("s")).otherwise(0)
    sizes = sizes.withColumn("t", at).join(others, ["mid", "kind", "t"], "left").select("mid", "kind", "s", "blocks", "low", "first", "end", "other_first", "other_end")
    none = F.array().cast("array<int>")
    mine = F.when(F.col("kind") == 0, F.sequence(F.col("first"), F.col("end") - 1)).otherwise(none)
    theirs = F.when(F.col("other_first").isNotNull(), F.sequence(F.col("other_first"), F.col("other_end") - 1)).otherwise(none)
    own = F.col("low") + F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, ["mid", "kind", "s"]).withColumns({"own": own, "other": F.explode(F.concat(mine, theirs))})
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("s", "blocks", "low", "first", "end", "other_first", "other_end", "other", "kind")


def candidates(lists: DataFrame, num: int, den: int, sketch) -> DataFrame:
    """(mid, class, rank, n): groups by lists' middle class, less the classes that can't link within theirs."""
    short = lists.groupBy("class").agg(F.first("rank").alias("rank"), F.collect_list("gram").alias("grams"))
    mids = lists.groupBy("gram").agg(F.min(F.struct("rank", "class")).alias("m")).select("gram", F.col("m.class").alias("mid"))
    groups = lists.select("gram", "class", "n").join(mids, "gram").select("mid", "class", "n").distinct()
    dealt = deal(groups.withColumn("kind", F.lit(0)), num, den).join(short, "class")
    return dealt.groupBy("mid", "i", "j").applyInArrow(_could_link(num, den, sketch), "mid binary, class binary, rank long, n int").distinct()


def connect_blocks(groups: DataFrame, sets: DataFrame, turn: int, num: int, den: int, sketch) -> DataFrame:
    """Links found within random blocks of each of ``groups`` (mid, class, label, rank, n)."""
    sizes = groups.groupBy("mid").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("class", F.lit(turn)), F.col("blocks")).cast("int")
    dealt = groups.join(sizes, "mid").select("mid", block.alias("i"), block.alias("j"), block.alias("own"), "class", "label", "rank")
    return dealt.join(sets, "class").groupBy("mid", "i", "j").applyInArrow(_connect(num, den, sketch, False), LINKS)


def finish(groups: DataFrame, sets: DataFrame, num: int, den: int, sketch) -> DataFrame:
    """Links between classes of different labels of each of ``groups``, from all pairs of its blocks but those of its largest label."""
    labels = groups.groupBy("mid", "label").agg(F.count("*").alias("c"))
    tops = labels.groupBy("mid").agg(F.sum("c").alias("c"), F.max(F.struct("c", "label")).alias("top")).where("c > top.c").select("mid", F.col("top.label").alias("top"))
    salt = F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")  # a group with most of all classes is spread
    tops = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = groups.withColumn("salt", salt).join(tops, ["mid", "salt"]).withColumn("kind", F.when(F.col("label") == F.col("top"), 1).otherwise(0)).drop("top", "salt")
    dealt = deal(rows, num, den).select("mid", "i", "j", "own", "class", "label", "rank")
    return dealt.join(sets, "class").groupBy("mid", "i", "j").applyInArrow(_connect(num, den, sketch, True), LINKS)


def joined(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, class, n) of each row of ``docs`` (doc_id, text, row), and (class, least) with the first
    (doc_id, row) of the class's component; a null doc_id comes last, as ``NO_ID``."""
    spark = docs.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch(spark, name))
        return save(df, paths[-1])

    first = kept(docs.mapInArrow(trimmed(_classes(k)), ROWS), "join-rows")
    rows = first.where(F.col("class").isNotNull()).select("doc_id", "row", "class", "n")
    pieces = first.where(F.col("piece").isNotNull()).select("piece", "counts")
    whole = np.zeros((COUNTERS // PIECE, PIECE), np.int64)
    for r in pieces.repartition("piece").mapInArrow(_merge, "piece int, counts binary").toLocalIterator():
        whole[r["piece"]] += np.frombuffer(r["counts"], "<u4")
    sketch = spark.sparkContext.broadcast(np.minimum(whole, 2**31 - 1).astype("<u4").tobytes())  # COUNTERS numbers, whatever the input

    postings = kept(docs.select("text").mapInArrow(trimmed(_postings(k, sketch, num, den)), "gram long, high long, low long, n int"), "postings")
    # lists of more than one class; of two classes within a list half the key tells them apart
    several = postings.groupBy("gram").agg(F.min("high").alias("least"), F.max("high").alias("most")).where("least < most").select("gram")
    lists = postings.join(several.hint("merge"), "gram", "left_semi").distinct()  # it grows with the input: never broadcast
    lists = kept(lists.select("gram", class_of("high", "low").alias("class"), "n"), "lists")
    drop(spark, paths[1])
    # a class that shares much of its prefix is near the middle of its group: such make the best pivots
    shares = lists.groupBy("class").agg((-F.count("*")).alias("rank"))
    lists = kept(lists.join(shares, "class").select("gram", "class", "n", "rank"), "lists")
    groups = kept(candidates(lists, num, den, sketch), "groups")
    members = rows.where("n > 0").groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "row")).alias("first"))
    # only texts that a small filter lets through are shuffled by id; whole sets are made of those asked for
    wanted = kept(groups.select("class").distinct().join(members, "class").select(F.nullif("first.doc_id", F.lit(NO_ID)).alias("doc_id")).distinct(), "wanted")
    found = spark.sparkContext.broadcast(id_filter(wanted))
    texts = docs.select("doc_id", "text", filter_places("doc_id").alias("at")).mapInArrow(trimmed(_filtered(found)), "doc_id long, text string")
    texts = texts.join(wanted.hint("merge"), texts.doc_id.eqNullSafe(wanted.doc_id), "left_semi").select("text")
    blocks = groups.groupBy("mid").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks")).where("blocks > 1")
    spread = kept(groups.join(blocks, "mid").select("class").distinct().withColumn("large", F.lit(True)), "spread")
    large = not spread.isEmpty()
    made = texts.mapInArrow(trimmed(_sets(k)), "class binary, grams binary").groupBy("class").agg(F.first("grams").alias("grams"))
    sets = kept(made.join(spread, "class", "left"), "sets")  # of large groups' classes marked, as only theirs take turns
    labels = groups.select(F.col("class").alias("node"), F.col("class").alias("label")).distinct()
    for turn in range(BLOCK_TURNS + 1 if large else 1):
        labelled = groups.join(labels.withColumnRenamed("node", "class"), "class")
        if turn < BLOCK_TURNS and large:
            links = connect_blocks(labelled, sets.where("large").drop("large"), turn, num, den, sketch)
        else:
            links = finish(labelled, sets.drop("large"), num, den, sketch)
        links = kept(links, "found")
        of = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        edges = links.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        merged, made = components(edges)
        paths += made
        higher = merged.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = kept(labels.join(higher, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")

    grouped = members.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    best = grouped.groupBy("label").agg(F.min("first").alias("least"))
    of_class = kept(grouped.join(best, "label").select("class", "least"), "components")
    drop(spark, *[p for p in paths if p not in (paths[0], paths[-1])])
    return rows, of_class


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text), in no order.

    Documents link when ``den * |A & B| >= num * |A | B|`` for their sets of ``k``-word shingles.
    """
    rows, of_class = joined(chosen(docs).withColumn("row", F.lit(None).cast("binary")), k, num, den)
    least = F.nullif("least.doc_id", F.lit(NO_ID))
    return rows.join(of_class, "class", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, least).otherwise(F.col("doc_id")).alias("component_id"))


def row_key(id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of a row's id and text, a null told from all values."""
    shown = F.concat(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("?")), F.when(F.col(f"`{text}`").isNull(), "-").otherwise("+"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    return F.unhex(F.md5(shown.cast("binary")))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without all but one row of each component: that of the smallest id, of one id that of the smallest key of its text.

    Rows are told apart by id and text, so of rows under one id each goes by its own text. Of rows with equal id and text one
    stays, the first by a hash of all other columns. Empty and null texts have no copies but rows of their own id.
    """
    named = docs.withColumn("_row", row_key())
    rows, of_class = joined(named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_row").alias("row")), k, num, den)
    stay = of_class.select(F.col("least.row").alias("_row")).union(rows.where("n = 0").select("row")).distinct()
    hashed = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = F.row_number().over(Window.partitionBy("_row").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in hashed))))
    single = named.withColumn("_nth", order).where(F.col("_nth") == 1).drop("_nth")
    return single.join(stay, "_row", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
