"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The order is that of the n-gram hashes. It is cut into fragments; every set falls into one segment a
fragment.

1. Candidates. Two sets that differ in at most D n-grams agree wholly in all but D fragments, so with
   more than D fragments some segment is equal. Sets are classed by size, D follows from the class
   and the threshold, and the segments' hashes are the only thing that is shuffled. Each key links its
   sets to the smallest of them (a star, first within the map task, then over all tasks): no pairs.
   Components of these stars are families; every qualifying pair lies inside one family.
2. Counting. Each family is cut into blocks of bounded size. The family's leader (the set that shares most
   keys) goes to all of its blocks, every other set to one. In a block n-grams are told apart by their
   words, their order is cut again, and for each fragment the overlaps of all pairs are counted on their own
   (a matrix product of segments), and summed per pair. Exact sizes and overlaps decide the links; a block
   returns a spanning forest of its links, and each set's distance from the leader.
   What a block links to the leader is one component wherever it is. The other sets are open. Jaccard
   distance is a metric: an open set that is too far from the leader for a link to any of its component is
   left to the next round, where the far ones have a leader of their own. The rest are near ones. Written as
   differences from the leader, an open set and any partner share so many n-grams that the rarest few of
   one's and of the other's have one in common: near sets are held, in slices, against the sets that they
   meet in such an n-gram, directly or through others, and are done if there are none.
3. Components of the links, in DataFrames.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .hashing import Words, digest64, mix64, window_hash
from .shared import drop_finished_shuffles, drop_table, prepare, spare_name, store, task_base, with_uid

#: Keys that linked sets of large classes share at least; a set with fewer shared keys has no link.
SUPPORT = 4
#: Keys that are shuffled at once, about, and in how many parts at most.
SLICE_ROWS, SLICES = 1 << 23, 8
_DOC, _KEY, _STAR, _NODE = 0, 1, 2, 3
_ROWS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])


def size_classes(percent: int, most: int = 1 << 40) -> tuple[list[int], list[int]]:
    """(lower bounds, D): sets whose larger one has bounds[i] <= size < bounds[i + 1] differ in D[i] n-grams at most.

    From 100 I >= p U: the difference U - I is at most (100 - p) (|x| + |y|) / (100 + p).
    """
    apart = lambda size: (100 - percent) * 2 * size // (100 + percent)
    first = 1
    while first < most and apart(first) < 1:
        first += 1
    bounds = [1, first] if first > 1 else [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2))
    return bounds, [apart(b - 1) for b in bounds[1:]]


def set_keys(grams: np.ndarray, size: int, hot: np.ndarray, percent: int, bounds: list[int], differ: list[int]) -> np.ndarray:
    """The candidate keys of one set of ``size`` n-grams by its hashes, free of the n-grams that very many sets hold.

    Sets that differ in at most D n-grams do so without their hot ones too. Sets that are mostly hot get
    keys of all their n-grams instead; where the two ways meet, a set gets both, as linked sets'
    shares of hot n-grams differ by little.
    """
    if not len(hot):
        return segment_keys(grams, size, 0, percent, bounds, differ)
    is_hot = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
    share, out = is_hot.mean(), []
    apart = (100 - percent) / percent
    if share <= 0.5:
        out.append(segment_keys(grams[~is_hot], size, 0, percent, bounds, differ))
    if share >= min(0.5 / (1 + apart), (0.5 - apart) / (1 - apart)) - 1e-9:
        out.append(segment_keys(grams, size, 1, percent, bounds, differ))
    return np.concatenate(out)


def segment_keys(grams: np.ndarray, size: int, way: int, percent: int, bounds: list[int], differ: list[int]) -> np.ndarray:
    """Keys of a set of ``size`` n-grams by its sorted, distinct hashes, or by a part of them that is chosen alike for all sets.

    The set's own class, and the next one if a larger partner may lie there. With ``spare`` fragments
    more than the class needs, linked sets agree in more than ``spare`` segments. The largest of those
    (by size, then place) is not among the ``spare`` smallest segments of either set, so these, which
    unlike sets may share by chance, need no key. In large classes ``SUPPORT`` - 1 keys more are given,
    so that linked sets share ``SUPPORT`` of them.
    """
    out = []
    own = int(np.searchsorted(bounds, size, side="right")) - 1
    for c in (own, own + 1):
        if c > own and 100 * size < percent * bounds[c]:
            break
        spare = differ[c] // 3 + support(differ[c]) if differ[c] else 0
        n = differ[c] + 1 + spare
        cuts = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
        at = np.concatenate(([0], np.searchsorted(grams, cuts), [len(grams)]))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(grams), dtype=np.uint64)))
        count = np.diff(at)
        keys = mix64((total[at[1:]] - total[at[:-1]]) ^ mix64(np.arange(n, dtype=np.uint64) + np.uint64(c << 32 | way << 31)) ^ (count.astype(np.uint64) << np.uint64(40)))
        keys = keys[np.argsort(count, kind="stable")[spare - (support(differ[c]) - 1) :]]
        out.append(keys)
    return np.concatenate(out)


def support(differ: int) -> int:
    """How many keys linked sets of a class share at least."""
    return SUPPORT if differ >= 3 * SUPPORT else 1


def gram_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each text's set of k-word n-grams as sorted hashes; fewer than k words make one n-gram of all of them."""
    grams = words.grams(k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(window_hash(words.hash[a:b], b - a)[:1] if b > a else np.zeros(0, np.uint64))
    return out


def word_numbers(texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The words of texts (words joined by one space; ``sizes``: how many) as numbers, equal only for equal words."""
    word = pc.split_pattern(pa.array(texts, pa.binary()), " ").flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return word[np.repeat(sizes > 0, np.maximum(sizes, 1))] if (sizes == 0).any() else word  # an empty text splits into one empty word


def exact_sizes(words: Words, sets: list[np.ndarray], plain: list[bytes], k: int) -> list[int]:
    """Distinct n-grams of each text by their words: hashes that n-grams of unlike words share are found by comparing each place with the hash's first one."""
    sizes = [len(s) for s in sets]
    place = np.flatnonzero(words.full(k))
    if not len(place):
        return sizes
    word = word_numbers(plain, np.diff(words.first))
    _, first, column = np.unique(words.grams(k)[place], return_index=True, return_inverse=True)
    unlike = np.zeros(len(place), bool)
    for j in range(k):
        unlike |= word[place + j] != word[place[first][column] + j]
    for d in np.unique(words.doc[place[np.isin(column, column[unlike])]]).tolist() if unlike.any() else ():
        at = np.arange(words.first[d], words.first[d + 1] - k + 1)
        sizes[d] = np.unique(np.stack([word[at + j] for j in range(k)]), axis=1).shape[1]
    return sizes


def _hot_counts(k: int, chunk: int = 4 << 20):
    """(n-gram, documents) of n-grams that three documents of a chunk hold, or more."""

    def count(sets):
        gram, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n > 2
        return pa.RecordBatch.from_arrays([pa.array(gram[often].view(np.int64)), pa.array(n[often], pa.int64())], names=["gram", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held += gram_sets(Words(b.column(0).to_pylist(), lower=True), k)
            size += sum(map(len, held[-b.num_rows :]))
            if size > chunk:
                yield count(held)
                held, size = [], 0
        if held:
            yield count(held)

    return run


def hot_grams(docs: DataFrame, k: int, least: int = 64, most: int = 1 << 18) -> np.ndarray:
    """The n-grams that most documents hold, counted over all of them: ``most`` at most (2 MB), each in over ``least``.

    Which n-grams are in it is of no matter to the result, only to its cost.
    """
    counted = docs.select("text").mapInArrow(_hot_counts(k), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > least).orderBy(F.desc("n"), "gram").limit(most).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(dtype=np.int64).view(np.uint64))


def _sketch(k: int, percent: int, hot):
    bounds, differ = size_classes(percent)

    def rows(kind, a, b, doc_id=None, n=None):
        size = len(a)
        none = pa.nulls(size, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none if doc_id is None else doc_id, none if n is None else pa.array(n, pa.int64())], schema=_ROWS)

    def run(batches):
        uid, seen, keys, owners, needs = task_base(), {}, [], [], []
        for batch in batches:
            words = Words(batch.column(1).to_pylist(), lower=True)
            sets = gram_sets(words, k)
            plain = [words.plain(i) for i in range(len(sets))]
            sizes = exact_sizes(words, sets, plain, k)
            uids = uid + np.arange(len(sets))
            entry = uids.copy()
            for i, s in enumerate(sets):
                if not len(s):
                    continue
                first = seen.setdefault(digest64(plain[i]), int(uids[i]))
                entry[i] = first
                if first == uids[i]:
                    keys.append(set_keys(s, sizes[i], hot.value, percent, bounds, differ))
                    owners.append(np.full(len(keys[-1]), first))
                    needs.append((first, support(differ[int(np.searchsorted(bounds, sizes[i], side="right")) - 1])))
            uid += len(sets)
            yield rows(_DOC, uids, entry, batch.column(0).cast(pa.int64()), sizes)
        if not keys:
            return
        key, owner = np.concatenate(keys).view(np.int64), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
        lead, met = owner[new][group], np.bincount(group)[group] > 1
        stars = np.unique(np.stack([lead[lead != owner], owner[lead != owner]]), axis=1)
        for i in range(0, stars.shape[1], 50_000):
            yield rows(_STAR, stars[0, i : i + 50_000], stars[1, i : i + 50_000])
        node, need = np.array(needs).T
        shared = np.bincount(np.searchsorted(node, owner[met]), minlength=len(node))
        for i in range(0, len(node), 50_000):
            part = slice(i, i + 50_000)
            yield rows(_NODE, node[part], shared[part], n=need[part])
        key, owner, met = key[new], owner[new], met[new]
        for i in range(0, len(key), 50_000):
            part = slice(i, i + 50_000)
            yield rows(_KEY, key[part], owner[part], n=met[part].astype(np.int64))

    return run


def gram_table(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of the distinct n-grams of each text, numbered from 0; equal numbers mean equal words.

    ``texts`` are words joined by one space. Hashes number the n-grams; then each occurrence's words are
    compared with those of the first one, and if any differ the words number them instead.
    """
    words = Words(texts)
    n, size = len(texts), np.diff(words.first)
    word = word_numbers(texts, size)
    place = np.flatnonzero(words.full(k))
    _, first, column = np.unique(words.grams(k)[place], return_index=True, return_inverse=True)
    if any((word[place + j] != word[place[first][column] + j]).any() for j in range(k)):
        _, column = np.unique(np.stack([word[place + j] for j in range(k)]), axis=1, return_inverse=True)
    column, owner = column.reshape(-1), words.doc[place]
    many = int(column.max()) + 1 if len(column) else 0
    short = {t: many + i for i, t in enumerate(sorted({texts[d] for d in np.flatnonzero((size < k) & (size > 0))}))}
    both = np.unique(owner * np.int64(max(1, many)) + column)
    few = [(d, short[texts[d]]) for d in np.flatnonzero((size < k) & (size > 0)).tolist()]
    owner, column = both // max(1, many), both % max(1, many)
    return np.concatenate([owner, [d for d, _ in few]]).astype(np.int64), np.concatenate([column, [c for _, c in few]]).astype(np.int64)


def overlaps(owner: np.ndarray, column: np.ndarray, n: int, left: int, fragment_cells: int = 8 << 20) -> np.ndarray:
    """Intersection sizes of the first ``left`` sets with all ``n``: the n-gram order is cut into fragments, each is counted on its own, and summed."""
    held = np.bincount(column, minlength=1)
    shared = held > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    total, width = np.zeros((left, n), np.float64), max(1, fragment_cells // n)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((n, min(width, int(shared.sum()) - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += part[:left] @ part.T
    return total.astype(np.int64)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for each member of a component of a symmetric boolean matrix, roots left out."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            new = np.flatnonzero(linked[front].any(axis=0) & left)
            left[new] = False
            out += [(root, int(m)) for m in new]
            front = new.tolist()
    return out


_FOUND = "u long, v long, family long, joined boolean, far double"
_FOUND_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("family", pa.int64()), ("joined", pa.bool_()), ("far", pa.float64())])
_DELTA = "family long, uid long, size long, token binary"
_DELTA_ARROW = pa.schema([("family", pa.int64()), ("uid", pa.int64()), ("size", pa.int64()), ("token", pa.binary())])


def _sent(batches, tally):
    """The rows (family, a, b, role, uid, text) of sorted batches."""
    for b in batches:
        if tally is not None:
            tally.add(b.num_rows)
        yield from zip(*(b.column(i).to_pylist() for i in range(6)))


def _count(k: int, percent: int, tally=None):
    """Groups sorted together in (family, a, b, role, uid, text); links (u, v) out, and in a block of several also its sets (u, family, joined, far).

    In a block (b is null) the leader has role 0, and every pair is counted. In a slice open sets have role 0
    and are held against the others of role 1. a is -1 for a family of one block: nothing is left open there.
    """

    def links(uids, texts, left):
        owner, column = gram_table(texts, k)
        size = np.bincount(owner, minlength=len(uids))
        both = overlaps(owner, column, len(uids), left)
        union = size[:left, None] + size[None, :] - both
        return (100 * both >= percent * union) & (np.array(uids)[:left, None] != np.array(uids)[None, :]), 1 - both[0] / np.maximum(union[0], 1)

    def run(batches):
        pairs, sets = [], []

        def flush():
            columns = zip(*[(*p, None, None, None) for p in pairs], *[(r[0], None, *r[1:]) for r in sets])
            out = pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)
            pairs.clear(), sets.clear()
            return out

        for (family, a, b), rows in groupby(_sent(batches, tally), key=lambda r: r[:3]):
            role, uids, texts = zip(*(r[3:] for r in rows))
            if b is None:
                linked, far = links(uids, texts, len(uids)) if len(uids) > 1 else (np.zeros((1, 1), bool), np.zeros(1))
                forest = _forest(linked)
                pairs += [(uids[x], uids[y]) for x, y in forest]
                if a >= 0:  # the leader is the first set
                    joined = {0} | {y for x, y in forest if x == 0}
                    sets += [(uids[i], family, i in joined, float(far[i])) for i in range(1, len(uids))]
            else:
                left = role.count(0)
                if left < len(uids):
                    linked = np.zeros((len(uids), len(uids)), bool)
                    linked[:left] = links(uids, texts, left)[0]
                    pairs += [(uids[x], uids[y]) for x, y in _forest(linked | linked.T)]
            if len(pairs) + len(sets) > 20_000:
                yield flush()
        if pairs or sets:
            yield flush()

    return run


def _grams_of(text: bytes, k: int) -> set[bytes]:
    """The n-grams of words joined by one space, as such."""
    words = text.split(b" ") if text else []
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _deltas(k: int, tally=None):
    """Groups sorted together in (family, a, b, role, uid, text), the leader (role 0) first; out: the n-grams of each other set in which it differs from the leader, by 128-bit digest."""

    def run(batches):
        held = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*held), _DELTA_ARROW)], schema=_DELTA_ARROW)
            held.clear()
            return out

        for (family, *_), rows in groupby(_sent(batches, tally), key=lambda r: r[:3]):
            lead = _grams_of(next(rows)[5], k)
            for row in rows:
                own = _grams_of(row[5], k)
                held += [(family, row[4], len(own), blake2b(g, digest_size=16).digest()) for g in own ^ lead]
                if len(held) > 20_000:
                    yield flush()
        if held:
            yield flush()

    return run


def _meeting(tokens: DataFrame, judged: DataFrame, percent: int) -> DataFrame:
    """(uid, family, near): the sets that near ones may still be linked to, and these, in smaller families.

    tokens: family, uid, size, token (n-grams in which a set differs from the leader); judged: uid, near. A
    near set x is not linked to the leader L, so |x - L| + |y - L| (symmetric differences) is over
    what a link of x and y allows for |x - y|, and they share o >= (|x - L| + |y - L| - |x - y|) / 2 >= 1 of these n-grams.
    In any order of n-grams the first |x - L| - o + 1 of x's and the first |y - L| - o + 1 of y's have one in common.
    Linked sets differ in at most (100 - percent) |x| / percent =: d, so that with |x - L| <= |y - L| the first
    d / 2 + 1 of x's and the first d + 1 of y's do. The order is by how many sets of the family differ in an n-gram, rarest first.
    """
    counts = store(tokens.groupBy("family", "token").agg(F.count("*").alias("n")).where("n > 1"), "differences-met")
    ranked = tokens.join(counts, ["family", "token"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("family", "uid").orderBy("n", "token"))
    first = ranked.withColumn("place", place).withColumn("d", F.floor((100 - percent) * F.col("size") / percent))
    first = first.where("place <= d + 1 and n > 1").select("family", "uid", "token", (F.col("place") <= F.floor(F.col("d") / 2) + 1).alias("short"))
    first = store(first.join(judged.select("uid", "near"), "uid"), "first-differences")
    stars = first.groupBy("family", "token").agg(F.min("uid").alias("lead"), F.count("*").alias("n"), F.max("short").alias("short"), F.max("near").alias("near"))
    stars = store(stars.where("n > 1 and short and near").select("family", "token", "lead"), "meeting")
    met = store(first.join(stars, ["family", "token"]).select("lead", "uid", "near").distinct(), "met-differences")
    of = components(met.select(F.col("lead").alias("u"), F.col("uid").alias("v"))).select(F.col("node").alias("uid"), F.col("component").alias("family"))
    return met.select("uid", "near").distinct().join(of, "uid")


def _plain(batches):
    """(uid, family, text) in; lower-cased words joined by one space out."""
    for b in batches:
        words = Words(b.column(2).to_pylist(), lower=True)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([words.plain(d) for d in range(words.n_texts)], pa.binary())], names=["uid", "family", "plain"])


def _spread(n: Column) -> Column:
    """The block of a set among ``n``."""
    return F.pmod(F.xxhash64("uid"), n).cast("int")


def _blocks_of(sets: DataFrame, block: int, block_grams: int) -> DataFrame:
    """(family, blocks, leader) by partial sums; families of one set are left out. sets: uid, family, score, n_shingles."""
    sized = sets.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("grams"), F.max(F.struct("score", (-F.col("uid")).alias("uid")))["uid"].alias("leader"))
    blocks = F.ceil(F.greatest(F.col("members") / block, F.col("grams") / block_grams)).cast("int")
    return sized.where("members > 1").select("family", blocks.alias("blocks"), (-F.col("leader")).alias("leader"))


def _grouped(dealt: DataFrame) -> DataFrame:
    rows = dealt.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b", "role", "uid")
    return rows.select("family", "a", "b", "role", "uid", "plain")


def _dealt(crowd: DataFrame, sized: DataFrame) -> DataFrame:
    """Each set to a block of its family, the leader to all of them."""
    leads = F.col("uid") == F.col("leader")
    to = F.when(F.col("blocks") == 1, F.array(F.lit(-1))).when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_spread(F.col("blocks"))))
    return _grouped(crowd.join(sized, "family").select("family", F.explode(to).alias("a"), F.lit(None).cast("int").alias("b"), F.when(leads, 0).otherwise(1).alias("role"), "uid", "plain"))


def _sliced(crowd: DataFrame, members: DataFrame, block: int, block_grams: int) -> DataFrame:
    """Near sets against all sets of their family. crowd: uid, plain; members: uid, family, near, n_shingles."""
    parts = lambda which: F.ceil(F.greatest(F.sum(which.cast("int")) / block, F.sum(F.when(which, F.col("n_shingles"))) / block_grams))
    slices = members.groupBy("family").agg(parts(F.col("near")).cast("int").alias("parts"), F.ceil(parts(F.lit(True)) / 4).cast("int").alias("slices"))
    here = crowd.select("uid", "plain").join(members.join(store(slices, "slices"), "family"), "uid")
    every = here.select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("a"), _spread(F.col("slices")).alias("b"), F.lit(1).alias("role"), "uid", "plain")
    asking = here.where("near").select("family", F.pmod(F.xxhash64("uid", F.lit(1)), "parts").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("b"), F.lit(0).alias("role"), "uid", "plain")
    return _grouped(every.union(asking))


def family_links(docs: DataFrame, members: DataFrame, k: int, percent: int, block: int, block_grams: int, rounds: int = 4, tally=None) -> DataFrame:
    """(u, v) that hold the components of the links inside families. docs: uid, text; members: uid, family, score, n_shingles.

    ``rounds``: in the last one all open sets are near ones.
    """
    found = []
    sets = docs.join(members.select("uid", "family").hint("shuffle_hash"), "uid").select("uid", "family", "text")
    crowd = store(sets.mapInArrow(_plain, "uid long, family long, plain binary"), "sets")
    drop_finished_shuffles(docs.sparkSession)
    for i in range(rounds):
        # small tables are stored, so that the other side of a join is a plain exchange: a hot family is split among tasks
        sized = store(_blocks_of(members, block, block_grams), "sizes")
        got = store(_dealt(crowd, sized).mapInArrow(_count(k, percent, tally), _FOUND), "links")
        drop_finished_shuffles(docs.sparkSession)  # texts
        found.append(got.where("family is null").select("u", "v"))
        judged = got.where("family is not null").select(F.col("u").alias("uid"), "family", "joined", "far")
        if not judged.where("not joined").head(1):
            break
        reach = store(judged.groupBy("family").agg(F.coalesce(F.max(F.when(F.col("joined"), F.col("far"))), F.lit(0.0)).alias("reach")), "reach")
        is_near = F.lit(True) if i == rounds - 1 else F.col("far") <= F.col("reach") + (1 - percent / 100 + 1e-9)
        judged = store(judged.join(reach, "family").select("uid", "family", "joined", (~F.col("joined") & is_near).alias("near")), "judged")
        opened = store(judged.where("near").select("family").distinct(), "open")
        if opened.head(1):
            again = store(sized.join(opened, "family", "left_semi"), "sizes")
            tokens = store(_dealt(crowd, again).mapInArrow(_deltas(k, tally), _DELTA), "differences")
            meet = store(_meeting(tokens, judged, percent).join(members.select("uid", "n_shingles"), "uid"), "meeting")
            drop_table(tokens)
            drop_finished_shuffles(docs.sparkSession)
            found.append(store(_sliced(crowd, meet, block, block_grams).mapInArrow(_count(k, percent, tally), _FOUND).select("u", "v"), "links"))
        members = store(members.join(judged.where("not joined and not near").select("uid"), "uid", "left_semi"), "far")
        if not members.head(1):
            break
        before, crowd = crowd, store(crowd.join(members.select("uid"), "uid", "left_semi"), "sets")
        drop_table(before)
        drop_finished_shuffles(docs.sparkSession)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _met_keys(rows: DataFrame, slice_rows: int = SLICE_ROWS, most: int = SLICES) -> DataFrame:
    """(b, lead, more): entries whose keys another map task has too, the least entry of such a key, and how many of these keys the entry shares with no set of its own task.

    ``rows`` is the table of ``_sketch``; most of its keys are held once. They are shuffled in ranges of about
    ``slice_rows`` (``most`` ranges at most), one after the other, so that their shuffles are never on disk together.
    """
    keys, parts = rows.where(f"kind = {_KEY}"), []
    slices = min(most, max(1, -(-keys.count() // slice_rows)))  # one number; keys are hashes, and each task's are sorted
    for i in range(slices):
        low, high = (i << 64) // slices - (1 << 63), ((i + 1) << 64) // slices - (1 << 63) - 1
        # a key has one row a map task here, however many sets share it
        same = Window.partitionBy("a")
        met = keys.where(F.col("a").between(low, high)).select("b", "n", F.min("b").over(same).alias("lead"), F.count("*").over(same).alias("held")).where("held > 1")
        parts.append(store(met.groupBy("b", "lead").agg(F.sum(1 - F.col("n")).alias("more")), "met"))
        drop_finished_shuffles(rows.sparkSession)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out if len(parts) == 1 else store(out.groupBy("b", "lead").agg(F.sum("more").alias("more")), "met")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, block: int = 512, block_grams: int = 4 << 20, hot_least: int = 64, tally=None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): uid, doc_id, n_shingles, component_id, component.

    A document's set: distinct k-word shingles of the lower-cased (A-Z) text; all words as one with
    fewer; empty without words, or for null. Two documents link when 100 * |x & y| >= percent *
    |x | y|, both not empty; component_id is the smallest doc_id reachable by links. A null doc_id is
    never the smallest unless a component has no other. Repeated rows are documents of their own and
    link. An empty table gives an empty result. ``uid`` is the row number of ``shared.with_uid``, ``component`` the smallest uid of the component.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hot = spark.sparkContext.broadcast(hot_grams(docs, k, hot_least))
    rows = store(docs.mapInArrow(_sketch(k, percent, hot), "kind byte, a long, b long, doc_id long, n long"), "segments")
    drop_finished_shuffles(spark)
    met = _met_keys(rows)
    # a set with fewer shared keys than linked sets have is in no family, unless others meet through it
    more = met.groupBy("b").agg(F.sum("more").alias("more"))
    nodes = rows.where(f"kind = {_NODE}").select(F.col("a").alias("uid"), F.col("b").alias("shared"), F.col("n").alias("need"))
    kept = nodes.join(more.withColumnRenamed("b", "uid"), "uid", "left").select("uid", (F.col("shared") + F.coalesce("more", F.lit(0))).alias("score"), "need").where("score >= need").select("uid", "score")
    kept = store(kept, "kept")
    local = rows.where(f"kind = {_STAR}").select(F.col("a").alias("u"), F.col("b").alias("v")).join(kept.select(F.col("uid").alias("v")), "v", "left_semi").select("u", "v")
    local = store(local, "stars")
    live = kept.select("uid").union(local.select("u")).distinct().withColumnRenamed("uid", "v")
    far = met.where("b <> lead").select(F.col("lead").alias("u"), F.col("b").alias("v")).join(live, "v", "left_semi").select("u", "v")
    own_rows = store(rows.where(f"kind = {_DOC}").select(F.col("a").alias("uid"), F.col("b").alias("entry"), "doc_id", F.col("n").alias("n_shingles")), "docs")
    families = components(local.union(far)).join(kept.withColumnRenamed("uid", "node"), "node")
    members = families.select(F.col("node").alias("uid"), F.col("component").alias("family"), "score").join(own_rows.select("uid", "n_shingles"), "uid")
    members = store(members, "families")
    drop_table(rows)
    hot.destroy()
    drop_finished_shuffles(spark)
    links = family_links(with_uid(docs).select("uid", "text"), members, k, percent, block, block_grams, tally=tally)
    links = components(links).select(F.col("node").alias("entry"), "component")

    least = own_rows.groupBy("entry").agg(F.min("doc_id").alias("least")).join(links, "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    least = store(least, "entries")
    of = least.groupBy("component").agg(F.min("least").alias("component_id"))
    entry = least.select("entry", "component").join(of, "component").select("entry", "component", "component_id")
    drop_finished_shuffles(spark)
    return own_rows.join(entry, "entry").select("uid", "doc_id", "n_shingles", "component_id", "component")


def keep_one_of_each(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the smallest doc_id stays (the first row of it; a null doc_id comes last).

    Texts without words, nulls among them, are linked with nothing and stay; repeated rows are copies; an empty
    table gives an empty result.
    """
    found, row = jaccard_components(docs, k, percent), spare_name(docs, "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    kept = found.groupBy("component").agg(first.alias("first")).select(F.col("first.uid").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").drop(row)
