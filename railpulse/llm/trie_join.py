"""N-gram Jaccard join over whole texts with prefix trees, and its components.

Two texts link when the Jaccard similarity of their sets of word shingles reaches
a threshold.  Equal sets form one class; the join works on classes, so copies
never meet each other.  It finds every link that matters to connectivity, with no
cap on partners:

1. Global order.  All shingles are counted over the corpus, and the level of each count
   that is above one goes to a table of fixed size (``SLOTS`` bytes, by hash).  Shingles come
   by level, rare before frequent, then by hash, so a prefix holds what is common to many
   texts only where little else is in them.  The order is the same everywhere; any such
   order is right, a table that is crowded only makes it less selective.
2. Prefixes.  Two sets that link share ``SHARED`` of the first n - ceil(t n) + ``SHARED``
   shingles of each, and they are among the first n - ceil(2 t / (1 + t) n) + ``SHARED``
   of the shorter, its core (of smaller sets as many as they have to share).  Each class
   posts its prefix; shingles posted by one class alone, or by none as core, drop.
3. Families.  Two classes that share fewer than that can't link, and the more texts there
   are the more pairs share one by chance.  So shingles of at most ``FEW`` classes connect
   those pairs only that share enough of them, or that both post a shingle of more
   classes, which connects all of its own.  Classes so connected form a family; no link
   leaves it.  A family of at most ``BLOCK`` classes is joined in one task.
4. Large families.  Each class goes to two of its shared shingles, picked by hash;
   a shingle's classes are dealt into blocks of about ``BLOCK``, and each block
   yields the links that connect it.  Groups of near copies, however large, are
   mostly connected after this, and a shingle whose classes all lie in one
   component is done.  Of the other shingles with the same classes one stays, and
   one whose classes another shingle covers goes; its classes, ordered by core, size
   and component, are cut into parts, and every pair of parts that holds a core, two
   components and sizes that can link is joined in a task of its own, so all pairs
   across components are covered exactly.
5. Components by alternating stars over the links, then back to the documents.

Within a task the sets of a block, each in the order of the block's most shared
shingles first, form a prefix tree.  A walk over it carries the overlap of the
shared beginning with every other set at once; a branch is left for a set when
the overlap so far plus what can still match on either side is below what the
lengths ask for.

Defined results: a null, empty or blank text has the empty set and links with
nothing; fewer words than a shingle make one shingle of all; repeated rows are
members of one class; a null doc_id belongs to its class but never names one
unless the whole component has none; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.llm.shingles import WORDS, mix, shingle_set
from railpulse.session import drop_shuffles, materialize

PERCENT = 80
#: Entries of the table of levels, a power of two.
SLOTS = 1 << 23
BLOCK = 192
BITS = 1 << 24
#: So often classes that can't link any more, and the shingles that they kept open, are taken away.
ROUNDS = 2
#: A post's place in its set is sent in 13 bits; later places count as this one.
LATE = (1 << 13) - 1
#: So many of the first shingles two classes must share, if their sizes ask for as many; at most 4.
SHARED = 4
#: Pairs are counted of shingles that at most so many classes post.
FEW = 8


# ------------------------------------------------------------------- global order
def _ranges(docs: DataFrame) -> int:
    """Hash ranges that shingles are gathered by: as many as keep a range's share bounded when the input grows."""
    return int(min(1 << 14, max(64, 8 * docs.rdd.getNumPartitions())))


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _blobs(columns: dict[str, np.ndarray], ranges: int, at: np.ndarray) -> list[tuple]:
    """(range, bytes of each column) of each range that has rows; ``at`` is the ascending range of each row."""
    edge = np.flatnonzero(np.diff(at, prepend=-1, append=ranges + 1))
    return [(int(at[i]), *(c[i:j].tobytes() for c in columns.values())) for i, j in zip(edge[:-1], edge[1:])]


def _levels(docs: DataFrame, words: int, ranges: int) -> np.ndarray:
    """One byte a slot: 0 where no shingle occurs twice, else eight times the binary logarithm of the most frequent one's count.

    A shingle is counted by a power of two of ranges and the 32 bits of its hash that follow, up to 255 a slice of documents.
    """
    bits = (ranges - 1).bit_length()

    def count(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                token, n = np.unique(np.concatenate([shingle_set(t, words) for t in batch.column(0).slice(k, 4096).to_pylist()]), return_counts=True)
                low = (token >> np.uint64(32 - bits)).astype(np.uint32)
                found = _blobs({"token": low, "n": np.minimum(n, 255).astype(np.uint8)}, 1 << bits, (token >> np.uint64(64 - bits)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[c] for f in found], pa.binary()) for c in (1, 2))], names=["part", "token", "n"])

    def add(table):
        token = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("token").to_pylist()])
        n = np.concatenate([np.frombuffer(b, np.uint8) for b in table.column("n").to_pylist()])
        token, at = np.unique(token, return_inverse=True)
        total = np.bincount(at, weights=n)
        twice = total > 1
        share = SLOTS >> bits
        slot, first = np.unique((token[twice].astype(np.int64) * share >> 32) + table.column("part")[0].as_py() * share, return_index=True)
        level = np.maximum.reduceat(np.minimum(255, np.ceil(8 * np.log2(total[twice]))), first).astype(np.uint8) if len(slot) else np.empty(0, np.uint8)
        return pa.table({"slot": pa.array([slot.astype(np.int32).tobytes()], pa.binary()), "level": pa.array([level.tobytes()], pa.binary())})

    levels = np.zeros(SLOTS, np.uint8)
    for r in docs.select("text").mapInArrow(count, "part int, token binary, n binary").groupBy("part").applyInArrow(add, "slot binary, level binary").collect():
        levels[np.frombuffer(r["slot"], np.int32)] = np.frombuffer(r["level"], np.uint8)  # SLOTS entries over all ranges
    return levels


def in_order(shingles: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set (sorted by hash) in the global order: by level, then by hash."""
    return shingles[np.argsort(level[_slot(shingles)], kind="stable")]


def prefix_length(n: int, percent: int = PERCENT, shared: int = 1) -> int:
    least = -(-percent * n // 100)
    return n - least + min(shared, least)


def core_length(n: int, percent: int = PERCENT, shared: int = 1) -> int:
    """The shorter of two sets that link shares ``shared`` of this many of its first shingles with a prefix of the longer."""
    least = -(-2 * percent * n // (100 + percent))
    return n - least + min(shared, least)


def signature(shingles: np.ndarray) -> int:
    """64 bits of a set: sums of two mixes of its members, mixed with its size."""
    with np.errstate(over="ignore"):
        a = mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        b = mix(shingles ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
        return int(mix(np.array([a ^ mix(np.array([b + np.uint64(len(shingles))], np.uint64))[0]], np.uint64)).view(np.int64)[0])


def _documents(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and sig (the class; null without words) of each document."""

    def task(batches):
        for batch in batches:
            n, sig = [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, words)
                n.append(len(own))
                sig.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64())], names=["doc_id", "n_shingles", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, n_shingles long, sig long")


def _buckets(docs: DataFrame, levels: np.ndarray, words: int, percent: int, ranges: int) -> DataFrame:
    """token, sig, core, place, lo, posts, others: the classes of each shingle that two or more classes post, one of them as core;
    whether it is core for this one, how many shingles come before it, the smallest core class, the number of classes, and,
    of at most ``FEW`` classes, the larger ones with the number of shingles that this one and they must share.

    Posts travel as arrays of a hash range; a class posts once a slice.  A shingle is known by its range and 32 bits of its
    hash: should two be taken for one, that connects classes that may not link.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def post(batches):
        level = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                prefix, sizes = {}, []
                for text in batch.column(0).slice(k, 4096).to_pylist():
                    own = shingle_set(text, words)
                    if len(own) and (sig := signature(own)) not in prefix:
                        prefix[sig] = in_order(own, level)[:prefix_length(len(own), percent, SHARED)]
                        sizes.append(len(own))
                token = np.concatenate([*prefix.values(), np.empty(0, np.uint64)])
                need = lambda n: min(SHARED, -(-percent * n // 100)) - 1
                place = np.concatenate([*((np.minimum(np.arange(len(p)), LATE) + (LATE + 1) * (need(n) + 4 * (np.arange(len(p)) < core_length(n, percent, SHARED)))) for p, n in zip(prefix.values(), sizes)), np.empty(0, np.int64)]).astype(np.uint16)
                sig = np.repeat(np.array([*prefix], np.int64), [len(p) for p in prefix.values()])
                at = (token & np.uint64(0xFFFFFF)).astype(np.int64) * ranges >> 24
                order = np.argsort(at, kind="stable")
                found = _blobs({"token": (token[order] >> np.uint64(32)).astype(np.uint32), "sig": sig[order], "place": place[order]}, ranges, at[order])
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[c] for f in found], pa.binary()) for c in (1, 2, 3))], names=["part", "token", "sig", "place"])

    def meet(table):
        token = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("token").to_pylist()]).astype(np.int64) + (table.column("part")[0].as_py() << 32)
        sig = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("sig").to_pylist()])
        place = np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("place").to_pylist()])
        order = np.lexsort((sig, token))
        token, sig, place = token[order], sig[order], place[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        token, sig, core, need, place = token[new], sig[new], place[new] >= 4 * (LATE + 1), (place[new] // (LATE + 1) % 4 + 1).astype(np.int8), (place[new] & LATE).astype(np.int32)
        _, at, n = np.unique(token, return_inverse=True, return_counts=True)
        cores = np.bincount(at, weights=core)
        lo = np.zeros(len(n), np.int64)  # the smallest core class: rows are in order, so the last written is the first
        lo[at[core][::-1]] = sig[core][::-1]
        n = n[at]
        two = (n > 1) & (cores[at] > 0)
        token, sig, core, need, place, lo, n = token[two], sig[two], core[two], need[two], place[two], lo[at][two], n[two].astype(np.int64)
        row = np.arange(len(token))
        after = np.where(n <= FEW, np.searchsorted(token, token, "right") - row - 1, 0)  # so many rows of the same shingle follow
        mine = np.repeat(row, after)
        other = mine + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
        pairs = pa.StructArray.from_arrays([pa.array(sig[other], pa.int64()), pa.array(np.maximum(need[mine], need[other]), pa.int8())], names=["sig", "need"])
        others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(after)), pa.int32()), pairs)
        return pa.table({"token": pa.array(token), "sig": pa.array(sig), "core": pa.array(core), "place": pa.array(place), "lo": pa.array(lo), "posts": pa.array(n), "others": others})

    return docs.select("text").mapInArrow(post, "part int, token binary, sig binary, place binary").groupBy("part").applyInArrow(meet, "token long, sig long, core boolean, place int, lo long, posts long, others array<struct<sig: bigint, need: tinyint>>")


def _connections(buckets: DataFrame) -> DataFrame:
    """Links (a, b) between classes such that no two that can link lie apart: see Families above."""
    pairs = buckets.select(F.col("sig").alias("a"), F.explode("others").alias("o")).groupBy("a", F.col("o.sig").alias("b")).agg(F.count("*").alias("n"), F.max("o.need").alias("need"))
    many = buckets.where(F.col("posts") > FEW)
    wide = many.select("sig").distinct()
    weak = pairs.where("n < need").join(wide.withColumnRenamed("sig", "a"), "a", "left_semi").join(wide.withColumnRenamed("sig", "b"), "b", "left_semi")
    return pairs.where("n >= need").select("a", "b").union(weak.select("a", "b")).union(many.select(F.col("lo").alias("a"), F.col("sig").alias("b")))


# ------------------------------------------------------------------- join in a block
def tree_links(sets: list[np.ndarray], percent: int = PERCENT, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets whose similarity reaches ``percent``; with ``side``, only pairs across sides."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n < 2 or not size.any():
        return []
    members = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, token, freq = np.unique(members, return_inverse=True, return_counts=True)
    # shingles of one set alone match nothing; the others are numbered most shared first
    rank = np.empty(len(freq), np.int64)
    rank[np.lexsort((np.arange(len(freq)), -freq))] = np.arange(len(freq))
    kept = freq[token] > 1
    token, owner = rank[token[kept]], owner[kept]
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    length = np.bincount(owner, minlength=n)
    begin = np.cumsum(length) - length
    seq = [token[begin[i]:begin[i] + length[i]] for i in range(n)]
    by_token = np.argsort(token, kind="stable")
    posting = owner[by_token]
    first = np.searchsorted(token[by_token], np.arange(token.max() + 2)) if len(token) else np.zeros(1, np.int64)

    def overlap(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        a, b = first[tokens], first[tokens + 1]
        if len(tokens) == 1:
            at = posting[a[0]:b[0]]
        else:
            n_each = b - a
            at = posting[np.repeat(a - np.cumsum(n_each) + n_each, n_each) + np.arange(n_each.sum())]
        return np.bincount(at, minlength=n)

    tree = sorted((i for i in range(n) if length[i]), key=lambda i: seq[i].tolist())
    least = lambda x, y: -(-percent * (x + y) // (100 + percent))  # noqa: E731  the overlap that sizes x and y need
    links = []
    stack = [(0, len(tree), 0, np.zeros(n, np.int64), np.arange(n))] if tree else []
    while stack:
        lo, hi, depth, ov, active = stack.pop()
        low, high = seq[tree[lo]], seq[tree[hi - 1]]
        m = min(len(low), len(high))
        differ = np.flatnonzero(low[depth:m] != high[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        if end > depth:
            ov = ov + overlap(low[depth:end])
        own = np.array(tree[lo:hi])
        # what a set still can match: its own unmatched shingles, or the longest rest below this node
        best = ov[active] + np.minimum(length[active] - ov[active], length[own].max() - end)
        active = active[best >= least(size[active], size[own].min())]
        if not len(active):
            continue
        done = lo
        while done < hi and length[tree[done]] == end:  # sets that end here come first
            y = tree[done]
            ok = active[(active != y) & (100 * ov[active] >= percent * (size[active] + size[y] - ov[active]))]
            links += [(min(y, int(x)), max(y, int(x))) for x in ok if side is None or side[x] != side[y]]
            done += 1
        while done < hi:  # children: runs of sets with the same next shingle
            t, stop = seq[tree[done]][end], done + 1
            while stop < hi and seq[tree[stop]][end] == t:
                stop += 1
            stack.append((done, stop, end, ov, active))
            done = stop
    return sorted(set(links))


def spanning(links: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """(smallest member, member) of each component of the links, for members that aren't the smallest."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(find(i), i) for i in range(n) if find(i) != i]


def _block_links(blocks: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) that connect each block; blocks has the keys, sig, side (null: all pairs) and the set's bytes."""

    def join(table):
        sig = table.column("sig").to_numpy()
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").take(pa.array(order)).to_pylist()]
        side = table.column("side").take(pa.array(order))
        found = spanning(tree_links(sets, percent, None if side.null_count else side.to_numpy()), len(sig))
        return pa.table({"a": pa.array([int(sig[i]) for i, _ in found], pa.int64()), "b": pa.array([int(sig[j]) for _, j in found], pa.int64())})

    return blocks.select(*keys, "sig", "side", "shingles").groupBy(*keys).applyInArrow(join, "a long, b long")


# ------------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node of the links (a, b).

    Alternating stars: in turn every node hands its larger, then its smaller
    neighbours to the smallest one it knows, until nothing changes; then each
    component is a star.  The minimum of a node is aggregated before it is joined
    back, so a centre of many links is never gathered.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
        state = now
        # larger neighbours of u move to the smallest of u and its neighbours
        both = edges.union(edges.select("v", "u"))
        small = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # smaller neighbours of u, and u, move to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u")
        edges = materialize(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")


# ------------------------------------------------------------------- the join
def _bit(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BITS)).cast("long")


def bitmap(ids: DataFrame, doc_id: str = "doc_id") -> np.ndarray:
    """BITS flags, set at the hashes of the ids: a fixed size however many they are."""
    bits = np.zeros(BITS, bool)
    at = ids.select((_bit(doc_id) + 1).alias("bit"))  # the functions below count from 1
    rows = at.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("b"))
    for r in rows.collect():  # at most BITS / 32768 rows of 4 KB
        own = np.unpackbits(np.frombuffer(r["b"], np.uint8), bitorder="little").astype(bool)
        begin = (r["k"] - 1) * 32768
        bits[begin:begin + 32768] = own
    return bits


def _able(placed: DataFrame, percent: int) -> DataFrame:
    """Posts of shingles whose classes lie in two components, of classes that can still link; ``widest`` is the size of
    the largest set that a class can link with.

    The first shingle that two sets share is posted by both, and if it is of one component, so are they.
    So a class shares, with any class it has yet to link with, at most what comes from its first open
    shingle on, which bounds the other one's size.
    """
    ends = placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    still = placed.join(ends.select("token"), "token", "left_semi")
    begin = Window.partitionBy("sig")
    rest = F.col("size") - F.min("place").over(begin)
    widest = F.floor((100 + percent) * rest / percent) - F.col("size")
    return still.withColumn("widest", widest).where(100 * F.col("widest") >= percent * F.col("size"))


def near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, sig (null: no words), component_id and component of every row of ``docs`` (doc_id, text).

    ``component`` names a component also where rows that share a doc_id lie in several (null: no words).
    """
    with drop_shuffles(docs.sparkSession):
        return _near_copies(docs.select("doc_id", F.col("text").cast("string").alias("text")), words, percent)


def _near_copies(docs: DataFrame, words: int, percent: int) -> DataFrame:
    known = materialize(_documents(docs, words), "shingled")
    classes = known.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("size"))
    ranges = _ranges(docs)
    buckets = materialize(_buckets(docs, _levels(docs, words, ranges), words, percent, ranges), "buckets")

    # families: classes connected by shared prefix shingles; no link leaves a family
    family = components(_connections(buckets))
    family = family.join(family.groupBy("label").agg(F.count("*").alias("members")), "label")
    sources = materialize(family.join(classes.withColumnRenamed("sig", "node"), "node").select(F.col("node").alias("sig"), F.col("label").alias("family"), "members", "first_id", "size"), "sources")
    # their sets, read again from the texts
    sets = _sets(docs, bitmap(sources, "first_id"), words).join(sources.select("sig", "family", "members"), "sig").dropDuplicates(["sig"])
    sets = materialize(sets, "sets")
    # a family that fits in a block is joined whole; the links that connect it point to its components' smallest class
    small = materialize(_block_links(sets.where(F.col("members") <= BLOCK).withColumn("side", F.lit(None).cast("long")), ["family"], percent), "small-links")
    sets = sets.where(F.col("members") > BLOCK).select("sig", "shingles")
    wanted = sources.where(F.col("members") > BLOCK).select("sig", "size", "family")
    # a shingle of several families is one of each
    buckets = materialize(buckets.drop("lo", "posts", "others").join(wanted, "sig").withColumn("token", F.xxhash64("token", "family")).drop("family"), "family-buckets")
    posts = buckets.groupBy("token").agg(F.count("*").alias("posts"), F.bool_or("core").alias("any")).where("posts > 1 AND any").drop("any")
    buckets = materialize(buckets.join(posts, "token"), "large-buckets")

    # first links of large families, by two shared shingles a class
    pick = lambda k: F.min_by(F.struct("token", "posts"), F.xxhash64("token", F.lit(k)))
    homes = buckets.groupBy("sig").agg(pick(1).alias("h1"), pick(2).alias("h2"))
    homes = homes.select("sig", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}.token").alias("token"), F.col(f"h{k}.posts").alias("posts")) for k in (1, 2)])).alias("h"))
    homes = homes.select("sig", "h.k", "h.token", F.pmod(F.xxhash64("sig", "h.k"), F.ceil(F.col("h.posts") / F.lit(BLOCK))).alias("part"))
    first = _block_links(homes.join(sets, "sig").withColumn("side", F.lit(None).cast("long")), ["k", "token", "part"], percent)
    label = materialize(components(first), "first-components")

    # shingles whose classes aren't yet one component, and classes that can link by one
    placed = buckets.select("token", "sig", "core", "place", "size").join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    for _ in range(ROUNDS):
        placed = materialize(_able(placed, percent), "placed")
    open_tokens = placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("sig", "core").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("sig", "core", F.lit(9)).cast("decimal(38,0)")).alias("s2")).where("lo < hi")
    one_each = open_tokens.groupBy("n", "s1", "s2").agg(F.min("token").alias("token")).select("token", "n")
    rest = placed.join(one_each.select("token", "n"), "token")
    # a class leads to its most posted shingle; one whose classes all lead to the same other is covered there
    lead = rest.groupBy("sig").agg(F.max(F.struct("n", "token", "core")).alias("x")).select("sig", F.col("x.token").alias("lead"), F.col("x.core").alias("lead_core"))
    apart = rest.join(lead, "sig").groupBy("token").agg(F.min("lead").alias("l1"), F.max("lead").alias("l2"), F.bool_or(F.col("core") & ~F.col("lead_core")).alias("more")).where("l1 < l2 OR l1 = token OR more")
    rest = rest.select("token", "sig", "core", "size", "label", "widest").join(apart.select("token"), "token")
    band = F.floor(F.log(F.col("size")) / math.log(1.25))  # sets that link differ by a quarter at most at 80 percent
    nth = F.row_number().over(Window.partitionBy("token").orderBy(F.col("core").desc(), band, "label", "sig"))
    part = materialize(rest.withColumn("part", F.floor((nth - 1) / (BLOCK // 2))), "parts")
    ends = part.groupBy("token", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("size").alias("least"), F.max("size").alias("most"), F.max("widest").alias("widest"), F.bool_or("core").alias("core"))
    other = ends.select("token", *[F.col(a).alias(b) for a, b in (("part", "q"), ("lo", "lo2"), ("hi", "hi2"), ("least", "least2"), ("most", "most2"), ("widest", "widest2"), ("core", "core2"))])
    near = (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least")) & (F.col("widest") >= F.col("least2")) & (F.col("widest2") >= F.col("least"))
    pairs = ends.join(other, "token").where("part <= q AND (core OR core2) AND least(lo, lo2) < greatest(hi, hi2)").where(near)
    pairs = pairs.select("token", F.col("part").alias("p"), "q")
    wide = pairs.select("token", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("part")).join(part.select("token", "part", "sig", "label"), ["token", "part"])
    more = _block_links(wide.select("token", "p", "q", "sig", F.col("label").alias("side")).join(sets, "sig"), ["token", "p", "q"], percent)

    # links between first components join those
    ends = more.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    merged = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("top"))
    large = label.join(merged, "label", "left").select(F.col("node").alias("sig"), F.coalesce("top", "label").alias("top"))
    large = large.union(merged.select("label", "top")).union(small.select("b", "a"))  # a class that only the second links reach names itself
    top = large.groupBy("sig").agg(F.min("top").alias("top"))
    top = materialize(sources.join(top, "sig", "left").select("sig", "first_id", F.coalesce("top", "sig").alias("top")), "tops")
    joined = top.join(top.groupBy("top").agg(F.min("first_id").alias("component_id")), "top").select("sig", "component_id", "top")
    of = classes.join(joined, "sig", "left").select("sig", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("top", "sig").alias("component"))
    linked = known.where("sig IS NOT NULL").select("doc_id", "n_shingles", "sig").join(of, "sig").select("doc_id", "n_shingles", "sig", "component_id", "component")
    return linked.union(known.where("sig IS NULL").select("doc_id", "n_shingles", "sig", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")))


def _sets(docs: DataFrame, wanted: np.ndarray, words: int) -> DataFrame:
    """sig and the shingles (uint64 bytes) of the documents whose id may be wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def task(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            own = [shingle_set(text, words) for text in batch.filter(pa.array(flags[batch.column(0).to_numpy()])).column(1).to_pylist()]
            own = [x for x in own if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["sig", "shingles"])

    return docs.select(_bit().alias("bit"), "text").mapInArrow(task, "sig long, shingles binary")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without all but one row of each component: the smallest doc_id stays (none comes last).

    A row is known by its doc_id and its set of shingles: rows that share a doc_id but not a
    text are decided apart, rows without a doc_id like any others.  Of rows that are
    equal in both, one stays.  Rows without words all stay.

    Most documents have no copy.  The ids that have one set flags in a table of fixed
    size; rows whose flag is unset stay where they are, and only the others meet the
    components in a join.
    """
    found = materialize(near_copies(docs, words, percent).where("sig IS NOT NULL"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    many = found.groupBy("component").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    grouped = found.join(many, "component").groupBy("doc_id", "sig", "component").agg(F.bool_or(order == F.col("first")).alias("stays"))
    grouped = materialize(grouped, "grouped")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap(grouped.where("doc_id IS NOT NULL"))))

    def flag(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            row, bits, texts = batch.columns
            maybe = [b is None or bool(flags[b]) for b in bits.to_pylist()]
            sets = [shingle_set(t.as_py() or "", words) if m else () for m, t in zip(maybe, texts)]
            sigs = [signature(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([row, pa.array(sigs, pa.int64())], names=["row", "sig"])

    bit = F.when(F.col("doc_id").isNotNull(), _bit())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), bit.alias("bit"), F.col("text").cast("string").alias("text"))
    marked = whole.mapInArrow(flag, T.StructType([T.StructField("row", docs.schema), T.StructField("sig", T.LongType())]))
    alone = marked.where("sig IS NULL").select("row")
    known = grouped.select(F.col("doc_id").alias("id"), F.col("sig").alias("own"), "component", "stays")
    named = marked.where("sig IS NOT NULL").join(known, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("sig") == F.col("own")), "left")
    kept = named.where("component IS NULL OR stays").withColumn("free", F.when(F.col("component").isNull(), F.monotonically_increasing_id()))
    first = Window.partitionBy("component", "free").orderBy(F.xxhash64("row"))
    once = kept.withColumn("n", F.row_number().over(first)).where("n = 1").select("row")
    return alone.unionByName(once).select("row.*")
