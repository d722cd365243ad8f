"""Jaccard self-join of k-word shingle sets by vertical partitioning.

The global order of shingles (that of their 64-bit hashes) is cut into fragments. Two sets of sizes x <= y link
only if they differ in at most d = (1 - t) / (1 + t) * (x + y) elements, so of more than d fragments at least
one holds the same elements in both. Sets of a size class are cut into as many fragments as that needs for the
largest pair of the class; equal fragments bring two sets together, and no frequent shingle or shared passage
does so on its own. Two sets that link share not just one fragment but as many as those they may differ in leave
over; of each set's fragments the most shared ones, one fewer than that number, are therefore left out, and the
rest still meet (a prefix filter over fragments, in the order of their frequency). What is brought together is then counted exactly: overlaps of SEGMENTS coarser fragments
separately, summed per pair.

No set is compared with all others of a group. Equal sets are one node beforehand. Of the nodes that share a
fragment, each is first counted against the one of its fragments' leaders with which it shares most fragments, in
STARS rounds, whose later ones take leaders across the components that the links so far make. Only pairs of nodes
that are still in different components are enumerated, inside bounded tiles, and a bound from sketches drops those that cannot link
before anything is emitted. A sketch has the parity of each bucket's elements: two sets differ in at least as many
elements as their sketches in bits. All filters are lossless, so the components are those of all links.

Fragments may be empty; sizes leave room for SLACK of them, and the few sets with more also meet on their empty
fragments. Hashes have 64 bits; if two different sets get one node hash, all is done again with another seed.

Null and empty texts have the empty set and link with nothing; fewer words than k make one shingle of the whole
sequence. Rows are told by doc_id and text: a doc_id that repeats with another text has a row for each, with a class
of its own. A null doc_id counts as larger than any other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.graph import components
from quadrille.llm.shared import NO_ID, Scratch, arrow_map, doc_ranges, own_names, string_buffer
from quadrille.llm.words import NOT_SPACE, PIECE, U, mix, shingle_sets, words_by_text

SEGMENTS, TILE, STARS = 8, 2048, 4
LEAST_BITS, BRIEF_BITS, MOST_BITS = 64, 2048, 8192


def key_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key), whatever other columns there are."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key_of(F.col("text")).alias("key"))


class Cut:
    """Size classes and numbers of fragments for links at 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def differ(self, total: int) -> int:
        """Most elements in which two sets of this total size may differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def top(self, c: int) -> int:
        return int(1.5**c) + c  # sizes of class c: above top(c - 1), up to this

    def classes(self, n: int) -> list[int]:
        """Its own class, and those above in which a set large enough not to be too large may lie."""
        c = 0
        while self.top(c) < n:
            c += 1
        out = [c]
        while self.top(out[-1]) + 1 <= 100 * n // self.percent:
            out.append(out[-1] + 1)
        return out

    def fragments(self, c: int) -> tuple[int, int]:
        """How many, and how many of them may be empty."""
        least = self.differ(2 * self.top(c)) + 1
        slack = -(-6 * least // 100) if least > 1 else 0
        return least + slack, slack

    def signatures(self, s: np.ndarray, seed: int) -> list[np.ndarray]:
        """One hash for each fragment of a sorted set that may bring it together with another set."""
        return [sig for _, _, sig in self.rated(s, seed)]

    def rated(self, s: np.ndarray, seed: int) -> list[tuple[int, int, np.ndarray]]:
        """(size class, how many of these any set that links here shares at least, signatures)."""
        n, out = len(s), []
        if self.differ(2 * n * 100 // self.percent) == 0:
            return out  # only an equal set could link
        sums = np.zeros(n + 1, U)
        np.cumsum(mix(s ^ U(seed)), out=sums[1:])
        high = s >> U(32)
        for c in self.classes(n):
            k, slack = self.fragments(c)
            if k == 1:
                continue
            ends = np.searchsorted(high * U(k) >> U(32), np.arange(k + 1, dtype=U))
            empty = ends[1:] == ends[:-1]
            ident = sums[ends[1:]] - sums[ends[:-1]]
            tags = (np.arange(k, dtype=U) + U(c << 40)) * U(0xD6E8FEB86659FD93)
            sig = mix(mix(ident + (ends[1:] - ends[:-1]).astype(U)) + tags)
            # at most `differ` fragments are unequal; of the equal ones, some are empty and may not be given
            need = k - self.differ(n + min(self.top(c), 100 * n // self.percent)) - min(int(empty.sum()), slack)
            if int(empty.sum()) <= slack:
                sig = sig[~empty]
            out.append((c, need, sig))
        return out


def node_of(s: np.ndarray, seed: int) -> tuple[int, int]:
    """A set's node, and a second hash to tell different sets of one node."""
    a = mix(s + U(2 * seed + 1))
    n = len(s)
    x, y = a.sum(dtype=U), mix(a ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)
    node, check = mix(np.array([x + U(n), y + U(n)], U)).view(np.int64)
    return int(node), int(check)


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's buckets as bits; about as many buckets as elements, within limits."""
    bits = min(max(LEAST_BITS, 1 << (len(s) - 1).bit_length()), MOST_BITS)
    return np.packbits(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, brought down to so many: buckets with the same low bits become one."""
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _by_width(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Number of words: (places in the list, rows of words)."""
    size = np.array([len(x) // 8 for x in sketches], np.int64)
    return {int(w): (at := np.flatnonzero(size == w), np.frombuffer(b"".join([sketches[i] for i in at]), U).reshape(-1, w)) for w in np.unique(size)}


def _sets(b: pa.RecordBatch, at: int, k: int):
    data, off = string_buffer(b.column(at))
    for i, j in doc_ranges(off, PIECE):
        h, bounds = words_by_text(data, off, i, j, NOT_SPACE)
        yield i, shingle_sets(h, bounds, k)


def _nodes(docs: DataFrame, k: int, seed: int) -> DataFrame:
    def make():
        def step(b):
            for i, sets in _sets(b, 1, k):
                pairs = [node_of(s, seed) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(sets)), b.column(2).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["doc_id", "key", "n", "node", "extra"])

        return step

    return arrow_map(docs, make, "doc_id long, key long, n long, node long, extra long")


def _signatures(docs: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    def make():
        cut = Cut(percent)

        def step(b):
            for _, sets in _sets(b, 1, k):
                sig, node, rule, had = [], [], [], set()
                for s in sets:
                    if len(s) and (x := node_of(s, seed)[0]) not in had:
                        had.add(x)
                        for c, need, part in cut.rated(s, seed):
                            sig.append(part)
                            node.append(np.full(len(part), x, np.int64))
                            rule.append(np.full(len(part), (c << 40) + need, np.int64))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([y.view(np.int64) for y in sig], node, rule)], ["sig", "node", "rule"])

        return step

    return arrow_map(docs, make, "sig long, node long, rule long")


def _profiles(texts: DataFrame, k: int) -> DataFrame:
    """texts: node, text. Rows (node, n, brief, sketch, parts): sketches, and the set cut into SEGMENTS fragments."""

    def make():
        def step(b):
            for i, sets in _sets(b, 1, k):
                brief, full, parts = [], [], []
                for s in sets:
                    full.append(sketch(s))
                    brief.append(fold(np.frombuffer(full[-1], U)[None], BRIEF_BITS // 64).tobytes())
                    at = np.searchsorted(s >> U(32), np.arange(SEGMENTS + 1, dtype=U) * U((1 << 32) // SEGMENTS))
                    parts.append([s[at[f] : at[f + 1]].tobytes() for f in range(SEGMENTS)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(brief, pa.binary()), pa.array(full, pa.binary()), pa.array(parts, pa.list_(pa.binary()))], ["node", "n", "brief", "sketch", "parts"])

        return step

    return arrow_map(texts, make, "node long, n long, brief binary, sketch binary, parts array<binary>")


def _bound_allows(x: np.ndarray, y: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches of one width differ in few enough bits for a link of sets of this total size."""
    return (100 + percent) * np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= (100 - percent) * total


def _links(pairs: DataFrame, profiles: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame | None:
    """Of the pairs (a, b), those that link, or None without any. Each fragment of two sets meets apart and is counted apart; the counts are summed per pair."""
    small = profiles.select("node", "n", "sketch")
    if not (n_pairs := pairs.count()):
        return None
    held = pairs.join(small.toDF("a", "na", "sa"), "a").join(small.toDF("b", "nb", "sb"), "b")

    def sift():
        def step(b):
            total = b.column("na").to_numpy() + b.column("nb").to_numpy()
            xs, ys, ok = _by_width(b.column("sa").to_pylist()), _by_width(b.column("sb").to_pylist()), np.zeros(len(total), bool)
            for v, (i, x) in xs.items():
                for w, (j, y) in ys.items():
                    at, p, q = np.intersect1d(i, j, assume_unique=True, return_indices=True)
                    ok[at] = _bound_allows(fold(x[p], min(v, w)), fold(y[q], min(v, w)), total[at], percent)
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

        return step

    left = scratch.save(arrow_map(held.select("a", "b", "na", "nb", "sa", "sb"), sift, "a long, b long, na long, nb long"), f"{name}-sifted", n_pairs)
    if not (n_left := left.count()):
        return None
    parts = profiles.select("node", F.posexplode("parts").alias("fragment", "part")).where(F.octet_length("part") > 0)
    cut = left.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("fragment"))
    both = cut.join(parts.toDF("a", "fragment", "pa"), ["a", "fragment"]).join(parts.toDF("b", "fragment", "pb"), ["b", "fragment"])

    def count():
        def step(b):
            for i in range(0, b.num_rows, 1000):
                some = b.slice(i, 1000)
                common = [len(np.intersect1d(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), assume_unique=True)) for x, y in zip(some.column("pa"), some.column("pb"), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(common, pa.int64())], ["a", "b", "common"])

        return step

    overlap = arrow_map(both.select("a", "b", "pa", "pb"), count, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    linked = left.join(overlap, ["a", "b"]).where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb")))
    out = scratch.save(linked.select("a", "b", "common"), f"{name}-links", n_left)
    scratch.drop(f"{name}-sifted")
    del held, cut, both, overlap, linked
    scratch.release()
    return None if out.isEmpty() else out


def _star_pairs(rows: DataFrame) -> DataFrame:
    """rows (node, leader), one for each fragment that brings them together: each node with the leader it shares most fragments with."""
    ties = rows.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    best = ties.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("top"))
    return best.select(F.least("node", "top.leader").alias("a"), F.greatest("node", "top.leader").alias("b")).distinct()


def _merge(comp: DataFrame | None, links: DataFrame, scratch: Scratch, name: str, n: int) -> DataFrame:
    """comp (node, comp) after more links: components of components, so that a later round's edges are few. n: number of nodes."""
    ends = links.select("a", "b")
    if comp is not None:
        ends = ends.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    reach = components(ends, scratch, name, limit=n)
    now = reach.toDF("node", "comp")
    if comp is not None:
        moved = comp.join(reach.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        now = moved.unionByName(now.join(comp.select("node"), "node", "left_anti"))
    return scratch.save(now, f"{name}-placed", n)


def _split_blocks(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(sig, node, comp) of the blocks that hold nodes of several components."""
    placed = members.join(comp.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    return placed.join(split, "sig").select("sig", "node", "comp")


def _cross_stars(split: DataFrame, seed: int) -> DataFrame:
    """In each block two components are drawn and a node of each; all nodes meet the one that isn't of their component."""
    drawn = F.struct(F.xxhash64("comp", F.lit(seed)).alias("c"), F.xxhash64("node", F.lit(seed)).alias("h"), "node", "comp")
    ends = split.groupBy("sig").agg(F.min(drawn).alias("lo"), F.max(drawn).alias("hi"))
    rows = split.join(ends, "sig")
    return _star_pairs(rows.select("node", F.when(F.col("comp") != F.col("lo.comp"), F.col("lo.node")).otherwise(F.col("hi.node")).alias("leader")))


def _tiles(members: DataFrame, profiles: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """members (sig, node, comp) of blocks that hold several components: the pairs across components that the bounds allow.

    Blocks with the same nodes count once; blocks of two are pairs already.
    """
    same = (F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("h2"))
    blocks = members.groupBy("sig").agg(F.count("*").alias("size"), F.min("node").alias("a"), F.max("node").alias("b"), *same)
    blocks = scratch.save(blocks.groupBy("size", "h1", "h2", "a", "b").agg(F.min("sig").alias("sig")), "blocks")
    twos = blocks.where("size = 2").select("a", "b")
    rows = members.join(blocks.where("size > 2").select("sig", "size"), "sig").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("t", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("sig", "node", "comp", "t", F.least("t", "other").alias("t0"), F.greatest("t", "other").alias("t1"))
    rows = rows.join(profiles.select("node", "n", "brief"), "node")

    def pairs(group: pa.Table) -> pa.Table:
        node, comp, n, t = (group.column(c).to_numpy() for c in ("node", "comp", "n", "t"))
        t0, t1 = group.column("t0")[0].as_py(), group.column("t1")[0].as_py()
        rows = _by_width(group.column("brief").to_pylist())
        a, b = [], []
        for v, (left, x) in rows.items():
            for w, (right, y) in rows.items():
                x0, y0 = fold(x, min(v, w)), fold(y, min(v, w))
                fits = t[right] == t1
                for at in np.flatnonzero(t[left] == t0):
                    i = left[at]
                    ok = fits & (comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))
                    if t0 == t1:
                        ok &= node[right] > node[i]
                    j = np.flatnonzero(ok)
                    j = right[j[_bound_allows(y0[j], x0[at], n[right[j]] + n[i], percent)]]
                    a.append(np.minimum(node[j], node[i]))
                    b.append(np.maximum(node[j], node[i]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return rows.groupBy("sig", "t0", "t1").applyInArrow(pairs, "a long, b long").unionByName(twos).distinct()


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None, seed: int = 1, all_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, key, n_shingles, node, component_id, first) of every row, and links (a, b, common) between nodes.

    doc_id and component_id are NO_ID for null; key tells texts under one doc_id; first: whether the row stands for its class.
    The links are those that were counted; together they connect whatever all links connect. all_links: every link
    between different sets. Then all pairs that share a fragment and pass the bounds are counted, also within a class,
    which is as much work as there are such pairs.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    given, docs = docs, keyed(docs)
    by_doc = scratch.save(_nodes(docs, k, seed), "nodes")
    n_docs = by_doc.count()
    reps = by_doc.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.min("extra").alias("e0"), F.max("extra").alias("e1"))
    reps = scratch.save(reps, "reps", n_docs)
    n, clash = reps.agg(F.count("*"), F.max(F.col("e0") != F.col("e1"))).first()  # n bounds what has a row a node below
    if clash:
        return jaccard_classes(given, k, percent, Scratch(spark, "ngram-join"), seed + 1, all_links)

    sigs = _signatures(docs, k, percent, seed)
    shared = sigs.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("sig", "size")
    shared = scratch.save(shared, "shared")
    scratch.release(0.3)  # before the signatures are shuffled once more
    members = scratch.save(sigs.join(shared, "sig").select("sig", "node", "rule", "size").distinct(), "members")
    del sigs, shared
    scratch.drop("shared")
    scratch.release(0.3)
    # of a node's fragments in one class, the `need` - 1 most shared are left out
    met = members.repartition("node")
    often = Window.partitionBy("node", "rule").orderBy(F.desc("size"), F.desc("sig"))
    met = met.withColumn("rank", F.row_number().over(often)).where(F.col("rank") >= F.col("rule").bitwiseAND((1 << 40) - 1))
    # a node whose fragments are widely shared stands in the middle of its group: it leads its blocks
    weighed = scratch.save(met.select("sig", "node", F.sum("size").over(Window.partitionBy("node")).alias("weight")), "weighed", members.count(), 20_000)
    del members, met
    scratch.drop("members")
    n_met = weighed.count()
    wanted = weighed.select("node").distinct().join(reps.select("node", "rep.*"), "node")
    profiles = scratch.save(_profiles(docs.join(wanted, ["doc_id", "key"]).select("node", "text").dropDuplicates(["node"]), k), "profiles", n, 2000)
    alone = reps.select("node", F.col("node").alias("comp")).limit(0)
    if all_links:
        tried, found, comp = alone.toDF("a", "b"), [], None
        split = weighed.select("sig", "node", F.col("node").alias("comp"))
    else:
        leaders = weighed.groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("top")).select("sig", F.col("top.node").alias("leader"))
        tried = scratch.save(_star_pairs(weighed.join(leaders, "sig").select("node", "leader")), "stars-0", n)
        found = [_links(tried, profiles, percent, scratch, "stars-0")]
        comp = _merge(None, found[0], scratch, "near-0", n) if found[0] else None
        split = scratch.save(_split_blocks(weighed.select("sig", "node"), comp or alone), "split-0", n_met, 20_000)
        scratch.drop("weighed")
    for i in range(1, 1 if all_links else STARS):
        if split.isEmpty():
            break
        more = scratch.save(_cross_stars(split, i).join(tried, ["a", "b"], "left_anti"), f"stars-{i}", n)
        tried = tried.unionByName(more)
        if links := _links(more, profiles, percent, scratch, f"stars-{i}"):
            found.append(links)
            comp = _merge(comp, links, scratch, f"near-{i}", n)
            split = scratch.save(_split_blocks(split.select("sig", "node"), comp), f"split-{i}", n_met, 20_000)
    if not split.isEmpty():
        rest = scratch.save(_tiles(split, profiles, percent, scratch).join(tried, ["a", "b"], "left_anti"), "rest")
        if links := _links(rest, profiles, percent, scratch, "rest"):
            found.append(links)
            comp = _merge(comp, links, scratch, "all", max(n, links.count()) if all_links else n)
    found = [x for x in found if x]
    links = functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "a long, b long, common long")
    named = scratch.save(reps.select("node", "rep").join(comp or alone, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named", n)
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    node_class = named.join(least, "comp").select("node", "least")
    first = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    out = by_doc.where("node IS NOT NULL").join(node_class, "node").select("doc_id", "key", F.col("n").alias("n_shingles"), "node", F.col("least.doc_id").alias("component_id"), first.alias("first"))
    empty = by_doc.where("node IS NULL").select("doc_id", "key", F.col("n").alias("n_shingles"), "node", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return out.unionByName(empty), links


def jaccard_links(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row; n_links: how many other rows it links with directly, rows with an equal set among them.

    Equal sets are one node with a weight, so only links between different sets are counted one by one.
    """
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    rows, links = jaccard_classes(docs, k, percent, all_links=True)
    size = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("size"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(size.toDF("b", "size"), "b").groupBy("a").agg(F.sum("size").alias("near")).toDF("node", "near")
    counts = size.join(near, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    out = rows.where("node IS NOT NULL").join(counts, "node").select("doc_id", "n_shingles", "component_id", "n_links")
    out = out.unionByName(rows.where("node IS NULL").select("doc_id", "n_shingles", "component_id", F.lit(0).cast("long").alias("n_links")))
    return out.select(known("doc_id"), "n_shingles", known("component_id"), "n_links")


def jaccard_report(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return jaccard_classes(docs, k, percent)[0].select(known("doc_id"), "n_shingles", known("component_id"))


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate class: that of the least doc_id, and of several texts under it the one of the least key.

    Rows equal in doc_id and text stay or go together.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    classes = jaccard_classes(docs, k, percent, scratch)[0]
    i, k = own_names(docs, "id", "key")
    gone = scratch.save(classes.where("NOT first").select(F.col("doc_id").alias(i), F.col("key").alias(k)).distinct(), "gone")
    named = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(k, key_of(F.col("text")))
    return named.join(gone, [i, k], "left_anti").select(docs.columns)
