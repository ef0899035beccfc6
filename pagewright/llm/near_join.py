"""N-gram Jaccard self-join by chosen paths.

1. A text is its set of five-word shingles. Equal sets are one class from the start (one row, with its
   copies counted), so copies never meet each other in a join.
2. A set has ``COORDINATES`` sampled tokens, its minima under as many hash functions. A path starts at a
   run; every node samples one coordinate, or two with chance 1/4 (1 / 0.8 on average, so that a pair at the
   threshold keeps meeting), and all sets with the same token there go on together.
3. Groups of at most ``LEAF`` sets, groups that hold most of their parent's, and all at the last depth, are leaves. Leaves with the same sets are
   worked on once. In a leaf all pairs are compared exactly, by products of incidence matrices; a leaf over
   ``BLOCK`` sets is cut into blocks whose pairs of blocks are tasks of their own. A pair counts in the
   smallest leaf that it shares, so links are exact counts however often a pair meets.
   In a leaf over ``BLOCK`` sets, ``PIVOTS`` of them are representatives. Jaccard distance is a metric, so any two sets within half the
   greatest distance of one representative are linked: they are its ball, and the links within are counted from the ball's size, without
   comparing (nor listing) its pairs. A set belongs to one ball at most. Only pairs that are not of one ball are compared.
4. Runs are repeated until a pair at the threshold shares a leaf with chance ``recall``, over all draws of the sampled
   tokens and of the paths. Paths are as long as it takes until groups that share ``SHARED`` of their tokens by
   chance have come down to a leaf's size, so they grow with the logarithm of the table.
5. Each leaf gives a set the least set of its local component; the classes are the connected components of
   these edges, found by alternating star contractions over tables in the shared folder.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; texts of fewer than five
words are one shingle; null, empty and blank texts have equal (empty) sets and so form one class; rows that
repeat are rows of their own; null ids stay; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.hashes import shingle_sets
from pagewright.llm.shared import drop, keep, slices, tables

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
LEAF = 32
BLOCK = 512
#: Representatives tried for each leaf over one block.
PIVOTS = 8
#: Parts of a group of any size where a table with a row for each group is joined to its members.
SALTS = 32
#: Share of the sets of a group that go on together by a token that need not make them alike.
SHARED = 0.15
#: Share of its parent from which a group counts as dense and is a leaf.
DENSE = 0.7
RECALL = 0.9999


def chance_to_meet(similarity: float, depth: int) -> float:
    """That a pair shares a leaf of one run, at the depth given."""
    p = 1.0
    for _ in range(depth):
        q = similarity * p
        p = 0.75 * q + 0.25 * (1 - (1 - q) ** 2)
    return p


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs after which a pair shares a leaf with chance ``recall``, whichever of the sampled tokens agree."""
    ways = [math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(COORDINATES + 1)]
    apart = [1 - chance_to_meet(k / COORDINATES, depth) for k in range(COORDINATES + 1)]
    runs = 1
    while sum(w * q**runs for w, q in zip(ways, apart, strict=True)) > 1 - recall:
        runs += 1
    return runs


def depth_for(sets: int, leaf: int) -> int:
    return max(3, math.ceil(math.log(max(sets, 1) / leaf) / -math.log(SHARED)))


def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def minima(tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sampled tokens (32 bits of each) at all coordinates."""
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(tokens), 1024):
        part = ((tokens[i : i + 1024, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        np.minimum(best, part.min(axis=0), out=best)
    return best


def sketches(df: DataFrame, text_col: str, carry: list[str], size: int) -> DataFrame:
    """The carried columns, digest of the set, sampled tokens (4 bytes each), and the text, compressed; rid numbers the rows."""
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = df.select(*own, F.col(text_col).cast("string").alias("text"))

    def sketch(batches):
        a, b = _hash_functions()
        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column(len(carry))
            digests, samples = [], []
            for s in shingle_sets(texts, size):
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                samples.append(minima(s, a, b).tobytes())
            packed = [None if t is None else shrink(t.encode()) for t in texts.to_pylist()]
            made = [pa.array(x, pa.binary()) for x in (digests, samples, packed)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], [*batch.schema.names[: len(carry)], "digest", "sample", "packed"])

    schema = rows.drop("text").schema.add("digest", "binary").add("sample", "binary").add("packed", "binary")
    return keep(rows.mapInArrow(sketch, schema).withColumn("rid", F.monotonically_increasing_id()), "sketches")


def unpacked(packed: list) -> list:
    grow = zstandard.ZstdDecompressor().decompress
    return [None if x is None else grow(x).decode() for x in packed]


def leaves_of(reps: DataFrame, runs: int, depth: int, leaf: int) -> DataFrame:
    """(path, rep, n): the leaves with two sets or more, those with the same sets once."""
    spark, rng = reps.sparkSession, np.random.default_rng(7)
    picks = []
    for r in range(runs):
        first = rng.choice(COORDINATES, 2, replace=False).tolist()
        picks += [(r, c) for c in first[: 2 if r % 4 == 3 else 1]]
    token = lambda c: f"substring(sample, 4 * ({c}) + 1, 4)"
    with tables() as made:
        level = reps.select("rep", F.expr("explode(array(" + ", ".join(f"xxhash64({r}, {c}, {token(c)})" for r, c in picks) + ")) AS path"))
        level = level.withColumn("parent", F.lit(1 << 62))
        found = None
        for k in range(1, depth + 1):
            sizes = level.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
            level = keep(level.join(sizes, "path"), f"paths-{k}")
            # a group that a shared token hardly divides holds sets that are alike: splitting it on would not help
            ends = (F.col("n") <= leaf) | (F.col("n") >= DENSE * F.col("parent"))
            done = level if k == depth else level.filter(ends)
            done = done.select("path", "rep", "n")
            found = done if found is None else found.unionByName(done)
            level = level.filter(~ends)
            if k == depth or level.isEmpty():
                break
            one, two = (f"cast(pmod(xxhash64(path, {j}), {COORDINATES}) AS int)" for j in (1, 2))
            next_paths = (
                f"filter(array(xxhash64(path, {one}, {token(one)}), "
                f"if(pmod(xxhash64(path, 0), 4) = 0 AND {one} <> {two}, xxhash64(path, {two}, {token(two)}), null)), x -> x IS NOT NULL)"
            )
            level = level.join(reps.select("rep", "sample"), "rep").select("rep", F.col("n").alias("parent"), F.expr(f"explode({next_paths}) AS path"))
            level = keep(level, f"steps-{k}")  # read twice, for the groups' sizes and for their members: else all paths are made twice
        out = once(found)
    drop(spark, made[:-1])
    return out


def once(leaves: DataFrame) -> DataFrame:
    """(path, rep, n) with the leaves that hold the same sets only once, and those of one set not at all."""
    contents = leaves.groupBy("path").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("x"), F.expr("bit_xor(xxhash64(rep, 1))").alias("y"))
    kept = contents.filter("n > 1").groupBy("n", "x", "y").agg(F.min("path").alias("path")).select("path", "n")
    return keep(leaves.select("path", "rep").join(kept, "path"), "leaves")


def spread(members: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``members`` joined to ``groups`` (one row for each of ``on``), a group's members (rep) over ``SALTS`` tasks."""
    salted = groups.withColumn("_salt", F.expr(f"explode(sequence(0, {SALTS - 1}))"))
    own = members.withColumn("_salt", F.expr(f"cast(pmod(xxhash64(rep, 3), {SALTS}) AS int)"))
    return own.join(salted, [*on, "_salt"], how).drop("_salt")


def in_groups(rows: DataFrame, keys: list[str], order: list[str], names: list[str], work, schema: str) -> DataFrame:
    """Apply ``work`` to the rows (as dicts of ``names``) of each group, which one task holds at a time; groups are bounded by what calls this."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*names)
    shape = [(c.strip().split(" ")) for c in schema.split(",")]

    def run(batches):
        held: list[dict] = []
        found: list[tuple] = []
        table = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(len(shape))], [n for n, _ in shape])
        for b in batches:
            for r in b.to_pylist():
                if held and any(held[0][k] != r[k] for k in keys):
                    found += work(held)
                    held = []
                held.append(r)
            if len(found) > 10_000:
                yield table()
                found = []
        if held:
            found += work(held)
        yield table()

    return rows.mapInArrow(run, schema)


def by_blocks(leaves: DataFrame, payload: DataFrame, block: int, work, names: list[str], schema: str) -> DataFrame:
    """Apply ``work`` (rows of one leaf, or of two of its blocks, as dicts) where they meet.

    ``leaves`` has path, rep, n, and inner: null, or how many of the leaf's n sets need not meet one another, the same for all its rows, with
    within telling whether this set is one of them. Every two other blocks of a leaf must meet once, so a set goes to as many tasks as its
    leaf has such blocks: to one, where the leaf has at most ``block`` sets.
    """
    inner = "coalesce(inner, 0)"
    placed = leaves.withColumn("first", F.expr(f"cast(ceil({inner} / {block}) AS int)")).withColumn("blocks", F.expr(f"first + cast(ceil((n - {inner}) / {block}) AS int)"))
    own = F.expr("cast(if(within, pmod(xxhash64(rep), first), first + pmod(xxhash64(rep), blocks - first)) AS int)")
    pairs = placed.filter("blocks > first").withColumn("block", own)
    pairs = pairs.withColumn("other", F.expr("explode(sequence(if(within, first, 0), blocks - 1))"))
    pairs = pairs.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("n", "first", "blocks", "inner", "within", "other")
    # a merge join at every size: what is estimated of the leaves says little, and they grow with the table
    return in_groups(pairs.hint("merge").join(payload, "rep"), ["path", "lo", "hi"], ["rep"], names, work, schema)


def uncut(leaves: DataFrame) -> DataFrame:
    return leaves.withColumns({"inner": F.lit(None).cast("long"), "within": F.lit(False)})


def plausible(leaves: DataFrame, reps: DataFrame, similarity: float, block: int) -> DataFrame:
    """The leaves without sets that are like no other in them, by their sampled tokens: agreement five standard
    deviations below ``similarity`` is let through; by the exact binomial tail a pair at 0.8 fails here 4.2 times in a million. Leaves over
    one block, which are dense or could not be divided, stay as they are."""
    small, large = leaves.filter(F.col("n") <= block), leaves.filter(F.col("n") > block)
    least = COORDINATES * similarity - 5 * math.sqrt(COORDINATES * similarity * (1 - similarity))

    def likely(rows: list[dict]) -> list[tuple]:
        sample = np.stack([np.frombuffer(r["sample"], np.uint32) for r in rows])
        agree = np.zeros((len(rows), len(rows)), np.uint8)
        for c in range(COORDINATES):
            agree += sample[:, c, None] == sample[None, :, c]
        near = agree >= least
        np.fill_diagonal(near, False)
        return [(rows[i]["path"], rows[i]["rep"]) for i in np.flatnonzero(near.any(1)).tolist()]

    names = ["path", "lo", "hi", "block", "rep", "sample"]
    rows = by_blocks(uncut(small), reps.select("rep", "sample"), block, likely, names, "path long, rep long")
    return once(keep(rows.unionByName(large.select("path", "rep")), "plausible"))


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs that are similar enough; the diagonal is false."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros((m, m), bool)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = np.flatnonzero(seen > 1)  # tokens of one set add to no intersection
    number = np.full(len(seen), -1, np.int64)
    number[shared] = np.arange(len(shared))
    column = number[column]
    held = column >= 0
    row, column = row[held], column[held]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((m, m), np.float64)
    width = max(256, 2_000_000 // m)
    for c in range(0, len(shared), width):
        lo, hi = np.searchsorted(column, [c, c + width])
        part = np.zeros((m, min(width, len(shared) - c)), np.float32)
        part[row[lo:hi], column[lo:hi] - c] = 1
        both += part @ part.T
    out = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def near_pivots(rows: list[dict], similarity: float, size: int) -> list[tuple]:
    """(rep, pivot) for the members of one block that are within half the greatest distance of a pivot of its leaf."""
    sets = list(shingle_sets(pa.array(unpacked([r["packed"] for r in rows]), pa.large_string()), size))
    members = [i for i, r in enumerate(rows) if not r["is_pivot"]]
    if not members:
        return []
    sizes = np.array([len(sets[i]) for i in members], np.int64)
    tokens = np.concatenate([sets[i] for i in members])
    ends = np.cumsum(sizes)
    found = []
    for i, r in enumerate(rows):
        own = sets[i]
        if not r["is_pivot"] or not len(own):
            continue
        at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
        upto = np.concatenate([[0], np.cumsum(own[at] == tokens)])
        both = upto[ends] - upto[ends - sizes]
        # the margin keeps rounding from letting in a pair that is just too far
        close = both >= (1 + similarity) / 2 * (sizes + len(own) - both) + 1e-9
        found += [(rows[members[j]]["rep"], r["rep"]) for j in np.flatnonzero(close).tolist()]
    return found


def balls(leaves: DataFrame, payload: DataFrame, similarity: float, size: int, block: int) -> DataFrame:
    """(rep, ball): for sets of leaves over one block, the pivot whose ball they belong to, the largest of those that hold them.

    A leaf's pivots are the sets that come first by a hash, so leaves that share most of their sets share pivots too.
    """
    large = leaves.filter(F.col("n") > block).withColumn("blocks", F.expr(f"cast(ceil(n / {block}) AS int)"))
    first = F.expr(f"slice(array_sort(collect_list(struct(h, rep))), 1, {PIVOTS})")
    drawn = large.withColumn("h", F.xxhash64("rep", F.lit(11)))
    # the first of each part of a leaf, then of the leaf: no list is longer than a part's few
    least = F.row_number().over(Window.partitionBy("path", "part").orderBy("h", "rep"))
    drawn = drawn.withColumn("part", F.expr("cast(pmod(xxhash64(rep, 5), blocks) AS int)")).withColumn("at", least).filter(F.col("at") <= PIVOTS)
    least = F.row_number().over(Window.partitionBy("path", "upper").orderBy("h", "rep"))
    drawn = drawn.withColumn("upper", F.expr("cast(part div ceil(sqrt(blocks)) AS int)")).withColumn("at", least).filter(F.col("at") <= PIVOTS)
    pivots = drawn.groupBy("path", "blocks").agg(first.alias("p")).select("path", "blocks", F.expr("explode(p.rep) AS rep"))
    pivots = pivots.select("path", "rep", F.expr("explode(sequence(0, blocks - 1)) AS lo"), F.lit(True).alias("is_pivot"))
    members = large.select("path", "rep", F.expr("cast(pmod(xxhash64(rep), blocks) AS int) AS lo"), F.lit(False).alias("is_pivot"))
    rows = pivots.unionByName(members).hint("merge").join(payload, "rep")
    names = ["path", "lo", "rep", "is_pivot", "packed"]
    near = in_groups(rows, ["path", "lo"], ["rep"], names, lambda rows: near_pivots(rows, similarity, size), "rep long, ball long")
    near = keep(near.distinct(), "near-pivots")
    held = spread(near, near.groupBy("ball").agg(F.count("*").alias("held")), ["ball"])
    return keep(held.groupBy("rep").agg(F.max_by("ball", F.struct("held", "ball")).alias("ball")), "balls")


def cut_by_balls(leaves: DataFrame, owned: DataFrame, block: int) -> DataFrame:
    """``leaves`` with ball, and for those over one block inner and within by the ball that has most of their sets."""
    rows = leaves.join(owned, "rep", "left")
    sizes = rows.filter((F.col("n") > block) & F.col("ball").isNotNull()).groupBy("path", "ball").agg(F.count("*").alias("inner"))
    main = sizes.groupBy("path").agg(F.max("inner").alias("inner"), F.max_by("ball", F.struct("inner", "ball")).alias("main"))
    small = uncut(rows.filter(F.col("n") <= block))
    large = spread(rows.filter(F.col("n") > block), main, ["path"], "left").withColumn("within", F.expr("ball IS NOT NULL AND ball <=> main")).drop("main")
    return small.unionByName(large)


def local_roots(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each row's component."""
    root = ids.copy()
    while True:
        best = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (best == root).all():
            return root
        root = best


def compared(rows: list[dict], similarity: float, size: int) -> list[tuple]:
    """(rep, links, root) from one leaf, or from two blocks of a leaf."""
    leaf, lo, hi = rows[0]["path"], rows[0]["lo"], rows[0]["hi"]
    ids = np.array([r["rep"] for r in rows], np.int64)
    near = linked(list(shingle_sets(pa.array(unpacked([r["packed"] for r in rows]), pa.large_string()), size)), similarity)
    if lo != hi:
        block = np.array([r["block"] for r in rows])
        near &= block[:, None] != block[None, :]
    if not near.any():
        return []
    root = local_roots(near, ids)
    ball = np.array([-1 if r["ball"] is None else r["ball"] for r in rows], np.int64)
    near &= (ball[:, None] != ball[None, :]) | (ball[:, None] < 0)  # pairs of one ball are counted by its size
    earlier = sorted({p for r in rows for p in r["paths"] if p < leaf})
    if earlier:  # pairs that share a smaller leaf are counted there
        place = {p: i for i, p in enumerate(earlier)}
        member = np.zeros((len(rows), len(earlier)), np.float32)
        for i, r in enumerate(rows):
            member[i, [place[p] for p in r["paths"] if p < leaf]] = 1
        near &= (member @ member.T) == 0
    links = near @ np.array([r["copies"] for r in rows], np.int64)
    return list(zip(ids.tolist(), links.tolist(), root.tolist(), strict=True))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): alternating large-star and small-star until nothing moves."""
    spark, before = edges.sparkSession, None
    with tables() as made:
        edges = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        while True:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
            edges = keep(small, "edges")
            drop(spark, made[:-1])
            made[:-1] = []
            now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()
            if now == before:
                break
            before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classed(made: DataFrame, similarity: float, size: int, recall: float, depth: int | None, leaf: int, block: int) -> DataFrame:
    """rid, root, n_links and copies of every row of the sketches."""
    spark = made.sparkSession
    groups = made.groupBy("digest").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"), F.first("sample").alias("sample"))
    groups = keep(groups, "sets")
    depth = depth_for(groups.count(), leaf) if depth is None else depth
    with tables() as meanwhile:
        leaves = leaves_of(groups.select("rep", "sample"), runs_for(recall, similarity, depth), depth, leaf)
        leaves = plausible(leaves, groups, similarity, block)
        lists = leaves.groupBy("rep").agg(F.collect_set("path").alias("paths"))  # a leaf of each run and branch at most
        payload = made.select("packed", F.col("rid").alias("rep"))
        owned = balls(leaves, payload, similarity, size, block)
        wanted = cut_by_balls(leaves, owned, block).join(lists, "rep").join(groups.select("rep", "copies"), "rep")
        names = ["path", "lo", "hi", "block", "rep", "copies", "paths", "ball", "packed"]
        across = by_blocks(wanted, payload, block, lambda rows: compared(rows, similarity, size), names, "rep long, links long, root long")
        within = owned.join(groups.select("rep", "copies"), "rep")
        within = spread(within, within.groupBy("ball").agg(F.sum("copies").alias("all")), ["ball"])
        met = keep(across.unionByName(within.select("rep", (F.col("all") - F.col("copies")).alias("links"), F.col("ball").alias("root"))), "links")
    drop(spark, meanwhile[:-1])
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = groups.select("digest", "rep", "copies").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    return made.select("rid", "digest").join(joined.select("digest", F.coalesce("root", "rep").alias("root"), "copies", n_links), "digest").drop("digest")


def near_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE,
    recall: float = RECALL, depth: int | None = None, leaf: int = LEAF, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: doc_id, class_id (the least id of its class), n_links (other rows that are similar
    enough) and n_copies (rows of the same set, itself included)."""
    with tables() as meanwhile:
        made = sketches(df, text_col, [id_col], size)
        found = classed(made, similarity, size, recall, depth, leaf, block)
        rows = keep(made.select(F.col("c0").alias("doc_id"), "rid").join(found, "rid"), "classed")
    drop(df.sparkSession, meanwhile[:-1])
    classes = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.join(classes, "root").select("doc_id", "class_id", F.col("n_links").cast("long"), F.col("copies").alias("n_copies"))


def near_deduplicated(
    df: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE,
    recall: float = RECALL, depth: int | None = None, leaf: int = LEAF, block: int = BLOCK,
) -> DataFrame:
    """One row of each class (the first by the table's order), with all columns of ``df``."""
    names = df.columns
    carry = [c for c in names if c != text_col]
    made = sketches(df, text_col, carry, size)
    with tables() as meanwhile:
        roots = classed(made, similarity, size, recall, depth, leaf, block).filter("rid <> root").select("rid")
        lost = keep(roots, "lost")
    drop(df.sparkSession, meanwhile[:-1])
    stays = made.join(lost, "rid", "left_anti").select(*[f"c{i}" for i in range(len(carry))], "packed")

    def whole(batches):
        for b in (part for batch in batches for part in slices(batch, len(carry), 1_000_000)):
            columns = dict(zip(carry, b.columns[:-1], strict=True)) | {text_col: pa.array(unpacked(b.column(len(carry)).to_pylist()), pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return stays.mapInArrow(whole, df.schema)
