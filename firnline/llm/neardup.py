"""MinHash near-duplicates by an LSH forest.

Every distinct set of word shingles has a signature of minima, read in several orders. In each order the signatures are
sorted, so texts that agree on the first values, a region, are neighbours, and the common prefix of each with the one
before tells how far a region goes down. Depth adapts to the region: a stretch of few texts yields all its pairs as
candidates, one of many is cut at longer prefixes until few are left; besides, each text of a large one is a candidate
with the neighbours next to it, with the middle text of its region (whose shingles are most often those of the others),
and with the least.

These only join most copies of large groups cheaply. The texts of large regions are then compared exactly: by the
rarest shingles of each, of which two linked texts share one, every pair that the links so far don't join already is a
candidate, block by block where a shingle has many texts. Only pairs within what is joined already are left out, as they
change no component. So a pair is lost only if its texts share no region of the first level at all: in one case of ten
million at a similarity of 0.85, of 100,000 at 0.8. Work grows with the square of a group where neither links nor rare
shingles set its texts apart.

Links are written once for each pair of distinct sets; equal sets share a class. The result is one row for each
document. A text of fewer words than a shingle is one shingle; one without words, or null, has none and no links.
Rows that share a doc_id count as one vertex each, by their own sets; null doc_ids are never a component's name, but link
others. Ties go to the smaller doc_id. An empty table gives an empty result; further columns pass through
`drop_near_duplicates`. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textbytes as tb
from .components import components

ORDERS, DEPTH = 16, 3
VALUES = ORDERS * DEPTH
DEPTHS = (DEPTH, 6, 10, 16, 24, VALUES)
BUCKETS, BLOCK = 1 << 18, 256
_random = np.random.Generator(np.random.PCG64(99))
_A = _random.integers(1, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingle_sets(column: pa.Array, words: int):
    """The sorted distinct shingle hashes of each text, one array after another."""
    buf, offsets = tb.text_bytes(column)
    for a, b in tb.slices(offsets):
        part, own = tb.LOWER[buf[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        start, end, first = tb.runs(~tb.SPACE[part], own)
        h = tb.segments(part, start, end)
        grams = tb.gram(h, words)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= words:
                yield np.unique(grams[lo : hi - words + 1])
            elif hi > lo:
                yield tb.gram(h[lo:hi], hi - lo) ^ np.uint64(hi - lo)
            else:
                yield h[:0]


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, (x[at : at + 4096, None] * _A + _B).min(0), out=out)
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return np.array([tb.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), np.bitwise_xor.reduce(tb.mix(s + np.uint64(len(s))))], np.uint64).tobytes()


def _features(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                n, fp, sig = [], [], []
                for s in shingle_sets(part.column(1), words):
                    n.append(len(s))
                    fp.append(fingerprint(s) if len(s) else None)
                    sig.append(signature(s).view(np.int32) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", "t", "n_shingles", "fp", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, n_shingles long, fp binary, sig array<int>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(fp, shingles) of every text with words."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                sets = [s for s in shingle_sets(batch.column(0).slice(lo, 512), words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp", "shingles"])

    return docs.select("text").mapInArrow(run, "fp binary, shingles array<bigint>")


#: Texts of a region that one task sorts; a larger region is dealt to several.
SORTED = 8192


def stretches(key: np.ndarray, rest: np.ndarray, region: int):
    """Of rows sorted by key and then by the rest of their order: pairs (i, j), and (level, rows) of each large stretch."""
    n = len(key)
    same = key[1:] == key[:-1]
    differ = rest[1:] != rest[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rest.shape[1]) if n > 1 else np.zeros(0, np.int64)
    common = np.append(-1, np.where(same, common + DEPTH, -1))  # with the row before: values that agree
    left, right, large = [], [], []
    open_ = np.ones(n, bool)
    for level, depth in enumerate(DEPTHS):
        start = np.flatnonzero(common < depth)
        size = np.diff(np.append(start, n))
        few = (size > 1) & (size <= region) & open_[start]
        for k in range(1, region):  # pairs k apart
            rows = tb.row_ranges(start[few], np.maximum(0, size[few] - k))
            left.append(rows)
            right.append(rows + k)
        many = (size > region) & open_[start]
        open_ &= np.repeat(many, size)
        if level:
            large += [(level, np.arange(s, s + m)) for s, m in zip(start[many].tolist(), size[many].tolist(), strict=True)]
        if not many.any():
            break
        if not level:  # neighbours in a large region
            next_to = np.flatnonzero((common[1:] >= depth) & open_[1:])
            left.append(next_to)
            right.append(next_to + 1)
    return np.concatenate(left), np.concatenate(right), large


def _regions(classes: DataFrame, region: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of neighbours; (key, fp, c, level) of the texts in large stretches, c texts each."""
    tree = F.col("tree")
    value = lambda i: F.element_at("sig", ((tree * DEPTH + i) % VALUES + 1).cast("int"))
    rows = classes.select("fp", "sig", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("tree"))
    rows = rows.select("fp", "tree", F.xxhash64(tree, *[value(i) for i in range(DEPTH)]).alias("key"))
    many = storage.keep(rows.join(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key"), "regions")
    at = (tree + 1) * DEPTH % VALUES + 1
    rest = F.slice(F.concat("sig", "sig"), at.cast("int"), VALUES - DEPTH)
    salt = F.when(F.col("c") > SORTED, F.pmod(F.xxhash64("fp"), F.ceil(F.col("c") / SORTED))).otherwise(0)
    order = many.join(classes, "fp").select(F.xxhash64("key", salt).alias("k"), rest.alias("rest"), "fp")

    def scan(batches):
        from hashlib import blake2b

        def emit(key, rest, fp):
            left, right, large = stretches(key, rest, region)
            i = np.concatenate([left, *[x for _, x in large]]).astype(np.int64)
            size = [len(x) for _, x in large]
            named = [int.from_bytes(blake2b(key[x[0]].tobytes() + rest[x[0]].tobytes() + bytes([level]), digest_size=8).digest(), "little", signed=True) for level, x in large]
            none = len(left)
            b = fp.take(pa.array(np.append(right, np.full(sum(size), -1)).astype(np.int64), mask=np.arange(len(i)) >= none))
            whole = lambda values: pa.array(np.concatenate([np.zeros(none, np.int64), np.repeat(np.array(values, np.int64), size)]))
            return pa.RecordBatch.from_arrays([fp.take(pa.array(i)), b, whole(named), whole(size), whole([level for level, _ in large])], names=["a", "b", "key", "c", "level"])

        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            rest_of = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(key), VALUES - DEPTH)
            fp = batch.column(2)
            if held:
                key, rest_of, fp = np.append(held[0], key), np.concatenate([held[1], rest_of]), pa.concat_arrays([held[2], fp])
            # the last region may go on in the next batch; one beyond SORTED is large anyway, and cut
            last = int(np.searchsorted(key[::-1] != key[-1], True))
            end = len(key) - last if last <= 4 * SORTED else len(key)
            if end:
                yield emit(key[:end], rest_of[:end], fp.slice(0, end))
            held = (key[end:].copy(), rest_of[end:].copy(), fp.slice(end)) if end < len(key) else None
        if held:
            yield emit(*held)

    dealt = order.repartition("k").sortWithinPartitions("k", "rest", "fp")
    found = storage.keep(dealt.mapInArrow(scan, "a binary, b binary, key long, c long, level long"), "forest")
    pairs = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    large = many.where(F.col("c") > region).select("key", "fp", "c", F.lit(0).cast("long").alias("level"))
    return pairs, large.union(found.where("b is null").select("key", F.col("a").alias("fp"), "c", "level"))


def _middles(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, p, q): every text of a large region with its middle text and its least, once for all regions with the same two."""
    # each text in its largest region of the first level; shingles of more than half of that count for it, others against
    group = large.where("level = 0").groupBy("fp").agg(F.max_by("key", F.struct("c", "key")).alias("g"))
    own = sets.join(group, "fp").select("fp", "g", "shingles")
    often = own.select("g", F.explode("shingles").alias("s")).groupBy("g", "s").agg(F.count("*").alias("n"))
    often = often.join(group.groupBy("g").agg(F.count("*").alias("m")), "g").where("2 * n > m")
    # at most twice as many as a text of the group has
    common = often.groupBy("g").agg(F.collect_list("s").alias("common"))
    score = own.join(common, "g", "left").select("fp", (2 * F.coalesce(F.size(F.array_intersect("shingles", "common")), F.lit(0)) - F.size("shingles")).alias("score"))
    pivots = large.join(score, "fp", "left").groupBy("key").agg(F.max_by("fp", F.struct("score", "fp")).alias("p"), F.min("fp").alias("q"))
    return large.select("key", "fp").join(pivots, "key").select("fp", "p", "q").distinct()


def _stars(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: every text of a large region with its middle text and its least."""
    stars = _middles(large, sets).select("fp", F.explode(F.array_distinct(F.array("p", "q"))).alias("p")).where("fp <> p")
    return stars.select(F.least("fp", "p").alias("a"), F.greatest("fp", "p").alias("b")).distinct()


def _lists(batch: pa.RecordBatch, column: str):
    """The numbers of a column of lists, and where each list begins and the last one ends."""
    x = batch.column(column)
    ends = np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    return x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], ends])


def _bucket(s: np.ndarray) -> np.ndarray:
    return (tb.mix(s.view(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(s, fp, n, at): the rarest shingles of each text, as many as must hold one of any text linked to it.

    Shingles are ordered by how often their bucket occurs, then by hash: any one order of all serves, and a table of
    fixed size gives it. `at` counts the rarer ones of the text.
    """

    def count(batches):
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(_bucket(_lists(batch, "shingles")[0]), minlength=BUCKETS)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n[found], pa.int64())], names=["bucket", "n"])

    counts = sets.select("shingles").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[counts["bucket"].to_numpy()] = counts["n"].to_numpy()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                s, first = _lists(part, "shingles")
                n = np.diff(first)
                some = n - (percent * n + 99) // 100 + 1
                order = np.lexsort((s, often[_bucket(s)], np.repeat(np.arange(len(n)), n)))
                at = np.arange(len(s)) - np.repeat(first[:-1], n)
                own = at < np.repeat(some, n)
                of = np.repeat(np.arange(len(n)), some)
                yield pa.RecordBatch.from_arrays([pa.array(s[order][own]), part.column("fp").take(pa.array(of)), pa.array(n[of]), pa.array(at[own])], names=["s", "fp", "n", "at"])

    return sets.select("fp", "shingles").mapInArrow(run, "s long, fp binary, n long, at long")


def _apart(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb), a < b, among sets: all that can be linked and aren't of one component of found(node, component)."""
    rows = _rarest(sets, percent).join(found.withColumnRenamed("node", "fp"), "fp", "left")
    rows = storage.keep(rows.select("s", "fp", "n", "at", F.coalesce("component", "fp").alias("c")), "rarest")
    # d: the component most frequent at a shingle; one text of each pair is of another
    most = rows.groupBy("s", "c").agg(F.count("*").alias("m")).groupBy("s").agg(F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("c", F.struct("m", "c")).alias("d"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    most = most.where("m > most").select("s", "d", blocks(F.col("m") - F.col("most")).alias("li"), blocks(F.col("m")).alias("ri"))
    rows = storage.keep(rows.join(most, "s"), "shared")
    dealt = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.where("c <> d").select("s", dealt(F.col("li")).alias("i"), each("ri").alias("j"), *[F.col(k).alias("x" + k) for k in ("fp", "n", "at", "c")])
    y = rows.select("s", each("li").alias("i"), dealt(F.col("ri")).alias("j"), "d", *[F.col(k).alias("y" + k) for k in ("fp", "n", "at", "c")])
    # a linked pair has enough left from the first shingle that both have
    enough = F.expr(f"{100 + percent} * least(xn - xat, yn - yat) >= {percent} * (xn + yn) and xc <> yc and (yc = d or xfp < yfp)")
    pairs = x.join(y, ["s", "i", "j"]).where(enough)
    ends = [F.least("xfp", "yfp").alias("a"), F.greatest("xfp", "yfp").alias("b")]
    return pairs.select(*ends, *[F.when((F.col("xfp") < F.col("yfp")) == F.lit(k == "a"), F.col("xn")).otherwise(F.col("yn")).alias("n" + k) for k in "ab"]).distinct()


def _near(docs: DataFrame, words: int, percent: int, region: int) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, component_id: one row for each document."""
    feats = storage.keep(_features(docs, words), "shingles")
    classes = storage.keep(feats.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("t").alias("t"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    size = classes.select("fp", "n")

    def comparable(pairs):
        pairs = pairs.join(size.select(F.col("fp").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("fp").alias("b"), F.col("n").alias("nb")), "b")
        return pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    near, large = _regions(classes.select("fp", "sig"), region)
    pairs = storage.keep(comparable(near), "pairs")
    crowded = not large.isEmpty()
    # the sets of the texts that some pair names, by a hash of one text of each
    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp"))
    if crowded:
        needed = needed.union(large.where("level = 0").select("fp"))
    owners = classes.join(needed.distinct(), "fp", "left_semi").select("t").distinct()
    texts = docs.select("text", F.xxhash64("text").alias("t")).join(owners, "t", "left_semi").groupBy("t", "text").agg(F.lit(1)).select("text")
    sets = storage.keep(_sets(texts, words).dropDuplicates(["fp"]), "sets")
    if crowded:
        pairs = pairs.union(storage.keep(comparable(_stars(large, sets)), "pairs")).distinct()
    left, right = (sets.select(F.col("fp").alias(c), F.col("shingles").alias("s" + c)) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    linked = lambda pairs: pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(linked(pairs))
    if crowded:
        # what the exact comparison adds joins components
        hot = sets.join(large.where("level = 0").select("fp").distinct(), "fp", "left_semi")
        more = storage.keep(linked(storage.keep(_apart(hot, found, percent), "pairs")), "links")
        if not more.isEmpty():
            for end in "uv":
                of = found.select(F.col("node").alias(end), "component")
                more = more.join(of, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
            joined = components(more)
            names = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
            # a text without links until now is its own component
            found = found.join(names, "component", "left").select("node", F.coalesce("least", "component").alias("component")).union(joined).distinct()
    of = classes.select("fp", "rep").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "component").select("fp", "component_id")
    out = feats.select("doc_id", "t", "n_shingles", "fp").join(of, "fp", "left")
    return out.select("doc_id", "t", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _kept():
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, region: int = 12) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept: one row for each document.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of `words`-word shingles.
    """
    return _near(docs, words, percent, region).select("doc_id", "n_shingles", "component_id", _kept().alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, region: int = 12) -> DataFrame:
    """docs without the rows that aren't kept, each judged by its own text; rows without doc_id stay."""
    one, two = "_gone", "_text"
    while {one, two} & {*docs.columns}:
        one, two = one + "_", two + "_"
    gone = _near(docs, words, percent, region).where(~_kept()).select(F.col("doc_id").alias(one), F.col("t").alias(two)).distinct()
    own = [docs["doc_id"] == F.col(one), F.xxhash64(docs["text"]) == F.col(two)]
    return docs.join(gone, own, "left_anti").select(*[f"`{c}`" for c in docs.columns])
