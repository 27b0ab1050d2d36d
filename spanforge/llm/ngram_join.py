"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word n-grams, each a 64-bit hash. Its sketch has m cells; a cell is the XOR of the
hashes that fall into it, so every n-gram that only one of two documents has changes one cell of one of them, and the
number of cells in which two sketches differ is a lower bound of the size of the symmetric difference. Two documents
of a and b n-grams that link at p percent differ in at most D = (a + b)(100 - p)/(100 + p) n-grams. m depends on the
size band (a power of two) and is such that more than D cells are not zero: by the pigeonhole principle linked
documents share a cell, and the join on (band, cell, value) loses none. A document near the lower end of a band is also
sketched for the band below.

A cell value that fewer than RARE documents share is a rare one: its documents are paired at once. Documents with more
than D rare cells need no others. The rest (copies with small edits, documents made of common passages) keep as many
common cells as make D + 1 with their rare ones, the same order for all; on each kept cell the documents are compared
with one centre, the one with the fewest rare cells, and only those that do not link to it are compared with the others
of that centre, in blocks. Documents with equal sets are one class and are compared once. What is found is verified on
whole sets; the result holds a spanning set of links of every component, not all pairs of a component.

Defined results: a text of fewer words than n is one n-gram; without words, or null, it has none and links with nothing;
a null doc_id has a null component; repeated rows give a row each and count as one document; where rows of a doc_id have
different sets, the text with the least hash speaks for all of them (each keeps its own number of n-grams); an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, components, give_back, mix, only_ids, passes, signed, table, tidy, without_ids

RARE = 8
SMALL = 64
SMALL_CELLS = 1 << 20
#: Sketch cells that one bucket of the join holds, about.
PER_BUCKET = 500_000
#: Common values that a task remembers.
REMEMBERED = 1 << 20
BLOCK = 256
_U = np.uint64


def gram_sets(texts: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each distinct n-gram, its hash, number of distinct n-grams of each text), sorted by text and hash."""
    words = Words(texts, fold=True)
    count = np.diff(words.first)
    full = words.windows(n_words)
    inside = words.inside(n_words)
    owner, grams = words.doc[: len(full)][inside], full[inside]
    short = np.flatnonzero((count > 0) & (count < n_words))
    if len(short):
        whole, power = np.zeros(len(short), np.uint64), np.ones(1, np.uint64)
        for j in range(n_words - 1):
            has = count[short] > j
            whole[has] += power * words.hash[0][words.first[:-1][short[has]] + j]
            power = power * _U(0xE7037ED1A0B428DB)
        owner = np.concatenate([owner, short])
        grams = np.concatenate([grams, mix(whole ^ count[short].astype(np.uint64))])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    owner, grams = owner[keep], grams[keep]
    return owner, grams, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def level_of(n: np.ndarray) -> np.ndarray:
    """The size band: 0 below SMALL, else the whole logarithm."""
    return np.where(n < SMALL, 0, np.floor(np.log2(np.maximum(n, 1) + 0.5)).astype(np.int64))


def has_below(n: np.ndarray, percent: int) -> np.ndarray:
    """Whether a document of the band below can be large enough to link."""
    level = level_of(n)
    return (level > 0) & (n * percent <= 100 * ((1 << level) - 1))


def cells(owner: np.ndarray, grams: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of each cell that is not zero. level: of each text, negative for none. The key's low bits are the level."""
    at = level[owner]
    use = at >= 0
    owner, grams, at = owner[use], grams[use], at[use]
    m = np.where(at == 0, SMALL_CELLS, (7 << at) // 10).astype(np.uint64)
    cell = ((mix(grams ^ _U(0x5851F42D4C957F2D)) >> _U(32)) % m).astype(np.int64)
    place = owner * (1 << 40) + cell
    order = np.argsort(place, kind="stable")
    place, grams = place[order], grams[order]
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    parity = np.bitwise_xor.reduceat(mix(grams), first)
    owner, cell, at = owner[order][first], place[first] % (1 << 40), at[order][first]
    keep = parity != 0
    key = mix(parity ^ mix(cell.astype(np.uint64) * _U(64) + at.astype(np.uint64)))
    key = (key & ~_U(63)) | at.astype(np.uint64)
    return owner[keep], key[keep]


def _meta(n_words: int, percent: int):
    @tidy
    def run(batches):
        for batch in batches:
            for part in passes(batch):
                owner, grams, n = gram_sets(part.column("text"), n_words)
                own, below = cells(owner, grams, level_of(n)), cells(owner, grams, np.where(has_below(n, percent), np.where(n < 2 * SMALL, 0, level_of(n) - 1), -1))
                digest = []
                for salt in (0x1B873593CC9E2D51, 0x27D4EB2F165667C5):
                    total = np.zeros(len(n), np.uint64)
                    np.add.at(total, owner, mix(grams ^ _U(salt)))
                    digest.append(signed(total))
                counted = [pa.array(np.bincount(x[0], minlength=len(n)).astype(np.int64)) for x in (own, below)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *digest, *counted], ["doc_id", "n", "d1", "d2", "nz", "nz_below"])

    return run


def _postings(n_words: int, percent: int, buckets: int):
    @tidy
    def run(batches):
        turn, known = 0, np.zeros(0, np.uint64)
        for batch in batches:
            for part in passes(batch.filter(pc.is_valid(batch.column("doc_id")))):
                owner, grams, n = gram_sets(part.column("text"), n_words)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                found = [cells(owner, grams, level_of(n)), cells(owner, grams, np.where(has_below(n, percent), np.where(n < 2 * SMALL, 0, level_of(n) - 1), -1))]
                docs, keys = ids[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found])
                order = np.lexsort((docs, keys))
                docs, keys = docs[order], keys[order]
                if len(keys):  # repeated rows are one posting, or their rank would make a rare value look common
                    once = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))
                    docs, keys = docs[once], keys[once]
                new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
                rank = np.arange(len(keys)) - np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
                # of a value that is common in one pass, RARE postings say so to its bucket; the others of the task are
                # known to be common, so that a bucket gets RARE for each task at most
                common = (rank >= RARE) | (np.isin(keys, known) if len(known) else False)
                if (fresh := np.unique(keys[rank >= RARE])).size:
                    known = np.union1d(known, fresh) if len(known) + len(fresh) <= REMEMBERED else fresh
                out = []
                if common.any():
                    out.append((1, (turn * 7919 + int(ids[0])) % buckets, keys[common].tobytes(), docs[common].tobytes()))
                docs, keys = docs[~common], keys[~common]
                bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else []
                for s, e in zip(edges, [*edges[1:], len(keys)], strict=True):
                    out.append((0, int(bucket[s]), keys[s:e].tobytes(), docs[s:e].tobytes()))
                turn += 1
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "bucket", "keys", "docs"])

    return run


def _match(group: pa.Table) -> pa.Table:
    """Pairs of documents that share rare values of this bucket, how many and of which level (kind 0); postings (doc, key)
    of common values (kind 1)."""
    kind = group.column("kind").to_numpy()
    blobs = [[np.frombuffer(b, np.int64) for b in group.column(c).to_pylist()] for c in ("keys", "docs")]
    join = lambda which, k: np.concatenate([b for b, x in zip(blobs[which], kind, strict=True) if x == k] or [np.zeros(0, np.int64)])
    keys, docs = join(0, 0), join(1, 0)
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (docs[1:] == docs[:-1])  # of repeated rows
    keys, docs = keys[~same], docs[~same]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    rare, some = size < RARE, size > 1
    keys, docs, rare = keys[some], docs[some], rare[some]
    a, b, at = [], [], []
    for step in range(1, RARE):
        hit = np.flatnonzero((keys[step:] == keys[:-step]) & rare[step:])
        a.append(docs[hit])
        b.append(docs[hit + step])
        at.append(keys[hit] & 63)
    a, b, at = np.concatenate(a), np.concatenate(b), np.concatenate(at)
    order = np.lexsort((at, b, a))
    a, b, at = a[order], b[order], at[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (at[1:] != at[:-1]))) if len(a) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(a)))
    heavy_docs = np.concatenate([docs[~rare], join(1, 1)])
    heavy_keys = np.concatenate([keys[~rare], join(0, 1)])
    rest = np.zeros(len(heavy_docs), np.int64)
    kinds = np.concatenate([np.zeros(len(first), np.int32), np.ones(len(heavy_docs), np.int32)])
    give_back()
    return pa.table({"kind": kinds, "a": np.concatenate([a[first], heavy_docs]), "b": np.concatenate([b[first], heavy_keys]), "level": np.concatenate([at[first], rest]), "n": np.concatenate([many, rest])})


def _sets(n_words: int):
    @tidy
    def run(batches):
        for batch in batches:
            for part in passes(batch):
                owner, grams, n = gram_sets(part.column("text"), n_words)
                ends = np.cumsum(n)
                blobs = [grams[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "grams"])

    return run


def _verify(percent: int):
    @tidy
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block(percent: int):
    """Links between the documents of two blocks: their sets as 0/1 matrices, a stretch of n-grams at a time."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = [[np.frombuffer(b, np.uint64) for b in t.column("grams").to_pylist()] for t in (left, right)]
        ids = [t.column("doc").to_numpy() for t in (left, right)]
        if not sets[0] or not sets[1]:
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        tokens = [np.concatenate(s) for s in sets]
        rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sets]
        shared = np.intersect1d(*tokens)
        found = []
        for t, r in zip(tokens, rows, strict=True):
            at = np.minimum(np.searchsorted(shared, t), max(len(shared) - 1, 0))
            keep = shared[at] == t if len(shared) else np.zeros(len(t), bool)
            order = np.argsort(at[keep], kind="stable")
            found.append((at[keep][order], r[keep][order]))
        common = np.zeros((len(sets[0]), len(sets[1])), np.float64)
        for s in range(0, len(shared), 4096):
            part = []
            for (at, r), side in zip(found, sets, strict=True):
                lo, hi = np.searchsorted(at, [s, s + 4096])
                m = np.zeros((len(side), 4096), np.float32)
                m[r[lo:hi], at[lo:hi] - s] = 1
                part.append(m)
            common += part[0] @ part[1].T
        sizes = [np.array([len(x) for x in s], np.float64) for s in sets]
        union = sizes[0][:, None] + sizes[1][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (ids[0][:, None] != ids[1][None, :]))
        a, b = ids[0][i], ids[1][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, n_words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text). Who gives the scratch can drop it after the result is written."""
    scratch = scratch or Scratch(spark, "ngrams")
    docs = docs.select("doc_id", "text")
    described = lambda df: df.mapInArrow(_meta(n_words, percent), "doc_id long, n long, d1 long, d2 long, nz long, nz_below long")
    meta = scratch.table(described(docs), "meta")
    rows = meta.select("doc_id", "n")
    # of the texts of one doc_id one speaks for it
    sets = F.struct("n", "d1", "d2")
    several = scratch.table(meta.where("doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("a"), F.max(sets).alias("b")).where("a <> b").select("doc_id"), "several")
    torn = not several.isEmpty()
    if torn:
        spoken = only_ids(spark, docs, several).where("text is not null").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        docs = without_ids(spark, docs, several).union(scratch.table(spoken, "spoken"))
        meta = scratch.table(described(docs), "spoken-meta")
    total = meta.agg(F.sum(F.col("nz") + F.col("nz_below"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_BUCKET))

    # classes of equal sets; the rest works on their smallest documents
    classes = meta.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("nz").alias("nz"), F.min("nz_below").alias("nz_below"))
    classes = scratch.table(classes, "classes")
    reps = classes.select(F.col("rep").alias("doc"), "n", "nz", "nz_below")

    posted = docs.mapInArrow(_postings(n_words, percent, buckets), "kind int, bucket int, keys binary, docs binary")
    found = scratch.table(posted.groupBy("bucket").applyInArrow(_match, "kind int, a long, b long, level long, n long"), "found")

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    own = F.when(F.col("n") < SMALL, 0).otherwise(F.floor(F.log2(F.col("n") + F.lit(0.5)))).cast("long")
    common = found.where("kind = 1").select(F.col("a").alias("doc"), F.col("b").alias("key")).join(reps, "doc")
    level = F.col("key").bitwiseAND(F.lit(63))
    most = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent)).cast("int")
    common = common.groupBy("doc", "n", F.when(level == own, F.col("nz")).otherwise(F.col("nz_below")).alias("cells"), level.alias("level")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    common = scratch.table(common.withColumn("most", most).withColumn("rare", (F.col("cells") - F.size("keys")).cast("int")), "common")
    # of a pair that links, all but D of the larger number of cells are shared: the rare ones counted here, the common
    # ones at most as many as either has
    sizes = reps.withColumn("own", own)
    heavy = common.select("doc", "level", F.size("keys").alias("common"))
    side = lambda x: sizes.select(F.col("doc").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "nz", "nz_below", "own")])
    extra = lambda x: heavy.select(F.col("doc").alias(x), "level", F.col("common").alias(f"common_{x}"))
    cells_of = lambda x: F.when(F.col("level") == F.col(f"own_{x}"), F.col(f"nz_{x}")).otherwise(F.col(f"nz_below_{x}"))
    pairs = found.where("kind = 0").groupBy("a", "b", "level").agg(F.sum("n").alias("shared"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(fits(F.col("n_a"), F.col("n_b")) & (F.col("level") == F.least("own_a", "own_b")))
    pairs = pairs.join(extra("a"), ["a", "level"], "left").join(extra("b"), ["b", "level"], "left")
    bound = F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))
    may = F.col("shared") + F.least(F.coalesce("common_a", F.lit(0)), F.coalesce("common_b", F.lit(0)))
    pairs = pairs.where(may >= F.greatest(cells_of("a"), cells_of("b")) - bound).select("a", "b")
    common = common.where("rare <= most")
    kept = common.select("doc", "n", "rare", F.explode(F.slice("keys", F.lit(1), F.col("most") + 1 - F.greatest(F.lit(0), F.col("rare")))).alias("key"))
    kept = scratch.table(kept, "kept")
    # a table of its own: adaptive execution can then split the common keys of the join
    centres = scratch.table(kept.groupBy("key").agg(F.min(F.struct("rare", "doc", "n")).alias("c")).select("key", F.col("c.doc").alias("centre"), F.col("c.n").alias("nc")), "centres")
    family = scratch.table(kept.join(centres, "key").where("doc <> centre").select("centre", "nc", "doc", "n").distinct(), "family")
    star = family.where(fits(F.col("nc"), F.col("n"))).select(F.least("centre", "doc").alias("a"), F.greatest("centre", "doc").alias("b"))
    pairs = scratch.table(pairs.union(star).distinct(), "pairs")

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).union(family.select("doc")).distinct()
    sets = scratch.table(only_ids(spark, docs, ids).dropDuplicates(["doc_id"]).mapInArrow(_sets(n_words), "doc_id long, grams binary"), "sets")
    with_sets = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    links = scratch.table(with_sets.mapInArrow(_verify(percent), "a long, b long"), "links")

    tied = links.select(F.col("a").alias("centre"), F.col("b").alias("doc")).union(links.select(F.col("b").alias("centre"), F.col("a").alias("doc")))
    loose = scratch.table(family.join(tied, ["centre", "doc"], "left_anti"), "loose")
    if not loose.isEmpty():
        blocks = lambda df, name: df.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        shape = scratch.table(blocks(loose, "n_left").join(blocks(family, "n_right"), "centre"), "shape")
        blob = sets.select(F.col("doc_id").alias("doc"), "grams")
        place = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = loose.select("centre", "doc").join(shape, "centre").join(blob, "doc").select("centre", "doc", "grams", place("n_left").alias("l"), every("n_right").alias("r"))
        right = family.select("centre", "doc").join(shape, "centre").join(blob, "doc").select("centre", "doc", "grams", every("n_left").alias("l"), place("n_right").alias("r"))
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, beside those of left
        more = left.groupBy("centre", "l", "r").cogroup(right.groupBy("centre", "l", "r")).applyInArrow(_block(percent), "a long, b long")
        links = links.union(scratch.table(more.distinct(), "more"))
    parts = components(spark, links, scratch)
    whole = meta.join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"], "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    if torn:
        said = whole.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep", "doc_id")).alias("component"))
        whole = rows.join(said, "doc_id", "left").withColumn("rep", F.col("component"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def op1_parity_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
