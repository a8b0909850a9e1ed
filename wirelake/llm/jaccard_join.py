"""Similarity join on word shingles by grouped prefixes, and its connected components.

Documents with equal shingle sets form one class. Shingles are ordered rarest first by a count sketch of
fixed size (any common order is right; a rare-first one is fast), and a class's prefix is the part of its set
that must meet the prefix of every class it links with. Prefix shingles that only one class has are
dropped; classes with equal size and equal prefix then collapse into one group.

Group pairs come from pivots: each prefix shingle's most central group meets the other groups of its
bucket, so a bucket gives a linear number of pairs. Pairs expand to members; parity signatures, whose difference
bounds the sets' difference from below, drop most pairs, and the sets of the others are intersected. Linked classes are joined into components. What is left are pairs of
different components in one bucket; the triangle inequality over the distances to the bucket's pivot
rules out most, more pivots connect most of the others, and every pair that is left is verified. So no
link between different components is lost, and a bucket of near copies never gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm.common import collect_bitmap, filter_bits, grams, in_bitmap, keep_one, mix, slices, stage, table, text_mark, word_stream
from wirelake.llm.components import components

#: Counters of the sketch and counters in one of its rows.
SKETCH, ROW = 1 << 18, 1 << 12
#: A bucket whose pairs of different components outnumber its rows by this factor is hot: signatures of COARSE 64-bit
#: words are then tested within its join.
PAIRS_PER_ROW, COARSE = 2, 16
#: While the hot buckets' pairs outnumber all index rows by this factor, further pivots connect components first.
PAIRS_FOR_PIVOTS, MOST_ROUNDS = 500, 6


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words are one shingle, no words none."""
    if len(words) == 0:
        return words
    if len(words) < k:
        return mix(grams(words, len(words)) + np.uint64(len(words)))
    return np.unique(grams(words, k))


def class_id(shingles: np.ndarray) -> int:
    """A 64-bit hash of the set, as Spark's long; 0 for the empty set."""
    if len(shingles) == 0:
        return 0
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def parities(shingles: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the set's hashes fall on i. Two bits or more for each shingle, a power of two."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference: equal shingles cancel out. A longer signature folds onto a shorter one."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def coarse(sig: bytes) -> np.ndarray:
    """A signature folded to COARSE words, or padded to them."""
    x = np.frombuffer(sig, np.uint8)
    while len(x) > COARSE * 8:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return np.pad(x, (0, COARSE * 8 - len(x))).view(np.int64)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The shingle set of each text; shingles of all texts are hashed in one go."""
    hashes, starts = word_stream(texts)
    all_grams = grams(hashes, k)
    return [
        np.unique(all_grams[starts[i] : starts[i + 1] - k + 1]) if starts[i + 1] - starts[i] >= k else shingle_set(hashes[starts[i] : starts[i + 1]], k)
        for i in range(len(texts))
    ]


def sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part, texts in slices(batch):
            yield part, shingle_sets(texts, k)


def rarest(shingles: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The first size shingles in the common order: by count, then hash."""
    key = (np.minimum(counts[(shingles & np.uint64(SKETCH - 1)).astype(np.int64)], np.uint64((1 << 24) - 1)) << np.uint64(40)) | (shingles >> np.uint64(24))
    first = np.argpartition(key, size - 1)[:size] if size < len(shingles) else np.arange(len(shingles))
    return shingles[first[np.argsort(key[first])]]


def scan_classes(rows: DataFrame, k: int, kind: str) -> DataFrame:
    """One scan: (id, mark, n, cid) for each row of docs, and each task's sketch as rows (seg, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint32)
        schema = None
        for part, sets in sets_of(batches, k):
            n = len(sets)
            if n:
                sketch += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            out = pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_id(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["id", "mark", "n", "cid", "seg", "counts"],
            )
            schema = out.schema
            yield out
        if schema is not None:
            segs = SKETCH // ROW
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(segs, schema.field("id").type), pa.nulls(segs, pa.int64()), pa.nulls(segs, pa.int64()), pa.nulls(segs, pa.int64()), pa.array(range(segs), pa.int32()), pa.array([sketch[s * ROW : s * ROW + ROW].tobytes() for s in range(segs)], pa.binary())],
                names=["id", "mark", "n", "cid", "seg", "counts"],
            )

    return rows.mapInArrow(run, f"id {kind}, mark long, n long, cid long, seg int, counts binary")


def sum_sketch(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches on the driver: SKETCH numbers."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(ROW, np.uint64)
        for x in group.column("counts"):
            c = x.as_buffer()
            total += np.frombuffer(c, np.uint64 if len(c) == ROW * 8 else np.uint32)
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    salted = parts.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(32)))
    once = salted.groupBy("seg", "salt").applyInArrow(add, "seg int, counts binary")
    out = np.zeros(SKETCH, np.uint64)
    for row in once.groupBy("seg").applyInArrow(add, "seg int, counts binary").collect():
        out[row["seg"] * ROW : row["seg"] * ROW + ROW] = np.frombuffer(row["counts"], np.uint64)
    return out


def prefixes(rows: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(cid, n, prefix, sig): one row for each row with shingles. The rarest shingles first, ties by hash."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for _, sets in sets_of(batches, k):
            cids, sizes, tokens, sigs = [], [], [], []
            for s in sets:
                if len(s):
                    size = len(s) - (-(-percent * len(s) // 100)) + 1
                    cids.append(class_id(s))
                    sizes.append(len(s))
                    tokens.append(rarest(s, counts, size).view(np.int64))
                    sigs.append(parities(s))
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["cid", "n", "prefix", "sig"])

    return rows.mapInArrow(run, "cid long, n long, prefix array<long>, sig binary")


def fetch_sets(rows: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(cid, shingles) of the wanted classes (cid, least): a bitmap of the ids thins the scan before any text is hashed."""
    bitmap = collect_bitmap(wanted, F.xxhash64("least"), filter_bits(wanted.count()))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            hit = in_bitmap(bits, batch.column("h").to_numpy())
            if hit.any():
                yield batch.filter(pa.array(hit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in sets_of(thin(batches), k):
            yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "shingles"])

    found = rows.withColumn("h", F.xxhash64("id")).select("h", "text").mapInArrow(run, "cid long, shingles binary")
    return found.join(wanted.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.first("shingles").alias("shingles"))


def sift(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with the least distance that their signatures allow, and whether they may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, maybe = [], []
            for x, y, n, m in zip(batch.column("x"), batch.column("y"), batch.column("xn").to_pylist(), batch.column("yn").to_pylist(), strict=True):
                h = least_difference(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                h = max(h, abs(n - m))
                common, whole = (n + m - h) / 2, (n + m + h) / 2
                least.append(1 - common / whole)
                maybe.append(100 * (n + m - h) >= percent * (n + m + h))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(least, pa.float64()), pa.array(maybe, pa.bool_())], names=["a", "b", "least", "maybe"])

    left = pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("x"), F.col("n").alias("xn")), "a")
    both = left.join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("y"), F.col("n").alias("yn")), "b")
    return both.select("a", "b", "x", "y", "xn", "yn").mapInArrow(run, "a long, b long, least double, maybe boolean")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the exact sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, union = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                c = len(np.intersect1d(p, q, assume_unique=True))
                common.append(c)
                union.append(len(p) + len(q) - c)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "whole"])

    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, common long, whole long")


def coarse_words(sigs: DataFrame) -> DataFrame:
    """(cid, len, w0, w1, ...): signatures folded to COARSE words or padded to them, and the length that they have then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("sig").to_pylist()
            words = np.array([coarse(s) for s in raw], np.int64).reshape(-1, COARSE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), pa.array([min(len(s), COARSE * 8) for s in raw], pa.int32()), *(pa.array(words[:, j]) for j in range(COARSE))],
                names=["cid", "len", *(f"w{j}" for j in range(COARSE))],
            )

    return sigs.mapInArrow(run, "cid long, len int, " + ", ".join(f"w{j} long" for j in range(COARSE)))


class Verifier:
    """Exact tests of pairs. Sets are fetched by a scan for those pairs that signatures let through, and kept."""

    def __init__(self, rows: DataFrame, k: int, percent: int, sigs: DataFrame, least: DataFrame):
        self.rows, self.k, self.percent, self.sigs, self.least = rows, k, percent, sigs, least
        self.sets: DataFrame | None = None

    def test(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(all pairs with low and high bounds of their distance, the pairs that link)."""
        sifted = stage(sift(pairs, self.sigs, self.percent), "jaccard-sifted")
        maybe = sifted.where("maybe").select("a", "b")
        wanted = maybe.select(F.col("a").alias("cid")).unionByName(maybe.select(F.col("b").alias("cid"))).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cid"), "cid", "left_anti")
        wanted = stage(wanted.join(self.least, "cid"), "jaccard-wanted")
        if not wanted.isEmpty():
            more = stage(fetch_sets(self.rows, self.k, wanted), "jaccard-sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        if self.sets is None:
            exact = sifted.limit(0).select("a", "b", F.lit(0).cast("long").alias("common"), F.lit(1).cast("long").alias("whole"))
        else:
            exact = stage(overlaps(maybe, self.sets), "jaccard-exact")
        distance = exact.select("a", "b", (1 - F.col("common") / F.col("whole")).alias("d"))
        bounds = sifted.join(distance, ["a", "b"], "left").select("a", "b", F.coalesce("d", "least").alias("low"), F.coalesce("d", F.lit(1.0)).alias("high"))
        return bounds, exact.where(F.col("common") * 100 >= F.col("whole") * self.percent).select("a", "b")


def reachable(n: str, m: str, pos: str, other: str, percent: int) -> F.Column:
    """Whether two sets of sizes n and m whose first common shingle stands at these places of the order may link."""
    rest = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(other))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= (F.col(n) + F.col(m)) * percent)


def link_classes(rows: DataFrame, k: int, percent: int, sketch: np.ndarray, least: DataFrame) -> DataFrame:
    """(cid, root) of the classes that link with another: root is the smallest class of the component.

    rows has id and text; least has the smallest id of each class, (cid, least).
    """
    far = 1 - percent / 100 + 1e-9
    classes = prefixes(rows.select("text"), k, percent, sketch).groupBy("cid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sig").alias("sig"))
    classes = stage(classes, "jaccard-classes")
    # sizes of linking classes differ by one band at most, so each shingle is indexed under its band and the next
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100))).cast("int") if percent < 100 else F.col("n").cast("int")
    entries = classes.select("cid", "n", F.size("prefix").alias("length"), band.alias("band"), F.posexplode("prefix").alias("pos", "shingle"))
    # under the next band a set only meets larger ones, and as the smaller of two a shorter prefix does
    shorter = F.col("pos") * (100 + percent) <= F.col("n") * (100 - percent)
    under = F.when(shorter, F.array(F.xxhash64("shingle", "band"), F.xxhash64("shingle", F.col("band") + 1))).otherwise(F.array(F.xxhash64("shingle", "band")))
    index = entries.select("cid", "n", "length", "pos", F.posexplode(under).alias("next", "token"))
    shared = index.groupBy("token").agg(F.count(F.lit(1)).alias("bucket")).where("bucket > 1").select("token")
    live = stage(index.join(shared, "token"), "jaccard-live")
    # classes of equal size and equal shared prefix are one group, named after its smallest class
    keyed = live.groupBy("cid").agg(F.first("n").alias("n"), F.first("length").alias("length"), F.xxhash64(F.array_sort(F.collect_list("token"))).alias("key"), F.count(F.lit(1)).alias("shared"))
    groups = keyed.groupBy("n", "key").agg(F.min("cid").alias("gid"))
    # prefix shingles of its own set a class apart: the fewer, the more central
    members = stage(keyed.join(groups, ["n", "key"]).select("cid", "gid", "n", (2 * F.col("length") - F.col("shared")).alias("own")), "jaccard-members")
    verifier = Verifier(rows, k, percent, classes.select("cid", "n", "sig"), least)
    placed = live.select("token", "cid", "pos", "next").join(members, "cid")
    heads = placed.where("cid = gid").select("token", "gid", "n", "own", "pos")
    pivots = heads.groupBy("token").agg(F.min(F.struct("own", F.xxhash64("gid").alias("h"), "gid", "n", "pos")).alias("p"))
    pivots = stage(pivots.select("token", F.col("p.gid").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos")), "jaccard-pivots")
    # group pairs (group, pivot), expanded to (member, pivot); a group's members also meet its own head
    group_pairs = heads.join(pivots, "token").where((F.col("gid") != F.col("pivot")) & reachable("n", "pn", "pos", "ppos", percent)).select("gid", "pivot").distinct()
    first = members.select("cid", "gid").join(group_pairs, "gid").select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
    own = members.where("cid <> gid").select(F.col("cid").alias("a"), F.col("gid").alias("b"))
    bounds, edges = verifier.test(first.unionByName(own).distinct())
    labels = stage(components(edges), "jaccard-labels")
    # distance of each row to its bucket's pivot; a member of the pivot's own group was checked against its head
    at = bounds.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), "low", "high")
    is_pivot = F.col("cid") == F.col("pivot")
    placed = stage(
        placed.join(pivots.select("token", "pivot"), "token")
        .join(at, ["cid", "pivot"], "left")
        .select("token", "cid", "n", "pos", "next", F.when(is_pivot, 0.0).otherwise(F.coalesce("low", F.lit(0.0))).alias("low"), F.when(is_pivot, 0.0).otherwise(F.coalesce("high", F.lit(1.0))).alias("high")),
        "jaccard-placed",
    )
    rounds, linked_now, n_rows = 0, True, placed.count()
    while True:
        now = placed.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        sizes = now.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64(F.col("cid") + rounds).alias("h"), "cid")).alias("some"))
        buckets = stage(  # the open buckets
            sizes.groupBy("token")
            .agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "label", "some")).alias("top"))
            .where("rows * rows > same")
            .select("token", "rows", ((F.col("rows") * F.col("rows") - F.col("same")) / 2).alias("left"), F.col("top.label").alias("top"), F.col("top.some.cid").alias("pivot")),
            "jaccard-open",
        )
        hot = F.col("left") > PAIRS_PER_ROW * F.col("rows")
        n_open, hot_pairs = buckets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(hot, F.col("left"))), F.lit(0))).first()
        if not n_open:
            break
        open_rows = now.join(buckets.select("token", "top", "pivot", hot.alias("hot")), "token")
        if rounds < MOST_ROUNDS and linked_now and hot_pairs > PAIRS_FOR_PIVOTS * n_rows:
            rounds += 1
            pairs = open_rows.where("hot and label <> top").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
            more = verifier.test(pairs)[1]
            linked_now = not more.isEmpty()
            edges = edges.unionByName(more)
            labels = stage(components(edges), "jaccard-labels")
            continue
        sides = [open_rows.select("token", "hot", *(F.col(c).alias(side + c) for c in ("cid", "n", "pos", "next", "low", "high", "label"))) for side in "xy"]
        near = (
            (F.col("xcid") < F.col("ycid"))
            & (F.col("xnext") + F.col("ynext") < 2)  # sets of one band meet under that band
            & (F.col("xlabel") != F.col("ylabel"))
            & reachable("xn", "yn", "xpos", "ypos", percent)
            & (F.col("xlow") - F.col("yhigh") <= far)
            & (F.col("ylow") - F.col("xhigh") <= far)
        )
        cold = sides[0].where("not hot").join(sides[1].where("not hot").drop("hot"), "token").where(near)
        coarse_sigs = coarse_words(classes.select("cid", "sig"))
        names = ["cid", "len", *(f"w{j}" for j in range(COARSE))]
        signed = [df.where("hot").drop("hot").join(coarse_sigs.select(*(F.col(c).alias(side + c) for c in names)), f"{side}cid") for side, df in zip("xy", sides, strict=True)]
        differ = F.lit(0)
        for j in range(COARSE):
            differ = differ + F.bit_count(F.col(f"xw{j}").bitwiseXOR(F.col(f"yw{j}")))
        may_link = (F.col("xn") + F.col("yn") - differ) * 100 >= (F.col("xn") + F.col("yn") + differ) * percent
        # signatures of very different lengths aren't comparable once padded; sizes within the threshold differ by one doubling at most
        alike = F.col("xlen") == F.col("ylen")
        warm = signed[0].join(signed[1], "token").where(near & (~alike | may_link))
        pairs = cold.select("xcid", "ycid").unionByName(warm.select("xcid", "ycid")).distinct().toDF("a", "b")
        pairs = stage(pairs, "jaccard-pairs")
        if not pairs.isEmpty():
            labels = stage(components(edges.unionByName(verifier.test(pairs)[1])), "jaccard-labels")
        break
    return labels.select(F.col("node").alias("cid"), F.col("label").alias("root"))


def component_rows(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, marked: bool = False) -> DataFrame:
    """(id, mark, n, component_id, class_size, grp) for each row of docs; mark is null unless asked for, grp is null for rows without shingles."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    mark = text_mark(F.col("text")) if marked else F.lit(None).cast("long")
    scanned = stage(scan_classes(rows.withColumn("mark", mark), k, kind), "jaccard-scan")
    sketch = sum_sketch(scanned.where("seg is not null").select("seg", "counts"))
    listed = scanned.where("seg is null").select("id", "mark", "n", "cid")
    classes = stage(listed.where("n > 0").groupBy("cid").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("class_size")), "jaccard-sizes")
    roots = link_classes(rows, k, percent, sketch, classes.select("cid", "least"))
    rooted = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(names, "root").select("cid", "component_id", "class_size", F.col("root").alias("grp")), "jaccard-named")
    single = listed.where("n = 0").select("id", "mark", "n", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("long").alias("grp"))
    return listed.where("n > 0").join(named, "cid").select("id", "mark", "n", "component_id", "class_size", "grp").unionByName(single)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, class_size.

    Words are runs without ASCII white space after lower-casing A-Z. Two documents link when
    100 * intersection >= percent * union of their sets of k-word shingles; component_id is the smallest id
    reachable. Null and empty texts have no shingles, link with nothing and are their own component. Rows with a
    null id take part but never name a component; repeated rows and ids each give their row. class_size counts the rows with the same
    set. Texts may have any length. Shingles are compared by 64-bit hashes. Other columns are ignored; an empty table gives an empty result.
    """
    found = component_rows(docs, k, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "class_size")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each component, all columns as they are: the row of the smallest id.

    Rows are told apart by id and text, so repeated and null ids lose no component; rows without shingles all stay.
    """
    found = component_rows(docs, k, percent, id_col, text_col, marked=True)
    return keep_one(docs, found.select("id", "mark", "grp", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), id_col, text_col)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
SQL = {
    "op4_jaccard_join": r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * common >= 90 * (p.n + q.n - common)),
both_ways as (select x, y from links union all select y, x from links),
reach(x, y) as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on r.y = b.x),
classes as (select doc_id, count(*) over (partition by h) as class_size from (select doc_id, list(s order by s) as h from shingles group by doc_id))
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, least(d.doc_id, coalesce(min(y), d.doc_id)) as component_id, coalesce(any_value(class_size), 1) as class_size
from documents d left join sizes using (doc_id) left join reach on reach.x = d.doc_id left join classes using (doc_id)
group by d.doc_id
"""
}
