"""Near duplicates by min-max hashing.

A document's set holds the distinct shingles of `width` words.  Under each random
permutation of the shingles both the smallest and the largest value are kept: each
agrees between two sets with probability equal to their similarity, so one hash
evaluation gives two signature values, and as the two ends repel each other their
mean has a lower variance than that of two permutations.  The values are cut into
bands; documents that agree in a whole band are candidates, and the band shape is
chosen so that a pair at the threshold is missed with probability 1e-6 at most.

Documents with one set are one class before anything else, by a 128-bit digest.  In
each bucket every class is compared with the smallest, on the full sets, so a large
group of near copies costs one comparison per member and bucket, not one per pair.
Buckets that this leaves with several groups are the rest: their classes are paired by
the exact prefix filter for set similarity, across groups only, and confirmed alike,
so no candidate pair between different groups is left out.  Where shingles have
many holders, each holder first meets a few of them, drawn anew and four times as many in
each round, and what that links becomes one group.  So of many near copies a bounded number
of pairs each is looked at, and all pairs only of those that no round could bring together.

Words are runs of anything but ASCII white space, with ASCII letters lowered.  A text
of fewer words than the width has its whole sequence as its one shingle.

Rows are known by a row number, given when their texts are stored, so rows without
id are linked like all others.

Defined results: null texts and texts without words have an empty set, are linked
with nothing and kept; repeated rows are copies of each other; rows that share an id
are compared each on its own; the head of a group is its smallest id, in a group
without ids its first row, which has no component id and is kept; other rows without
id are not; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fallow.llm.components import components
from fallow.session import in_few_tasks, settle, ship_package

WIDTH, PERCENT = 3, 85
MISS = 1e-6
VALUES = 128  # signature values at most
CHUNK = 1 << 16  # shingles permuted at a time
BATCH = 256  # rows with whole texts that a Python worker holds at a time
TEXTS, PAIRS = 8192, 4096  # texts and pairs of texts that one task may write or compare
DRAWS = 8  # rows of a shingle that its other rows meet in the first round
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        rolled = rolled * _FACTOR + hashes[i : i + len(rolled)]
    return np.unique(mix(rolled))


def band_shape(similarity: float) -> tuple[int, int]:
    """(rows, bands): the longest rows whose bands miss a pair at `similarity` with probability MISS at most."""
    best = (1, math.ceil(math.log(MISS) / math.log(1 - similarity)))
    for rows in range(2, 16):
        bands = math.ceil(math.log(MISS) / math.log(1 - similarity**rows))
        if rows * bands <= VALUES:
            best = (rows, bands)
    return best


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return random[0] * np.uint64(2) + np.uint64(1), random[1]


def signatures(sets: list[np.ndarray], perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signature values by document: the minimum and the maximum under each permutation, side by side.  No set may be empty."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * len(perms[0])), np.uint64)
    for i, (a, b) in enumerate(zip(*perms, strict=True)):
        moved = values * a + b
        out[:, 2 * i] = np.minimum.reduceat(moved, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(moved, starts)
    return out


def band_hashes(values: np.ndarray, rows: int, bands: int) -> np.ndarray:
    out = np.empty((len(values), bands), np.uint64)
    for band in range(bands):
        out[:, band] = band + 1
        for r in range(rows):
            out[:, band] = mix(out[:, band] * _FACTOR + values[:, band * rows + r])
    return out.view(np.int64)


def _signer(width: int, rows: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        perms = permutations(-(-rows * bands // 2), seed)
        for batch in batches:
            sizes, keys, found, held = [], [], [], []

            def sign(held=held, found=found):
                if held:
                    found.append(band_hashes(signatures(held, perms), rows, bands))
                    held.clear()

            for text in batch["text"].to_pylist():
                own = shingle_set(text, width)
                sizes.append(len(own))
                keys.append(xxh3_128_digest(own.tobytes()) if len(own) else None)
                if len(own):
                    held.append(own)
                    if sum(map(len, held)) > CHUNK:
                        sign()
            sign()
            flat = np.concatenate(found).reshape(-1) if found else np.zeros(0, np.int64)
            has = np.array([n > 0 for n in sizes], bool)
            offsets = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
            yield pa.record_batch(
                [batch["row"], batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["row", "doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """While a stage with whole texts runs, hand Python fewer rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _confirmer(width: int, percent: int):
    """Keep pairs whose full sets meet the threshold, with all columns but the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, np.ndarray] = {}  # a text often recurs within a batch

            def of(text: str, sets=sets) -> np.ndarray:
                if text not in sets:
                    if len(sets) > BATCH:
                        sets.clear()
                    sets[text] = shingle_set(text, width)
                return sets[text]

            keep = []
            for x, y in zip(batch["a_text"].to_pylist(), batch["b_text"].to_pylist(), strict=True):
                x, y = of(x), of(y)
                shared = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.drop_columns(["a_text", "b_text"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, seed: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id of its group) and kept (it is that one)."""
    own = settle(_numbered(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))), "zstd")
    judged = _judged(own, width, percent, seed)
    named = F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("head.doc_id"))
    return judged.select(
        "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), (named | (F.col("row") == F.col("head.row"))).alias("kept")
    )


def without_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, seed: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`, with all their columns, with one row of each group: that of the smallest id, or the first."""
    stored = settle(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "zstd")
    own = stored.select("row", F.col(f"doc.`{key}`").cast("long").alias("doc_id"), F.col(f"doc.`{text}`").alias("text"))
    stay = _judged(own, width, percent, seed).where(F.col("row") == F.col("head.row")).select("row")
    left = in_few_tasks(stored.join(stay, "row", "left_semi"), stored.count(), TEXTS)
    return left.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number of their own, to be stored at once."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def _judged(own: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """(row, doc_id, n_shingles, head) of every row of the stored table `own` (row, doc_id, text).

    `head` (is without id, doc_id, row) is the first row of the group, those with the smallest id first.
    """
    ship_package(own.sparkSession)
    rows, bands = band_shape(percent / 100)
    with small_batches(own.sparkSession):
        signed = own.select("row", "doc_id", "text").mapInArrow(_signer(width, rows, bands, seed), "row long, doc_id long, n_shingles long, set_key binary, bands array<long>")
        signed = settle(signed)

    n_rows = signed.count()
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row"))
    full = signed.where(F.col("set_key").isNotNull())
    classes = full.groupBy("set_key").agg(F.min("row").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.min(place).alias("head"))
    classes = settle(in_few_tasks(classes, n_rows))
    links = _links(own, classes, width, percent)

    labelled = classes.select("set_key", "id", "head").join(components(links), "id", "left").select("set_key", "head", F.coalesce("root", "id").alias("root"))
    heads = in_few_tasks(labelled.groupBy("root").agg(F.min("head").alias("first")), n_rows)
    labelled = settle(in_few_tasks(labelled.join(heads, "root").select("set_key", F.col("first").alias("head")), n_rows))
    out = in_few_tasks(full.select("row", "doc_id", "n_shingles", "set_key").join(labelled, "set_key").drop("set_key"), n_rows)
    empty = signed.where(F.col("set_key").isNull()).select("row", "doc_id", "n_shingles", place.alias("head"))
    return out.unionByName(empty)


def _links(own: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes that make up all components."""
    n_classes = classes.count()
    filed = classes.select("id", "n", F.explode("bands").alias("bucket"))
    leads = filed.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("members")).where("members > 1")
    members = settle(in_few_tasks(filed.join(leads.drop("members"), "bucket"), n_classes * band_shape(percent / 100)[1]))
    wanted = members.select("id").distinct()
    texts = settle(in_few_tasks(own.select(F.col("row").alias("id"), "text").join(wanted, "id"), n_classes, TEXTS), "zstd")

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b and any other columns) of a stored table that are linked."""
        a = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
        b = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
        both = in_few_tasks(pairs.join(a, "a").join(b, "b"), pairs.count(), PAIRS).select(*pairs.columns, "a_text", "b_text")
        with small_batches(own.sparkSession):
            return settle(both.mapInArrow(_confirmer(width, percent), pairs.schema))

    first = members.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    first = settle(in_few_tasks(first, members.count()))
    near = confirm(first)

    roots = components(near).withColumnRenamed("id", "member")
    placed = members.join(roots, F.col("id") == F.col("member"), "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    placed = settle(in_few_tasks(placed, members.count()))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rest = placed.join(mixed.drop("low", "high"), "bucket", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    prefix = _prefixes(in_few_tasks(texts.join(rest, "id"), texts.count(), TEXTS), width, percent)
    tried, draws = first, DRAWS
    while _others(prefix) > draws:
        drawn = _drawn_pairs(prefix, percent, draws).join(tried, ["a", "b"], "left_anti")
        drawn = settle(in_few_tasks(drawn, draws * prefix.count()))
        found = confirm(drawn)
        tried, near = tried.unionByName(drawn.select("a", "b")), near.unionByName(found.select("a", "b"))
        prefix, draws = _regrouped(prefix, found), 4 * draws
    pairs = settle(_prefix_pairs(prefix, percent).join(tried, ["a", "b"], "left_anti"))
    return near.unionByName(confirm(pairs))


def _exploder(width: int):
    """One row per shingle."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t, width).view(np.int64) for t in part["text"].to_pylist()]
                each = [np.repeat(part[c].to_numpy(), [len(x) for x in sets]) for c in ("id", "n", "root")]
                yield pa.record_batch([pa.array(c) for c in (*each, np.concatenate(sets))], schema=schema)

    return run


def _prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, id, n, root, place) of the shingles of `docs` (id, n, root, text) that can make pairs of different roots.

    The exact prefix filter for set similarity: shingles are ordered by how many documents hold them, rarest
    first.  Two sets that meet the threshold share one of the first n - (least overlap) + 1 of each, and
    after the first that they share enough must be left in both.  Documents that have a long passage in
    common, but differ otherwise, share none of their rare shingles and never become a pair.
    """
    with small_batches(docs.sparkSession):
        tokens = settle(docs.select("id", "n", "root", "text").mapInArrow(_exploder(width), "id long, n long, root long, token long"))
    held = tokens.groupBy("token").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")).where("held > 1")
    of_doc = Window.partitionBy("id")  # at most one document's shingles
    place = F.col("n") - F.count("*").over(of_doc) + F.row_number().over(of_doc.orderBy("held", "token"))
    prefix = tokens.join(held, "token").withColumn("place", place)
    prefix = prefix.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("low") < F.col("high")))
    return settle(in_few_tasks(prefix.select("token", "id", "n", "root", "place"), tokens.count()))


def _may_meet(percent: int) -> Column:
    """Whether a row and the row of its shingle with the columns x_... are of different roots and may meet the threshold."""
    left = F.least(F.col("n") - F.col("place"), F.col("x_n") - F.col("x_place")) + 1
    return (
        (F.col("x_root") != F.col("root"))
        & (100 * F.least("n", "x_n") >= percent * F.greatest("n", "x_n"))
        & (left * (100 + percent) >= percent * (F.col("n") + F.col("x_n")))
    )


def _prefix_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of a prefix table that are of different roots and may meet the threshold."""
    x = prefix.select("token", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "root", "place")])
    pairs = x.join(prefix, "token").where((F.col("x_id") < F.col("id")) & _may_meet(percent))
    return pairs.select(F.col("x_id").alias("a"), F.col("id").alias("b")).distinct()


def _others(prefix: DataFrame) -> float:
    """How many rows of its shingle, of other roots, a row has on average."""
    n_rows = prefix.count()
    groups = in_few_tasks(prefix.groupBy("token", "root").agg(F.count("*").alias("k")), n_rows)
    shared = groups.groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
    return in_few_tasks(shared, n_rows).agg(F.sum(F.col("k") * F.col("k") - F.col("own")) / F.sum("k")).first()[0] or 0.0


def _drawn_pairs(prefix: DataFrame, percent: int, draws: int) -> DataFrame:
    """Pairs (a, b), with their roots a_root and b_root, of each row with at most `draws` rows of its shingle.

    Rows of a shingle are dealt over so many slots and one is drawn from each.
    """
    order = F.xxhash64("id", "token", F.lit(draws))
    row = F.struct(order.alias("h"), *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "root", "place")])
    x = prefix.groupBy("token", F.pmod(order, F.lit(draws)).alias("slot")).agg(F.min(row).alias("x")).select("token", "x.*")
    pairs = in_few_tasks(x, prefix.count()).join(prefix, "token").where(_may_meet(percent))
    x, own = F.struct(F.col("x_id").alias("id"), F.col("x_root").alias("root")), F.struct("id", "root")
    pairs = pairs.select(F.least(x, own).alias("a"), F.greatest(x, own).alias("b"))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.root").alias("a_root"), F.col("b.root").alias("b_root")).distinct()


def _regrouped(prefix: DataFrame, links: DataFrame) -> DataFrame:
    """`prefix` with the roots that follow from more links (a_root, b_root); rows whose shingle has one root left go."""
    n_rows = prefix.count()
    joined = components(links, "a_root", "b_root").select(F.col("id").alias("root"), F.col("root").alias("onto"))
    moved = prefix.join(joined, "root", "left").select("token", "id", "n", F.coalesce("onto", "root").alias("root"), "place")
    moved = settle(in_few_tasks(moved, n_rows))
    mixed = in_few_tasks(moved.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")), n_rows).where("low < high")
    return settle(in_few_tasks(moved.join(mixed.select("token"), "token", "left_semi"), n_rows))
