"""SimHash fingerprints and their near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is 1 where more than half of the shingles' hashes have it. Each bit
position is given one of the non-zero vectors of ``radius + 1`` bits, and for each non-zero vector v a
table keys the fingerprints by the positions whose vector has an odd product with v. At most
``radius`` differing positions span at most ``radius`` dimensions, so some v is orthogonal to them all:
in that table the pair has equal keys. Every pair within the radius therefore meets in one of the
2^(radius+1) - 1 tables; distances are then checked exactly.

Only distinct fingerprints enter the tables. Keys held once are dropped after a count with map-side
sums; what is left is gathered by key where a key has at most ``BUCKET`` fingerprints, and linked by
breadth-first search, which emits a spanning forest and never all pairs. Fingerprints of larger
buckets take another exact way: each emits the points within half the radius of it, and those
sharing a point are linked to the least of them (two fingerprints within an even radius share one).

Nulls count as the empty text (fingerprint zero, linked like any other); ids may be null or repeated
(each row is returned); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, cut, fresh, prepared, sent_if_few, shuffled, text_or_empty, texts, tidied, written
from quillgrid.llm.components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
BUCKET = 1024

_BITS = 64


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles, repeats included, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, seed) for p in parts), np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bit i is set if it is set in more than half of the hashes."""
    ones = np.zeros(_BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def covering_masks(radius: int) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits; position i has vector 1 + i mod (2^(radius+1) - 1)."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(_BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size + 1)]


def _fingerprints(shingle: int, seed: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [signed(fingerprint(t, shingle, seed)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed 64-bit integer."""
    prepared(df.sparkSession)
    rows = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidied(_fingerprints(shingle, seed)), f"id {df.schema[id_col].dataType.simpleString()}, fp bigint")


def _lists(column: pa.Array):
    """For each list of structs of a column, a function from a field to that list's part of it; nothing is copied."""
    edges, flat = column.offsets.to_numpy(), column.values
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield lambda name, i=start, n=stop - start: flat.field(name).slice(i, n)


def _forest(radius: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for group in _lists(batch.column(0)):
                # Bit counts of signed numbers are of their size, so the fingerprints are taken as unsigned ones.
                fps, nodes = group("fp").to_numpy().view(np.uint64), group("node").to_numpy()
                left = np.argsort(fps, kind="stable")
                while len(left) > 1:
                    front, left = [left[0]], left[1:]
                    while front and len(left):
                        x = front.pop()
                        near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
                        if near.any():
                            found = left[near]
                            a.append(np.full(len(found), nodes[x]))
                            b.append(nodes[found])
                            front += list(found)
                            left = left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _points(radius: int):
    steps = [0] + [sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(_BITS), k)]
    flips = np.asarray([signed(x) for x in steps], np.int64)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for node, seed, fp in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n = len(flips)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, node)), pa.array(np.full(n, seed, np.int32)), pa.array(flips ^ fp)], names=["node", "seed", "point"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between nodes that connect all pairs with fingerprints of one seed within the radius.

    ``nodes`` has columns node, seed and fp, each combination once.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = covering_masks(radius)
    keys = F.array(*[F.xxhash64(F.col("seed"), F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)])
    tables = nodes.select("node", "seed", "fp", F.explode(keys).alias("key"))
    counts = tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(shuffled(tables).join(counts, "key"))
    groups = met.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list(F.struct("fp", "node")).alias("group")).select("group")
    # Edges, fewer than the rows above, are kept: a next Python stage in the same tasks would double the workers of an executor.
    near = cut(groups.mapInArrow(tidied(_forest(radius)), "a bigint, b bigint"))
    crowded = met.where(F.col("n") > bucket).select("node", "seed", "fp")
    if crowded.isEmpty():
        return near
    # Few rows that become thousands each: dealt out, as Spark would leave them to one task.
    crowded = crowded.distinct().repartition(4 * nodes.sparkSession.sparkContext.defaultParallelism, "node")
    points = crowded.mapInArrow(tidied(_points(radius)), "node bigint, seed int, point bigint")
    least = points.groupBy("seed", "point").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").drop("z")
    far = shuffled(points).join(least, ["seed", "point"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    return near.unionByName(far)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """(id, fp, component_id) of every row; component_id: the least id reachable over links between fingerprints."""
    rows = cut(fingerprints(df, id_col, text_col, shingle, seed))
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(links(firsts.select(F.col("fp").alias("node"), F.lit(0).alias("seed"), "fp"), radius, bucket))
    grouped = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select(F.col("fp").alias("own_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("own_fp")).select(F.col("id").alias(id_col), "fp", "component_id")


# Documents of which one of each group stays.

SIMILARITY = 0.8
WORDS = 5
SEEDS = (1,)
#: Min-hashes of the shingles: ``BANDS`` keys of ``BAND`` minima each. A pair of similarity s has no key in common with
#: probability (1 - s ** BAND) ** BANDS, whatever the edit: 3e-6 at 0.8.
BANDS = 32
BAND = 5
#: Documents of a family, and shingles of all of them, that one task compares; larger families first go
#: through rounds of ``LEADERS`` documents (fewer where their shingles are many).
FAMILY = 5_000
FAMILY_SHINGLES = 2_000_000
LEADERS = 256
#: Texts of a family that a task compares with its first texts in a round, about.
SHARE = 2 * LEADERS


def word_fingerprint(text: str, seed: int) -> int:
    """SimHash of the distinct words: of texts that share most five-word shingles it differs in few bits."""
    words = set(text.encode("utf-8", "surrogatepass").lower().split())
    return majority(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64)) if words else 0


def shingle_hashes(text: str, size: int = WORDS) -> np.ndarray:
    """Distinct hashes of the word shingles (of the whole sequence where there are fewer words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    parts = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p) for p in parts), np.uint64).view(np.int64))


_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, (BANDS * BAND, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band: the hash of the band's minima over the shingles' hashes, as a signed number."""
    own = shingles.view(np.uint64)
    least = np.min([(own[k : k + 2048] * _FACTORS).min(1) for k in range(0, len(own), 2048)], axis=0)
    return [signed(xxhash.xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least.reshape(BANDS, BAND))]


def _word_fingerprints(batches: Batches) -> Batches:
    for batch in batches:
        values = texts(batch, "text")
        found = [[signed(word_fingerprint(t, s)) for s in SEEDS] for t in values]
        bands = [band_keys(shingle_hashes(t)) for t in values]
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, lists), pa.array(bands, lists)], names=["id", "mark", "fps", "bands"])


def _shingled(batches: Batches) -> Batches:
    for batch in batches:
        found = [shingle_hashes(t).tolist() for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["root", "node", "shingles"])


def leaders_of(nodes: list[int], shingles: list[np.ndarray], similarity: float = SIMILARITY) -> set[int]:
    """The nodes that stay: by rising node, each that is not similar to one that stays (a repeated node counts once)."""
    holders: dict[int, list[int]] = {}
    sizes: list[int] = []
    stay: list[int] = []
    for k in sorted(range(len(nodes)), key=nodes.__getitem__):
        if stay and nodes[k] == stay[-1]:
            continue
        own = shingles[k].tolist()
        shared: dict[int, int] = {}
        for x in own:
            for j in holders.get(x, ()):
                shared[j] = shared.get(j, 0) + 1
        if any(n >= similarity * (len(own) + sizes[j] - n) for j, n in shared.items()):
            continue
        for x in own:
            holders.setdefault(x, []).append(len(stay))
        sizes.append(len(own))
        stay.append(nodes[k])
    return set(stay)


def _family_losers(similarity: float):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            lost: list[int] = []
            for members in _lists(batch.column(0)):
                nodes, lists = members("node").to_pylist(), members("shingles")
                edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                stay = leaders_of(nodes, [values[i:j] for i, j in zip(edges[:-1], edges[1:])], similarity)
                lost += [n for n in nodes if n not in stay]
            yield pa.RecordBatch.from_arrays([pa.array(lost, pa.int64())], names=["node"])

    return run


def band_links(firsts: DataFrame) -> DataFrame:
    """Edges (a, b) from the least node of each band key to the others that have the key; ``firsts`` has columns node and bands."""
    keys = firsts.select("node", F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select(F.col("key").alias("k"), "a")
    return shuffled(keys).join(least, F.col("key") == F.col("k")).where("node <> a").select("a", F.col("node").alias("b"))


def _mark(text_col: str):
    """What tells texts apart: 128 bits of a text, the empty text's for a null."""
    return F.unhex(F.md5(text_or_empty(text_col)))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, mark, id, times, rows, fps, bands) of each different text, nodes rising with the least id that has it.

    ``id`` is that least id (null if the text has no other, which comes last), ``times`` the rows that
    have both, ``rows`` those that have the text. Texts with one least id are in the order of their marks.
    """
    keyed = docs.select(docs[id_col].alias("id"), _mark(text_col).alias("mark"), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(keyed.mapInArrow(tidied(_word_fingerprints), f"id {kind}, mark binary, fps array<bigint>, bands array<bigint>"))
    same = (F.min("fps").alias("fps"), F.min("bands").alias("bands"))
    by_id = rows.groupBy("mark", "id").agg(F.count("*").alias("n"), *same)
    by_text = by_id.groupBy("mark").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("x"), F.sum("n").alias("rows"), *same)
    order = ["none", "id", "mark"]
    flat = by_text.select("mark", "x.none", "x.id", F.col("x.n").alias("times"), "rows", "fps", "bands")
    return cut(flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()).drop("none"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(mark, id, times, lost) of the texts that go because a similar one stays, and of those that several rows have.

    Similar: five-word shingles of a Jaccard similarity of ``similarity`` or more. Candidates are
    families of texts connected by SimHash links (fingerprints of the distinct words, covering hashing
    at the radius) or by a band of min-hashes of the shingles in common; in a family, by rising id, a text
    stays unless it is similar to one that stays. Families above ``FAMILY`` texts or ``FAMILY_SHINGLES``
    shingles pass through rounds that compare all of them with their first texts, in Spark, until they
    are smaller; other families wait outside the rounds.
    """
    spark = docs.sparkSession
    prepared(spark)
    told = distinct_texts(docs, id_col, text_col)
    nodes = told.select("node", F.posexplode("fps").alias("seed", "fp"))
    families = written(connected_components(links(nodes).unionByName(band_links(told))), "families")
    wanted = sent_if_few(cut(shuffled(told).join(families, "node").select(F.col("mark").alias("m"), F.col("id").alias("i"), "root", "node")))
    rows = docs.select(docs[id_col].alias("id"), _mark(text_col).alias("mark"), text_or_empty(text_col).alias("text"))
    named = rows.join(wanted, (F.col("mark") == F.col("m")) & F.col("id").eqNullSafe(F.col("i"))).select("root", "node", "text")
    members = written(named.mapInArrow(tidied(_shingled), "root bigint, node bigint, shingles array<bigint>"), "members")
    lost, settled = spark.createDataFrame([], "node bigint"), []
    while True:
        sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("all"))
        large = sizes.where((F.col("n") > 1) & ((F.col("n") > FAMILY) | (F.col("all") > FAMILY_SHINGLES))).select("root", F.ceil(F.col("n") / SHARE).alias("shares"))
        if large.isEmpty():
            break
        large = F.broadcast(cut(large))  # a few rows: each stands for thousands of texts or millions of shingles
        settled.append(members.join(large, "root", "left_anti"))
        members = members.join(large, "root", "left_semi")
        order = Window.partitionBy("root").orderBy("node")
        ranked = members.select("root", "node", F.size("shingles").alias("size")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEADERS)
        heads = ranked.withColumn("sum", F.sum("size").over(order)).where((F.col("k") == 1) | (F.col("sum") <= FAMILY_SHINGLES))
        chosen = shuffled(members).join(heads.select("root", "node").distinct(), ["root", "node"])
        picked = cut(chosen.groupBy("root").agg(F.collect_list(F.struct("node", "shingles")).alias("m")).select("root", "m"))
        beaten = cut(picked.select("m").mapInArrow(tidied(_family_losers(similarity)), "node bigint"))
        stay = picked.select("root", F.explode("m").alias("m")).select("root", "m.node", "m.shingles").join(beaten, "node", "left_anti")
        dealt = members.join(large, "root").withColumn("share", F.pmod(F.xxhash64("node"), "shares"))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share")
        leaders = stay.join(large, "root").select("root", every, F.col("node").alias("leader"), F.col("shingles").alias("own"))
        pairs = shuffled(dealt).join(leaders, ["root", "share"]).where("node > leader")
        both = F.size(F.array_intersect("shingles", "own"))
        similar = pairs.where(both >= similarity * (F.size("shingles") + F.size("own") - both)).select("node").distinct()
        gone = cut(beaten.unionByName(similar).distinct())
        lost = lost.unionByName(gone)
        members = written(members.join(gone, "node", "left_anti").join(stay.select("node"), "node", "left_anti"), "members")
    for part in settled:
        members = members.unionByName(part)
    gathered = members.groupBy("root").agg(F.collect_list(F.struct("node", "shingles")).alias("members")).select("members")
    lost = lost.unionByName(gathered.mapInArrow(tidied(_family_losers(similarity)), "node bigint")).distinct().withColumn("lost", F.lit(True))
    judged = shuffled(told.select("node", "mark", "id", "times", "rows")).join(lost, "node", "left").where(F.col("lost") | (F.col("rows") > 1))
    return judged.select("mark", "id", "times", F.coalesce("lost", F.lit(False)).alias("lost"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with their columns, of texts that stay: one row of each text, that with the least id.

    Which texts stay is told by ``similar_texts``. Ids may be of any type that has an order, and may repeat:
    rows are told apart by id and text, so rows of one id with different texts are judged one by one. A
    null id comes after all others. Of rows with the same id and text any one stays. Null and
    empty texts are equal.
    """
    mark, own, first, times, lost = fresh(docs, "_mark", "_own", "_first", "_times", "_lost")
    told = sent_if_few(written(similar_texts(docs, id_col, text_col, similarity), "texts").toDF(mark, first, times, lost))
    met = docs.withColumn(own, _mark(text_col)).join(told, F.col(own) == F.col(mark), "left")
    met = met.where(F.col(mark).isNull() | (~F.col(lost) & docs[id_col].eqNullSafe(F.col(first))))
    if told.where(~F.col(lost) & (F.col(times) > 1)).isEmpty():
        return met.select(*docs.columns)
    once = met.where(F.coalesce(F.col(times), F.lit(1)) == 1)
    return once.unionByName(met.where(F.col(times) > 1).dropDuplicates([mark])).select(*docs.columns)
