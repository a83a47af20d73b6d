"""MinHash near-dedup with tensored banding.

A document's set holds its distinct shingles of WORDS words. Documents with the
same set form a class, and only classes are compared. Two small collections of
``r`` half-bands are computed, each half-band of HALF minhashes; a table key is
a pair of one half-band from either collection. That gives r * r tables from
2 * r half-bands. As a key can only meet another if both halves do, the halves
are counted first and pairs are formed from those that two classes share.

``r`` is chosen so that a pair at exactly the wanted similarity is missed with
a chance of at most MISS; more similar pairs are missed far less often.

Candidates in a bucket are verified on the full sets against one pivot of the
bucket, and components are formed from the links. Only buckets that then still hold
several components go on to the next round, with another pivot and the components
so far, and only components are linked there. When a round finds few links for what it tries, the rounds end.
Pairs across the components that are left come from prefix filtering: with the
shingles of every set in one order, rare ones first, two sets that are similar
enough share a shingle among the first few of both, at places that leave room
for the overlap they need. A set brings a parity bitmap of its shingles along: two
bitmaps differ in no more bits than the sets in shingles, so pairs that differ in too
many are left out before they are made. Both filters are exact, so no link that a bucket holds
is lost, and sets that differ in rare shingles never meet.

Texts with fewer words than WORDS have their whole word sequence as one
shingle. Null, empty and blank texts have an empty set and are linked with
nothing. A null doc_id has no part in naming a component. Of repeated rows each
gets the result of its doc_id. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, only, own_cache, settled, slices, utf8, with_row
from plumbline.llm.components import components

WORDS, HALF, MISS = 5, 2, 1e-5
#: Cells of the counts by which shingles are ordered; only the order's quality depends on them.
SKETCH = 1 << 17
#: 64-bit words of a set's parity bitmap; more of them leave out more pairs, whatever their number no link is lost.
PARITY = 8
#: A round that finds one link for more tries than this is the last one.
FEW = 8

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CACHE = 400_000
_hashes: dict[bytes, int] = {}


def half_bands(similarity: float, half: int = HALF, miss: float = MISS) -> int:
    """Half-bands a collection needs: a pair is found if it shares one of each collection."""
    p = similarity**half
    r = 1
    while 1 - (1 - (1 - p) ** r) ** 2 > miss:
        r += 1
    return r


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    known = own_cache(_hashes)
    if len(known) > _CACHE:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([known[w] for w in words], np.uint64)
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(len(words), size), np.uint64)
    for i in range(min(len(words), size)):
        out = _mixed(out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def _seeds(r: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, (2 * r * HALF, 1), dtype=np.uint64) * np.uint64(2)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The half-bands of both collections, first one then the other."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 4096):
        h = shingles[None, lo : lo + 4096] ^ seeds
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        least = np.minimum(least, h.min(axis=1))
    bands = np.zeros(len(seeds) // HALF, np.uint64)
    for part in least.reshape(-1, HALF).T:
        bands = _mixed(bands * np.uint64(0x9E3779B97F4A7C15) ^ part)
    return bands.view(np.int64)


def _signatures(r: int, size: int):
    seeds = _seeds(r)

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, size) for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([signature(s, seeds) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "row", "n_shingles", "set_id", "bands"],
            )

    return run


def _sets(size: int):
    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, size) for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def bucket_members(classes: DataFrame, r: int) -> DataFrame:
    """key, node, n of all table keys that at least two classes (node, n_shingles, bands) share."""
    halves = classes.select("node", F.posexplode("bands").alias("band", "value")).select("node", "band", F.xxhash64("band", "value").alias("half"))
    halves = keep(halves, "halves")
    shared = halves.groupBy("half").count().filter("count > 1").select("half")
    # At most r half-bands of either collection for each node.
    live = halves.join(shared, "half", "left_semi").groupBy("node").agg(
        F.collect_list(F.when(F.col("band") < r, F.col("half"))).alias("first"), F.collect_list(F.when(F.col("band") >= r, F.col("half"))).alias("second")
    )
    tables = live.select("node", F.explode("first").alias("x"), "second").select("node", "x", F.explode("second").alias("y"))
    tables = keep(tables.select(F.xxhash64("x", "y").alias("key"), "node"), "tables")
    full = tables.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    return tables.join(full, "key", "left_semi").join(classes.select("node", F.col("n_shingles").alias("n")), "node")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose sets are similar enough; sizes are compared before any set is fetched."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = both * 100 >= (F.size("sa") + F.size("sb") - both) * percent
    return pairs.join(one, "a").join(two, "b").filter(near).select(pairs.columns)


def _live(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return members.join(mixed, "key", "left_semi")


def _tried(live: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of a row and its bucket's pivot in different components (ca, cb), of sizes that can be similar enough."""
    # Another pivot in each round: the smallest node first, then the smallest by another hash.
    order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    heads = live.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n", "comp")).alias("p"))
    heads = heads.select("key", F.col("p.node").alias("b"), F.col("p.n").alias("nb"), F.col("p.comp").alias("cb"))
    fits = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent
    return live.join(heads, "key").filter("comp <> cb").filter(fits).select(F.col("node").alias("a"), "b", F.col("comp").alias("ca"), "cb").distinct()


def _moved(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """The rows with their component after ``merged`` (node: a component, comp: the one it went to)."""
    into = merged.select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    return rows.join(into, "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into")


def linked_components(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """node, comp of the classes that are linked with others, but for each component's smallest node.

    ``members`` (key, node, n: its shingles) has the classes of each bucket. A round leaves nothing behind but its live rows.
    """
    spark = sets.sparkSession
    comp = spark.createDataFrame([], "node long, comp long")
    live = members.withColumn("comp", F.col("node"))

    def merge(pairs):
        """(pairs tried, links found, components that went into others) of the pairs, which have their components."""
        counts = []

        def run():
            tried = keep(pairs, "pairs")
            links = keep(_links(tried, sets, percent), "links")
            counts.extend((tried.count(), links.count()))
            return components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))

        merged = settled(spark, run, "merged")
        return (*counts, merged)

    turn = 0
    while True:
        tried, found, merged = merge(_tried(live, percent, turn))
        if found:
            comp = settled(spark, lambda comp=comp, merged=merged: _moved(comp, merged).select("node", "comp").union(merged), "comp")
            live = settled(spark, lambda live=live, merged=merged: _live(_moved(live, merged)), "live")
        turn += 1
        # A speed choice: what later pivots would find, the exact filter finds as well.
        if turn > 1 and found * FEW < tried or not tried:
            break
    # What is left: pairs across the components that still share a bucket.
    rest = keep(sets.join(live.select("node", "comp").distinct(), "node"), "rest")
    _, found, merged = merge(prefix_pairs(rest, percent).select("a", "b", "ca", "cb").distinct())
    return _moved(comp, merged).select("node", "comp").union(merged) if found else comp


def _rarity(batches):
    seen = np.zeros(SKETCH, np.int64)
    for batch in batches:
        seen += np.bincount(batch.column("shingles").flatten().to_numpy().view(np.uint64) % np.uint64(SKETCH), minlength=SKETCH)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["cell", "n"])


def _parity(shingles: np.ndarray) -> np.ndarray:
    """The bitmap in which a bit is set if an odd number of the shingles falls on it."""
    cells = (shingles.view(np.uint64) >> np.uint64(32)) % np.uint64(64 * PARITY)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(shared, percent: int):
    def run(batches):
        counts = shared.value
        for batch in batches:
            columns, parities = [[] for _ in range(5)], []
            for node, comp, shingles in zip(*(batch.column(c).to_pylist() for c in ("node", "comp", "shingles")), strict=True):
                own = np.array(shingles, np.int64)
                n, parity = len(own), _parity(own)
                order = np.lexsort((own, counts[own.view(np.uint64) % np.uint64(SKETCH)]))
                # The larger set of a pair shares percent of its own size, the smaller one 2 p / (100 + p) of its own, at least.
                own = own[order[: n + (-percent * n) // 100 + 1]]
                for column, values in zip(columns, (own, [node] * len(own), [comp] * len(own), [n] * len(own), np.arange(len(own))), strict=True):
                    column.extend(values)
                parities.extend([parity] * len(own))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array(parities, pa.list_(pa.int64()))], names=["shingle", "node", "comp", "n", "place", "parity"]
            )

    return run


def prefix_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``rest`` (node, comp, shingles) in different components that can be similar enough, and few others."""
    cells = rest.mapInArrow(_rarity, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SKETCH, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    shared = rest.sparkSession.sparkContext.broadcast(counts)  # SKETCH numbers
    heads = keep(rest.mapInArrow(_prefixes(shared, percent), "shingle long, node long, comp long, n long, place long, parity array<long>"), "prefixes")
    larger = heads.withColumnsRenamed({"node": "a", "comp": "ca", "n": "na", "place": "pa", "parity": "xa"})
    smaller = heads.withColumnsRenamed({"node": "b", "comp": "cb", "n": "nb", "place": "pb", "parity": "xb"})
    smaller = smaller.filter((F.col("nb") - F.col("pb")) * (100 + percent) >= 2 * percent * F.col("nb"))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    fits = (F.col("nb") <= F.col("na")) & (F.col("nb") * 100 >= F.col("na") * percent)
    # Shingles that only one of the two has, at least.
    apart = reduce(add, [F.bit_count(F.col("xa")[i].bitwiseXOR(F.col("xb")[i])) for i in range(PARITY)])
    alike = (F.col("na") + F.col("nb") - apart) * (100 + percent) >= 2 * percent * (F.col("na") + F.col("nb"))
    return larger.join(smaller, "shingle").filter((F.col("ca") != F.col("cb")) & fits & room & alike)


def near_dedup(docs: DataFrame, percent: int = 80, size: int = WORDS, numbered: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Sets with 100 * intersection >= percent * union are linked; component_id is
    the smallest doc_id of a component. ``numbered`` says that ``docs`` is a stored
    table whose doc_id is a number of its own for each row, so it need not be stored again.
    """
    return settled(docs.sparkSession, lambda: _near_dedup(docs, percent, size, numbered), "near")


def _near_dedup(docs: DataFrame, percent: int, size: int, numbered: bool) -> DataFrame:
    spark, r = docs.sparkSession, half_bands(percent / 100)
    # Stored with their rows: a set is fetched by the row that stands for its class, whatever its doc_id.
    texts = docs.select("doc_id", "text", F.col("doc_id").alias("row")) if numbered else keep(with_row(docs.select("doc_id", "text")), "texts")
    rows = keep(texts.mapInArrow(_signatures(r, size), "doc_id long, row long, n_shingles long, set_id binary, bands array<long>"), "signatures")
    classes = keep(
        rows.filter("n_shingles > 0").groupBy("set_id").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")),
        "classes",
    )
    members = settled(spark, lambda: bucket_members(classes, r), "members")
    wanted = members.select(F.col("node").alias("row")).distinct()
    sets = keep(only(texts.select("row", "text"), "row", wanted, "wanted").mapInArrow(_sets(size), "node long, shingles array<long>"), "sets")
    comp = settled(spark, lambda: linked_components(sets, members, percent), "comp")
    placed = classes.select("set_id", "node", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    final = placed.join(named, "comp").select("set_id", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(final, "set_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM t, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * inter >= 85 * (nx.n + ny.n - inter)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM t
    UNION
    SELECT a, y FROM reach JOIN links ON b = x
)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = t.doc_id
"""
