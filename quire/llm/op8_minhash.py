"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set are its distinct shingles of ``size`` words. Equal sets become one
representative first, the smallest id, so copies are never compared. The rest are posted
under each (coordinate, value) of their signature:

1. Values are counted over all representatives. A pair over the match threshold shares at least
   ``matches`` of COORDINATES values, so one with fewer shared values has no partner, and of
   the others it is enough to post the rarest (shared - matches + 1) values: pairs over the
   threshold meet there (prefix), the longest lists are skipped. Lists with the same members
   are kept once.
2. In each list members are compared with a few pivots (the smallest id and others by hash),
   not with each other: collisions are counted on the signatures, pairs over the threshold are
   confirmed on the full sets, links make components.
3. Lists whose members are still in several components are compared in blocks of BLOCK_ROWS,
   members of one component excepted: collisions are counted and pairs over the threshold
   confirmed inside the task, and only links that join two components leave it. After that no
   pair that met in a list and could join two components is open, so the components are those
   of all links.

At similarity 0.8 fewer than 24 of 48 coordinates agree with probability below 1e-5.

Null and empty texts have an empty set, link with nothing and are kept. A row without id is
its own component: component_id null, kept true. Rows of equal id are one node of the
graph, each row keeps its own n_shingles. Input columns named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, U64, append, column, materialize, mix, rolled, table_column, text_bytes, windows, word_hashes, words

SHINGLE = 4
PERCENT = 80
COORDINATES = 48
MATCHES = 24
PIVOTS = 3
BLOCK_ROWS = 1024
#: Bits of the map of wanted ids: 16 MB.
FILTER_BITS = 1 << 27
_RANDOM = np.random.Generator(np.random.PCG64(97)).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and where each text's begin."""
    starts, ends, first = words(buf, off, SPACES)
    hashes = word_hashes(buf, starts, ends, lower=True)
    at, h = windows(hashes, first, size)
    doc = np.searchsorted(first, at, "right") - 1
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        h = np.concatenate([h, mix(rolled(hashes, first[few], first[few + 1]) + n[few].astype(U64))])
        doc = np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(off)))


def signed(docs: DataFrame, size: int) -> DataFrame:
    """_id, text -> _id, n_shingles, a and b (128 bits that name the set), signature."""

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        h, first = shingle_sets(*text_bytes(column(part, "text")), size)
        n = np.diff(first)
        have = np.flatnonzero(n)
        at = first[:-1][have]
        signature = np.zeros((len(n), COORDINATES), np.uint32)
        a, b = np.zeros(len(n), U64), np.zeros(len(n), U64)
        if len(have):
            for k in range(COORDINATES):
                signature[have, k] = np.minimum.reduceat((h ^ _RANDOM[0, k]) * _RANDOM[1, k], at) >> U64(32)
            a[have] = np.add.reduceat(mix(h), at)
            b[have] = np.bitwise_xor.reduceat(mix(h + U64(12345)), at)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COORDINATES, pa.int32()), pa.array(signature.ravel().view(np.int32)))
        return [pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), values]

    return append(docs, fn, [("n_shingles", "bigint"), ("a", "bigint"), ("b", "bigint"), ("signature", "array<int>")]).drop("text")


def postings(reps: DataFrame, matches: int) -> DataFrame:
    """token, id: each representative under its rarest shared values; lists of two and more,
    equal lists once."""
    spark = reps.sparkSession
    tokens = reps.select("id", F.posexplode("signature").alias("pos", "value"))
    tokens = tokens.select("id", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("value").bitwiseAND(0xFFFFFFFF).cast("long")).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    own = tokens.join(shared, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t")).where(F.size("t") >= matches)  # at most COORDINATES
    rare = own.select("id", F.explode(F.slice("t", 1, F.size("t") - matches + 1)).alias("t")).select(F.col("t.token").alias("token"), "id")
    rare = materialize(spark, rare, "minhash-postings")
    members = [F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    lists = rare.groupBy("token").agg(*members).where("n > 1").groupBy("n", "x", "y").agg(F.min("token").alias("token"))
    return materialize(spark, rare.join(lists.select("token", "n"), "token"), "minhash-lists")


def pivot_pairs(lists: DataFrame) -> DataFrame:
    """a < b: each member of a list with the list's pivots."""
    pivots = [F.min("id")] + [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"] for k in range(1, PIVOTS)]
    chosen = lists.groupBy("token").agg(F.array_distinct(F.array(*pivots)).alias("pivots"))
    pairs = lists.join(chosen, "token").select("id", F.explode("pivots").alias("pivot")).where("id <> pivot")
    return pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def over_threshold(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``matches`` coordinates."""
    both = pairs.join(reps.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").join(reps.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
    agree = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)
    return both.where(agree >= matches).select("a", "b")


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose _id may be in ``ids`` (column _id): none that is in it is lost, a
    join decides the rest. Bits are set by hash in a map of FILTER_BITS, broadcast in rows of
    4 KB, so texts of documents without candidates never enter an exchange and the broadcast is
    bounded at any number of ids."""
    place = F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS)) + 1
    bits = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket")
    return near.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union. ``docs``: _id, text."""
    pairs = materialize(pairs.sparkSession, pairs, "minhash-pairs")
    texts = likely(docs, pairs.select(F.explode(F.array("a", "b")).alias("_id")))
    both = pairs.join(texts.select(F.col("_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("_id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[object, np.ndarray] = (None, np.zeros(0, U64))  # pairs of one b follow each other
        for batch in batches:
            raw = {c: text_bytes(column(batch, c)) for c in "xy"}
            names, keep = column(batch, "b").to_pylist(), []
            for i in range(len(batch)):
                x, y = (buf[off[i] : off[i + 1]] for buf, off in raw.values())
                mine = (names[i], y.tobytes())
                if kept[0] != mine:
                    kept = (mine, shingle_sets(y, np.array([0, len(y)]), size)[0])
                s, t = shingle_sets(x, np.array([0, len(x)]), size)[0], kept[1]
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    keep.append(False)
                    continue
                inside = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                keep.append(inside > 0 and 100 * inside >= percent * (len(s) + len(t) - inside))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every node of ``edges`` (a, b), by large-star
    and small-star steps: each hangs the neighbours of a node on the smallest of them."""
    spark = edges.sparkSession

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            arcs = edges.select("a", "b").union(edges.select("b", "a"))
        else:
            arcs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = arcs.join(least, "a")
        if large:
            hung = hung.where("b > a").select("b", "m").union(least.select("a", "m"))
        else:
            hung = hung.select("b", "m").union(least.select("a", "m"))
        return hung.toDF("a", "b").where("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(spark, edges.select("a", "b").where("a <> b"), "links")
    before = None
    while (now := mark(edges)) != before:
        before = now
        edges = materialize(spark, star(star(edges, True), False), "links")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")


def block_links(ids: np.ndarray, component: np.ndarray, signature: np.ndarray, h: np.ndarray, first: np.ndarray, matches: int, percent: int) -> list[tuple[int, int]]:
    """Links of a block that join components: signatures over the threshold are confirmed on
    the full sets h[first[k]:first[k+1]], one member against all later ones at once."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    size = np.diff(first)
    values, place = np.unique(h, return_inverse=True)
    mark = np.zeros(len(values), np.int64)
    label = component.copy()
    for r in range(len(ids) - 1):
        agree = (signature[r + 1 :] == signature[r]).sum(axis=1)
        hit = np.flatnonzero((agree >= matches) & (label[r + 1 :] != label[r])) + r + 1
        hit = hit[100 * np.minimum(size[hit], size[r]) >= percent * np.maximum(size[hit], size[r])]
        if not len(hit):
            continue
        mark[place[first[r] : first[r + 1]]] = 1
        n = size[hit]
        at = np.arange(n.sum()) + np.repeat(first[hit] - (np.cumsum(n) - n), n)
        inside = np.add.reduceat(mark[place[at]], np.cumsum(n) - n)
        mark[place[first[r] : first[r + 1]]] = 0
        for k in hit[100 * inside >= percent * (n + size[r] - inside)].tolist():
            a, b = find(int(component[r])), find(int(component[k]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(min(ids[r], ids[k])), int(max(ids[r], ids[k]))))
                label[(label == a) | (label == b)] = min(a, b)
    return out


def open_links(lists: DataFrame, reps: DataFrame, found: DataFrame, docs: DataFrame, size: int, matches: int, percent: int) -> DataFrame:
    """a, b: confirmed links between components that still meet in a list; at most one link
    for each member of a block leaves a task. ``docs``: _id, text."""
    named = lists.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = named.groupBy("token").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("token")
    rows = named.join(several, "token").join(reps.select("id", "signature"), "id")
    rows = materialize(lists.sparkSession, rows.select("token", "n", "id", "component", "signature"), "minhash-open")
    texts = likely(docs, rows.select(F.col("id").alias("_id")))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("long")
    rows = rows.join(texts, F.col("id") == F.col("_id")).withColumn("i", F.pmod(F.xxhash64("id"), blocks)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("token", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "id", "component", "signature", "text")
    rows = rows.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "id")

    def links(table: pa.Table) -> list[tuple[int, int]]:
        h, first = shingle_sets(*text_bytes(table_column(table, "text")), size)
        signature = table_column(table, "signature").flatten().to_numpy().reshape(-1, COORDINATES)
        return block_links(table.column("id").to_numpy(), table.column("component").to_numpy(), signature, h, first, matches, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            keys = [table.column(c).to_numpy() for c in ("token", "p", "q")]
            edge = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2]) != 0)) + 1
            cut = [0, *edge.tolist()]
            out = [x for s, e in zip(cut[:-1], cut[1:]) if e - s > 1 for x in links(table.slice(s, e - s))]
            rest = table.slice(cut[-1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b"])
        if rest is not None and (out := links(rest)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, matches: int = MATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest id reachable by links), kept (whether the row's
    id is that one)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text"))
    rows = materialize(spark, signed(texts, size), "minhash-signatures")
    named = rows.where("n_shingles > 0 and _id is not null")
    reps = materialize(spark, named.groupBy("a", "b", "n_shingles").agg(F.min("_id").alias("id"), F.min("signature").alias("signature")), "minhash-sets")
    lists = postings(reps, matches)
    nodes = texts.where("_id is not null")
    links = materialize(spark, confirm(over_threshold(pivot_pairs(lists), reps, matches), nodes, size, percent), "minhash-links")
    found = components(links)
    more = materialize(spark, open_links(lists, reps, found, nodes, size, matches, percent), "minhash-links")
    if not more.isEmpty():
        found = components(links.union(more))
    ties = reps.select("id", "a", "b", "n_shingles")
    sets = named.select("_id", "a", "b", "n_shingles").join(ties, ["a", "b", "n_shingles"])
    whole = sets.join(found, "id", "left").select("_id", F.coalesce("component", "id").alias("component")).groupBy("_id").agg(F.min("component").alias("component_id"))
    out = rows.select("_id", "n_shingles").join(whole, "_id", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
