"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile against tile.

Fingerprints lie in tiles by the population counts of their four 16-bit quarters. Two fingerprints differ in at
least as many bits as their counts do, so a pair of tiles whose counts are further apart than the radius holds no
link and is never built. Each remaining pair is one group: numpy exclusive-or and bit counts over blocks of the two
tiles, with the same test block by block. A group returns a spanning forest of its links, not the links, so
thousands of near copies cost as many rows as they have fingerprints. Equal fingerprints meet once, before.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.rows import free_name, spread_lookup, text_function, written

SEED = 42
#: Fingerprints of a tile, at least and at most; between them a 64th of all. A pair of the largest tiles keeps a task busy
#: for about a minute; of more fingerprints there are more pairs.
TILE_ROWS = (1 << 15, 1 << 17)
#: Tasks that the pairs of tiles are dealt to, at most.
PAIR_TASKS = 20_000
#: Fingerprints of a block inside a pair of tiles.
BLOCK = 512
#: Links held back before they are folded into the forest.
HELD = 1 << 20
_QUARTERS = ("q0", "q1", "q2", "q3")


def simhash64(text: bytes | None, shingle: int) -> int:
    """Fingerprint of a text as unsigned 64 bits; 0 where it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(end + 1 for end in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], dtype="<u8")
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def make():
        def run(texts):
            return pa.array(np.array([simhash64(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

        return run

    return text_function(make, "long")


def popcounts(prints: np.ndarray) -> np.ndarray:
    """Bits set in each 16-bit quarter, highest quarter first."""
    quarters = prints.astype(np.uint64).view("<u2").reshape(-1, 4)[:, ::-1]
    return np.bitwise_count(quarters).astype(np.int16)


def _gap(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Least number of bits in which members of two boxes of counts differ."""
    return np.maximum(np.maximum(other_lo - hi, lo - other_hi), 0).sum(axis=-1)


def plan_tiles(keys: np.ndarray, counts: np.ndarray, tile_rows: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Tiles over the count vectors that occur: first tile and number of tiles of each key, and the boxes.

    Halves the keys along their widest side until a tile holds at most ``tile_rows`` fingerprints. A single key
    with more than that is shared by several tiles.
    """
    first, parts, boxes = np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64), []
    todo = [np.arange(len(keys))] if len(keys) else []
    while todo:
        part = todo.pop()
        lo, hi, rows = keys[part].min(axis=0), keys[part].max(axis=0), int(counts[part].sum())
        if rows <= tile_rows or len(part) == 1:
            first[part], parts[part] = len(boxes), max(1, -(-rows // tile_rows))
            boxes += [(lo, hi)] * int(parts[part[0]])
            continue
        side = int((hi - lo).argmax())
        order = part[np.argsort(keys[part, side], kind="stable")]
        values, below = keys[order, side], counts[order].cumsum()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        cut = int(cuts[np.abs(below[cuts - 1] - rows / 2).argmin()])
        todo += [order[:cut], order[cut:]]
    return first, parts, boxes


def fold_links(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest label of everything reachable, once the links i-j are added."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def tile_forest(prints: np.ndarray, sides: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between side 0 and side 1 (within side 0 where side 1 is empty)."""
    counts = popcounts(prints)
    order = np.lexsort((counts[:, 3], counts[:, 2], counts[:, 1], counts[:, 0], sides))
    prints, sides, counts = prints[order], sides[order], counts[order]
    split = int((sides == 0).sum())
    alone = split == len(prints)
    cut = lambda a, b: [(k, min(k + BLOCK, b)) for k in range(a, b, BLOCK)]
    left, right = cut(0, split), cut(0, split) if alone else cut(split, len(prints))
    lo = np.array([counts[a:b].min(axis=0) for a, b in right]).reshape(-1, 4)
    hi = np.array([counts[a:b].max(axis=0) for a, b in right]).reshape(-1, 4)
    label, held, n_held = np.arange(len(prints)), [], 0
    for n, (a, b) in enumerate(left):
        near = _gap(counts[a:b].min(axis=0), counts[a:b].max(axis=0), lo, hi) <= radius
        for k in np.flatnonzero(near):
            if alone and k < n:
                continue
            c, d = right[k]
            i, j = np.nonzero(np.bitwise_count(prints[a:b, None] ^ prints[None, c:d]) <= radius)
            held.append((i + a, j + c))
            n_held += len(i)
            if n_held > HELD:
                label, held, n_held = fold_links(label, *map(np.concatenate, zip(*held, strict=True))), [], 0
    if held:
        label = fold_links(label, *map(np.concatenate, zip(*held, strict=True)))
    linked = np.flatnonzero(label != np.arange(len(label)))
    signed = prints.view(np.int64)
    return list(zip(signed[linked].tolist(), signed[label[linked]].tolist(), strict=True))


def links(prints: DataFrame, radius: int) -> DataFrame:
    """A forest (``a``, ``b``) that joins just the fingerprints ``fp`` within ``radius`` bits of each other, transitively.

    ``prints`` has each fingerprint once. What reaches the driver is one row per vector of four counts (17 to the
    power of 4 at most) and what goes back is one row per pair of tiles.
    """
    spark = prints.sparkSession
    quarter = lambda n: F.bit_count(F.shiftrightunsigned("fp", 48 - 16 * n).bitwiseAND(F.lit(0xFFFF)))
    keyed = prints.select("fp", *(quarter(n).cast("int").alias(q) for n, q in enumerate(_QUARTERS)))
    seen = keyed.groupBy(*_QUARTERS).count().collect()
    keys = np.array([r[:4] for r in seen], dtype=np.int64).reshape(-1, 4)
    counts = np.array([r[4] for r in seen], dtype=np.int64)
    rows = min(max(TILE_ROWS[0], int(counts.sum()) // 64), TILE_ROWS[1])
    first, parts, boxes = plan_tiles(keys, counts, rows)
    lo, hi = (np.array([b[k] for b in boxes]).reshape(-1, 4) for k in (0, 1))
    members, pair = [], 0
    for a in range(len(boxes)):
        for b in np.flatnonzero(_gap(lo[a], hi[a], lo[a:], hi[a:]) <= radius) + a:
            members.append((a, pair, 0))
            if b != a:
                members.append((int(b), pair, 1))
            pair += 1
    places = [(*map(int, k), int(f), int(p)) for k, f, p in zip(keys, first, parts, strict=True)]
    place = spark.createDataFrame(places, "q0 int, q1 int, q2 int, q3 int, first int, parts int")
    member = spark.createDataFrame(members, "tile int, pair int, side byte")
    tiled = keyed.join(F.broadcast(place), [*_QUARTERS]).select(
        "fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int").alias("tile")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        prints = [np.asarray(p, dtype=np.int64) for p in group["prints"]]
        sides = np.repeat(group["side"].to_numpy(), [len(p) for p in prints])
        found = tile_forest(np.concatenate(prints).view(np.uint64), sides, radius)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    # a tile travels as one row, at most TILE_ROWS[1] longs, to each of its pairs
    packed = tiled.groupBy("tile").agg(F.collect_list("fp").alias("prints"))
    paired = packed.join(F.broadcast(member), "tile").select("pair", "side", "prints")
    # a task for each pair: few bytes are much work here, so tasks are not merged by their bytes
    return paired.repartition(max(1, min(pair, PAIR_TASKS)), "pair").groupBy("pair").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(``v``, ``root``) for every end of an edge (``a``, ``b``): the smallest value reachable from it.

    Large-star and small-star steps in turn, each written to the shared folder, until every edge leads to a root.
    """
    edges = written(edges.distinct(), "links")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("w"))
        )
        # the centre of a star has a row for each neighbour, so its neighbours are dealt over tasks
        least = written(both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = spread_lookup(both.filter("w > u"), least, "u", "n").select(F.col("w").alias("u"), F.col("m").alias("w"))
        small = written(large.filter("u <> w").distinct(), "small")
        floor = written(small.groupBy("u").agg(F.min("w").alias("m"), F.count("*").alias("n")), "floor")
        edges = written(
            spread_lookup(small, floor, "u", "n")
            .select(F.col("w").alias("a"), F.col("m").alias("b"))
            .unionByName(floor.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .filter("a <> b")
            .distinct(),
            "links",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int, radius: int) -> DataFrame:
    """``doc_id``, ``fp`` and ``component`` (smallest id reachable over links, its own included) of every row.

    Null and wordless texts have fingerprint 0 and link like any other. Rows with the same id stay apart. The
    component is null only where no row of it has an id. Other columns of ``docs`` are not read.
    """
    return _rooted(docs, doc_id, text, shingle, radius).drop("root")


def _rooted(docs: DataFrame, doc_id: str, text: str, shingle: int, radius: int) -> DataFrame:
    """As :func:`near_duplicates`, with the ``root`` that tells components of the same smallest id apart."""
    # docs -> one short row each, written, so that the texts are read and hashed once
    hashed = written(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(shingle)(text).alias("fp")), "prints")
    nodes = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = written(components(links(nodes.select("fp"), radius)), "roots")
    rooted = nodes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    smallest = written(rooted.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("prints")), "smallest")
    per_print = spread_lookup(rooted, smallest, "root", "prints").select("fp", "n", "component", "root")
    return spread_lookup(hashed, per_print, "fp", "n").select("doc_id", "fp", "component", "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int, radius: int) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, any one of it where the row is repeated.

    Where one id stands on different texts, each component keeps its own. Of components without any id one row per
    fingerprint stays.
    """
    found = written(_rooted(docs, doc_id, text, shingle, radius), "groups")
    kept = found.filter("doc_id = component").groupBy("root").agg(F.min("doc_id").alias("id"), F.min("fp").alias("kept_fp"))
    # only the texts of these ids need their fingerprint again to tell which of them stays
    shared = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    shared = shared.filter("a <> b").select(F.col("doc_id").alias("id"))
    fp = free_name(docs, "fp")
    printed = lambda rows: rows.withColumn(fp, _fingerprints(shingle)(text))
    named = kept.join(shared, "id", "left_anti").select(F.col("id").alias(doc_id))
    several = printed(docs.join(shared.select(F.col("id").alias(doc_id)), doc_id, "left_semi"))
    chosen = kept.join(shared, "id", "left_semi").select(F.col("id").alias(doc_id), F.col("kept_fp").alias(fp))
    lone = found.filter("component is null").select(F.col("fp").alias(fp)).distinct()
    nameless = printed(docs.filter(F.col(doc_id).isNull())).join(lone, fp, "left_semi").dropDuplicates([fp])
    return (
        docs.join(named, doc_id, "left_semi")
        .dropDuplicates([doc_id])
        .select(docs.columns)
        .unionByName(several.join(chosen, [doc_id, fp], "left_semi").dropDuplicates([doc_id, fp]).select(docs.columns))
        .unionByName(nameless.select(docs.columns))
    )


def hex_print(fp: str):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
