"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

Documents are sets of word shingles; two are linked where their Jaccard similarity is ``threshold`` or more. Equal sets form one class
and are never compared. A class has a sketch (see ``sketches``); classes that agree in a band of it share a bucket. Inside a bucket the
8-bit sketches are compared: first a maximum spanning forest by estimated similarity gives candidate links; they are confirmed on
the full sets and joined to components; then every pair of a bucket that is still in two components, and whose estimate is within
``SIGMAS`` standard deviations of the threshold, is confirmed as well. So a large group costs as many links as members, but no link
that could join two components is left out, save with the probabilities of banding (1e-6 a pair) and of the estimate (3e-5).

A bucket or a component that outgrows ``CELL_ROWS`` is dealt over cells that together hold all of its pairs. Classes are known by a
64-bit hash of their set. Defined results: texts without words have an empty set, no links, and are their own component; rows with
one id are one document, so its texts, empty ones too, share a component; a null id has no component and is kept; an empty table gives an empty result. Other columns are ignored
by ``duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallygrid.llm.components import components
from tallygrid.llm.sketches import band_keys, bands, shingle_sets, sketch
from tallygrid.llm.textkit import WordHashes, byte_strings, chunks, free_name, runs, stored

SKETCH = 1024
BANDED = 256
CELL_ROWS = 4096
SIGMAS = 4.0


def node_of(shingles: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0])


def _sets(texts: list[bytes], width: int, hashes: WordHashes) -> Iterator[tuple[int, list[np.ndarray]]]:
    for lo, hi in chunks(texts):
        yield lo, shingle_sets(texts[lo:hi], width, hashes)


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """(id, n, node, bands) of each document; bands only at the first document of a class in its task."""
    kind = docs.schema[id_col].dataType.simpleString()
    count, rows = bands(BANDED, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for lo, sets in _sets(byte_strings(batch.column(1)), width, hashes):
                nodes = [node_of(s) if len(s) else None for s in sets]
                new = [i for i, node in enumerate(nodes) if node is not None and node not in seen and not seen.add(node)]
                keys = [None] * len(sets)
                for i, own in zip(new, band_keys(sketch([sets[i] for i in new], SKETCH), count, rows).view(np.int64)):
                    keys[i] = own
                columns = [batch.column(0).slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "node", "bands"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, node long, bands array<long>")


def _full_sets(texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, n, shingles, sketch, bands) of each text; shingles and band keys as 64-bit words, sketches by the lowest byte of each coordinate."""
    count, rows = bands(BANDED, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for _, sets in _sets(byte_strings(batch.column(0)), width, hashes):
                full = sketch(sets, SKETCH)
                low = (full & np.uint64(255)).astype(np.uint8)
                keys = band_keys(full, count, rows)
                columns = [
                    pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in low], pa.binary()),
                    pa.array([k.tobytes() for k in keys], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "shingles", "sketch", "bands"])

    return texts.mapInArrow(run, "node long, n long, shingles binary, sketch binary, bands binary")


@dataclass
class Cell:
    """Classes of a bucket, or of two blocks of a large one."""

    nodes: np.ndarray
    roots: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    bands: np.ndarray
    blocks: np.ndarray
    band: int
    one_block: bool


def forest(cell: Cell, threshold: float) -> list[tuple[int, int]]:
    """Maximum spanning forest over the shares of equal coordinates (Prim), without links that are likely too weak."""
    least = SKETCH * threshold - deviation(threshold)
    n = len(cell.nodes)
    best, by = np.full(n, -1), np.zeros(n, np.int64)
    left, at, out = np.ones(n, bool), 0, []
    for _ in range(n - 1):
        left[at] = False
        equal = (cell.low == cell.low[at]).sum(1)
        better = left & (equal > best)
        best[better], by[better] = equal[better], at
        at = int(np.where(left, best, -1).argmax())
        if best[at] >= least:
            out.append((int(cell.nodes[by[at]]), int(cell.nodes[at])))
    return out


def open_pairs(cell: Cell, threshold: float) -> list[tuple[int, int]]:
    """Pairs in different components that may be similar enough by their sizes and sketches.

    A pair that shares several buckets is given by the first of its bands, one within a block by that block's own cell.
    """
    least = SKETCH * threshold - SIGMAS * deviation(threshold)
    out = []
    for i in range(len(cell.nodes) - 1):
        other = np.flatnonzero(cell.roots[i + 1 :] != cell.roots[i]) + i + 1
        if not cell.one_block:
            other = other[cell.blocks[other] != cell.blocks[i]]
        other = other[np.minimum(cell.sizes[other], cell.sizes[i]) >= threshold * np.maximum(cell.sizes[other], cell.sizes[i]) - 1e-9]
        other = other[(cell.low[other] == cell.low[i]).sum(1) >= least]
        other = other[(cell.bands[other] == cell.bands[i]).argmax(1) == cell.band]
        out.extend((int(cell.nodes[i]), int(cell.nodes[j])) for j in other)
    return out


def deviation(threshold: float) -> float:
    """Standard deviation of the number of equal coordinates at the threshold."""
    return float(np.sqrt(SKETCH * threshold * (1 - threshold)))


def _candidates(members: DataFrame, sets: DataFrame, roots: DataFrame | None, threshold: float, choose: Callable) -> DataFrame:
    """Candidate links (a, b), a < b, of every bucket, chosen by ``choose``."""
    members = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    key = Window.partitionBy("key")
    live = members.select("*", F.min("root").over(key).alias("r0"), F.max("root").over(key).alias("r1"), F.count(F.lit(1)).over(key).alias("rows")).where("r0 <> r1")
    parts = F.ceil(F.col("rows") / CELL_ROWS)
    block = F.pmod(F.xxhash64("node"), parts)
    dealt = live.select("key", "band", "node", "root", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    cell = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    rows = dealt.select(cell.alias("cell"), "band", "node", "root", "block").join(sets.select("node", "n", "sketch", "bands"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            if group.num_rows < 2:
                continue
            band, nodes, roots, blocks, sizes = (group.column(i).to_numpy() for i in range(1, 6))
            low = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint8).reshape(-1, SKETCH)
            keys = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint64).reshape(len(low), -1)
            own, first = np.unique(nodes, return_index=True)
            one = len(np.unique(blocks)) == 1
            pairs = choose(Cell(own, roots[first], sizes[first], low[first], keys[first], blocks[first], int(band[0]), one), threshold)
            a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    ordered = rows.select("cell", "band", "node", "root", "block", "n", "sketch", "bands").repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, roots: DataFrame | None, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Pairs meet in cells named by the component of one end, so that a set is sent once for many pairs. The host is the end in the
    larger component; a component is dealt over as many cells as its pairs need.
    """
    if roots is not None:
        size = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
        known = roots.join(size, "root").select("node", "root", "members")
        for end in ("a", "b"):
            pairs = pairs.join(known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"), F.col("members").alias(f"{end}_size")), end, "left")
        host_b = F.coalesce("b_size", F.lit(1)) >= F.coalesce("a_size", F.lit(1))
        host, root = F.when(host_b, F.col("b")).otherwise(F.col("a")), F.when(host_b, F.col("b_root")).otherwise(F.col("a_root"))
        parts = F.ceil(F.when(host_b, F.col("b_size")).otherwise(F.col("a_size")) / 512)
        cell = F.xxhash64(F.coalesce(root, host), F.coalesce(F.pmod(F.xxhash64(host), parts), F.lit(0)))
    else:
        cell = F.col("b")
    pairs = pairs.select(cell.alias("cell"), "a", "b")
    ends = pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "shingles"), "node")
    rows = ends.select("cell", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "shingles")
    rows = rows.union(pairs.select("cell", F.lit(1), "a", "b", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known = None, {}
        for batch in batches:
            found = []
            for at, kind, a, b, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if at != cell:
                    cell, known = at, {}
                if kind == 0:
                    known[a] = np.frombuffer(shingles, np.uint64)
                elif alike(known[a], known[b], threshold):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, "a long, b long")


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the similarity of two sorted sets is ``threshold`` (a percentage in whole numbers) or more."""
    common = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * common >= round(100 * threshold) * (len(x) + len(y) - common)


def duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: size of its set, smallest id it is linked with by any number of steps, and whether it is that id."""
    signed = stored(_signatures(docs, id_col, text_col, width, threshold), "signatures")
    classes = stored(signed.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("first")), "classes")
    many = signed.where("id is not null").groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("texts"))
    many = stored(many.where("texts > 1 and low is not null").select(F.col("id").alias("of"), "low", "high"), "repeated-ids")
    tied = signed.join(many.where("low <> high"), F.col("id") == F.col("of")).where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    tied = stored(tied, "texts-of-one-id")
    key = Window.partitionBy("key")
    keys = signed.where("bands is not null").select(F.posexplode("bands").alias("band", "key"), "node")
    shared = keys.select("key", "band", "node", F.min("node").over(key).alias("low"), F.max("node").over(key).alias("high")).where("low <> high")
    members = stored(shared.select("key", "band", "node").distinct(), "buckets")
    wanted = stored(members.select("node").distinct().join(classes, "node").select(F.col("first").alias(free_name(docs, "wanted"))).distinct(), "bucketed")
    texts = docs.select(id_col, text_col).join(wanted.hint("shuffle_hash"), F.col(id_col) == F.col(wanted.columns[0]), "left_semi")
    sets = stored(_full_sets(texts.select(text_col), width, threshold).dropDuplicates(["node"]), "shingle-sets")
    first = stored(verified(stored(_candidates(members, sets, None, threshold, forest), "candidates"), sets, None, threshold), "verified")
    first = first.union(tied)
    roots = stored(components(first), "roots")
    rest = stored(_candidates(members, sets, roots, threshold, open_pairs), "candidates")
    more = stored(verified(rest, sets, roots, threshold), "verified")
    roots = stored(components(first.union(more)), "roots")
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.select("node", "root").join(least, "root").select(F.col("node").alias("named"), "component_id"), "components")
    out = signed.select("id", "n", "node").join(many.select("of", "low"), F.col("id") == F.col("of"), "left")
    out = out.withColumn("node", F.coalesce("node", "low")).join(named, F.col("node") == F.col("named"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are linked to one with a smaller id; all columns stay."""
    gone = duplicates(docs, width, threshold, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(free_name(docs, "gone"))).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col(id_col) == F.col(gone.columns[0]), "left_anti")
