"""Groups of records that share most of their words: covering locality-sensitive hashing, then an exact check.

Each distinct word set gets a sketch of ``groups * width`` positions; two sketches differ in a position with one
minus the sets' weighted overlap as probability (consistent weighted sampling: rare words weigh more, so template
words don't fill the buckets). The positions are cut into groups, and in each group three structured masks are laid
over the positions: position i belongs to class i mod 3 and mask v leaves out class v. One differing position lies in
one class only, so the mask that leaves that class out still agrees: every pair with at most one difference in some
group collides. By the pigeonhole principle every pair of sketches within Hamming radius 2 * groups - 1 collides in
some table for certain; pairs beyond it collide with high probability. Collisions are checked exactly on the words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.buckets import candidate_pairs, crowded_keys, looked_at, salted_parts
from loomgraph.llm.staging import shuffles, stage, stage_by
from loomgraph.operators.skew import join_sized

#: Cells of the document-frequency sketch: fixed, whatever the size of the collection (1 MB as float32).
CELLS = 1 << 18
CHUNKS = 16
PRIOR = 1000


@dataclass(frozen=True)
class NearSpec:
    """``threshold`` as a fraction of integers; ``groups`` * ``width`` sketch positions; ``power`` of the word weight.

    ``expand``: classes of equal word sets with at most so many ids are listed in full. In larger ones each text stands by
    its first id, to which its copies are linked, and texts are listed in full if there are at most so many of them; else
    they are linked to the class's first id. No link between different word sets depends on it.
    """

    numerator: int = 7
    denominator: int = 10
    groups: int = 10
    power: float = 1.5
    hot: int = 256
    expand: int = 64

    def width(self, n: int) -> int:
        """Positions in a group: one more for each factor of 30 in the collection beyond a million, so buckets stay small."""
        return 5 + max(0, int(np.ceil(np.log(max(n, 1) / 1e6) / np.log(30))))

    def parts(self, n: int) -> int:
        """Groups: as many as keep the chance of a miss where ``groups`` of five positions have it, at every size."""
        miss = (1 - hit(5, AGREE)) ** self.groups
        return int(np.ceil(np.log(miss) / np.log(1 - hit(self.width(n), AGREE)) - 1e-9))


#: Agreement of the sketches of two texts at the threshold whose few differing words are rare (the lowest met with).
AGREE = 0.53


def hit(width: int, agree: float) -> float:
    """Chance that two sketches share a key of one group, when each position agrees with chance ``agree``.

    Mask v is met if all positions outside class v (i mod 3) agree; two masks are met only if all positions agree.
    """
    outside = [sum(i % 3 != v for i in range(width)) for v in range(3)]
    return sum(agree**k for k in outside) - 2 * agree**width


def word_array(label: Column, summary: Column) -> Column:
    """Hashes, in order, of the distinct words: runs of letters and digits of both texts, lower-cased (null as empty)."""
    text = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(summary, F.lit(""))))
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, lambda x: F.xxhash64(x))))


def worded(nodes: DataFrame) -> DataFrame:
    """(id, class, copy, words): the rows with an id and at least one word (other texts overlap with nothing), their
    hashed words, the hash of the word set and that of the texts as they are."""
    exact = F.xxhash64(F.coalesce("label", F.lit("\0")), F.coalesce("summary", F.lit("\0")))
    rows = nodes.where(F.col("id").isNotNull()).select("id", exact.alias("copy"), word_array(F.col("label"), F.col("summary")).alias("words"))
    return rows.where(F.size("words") > 0).select("id", F.xxhash64("words").alias("class"), "copy", "words")


def word_classes(rows: DataFrame) -> DataFrame:
    """(class, rep, words, size): the distinct word sets of (id, class, words) rows with their first id."""
    return rows.groupBy("class").agg(F.min("id").alias("rep"), F.first("words").alias("words")).withColumn("size", F.size("words"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    column = column if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64, copy=False), np.diff(column.offsets.to_numpy())


def frequency_sketch(classes: DataFrame) -> np.ndarray:
    """Document frequency of hashed words in CELLS counters, over all rows; the driver gets the fixed-size counters."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for b in batches:
            flat, _ = _lists(b.column(0))
            cells += np.bincount((flat >> np.uint64(24)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
        used = [i for i in range(CHUNKS) if cells[i * CELLS // CHUNKS : (i + 1) * CELLS // CHUNKS].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([cells[i * CELLS // CHUNKS : (i + 1) * CELLS // CHUNKS].astype("<i8").tobytes() for i in used], pa.binary())], names=["chunk", "cells"]
        )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw, "<i8")
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["chunk", "cells"])

    schema = "chunk int, cells binary"
    parts = classes.select("words").mapInArrow(count, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema)
    out = np.zeros(CELLS, np.int64)
    for chunk, raw in parts.collect():
        out[chunk * CELLS // CHUNKS : (chunk + 1) * CELLS // CHUNKS] = np.frombuffer(bytes(raw), "<i8")
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def sketches(flat: np.ndarray, lengths: np.ndarray, weights: np.ndarray, positions: int) -> np.ndarray:
    """(documents, positions) symbols by consistent weighted sampling; every document has a word."""
    start = np.r_[0, np.cumsum(lengths)[:-1]]
    scale = (-1.0 / weights[(flat >> np.uint64(24)).astype(np.int64) & (CELLS - 1)]).astype(np.float32)
    out = np.empty((len(lengths), positions), np.uint32)
    for j in range(positions):
        draw = _mix(flat + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        u = ((draw >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
        out[:, j] = np.minimum.reduceat(np.log(u) * scale, start).view(np.uint32)
    return out


def covering_keys(sk: np.ndarray, groups: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, keys) for each group and mask."""
    salt = _mix(np.arange(1, groups * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for g in range(groups):
        for v in range(3):
            key = np.full(len(sk), (g * 3 + v + 1) * 0x2545F4914F6CDD1D & (2**64 - 1), np.uint64)
            for i in range(width):
                if i % 3 != v:
                    key = _mix(key ^ (sk[:, g * width + i].astype(np.uint64) * salt[g * width + i]))
            yield g, key.view(np.int64)


def nibbles(sk: np.ndarray, half: int) -> np.ndarray:
    """Four bits of each of 16 positions, packed: of the even ones of 32 (half 0) or the odd ones (half 1)."""
    sig = np.zeros(len(sk), np.uint64)
    for i in range(16):
        sig |= (_mix(sk[:, (2 * i + half) * sk.shape[1] // 32].astype(np.uint64)) & np.uint64(15)) << np.uint64(4 * i)
    return sig.view(np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the 16 packed positions differ."""
    x = (a ^ b).view(np.uint64)
    x |= (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))
    return np.bitwise_count(x & np.uint64(0x1111111111111111))


def near_classes(classes: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """(class_a, class_b, overlap): pairs of different word sets whose overlap reaches the threshold."""
    n = classes.count()
    width = spec.width(n)
    counts = frequency_sketch(classes)
    # As if PRIOR further texts had none of the words: in a small collection a word of most texts still counts.
    weights = np.maximum(np.log((n + PRIOR) / np.maximum(counts, 1)), 0.05) ** spec.power
    shared = classes.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    groups = spec.parts(n)
    num, den = spec.numerator, spec.denominator

    def keys(batches: Iterable[pa.RecordBatch], crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, lengths = _lists(b.column(1))
            if not len(lengths):
                continue
            sk = sketches(flat, lengths, shared.value, groups * width)
            doc, size = b.column(0), pa.array(lengths.astype(np.int32))
            sig = [pa.array(nibbles(sk, h)) for h in (0, 1)]
            for g, key in covering_keys(sk, groups, width):
                yield pa.RecordBatch.from_arrays([doc, pa.array(salted_parts(doc.to_numpy(), key, g, crowded)), pa.array(key), *sig, size], names=["doc", "part", "key", "sig", "sig2", "size"])

    def keep(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        # Overlaps at the threshold leave about 18 of the 32 packed positions equal, unrelated texts 2 to 4: ten are asked for.
        small, large = np.minimum(a[2], b[2]).astype(np.int64), np.maximum(a[2], b[2]).astype(np.int64)
        return (differing(a[0], b[0]) + differing(a[1], b[1]) <= 22) & (small * den >= large * num)

    def index(rows: DataFrame, crowded: np.ndarray) -> DataFrame:
        return rows.select(F.col("class").alias("doc"), "words").mapInArrow(lambda batches: keys(batches, crowded), "doc long, part int, key long, sig long, sig2 long, size int")

    few, share = looked_at(classes, "class", n)
    with shuffles(classes.sparkSession, n * groups * 3):
        crowded = crowded_keys(index(few, np.zeros(0, np.int64)), share, spec.hot) if n > spec.hot else np.zeros(0, np.int64)
        pairs = stage(candidate_pairs(index(classes, crowded), keep, spec.hot), "near-pairs")
    wa, wb = (classes.select(F.col("class").alias(c), F.col("words").alias(f"w{c}")) for c in ("a", "b"))
    both = pairs.join(wa, "a").join(wb, "b")
    common = F.size(F.array_intersect("wa", "wb")).cast("long")
    counted = both.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), common.alias("c"), (F.size("wa") + F.size("wb")).cast("long").alias("s"))
    return counted.where(F.col("c") * den >= (F.col("s") - F.col("c")) * num).select("class_a", "class_b", (F.col("c") / (F.col("s") - F.col("c"))).alias("overlap"))


def near_ids(nodes: DataFrame, spec: NearSpec = NearSpec()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links between classes, classes, membership (id, class, copy))."""
    with shuffles(nodes.sparkSession, nodes.count()):
        rows = stage(worded(nodes), "near-words")
        classes = stage_by(word_classes(rows), "near-classes", "class")
        links = stage(near_classes(classes, spec), "near-links")
        members = stage(rows.groupBy("id").agg(F.min(F.struct("class", "copy")).alias("m")).select("id", "m.*"), "near-members")
    return links, classes, members


def near_pairs(nodes: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """(id_a, id_b), id_a < id_b: near-duplicate ids.

    All pairs of ids come out, but for classes of more than ``expand`` ids (see :class:`NearSpec`): there the first id
    of each text stands for its copies, which are linked to it.
    """
    links, classes, members = near_ids(nodes, spec)
    linked = links.select(F.col("class_a").alias("class")).union(links.select("class_b")).distinct()
    total = members.count()
    texts = members.groupBy("class", "copy").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    several = texts.groupBy("class").agg(F.sum("n").alias("ids"), F.min("first").alias("rep"), F.count(F.lit(1)).alias("texts")).where(F.col("ids") > 1)
    copies = stage(join_sized(members, several, "class", "ids", total), "near-copies")
    large = stage(texts.join(several.where(F.col("ids") > spec.expand), "class"), "near-texts")
    few = F.col("texts") <= spec.expand
    single = classes.select("class", F.col("rep").alias("id")).join(linked, "class", "left_semi").join(copies.select("class").distinct(), "class", "left_anti")
    small = copies.where(F.col("ids") <= spec.expand).select("class", "id")
    listed = large.where(few).select("class", F.col("first").alias("id"))
    shown = single.unionByName(small).unionByName(listed).unionByName(large.where(~few).select("class", F.col("rep").alias("id")).distinct())
    a, b = shown.select(F.col("class").alias("class_a"), F.col("id").alias("x")), shown.select(F.col("class").alias("class_b"), F.col("id").alias("y"))
    between = links.join(a, "class_a").join(b, "class_b").select("x", "y")
    full = small.unionByName(listed)  # at most ``expand`` of each class
    within = full.select("class", F.col("id").alias("x")).join(full.select("class", F.col("id").alias("y")), "class").where(F.col("x") < F.col("y")).select("x", "y")
    mark = F.xxhash64("class", "copy").alias("mark")
    firsts = large.select(mark, "first", "n")
    of_text = join_sized(copies.where(F.col("ids") > spec.expand).select("id", mark), firsts, "mark", "n", total).select(F.col("first").alias("x"), F.col("id").alias("y"))
    of_class = large.where(~few).select(F.col("rep").alias("x"), F.col("first").alias("y"))
    pairs = between.unionByName(within).unionByName(of_text).unionByName(of_class).where(F.col("x") != F.col("y"))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def connected_groups(links: DataFrame, classes: DataFrame, rounds: int = 200) -> DataFrame:
    """(class, group): connected components by min-label hooking with pointer jumping; all state stays distributed.

    The rounds needed grow with the logarithm of the longest chain; not being done after ``rounds`` is an error."""
    labels = stage(classes.select("class", F.col("class").alias("label")), "labels")
    edges = stage(links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).union(links.select("class_b", "class_a")), "edges")
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("class", "v"), "v").groupBy("u").agg(F.min("label").alias("other"))
        hooked = labels.join(near, F.col("class") == F.col("u"), "left").select("class", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jumped = hooked.alias("h").join(labels.select(F.col("class").alias("c"), F.col("label").alias("up")), F.col("label") == F.col("c"), "left")
        nxt = stage(jumped.select("class", "old", F.least("label", "up").alias("label")), "labels")
        if nxt.where(F.col("old") != F.col("label")).limit(1).count() == 0:
            return nxt.select("class", F.col("label").alias("group"))
        labels = nxt.select("class", "label")
    raise RuntimeError(f"components are not connected after {rounds} rounds")


def near_groups(nodes: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per node with words; ids of a group share the group's first id.

    ``class_id`` is the first id with the same word set, ``n_links`` the number of other word sets near to it.
    Nodes near to no other form groups of their own. Blank nodes are left out.
    """
    links, classes, members = near_ids(nodes, spec)
    degree = links.select(F.col("class_a").alias("class")).unionAll(links.select("class_b")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    linked = classes.join(degree, "class")
    group = connected_groups(links, linked).join(classes.select("class", "rep"), "class")
    named = group.groupBy("group").agg(F.min("rep").alias("group_id"))
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("ids"))
    per_class = classes.select("class", "rep").join(sizes, "class").join(degree, "class", "left").join(group.select("class", "group").join(named, "group").select("class", "group_id"), "class", "left")
    return join_sized(members, per_class, "class", "ids", members.count()).select("id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
