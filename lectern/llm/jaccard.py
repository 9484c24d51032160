"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A text's words are ASCII lower-cased runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``;
its shingles are the distinct runs of five words (a text of fewer words is one
shingle). Texts with the same shingles form one **class**, found by a fingerprint
of the set, and only one text of a class goes on: copies are never paired.

The forest has ``trees`` prefix tries over MinHash values. Two classes are
candidates where they share a trie's prefix. The prefix starts at ``longest``
values and is shortened until two texts exactly at the threshold meet in some trie
with the target probability (``depth``): with 24 tries and 0.99999 that is four
values, and texts of similarity 0.9 are missed about once in 10^11. A class
meets the smallest class of its prefix only, so the table of candidates has at
most one row for each class and trie, however large a group.

Candidates are joined into connected groups; the shingle sets of a group's classes
meet once (in blocks of ``block_rows`` where a group is larger) and **all** pairs
in a group are verified exactly by counting common shingles. Tasks return link
counts and a spanning tree, never all pairs.

Result, one row per document: ``class_id`` (the smallest doc_id linked to it
directly or through others, its own if none), ``n_links`` (other texts of
similarity at or over the threshold, classes counted once), ``n_copies`` (rows
with its shingles, itself included) and ``n_shingles``.

Cases: a null or empty text, or one without a word, has no shingle, no link, and
its own doc_id as class. Repeated rows are copies. A null doc_id is never the
smallest; a group of such rows alone has a null class. Very long texts have a long
set. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm.components import components
from lectern.session import kept


@dataclass(frozen=True)
class Forest:
    words: int = 5
    threshold: float = 0.8
    trees: int = 24
    longest: int = 8
    target: float = 0.99999
    block_rows: int = 2048
    block_shingles: int = 4_000_000

    @property
    def depth(self) -> int:
        """Shorten the prefix until the recall at the threshold reaches the target."""
        for depth in range(self.longest, 1, -1):
            if 1 - (1 - self.threshold**depth) ** self.trees >= self.target:
                return depth
        return 1


def shingle_sets(block: B.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and the first of each."""
    found = B.words(block, B.ALNUM)
    hashes = B.span_hashes(B.LOWER[block.data], found.start, found.end)
    inside = B.grams_inside(found.first, size, len(hashes))
    values, owner = B.gram_hashes(hashes, size)[inside], found.doc[: len(inside)][inside]
    short = np.flatnonzero((found.counts > 0) & (found.counts < size))
    if len(short):
        more = [B.gram_hashes(hashes[found.first[d] : found.first[d + 1]], int(found.counts[d]), seed=int(found.counts[d]))[0] for d in short]
        values, owner = np.append(values, np.array(more, np.uint64)), np.append(owner, short)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(block.n + 1))


def prefixes(values: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Hash of each trie's prefix of MinHash values, a row per document with shingles."""
    factors = B.constants(71, trees * depth) | np.uint64(1)
    masks = B.constants(72, trees * depth)
    out = np.zeros((len(first), trees), np.uint64)
    for tree in range(trees):
        for k in range(tree * depth, (tree + 1) * depth):
            least = np.minimum.reduceat((values ^ masks[k]) * factors[k], first)
            out[:, tree] = B.mixed(out[:, tree] + least)
    return out


SIGNED = "doc_id long, mark long, class long, n_shingles long, labels array<long>"


def signed(docs: DataFrame, forest: Forest) -> DataFrame:
    """Each row's class (fingerprint of its shingles, null without any) and its prefixes."""
    trees, depth, size = forest.trees, forest.depth, forest.words

    def run(batches):
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                values, first = shingle_sets(block, size)
                counts = np.diff(first)
                some = np.flatnonzero(counts)
                labels = np.zeros((block.n, trees), np.uint64)
                prints = np.zeros(block.n, np.uint64)
                if len(some):
                    labels[some] = prefixes(values, first[:-1][some], trees, depth)
                    prints[some] = np.add.reduceat(B.mixed(values), first[:-1][some])
                    prints[some] = B.mixed(prints[some] + counts[some].astype(np.uint64))
                part = batch.slice(block.row, block.n)
                offsets = np.append(0, np.cumsum(np.where(counts > 0, trees, 0)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("mark"),
                        pa.array(prints.view(np.int64), mask=counts == 0),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(labels[some].ravel().view(np.int64))),
                    ],
                    ["doc_id", "mark", "class", "n_shingles", "labels"],
                )

    return B.modest(docs).select("doc_id", "text", text_mark().alias("mark")).mapInArrow(run, SIGNED)


def text_mark():
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def candidate_groups(classes: DataFrame) -> DataFrame:
    """node and root: classes joined where they share a prefix of some trie."""
    rows = classes.select("class", F.posexplode("labels").alias("tree", "label"))
    heads = rows.groupBy("tree", "label").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = rows.join(heads, ["tree", "label"]).select(F.col("class").alias("a"), F.col("head").alias("b"))
    return components(edges)


def linked_sets(sets: list[np.ndarray], part: np.ndarray | None, needed: int, scale: int, columns: int = 2048, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Smallest index of each set's component, and its number of links.

    Links are pairs whose intersection over union is ``needed / scale`` or more, and of different
    parts where parts are given. Pairs are counted in tiles, so memory is that of a tile whatever
    the number of sets.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values)
    ranked, owner = values[order], owner[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)
    length = np.diff(np.append(start, len(ranked)))
    shared = length > 1
    owner = owner[np.repeat(shared, length)]
    column = np.repeat(np.arange(int(shared.sum())), length[shared])
    by_owner = np.argsort(owner, kind="stable")
    owner, column = owner[by_owner], column[by_owner]
    n_columns, edges = int(shared.sum()), np.searchsorted(owner, np.arange(0, m + tile, tile))

    def dense(k: int, low: int) -> np.ndarray:
        """Rows of tile ``k`` over columns from ``low``."""
        mine, at = owner[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]]
        inside = (at >= low) & (at < low + columns)
        out = np.zeros((min(tile, m - k * tile), columns), np.float32)
        out[mine[inside] - k * tile, at[inside] - low] = 1
        return out

    links, root = np.zeros(m, np.int64), np.arange(m)
    for a in range(-(-m // tile)):
        for b in range(a, -(-m // tile)):
            total = np.zeros((min(tile, m - a * tile), min(tile, m - b * tile)), np.float32)
            for low in range(0, n_columns, columns):
                left = dense(a, low)
                if left.any():
                    total += left @ (left if a == b else dense(b, low)).T
            x, y = np.nonzero(total)
            common = total[x, y].astype(np.int64)
            x, y = x + a * tile, y + b * tile
            hit = (common * scale >= needed * (sizes[x] + sizes[y] - common)) & (x < y)
            if part is not None:
                hit &= part[x] != part[y]
            x, y = x[hit], y[hit]
            links += np.bincount(x, minlength=m) + np.bincount(y, minlength=m)
            root = united(root, np.stack([x, y], axis=1))
    return root, links


def united(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The smallest index of each component once the pairs are joined too."""
    while len(pairs):
        x, y = root[pairs[:, 0]], root[pairs[:, 1]]
        apart = x != y
        if not apart.any():
            break
        pairs, low, high = pairs[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        link = np.arange(len(root))
        np.minimum.at(link, high, low)
        while (link[link] != link).any():
            link = link[link]
        root = link[root]
    return root


VERIFIED = "node long, root long, links long"


def verify(groups: DataFrame, threshold: float) -> DataFrame:
    """Links of each class within its group of sets (part ``x`` against part ``y``) and a tree that spans them."""
    scale = 10_000
    needed = round(threshold * scale)

    def run(table):
        nodes = np.array(table.column("node").to_pylist(), np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        part = np.array(table.column("part").to_pylist()) if x != y else None
        root, links = linked_sets(sets, part, needed, scale)
        return pa.table({"node": nodes, "root": nodes[root], "links": links})

    return groups.groupBy("group", "x", "y").applyInArrow(run, VERIFIED)


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """Replace ``text`` by the packed shingle set."""

    def run(batches):
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                values, first = shingle_sets(block, size)
                part = batch.slice(block.row, block.n)
                raw = [values[first[d] : first[d + 1]].tobytes() for d in range(block.n)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("group", "node", "parts", "part")), pa.array(raw, pa.binary())],
                    ["group", "node", "parts", "part", "shingles"],
                )

    picked = rows.select("group", "node", "parts", "part", "text")
    return picked.mapInArrow(run, "group long, node long, parts long, part long, shingles binary")


def joined(docs: DataFrame, forest: Forest = Forest()) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, class, n_shingles) and classes (class, root, n_links, n_copies, lead)."""
    rows = kept(signed(docs, forest), "shingled")
    classes = rows.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("lead"),
        F.count(F.lit(1)).alias("n_copies"),
        F.first("labels").alias("labels"),
        F.max("n_shingles").alias("n_shingles"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("sample"),
    )
    classes = kept(classes, "classes")
    groups = candidate_groups(classes)
    members = kept(
        groups.join(classes.select(F.col("class").alias("node"), "n_shingles", "sample.doc_id", "sample.mark"), "node"), "members"
    )
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")).select(
        "root",
        F.greatest(F.ceil(F.col("n") / forest.block_rows), F.ceil(F.col("total") / forest.block_shingles)).alias("parts"),
    )
    wanted = members.join(sizes, "root").select(
        "doc_id", "mark", "node", F.col("root").alias("group"), "parts",
        F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"),
    )
    texts = docs.select("doc_id", "text", text_mark().alias("mark"))
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["mark"] == wanted["mark"])
    # A merge at every size: a broadcast would stop fitting as the corpus grows.
    # Repeated rows bring the same set; one of them is enough.
    sets = _sets(texts.hint("merge").join(wanted, same), forest.words).dropDuplicates(["node"])
    # Part p meets every part q: in the block (min, max) of the two.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    placed = sets.withColumn("q", other).select(
        "group", "node", "part", "shingles", F.least("part", "q").alias("x"), F.greatest("part", "q").alias("y")
    )
    verified = kept(verify(placed, forest.threshold), "verified")
    linked = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    whole = (
        classes.select("class", "lead", "n_copies")
        .join(linked.select(F.col("node").alias("class"), "root"), "class", "left")
        .join(counts.select(F.col("node").alias("class"), "n_links"), "class", "left")
        .select("class", "lead", "n_copies", F.coalesce("root", "class").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return rows.drop("labels"), kept(whole, "class-links")


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies, n_shingles."""
    rows, classes = joined(docs, forest)
    least = classes.groupBy("root").agg(F.min("lead").alias("class_id"))
    named = classes.join(least, "root").select("class", "class_id", "n_links", "n_copies")
    return rows.join(named, "class", "left").select(
        "doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        "n_shingles",
    )


def one_of_each(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """The documents with the smallest doc_id of each group, with all their columns; texts without a word stay."""
    rows, classes = joined(docs, forest)
    placed = rows.join(classes.select("class", "root"), "class", "left")
    first = placed.where("class is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("s")
    ).select("s.doc_id", "s.mark", F.lit(True).alias("lead"))
    wordless = rows.where("class is null").select("doc_id", "mark", F.lit(False).alias("lead"))
    chosen = first.unionAll(wordless.distinct())
    mark, other, chosen_mark, lead, own = B.unused(docs.columns, "__mark", "__id", "__chosen", "__lead", "__own")
    marked = docs.withColumn(mark, text_mark())
    keys = chosen.select(F.col("doc_id").alias(other), F.col("mark").alias(chosen_mark), F.col("lead").alias(lead))
    stay = marked.join(keys, marked["doc_id"].eqNullSafe(keys[other]) & (marked[mark] == keys[chosen_mark]))
    # Repeated rows of a group are one document; rows without a word are not judged.
    stay = stay.withColumn(own, F.when(F.col(lead), F.lit(0)).otherwise(F.monotonically_increasing_id()))
    return stay.dropDuplicates(["doc_id", mark, own]).select(*docs.columns)
