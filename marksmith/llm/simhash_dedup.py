"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

``near_duplicates`` links fingerprints of 64 bits that differ in at most two. Cut into four blocks of 16
bits, such a pair agrees in at least two blocks, so each pair of blocks is a join key, and candidates are
verified by their Hamming distance. Rows with equal fingerprints are one class from the start. A key that
more than ``SMALL_BUCKET`` classes share isn't joined pair by pair: its classes are spread over all 65
fingerprints within one bit, and two classes meet there exactly when they differ in two bits or fewer. A
point has at most 65 classes around it, so either way is linear in the rows, and no link is lost.

``drop_near_duplicates`` serves a similarity (Jaccard, of shingles of five words): its fingerprints have
as many blocks as find a pair of that similarity with probability ``RECALL``, each block's width growing
with the logarithm of the number of texts, so that the expected candidates of a row stay constant.
Candidates are all pairs that share a block and are not tied yet, however many share it; they are verified by
the Hamming distance of the whole fingerprint, and where that lies within ``UNSURE`` standard deviations of the
limit, by the exact similarity of the two texts.

Defined results: null and empty texts, and those of white space alone, have the fingerprint zero and are
linked like any other. A text of fewer words than a shingle is one shingle. Rows without id are linked to
nothing and have no component. Rows that repeat an id with different texts have fingerprints of their own;
classes of texts whose smallest id is the same are linked by it. Texts may be of any length. An empty table
gives an empty table. Only the id and the text are read, so extra columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, record_batches, texts, written
from .components import components

WORDS, MAX_BITS, SEED = 3, 2, 42
BLOCKS, BLOCK_BITS, SMALL_BUCKET = 4, 16, 16
#: Shingles whose bits are counted together.
STEP = 1 << 14

#: The similarity stage: words to a shingle, least similarity, share of such pairs that blocks are to find, neighbours
#: compared in a block, the bits that a pair is verified by at least, and how far from the limit it is checked exactly.
SIMILAR_WORDS, SIMILARITY, RECALL, NEIGHBOURS, VERIFY_BITS, UNSURE = 5, 0.8, 0.95, 4, 2048, 3.0
#: Blocks of the first pass, which chains large groups.
FIRST_BLOCKS = 10
#: Rows of a part of a crowded key, and rows compared with the others at once.
PART_ROWS, COMPARED_TOGETHER = 4096, 256


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, as bytes (rows of eight, the lowest first); A-Z lower-cased."""
    found = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space alone
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        made = [digest(b" ".join(found), SEED)] if found else []
    else:
        made = [digest(b" ".join(s), SEED) for s in zip(*[found[k:] for k in range(words)])]
    return np.frombuffer(b"".join(made), dtype=np.uint8).reshape(-1, 8)[:, ::-1]


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits as a signed number: a bit is set when over half of the shingles' hashes have it."""
    h = shingle_hashes(text, words)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), STEP):
        ones += np.unpackbits(h[at : at + STEP], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(doc, fingerprint(text.as_py(), words)) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))]
            yield from record_batches(made, "doc_id long, fp long")

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: Column) -> Column:
    """A key for every pair of blocks: the blocks' bits, and which blocks they are."""
    pairs = list(combinations(range(BLOCKS), BLOCKS - MAX_BITS))
    part = [F.shiftrightunsigned(fp, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for k in range(BLOCKS)]
    return F.array(*[F.lit(n).cast("bigint") + 8 * (part[a] + (1 << BLOCK_BITS) * part[b]) for n, (a, b) in enumerate(pairs)])


def links(classes: DataFrame) -> DataFrame:
    """(u, v) that connect all classes (node, fp) which differ in at most MAX_BITS bits."""
    keyed = classes.select("node", "fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.hint("merge").join(sizes.hint("merge"), "key")
    inside = Window.partitionBy("key").orderBy("fp")
    later = F.array(*[F.struct(F.lead("node", k).over(inside).alias("v"), F.lead("fp", k).over(inside).alias("fp2")) for k in range(1, SMALL_BUCKET)])
    small = shared.where(F.col("n") <= SMALL_BUCKET).select("node", "fp", later.alias("later"))
    candidates = small.select("node", "fp", F.explode("later").alias("other"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other.fp2"))) <= MAX_BITS
    verified = candidates.where(F.col("other.v").isNotNull() & near).select(F.col("node").alias("u"), F.col("other.v").alias("v"))
    # large buckets: classes meet at the points within one bit of both
    crowded = shared.where(F.col("n") > SMALL_BUCKET).select("node", "fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(np.int64(np.uint64(1 << k)).item()).cast("bigint") for k in range(64)])
    points = crowded.select("node", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    around = Window.partitionBy("point")
    met = points.withColumn("v", F.min("node").over(around)).where("node <> v").select(F.col("node").alias("u"), "v")
    return verified.unionByName(met)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links of at most MAX_BITS bits."""
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"))
    classes = checkpointed(classes)
    reached = classes.join(components(links(classes)), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return (
        rows.hint("merge")
        .join(reached.hint("merge"), "fp", "left")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    )


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two sets with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(n_texts: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a block, blocks): about one unrelated text to every two blocks, and pairs found with ``recall``."""
    bits = max(8, math.ceil(math.log2(max(2, n_texts))) + 1)
    hit = (1 - differing_share(similarity)) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def fingerprint_bits(bits: int, blocks: int) -> int:
    return 8 * -(-max(VERIFY_BITS, bits * blocks) // 8)


#: Values of a hash's byte, times its bytes: a text's shingles are counted in so many places before they are projected.
PLACES = 8 * 256
PROJECTED_TOGETHER = 256


def projection(bits: int, seed: int = SEED) -> np.ndarray:
    """Random vectors, one for each byte value at each place in a hash; a shingle's vector is the sum of its eight."""
    drawn = np.random.default_rng(seed).standard_normal((8, 256, bits)).astype(np.float32)
    return (drawn - drawn.mean(axis=1, keepdims=True)).reshape(PLACES, bits)


def wide_fingerprints(docs: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS) -> DataFrame:
    """doc_id and fp (packed bits): the signs of the sums of the distinct shingles' random vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, lane = projection(bits), np.arange(8, dtype=np.int64) * 256
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), PROJECTED_TOGETHER):
                some = column[at : at + PROJECTED_TOGETHER]
                counts = np.zeros((len(some), PLACES), dtype=np.float32)
                for k, text in enumerate(some):
                    h = np.unique(np.ascontiguousarray(shingle_hashes(text.as_py(), words)).view(np.uint64)).view(np.uint8).reshape(-1, 8)
                    for step in range(0, len(h), STEP):
                        counts[k] += np.bincount((h[step : step + STEP] + lane).ravel(), minlength=PLACES)
                packed = np.packbits(counts @ vectors > 0, axis=1, bitorder="little")
                yield from record_batches(list(zip(ids[at : at + len(some)], [p.tobytes() for p in packed])), "doc_id long, fp binary")

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp binary")


#: The first bits of a fingerprint, in 64-bit words: they travel with each key and part nearly all candidates.
CHECK_WORDS = 4
CHECKS = [f"check{k}" for k in range(CHECK_WORDS)]
#: How many standard deviations beyond the limit those bits may lie: a close pair is lost once in some 30,000 times.
ROUGH = 4.0


def most_bits(n: int, similarity: float, widths: float) -> float:
    """Bits of ``n`` that a pair of this similarity differs in, ``widths`` standard deviations above the mean."""
    share = differing_share(similarity)
    return n * share + widths * math.sqrt(n * share * (1 - share))


def keyed_classes(classes: DataFrame, bits: int, blocks: int, checks: int = CHECK_WORDS) -> DataFrame:
    """(key, node, tie, and the first ``checks`` words) for each block of the classes (node, fp, tie)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(blocks, dtype=np.uint64)
        powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            nodes, ties = batch.column("node").to_numpy(zero_copy_only=False), batch.column("tie")
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
            for at in range(0, len(nodes), 1024):
                flat = np.unpackbits(fps[at : at + 1024], axis=1, bitorder="little")
                words = np.packbits(flat[:, : 64 * checks], axis=1, bitorder="little").view(np.int64).reshape(len(flat), -1)
                keys = (flat[:, : bits * blocks].reshape(-1, blocks, bits).astype(np.uint64) * powers).sum(axis=2, dtype=np.uint64) * np.uint64(blocks) + place
                row = np.repeat(np.arange(len(flat)), blocks)
                columns = [keys.view(np.int64).ravel(), nodes[at : at + 1024][row], *[words[:, k][row] for k in range(checks)]]
                tie = ties[at : at + 1024].take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, type=pa.int64()) for c in columns], tie], names=["key", "node", *CHECKS[:checks], "tie"])

    return classes.select("node", "fp", "tie").mapInArrow(cut, ", ".join(f"{c} long" for c in ("key", "node", *CHECKS[:checks], "tie")))


def candidate_pairs(classes: DataFrame, bits: int, blocks: int, neighbours: int, similarity: float) -> DataFrame:
    """(u, v) of classes (node, fp, tie) that share a block and whose first bits don't part them; not those that are tied already."""
    keyed = keyed_classes(classes, bits, blocks)
    inside = Window.partitionBy("key").orderBy("node")
    carried = ("node", *CHECKS, "tie")
    later = F.array(*[F.struct(*[F.lead(c, k).over(inside).alias(c) for c in carried]) for k in range(1, neighbours + 1)])
    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o.{c}"))) for c in CHECKS), F.lit(0))
    rough = differing <= math.floor(most_bits(64 * CHECK_WORDS, similarity, ROUGH))
    open_pair = F.col("o.node").isNotNull() & F.coalesce(F.col("tie") != F.col("o.tie"), F.lit(True))
    beside = keyed.select(*carried, later.alias("later")).select(*carried, F.explode("later").alias("o"))
    return beside.where(open_pair & rough).select(F.col("node").alias("u"), F.col("o.node").alias("v")).distinct()


def open_pairs(ties: np.ndarray, fps: np.ndarray, apart: np.ndarray, limits: list[tuple[int, float]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows sorted by tie, of different ties, whose words of ``fps`` differ in no more bits than ``limits`` (words, bits) allow.

    ``apart`` numbers the one or two blocks that the rows are of; where there are two, only pairs across them are given.
    """
    ends = np.searchsorted(ties, ties, side="right")
    two = apart.min() != apart.max()
    first, most = limits[0]
    at = 0
    while at < len(ties):
        # a chunk within one tie starts behind that tie, so that a large group isn't compared with itself
        to = min(at + COMPARED_TOGETHER, max(ends[at], at + 1) if ends[at] - at >= COMPARED_TOGETHER else len(ties))
        begin = ends[at] if ends[at] >= to else at
        if begin < len(ties):
            d = np.zeros((to - at, len(ties) - begin), dtype=np.uint16)
            for w in range(first):
                d += np.bitwise_count(fps[at:to, w, None] ^ fps[None, begin:, w])
            near = (d <= most) & (ties[at:to, None] < ties[None, begin:])
            if two:
                near &= apart[at:to, None] != apart[None, begin:]
            left, right = np.nonzero(near)
            for some in range(0, len(left), STEP):
                i, j = left[some : some + STEP] + at, right[some : some + STEP] + begin
                for words, bits in limits[1:]:
                    keep = np.bitwise_count(fps[i, :words] ^ fps[j, :words]).sum(axis=1, dtype=np.int64) <= bits
                    i, j = i[keep], j[keep]
                yield i, j
        at = to


def crowded_pairs(classes: DataFrame, bits: int, blocks: int, neighbours: int, similarity: float) -> DataFrame:
    """(u, v, d) of classes (node, fp, tie) not tied yet that share a block's key with more than ``neighbours`` others, and their distance.

    All pairs of such a key are compared, but those of one tie. A key's rows are cut, in the order of
    their ties, into parts of at most ``PART_ROWS``, and two parts (or one with itself) make a task.
    """
    keyed = keyed_classes(classes, bits, blocks, 0)
    key = Window.partitionBy("key")
    sized = keyed.withColumns({"n": F.count(F.lit(1)).over(key), "lo": F.min("tie").over(key), "hi": F.max("tie").over(key)})
    crowded = sized.where((F.col("n") > neighbours + 1) & (F.col("lo") < F.col("hi")))
    number = F.row_number().over(key.orderBy("tie", "node")) - 1
    rows = written(crowded.select("key", "node", "tie", F.floor(number / PART_ROWS).cast("int").alias("part")), "crowded")
    spans = rows.groupBy("key", "part").agg(F.min("tie").alias("lo"), F.max("tie").alias("hi"))
    ahead = spans.select("key", F.col("part").alias("part2"), F.col("hi").alias("hi2"))
    met = spans.join(ahead, "key").where("part <= part2 AND lo < hi2").select("key", F.col("part").alias("a"), F.col("part2").alias("b"))
    wanted = met.select("key", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("part"))
    members = rows.join(wanted, ["key", "part"]).join(classes.select("node", "fp"), "node")
    dealt = members.select("key", "a", "b", "part", "tie", "node", "fp").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "tie", "node")

    def pairs_of(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        nodes, ties, parts = (group.column(c).to_numpy() for c in ("node", "tie", "part"))
        fps = np.frombuffer(b"".join(group.column("fp").to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
        n_bits = 8 * fps.shape[1]
        fps = np.pad(fps, ((0, 0), (0, -fps.shape[1] % 8))).view(np.uint64)
        for i, j in open_pairs(ties, fps, parts, [(CHECK_WORDS, most_bits(64 * CHECK_WORDS, similarity, ROUGH)), (fps.shape[1], most_bits(n_bits, similarity, UNSURE))]):
            yield nodes[i], nodes[j], np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int32)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group goes on in the next batch

        def settled(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            named = np.stack([rows.column(c).to_numpy() for c in ("key", "a", "b")], axis=1)
            starts = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]).any(axis=1)])
            for begin, end in zip(starts, [*starts[1:], len(named) if last else None]):
                if end is None:
                    held[:] = rows.slice(begin).to_batches()
                    return
                for u, v, d in pairs_of(rows.slice(begin, end - begin)):
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u, type=pa.int64()), pa.array(v, type=pa.int64()), pa.array(d, type=pa.int32())], names=["u", "v", "d"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                same = held and all(batch.column(c)[batch.num_rows - 1] == held[0].column(c)[0] for c in ("key", "a", "b"))
                held.append(batch)
                if not same:
                    yield from settled(pa.Table.from_batches(held), False)
        if held:
            yield from settled(pa.Table.from_batches(held), True)

    return dealt.mapInArrow(compare, "u long, v long, d int").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "d").distinct()


def measured_pairs(pairs: DataFrame, classes: DataFrame, n_bits: int, similarity: float) -> DataFrame:
    """``pairs`` (u, v) with the distance d of their whole fingerprints, those left out that are too far apart."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), dtype=np.uint8) ^ np.frombuffer(b"".join(b), dtype=np.uint8)
        return pd.Series(np.bitwise_count(x).reshape(len(a), -1).sum(axis=1, dtype=np.int32))

    pairs = written(pairs, "pairs")
    paired = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = written(classes.select("node", "fp").join(paired, "node", "left_semi"), "paired")
    left, right = (wanted.select(F.col("node").alias(n), F.col("fp").alias(f)) for n, f in (("u", "a"), ("v", "b")))
    return pairs.join(left, "u").join(right, "v").select("u", "v", distance("a", "b").alias("d")).where(F.col("d") <= most_bits(n_bits, similarity, UNSURE))


def verified_pairs(measured: DataFrame, docs: DataFrame, n_bits: int, words: int, similarity: float) -> DataFrame:
    """Those of ``measured`` (u, v, d) whose texts, in ``docs``, are as similar as asked: by their distance or, near the limit, exactly."""
    near, sure = written(measured, "near"), most_bits(n_bits, similarity, -UNSURE)
    unsure = near.where(F.col("d") >= sure).select("u", "v")
    return near.where(F.col("d") < sure).select("u", "v").unionByName(exactly_similar(unsure, docs, words, similarity))


def similar_components(classes: DataFrame, docs: DataFrame, bits: int, blocks: int, words: int, similarity: float) -> DataFrame:
    """(node, component) of classes (node, fp) that links tie.

    A first pass over few blocks chains each class to the next one beside it, which already ties most of a
    large group of copies. The full pass then leaves out pairs within one of those components: their links
    could change nothing, and all pairs that would be compared are as many as the group's rows times the blocks.
    It compares a class with ``NEIGHBOURS`` others of a key, which is all of them in nearly every key; a last
    pass compares all pairs of the other keys that are not tied by then.
    """
    n_bits = fingerprint_bits(bits, blocks)
    few = min(FIRST_BLOCKS, blocks)
    chained = candidate_pairs(classes.withColumn("tie", F.lit(None).cast("long")), bits, few, 1, similarity)
    verify = lambda measured: verified_pairs(measured, docs, n_bits, words, similarity)
    tied = components(verify(measured_pairs(chained, classes, n_bits, similarity))).select("node", F.col("component").alias("tie"))
    rest = candidate_pairs(classes.join(tied, "node", "left"), bits, blocks, NEIGHBOURS, similarity)
    found = verify(measured_pairs(rest, classes, n_bits, similarity))
    known = components(found.unionByName(tied.select(F.col("node").alias("u"), F.col("tie").alias("v"))))
    reached = classes.join(known, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("tie"))
    more = verify(crowded_pairs(reached, bits, blocks, NEIGHBOURS, similarity))
    return components(more.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def exactly_similar(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of ids whose texts, in ``docs`` (doc_id, text), have sets of shingles as similar as asked."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> bool:
            p, q = (np.unique(np.ascontiguousarray(shingle_hashes(t, words)).view(np.uint64)) for t in (x, y))
            shared = len(np.intersect1d(p, q, assume_unique=True))
            return shared >= similarity * (len(p) + len(q) - shared)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    wanted = written(docs.join(ids, "doc_id", "left_semi"), "compared")
    both = pairs.join(wanted.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").join(wanted.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
    return both.where(similar("a", "b")).select("u", "v")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """The rows of ``docs`` without those that a chain of similar texts ties to a row with a smaller id; same columns.

    Rows that repeat an id stand or fall together; rows without id stay.
    """
    bits, blocks = layout(docs.count(), similarity, recall)
    made = wide_fingerprints(docs, fingerprint_bits(bits, blocks), id_col, text_col, words).where("doc_id IS NOT NULL")
    rows = written(made.withColumn("fp_key", F.unhex(F.md5("fp"))), "fingerprints")  # a short key joins in place of some hundred bytes
    classes = checkpointed(rows.groupBy("fp_key", "fp").agg(F.min("doc_id").alias("node")))
    tied = similar_components(classes, texts(docs, id_col, text_col), bits, blocks, words, similarity).where("node <> component").select("node")
    # rows that are not their class's least id, and classes that are not their component's
    of_class = rows.select("doc_id", "fp_key").hint("merge").join(classes.select("fp_key", "node").hint("merge"), "fp_key").select("doc_id", "node")
    losers = of_class.where("doc_id <> node").select("doc_id").unionByName(
        of_class.where("doc_id = node").select("doc_id").join(tied, F.col("doc_id") == F.col("node"), "left_semi")
    )
    gone = losers.select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
