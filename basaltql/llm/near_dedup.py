"""Near-duplicate documents: SetSketch registers, banded, joint likelihood, then verification on full shingle sets.

A SetSketch register is the minimum of exponentially distributed hash values on an exponential scale, truncated to 16
bits: floor(1 - log_B(min / A)). Registers merge by maximum, and two registers are equal with a probability close to the
Jaccard similarity. ROWS registers make a band; documents that share a band are candidates. Of a band's documents each is
first held against one hub, the one with the smallest id, which links large groups of copies by a star and never by all
pairs. Components of these links leave some bands whose documents lie in different components; only there, blocks of a
band are compared with each other: a pair is dropped if its own shingles, those that no other document there has, already
rule the similarity out, or if the likelihood of the joint registers does. Documents with a partner left meet once more
with their full sets, and a meeting gives a spanning forest of its links, never all pairs. Every link that counts is
confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .spark_tools import HOT_KEYS, HOT_ROWS, bounded_batches, gathered, hot_keys, keyed, looked_up, partitions_for, read, slices, written
from .text_arrays import U, grams, mix, span_hash, words_of

SHINGLE_WORDS, PERCENT = 5, 75
#: Chance to miss a pair at similarity 0.75: (1 - 0.75**5)**48, about 2e-6.
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
#: Base, rate and limit of the registers' exponential scale.
B, A, LIMIT = 1.001, 20.0, 65534
#: Pairs whose most likely similarity is below can't have 0.75: four standard deviations of so many registers.
LIKELY = 0.75 - 4 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Documents of a band in one block of the pairwise step.
BLOCK = 512
#: Bytes of shingles that a task holds.
BUCKET_BYTES = 16 << 20
MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)
BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=U) * U(0xE7037ED1A0B428DB))
SKETCH = "doc_id long, node long, n_shingles long, set_high long, set_low long, registers binary, bands array<long>"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the sorted distinct shingle hashes of each text. Fewer than five words: the whole sequence."""
    words = words_of(texts, lower=True)
    sums = words.sums()
    hashes, _, counts = grams(words, SHINGLE_WORDS, sums)
    ends = np.cumsum(counts)
    sets = []
    for n, end, lo, hi in zip(counts.tolist(), ends.tolist(), words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if n:
            sets.append(np.unique(hashes[end - n : end]))
        elif hi > lo:
            sets.append(mix(span_hash(sums, np.array([lo]), np.array([hi])) + U(hi - lo)))
        else:
            sets.append(np.zeros(0, U))
    bounds = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    return np.concatenate(sets) if sets else np.zeros(0, U), bounds


def set_sketch(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """REGISTERS registers (uint16) for each set; an empty set has zeros."""
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        heads = bounds[:-1][full]
        least = np.stack([np.minimum.reduceat(values * m, heads) for m in MULTIPLIERS], 1)
        exponential = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53))
        out[full] = np.clip(np.floor(1 - np.log(exponential / A) / np.log(B)), 0, LIMIT)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union of sets."""
    return np.maximum(a, b)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    parts = registers.astype(U).reshape(len(registers), BANDS, ROWS)
    value = np.zeros(parts.shape[:2], U)
    for j in range(ROWS):
        value = mix(value * U(0x100000001B3) + parts[:, :, j] + U(1))
    return mix(value ^ BAND_SALT)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 60) -> np.ndarray:
    """The most likely Jaccard similarity of each pair, from how many registers are larger, smaller and equal.

    With u and v the cardinalities' shares and p(x) = -log_B(1 - x (B - 1) / B): a register is larger in a with the chance
    p(u - v J) and larger in b with p(v - u J)."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = REGISTERS - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0, 1, grid + 1)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return np.take_along_axis(j, (above * log(up) + below * log(down) + equal * log(1 - up - down)).argmax(1)[:, None], 1)[:, 0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, "text", 2 << 20):
        values, bounds = shingle_sets(batch.column("text"))
        registers = set_sketch(values, bounds)
        sizes = np.diff(bounds)
        full = sizes > 0
        high, low = np.zeros(len(sizes), U), np.zeros(len(sizes), U)
        if len(values):
            heads = bounds[:-1][full]
            high[full] = np.add.reduceat(mix(values + U(1)), heads)
            low[full] = np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), heads)
        bands = band_hashes(registers)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), _signed(bands[full].reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(sizes), _signed(high), _signed(low), pa.array([r.tobytes() for r in registers], pa.binary()), lists], ["doc_id", "node", "n_shingles", "set_high", "set_low", "registers", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, "text", 2 << 20):
        values, bounds = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([values[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["node", "shingles"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("registers_a", "registers_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = (100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)) & (likely_similarity(a, b, n_a, n_b) >= LIKELY)
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the documents of one block, or of two blocks of a band, those with a likely partner of another component there: a
    row for each document, never one for each pair."""
    for batch in slices(batches, "block_registers", 8 << 20):
        for row in batch.to_pylist():
            registers = np.frombuffer(row["block_registers"], np.uint16).reshape(-1, REGISTERS)
            node, label, n, own, side = (np.array(row[c]) for c in ("nodes", "labels", "sizes", "owns", "sides"))
            #: A pair that shares several bands is looked at in the first of them.
            bands = band_hashes(registers)
            here = int((bands[0] == np.int64(row["band"]).astype(U)).argmax())
            left = np.flatnonzero(side != 1)
            right = np.flatnonzero(side != 0)
            paired = np.zeros(len(node), bool)
            for i in left.tolist():
                j = right[(label[right] != label[i]) & ((node[right] > node[i]) if row["x"] == row["y"] else True)]
                j = j[(bands[j] == bands[i]).argmax(1) == here]
                #: Shingles of one document only can't be common to two.
                common = np.minimum(n[j] - own[j], n[i] - own[i])
                j = j[100 * common >= PERCENT * (n[j] + n[i] - common)]
                if len(j):
                    j = j[(registers[j] == registers[i]).sum(1) >= REGISTERS * (LIKELY - 0.05)]
                if len(j):
                    a = np.broadcast_to(registers[i], (len(j), REGISTERS))
                    j = j[likely_similarity(a, registers[j], np.full(len(j), float(n[i])), n[j].astype(float)) >= LIKELY]
                    paired[j] = True
                    paired[i] |= len(j) > 0
            #: Rows with one doc_id are one node here.
            out = np.flatnonzero(paired)[np.unique(node[paired], return_index=True)[1]]
            if len(out):
                meeting = [pa.array([row[c]] * len(out), t) for c, t in (("band", pa.int64()), ("x", pa.int32()), ("y", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*meeting, pa.array(side[out].astype(np.int32)), pa.array(node[out]), pa.array(label[out])], ["band", "x", "y", "side", "node", "label"])


def forest(node: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of all links (a, b) between the left documents (side not 1) and the right ones (side not 0): a link
    between documents that labels or earlier links have joined is left out, so links are fewer than labels."""
    sizes, root = np.array([len(x) for x in sets]), label.copy()
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    terms = np.split(place, np.cumsum(sizes)[:-1])
    right = np.flatnonzero(side != 0)
    if not len(right):
        return []
    there, heads = np.concatenate([terms[j] for j in right.tolist()]), np.cumsum(sizes[right]) - sizes[right]
    here, links = np.zeros(len(values), np.int32), []
    for i in np.flatnonzero(side != 1).tolist():
        other = root[right] != root[i]
        if other.any():
            here[terms[i]] = 1
            common = np.add.reduceat(here[there], heads)
            here[terms[i]] = 0
            near = right[other & (100 * common >= PERCENT * (sizes[right] + sizes[i] - common))]
            roots, first = np.unique(root[near], return_index=True)
            links += [(min(x, int(node[i])), max(x, int(node[i]))) for x in node[near[first]].tolist()]
            root[np.isin(root, roots)] = root[i]
    return links


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of each meeting (band, x, y) from its documents' full sets. Rows of a meeting follow each other, and only
    those of one meeting are held."""

    def links_of(rows: list[dict]) -> pa.RecordBatch:
        links = forest(*(np.array([r[c] for r in rows]) for c in ("node", "label", "side")), [np.frombuffer(r["shingles"], U) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["band"], row["x"], row["y"]) != now:
                yield links_of(held)
                held = []
            now = (row["band"], row["x"], row["y"])
            held.append(row)
    if held:
        yield links_of(held)


def _shared_out(buckets: int):
    """Each set's shingles by bucket: the nodes, how many shingles each has here, and those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles", 8 << 20):
            sets = [np.frombuffer(x, U) for x in batch.column("shingles").to_pylist()]
            if not sets:
                continue
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            bucket = (mix(values) % U(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            values, owner, cuts = values[order], owner[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            node, rows = batch.column("node").to_numpy(), []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                here, counts = np.unique(owner[cuts[b] : cuts[b + 1]], return_counts=True)
                rows.append((b, node[here].tobytes(), counts.astype(np.int64).tobytes(), values[cuts[b] : cuts[b + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "nodes", "counts", "shingles"])

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a partition's buckets each node has alone."""
    held = [[np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, U), strict=True)] for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("nodes", "counts", "shingles")), strict=True)]
    if held:
        nodes, counts, values = (np.concatenate(c) for c in zip(*held, strict=True))
        owner = np.repeat(nodes, counts)
        _, first, often = np.unique(values, return_index=True, return_counts=True)
        node, own = np.unique(owner[first[often == 1]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(own.astype(np.int64))], ["node", "own"])


def own_shingles(sets: DataFrame, buckets: int) -> DataFrame:
    """(node, own): how many shingles of each of the sets (node, shingles) no other one has; nodes with none are left out.
    A task holds the shingles of one bucket."""
    parts = sets.mapInArrow(_shared_out(buckets), "bucket int, nodes binary, counts binary, shingles binary").repartition(buckets, "bucket")
    return parts.mapInArrow(_own, "node long, own long").groupBy("node").agg(F.sum("own").alias("own"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs (doc_id, text and any others).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set is a text's distinct 5-word shingles, or its whole
    sequence where it has fewer words; documents with 100 * intersection >= 75 * union are linked. Null or empty texts
    have n_shingles 0 and are linked with nothing. Rows with one doc_id count as one document. A null doc_id takes part in
    links, and its component_id is the smallest doc_id of its component or null; kept is true where doc_id equals
    component_id or both are null. An empty table gives no rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = keyed(docs).select("doc_id", F.coalesce("doc_id", "text_hash").alias("node"), "text")
    sketches = written(texts.mapInArrow(_sketches, SKETCH), "sketches")
    content = ["n_shingles", "set_high", "set_low"]
    #: One row for each different set: copies meet here, reduced before the shuffle.
    sets = written(sketches.where("n_shingles > 0").groupBy(*content).agg(F.min("node").alias("node"), F.first("registers").alias("registers"), F.first("bands").alias("bands")), "sets")
    bands = sets.select("node", F.explode("bands").alias("band"))
    hubs = written(bands.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"), "hubs")
    #: Bands of very many documents, HOT_KEYS at most.
    wide = [r[0] for r in hubs.where(F.col("members") > max(HOT_ROWS, sets.count() * BANDS // HOT_KEYS)).select(F.xxhash64("band")).collect()]
    star = looked_up(bands, hubs.select("band", "hub"), ["band"], wide).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    def shingles(nodes: DataFrame, name: str) -> DataFrame:
        """(node, shingles): the full sets of these nodes, from their texts. Merged at every size, so that cost grows evenly."""
        return written(texts.select("node", "text").join(nodes.hint("merge"), "node", "left_semi").mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node", "shingles"]), f"{name}-shingles")

    def confirmed(pairs: DataFrame, full: DataFrame, name: str) -> DataFrame:
        """Of candidate pairs (a, b) those that the full sets confirm."""
        side = lambda x: full.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
        out = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirmed, "a long, b long").distinct(), f"{name}-links")
        bounded_batches(spark)
        return out

    thin = sets.select("node", F.col("n_shingles").alias("n"), "registers")
    of = lambda x: thin.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}"))
    star = written(star, "star")
    #: Later candidates are members of the same bands, so these sets serve every confirmation.
    full = shingles(star.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "star")
    likely = star.join(of("a"), "a").join(of("b"), "b").mapInArrow(_likely, "a long, b long")
    links = confirmed(likely, full, "star")
    labels = components(links)
    named = sets.select("node", "bands").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "bands")
    member = named.select("node", "label", F.explode("bands").alias("band"))
    #: Bands of two are settled by their star; so are those that lie in one component.
    open_bands = member.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("members > 2 and lo <> hi").select("band", "hub", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    #: A band's hub has met all others there.
    unsettled = written(member.join(open_bands, "band").where("node <> hub").drop("hub"), "unsettled")
    alone = own_shingles(full.join(unsettled.select("node").distinct(), "node", "left_semi"), partitions_for(full, BUCKET_BYTES))
    #: A document whose own shingles alone rule out every partner needs no meeting.
    hopeful = thin.join(alone, "node", "left").fillna(0, ["own"]).where(100 * (F.col("n") - F.col("own")) >= PERCENT * F.col("n"))
    placed = unsettled.withColumn("own", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
    #: Each block meets itself and each later one: a document goes once to each meeting.
    meetings = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "node", "label", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    blocks = (
        meetings.join(hopeful, "node")
        .groupBy("band", "x", "y")
        .agg(F.sort_array(F.collect_list(F.struct("node", "label", "n", "own", "side", "registers"))).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo <> hi")
        .select("band", "x", "y", F.col("m.node").alias("nodes"), F.col("m.label").alias("labels"), F.col("m.n").alias("sizes"), F.col("m.own").alias("owns"), F.col("m.side").alias("sides"), F.expr("unhex(array_join(transform(m, r -> hex(r.registers)), ''))").alias("block_registers"))
    )
    #: In a meeting, full sets go once for each document that has a likely partner there, and links come back as a forest.
    paired = blocks.mapInArrow(_across, "band long, x int, y int, side int, node long, label long").join(full, "node")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    more = written(paired.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(_joined, "a long, b long"), "rest-links")
    bounded_batches(spark)
    if more.limit(1).count():
        labels = components(links.union(more))
    groups = sets.select(*content, "node").join(labels, "node", "left").select(*content, F.coalesce("label", "node").alias("label"))
    #: Null ids have nodes that are no ids; so the component's id is its smallest real one.
    ids = written(sketches.where("n_shingles > 0").groupBy(*content).agg(F.min("doc_id").alias("least")).join(groups, content), "ids")
    named = looked_up(ids, ids.groupBy("label").agg(F.min("least").alias("component_id")), ["label"], hot_keys(ids, ["label"])).select(*content, "component_id", F.lit(True).alias("grouped"))
    out = sketches.select("doc_id", *content).join(named, content, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
