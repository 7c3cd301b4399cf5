"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Each text is a weighted set of five-word shingles, weight (1 + ln tf) * idf. A
consistent weighted sample of such a set equals another set's with a probability
of their weighted Jaccard similarity; bands of samples are the keys under which
candidates meet. Every candidate is verified by the weighted Jaccard similarity
of the whole texts.

Texts that meet under a key are not compared in pairs. Equal texts are one node.
The member that meets most others leads its key, all members are verified
against it, and links make components. Only where members of one leader are
still in different components are those outside the largest one compared with
the others, in blocks, and only as far as the triangle inequality of the Jaccard
distance allows a link. So nothing that the candidates hold is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import HASH_BASE, arrow_rows, durable, fresh, release_memory, shingle_hashes, slices, splitmix, table, word_hashes
from folioquery.llm.components import components, small

WIDTH = 5
SIMILARITY = 0.8
#: Bands of rows samples each: two texts at similarity 0.8 share a band with probability 1 - (1 - 0.8**4)**12 = 0.998.
BANDS, ROWS = 12, 4
#: Shingles are counted in so many counters (1 MB): the size of what is collected and broadcast is fixed.
COUNTERS = 1 << 18
#: The idf runs from 1 for a shingle of all documents to 1 + STRENGTH for one of a share of at most FLOOR, on a logarithmic scale.
STRENGTH, FLOOR = 0.25, 0.002
#: The gamma distribution is drawn from so many quantiles.
QUANTILES = 1 << 16
SEED = 20011
#: Shingles whose draws are held at once.
_ROWS_AT_ONCE = 256
#: Texts of a block that is compared at once.
BLOCK = 128
_BIN = 0.02


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def document_frequencies(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Counts of documents by counter, and the number of documents, over the whole table.

    Each task sums its own documents; the counters are then summed in a shuffle
    of at most COUNTERS rows a task, and COUNTERS rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS + 1, np.int64)
        for batch in slices(batches):
            shingles, offsets = shingle_hashes(*word_hashes(batch.column(0)), width)
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(offsets))
            once = np.unique(row * COUNTERS + _counter(shingles))
            total[:COUNTERS] += np.bincount(once % COUNTERS, minlength=COUNTERS)
            total[COUNTERS] += batch.num_rows
        seen = np.flatnonzero(total)
        for a in range(0, len(seen), 100_000):
            part = seen[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["counter", "n"])

    rows = arrow_rows(docs).select(F.col("text").cast("string")).mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS + 1, np.int64)
    out[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return out[:COUNTERS], int(out[COUNTERS])


def idf_table(counts: np.ndarray, documents: int) -> np.ndarray:
    """idf by counter; colliding shingles add up, so a share is too large by about shingles per document / COUNTERS at most."""
    share = np.clip(counts / max(1, documents), FLOOR, 1.0)
    return (1.0 + STRENGTH * np.log(1.0 / share) / np.log(1.0 / FLOOR)).astype(np.float32)


def weighted(column: pa.Array, idf: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of the distinct shingles of each text, sorted by row and shingle."""
    shingles, offsets = shingle_hashes(*word_hashes(column), width)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    order = np.lexsort((shingles, row))
    shingles, row = shingles[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])
    at = np.flatnonzero(first)
    tf = np.diff(np.append(at, len(row)))
    return row[at], shingles[at], (1.0 + np.log(tf)).astype(np.float32) * idf[_counter(shingles[at])]


_GAMMA: list[np.ndarray] = []


def _gamma() -> list[np.ndarray]:
    """Quantiles of Gamma(2, 1), their inverses and logarithms; by bisection of its distribution 1 - (1 + x) exp(-x)."""
    if not _GAMMA:
        share = (np.arange(QUANTILES) + 0.5) / QUANTILES
        low, high = np.zeros(QUANTILES), np.full(QUANTILES, 60.0)
        for _ in range(60):
            middle = (low + high) / 2
            below = 1 - (1 + middle) * np.exp(-middle) < share
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        _GAMMA.extend([high.astype(np.float32), (1 / high).astype(np.float32), np.log(high).astype(np.float32)])
    return _GAMMA


def weighted_samples(rows: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int, samples: int) -> np.ndarray:
    """Hashes of the consistent weighted samples, (n, samples); rows without shingles are zero.

    The draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) of a shingle for a sample come
    from the bits of a hash of both, so each shingle has its own. With t =
    floor(ln w / r + beta) the sample is the shingle of the least ln c - r * (t -
    beta + 1), together with its t.
    """
    r, inverse, log_c = _gamma()
    seeds = splitmix((np.arange(1, samples + 1, dtype=np.uint64) + np.uint64(SEED)) * HASH_BASE)
    out = np.zeros((n, samples), np.uint64)
    bounds = np.searchsorted(rows, np.arange(n + 1))
    log_w, columns = np.log(weights).astype(np.float32), np.arange(samples)
    for k in range(n):
        best = None
        for a in range(bounds[k], bounds[k + 1], _ROWS_AT_ONCE):
            part = slice(a, min(a + _ROWS_AT_ONCE, bounds[k + 1]))
            mine = shingles[part]
            mixed = mine[:, None] ^ seeds
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            bits = mixed.view("<u2").reshape(len(mine), samples, 4)
            for_r, for_c = bits[:, :, 3], bits[:, :, 2]
            beta = mixed.view("<u4").reshape(len(mine), samples, 2)[:, :, 0].astype(np.float32) * np.float32(2**-32)
            steps = inverse[for_r]
            steps *= log_w[part, None]
            steps += beta
            np.floor(steps, out=steps)
            value = steps - beta
            value += np.float32(1)
            value *= r[for_r]
            np.subtract(log_c[for_c], value, out=value)
            at = value.argmin(axis=0)
            found = (value[at, columns], mine[at], steps[at, columns])
            if best is None:
                best = found
            else:
                less = found[0] < best[0]
                best = tuple(np.where(less, x, y) for x, y in zip(found, best, strict=True))
        if best is not None:
            out[k] = splitmix(best[1] ^ (best[2].astype(np.int64).astype(np.uint64) * HASH_BASE))
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys of bands of samples."""
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(samples), 1))
    for k in range(rows):
        out = splitmix(out * HASH_BASE + samples.reshape(len(samples), bands, rows)[:, :, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, keys) of every row: the hash of its text and its band keys (none for a text without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            row, shingles, weights = weighted(batch.column(2), shared.value, width)
            n = batch.num_rows
            keys = band_keys(weighted_samples(row, shingles, weights, n, bands * rows), bands, rows)
            some = np.bincount(row, minlength=n) > 0
            offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "node", "keys"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return arrow_rows(docs).select("doc_id", F.xxhash64(text).alias("node"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, node long, keys array<long>")


def similarities(left: list[np.ndarray], left_w: list[np.ndarray], right: list[np.ndarray], right_w: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarities of two lists of texts (sorted shingles and weights)."""
    all_s = np.concatenate(right) if right else np.zeros(0, np.uint64)
    all_w = np.concatenate(right_w) if right else np.zeros(0, np.float32)
    of = np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(all_s, kind="stable")
    all_s, all_w, of = all_s[order], all_w[order].astype(np.float64), of[order]
    sums = np.array([w.sum(dtype=np.float64) for w in right_w])
    out = np.zeros((len(left), len(right)))
    for k, (s, w) in enumerate(zip(left, left_w, strict=True)):
        low, high = np.searchsorted(all_s, s, "left"), np.searchsorted(all_s, s, "right")
        n = high - low
        spots = np.repeat(low, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        shared = np.bincount(of[spots], weights=np.minimum(all_w[spots], np.repeat(w.astype(np.float64), n)), minlength=len(right))
        out[k] = shared / np.maximum(w.sum(dtype=np.float64) + sums - shared, 1e-12)
    return out


def _vectors(texts: pa.Array, idf: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    row, shingles, weights = weighted(texts, idf, width)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    return [shingles[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], [weights[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _compare(cells: DataFrame, keys: list[str], idf: np.ndarray, width: int, threshold: float, every: bool) -> DataFrame:
    """Compare the left with the right texts of each cell; a cell holds at most about 2 * BLOCK texts.

    ``every``: a row for each pair of the first left text with a right one, whatever the
    similarity. Otherwise, for each left text, its best link into each component but its own.
    """
    shared = cells.sparkSession.sparkContext.broadcast(idf)

    def run(cell: pa.Table) -> pa.Table:
        side = cell.column("side").to_numpy()
        text = cell.column("text").combine_chunks()
        node, component, dist = (cell.column(c).to_numpy() for c in ("node", "component", "dist"))
        li, ri = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a: list = []
        b: list = []
        sim: list = []
        if len(li) and len(ri):
            left, right = _vectors(text.take(pa.array(li)), shared.value, width), _vectors(text.take(pa.array(ri)), shared.value, width)
            for k, i in enumerate(li):
                able = np.arange(len(ri)) if every else np.flatnonzero((component[ri] != component[i]) & (np.abs(dist[ri] - dist[i]) <= 1 - threshold + 1e-6))
                if not len(able):
                    continue
                s = similarities(left[0][k : k + 1], left[1][k : k + 1], [right[0][j] for j in able], [right[1][j] for j in able])[0]
                if not every:
                    hit = np.flatnonzero(s >= threshold)
                    hit = hit[np.argsort(-s[hit], kind="stable")]
                    hit = hit[np.sort(np.unique(component[ri[able[hit]]], return_index=True)[1])]
                    able, s = able[hit], s[hit]
                a += [node[i]] * len(able)
                b += node[ri[able]].tolist()
                sim += s.tolist()
            del left, right
        release_memory()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float64())})

    return cells.groupBy(*keys).applyInArrow(run, "a long, b long, sim double")


def _spread(node: Column, n: Column) -> Column:
    """A block number below n for a node."""
    return F.pmod(F.xxhash64(node, F.lit(5)), n)


def near_links(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, keys) of all rows, and links (a, b) between nodes that join them to components."""
    counts, n_docs = document_frequencies(docs, width)
    idf = idf_table(counts, n_docs)
    signed = durable(signatures(docs, idf, bands, rows, width))
    nodes = signed.groupBy("node").agg(F.any_value("keys").alias("keys"))
    member = nodes.select("node", F.explode("keys").alias("key"))
    # sums over a key are durable before they are joined to its rows: a join of its own can split a hot key
    sizes = durable(member.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = durable(member.join(sizes, "key"))
    # the member that meets most others leads its key
    weight = durable(met.groupBy("node").agg(F.sum("size").alias("weight")))
    n_nodes = weight.count()
    led = met.join(weight, "node")
    leaders = durable(led.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("leader")))
    groups = durable(met.join(leaders, "key").select("leader", "node").where("leader <> node").distinct())

    texts = (
        docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("node", F.xxhash64("text"))
        .join(small(weight.select("node"), n_nodes), "node", "left_semi")
        .groupBy("node")
        .agg(F.any_value("text").alias("text"))
    )
    texts = durable(texts)

    # each leader against blocks of its members
    blocks = durable(groups.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")))
    right = groups.join(blocks, "leader").select("leader", _spread(F.col("node"), F.col("blocks")).alias("block"), "node", F.lit(1).alias("side"))
    left = blocks.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("node"), F.lit(0).alias("side"))
    nothing = [F.lit(0).cast("long").alias("component"), F.lit(0.0).alias("dist")]
    cells = left.unionByName(right).join(texts, "node").select("leader", "block", "side", "node", *nothing, "text")
    star = durable(_compare(cells, ["leader", "block"], idf, width, similarity, True))
    links = star.where(F.col("sim") >= similarity).select("a", "b")

    # leaders whose members are in several components
    found = components(links)
    around = star.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("sim")).alias("dist"))
    around = around.unionByName(blocks.select("leader", F.col("leader").alias("node"), F.lit(0.0).alias("dist")))
    placed = durable(around.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    by_component = placed.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("n"))
    main = by_component.groupBy("leader").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = durable(main.select("leader", F.col("m.component").alias("main")))
    bins = placed.join(main, "leader").withColumn("bin", F.floor(F.col("dist") / _BIN).cast("int")).withColumn("other", F.col("component") != F.col("main"))
    bins = durable(bins.select("leader", "node", "component", "dist", "bin", "other"))
    counted = bins.groupBy("leader", "other", "bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    counted = durable(counted)
    blocked = bins.join(counted, ["leader", "other", "bin"]).withColumn("block", _spread(F.col("node"), F.col("blocks")))
    # cells of two blocks whose distances to the leader allow a link; a pair of two others is compared once
    parts = counted.select("leader", "other", "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    one, two = parts.where("other"), parts
    reach = int(np.ceil((1 - similarity) / _BIN)) + 1
    pair = one.select("leader", *[F.col(c).alias(f"x_{c}") for c in ("other", "bin", "block")]).join(
        two.select("leader", *[F.col(c).alias(f"y_{c}") for c in ("other", "bin", "block")]), "leader"
    )
    pair = pair.where((F.abs(F.col("x_bin") - F.col("y_bin")) <= reach) & (~F.col("y_other") | (F.struct("x_bin", "x_block") <= F.struct("y_bin", "y_block"))))
    pair = pair.withColumn("cell", F.xxhash64("leader", "x_bin", "x_block", "y_other", "y_bin", "y_block"))
    spots = pair.select("leader", "cell", F.lit(0).alias("side"), *[F.col(f"x_{c}").alias(c) for c in ("other", "bin", "block")]).unionByName(
        pair.select("leader", "cell", F.lit(1).alias("side"), *[F.col(f"y_{c}").alias(c) for c in ("other", "bin", "block")])
    )
    rest = blocked.join(durable(spots), ["leader", "other", "bin", "block"]).join(texts, "node")
    rest = rest.select("leader", "cell", "side", "node", "component", "dist", "text")
    more = _compare(rest, ["leader", "cell"], idf, width, similarity, False).select("a", "b")
    return signed, links.unionByName(more)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, class_id, class_size) of every row: its text's hash, its near-duplicate class and the class's rows.

    The class id is the least doc_id of the class, of which a null one comes
    last. Equal texts are in one class; null texts count as empty, and texts
    without words are alike only if they are equal. Texts of fewer than
    ``width`` words have one shingle. Rows may repeat, each is returned; an empty
    table gives no rows. Further columns aren't read. Nodes are 64-bit hashes.
    """
    signed, links = near_links(docs, similarity, bands, rows, width)
    found = components(links)
    labelled = signed.select("doc_id", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = durable(labelled)
    names = labelled.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    joined = labelled.join(durable(names.where("class_size > 1")), "component", "left")
    return joined.select("doc_id", "node", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each near-duplicate class: the one with the least doc_id, of several such the one with the least hash of its text.

    Rows that are equal in id and text are one. Null texts count as empty, null
    ids come last, an empty table gives no rows. The columns stay as they are,
    whatever the names of further ones.
    """
    doc, hashed = fresh(docs.columns, "_id", "_node")
    classes = near_classes(docs, similarity).where("class_size > 1")
    classes = durable(classes)
    keepers = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))).alias("k"))
    keepers = keepers.select(F.col("class_id").alias("kept"), F.col("k.doc_id").alias("kept_doc"), F.col("k.node").alias("kept_node"))
    of = classes.select("doc_id", "node", "class_id").distinct().join(keepers, F.col("class_id").eqNullSafe(F.col("kept")))
    dropped = of.where(~(F.col("doc_id").eqNullSafe(F.col("kept_doc")) & (F.col("node") == F.col("kept_node"))))
    dropped = durable(dropped.select(F.col("doc_id").alias(doc), F.col("node").alias(hashed)))
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))

    def same() -> Column:
        return F.col("doc_id").eqNullSafe(F.col(doc)) & (text_hash == F.col(hashed))

    kept = docs.join(small(dropped, dropped.count()), same(), "left_anti")
    again = durable(classes.groupBy(F.col("doc_id").alias(doc), F.col("node").alias(hashed)).count().where("count > 1").drop("count"))
    n_again = again.count()
    if not n_again:
        return kept
    once = kept.join(small(again, n_again), same(), "left_anti")
    repeated = kept.join(small(again, n_again), same(), "left_semi").withColumn(hashed, text_hash)
    return once.unionByName(repeated.dropDuplicates(["doc_id", hashed]).drop(hashed))


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
