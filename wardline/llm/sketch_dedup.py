"""Near-duplicates by fast similarity sketching, banding and exact verification.

Every document's set of word shingles is sketched: in each round all elements are hashed
to a bin and a value, later rounds have larger values, and a bin keeps its smallest. The
rounds end when every bin is filled; in the second half of the rounds each goes to a fixed
bin, so that all bins always fill. Equal bins estimate the similarity. Bands of bins
give candidate pairs, which are verified on the full sets.

Equal sets are one node, so copies cost nothing. Within a bucket of a band every node is
first compared with one leader. A bucket whose nodes are then in one component is done. In
the others the nodes outside of the bucket's largest component, its strays, are compared
with each other and with those inside. That is dealt over a grid: blocks of strays against
blocks of strays and of the rest, bounded in rows and in shingles. A task compares the
sketches of its two blocks, verifies candidates of different components on the full sets,
most similar first, and returns a spanning forest of the links it found, never pairs.

Defined results: null, empty and blank texts have no shingles and are linked with nothing,
each its own component. A row without id takes part in links; a component's id is the
smallest id in it (null if there is none) and a row is kept if its id is that. Repeated
rows are links of each other and all kept or all dropped. Columns beyond doc_id and the
text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.components import components, tasks_for
from wardline.llm.textops import LOWER, WHITE, blocks, mix, rows_at, runs, span_hashes
from wardline.plans.stages import Stages

BANDS = 28
ROWS = 6
BITS = 10
BINS = BANDS * ROWS
LINK_PERCENT = 80
#: Nodes and shingles of a block of the grid, as expected sizes.
BLOCK_NODES = 512
BLOCK_SHINGLES = 1_000_000
#: Candidates whose estimate is this many standard deviations below the limit are not verified.
DEVIATIONS = 4
PAIRS_PER_TASK = 20_000
#: Pairs of a grid cell whose sketches are compared at once.
PAIRS_AT_ONCE = 10_000
_U = np.uint64


def word_hashes(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every word, ASCII capitals lowered."""
    starts, ends = runs(~WHITE[content], offsets)
    (hashes,) = span_hashes(LOWER[content], starts, ends)
    return rows_at(offsets, starts), hashes


def shingle_hashes(row: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs, sorted; a text of fewer words is one shingle."""
    if not len(words):
        return row, words
    length = np.bincount(row)
    first = np.r_[0, np.cumsum(length)][:-1]
    key = words.copy()
    for ahead in range(1, size):
        later = np.r_[words[ahead:], np.zeros(min(ahead, len(words)), dtype=np.uint64)]
        inside = (np.arange(len(words)) + ahead) < (first + length)[row]
        key = np.where(inside, mix(key * _U(0x9E3779B97F4A7C15) + later), key)
    place = np.arange(len(words)) - first[row]
    whole = (place <= length[row] - size) | ((place == 0) & (length[row] < size))
    # a shorter text must not equal the beginning of a longer one
    key = mix(key + np.minimum(length[row], size).astype(np.uint64))[whole]
    order = np.lexsort((key, row[whole]))
    row, key = row[whole][order], key[order]
    fresh = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]
    return row[fresh], key[fresh]


def text_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Shingle sets block by block: first row, end row, and sorted (text, shingle) pairs."""
    for start, end, parts in blocks(texts, 2000):
        found = [word_hashes(content, offsets) for content, offsets in parts if len(content)]
        row = np.concatenate([np.zeros(0, dtype=np.int64), *[r for r, _ in found]])
        words = np.concatenate([np.zeros(0, dtype=np.uint64), *[w for _, w in found]])
        yield start, end, *shingle_hashes(row, words, size)


def sketch(row: np.ndarray, elements: np.ndarray, texts: int, bins: int = BINS) -> np.ndarray:
    """Bins of each text's set: the round in the upper bits, the value in the lower ones."""
    full = np.full((texts, bins), np.iinfo(np.uint64).max)
    flat = full.reshape(-1)
    counts = np.bincount(row, minlength=texts)
    open_text = counts > 0
    step = 0
    while step < 2 * bins and open_text.any():
        active = open_text[row]
        row, elements = row[active], elements[active]
        together = max(1, min(32, 300_000 // max(1, len(elements)), (bins if step < bins else 2 * bins) - step))
        for each in range(step, step + together):
            hashed = mix(elements + _U((each + 1) * 0xD1B54A32D192ED03 % 2**64))
            value = (hashed >> _U(12)) | (_U(min(each, 4095)) << _U(52))
            place = (hashed & _U(0xFFFFFFFF)) * _U(bins) >> _U(32) if each < bins else np.full(len(row), each - bins, dtype=np.uint64)
            np.minimum.at(flat, row * bins + place.astype(np.int64), value)
        step += together
        open_text &= (full == np.iinfo(np.uint64).max).any(axis=1)
    return full


def packed_bands(bins: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One long per band: a few bits of each of its bins, side by side."""
    short = mix(bins) >> _U(64 - BITS)
    packed = np.zeros((len(bins), bands), dtype=np.uint64)
    for i in range(rows):
        packed |= short[:, i::rows][:, :bands] << _U(i * BITS)
    return packed.view(np.int64)


def equal_bins(left: Column, right: Column) -> Column:
    """How many bins of two packed sketches are equal."""
    low = sum(((1 << (BITS - 1)) - 1) << (i * BITS) for i in range(ROWS))
    high = sum(1 << (i * BITS + BITS - 1) for i in range(ROWS))

    def unequal(x: Column) -> Column:
        carried = x.bitwiseAND(F.lit(low)) + F.lit(low)
        return F.bit_count(carried.bitwiseOR(x).bitwiseAND(F.lit(high)))

    different = F.zip_with(left, right, lambda x, y: unequal(x.bitwiseXOR(y)))
    return F.lit(BINS) - F.aggregate(different, F.lit(0), lambda total, n: total + n)


def first_common(left: Column, right: Column) -> Column:
    """Place of the first band that two packed sketches share, from 0; -1 if there is none."""
    return F.array_position(F.zip_with(left, right, lambda x, y: x == y), True).cast("int") - 1


def _fingerprints(row: np.ndarray, elements: np.ndarray, texts: int) -> list[bytes | None]:
    """16 bytes per set: sums of two hashes of its elements; None for an empty set."""
    sums = np.zeros((texts, 2), dtype=np.uint64)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
    if len(starts):
        for i, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
            sums[row[starts], i] = np.add.reduceat(mix(elements ^ _U(salt)), starts)
    size = np.bincount(row, minlength=texts)
    return [sums[i].tobytes() if size[i] else None for i in range(texts)]


def signed_parts(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """n, node and bands of each text, given out block by block."""
    for start, end, row, elements in text_sets(texts, size):
        listed = packed_bands(sketch(row, elements, end - start))
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(listed) + 1) * BANDS, pa.int32()), pa.array(listed.reshape(-1)))
        n = pa.array(np.bincount(row, minlength=end - start))
        node = pa.array(_fingerprints(row, elements, end - start), pa.binary())
        yield pa.StructArray.from_arrays([n, node, keys], ["n", "node", "bands"])


def set_parts(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """node and sorted set of hashes of each text, given out block by block."""
    for start, end, row, elements in text_sets(texts, size):
        node = pa.array(_fingerprints(row, elements, end - start), pa.binary())
        ends = np.searchsorted(row, np.arange(end - start + 1))
        sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(elements.view(np.int64)))
        yield pa.StructArray.from_arrays([node, sets], ["node", "shingles"])


def signatures(df: DataFrame, shingle_words: int, text: str = "text") -> DataFrame:
    """doc_id, _key, n_shingles, node (null for an empty set) and bands of each row."""

    @F.arrow_udf("struct<n: bigint, node: binary, bands: array<bigint>>")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from signed_parts(batch, shingle_words)

    whole = F.coalesce(F.col(text), F.lit(""))
    made = df.select("doc_id", F.xxhash64(whole).alias("_key"), signed(whole).alias("_s"))
    return made.select("doc_id", "_key", F.col("_s.n").alias("n_shingles"), "_s.node", "_s.bands")


def shingle_sets(df: DataFrame, shingle_words: int, text: str = "text") -> Column:
    """Column of node and sorted set of hashes of each row."""

    @F.arrow_udf("struct<node: binary, shingles: array<bigint>>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from set_parts(batch, shingle_words)

    return listed(F.coalesce(F.col(text), F.lit("")))


def _equal_bins(differ: np.ndarray) -> np.ndarray:
    """As :func:`equal_bins`, of the packed differences of many pairs."""
    low = _U(sum(((1 << (BITS - 1)) - 1) << (i * BITS) for i in range(ROWS)))
    high = _U(sum(1 << (i * BITS + BITS - 1) for i in range(ROWS)))
    unequal = (((differ & low) + low) | differ) & high
    return BINS - np.bitwise_count(unequal).sum(axis=1, dtype=np.int64)


def _leaders(rows: DataFrame) -> DataFrame:
    """One node of each bucket."""
    return rows.groupBy("band").agg(F.min("node").alias("node")).select("band", "node", F.lit(True).alias("leads"))


def links(df: DataFrame, signed: DataFrame, shingle_words: int, stages: Stages, percent: int = LINK_PERCENT, text: str = "text") -> DataFrame:
    """Labels (node, component) of the nodes that are linked with others."""
    nodes = (
        signed.where(F.col("node").isNotNull())
        .groupBy("node", "n_shingles")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("row"), F.first("bands").alias("bands"))
    )
    each = nodes.select("node", F.posexplode("bands").alias("place", "packed"))
    banded = each.select("node", "place", F.xxhash64("place", "packed").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    facts = nodes.select("node", F.col("n_shingles").alias("n"), "row", F.col("bands").alias("sketch"))
    members, found = stages.measured(banded.join(shared.select("band"), "band").join(facts, "node"), F.count(F.lit(1)))
    if not found:
        return df.sparkSession.createDataFrame([], "node binary, component binary")
    tasks = tasks_for(found)
    # the sets of nodes that share a bucket, from one row of each
    wanted = members.groupBy("node").agg(F.first("row").alias("row")).select(F.col("row.doc_id").alias("_id"), F.col("row._key").alias("_k"))
    rows = df.select("doc_id", F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    some = rows.join(wanted.distinct(), same, "left_semi").select(shingle_sets(df, shingle_words, "_text").alias("s"))
    sets = stages.write(some.select("s.*").groupBy("node").agg(F.first("shingles").alias("shingles")))
    members = members.drop("row")

    def verified(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        checked = pairs.join(a, "a").join(b, "b").withColumn("common", common)
        union = F.size("sa") + F.size("sb") - F.col("common")
        return checked.where(100 * F.col("common") >= percent * union).select("a", "b")

    def alike(left: Column, right: Column) -> Column:
        return (100 * left >= percent * right) & (100 * right >= percent * left)

    limit, bins = percent / 100, BINS
    least = bins * (limit - DEVIATIONS * (limit * (1 - limit) / bins) ** 0.5)

    def compared(rows: DataFrame) -> DataFrame:
        """Verified pairs of each bucket's leader with its other nodes; a pair belongs to the first band that both share."""
        lead = rows.where("leads").select("band", F.col("node").alias("leader"), F.col("n").alias("size"), F.col("sketch").alias("ahead"))
        meet = (
            ~F.col("leads")
            & alike(F.col("n"), F.col("size"))
            & (first_common(F.col("sketch"), F.col("ahead")) == F.col("place"))
            & (equal_bins(F.col("sketch"), F.col("ahead")) >= least)
        )
        apart = rows.join(lead, "band").where(meet)
        pairs = apart.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        pairs, count = stages.measured(pairs.coalesce(tasks), F.count(F.lit(1)))
        return verified(pairs).coalesce(tasks_for(count, PAIRS_PER_TASK))

    rows = members.withColumn("component", F.col("node"))
    leaders = _leaders(rows).coalesce(tasks)
    rows = rows.join(leaders, ["band", "node"], "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
    labels = components(stages.write(compared(stages.write(rows.coalesce(tasks)))), stages)
    placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stages.write(placed.coalesce(tasks))
    per = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).coalesce(tasks)
    open_ = per.groupBy("band").agg(
        F.max(F.struct("rows", "component", "shingles")).alias("main"),
        F.sum("rows").alias("rows"),
        F.sum("shingles").alias("shingles"),
        F.count(F.lit(1)).alias("parts"),
    ).where("parts > 1")
    return components(stages.write(_grid(placed, open_, sets, percent, least)).unionByName(labels.toDF("a", "b")), stages)


def _grid(placed: DataFrame, open_: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """A spanning forest of the links between components in the buckets that have several."""

    def blocks_of(rows: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK_NODES), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")

    sized = open_.select(
        "band",
        F.col("main.component").alias("main"),
        blocks_of(F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles")).alias("strays"),
        blocks_of(F.col("main.rows"), F.col("main.shingles")).alias("rest"),
    )
    rows = placed.join(sized, "band").withColumn("inside", F.col("component") == F.col("main"))
    block = F.pmod(F.xxhash64("node", F.lit("grid")), F.when(F.col("inside"), F.col("rest")).otherwise(F.col("strays"))).cast("int")
    rows = rows.withColumn("own", F.when(F.col("inside"), block + F.col("strays")).otherwise(block))

    def cell(x: Column, y: Column) -> Column:
        return F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))

    with_strays = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda i: cell(i, F.col("own")))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: cell(F.col("own"), k + F.col("strays")))
    cells = F.when(F.col("inside"), with_strays).otherwise(F.concat(with_strays, with_rest))
    dealt = rows.select("band", "place", "node", "component", "sketch", "own", F.explode(cells).alias("cell"))
    filled = dealt.select("band", "place", "node", "component", "sketch", "own", "cell.*").join(sets, "node")

    def forest(key: tuple, table: pa.Table) -> pa.Table:
        a, b = _spanning(table, key[1].as_py(), key[2].as_py(), percent, least)
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return filled.groupBy("band", "x", "y").applyInArrow(forest, "a binary, b binary")


def _spanning(table: pa.Table, x: int, y: int, percent: int, least: float) -> tuple[list[bytes], list[bytes]]:
    """Links between the components of two blocks, as many as join them up."""
    own = table["own"].to_numpy()
    node, component = table["node"].to_pylist(), table["component"].to_pylist()
    sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(own), BANDS)
    shingles = table["shingles"].combine_chunks()
    size = pc.list_value_length(shingles).to_numpy().astype(np.int64)
    sets = np.split(shingles.flatten().to_numpy().view(np.uint64), np.cumsum(size)[:-1])  # each sorted
    place = table["place"][0].as_py()
    names = {c: i for i, c in enumerate(dict.fromkeys(component))}
    number = np.array([names[c] for c in component])
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    found = []
    step = max(1, 2_000_000 // max(1, len(right) * BANDS))
    for start in range(0, len(left), step):
        some = left[start : start + step]
        apart = number[some][:, None] != number[right][None, :]
        if x == y:
            apart &= some[:, None] < right[None, :]
        n, m = size[some][:, None], size[right][None, :]
        i, j = np.nonzero(apart & (100 * n >= percent * m) & (100 * m >= percent * n))
        i, j = some[i], right[j]
        for part in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[part : part + PAIRS_AT_ONCE], j[part : part + PAIRS_AT_ONCE]
            differ = sketch[a] ^ sketch[b]
            # a pair belongs to the first band that both share
            a, b, differ = (v[(differ == 0).argmax(axis=1) == place] for v in (a, b, differ))
            equal = _equal_bins(differ)
            kept = equal >= least
            found.append(np.stack([equal[kept], a[kept], b[kept]], axis=1))
    ranked = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    edges: tuple[list[bytes], list[bytes]] = ([], [])
    for _, i, j in ranked[np.argsort(-ranked[:, 0], kind="stable")].tolist():
        a, b = root(number[i]), root(number[j])
        if a == b:
            continue
        short, long = (i, j) if size[i] <= size[j] else (j, i)
        at = np.minimum(np.searchsorted(sets[long], sets[short]), size[long] - 1)
        common = int(np.count_nonzero(sets[long][at] == sets[short]))
        if 100 * common >= percent * (size[i] + size[j] - common):
            parent[max(a, b)] = min(a, b)
            edges[0].append(node[i])
            edges[1].append(node[j])
    return edges


def _labelled(df: DataFrame, shingle_words: int, percent: int, text: str) -> DataFrame:
    """doc_id, _key, n_shingles and component (null without shingles) of every row."""
    stages = Stages(df.sparkSession, "near-copies")
    signed = stages.write(signatures(df, shingle_words, text))
    labels = links(df, signed, shingle_words, stages, percent, text)
    rows = signed.select("doc_id", "_key", "n_shingles", "node").join(labels, "node", "left")
    return rows.withColumn("component", F.coalesce("component", "node")).drop("node")


def classes(df: DataFrame, shingle_words: int = 5, percent: int = LINK_PERCENT, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    named = _labelled(df, shingle_words, percent, text)
    smallest = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("_least"))
    out = named.join(smallest, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(df: DataFrame, shingle_words: int = 5, percent: int = LINK_PERCENT, text: str = "text") -> DataFrame:
    """The documents without near-copies: one of each component stays, the one with the smallest id.

    Texts without words all stay.
    """
    named = _labelled(df, shingle_words, percent, text).where(F.col("component").isNotNull())
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("row")
    wanted = named.groupBy("component").agg(best).select(F.col("row.doc_id").alias("_id"), F.col("row._key").alias("_k"))
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("_doc"),
        F.col("doc_id").alias("_own"),
        F.xxhash64(whole).alias("_key"),
        whole.rlike(r"[^\x20\x09-\x0D]").alias("_worded"),
    )
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    one = keyed.where("_worded").join(wanted, same, "left_semi").groupBy("_own", "_key").agg(F.first("_doc").alias("_doc"))
    return one.select("_doc.*").unionByName(keyed.where(~F.col("_worded")).select("_doc.*"))
