"""MinHash near-duplicate grouping with SuperMinHash signatures.

Every element of a set gives each of the ``m`` places of a signature one rank of a permutation of its own plus a
random fraction; a place keeps its least value. The ranks of an element are correlated (no two are equal), which lowers
the variance of the estimate against independent hashes, and as step ``j`` gives values of at least ``j``, a
document stops as soon as no place holds more than that.

Documents with equal shingle sets are one class, and bands of the signatures of classes make buckets. Only verified links
unite classes, in two steps:

* every class is compared with the first classes of its buckets, as far as sizes and signatures allow a link;
* groups that signatures still find alike within a bucket form families, and in each family the members outside the largest
  group are compared with all others, on full shingle sets and up to the first link of two groups.

Buckets themselves make no families, so texts that only collide in a band never meet. A bucket of one group costs one
pair a member. Members of a hub are dealt out in portions of ``HUB_PAIRS`` to tasks that hold two texts at a time, members of
large buckets and families in chunks, so no key's rows meet in one task and no pairs of a group are written out. Verified
links are united by union-find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixmine.llm import text as X
from fixmine.llm.graph import PAIR, UnionFind, components
from fixmine.llm.store import columns_for, drop, keep, owner, present, spare

PLACES = 320
#: Largest probability that no band holds a pair just at the threshold.
MISSED = 1e-5
#: Pairs of one hub that are compared together.
HUB_PAIRS = 64
#: Members of a bucket whose signatures are compared together with as many others.
CHUNK = 512
#: Places of a signature that tell whether groups are alike; pairs of alike groups are compared on all.
ROUGH = 96
#: Members, and shingles, of a family that are compared together with as many others.
FAMILY_CHUNK, FAMILY_SHINGLES = 128, 1_000_000
#: Elements whose permutations are held at once, and texts whose signatures are (2.5 kB each, and several copies).
_CHUNK, _TEXTS = 1 << 13, 512


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int = PLACES, seed: int = 1) -> np.ndarray:
    """Signatures (n rows of m values, the rank in the upper and the fraction in the lower 32 bits) of n sets.

    elements: distinct hashes, set after set; owner: the set of each element, rising. An empty set has the largest values.
    """
    out = np.full((n, m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    for begin in range(0, len(elements), _CHUNK):
        own, of = elements[begin : begin + _CHUNK], owner[begin : begin + _CHUNK]
        perm = np.empty((len(own), m), np.uint16)
        perm[:] = np.arange(m, dtype=np.uint16)
        row = np.arange(len(own))
        docs = np.unique(of)
        for j in range(m):
            with np.errstate(over="ignore"):
                draw = X.mix(own + X.U64(seed) * X.U64(0xD1342543DE82EF95) + X.U64(j) * X.U64(0x2545F4914F6CDD1D))
            swap = (j + (((draw & X.U64(0xFFFFFFFF)) * X.U64(m - j)) >> X.U64(32)).astype(np.int64))
            place = perm[row, swap]
            perm[row, swap] = perm[row, j]
            perm[row, j] = place
            np.minimum.at(flat, of * m + place, (X.U64(j) << X.U64(32)) | (draw >> X.U64(32)))
            docs = docs[(out[docs].max(axis=1) >> X.U64(32)) > X.U64(j)]
            if not len(docs):
                break
            going = np.isin(of[: len(own)], docs) if len(docs) < n else np.ones(len(own), bool)
            if not going.all():
                own, of, perm = own[going], of[going], perm[going]
                row = np.arange(len(own))
    return out


def rows_of_bands(threshold: float, places: int = PLACES) -> int:
    """The most rows a band can have with ``MISSED`` kept: 8 at 0.85, 6 at 0.8."""
    return max([1, *(r for r in range(1, places + 1) if (1 - threshold**r) ** (places // r) <= MISSED)])


def unlikely_below(threshold: float, places: int) -> float:
    """The share of equal places that is five standard errors below the threshold: a link just at it falls lower in 1 to 6 of a million cases."""
    return max(0.0, threshold - 5 * (threshold * (1 - threshold) / places) ** 0.5)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; places that fill no band are left out."""
    n = len(signatures)
    m = signatures.shape[1] // rows * rows
    signatures = signatures[:, :m]
    keys = X.mix(np.arange(9000, 9000 + m, dtype=np.uint64)) | X.U64(1)
    with np.errstate(over="ignore"):
        return X.mix((X.mix(signatures) * keys).reshape(n, m // rows, rows).sum(axis=2, dtype=np.uint64))


SKETCH = "doc_id long, text_hash long, n_shingles long, print binary, bands array<long>, sig binary"


def _sketch(rows: int):
    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.buffers(batch["text"])
            ids, hashes = batch["doc_id"], batch["text_hash"]
            for i, j in X.slices(offsets, texts=_TEXTS):
                sets = list(X.shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                sizes = np.array([len(s) for s in sets])
                signs = super_minhash(np.concatenate(sets), np.repeat(np.arange(j - i), sizes), j - i)
                bands = band_keys(signs, rows).view(np.int64)
                full = sizes > 0
                small = X.mix(signs).astype(np.uint8)
                yield pa.record_batch([
                    ids.slice(i, j - i), hashes.slice(i, j - i), pa.array(sizes, pa.int64()), pa.array([X.fingerprint(s) for s in sets], pa.binary()),
                    pa.array([b if f else None for b, f in zip(bands, full, strict=True)], pa.list_(pa.int64())), pa.array([s.tobytes() for s in small], pa.binary()),
                ], names=["doc_id", "text_hash", "n_shingles", "print", "bands", "sig"])

    return run


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, hub, portion, side) of pairs (x, y): y as side 1, in portions of so many of one x in one task, and x as side 0 of each portion."""
    seen: dict[int, int] = {}
    task = TaskContext.get().partitionId() << 32
    for batch in batches:
        out = []
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
            nth = seen.get(x, 0)
            seen[x] = nth + 1
            portion = task + nth // HUB_PAIRS
            if nth % HUB_PAIRS == 0:
                out.append((x, x, portion, 0))
            out.append((y, x, portion, 1))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["node", "hub", "portion", "side"])


def _beside(pairs: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
    """Rows (hub, portion, side, node, cols): x of the pairs (x, y) as side 0, then the y of a portion as side 1. table: node, cols; pairs: a kept table."""
    need = pairs.select("x", "y").mapInArrow(_portions, "node long, hub long, portion long, side long")
    return table.join(need, "node").select("hub", "portion", "side", "node", *cols).repartition("hub", "portion").sortWithinPartitions("hub", "portion", "side")


def _likely(percent: int, least: float):
    """Pairs (x, y) that sizes and signatures allow to be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, size, sign = None, 0, b""
        for batch in batches:
            nodes, sides, sizes = (batch[c].to_numpy() for c in ("node", "side", "n_shingles"))
            signs = _signatures(batch["sig"])
            cuts = np.flatnonzero(sides == 0)
            found: list[tuple[int, int]] = []
            for a, b in zip([-1, *cuts.tolist()], [*cuts.tolist(), len(nodes)], strict=True):
                if a >= 0:
                    hub, size, sign = int(nodes[a]), sizes[a], signs[a]
                if a + 1 < b:
                    fit = _sizes_fit(sizes[a + 1 : b], size, percent) & ((signs[a + 1 : b] == sign).mean(axis=1) >= least)
                    found += [(hub, y) for y in nodes[a + 1 : b][fit].tolist()]
            yield _pairs(found)

    return run


def _sizes_fit(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PLACES)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=PAIR)


def _by_block(keys: tuple[str, ...], cols: tuple[str, ...], pairs: Callable[[list[tuple]], list[tuple[int, int]]]):
    """Pairs of each block of rows; rows sorted by ``keys``."""

    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, r in zip(zip(*(batch[c].to_pylist() for c in keys), strict=True), zip(*(batch[c].to_pylist() for c in cols), strict=True), strict=True):
                if k != key:
                    found += pairs(block)
                    key, block = k, []
                block.append(r)
            yield _pairs(found)
        yield _pairs(pairs(block))

    return run


def _alike(percent: int, least: float):
    """Groups that signatures find alike in a block (side, node, group, n_shingles, sig); no more pairs than groups."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        if not left or not right:
            return []
        groups, of = np.unique(np.array([r[2] for r in right]), return_inverse=True)
        size, signs = np.array([r[3] for r in right]), np.frombuffer(b"".join(r[4] for r in right), np.uint8).reshape(len(right), -1)
        united, out = UnionFind(), []
        for _, _, own, n, sig in left:
            at = np.flatnonzero((groups[of] != own) & _sizes_fit(size, np.int64(n), percent))
            if len(at):
                at = at[(signs[at] == np.frombuffer(sig, np.uint8)).mean(axis=1) >= least]
            out += [(own, other) for other in groups[np.unique(of[at])].tolist() if united.union(own, other)]
        return out

    return pairs


def _linked(percent: int, least: float):
    """Links between groups in a block (side, node, group, sig, text) of a family; a link makes two groups one for the block."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        left, right = ([r for r in rows if r[0] == side] for side in (0, 1))
        if not left or not right:
            return []
        sets = list(X.shingle_sets(*X.buffers(pa.array([r[4] for r in right], pa.large_string()))))
        size, signs = np.array([len(x) for x in sets]), np.frombuffer(b"".join(r[3] for r in right), np.uint8).reshape(len(right), PLACES)
        node, group = np.array([r[1] for r in right]), np.array([r[2] for r in right])
        now, out = {g: g for g in group.tolist()}, []
        for (_, x, own, sig, _), mine in zip(left, X.shingle_sets(*X.buffers(pa.array([r[4] for r in left], pa.large_string()))), strict=True):
            own = now.setdefault(own, own)
            at = np.flatnonzero((group != own) & _sizes_fit(size, np.int64(len(mine)), percent))
            if len(at):
                at = at[(signs[at] == np.frombuffer(sig, np.uint8)).mean(axis=1) >= least]
            for k in at.tolist():
                if group[k] == own:
                    continue
                both = X.shared(mine, sets[k])
                if 100 * both >= percent * (len(mine) + len(sets[k]) - both):
                    out.append((x, int(node[k])))
                    old = int(group[k])
                    group[group == old] = own
                    now.update({g: own for g, h in now.items() if h == old})
        return out

    return pairs


def _compare(percent: int):
    """Links of hubs (side 0) and the members after them (side 1)."""

    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for node, side, s in zip(batch["node"].to_pylist(), batch["side"].to_pylist(), X.shingle_sets(*X.buffers(batch["text"])), strict=True):
                if side == 0:
                    hub, own = node, s
                    continue
                both = X.shared(own, s)
                if 100 * both >= percent * (len(own) + len(s) - both):
                    found.append((hub, node))
            yield _pairs(found)

    return run


def _texts(rows: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the classes in ``nodes`` (node); one row of the table brings the text of a class."""
    wanted = classes.join(nodes, "node", "left_semi").select("doc_id", "text_hash", "node")
    return rows.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("node", "text")


def _with_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` (node) with the group of each class; a class without links is a group of its own."""
    return df.join(groups.select("node", F.col("component").alias("group")), "node", "left").withColumn("group", F.coalesce("group", "node"))


def _outside_with_all(rows: DataFrame, key: str, most: int, *cols: str, size: str | None = None, most_size: int = 1) -> DataFrame:
    """Blocks (key, i, j) of rows (key, node, group and others): members outside the largest group (side 0) with all (side 1).

    Keys of one group give none. Both sides are cut into chunks of about ``most`` members, and ``most_size`` of ``size``.
    """
    one = F.lit(0) if size is None else F.sum(size)
    counts = rows.groupBy(key, "group").agg(F.count("*").alias("n"), one.cast("long").alias("s"))
    held = counts.groupBy(key).agg(F.count("*").alias("groups"), F.max_by("group", F.struct("n", "group")).alias("_main"), F.max_by("s", F.struct("n", "group")).alias("ms"), F.max("n").alias("mn"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("groups > 1")
    chunks = lambda n, s: F.ceil(F.greatest(n / most, s / most_size, F.lit(1.0))).cast("int")
    held = held.select(key, "_main", chunks(F.col("n") - F.col("mn"), F.col("s") - F.col("ms")).alias("_lefts"), chunks(F.col("n"), F.col("s")).alias("_rights"))
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    right = F.transform(every("_lefts"), lambda i: place(i, chunk("_rights"), 1))
    left = F.when(F.col("group") != F.col("_main"), F.transform(every("_rights"), lambda j: place(chunk("_lefts"), j, 0)))
    at = F.explode(F.concat(right, F.coalesce(left, F.slice(right, 1, 0)))).alias("_at")
    return rows.join(held, key).select(key, at, "node", "group", *cols).select(key, "_at.*", "node", "group", *cols)


def near_groups(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text and any other columns).

    Links: documents whose sets of distinct 5-word shingles have a Jaccard similarity of ``threshold`` or more.
    component_id: the smallest doc_id reachable; kept: doc_id = component_id. Null or wordless texts have no
    shingles and no links. Of rows with one doc_id and different texts, each gets the group of its own text. A null
    doc_id keeps its row with a null component and kept false, and links nothing. An empty table gives an empty table.
    """
    return labelled_rows(docs, threshold).drop("text_hash")


def labelled_rows(docs: DataFrame, threshold: float, seen: dict[str, int] | None = None) -> DataFrame:
    """``near_groups`` with the hash of each row's text. seen: gets the numbers of pairs looked at, pairs verified, links and family members."""
    percent = round(100 * threshold)
    least = unlikely_below(threshold, PLACES)
    rows = columns_for(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    sketch = keep(rows.mapInArrow(_sketch(rows_of_bands(threshold)), SKETCH), "sketch")
    named = sketch.where("doc_id is not null and n_shingles > 0")
    # a class is known by a hash of its print, as rows with one doc_id may have different texts
    classes = keep(named.groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).select(F.xxhash64("print").alias("node"), "print", "row.*", "n_shingles", "bands", "sig"), "classes")
    signs = classes.select("node", "n_shingles", "sig")
    in_bucket = classes.select(F.explode("bands").alias("bucket"), "node")
    buckets = in_bucket.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", "first")
    member = keep(in_bucket.join(buckets, "bucket"), "members")
    stars = keep(member.where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y")).distinct(), "stars")
    likely = keep(_beside(stars, signs, "n_shingles", "sig").mapInArrow(_likely(percent, least), "a long, b long").select(F.col("a").alias("x"), F.col("b").alias("y")), "likely")
    texts = _texts(rows, classes, likely.select(F.explode(F.array("x", "y")).alias("node")).distinct())
    links = keep(_beside(likely, texts, "text").mapInArrow(_compare(percent), "a long, b long"), "links")
    groups = keep(components(links, "groups"), "groups")
    met = _with_group(member.where("node <> first").select("bucket", "node"), groups).join(signs.withColumn("sig", F.substring("sig", 1, ROUGH)), "node")
    blocks = _outside_with_all(met, "bucket", CHUNK, "n_shingles", "sig").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    alike = keep(blocks.mapInArrow(_by_block(("bucket", "i", "j"), ("side", "node", "group", "n_shingles", "sig"), _alike(percent, unlikely_below(threshold, ROUGH))), "a long, b long").distinct(), "alike")
    drop(member)
    more = links.limit(0)
    if not alike.isEmpty():
        families = keep(components(alike, "families").select(F.col("node").alias("group"), F.col("component").alias("family")), "families")
        kin = keep(_with_group(signs, groups).join(families, "group"), "kin")
        dealt = keep(_outside_with_all(kin, "family", FAMILY_CHUNK, "sig", size="n_shingles", most_size=FAMILY_SHINGLES), "blocks")
        blocks = dealt.join(_texts(rows, classes, kin.select("node")), "node").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
        more = keep(blocks.mapInArrow(_by_block(("family", "i", "j"), ("side", "node", "group", "sig", "text"), _linked(percent, least)), "a long, b long"), "links")
        if not more.isEmpty():
            old, groups = groups, keep(components(links.union(more), "groups"), "groups")
            drop(old)
        if seen is not None:
            seen["kin"], seen["dealt"] = kin.count(), dealt.count()
        drop(families, kin, dealt)
    if seen is not None:
        seen["stars"], seen["likely"], seen["links"], seen["more"] = stars.count(), likely.count(), links.count(), more.count()
    drop(stars, likely, alike, links)
    least_id = groups.join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    label = keep(classes.select("print", "node", "doc_id").join(groups.join(least_id, "component").select("node", "least"), "node", "left").select("print", F.coalesce("least", "doc_id").alias("component")), "labels")
    drop(classes, groups)
    labelled = sketch.where("n_shingles > 0").join(label, "print", "left").select("doc_id", "text_hash", "n_shingles", "component")
    alone = sketch.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component"))
    return labelled.union(alone).select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each group, with all its columns; rows without a doc_id stay.

    Of rows that repeat both doc_id and text one stays.
    """
    d, h, own = spare(docs, "doc_key"), spare(docs, "hash_key"), spare(docs, "text_hash")
    mine = present()
    with owner():
        stay = keep(labelled_rows(docs, threshold).where("kept").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct(), "stay", mine)
    rows = docs.withColumn(own, F.xxhash64("text"))
    ours = rows.join(stay, (F.col("doc_id").cast("long") == F.col(d)) & (F.col(own) == F.col(h)), "inner").dropDuplicates([d, h])
    return ours.select(*docs.columns).union(docs.where("doc_id is null"))
