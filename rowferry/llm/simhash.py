"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most ``2r`` bits apart share a variant within ``r`` bits of each. So
every fingerprint stands for all its variants within ``r`` bits; the shuffle goes by the
leading bits of the variants, and the task that owns a prefix makes the variants below it,
finds equal ones, and verifies and deduplicates the colliding pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.graph import components
from rowferry.llm.tables import small_batches, sub_batches, tidy, worker_model
from rowferry.storage import materialize

BITS = 64
SEED = 42
SHINGLES_AT_ONCE = 1 << 16
PREFIX_VARIANTS = 1 << 20
VARIANTS_AT_ONCE = 1 << 19


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 without words.

    Words are runs without ASCII white space, A-Z in lower case; shingles of ``shingle``
    words keep their repeats, a shorter text is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    totals = np.zeros(BITS, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(spans), SHINGLES_AT_ONCE):
        some = spans[at : at + SHINGLES_AT_ONCE]
        values = np.fromiter((hashed(joined[a:b], SEED) for a, b in some), np.uint64, len(some))
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int32)
    chosen = np.packbits(totals * 2 > len(spans), bitorder="little")
    return int(chosen.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_hash, fingerprint`` of every row; the texts stay in their tasks."""

    def run(batches):
        worker_model("none", lambda: None)  # an earlier operator's model goes
        for batch in batches:
            for part in sub_batches(batch, 256):
                values = [fingerprint(t, shingle) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(values, pa.int64())],
                    ["doc_id", "text_hash", "fingerprint"],
                )

    rows = small_batches(docs.select("doc_id", text_hash().alias("text_hash"), "text"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, fingerprint long")


def text_hash() -> Column:
    """Tells the rows of one id apart by their texts; null and empty texts count as equal."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """For each budget up to ``most``, the numbers of ``bits`` bits with at most that many ones."""
    out, known = [], []
    for ones in range(most + 1):
        known += [sum(1 << i for i in c) for c in combinations(range(bits), ones)]
        out.append(np.array(known, np.uint64))
    return out


def _collisions(low: np.ndarray, budget: np.ndarray, bits: int, masks: dict[int, list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that share a variant, as stars around each variant's first.

    ``low``: the lower ``bits`` bits; ``budget``: bits that may still change. Too many variants at
    once are made prefix by prefix, so memory doesn't follow the size of a dense prefix.
    """
    if low.size < 2:
        return
    most = int(budget.max())
    if bits not in masks:
        masks[bits] = _masks(bits, max(most, 2))
    elif len(masks[bits]) <= most:
        masks[bits] = _masks(bits, most)
    made = sum(int((budget == r).sum()) * masks[bits][r].size for r in range(most + 1))
    if made > VARIANTS_AT_ONCE and bits > 8:
        step = 4
        head = low >> np.uint64(bits - step)
        rest = low & np.uint64((1 << (bits - step)) - 1)
        for value in range(1 << step):
            left = budget - np.bitwise_count(head ^ np.uint64(value)).astype(np.int64)
            at = np.flatnonzero(left >= 0)
            for a, b in _collisions(rest[at], left[at], bits - step, masks):
                yield at[a], at[b]
        return
    variants, owners = [], []
    for r in range(most + 1):
        at = np.flatnonzero(budget == r)
        if at.size:
            variants.append((low[at][:, None] ^ masks[bits][r][None, :]).ravel())
            owners.append(np.repeat(at, masks[bits][r].size))
    every, owner = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(every)
    same = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not same.size:
        return
    place = np.minimum(np.searchsorted(same, every), same.size - 1)
    hit = np.flatnonzero(same[place] == every)
    group, owner = place[hit], owner[hit]
    order = np.lexsort((owner, group))
    group, owner = group[order], owner[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    lead = owner[np.flatnonzero(first)[np.cumsum(first) - 1]]
    yield lead[~first], owner[~first]


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to connect what ``a-b`` connect."""
    root, kept = list(range(size)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _prefix_links(radius: int, distance: int, prefix_bits: int):
    """Rows ``(prefix, fingerprint, budget)`` in prefix order to links of fingerprints."""

    def links(fps: np.ndarray, budget: np.ndarray, masks) -> pa.RecordBatch | None:
        bits = BITS - prefix_bits
        low = fps.view(np.uint64) & np.uint64((1 << bits) - 1)
        found = [np.zeros((0, 2), np.int64)]
        for a, b in _collisions(low, budget, bits, masks):
            apart = np.bitwise_count(fps[a].view(np.uint64) ^ fps[b].view(np.uint64))
            near = (apart <= distance) & (a != b)
            found.append(np.unique(np.stack([a[near], b[near]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        if not pairs.size:
            return None
        keep = np.array(_forest(fps.size, pairs[:, 0], pairs[:, 1]), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fps[keep[:, 0]]), pa.array(fps[keep[:, 1]])], ["a", "b"])

    def run(batches):
        masks: dict[int, list[np.ndarray]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            prefix = batch.column("prefix").to_numpy()
            fps, budget = batch.column("fingerprint").to_numpy(), batch.column("budget").to_numpy().astype(np.int64)
            edges = np.flatnonzero(np.diff(prefix) != 0) + 1
            for start, stop in zip([0, *edges], [*edges, prefix.size], strict=True):
                if start == stop:
                    continue
                if held and prefix[start] != now:
                    out = links(*map(np.concatenate, zip(*held, strict=True)), masks)
                    if out is not None:
                        yield out
                    held = []
                now = prefix[start]
                held.append((fps[start:stop], budget[start:stop]))
        if held:
            out = links(*map(np.concatenate, zip(*held, strict=True)), masks)
            if out is not None:
                yield out

    return run


def ball_links(fingerprints: DataFrame, distance: int) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints at most ``distance`` bits apart.

    ``fingerprints``: distinct values in ``fingerprint``. A shuffled row stands for all variants
    under one prefix; the prefix length follows the number of variants, so that a prefix holds
    about a million of them at any input size. A prefix keeps a spanning forest of its links.

    ``distance`` must be even: any two fingerprints that share a variant are then linked, so a
    star around each variant's first owner loses no link.
    """
    if distance < 0 or distance % 2:
        raise ValueError(f"distance must be even and not negative: {distance}")
    radius = distance // 2
    count = fingerprints.count()
    ball = sum(math.comb(BITS, r) for r in range(radius + 1))
    bits = min(24, max(4, math.ceil(math.log2(max(2, count * ball / PREFIX_VARIANTS)))))
    flips = [(m, radius - m.bit_count()) for m in _masks(bits, radius)[radius].tolist()]
    masks = F.array(*[F.struct(F.lit(m).cast("int").alias("mask"), F.lit(r).cast("byte").alias("budget")) for m, r in flips])
    top = F.shiftrightunsigned("fingerprint", BITS - bits).cast("int")
    spread = fingerprints.select("fingerprint", top.alias("top"), F.explode(masks).alias("flip")).select(
        F.col("top").bitwiseXOR(F.col("flip.mask")).alias("prefix"), "fingerprint", F.col("flip.budget").alias("budget")
    )
    sorted_rows = spread.repartition("prefix").sortWithinPartitions("prefix")
    return sorted_rows.mapInArrow(tidy(_prefix_links(radius, distance, bits)), "a long, b long")


def _fingerprint_groups(rows: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """``(fingerprint, root)``, each fingerprint's component, and ``(root, head)``, the row that comes first in it.

    Rows are ordered by id, nulls last, then by the text's hash.
    """
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")
    classes = materialize(rows.groupBy("fingerprint").agg(F.min(place).alias("first")), "simhash-classes")
    roots = components(ball_links(classes.select("fingerprint"), distance), "a", "b")
    joined = classes.join(roots, classes["fingerprint"] == roots["node"], "left")
    joined = joined.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    return joined.select("fingerprint", "root"), joined.groupBy("root").agg(F.min("first").alias("head"))


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``docs`` needs ``doc_id`` and ``text``; other columns aren't read. A text that is null or has no
    word has fingerprint zero and links like any other. Repeated rows share a fingerprint. A null
    id belongs to a component, but names one only if it has no other id. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle), "simhash")
    groups, heads = _fingerprint_groups(rows, distance)
    return rows.join(groups.join(heads, "root"), "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("head.doc_id").alias("component_id")
    )


def keep_one_per_component(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id, nulls last.

    All columns are kept as they are. Of several rows with that id, one with the smallest text
    hash stays; only where the row itself is repeated are whole rows grouped.
    """
    rows = materialize(fingerprints(docs, shingle), "simhash")
    _, heads = _fingerprint_groups(rows, distance)
    copies = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    head = heads.select(F.col("head.doc_id").alias("__id"), F.col("head.text_hash").alias("__hash"))
    kept = head.join(copies, head["__id"].eqNullSafe(copies["doc_id"]) & (head["__hash"] == copies["text_hash"]))
    kept = materialize(kept.select("__id", "__hash", "n"), "simhash-kept")
    marked = docs.withColumn("__text_hash", text_hash())

    def chosen(keys: DataFrame) -> DataFrame:
        same = marked["doc_id"].eqNullSafe(keys["__id"]) & (marked["__text_hash"] == keys["__hash"])
        return marked.join(keys, same, "left_semi")

    once, often = chosen(kept.where("n = 1")), chosen(kept.where("n > 1"))
    return once.union(often.dropDuplicates(["doc_id", "__text_hash"])).drop("__text_hash")
