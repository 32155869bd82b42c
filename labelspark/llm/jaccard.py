"""Jaccard join of word-shingle sets by universe partition, exact, with its components.

Two sets whose sizes are a <= b and whose similarity is at least t differ in at most
H = a(1 - t)/t elements. The universe of shingles is divided by hash into segments; if the
segments' allowances add up to H + 1, two such sets differ in fewer elements than the
allowance in at least one segment. Allowance 1 asks for an equal subset, allowance 2 for
subsets that differ in one element at most, which one-deletion neighbourhoods find. How many
segments have which allowance is decided by cost for each band of sizes.

Segments that are empty in both sets agree, too, and tell nothing. `spare` segments are therefore
added: the allowances of the segments that two similar sets agree in then add up to spare + 1 at
least. A set keeps its first `spare` empty segments to itself, in an order all sets share. If two
similar sets agree in empty segments only, the last of these comes after `spare` others in both
sets, so both send it, and no pair is lost.

Of its filled segments a set sends the rarest only. All but H filled segments of a set are equal in a
similar one, so in an order of segment subsets that all sets share, the first equal one is among the
first H + 1 of both. Subsets are ordered by how often the rarest of their shingles is seen in all texts,
counted in a table of fixed size; collisions there move cost, never results. Frequent lines are thus kept
from bringing unlike sets together. Sets with fewer filled segments send them all, and their empty ones as above.

Sets that meet are compared by parity sketches before any element travels: bit b tells whether
an odd number of a set's elements hash to b. Two sketches differ in at most as many bits as
their sets have unshared elements, so a pair over the allowance is refused without error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.bitset import build_filter, may_hold
from labelspark.llm.components import components
from labelspark.llm.hashing import mix, multiplier, overlap, shingle_set, word_hashes
from labelspark.llm.stored import release, stored
from labelspark.llm.tasks import batch as batch_of
from labelspark.llm.tasks import map_batches

#: Prices of the allocation: one signature sent, one pair of sets compared. They move cost, never results.
SIGNATURE_COST, PAIR_COST = 1.0, 20.0
#: How likely two unlike sets of a band agree on a shingle. None: counted for each band.
AGREEMENT: float | None = None
#: Sizes of a band differ by less than this factor.
BAND_NUMERATOR, BAND_DENOMINATOR = 3, 2
#: Places of the table in which shingles are counted.
PLACES = 1 << 15
#: Longs of a parity sketch. More refuse more unrelated pairs of long texts; results are the same.
SKETCH_WORDS = 16
#: Sets of a bucket's part: fuller buckets are compared in several parts.
PART = 4096


@dataclass(frozen=True)
class Band:
    """Sizes lo..hi, divided into `segments` and `spare` more; the last `deletions` have allowance 2.

    The first `spare` empty segments of allowance 1 are not sent.
    """

    index: int
    lo: int
    hi: int
    segments: int
    deletions: int
    spare: int = 0


def band_limits(percent: int) -> list[tuple[int, int]]:
    """Size bands, from the smallest size at which two different sets can be similar enough."""
    lo, out = -(-percent // (100 - percent)), []
    while lo < 1 << 31:
        hi = max(lo, lo * BAND_NUMERATOR // BAND_DENOMINATOR - 1)
        out.append((lo, hi))
        lo = hi + 1
    return out


def spare_segments(lo: int, allowance: int) -> int:
    """Segments to add to `allowance` so that sets of `lo` elements hardly ever have more empty ones."""
    spare = 0
    while spare < 2 * lo:
        m = allowance + spare
        load = lo / m
        empty = m * math.exp(-load)
        spread = math.sqrt(empty * (1 - (1 + load) * math.exp(-load)))
        need = min(math.ceil(empty + 3 * spread), 2 * lo)
        if need <= spare:
            break
        spare = need
    return spare


def chance_meetings(size: float, agreement: float) -> tuple[float, float]:
    """How likely two unlike sets meet in a segment of about `size` elements, by allowance (1, 2).

    With allowance 1 both must hold the same elements, and some. With allowance 2 all elements but
    one must be shared, or each of the sets has at most one there.
    """
    bare = math.exp(-size)
    few = bare * (1 + size)
    return math.exp(size * (agreement - 1)) - bare, few * few + (1 + size) * agreement ** max(size - 1, 0)


def allocate(index: int, lo: int, hi: int, sets: int, percent: int, agreement: float = 0.05) -> Band:
    """The cheapest division of a band that holds about `sets` sets."""
    allowance = hi * (100 - percent) // percent + 1
    middle, spare = (lo + hi) / 2, spare_segments(lo, allowance)
    agreement = agreement if AGREEMENT is None else AGREEMENT
    best, d = None, 0
    while d <= allowance // 2:
        segments = allowance - d + spare
        size = middle / segments
        equal, near = chance_meetings(size, agreement)
        sent = segments + d * size
        alike = (segments - d) * equal + d * near
        cost = SIGNATURE_COST * sets * sent + PAIR_COST * sets * sets / 2 * alike
        if best is None or cost < best[0]:
            best = cost, Band(index, lo, hi, segments - spare, d, spare)
        d = d + max(1, d // 4)
    return best[1]


def signatures(
    elements: np.ndarray, band: Band, counts: np.ndarray | None = None, percent: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a set's segment subsets that are sent, and of those subsets less one element.

    With `counts`, by place of a shingle, no more subsets are sent than similarity `percent` asks for.
    """
    total_segments = band.segments + band.spare
    m = np.uint64(total_segments)
    segment = mix(elements, 1) % m
    weight = mix(elements, 2)
    order = np.argsort(segment, kind="stable")
    segment, weight = segment[order], weight[order]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weight, dtype=np.uint64)))
    cut = np.searchsorted(segment, np.arange(total_segments + 1, dtype=np.uint64))
    sums = total[cut[1:]] - total[cut[:-1]]
    sums += np.arange(total_segments, dtype=np.uint64) * multiplier(101)
    sums += np.full(1, band.index, dtype=np.uint64) * multiplier(102)
    near = segment >= m - np.uint64(band.deletions) if band.deletions else np.zeros(0, bool)
    fewer = sums[segment[near].astype(np.int64)] - weight[near] if band.deletions else sums[:0]
    empty = cut[1:] == cut[:-1]
    empty[total_segments - band.deletions :] = False
    sent = ~empty | (np.cumsum(empty) > band.spare)
    if counts is not None:
        plain = total_segments - band.deletions
        filled = np.flatnonzero(~empty[:plain])
        unlike = min(len(elements) * (100 - percent) // percent, band.segments + band.deletions - 1)
        need = max(unlike - 2 * band.deletions + 1, 0)
        if need <= len(filled):
            seen = counts[(elements[order][: cut[plain]] & np.uint64(PLACES - 1)).astype(np.int64)]
            least = np.minimum.reduceat(seen, cut[filled]).astype(np.uint64) if len(filled) else np.empty(0, np.uint64)
            rarest = np.argsort((least << np.uint64(24)) | (mix(sums[filled], 5) >> np.uint64(40)), kind="stable")
            sent[filled[rarest[need:]]] = False
            sent[:plain] &= ~empty[:plain]
    return mix(sums[sent], 3), mix(fewer, 3)


def _set_key(elements: np.ndarray) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(elements.tobytes())
    return _signed(n >> 64), _signed(n & ((1 << 64) - 1))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the number of elements that hash to each bit, as SKETCH_WORDS longs."""
    bits = SKETCH_WORDS * 64
    counts = np.bincount((mix(elements, 4) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()),
     ("full", pa.list_(pa.int64())), ("fewer", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())),
     ("raw_sha256", pa.string())]
)
_LEAST = pa.schema([(c, pa.int64()) for c in ("band", "a", "b", "c")])
_SETS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("elements", pa.binary())])


def _elements(text: str | None, k: int) -> np.ndarray:
    """Shingles of the words `[^\\x20\\x09-\\x0D]+`, A-Z lowered."""
    return shingle_set(word_hashes((text or "").encode().lower().split()), k)


def _place() -> Column:
    """Hash of a row's doc_id, never null: where the row of a set is looked for."""
    return F.xxhash64(F.col("doc_id").cast("long"))


def _least_shingles(docs: DataFrame, k: int, lows: np.ndarray) -> DataFrame:
    """(band, a, b, c): each set's band and its least shingles by three hashes.

    Band -1 has how many shingles of a task's sets (b) fall on each place (a).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, size = np.zeros(PLACES, np.int64), [], 0
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                elements = _elements(t, k)
                waiting.append((elements & np.uint64(PLACES - 1)).astype(np.int64))
                size += len(elements)
                if size > PLACES:
                    seen += np.bincount(np.concatenate(waiting), minlength=PLACES)
                    waiting, size = [], 0
                at = int(np.searchsorted(lows, len(elements), side="right")) - 1
                if at >= 0:
                    out.append((at, *(_signed(int(mix(elements, salt).min())) for salt in (11, 12, 13))))
            yield batch_of(_LEAST, *(zip(*out) if out else [[]] * 4))
        seen += np.bincount(np.concatenate([np.empty(0, np.int64), *waiting]), minlength=PLACES)
        places = np.flatnonzero(seen)
        yield batch_of(_LEAST, np.full(len(places), -1), places, seen[places], np.zeros(len(places), np.int64))

    return map_batches(docs.select("text"), run, "band long, a long, b long, c long")


def _bands(docs: DataFrame, k: int, percent: int) -> tuple[list[Band], np.ndarray]:
    """Bands, and how many shingles fall on each place. Bands are priced by how many sets they have and how often unlike sets agree; all texts are counted.

    Two sets agree on a least shingle by chance J, their similarity. Pairs that agree by the first
    hash and by neither of the others are counted by inclusion and exclusion, J(1 - J)^2 on
    average: copies, which have to meet anyway, count as nothing, and unlike sets count as J.
    """
    limits = band_limits(percent)
    least = stored(_least_shingles(docs, k, np.array([lo for lo, _ in limits])))
    counts = np.zeros(PLACES, np.int64)
    seen = least.where("band = -1").groupBy("a").agg(F.sum("b").alias("n")).toArrow()
    counts[seen.column("a").to_numpy()] = seen.column("n").to_numpy()
    groups = stored(least.where("band >= 0").groupBy("band", "a", "b", "c").agg(F.count("*").alias("n")))
    pairs = F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)

    def agreeing(*by: str) -> dict[int, float]:
        counted = groups.groupBy("band", *by).agg(F.sum("n").alias("n")).groupBy("band").agg(pairs.alias("pairs"))
        return {r["band"]: r["pairs"] for r in counted.collect()}

    sets = {r["band"]: r["n"] for r in groups.groupBy("band").agg(F.sum("n").alias("n")).collect()}
    one, two, other, three = (agreeing(*by) for by in ("a", "ab", "ac", "abc"))
    out = []
    for i, (lo, hi) in enumerate(limits):
        n = sets.get(i, 1)
        alike = one[i] - two[i] - other[i] + three[i] if i in one else 0.0
        out.append(allocate(i, lo, hi, n, percent, min(1.0, (alike + 1) / (n * (n - 1) / 2 + 1))))
    return out, counts


def _signed_rows(docs: DataFrame, k: int, percent: int, bands: list[Band], counts: np.ndarray) -> DataFrame:
    lows = np.array([b.lo for b in bands])
    seen = docs.sparkSession.sparkContext.broadcast(counts)

    def of(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(elements)
        at = int(np.searchsorted(lows, n, side="right")) - 1
        if at < 0:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        mine = [bands[at]]
        if at and bands[at - 1].hi * 100 >= n * percent:
            mine.append(bands[at - 1])
        full, fewer = zip(*(signatures(elements, b, seen.value, percent) for b in mine))
        return np.concatenate(full), np.concatenate(fewer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes, keys, full, fewer, sketches = [], [], [], [], []
            for t in texts:
                elements = _elements(t, k)
                sizes.append(len(elements))
                keys.append(_set_key(elements) if len(elements) else (None, None))
                f, d = of(elements)
                full.append(f.view(np.int64))
                fewer.append(d.view(np.int64))
                sketches.append(sketch(elements))
            digests = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
            yield batch_of(
                _ROWS, b.column("doc_id"), sizes, *(zip(*keys) if keys else ([], [])), full, fewer, sketches, digests
            )

    kind = "doc_id long, n_shingles long, hi long, lo long, full array<long>, fewer array<long>"
    kind += ", sketch array<long>, raw_sha256 string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, kind)


def _representatives(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of `signed` that stand for a class, without moving their signatures.

    A filter of bounded size refuses the others where they are read; a few may pass and are only
    compared in vain, as they are in no class.
    """
    keys = classes.select(F.xxhash64("set").alias("h"))
    bits = signed.sparkSession.sparkContext.broadcast(build_filter(keys, "h", classes.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = may_hold(bits.value, b.column("h").to_numpy().view(np.uint64))
            yield b.select(["set", "full", "fewer"]).filter(pa.array(mine))

    read = signed.select(F.col("row").alias("set"), "full", "fewer", F.xxhash64("row").alias("h"))
    return map_batches(read, run, "set long, full array<long>, fewer array<long>")


def _buckets(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(signature, set, rank, size): sets that share a signature, numbered within it, and how many they are."""
    sent = _representatives(signed, classes).select("set", F.explode(F.concat("full", "fewer")).alias("signature"))
    whole = Window.partitionBy("signature")
    numbered = sent.select(
        "signature", "set", F.row_number().over(whole.orderBy("set")).alias("rank"), F.count("*").over(whole).cast("int").alias("size")
    )
    return numbered.where("size > 1").join(classes.select("set"), "set", "left_semi")


def _sets(docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(set, elements) of the sets of `keys` (set, hi, lo, place).

    Only texts of rows that may stand for one of the sets are divided into shingles again.
    """
    n = keys.count()
    sc = docs.sparkSession.sparkContext
    places, bits = (sc.broadcast(build_filter(keys, c, n)) for c in ("place", "hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            mine = may_hold(places.value, b.column("place").to_numpy().view(np.uint64))
            for t in b.column("text").filter(pa.array(mine)).to_pylist():
                elements = _elements(t, k)
                if not len(elements):
                    continue
                key = _set_key(elements)
                if key in done or not may_hold(bits.value, np.array([key[0]]).view(np.uint64))[0]:
                    continue
                if len(done) < 200_000:
                    done.add(key)
                out.append((*key, elements.tobytes()))
            yield batch_of(_SETS, *(zip(*out) if out else [[]] * 3))

    read = docs.select("text", _place().alias("place"))
    found = map_batches(read, run, "hi long, lo long, elements binary")
    once = found.groupBy("hi", "lo").agg(F.first("elements").alias("elements"))
    return stored(once.join(keys, ["hi", "lo"]).select("set", "elements"))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, by their elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("eu"), b.column("ev")):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def side(node: str) -> DataFrame:
        named = sets.select(F.col("set").alias(node), F.col("elements").alias("e" + node))
        return named.join(pairs.select(node), node, "left_semi")

    with_both = pairs.join(side("v"), "v").join(side("u"), "u")
    return map_batches(with_both.select("u", "v", "eu", "ev"), run, "u long, v long")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets whose sets are not in one component yet, with label and the bucket's size."""
    named = buckets.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "label", F.coalesce("label", "set")
    )
    open_ = named.groupBy("signature").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.max("rank").alias("size")
    ).where("a < b")
    return stored(named.join(open_.select("signature", "size"), "signature"))


def _met(active: DataFrame, sketches: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """(u, v): sets of ranks low..high-1 with later sets of their bucket that may be similar.

    Sizes, labels and sketches are compared within the join, so no other pair leaves it. A full
    bucket is dealt to several tasks: its later sets by rank, its first sets to each of them.
    """
    parts = F.ceil(F.col("size") / PART).cast("int")
    with_bits = active.where(F.col("size") > low).withColumn("parts", parts).join(sketches, "set")
    bits = [f"s{i}" for i in range(SKETCH_WORDS)]
    first = with_bits.where((F.col("rank") >= low) & (F.col("rank") < high)).select(
        "signature", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("set").alias("u"),
        F.col("n").alias("nu"), F.col("rank").alias("ru"), F.col("label").alias("lu"), *[F.col(c).alias("u" + c) for c in bits]
    )
    later = with_bits.where(F.col("rank") > low).withColumn("part", (F.col("rank") % F.col("parts")).cast("int"))
    unlike = sum((F.bit_count(F.col(c).bitwiseXOR(F.col("u" + c))) for c in bits), F.lit(0))
    return first.join(later, ["signature", "part"]).where(
        (F.col("rank") > F.col("ru")) & (F.col("label") != F.col("lu"))
        & (F.least("n", "nu") * 100 >= F.greatest("n", "nu") * percent)
        & (unlike * (100 + percent) <= (F.col("n") + F.col("nu")) * (100 - percent))
    ).select("u", F.col("set").alias("v")).distinct()


def _labels(docs: DataFrame, classes: DataFrame, buckets: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, label) of all sets that are linked to another.

    In each signature's bucket the sets of the first ranks are compared with all later sets of
    other components, then the next ranks, eight times as many, and so on. Sets found linked
    need no comparison with each other, so a bucket of near copies costs its size, not its
    square; a bucket is done when its sets are in one component or all pairs across are tested.
    Elements are made and sent only for sets whose sketches let them pass.
    """
    links = tested = sets = labels = None
    low, high = 1, 2
    active = buckets.withColumn("label", F.col("set"))
    while True:
        pairs = _met(active, sketches, low, high, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = stored(pairs)
        if not pairs.isEmpty():
            need = pairs.select(F.col("u").alias("set")).unionByName(pairs.select(F.col("v").alias("set"))).distinct()
            if sets is not None:
                need = need.join(sets.select("set"), "set", "left_anti")
            keys = stored(classes.join(need, "set", "left_semi").select("set", "hi", "lo", "place"))
            if not keys.isEmpty():
                more = _sets(docs, keys, k)
                sets = more if sets is None else sets.unionByName(more)
            found = stored(_similar(pairs, sets, percent))
            tested = pairs if tested is None else tested.unionByName(pairs)
            release()
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                labels = components(links)
                # all pairs of a bucket of `high` sets are tested
                active = _open(active.where(F.col("size") > high).drop("label", "size"), labels)
        low, high = high, high * 8
        last = active.agg(F.max("rank")).first()[0]
        if last is None or last <= low:
            break
    return docs.sparkSession.createDataFrame([], "node long, label long") if labels is None else labels


def similar_rows(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """Components of rows of `docs` (doc_id, text) whose shingle sets are similar.

    Two rows link when 100 * shared >= percent * united shingles of `k` words. Returns one row
    per row: doc_id, n_shingles, component_id, raw_sha256. Texts of fewer than k words are one
    shingle; null, empty and blank texts have none, link with nothing and are their own
    component. Rows with equal sets are always linked; component_id is the smallest doc_id of
    the component (null only if all are null). An empty table gives an empty result.

    Equal sets are one class from the start, found with a map-side aggregate, so copies cost
    one comparison. Elements are 64-bit hashes of shingles, classes 128-bit hashes of sets.
    """
    bands, counts = _bands(docs, k, percent)
    signed = stored(_signed_rows(docs, k, percent, bands, counts).withColumn("row", F.monotonically_increasing_id()))
    rows = stored(signed.drop("full", "fewer"))
    classes = stored(
        rows.where("n_shingles > 0").withColumn("place", _place()).groupBy("hi", "lo").agg(
            F.min("row").alias("set"), F.min("doc_id").alias("first"), F.min_by("place", "row").alias("place"),
            F.min("n_shingles").alias("n"),
        )
    )
    buckets = stored(_buckets(signed, classes))
    release(signed)
    met = classes.join(buckets.select("set").distinct(), "set", "left_semi").select("set", "n")
    sketches = stored(
        rows.withColumnRenamed("row", "set").join(met, "set")
        .select("set", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)])
    )
    release()
    labels = _labels(docs, classes, buckets, sketches, k, percent)
    labelled = classes.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "label", F.coalesce("label", "set")
    )
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    known = stored(labelled.join(least, "label").select("hi", "lo", "component_id"))
    return rows.select("doc_id", "n_shingles", "hi", "lo", "raw_sha256").join(known, ["hi", "lo"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "raw_sha256",
    )
