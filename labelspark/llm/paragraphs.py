"""Repeated paragraphs: MinHash bands, exact Jaccard, and clusters of what to remove.

A paragraph is a line, a run of shorter lines, or a stretch of a fixed number of words inside the
text. Stretches start at words that winnowing selects, so two texts that share `passage` words in a
row share a stretch, wherever the passage stands and whatever the lines are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.bitset import build_filter, may_hold
from labelspark.llm.components import components
from labelspark.llm.hashing import mix, multiplier, overlap, run_hashes, word_hashes
from labelspark.llm.stored import release, stored
from labelspark.llm.tasks import batch as batch_of
from labelspark.llm.tasks import map_batches


@dataclass(frozen=True)
class ParagraphSettings:
    """stretch: words of a stretch, and the fewest of a line. passage: words of a shared
    passage that is always met. k, percent: shingle size and similarity. recall: least chance
    that a pair at the threshold shares a band."""

    stretch: int = 25
    passage: int = 51
    k: int = 5
    percent: int = 80
    recall: float = 0.99
    hashes: int = 12


def tuned_bands(percent: int, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding that still reaches the recall.

    More rows in a band mean fewer chance meetings; bands are added until pairs at the
    threshold meet often enough, within `hashes` values.
    """
    best, t = (hashes, 1), percent / 100
    for rows in range(1, hashes + 1):
        bands = next((b for b in range(1, hashes // rows + 1) if 1 - (1 - t**rows) ** b >= recall), None)
        if bands:
            best = bands, rows
    return best


def _starts(hashes: np.ndarray, bounds: np.ndarray, s: ParagraphSettings) -> np.ndarray:
    """Words at which stretches start: the least hash of each run of passage - stretch + 1.

    The words of several texts stand one after the other; text i has those from bounds[i] on.
    """
    window, n = s.passage - s.stretch + 1, len(hashes) - s.stretch + 1
    if n < window:
        return np.empty(0, dtype=np.int64)
    least = (mix(hashes[:n], 9) & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < window:  # least value of each run, with its place in the low half
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    long = np.diff(bounds) >= s.passage
    inside = np.zeros(len(least) + 1, dtype=np.int8)  # runs of one text, not of two neighbours
    inside[bounds[:-1][long]] += 1
    inside[bounds[1:][long] - s.passage + 1] -= 1
    starts = (least[np.cumsum(inside[:-1], dtype=np.int8) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return starts[np.diff(starts, prepend=-1) != 0]


def spans_of(text: str | None, s: ParagraphSettings) -> tuple[list[bytes], list[tuple[int, int]]]:
    """A text's words (A-Z lowered) and its paragraphs, as word ranges.

    A line of `stretch` words is a paragraph, and so are shorter lines up to a blank or a long one
    if they have as many together. A text with neither a paragraph nor a stretch is one itself.
    """
    words, spans, start = [], [], 0
    for line in [*(text or "").encode().lower().split(b"\n"), b""]:
        own, at = line.split(), len(words)
        if not own or len(own) >= s.stretch:
            if at - start >= s.stretch:
                spans.append((start, at))
            if own:
                spans.append((at, at + len(own)))
            start = at + len(own)
        words += own
    if not spans and 0 < len(words) < s.passage:
        spans.append((0, len(words)))
    return words, spans


_SPANS = pa.schema([("doc_id", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("key", pa.int64()), ("check", pa.int32())])
_BANDS = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("apart", pa.int32()), ("bands", pa.list_(pa.int64()))])
#: Keys a task remembers, to send a repeated paragraph's bands or shingles once.
REMEMBERED = 200_000
#: Longs of a parity sketch. More refuse more unrelated pairs of long lines; results are the same.
SKETCH_WORDS = 4
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
#: Keys of a band's part: fuller bands are compared in several parts.
PART = 4096
#: Bytes of text that a task cuts at once.
SLICE = 1 << 20
#: Paragraphs whose sketches are counted at once.
COUNTED = 1024


@dataclass
class Cut:
    """Paragraphs of some texts: number of the text, word range in it, range in `shingles`, and
    two columns of keys, hashes of the paragraph's words."""

    shingles: np.ndarray
    text: np.ndarray
    words: np.ndarray
    at: np.ndarray
    keys: np.ndarray


def cut(texts: list[str | None], s: ParagraphSettings) -> Cut:
    words, bounds, spans = [], [0], []
    for text in texts:
        own, lines = spans_of(text, s)
        spans += [(bounds[-1] + a, bounds[-1] + e) for a, e in lines]
        words += own
        bounds.append(len(words))
    bounds, hashes = np.array(bounds), word_hashes(words)
    starts = _starts(hashes, bounds, s)
    ends = np.array(spans, dtype=np.int64).reshape(-1, 2)
    ends = np.concatenate((ends, np.stack((starts, starts + s.stretch), axis=1)))
    ends = np.unique((ends[:, 0] << 32) | ends[:, 1])
    ends = np.stack((ends >> 32, ends & 0xFFFFFFFF), axis=1)
    text = np.searchsorted(bounds, ends[:, 0], side="right") - 1
    shingles = run_hashes(np.append(hashes, np.zeros(s.k, np.uint64)), s.k)
    at = ends - np.array([0, s.k - 1])
    short = np.flatnonzero(ends[:, 1] - ends[:, 0] < s.k)  # their words are one shingle, behind the others
    if len(short):
        at[short] = len(shingles) + np.arange(len(short))[:, None] + np.array([0, 1])
        shingles = np.concatenate([shingles, *(run_hashes(hashes[a:e], e - a) for a, e in ends[short].tolist())])
    keys = []
    for salt in (8, 9):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingles, salt), dtype=np.uint64)))
        keys.append(mix(total[at[:, 1]] - total[at[:, 0]], 6))
    return Cut(shingles, text, ends - bounds[text][:, None], at, np.stack(keys, axis=1))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // SLICE)) + 1
        for a, e in itertools.pairwise([0, *ends.tolist(), b.num_rows]):
            yield b.slice(a, e - a)


def _bands(c: Cut, chosen: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash bands of the chosen paragraphs, a row each."""
    padded, at, out = np.append(c.shingles, np.uint64(0)), c.at[chosen].ravel(), []
    for band in range(bands):
        total = np.full(len(chosen), band, dtype=np.uint64)
        for r in range(rows if len(chosen) else 0):
            least = np.minimum.reduceat(padded * multiplier(1000 + band * rows + r), at)[::2]
            total = mix(total * np.uint64(31) + least, 5)
        out.append(total)
    return np.stack(out, axis=1).view(np.int64)


def _news(
    c: Cut, rows: np.ndarray, done: dict[int, int | None], again: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, last, end, fresh): keys that were not met yet (fresh), or in one other row only, each once a text.

    With the place of one of its paragraphs come the last start and the first end of all that the
    text has of the key. `done` holds the only row of a key so far, None after a second one. With
    `again`, texts that repeat the only row so far count, too.
    """
    order = np.lexsort((c.text, c.keys[:, 0]))
    key, text = c.keys[order, 0], c.text[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))[: len(order)])
    if not len(first):
        return (*(np.empty(0, np.int64),) * 3, np.empty(0, bool))
    last = np.maximum.reduceat(c.words[order, 0], first)
    end = np.minimum.reduceat(c.words[order, 1], first)
    new, fresh = [], []
    for i, (name, row) in enumerate(zip(key[first].tolist(), rows[text[first]].tolist())):
        if name not in done:
            new.append(i)
            fresh.append(True)
            if len(done) < REMEMBERED:
                done[name] = row
        elif done[name] is not None and (again or done[name] != row):
            new.append(i)
            fresh.append(False)
            if done[name] != row:
                done[name] = None
    new = np.array(new, dtype=np.int64)
    place = order[first[new]]
    by = np.argsort(place)
    return place[by], last[new][by], end[new][by], np.array(fresh, dtype=bool)[by]


def _lie_apart(text: np.ndarray, band: np.ndarray, last: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each paragraph: do some of its text's paragraphs with the same band lie apart?"""
    if not len(text):
        return np.zeros(0, dtype=bool)
    order = np.lexsort((band, text))
    new = np.append(True, (text[order][1:] != text[order][:-1]) | (band[order][1:] != band[order][:-1]))
    first = np.flatnonzero(new)
    apart = np.maximum.reduceat(last[order], first) >= np.minimum.reduceat(end[order], first)
    out = np.empty(len(text), dtype=bool)
    out[order] = apart[np.cumsum(new) - 1]
    return out


def _occurrences(docs: DataFrame, s: ParagraphSettings) -> DataFrame:
    """doc_id, from, to (words), and key and check (hashes of the words) of each paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            c = cut(b.column("text").to_pylist(), s)
            yield batch_of(
                _SPANS, b.column("doc_id").to_numpy()[c.text], c.words[:, 0].astype(np.int32), c.words[:, 1].astype(np.int32),
                c.keys[:, 0].copy().view(np.int64), c.keys[:, 1].astype(np.uint32).view(np.int32),
            )

    return map_batches(docs, run, "doc_id long, from int, to int, key long, check int")


def _banded(docs: DataFrame, s: ParagraphSettings) -> DataFrame:
    """key, row, apart and bands of each key, and again if a task meets it in a second row.

    Bit i of apart tells whether the row has paragraphs of the same band i that lie apart.
    """
    bands, rows = tuned_bands(s.percent, s.recall, s.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int | None] = {}
        for b in _slices(batches):
            c, row = cut(b.column("text").to_pylist(), s), b.column("row").to_numpy()
            new, last, end, _ = _news(c, row, done)
            made, apart = _bands(c, new, bands, rows), np.zeros(len(new), dtype=np.int32)
            for i in range(bands):
                apart |= _lie_apart(c.text[new], made[:, i], last, end).astype(np.int32) << i
            lists = pa.ListArray.from_arrays(np.arange(0, made.size + 1, bands, dtype=np.int32), made.ravel())
            yield batch_of(_BANDS, c.keys[new, 0].copy().view(np.int64), row[c.text[new]], apart, lists)

    read = docs.select("text", F.monotonically_increasing_id().alias("row"))
    return map_batches(read, run, "key long, row long, apart int, bands array<long>")


def _buckets(banded: DataFrame) -> DataFrame:
    """(band, key, rank, size): keys of bands that hold several, numbered within the band, and how many they are.

    A band whose keys all stand in one and the same row, and do not lie apart there, links nothing
    and is left out. The paragraphs of a row and band have the same mark.
    """
    order, whole = Window.partitionBy("band").orderBy("key"), Window.partitionBy("band")
    sent = banded.select("key", "row", "apart", F.posexplode("bands").alias("i", "band"))
    marked = sent.select("band", "key", F.expr("row * 2 + (shiftright(apart, i) & 1)").alias("mark"))
    rows = marked.select(
        "band", "key", F.dense_rank().over(order).alias("rank"), F.lag("key").over(order).alias("before"),
        F.max("key").over(whole).alias("last"), F.min("mark").over(whole).alias("a"), F.max("mark").over(whole).alias("b"),
    )
    several = "(rank > 1 or key < last) and (a < b or b % 2 = 1)"
    sized = rows.where(several).withColumn("size", F.max("rank").over(whole))
    return sized.where("before is null or before < key").select("band", "key", "rank", "size")


def _sets(shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, sketches and, one after the other, sorted distinct elements of ranges of `shingles`.

    A sketch is the parity of the number of elements that hash to each of its bits.
    """
    sizes = at[:, 1] - at[:, 0]
    owner = np.repeat(np.arange(len(at)), sizes)
    elements = shingles[np.arange(len(owner)) + np.repeat(at[:, 0] - np.cumsum(sizes) + sizes, sizes)]
    elements = elements[np.lexsort((elements, owner))]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
    elements, owner = elements[first], owner[first]
    sizes, bits, sketches = np.bincount(owner, minlength=len(at)), SKETCH_WORDS * 64, []
    place = owner * bits + (mix(elements, 4) % np.uint64(bits)).astype(np.int64)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    for a in range(0, len(at), COUNTED):
        e = min(a + COUNTED, len(at))
        counts = np.bincount(place[ends[a] : ends[e]] - a * bits, minlength=(e - a) * bits)
        sketches.append(np.packbits((counts & 1).astype(np.uint8)).view(np.int64).reshape(-1, SKETCH_WORDS))
    return sizes, np.concatenate(sketches) if sketches else np.zeros((0, SKETCH_WORDS), np.int64), elements


def _shingles_of(docs: DataFrame, keys: DataFrame, s: ParagraphSettings) -> DataFrame:
    """(key, doc_id, last, end, n, s0.., elements): places, size, parity sketch and shingle set of each of
    `keys`, and perhaps of others.

    A task gives the set with one document of a key; if there is a second one, it comes without a
    set. The wide column stays where it is written until a pair of keys has passed the sketches.
    """
    bits = docs.sparkSession.sparkContext.broadcast(build_filter(keys, "key", keys.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int | None] = {}
        for b in _slices(batches):
            c = cut(b.column("text").to_pylist(), s)
            met = np.flatnonzero(may_hold(bits.value, c.keys[:, 0].copy()))
            c = Cut(c.shingles, c.text[met], c.words[met], c.at[met], c.keys[met])
            doc = b.column("doc_id").to_numpy()
            place, last, end, fresh = _news(c, doc, done, again=True)
            for own in (fresh, ~fresh):
                m = place[own]
                if own is fresh:
                    sizes, sketches, elements = _sets(c.shingles, c.at[m])
                    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes))) * 8
                    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(elements)]
                    made = [pa.array(sizes), *map(pa.array, sketches.T.copy()), pa.BinaryArray.from_buffers(pa.binary(), len(m), buffers)]
                else:
                    made = [*(pa.nulls(len(m), pa.int64()) for _ in ["n", *SKETCH]), pa.nulls(len(m), pa.binary())]
                columns = [c.keys[m, 0].copy().view(np.int64), doc[c.text[m]], last[own], end[own]]
                names = ["key", "doc_id", "last", "end", "n", *SKETCH, "elements"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *made], names=names)

    kind = f"key long, doc_id long, last long, end long, n long, {', '.join(f'{c} long' for c in SKETCH)}, elements binary"
    return stored(map_batches(docs, run, kind))


def _sketches(sets: DataFrame) -> DataFrame:
    """(key, n, s0.., least, most, last, end): with smallest and largest document, last start and first end.

    Of two keys of one and the same document, some occurrences lie apart if and only if the last
    start of one is not before the first end of the other.
    """
    return sets.groupBy("key").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ["n", *SKETCH]],
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("last").alias("last"), F.min("end").alias("end"),
    )


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the bands whose keys are not in one component yet, with label and the band's size."""
    named = buckets.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    open_ = named.groupBy("band").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.max("rank").alias("size")
    ).where("a < b")
    return stored(named.join(open_.select("band", "size"), "band"))


def _met(active: DataFrame, sketches: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """(u, v): keys of ranks low..high-1 with later keys of their band that may be similar.

    Sizes, labels, places and sketches are compared within the join, so no other pair leaves
    it. A full band is dealt to several tasks: its later keys by rank, its first keys to each.
    """
    parts = F.ceil(F.col("size") / PART).cast("int")
    with_bits = active.where(F.col("size") > low).withColumn("parts", parts).join(sketches, "key")
    first = with_bits.where((F.col("rank") >= low) & (F.col("rank") < high)).select(
        "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias("u"),
        F.col("n").alias("nu"), F.col("rank").alias("ru"), F.col("label").alias("lu"), F.col("least").alias("au"),
        F.col("most").alias("bu"), F.col("last").alias("last_u"), F.col("end").alias("end_u"), *[F.col(c).alias("u" + c) for c in SKETCH],
    )
    later = with_bits.where(F.col("rank") > low).withColumn("part", (F.col("rank") % F.col("parts")).cast("int"))
    unlike = sum((F.bit_count(F.col(c).bitwiseXOR(F.col("u" + c))) for c in SKETCH), F.lit(0))
    return first.join(later, ["band", "part"]).where(
        (F.col("rank") > F.col("ru")) & (F.col("label") != F.col("lu"))
        & ((F.least("least", "au") < F.greatest("most", "bu")) | (F.col("last") >= F.col("end_u")) | (F.col("last_u") >= F.col("end")))
        & (F.least("n", "nu") * 100 >= F.greatest("n", "nu") * percent)
        & (unlike * (100 + percent) <= (F.col("n") + F.col("nu")) * (100 - percent))
    ).select("u", F.col("key").alias("v")).distinct()


def _labels(active: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, label) of all paragraphs that are linked to another, label the component's least key.

    In each band the keys of the first ranks are compared with all later keys of other
    components, then the next ranks, eight times as many, and so on, until the band is one
    component or all pairs across are tested. Keys found linked need no comparison with each
    other, so a band of near copies costs its size, not its square.
    """
    links = tested = labels = None
    low, high = 1, 2
    while True:
        pairs = _met(active, sketches, low, high, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = stored(pairs)
        if not pairs.isEmpty():
            found = stored(_similar(pairs, sets, percent))
            tested = pairs if tested is None else tested.unionByName(pairs)
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                labels = components(links).withColumnRenamed("node", "key")
                # all pairs of a band of `high` keys are tested
                old, active = active, _open(active.where(F.col("size") > high).drop("label", "size"), labels)
                release(old)
        low, high = high, high * 8
        last = active.agg(F.max("rank")).first()[0]
        if last is None or last <= low:
            break
    return sets.sparkSession.createDataFrame([], "key long, label long") if labels is None else labels


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("eu"), b.column("ev")):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    own = sets.where("elements is not null").select("key", "elements").join(asked, "key", "left_semi").groupBy("key").agg(F.first("elements").alias("elements"))
    left, right = (own.select(F.col("key").alias(n), F.col("elements").alias("e" + n)) for n in "uv")
    return map_batches(pairs.join(right, "v").join(left, "u").select("u", "v", "eu", "ev"), run, "u long, v long")


def repeated_paragraphs(docs: DataFrame, settings: ParagraphSettings = ParagraphSettings()) -> DataFrame:
    """Paragraphs of `docs` (doc_id, text) that stand in several documents, equal or nearly so.

    One row per occurrence: doc_id, from_word, to_word, cluster_id, keep_doc_id, n_copies, removed.
    Clusters are components of paragraphs whose shingle sets reach the
    similarity; the occurrences in the document with the smallest id stay, the others are
    removed. Documents without repeated paragraphs have no row.

    Null and empty texts have no paragraphs; a text of few words, or of short lines between blank
    ones, is one paragraph. Rows that repeat a doc_id count as one document, rows without doc_id as
    none: they neither make a paragraph repeated nor are in the result. Further columns are ignored;
    an empty table gives an empty result. Equal paragraphs need no band to meet; of unequal ones at
    the threshold, `recall` share a band, and all that share one are compared. Paragraphs that
    only stand in one and the same document and overlap in all their occurrences are not linked to
    each other; word numbers tell that, also if several rows have the doc_id.
    """
    s = settings
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = stored(_buckets(_banded(docs, s)))
    release()
    sets = _shingles_of(docs, buckets.select("key").distinct(), s)
    sketches = stored(_sketches(sets))
    labels = stored(_labels(buckets.withColumn("label", F.col("key")), sketches, sets, s.percent))
    release(sets, sketches)
    spans = stored(_occurrences(docs, s))
    classes = spans.groupBy("key", "check").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    named = stored(
        classes.join(labels, "key", "left")
        .where("least < most or label is not null").withColumn("label", F.coalesce("label", "key"))
    )
    clusters = named.groupBy("label").agg(
        F.sum("n").alias("n_copies"), F.min("least").alias("keep_doc_id"), F.max("most").alias("most")
    ).where("keep_doc_id < most").drop("most")
    known = stored(named.select("key", "check", "label").join(clusters, "label"))
    return spans.join(known, ["key", "check"]).select(
        "doc_id", F.col("from").alias("from_word"), F.col("to").alias("to_word"), F.col("label").alias("cluster_id"),
        "keep_doc_id", "n_copies", (F.col("doc_id") != F.col("keep_doc_id")).alias("removed"),
    )


def cut_paragraphs(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """`docs` with the removed word ranges cut out of their texts; all columns stay.

    Words keep the white space before them; a text without removals is returned as it is.
    """
    removed = repeated.where("removed").groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.struct("from_word", "to_word")).alias("_cut")
    )
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    left = F.filter(
        words, lambda w, i: ~F.exists("_cut", lambda c: (i >= c["from_word"]) & (i < c["to_word"]))
    )
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(left, ""))
    return docs.join(removed, F.col("doc_id") == F.col("_id"), "left").withColumn("text", text).select(*docs.columns)
