"""Substring dedup: MinHash banding of content-defined paragraphs, exact Jaccard, components of removals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks
from tessera.llm.arrowtext import Words, mix, pieces, words
from tessera.llm.arrowtext import _power as power
from tessera.llm.packed import DEALT, HELD, buckets_of, deal, pack, steady, together, trim, unpack
from tessera.llm.shared import bounded, components, discard, map_arrow, materialize, small_batches, tidy

#: Bands and rows of a band: at a similarity of 0.8, 1 - (1 - 0.8 ** 3) ** 6 = 0.986 of pairs meet; a passage has several paragraphs.
BANDS, ROWS = 6, 3
#: A word pair starts a paragraph if its hash is the least among so many on either side in its line.
REACH = 24
#: Words of an anchor; of every WINDOW (a power of two) runs of GRAM words one is an anchor, so texts that share GRAM + WINDOW - 1 = 40 words share one.
GRAM, WINDOW = 9, 32
#: Keys of exact spans are kept apart from those of paragraphs, which may stand at the same words.
EXACT = 0x2545F4914F6CDD1D

_LONGS = lambda *names: T.StructType([T.StructField(c, T.LongType()) for c in names])
PARAGRAPHS = _LONGS("row", "first_word", "n_words", "key")
#: Packed by slice of texts: row, first_word, n_words, key and n of paragraphs; which of them have bands, and those.
UNITS = T.StructType([T.StructField(c, T.BinaryType()) for c in ("units", "bands")])
EDGES = _LONGS("a", "b", "n", "row")
ANCHORS = _LONGS("row", "at", "key", "begin", "left", "end", "right")
#: A class that one task can't tell alone: its places, and what each task knows of it.
PLACES, KNOWN = _LONGS("row", "place", "key"), _LONGS("key", "class", "r", "s")
#: Kinds of packed values: places, hot keys, places of hot keys, and classes; then hits, places of other classes, and those.
PLACE, HOT_KEY, HOT_PLACE, CLASS = range(4)
HIT, OPEN, TOLD = range(3)
#: Places of a key, of those that a task holds, beyond which they aren't dealt out by key.
HOT = 256
#: A place is the first word, two flags (the text isn't the class's first; the class is in several texts) and the number of words.
OTHER, MANY, N_WORDS = 1 << 31, 1 << 30, (1 << 30) - 1
PASSAGES = T.StructType([*(T.StructField(c, T.LongType()) for c in ("row", "first_word", "n_words", "n_paragraphs", "component_id")), T.StructField("removed", T.BooleanType())])
MEMBERS = ("key", "root", "n", "copies", "i", "j", "side")
GROUPS = T.StructType([*(T.StructField(c, T.IntegerType() if c in ("i", "j", "side") else T.LongType()) for c in MEMBERS), T.StructField("tokens", T.BinaryType())])


def _least_around(h: np.ndarray, reach: int) -> np.ndarray:
    """True where a value is less than the ``reach`` before it and at most the ``reach`` after it; ends of h don't count as such."""
    n, top = len(h), np.uint64(0xFFFFFFFFFFFFFFFF)
    least, width = np.concatenate([np.full(reach, top), h, np.full(reach, top)]), 1
    while width < reach:  # the least of so many from each place on
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (h < least[:n]) & (h <= least[reach + 1 : reach + 1 + n])


def paragraphs(part: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds [begin, end), in words of ``part``, of the paragraphs with at least ``least`` words.

    A paragraph starts at each line, and inside a line where the hash of a word
    and the next one is the least around: a passage that is copied into another
    text is cut at the same words there, wherever it begins.
    """
    n = len(part.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.cumsum(part.data == 10) if len(part.data) else np.zeros(0, np.int64)
    line = np.zeros(n, bool)
    line[0] = True
    line[1:] = (part.text[1:] != part.text[:-1]) | (breaks[part.start[1:]] != breaks[part.start[:-1]])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    pair = np.full(n, top)
    pair[:-1] = mix(part.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + part.hash[1:])
    pair[:-1][line[1:]] = top  # the last word of a line has no pair
    # Lines are kept apart by so many greatest values.
    number = np.cumsum(line) - 1
    at = np.arange(n) + number * REACH
    spread = np.full(int(at[-1]) + 1, top)
    spread[at] = pair
    cut = line | (_least_around(spread, REACH)[at] & (pair != top))
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], n)
    long = end - begin >= least
    return begin[long], end[long]


def spans_of(part: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of what is compared as a whole: content-defined paragraphs, lines, and paragraphs between blank lines."""
    n = len(part.hash)
    begin, end = paragraphs(part, least)
    if not n:
        return begin, end
    breaks = np.cumsum(part.data == 10)[part.start]
    found = [begin << 32 | end]
    for apart in (1, 2):
        first = np.flatnonzero(np.append(True, (part.text[1:] != part.text[:-1]) | (np.diff(breaks) >= apart)))
        last = np.append(first[1:], n)
        found.append((first << 32 | last)[last - first >= least])
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def anchors(part: Words) -> np.ndarray:
    """First words of the anchors: of each WINDOW neighbouring runs of GRAM words in a text, over line ends, the first of least hash."""
    n = len(part.hash)
    at = np.arange(n)
    left = np.cumsum(part.count)[part.text] - at if n else at
    at, left = at[left >= GRAM], left[left >= GRAM]
    if not len(at):
        return at
    # Texts are kept apart by so many greatest values.
    value = np.full(n + len(part) * WINDOW + WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
    place = np.zeros(len(value), np.int64)
    spread = at + part.text[at] * WINDOW
    value[spread], place[spread] = mix(_keys(part, at, at + GRAM).view(np.uint64) ^ np.uint64(EXACT)), at
    step = 1
    while step < WINDOW:
        less = value[step:] < value[:-step]
        value, place = np.where(less, value[step:], value[:-step]), np.where(less, place[step:], place[:-step])
        step *= 2
    starts = (left >= GRAM + WINDOW - 1) | (part.count[part.text[at]] == left)
    return np.unique(place[spread[starts]])


def _keys(part: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit key of each paragraph's words in order."""
    n = len(part.hash)
    total = np.concatenate([[np.uint64(0)], np.cumsum(part.hash * power("up", n), dtype=np.uint64)])
    return mix((total[end] - total[begin]) * power("down", n + 1)[begin] + (end - begin).astype(np.uint64)).view(np.int64)


def _shingle_runs(part: Words, begin: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, those that each paragraph holds, and where each paragraph's begin; every one has k words or more."""
    h = part.hash
    whole = h.copy()
    for j in range(1, k):
        whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([h[j:], np.zeros(j, np.uint64)]))
    size = end - begin - k + 1
    starts = np.cumsum(size) - size
    return whole, np.repeat(begin - starts, size) + np.arange(int(size.sum())), starts


def _distinct(part: Words, whole: np.ndarray, begin: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs stand first in their paragraph, by where each run stood last, and how many do."""
    key = whole ^ mix(part.text.astype(np.uint64))
    order = np.argsort(key)
    twice = np.append(False, key[order[1:]] == key[order[:-1]])
    order = np.sort(order[twice | np.append(twice[1:], False)])  # most runs stand once
    order = order[np.argsort(key[order], kind="stable")]
    before = np.full(len(key), -1, np.int64)
    same = key[order[1:]] == key[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    size = np.diff(np.append(starts, len(at)))
    first = before[at] < np.repeat(begin, size)
    return first, np.add.reduceat(first, starts, dtype=np.int64)


def _scan(docs: DataFrame, columns: list, schema: T.StructType, of: Callable, least: int, bounds: Callable = spans_of) -> DataFrame:
    """of(part, begin, end, batch) gives arrays of the schema's columns, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for batch in (x for b in batches for x in pieces(b)):
            for part in words(batch.column(batch.num_columns - 1), lower=True):
                begin, end = bounds(part, least)
                if len(begin):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in of(part, begin, end, batch)], names=schema.fieldNames())
        trim()

    return map_arrow(docs.select(*columns), run, schema)


def unit_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(units, bands): each paragraph's place, key and distinct shingles, and hashes of its MinHash bands, packed.

    Bands are left out where a slice of texts has the paragraph a second time,
    and of sets so small that one shingle more is too much a difference: those
    link with none that has other shingles.  Runs are hashed well already, so
    odd factors tell the orders apart in which a MinHash is the least.
    """
    salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)

    def of(part: Words, begin: np.ndarray, end: np.ndarray, batch: pa.RecordBatch):
        own = part.text[begin]
        key = _keys(part, begin, end)
        first = np.unique(key, return_index=True)[1]
        first = np.sort(first[(end - begin)[first] - k + 1 >= percent / (100 - percent)])
        n = np.zeros(len(key), np.int64)
        banded = np.zeros((1 + BANDS, 0), np.int64)
        if len(first):
            whole, at, starts = _shingle_runs(part, begin[first], end[first], k)
            n[first] = _distinct(part, whole, begin[first], at, starts)[1]
            bands = np.empty((len(first), BANDS), np.uint64)
            ranges = np.stack([begin[first], end[first] - k + 1], 1).reshape(-1)  # every other range is a paragraph's
            whole = np.append(whole, np.uint64(0))
            for b in range(BANDS):
                value = np.full(len(first), np.uint64(b + 1))
                for r in range(ROWS):
                    value = mix(value + np.minimum.reduceat(whole * salts[b * ROWS + r], ranges)[::2])
                bands[:, b] = value
            some = n[first] * (100 - percent) >= percent
            banded = np.concatenate([first[some][None, :], bands[some].T.view(np.int64)])
        row = batch.column(0).to_numpy(zero_copy_only=False)[own + part.first]
        places = pack([row, begin - (np.cumsum(part.count) - part.count)[own], end - begin, key, n])
        return pa.array([places], pa.binary()), pa.array([banded.tobytes()], pa.binary())

    return _scan(docs, ["row", "text"], UNITS, of, k)


def deal_places(parts: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Places (row, first_word, n_words, key), dealt out by key; of keys with many places here, one row by key, and the places elsewhere."""

    def flush(values: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, first, n, key = values
        place = (first << 32) | n
        bin = (key.view(np.uint64) >> np.uint64(44)).astype(np.int64)
        hot = (np.bincount(bin, minlength=1 << 20) > HOT)[bin]
        if hot.any():
            found, count = np.unique(key[hot], return_counts=True)
            hot &= np.isin(key, found[count > HOT])
        if hot.any():
            order = np.flatnonzero(hot)[np.argsort(key[hot], kind="stable")]
            r, p, k = row[order], place[order], key[order]
            begins = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            ends = [f.reduceat(x, begins) for x in (r, p) for f in (np.minimum, np.maximum)]
            yield from deal(k[begins], [k[begins], *ends], buckets, HOT_KEY)
            yield from deal(mix(p.view(np.uint64) + mix(r.view(np.uint64))), [r, p, k], buckets, HOT_PLACE)
            row, place, key = row[~hot], place[~hot], key[~hot]
        yield from deal(key, [row, place, key], buckets, PLACE)

    steady()
    held, many = [], 0
    for values in parts:
        held.append(values)
        many += values.shape[1]
        if many >= HELD:
            yield from flush(np.concatenate(held, axis=1))
            held, many = [], 0
    if many:
        yield from flush(np.concatenate(held, axis=1))
    trim()


def unit_places(units: DataFrame) -> DataFrame:
    """The places of what ``unit_rows`` packs, dealt out by key."""
    buckets = buckets_of(units.sparkSession)
    return map_arrow(units.select("units"), lambda batches: deal_places((x[:4] for b in batches for x in unpack(b.column(0), 5)), buckets), DEALT)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns]) if batch.num_rows else np.zeros((batch.num_columns, 0), np.int64)


def joined(values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (band, key, n, row): edges (a, b, n and row of a) from paragraphs to the least of their band and class of sizes, those least ones and their classes, and which rows have a band of their own.

    The least of several is an edge to itself, which tells its n and row.
    """
    order = np.argsort(values[0])
    band = values[0][order]
    twice = np.zeros(len(band) + 1, bool)
    twice[1:-1] = band[1:] == band[:-1]
    order = order[twice[1:] | twice[:-1]]
    alone = np.ones(len(band), bool)
    alone[order] = False
    some = values[:, order]
    size = np.floor(np.log(np.maximum(some[2], 1)) / np.log(100.01 / percent)).astype(np.int64)
    order = np.lexsort((some[3], some[1], size, some[0]))
    some, size = some[:, order], size[order]
    new = np.append(True, (some[0, 1:] != some[0, :-1]) | (size[1:] != size[:-1]))[: len(size)]
    least = some[:, new]
    root = least[1][np.cumsum(new) - 1]
    different = new | np.append(True, some[1, 1:] != some[1, :-1])[: len(new)]  # copies of a paragraph are one
    many = (np.add.reduceat(different, np.flatnonzero(new), dtype=np.int64) > 1)[np.cumsum(new) - 1] if len(new) else new
    edge = different & many
    return np.stack([some[1], root, some[2], some[3]])[:, edge], least, size[new], alone


def _once(edges: np.ndarray) -> np.ndarray:
    return edges[:, np.unique(mix(edges[0].view(np.uint64)) + edges[1].view(np.uint64), return_index=True)[1]]


def candidates(units: DataFrame, percent: int) -> DataFrame:
    """(key, root, n, row): paragraphs joined by bands they share, the least one of their component, their distinct shingles, and a text that has them.

    Paragraphs that link have sizes within ``percent`` of each other, so a band
    joins those of one class of sizes, and classes that are neighbours: a line
    and a half of it stay apart.  Each task joins what it holds to the least
    paragraph of a band and class and deals out that alone, so copies and
    bands that very many paragraphs have cost a row a task.
    """
    spark = units.sparkSession
    buckets = buckets_of(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        held, many = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            some = np.concatenate(held, axis=1)
            held.clear()
            values = np.stack([some[3:].reshape(-1), *(np.tile(x, BANDS) for x in some[:3])])
            edges, least, _, alone = joined(values, percent)
            edges, least = _once(edges), np.concatenate([values[:, alone], least], axis=1)
            yield from deal(mix(edges[0].view(np.uint64)), list(edges), buckets, 1)
            yield from deal(least[0], list(least), buckets)

        for batch in batches:
            for places, bands in zip(unpack(batch.column(0), 5), unpack(batch.column(1), 1 + BANDS), strict=True):
                at = bands[0]
                held.append(np.concatenate([places[3:5, at], places[:1, at], bands[1:]]))
                many += len(at) * BANDS
                if many >= HELD:
                    yield from flush()
                    many = 0
        if many:
            yield from flush()
        trim()

    def work(values: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges, least, size, _ = joined(values[0], percent)
        near = np.flatnonzero((least[0, 1:] == least[0, :-1]) & (size[1:] == size[:-1] + 1) & (least[1, 1:] != least[1, :-1]))
        across = [np.stack([least[1][x], least[1][y], least[2][x], least[3][x]]) for x, y in ((near, near + 1), (near + 1, near))]
        edges = _once(np.concatenate([values[1], edges, *across], axis=1))
        if edges.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges], names=EDGES.fieldNames())

    edges = materialize(together(map_arrow(units, run, DEALT), work, {0: 4, 1: 4}, EDGES), "paragraph-edges", few=True)
    tidy(spark)
    near = components(edges.select("a", "b"), "paragraph-candidates").withColumnRenamed("node", "key")
    # Each paragraph's set is read from one text that has it.
    near = materialize(near.join(edges.groupBy(F.col("a").alias("key")).agg(F.min("n").alias("n"), F.min("row").alias("row")), "key"), "paragraph-parts", few=True)
    discard(edges)
    tidy(spark)
    return near


def exact_spans(docs: DataFrame) -> DataFrame:
    """Places, dealt out by key: spans of docs (row, text) that cover all that repeats exactly in GRAM + WINDOW - 1 words or more.

    Of WINDOW neighbouring runs of GRAM words in such a passage, one is an
    anchor (``anchors``) at all its places, so WINDOW words to both sides of the
    anchors cover it.  A side is a span.  Where an anchor that repeats has
    different sides, each run of GRAM words in them is one too, at the first
    place of each different side and no other: later places repeat that side.
    Anchors with the same sides at all their places give one span, to the right,
    which holds them; so do those with one place, whose spans repeat nowhere.
    """

    def bounds(part: Words, _: int) -> tuple[np.ndarray, np.ndarray]:
        at = anchors(part)
        return at, at + GRAM

    def of(part: Words, begin: np.ndarray, end: np.ndarray, batch: pa.RecordBatch):
        own, salt = part.text[begin], np.int64(EXACT)  # sides have salts of their own: two may be the same words
        last = np.cumsum(part.count)[own]
        zero = last - part.count[own]
        low, high = np.maximum(zero, begin - WINDOW), np.minimum(last, end + WINDOW)
        at = pa.array(own + part.first)
        return batch.column(0).take(at), begin - zero, _keys(part, begin, end) ^ salt, low - zero, _keys(part, low, end) ^ ~salt, high - zero, _keys(part, begin, high) ^ (salt >> 1)

    buckets = buckets_of(docs.sparkSession)
    table = materialize(_scan(docs, ["row", "text"], ANCHORS, of, 0, bounds), "anchors")
    tidy(docs.sparkSession)
    # Most anchors have the same sides everywhere; only the others are told apart further.
    sign = F.xxhash64("left", "right").bitwiseAND(0x7FFFFFFF).cast("int")
    differ = table.select("key", sign.alias("p")).groupBy("key").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("key", F.lit(True).alias("differ"))
    table = table.join(bounded(materialize(differ, "anchors-differ", few=True), 500_000), "key", "left").withColumn("differ", F.coalesce("differ", F.lit(False)))
    sides = table.where("differ").select("key", F.expr("""inline(array(
        struct(0 as side, left as next, struct(row, at, begin as low, at - 1 as high) as place),
        struct(1 as side, right as next, struct(row, at, at + 1 as low, end as high) as place)))"""))
    ends = sides.groupBy("key", "side", "next").agg(F.min("place").alias("place")).select("place.*")
    ends = materialize(ends.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "anchor-ends", few=True)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in (x for b in batches for x in pieces(b)):
            need = batch.column(1)
            ends, low, high = need.offsets.to_numpy().astype(np.int64), *(need.values.field(c).to_numpy() for c in ("low", "high"))
            for part in words(batch.column(2), lower=True):
                x, y = ends[part.first], ends[part.first + len(part)]
                text = np.repeat(np.arange(len(part)), np.diff(ends[part.first : part.first + len(part) + 1]))
                zero = np.cumsum(part.count) - part.count
                begin, last = low[x:y], np.minimum(high[x:y], part.count[text] - GRAM)
                size = np.maximum(last + 1 - begin, 0)
                begin = np.unique(np.repeat(begin + zero[text] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
                own = part.text[begin]
                row = batch.column(0).to_numpy(zero_copy_only=False)[own + part.first]
                yield np.stack([row, begin - zero[own], np.full(len(begin), GRAM), _keys(part, begin, begin + GRAM) ^ np.int64(EXACT)])

    inner = docs.join(bounded(ends), "row").select("row", "ranges", "text")
    inner = map_arrow(inner, lambda batches: deal_places(grams(batches), buckets), DEALT)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            row, at, key, begin, left, end, right = _columns(batch.select(ANCHORS.fieldNames()))
            yield np.stack([row, at, end - at, right])
            both = batch.column("differ").to_numpy(zero_copy_only=False)
            yield np.stack([row, at, np.full(len(row), GRAM), key])[:, both]
            # A left side is needed at the start of a text only: else the right side of an anchor before covers what is equal.
            yield np.stack([row, begin, at + GRAM - begin, left])[:, (begin == 0) & (at > 0)]

    return map_arrow(table.select(*ANCHORS.fieldNames(), "differ"), lambda batches: deal_places(spans(batches), buckets), DEALT).unionAll(inner)


def repeats(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, place, class) of all places whose class is found again, dealt out by row to a bucket a shuffle partition.

    found: dealt places; classes: (key, class) of keys that are linked.  A key's
    places come together in one task, except those of hot keys; theirs, and
    those of linked keys, are told apart by a join when all is known of them.
    Each task packs rows for all texts, so what it finds goes to fewer buckets
    than there are tasks: their number squared would be that of the packed rows.
    """
    buckets, fewer = buckets_of(found.sparkSession), buckets_of(found.sparkSession, 1)

    def of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in map(_columns, batches):
            yield from deal(values[0], list(values), buckets, CLASS)

    def work(values: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        row, place, key = values[PLACE][:, np.argsort(values[PLACE][2])]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        begins, which = np.flatnonzero(new), np.cumsum(new) - 1
        r, s, a, b = (f.reduceat(x, begins) for x in (row, place) for f in (np.minimum, np.maximum))
        keys, hot = key[begins], values[HOT_KEY]
        linked = values[CLASS][:, np.argsort(values[CLASS][0])]
        special = np.isin(keys, linked[0]) | np.isin(keys, hot[0])
        plain = (~special & ((r != s) | (a != b)))[which]
        own = which[plain]
        hits = place[plain] | np.where(row[plain] != r[own], OTHER, 0) | np.where(r[own] != s[own], MANY, 0)
        yield from deal(mix(row[plain].view(np.uint64)), [row[plain], hits, key[plain]], fewer, HIT)
        rest = np.concatenate([np.stack([row, place, key])[:, special[which]], values[HOT_PLACE]], axis=1)
        yield from deal(rest[2], list(rest), 1, OPEN)
        told = np.concatenate([np.stack([keys, r, s])[:, special], hot[:3]], axis=1)
        group = told[0].copy()
        if linked.shape[1]:
            at = np.minimum(np.searchsorted(linked[0], group), linked.shape[1] - 1)
            group = np.where(linked[0][at] == group, linked[1][at], group)
        yield from deal(told[0], [told[0], group, *told[1:]], 1, TOLD)

    def rows(kind: int, schema: T.StructType) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for values in unpack(batch.column(0), len(schema)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=schema.fieldNames())

        return map_arrow(table.where(F.col("kind") == kind).select("packed"), run, schema)

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in map(_columns, batches):
            yield from deal(mix(values[0].view(np.uint64)), list(values), fewer, HIT)

    table = found.unionAll(map_arrow(classes, of_class, DEALT))
    table = materialize(together(table, work, {PLACE: 3, HOT_KEY: 5, HOT_PLACE: 3, CLASS: 2}, DEALT), "passage-hits", large_rows=True)
    tidy(found.sparkSession)
    told = materialize(rows(TOLD, KNOWN).groupBy("key", "class").agg(F.min("r").alias("r"), F.max("s").alias("s")), "passage-told", few=True)
    firsts = told.groupBy("class").agg(F.min("r").alias("r"), F.max("s").alias("s"))
    told = bounded(materialize(told.select("key", "class").join(firsts, "class"), "passage-firsts", few=True), 500_000)
    flags = F.when(F.expr("row <> r"), F.lit(OTHER)).otherwise(F.lit(0)).bitwiseOR(F.when(F.expr("r <> s"), F.lit(MANY)).otherwise(F.lit(0)))
    others = rows(OPEN, PLACES).join(told, "key").select("row", F.col("place").bitwiseOR(flags.cast("bigint")), "class")
    return table.where(F.col("kind") == HIT).unionAll(map_arrow(others, by_row, DEALT))


def identified(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(row, text) of docs, and (row, id) of those whose row isn't their id.

    ``row`` is the id; a null id, or one that several different texts have, gets
    a hash of id and text, below zero.
    """
    docs = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    key = F.xxhash64("id", "text").bitwiseOR(F.lit(-(1 << 63)))
    twice = docs.where("id is not null").select("id", F.xxhash64("text").alias("h")).groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("id", F.lit(True).alias("twice"))
    twice = bounded(materialize(twice, "passage-ids", few=True), 500_000)
    some = docs.join(twice, "id", "left").select(F.when(F.col("id").isNull() | F.col("twice"), key).otherwise(F.col("id")).alias("row"), "text", "id")
    odd = materialize(some.where("id is null or row <> id").select("row", "id").distinct(), "passage-odd", few=True)
    return some.select("row", "text"), odd


def _found(some: DataFrame, k: int, percent: int) -> DataFrame:
    """What ``repeats`` gives for the spans of all kinds of some (row, text)."""
    spark = some.sparkSession
    units = materialize(unit_rows(some, k, percent), "paragraphs", large_rows=True)
    near = candidates(units, percent)
    members = blocks.in_blocks(near.withColumn("copies", F.lit(1).cast("bigint")))
    members = members.groupBy("row").agg(F.collect_list(F.struct(*MEMBERS)).alias("need"))
    members = materialize(members, "paragraph-members", few=True)
    chosen = some.join(bounded(members), "row")
    if some.groupBy("row").count().where("count > 1").limit(1).count():  # rows that repeat id and text are read once
        chosen = chosen.dropDuplicates(["row"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for batch in (x for b in batches for x in pieces(b)):
            need = batch.column(0)
            ends, flat = need.offsets.to_numpy().astype(np.int64), need.values
            for part in words(batch.column(1), lower=True):
                begin, end = spans_of(part, k)
                low, high = ends[part.first], ends[part.first + len(part)]
                wanted = flat.slice(low, high - low)
                text = np.repeat(np.arange(len(part)), np.diff(ends[part.first : part.first + len(part) + 1]))
                told = lambda key, of: mix(key.view(np.uint64) ^ mix(of.astype(np.uint64)))
                have = told(_keys(part, begin, end), part.text[begin])
                order = np.argsort(have, kind="stable")
                own = order[np.searchsorted(have[order], told(wanted.field("key").to_numpy(), text))]
                whole, at, starts = _shingle_runs(part, begin[own], end[own], k)
                first, size = _distinct(part, whole, begin[own], at, starts)
                tokens, bounds = whole[at[first]], np.append(0, np.cumsum(size))
                for x in range(0, len(own), 4000):
                    y = min(x + 4000, len(own))
                    some = tokens[bounds[x] : bounds[y]]
                    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), y - x, [None, pa.py_buffer(8 * (bounds[x : y + 1] - bounds[x])), pa.py_buffer(some)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*(wanted.field(c).slice(x, y - x) for c in MEMBERS), binary], names=GROUPS.fieldNames())
        trim()

    linked = blocks.links(map_arrow(chosen.select("need", "text"), sets, GROUPS), percent)
    linked = materialize(linked.select(F.col("key").alias("a"), F.col("to").alias("b")), "paragraph-links", few=True)
    classes = components(linked, "paragraph-classes").select(F.col("node").alias("key"), F.col("root").alias("class"))
    discard(near, linked, members)
    tidy(spark)
    return repeats(unit_places(units).unionAll(exact_spans(some)), classes)


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", *, k: int = 5, percent: int = 80, min_words: int = 16) -> DataFrame:
    """Passages of texts that repeat, whole or nearly, elsewhere: one row for each.

    Texts are cut into units (``spans_of``; A-Z lower-cased, of k words at least):
    content-defined paragraphs, lines, and paragraphs between blank lines.  They
    are one class if they have
    the same words, or are joined by pairs whose sets of k-word shingles have a
    Jaccard similarity of ``percent`` or more: bands of MinHashes collide
    (``candidates``), components of colliding paragraphs are dealt into blocks,
    and pairs are verified there on whole sets (``blocks.links``).  Of each
    class the first place, by id and word, is kept and all others are removed.
    Spans that repeat exactly (``exact_spans``) are classes too, so a passage of
    40 words or more is found whole wherever it stands and lines end in it; a
    shorter one inside other lines is found if an anchor is in it.  A
    place that overlaps the first one isn't removed.  Neighbouring or
    overlapping spans of one text with the same fate, fewer than k words apart,
    make a passage; those of ``min_words`` or more are returned.  Words of a
    kept passage that a removed one holds as well are removed.

    Columns: id, first_word and n_words (words counted from 0), n_paragraphs
    (spans of all kinds), component_id (least class of the passage), removed,
    and row, by which ``remove_passages`` knows the text.  Null and empty texts
    have no passages.  Rows that repeat an id with other texts, or have none, are
    told apart by their texts (and come first); rows that repeat both are one,
    and its passages are returned once.  Other columns of docs are not read.
    An empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):
        some, odd = identified(docs, id, text)
        found = _found(some, k, percent)

    def work(values: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        row, place, group = values[HIT]
        yield from _passages(row, place >> 32, place & N_WORDS, group, (place & OTHER) > 0, (place & MANY) > 0, k, min_words)

    out = together(found, work, {HIT: 3}, PASSAGES, buckets_of(docs.sparkSession, 1))
    out = out.join(bounded(odd.withColumn("odd", F.lit(True))), "row", "left").withColumn("id", F.when(F.col("odd"), F.col("id")).otherwise(F.col("row")))
    return out.select(F.col("id").alias(id), "first_word", "n_words", "n_paragraphs", "component_id", "removed", "row")


def _passages(row: np.ndarray, first: np.ndarray, n: np.ndarray, group: np.ndarray, other: np.ndarray, many: np.ndarray, k: int, min_words: int) -> list[pa.RecordBatch]:
    """The passages of whole texts from their spans: row, first word, number of words, class, ``other`` and ``many``.

    In the text that has a class first, its first place stays, and so does what
    overlaps it; a class that no text has a second time is dropped.
    """
    order = np.lexsort((-n, first, group, row))
    row, first, n, group, other, many = (x[order] for x in (row, first, n, group, other, many))
    begins = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])))
    which = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(row))))
    removed = other | (first >= (first + n)[begins][which])
    kept = many | np.logical_or.reduceat(removed, begins)[which]
    row, first, end, group, removed = (x[kept] for x in (row, first, first + n, group, removed))
    if not len(row):
        return []
    order = np.lexsort((first, removed, row))
    row, first, end, group, removed = (x[order] for x in (row, first, end, group, removed))
    side = np.append(True, (row[1:] != row[:-1]) | (removed[1:] != removed[:-1]))
    base = np.cumsum(side) << np.int64(40)  # sides are kept apart, so one running maximum does for all
    reached = np.maximum.accumulate(base + end)
    new = side.copy()
    new[1:] |= base[1:] + first[1:] - reached[:-1] >= k
    begins = np.flatnonzero(new)
    start, stop = np.minimum.reduceat(first, begins), np.maximum.reduceat(end, begins)
    columns = (row[begins], start, stop - start, np.diff(np.append(begins, len(row))), np.minimum.reduceat(group, begins), removed[begins])
    long = stop - start >= min_words
    return [pa.RecordBatch.from_arrays([pa.array(x[long]) for x in columns], names=PASSAGES.fieldNames())]


def remove_passages(docs: DataFrame, passages: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the words of removed passages cut out of their texts; other white space stays as it is.

    passages: what ``repeated_passages`` returns for these docs; a row whose id
    passages know under a hash is looked up by that.  A text that loses nothing is
    unchanged; a null text stays null.  All columns of docs are kept.
    """
    gone = passages.where("removed").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("spans"))
    gone = gone.select(F.struct("row", "spans").alias("gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))  # no name can clash inside a struct
    own = F.col("d").getField(id).cast("bigint")
    hashed = F.xxhash64(own, F.col("d").getField(text)).bitwiseOR(F.lit(-(1 << 63)))
    by_id = whole.join(gone, own == F.col("gone.row"), "left")
    joined = by_id.join(gone.withColumnRenamed("gone", "other"), hashed == F.col("other.row"), "left").withColumn("gone", F.coalesce("gone", "other"))
    kept = F.expr(
        rf"""if(gone is null, d.`{text}`, array_join(transform(
            filter(transform(regexp_extract_all(d.`{text}`, '([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+)', 1), (w, i) -> struct(w as w, i as i)),
                x -> not exists(gone.spans, g -> x.i >= g.first_word and x.i < g.first_word + g.n_words)), x -> x.w), ''))"""
    )
    return joined.select(*[(kept if c == text else F.col("d").getField(c)).alias(c) for c in docs.columns])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_passages(docs).drop("row")
