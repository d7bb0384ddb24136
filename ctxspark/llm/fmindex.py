"""Repeated passages: compressed FM-indexes, one per shard of the text that can repeat at all, through which the
passages of all documents are streamed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import bound_arrow, cut, mix, ngram_hash, text_slices

#: Words of a window, and of the runs whose smallest hash names a window's shard.
WINDOW, RUN = 20, 6
#: Words of a shard, about; runs that occur more often than this are dealt out window by window.
SHARD_WORDS, FREQUENT = 400_000, 2000
#: Words of a passage at most; suffixes are sorted by one symbol more.
LONGEST = 63
#: Bits of a filter at most (it holds names of runs; a false positive costs time, not results).
FILTER_BITS = 1 << 27
#: Passages whose words a task remembers having sent.
SENT = 200_000


class WaveletMatrix:
    """Ranks of a sequence of numbers: per bit a packed bit row with counts, so log2(numbers) bits per entry."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.words, self.before = bits, [], [], []
        pad = -len(values) % 64 + 64
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(np.uint8)
            words = np.packbits(np.concatenate([bit, np.zeros(pad, np.uint8)]), bitorder="little").view("<u8")
            self.words.append(words)
            ones = np.bitwise_count(words).astype(np.int32)
            self.before.append(np.cumsum(ones, dtype=np.int32) - ones)
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the entries equal to symbol before place at end in the last row; differences of two are ranks."""
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Passages of symbols from 1 up, each ended by 0 and of LONGEST symbols at most, as a wavelet matrix over their
    Burrows-Wheeler transform. Neither the text nor the suffix array is kept: what remains besides is the common prefix
    of neighbouring suffixes (a byte each), the intervals around them, and per window of repeated symbols the least of
    the given keys at which it begins."""

    def __init__(self, text: np.ndarray, keys: np.ndarray, window: int):
        n, self.window = len(text), window
        rank, classes, places = text.astype(np.int64), 0, None
        for h in (1, 2, 4, 8, 16, 32):
            key = rank * (int(rank.max()) + 2)
            key[:-h or None] += rank[h:] + 1
            places = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[places]) != 0)])
            rank = np.empty(n, np.int64)
            rank[places] = new
            if new[-1] == classes:
                break
            classes = new[-1]
        symbols = int(text.max()) + 1
        self.wavelet = WaveletMatrix(text[places - 1].astype(np.int64), max(1, (symbols - 1).bit_length()))
        every = np.arange(symbols)
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.size, self.jump = n, first[:-1] - self.wavelet.descend(every, np.zeros(symbols, np.int64))
        self.common = self._common(text, places)
        self.left, self.right = self._around(self.common)
        self.classes = np.cumsum(self.common[:-1] < window, dtype=np.int32) - 1
        self.least = np.full(int(self.classes[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.classes, keys[places])

    @staticmethod
    def _common(text: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Per suffix the symbols that it shares with the one before it, up to the end of a passage; -1 at both ends."""
        out = np.zeros(len(places) + 1, np.int8)
        at, a, b = np.arange(1, len(places)), places[:-1], places[1:]
        padded = np.concatenate([text, np.zeros(LONGEST + 1, text.dtype)])
        for k in range(LONGEST + 1):
            x = padded[a + k]
            same = (x == padded[b + k]) & (x > 0)
            at, a, b = at[same], a[same], b[same]
            if not len(at):
                break
            out[at] = k + 1
        out[0] = out[-1] = -1
        return out

    @staticmethod
    def _around(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per suffix the nearest places on both sides where less is shared: the interval of what it shares."""
        left, right = np.zeros(len(common), np.int32), np.full(len(common), len(common) - 1, np.int32)
        for v in np.unique(common[1:-1]).tolist():
            less, at = np.flatnonzero(common < v), np.flatnonzero(common[1:-1] == v) + 1
            k = np.searchsorted(less, at)
            left[at], right[at] = less[k - 1], less[k]
        return left, right

    def statistics(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(length, least) at each place of the streamed text, which holds passages at begin: the matching statistic,
        that is how many symbols from there on occur at two places of the index or more (the passages are in it
        themselves), and the least key of the window of them, if they are enough for one.

        Each passage is taken from its end by backward search; where a symbol does not extend the match, the match
        gives up its last symbols until one does. A passage is left, with zeros, once no window further left can match
        any more (but for whole). All passages go on together, each by its own next attempt."""
        length, least = np.zeros(len(text), np.int8), np.full(len(text), np.iinfo(np.int64).max)
        place, left = begin + size - 1, size - 1
        low, high, depth = np.zeros(len(size), np.int64), np.full(len(size), self.size, np.int64), np.zeros(len(size), np.int64)
        while len(place):
            c = text[place]
            ends = self.wavelet.descend(np.concatenate([c, c]), np.concatenate([low, high]))
            jump = self.jump[c]
            a, b = jump + ends[: len(c)], jump + ends[len(c) :]
            more = b - a > 1
            edge = np.where(self.common[low] >= self.common[high], low, high)
            low, high = np.where(more, a, self.left[edge]), np.where(more, b, self.right[edge])
            done = more | (depth == 0)
            depth = np.where(more, depth + 1, np.maximum(self.common[edge], 0))
            length[place[more]] = depth[more]
            enough = np.flatnonzero(more & (depth >= self.window))
            least[place[enough]] = self.least[self.classes[low[enough]]]
            place, left = place - done, left - done
            stay = np.flatnonzero((left >= 0) & (whole | (depth + left + 1 >= self.window)))
            if len(stay) < len(place):
                place, left, low, high, depth = (x[stay] for x in (place, left, low, high, depth))
        return length, least


def window_names(h: np.ndarray, owner: np.ndarray, window: int = WINDOW, run: int = RUN):
    """h, owner: hash and text of each word. Per stretch of consecutive windows of one text with the same name (the
    smallest hash of their runs): (first word, windows, name, places of the name's run in the stretch). Equal windows
    have equal names wherever they stand."""
    n = len(h) - window + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty, empty, np.empty(0, np.uint64), empty
    runs = ngram_hash(h, run)
    width, low, have = window - run + 1, runs, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    inside = owner[:n] == owner[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:n] != owner[: n - 1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    edge = np.append(np.flatnonzero(new | ~inside), n)
    size = edge[np.searchsorted(edge, first, "right")] - first
    span = size + width - 1
    total = np.cumsum(span)
    at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - span), span)
    same = runs[at] == np.repeat(low[first], span)
    places = np.add.reduceat(same, total - span) if len(first) else empty
    return first, size, low[first], places


class NameFilter:
    """A bounded set of 64-bit names: no false negatives."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 64).bit_length() + 1)

    def has(self, names: np.ndarray) -> np.ndarray:
        at = names * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    @staticmethod
    def of(names: DataFrame, count: int, most: int = FILTER_BITS) -> NameFilter:
        """names: (name long). The executors set the bits of a word of the filter together; the driver gets the words."""
        size = min(most, 1 << max(10, (16 * count).bit_length()))
        shift = 64 - size.bit_length() + 1

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)
                words = (at >> np.uint64(6)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

        words = names.select("name").mapInArrow(place, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        return NameFilter(bits)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = bytes(0x20 if s else c for c, s in enumerate(_SPACE))
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BASE = 0x9E3779B97F4A7C15
#: Bytes of texts that are hashed at a time.
HASHED_BYTES = 1 << 20


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))


def _powers_to(base: int, n: int) -> np.ndarray:
    """The first n powers or more; kept by powers of two."""
    return _powers(base, 1 << max(16, n.bit_length()))


class HashedWords:
    """The words of several texts, found and hashed in numpy: hash, text (owner), first word of each text (begin). Equal
    words have equal hashes; unlike ones may, too, so hashes only ever decide which passages meet."""

    def __init__(self, texts: list[bytes]):
        self.raw = (b" " + b" ".join(texts) + b" ").translate(_PLAIN)
        b = np.frombuffer(self.raw, np.uint8)
        edge = np.flatnonzero(np.diff(b == 0x20)) + 1
        self.start, self.end = edge[::2], edge[1::2]
        sums = np.cumsum(_LETTER[b] * _powers_to(_BASE, len(b))[: len(b)], dtype=np.uint64)
        back = _powers_to(pow(_BASE, -1, 1 << 64), len(b))[self.start]
        self.hash = mix((sums[self.end - 1] - sums[self.start - 1]) * back + (self.end - self.start).astype(np.uint64))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        last = np.searchsorted(self.start, np.cumsum(sizes + 1) + 1)
        count = np.diff(np.concatenate([[0], last]))
        self.owner, self.begin = np.repeat(np.arange(len(texts)), count), last - count
        self._wide = np.concatenate([[0], np.cumsum(self.start[1:] - self.end[:-1] > 1)])

    def words(self, first: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Each run of n words from first on, joined by one space."""
        raw, last = self.raw, first + n - 1
        plain = self._wide[last] == self._wide[first] if len(first) else first
        spans = zip(self.start[first].tolist(), self.end[last].tolist(), plain.tolist())
        return [raw[a:b] if p else b" ".join(raw[a:b].split()) for a, b, p in spans]


def _name_counts(docs: DataFrame) -> DataFrame:
    """(name, places) in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, limit=HASHED_BYTES):
            w = HashedWords(texts)
            _, _, name, places = window_names(w.hash, w.owner)
            names, flat = np.unique(name, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(flat, places, minlength=len(names)).astype(np.int64))], ["name", "places"])

    return docs.select("id", "text").mapInArrow(run, "name long, places long").groupBy("name").agg(F.sum("places").alias("places"))


def _pieces(first: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows cut into pieces of at most so many: (first word, windows, stretch)."""
    count = -(-size // most)
    of = np.repeat(np.arange(len(size)), count)
    skip = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * most
    return first[of] + skip, np.minimum(size[of] - skip, most), of


def _passages(docs: DataFrame, often, frequent, wanted=None) -> DataFrame:
    """(name, k1, k2, id, row, start, n_words, words) of each passage (a bounded piece of a stretch) whose name occurs
    more than once: its place, the two halves of a 128-bit BLAKE2 digest of its words, and, once or more for each passage,
    the words themselves. Frequent names are dealt out window by window, named by themselves; their words are left out
    here and given, for those that wanted has, by a second call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, many, sent = often.value, frequent.value, set()
        for rows, texts in text_slices(batches, limit=HASHED_BYTES):
            w = HashedWords(texts)
            first, size, name, _ = window_names(w.hash, w.owner)
            keep = repeats.has(name)
            first, size, name = first[keep], size[keep], name[keep]
            hot = many.has(name)
            single, _, _ = _pieces(first[hot], size[hot], 1)
            a, n, of = _pieces(first[~hot], size[~hot], LONGEST - WINDOW + 1) if wanted is None else (first[:0], size[:0], first[:0])
            alone = np.arange(len(a) + len(single)) >= len(a)
            a, n = np.concatenate([a, single]), np.concatenate([n + WINDOW - 1, np.full(len(single), WINDOW, np.int64)])
            words = w.words(a, n)
            digests = [blake2b(x, digest_size=16).digest() for x in words]
            key = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            name = np.concatenate([name[~hot][of].view(np.int64), key[len(of) :, 0]])
            held: list = [None] * len(words)
            for i in range(len(of)) if wanted is None else np.flatnonzero(wanted.value.has(key[:, 0].view(np.uint64))).tolist():
                if digests[i] not in sent:
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(digests[i])
                    held[i] = words[i]
            doc = w.owner[a]
            at, flat = pa.array(doc), [pa.array(x) for x in (name, key[:, 0], key[:, 1])]
            out = pa.RecordBatch.from_arrays([*flat, rows.column(0).take(at), rows.column(1).take(at), pa.array((a - w.begin[doc]).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(held, pa.binary())], names)
            yield out if wanted is None else out.filter(pc.is_valid(out.column("words")))

    names = ["name", "k1", "k2", "id", "row", "start", "n_words", "words"]
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "row", "text").mapInArrow(run, f"name long, k1 long, k2 long, id {kind}, row long, start long, n_words long, words binary")


def earlier_windows(passages: list[bytes], order: np.ndarray, start: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(passage, first word, words) of each interval that windows cover which also begin earlier: at a smaller order, or
    a smaller start and the same order. The passages are unlike each other; they are indexed, and then streamed through
    the index for their matching statistics."""
    size = np.fromiter((x.count(b" ") + 1 for x in passages), np.int64, len(passages))
    words = pa.array(b" ".join(passages).split(b" "), pa.binary()).dictionary_encode().indices.to_numpy()
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int32)
    offset = np.arange(len(text)) - np.repeat(begin, size + 1)
    text[offset < np.repeat(size, size + 1)] = words + 1
    keys = np.repeat((order << np.int64(40)) + start, size + 1) + offset
    length, least = FMIndex(text, keys, window).statistics(text, begin, size)
    hit = np.flatnonzero((length >= window) & (least < keys))
    if len(hit):
        new = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
        a, z = hit[new], hit[np.append(new[1:], len(hit)) - 1]
        for x, y in zip(a.tolist(), z.tolist()):
            k = int(np.searchsorted(begin, x, "right")) - 1
            yield k, x - int(begin[k]), y - x + window


def _search(held: DataFrame, kind: str) -> DataFrame:
    """held (shard, k1, k2, n, id, start, words) in the order of shard and key, each passage by one row with its count and
    first place and by one row or more with its words, to (k1, k2, id, start, gone): of each passage its first place and
    the intervals of it that begin earlier still. Passages without either are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            parts.append(pa.Table.from_batches([b]))
            if parts[0].column("shard")[0].as_py() != b.column("shard")[-1].as_py():
                t = pa.concat_tables(parts)
                key = t.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist()]
                for a, z in zip(cuts, cuts[1:]):
                    yield solve(t.slice(a, z - a))
                parts = [t.slice(cuts[-1])]
        if parts:
            yield solve(pa.concat_tables(parts))

    def solve(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t.column(c).to_numpy() for c in ("k1", "k2")], 1)
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])
        group = np.cumsum(new) - 1
        told = np.flatnonzero(t.column("words").is_null().to_numpy())
        said = np.flatnonzero(t.column("words").is_valid().to_numpy())
        said = said[np.unique(group[said], return_index=True)[1]]
        both, i, j = np.intersect1d(group[told], group[said], return_indices=True)
        if len(both) < len(told):
            raise RuntimeError("a passage came without its words")
        facts = t.take(pa.array(told[i])).combine_chunks()
        passages = t.column("words").take(pa.array(said[j])).to_pylist()
        gone: list[list[dict]] = [[] for _ in passages]
        if passages:
            named = pc.rank(facts.column("id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
            for k, a, n in earlier_windows(passages, named.to_numpy().astype(np.int64), facts.column("start").to_numpy()):
                gone[k].append({"at": a, "n": n})
        keep = np.flatnonzero((facts.column("n").to_numpy() > 1) | np.fromiter(map(bool, gone), bool, len(gone)))
        some = facts.take(pa.array(keep)).select(["k1", "k2", "id", "start"]).combine_chunks()
        lists = pa.array([gone[k] for k in keep.tolist()], pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in some.columns), lists], ["k1", "k2", "id0", "start0", "gone"])

    return held.mapInArrow(run, f"k1 long, k2 long, id0 {kind}, start0 long, gone array<struct<at: long, n: long>>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, start, n_words): stretches of words that windows cover which begin earlier in the corpus (in a smaller
    id, or further left in the same id); row is the hash of the row's text. Stretches may touch or overlap.

    A window's name is the smallest hash among its runs of RUN words, so equal windows have one name. Names that occur
    once cannot repeat and are left out by a filter of bounded size. Consecutive windows of one name make a passage.
    Every passage that differs from all others (by a 128-bit cryptographic digest, pre-aggregated) goes once, as words,
    to the shard of its name, which builds one FM-index and then streams its passages through it: matching statistics
    tell which windows occur elsewhere, and the least place of a window which of these begin earlier. The copies of a
    passage share its search: all but the first have every window at the first one's place already. Names that are
    frequent are dealt out by whole windows, so no shard holds more than FREQUENT passages of one name."""
    spark = docs.sparkSession
    bound_arrow(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    names = cut(_name_counts(docs).where("places > 1"))
    n, n_frequent = names.agg(F.count("*"), F.count_if(F.col("places") > FREQUENT)).first()
    often = spark.sparkContext.broadcast(NameFilter.of(names, n))
    frequent = spark.sparkContext.broadcast(NameFilter.of(names.where(F.col("places") > FREQUENT), n_frequent))
    found = cut(_passages(docs, often, frequent))
    first = found.groupBy("name", "k1", "k2").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n"), F.count("words").alias("sent"), F.max("n_words").alias("n_words"))
    first = cut(first.where("n > 1 or sent > 0"))
    words = found.where("words is not null").select("name", "k1", "k2", "words")
    if n_frequent:
        hot = first.where("sent = 0").select(F.col("k1").alias("name"))
        wanted = spark.sparkContext.broadcast(NameFilter.of(hot, hot.count()))
        words = words.unionByName(_passages(docs, often, frequent, wanted).select("name", "k1", "k2", "words"))
    shards = int(first.agg(F.sum("n_words")).first()[0] or 0) // SHARD_WORDS + 1
    shard = F.pmod("name", F.lit(shards)).cast("int").alias("shard")
    told = first.select(shard, "k1", "k2", "n", "first.id", "first.start", F.lit(None).cast("binary").alias("words"))
    said = words.select(shard, "k1", "k2", F.lit(0).cast("long").alias("n"), F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("start"), "words")
    held = told.unionByName(said).repartition("shard").sortWithinPartitions("shard", "k1", "k2")
    known = cut(_search(held, kind))
    place = found.select("k1", "k2", "id", "row", "start", "n_words").join(known, ["k1", "k2"])
    own = F.col("id").eqNullSafe(F.col("id0")) & (F.col("start") == F.col("start0"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n_words").alias("n")))
    gone = place.select("id", "row", "start", F.explode(F.when(own, F.col("gone")).otherwise(whole)).alias("g"))
    return gone.select("id", "row", (F.col("start") + F.col("g.at")).alias("start"), F.col("g.n").alias("n_words"))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): per row of docs what is left of its words when those of repeated_passages go, as
    words joined by one space. Words are runs of anything but ASCII white space. A null text has no words; rows with a
    null id count as the first document and lose nothing. Rows that repeat an id are one document, in which places count
    by their words before them in their own row, so repeats of one row lose nothing by each other; each row loses its
    own words only. Other columns are not read; an empty table gives an empty result."""
    found = repeated_passages(docs, id_col, text_col)
    gone = found.where("id is not null").groupBy("id", "row").agg(F.collect_list(F.struct("start", "n_words")).alias("gone"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    gone = cut(gone).withColumnsRenamed({"id": "of", "row": "of_row"}).hint("merge")
    rows = rows.join(gone, (F.col("id") == F.col("of")) & (F.col("row") == F.col("of_row")), "left").select("id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches):
            total, removed, kept = [], [], []
            for text, gone in zip(texts, b.column("gone").to_pylist()):
                words = text.split()
                total.append(len(words))
                if gone:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for x in gone:
                        cover[x["start"]] += 1
                        cover[x["start"] + x["n_words"]] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")
