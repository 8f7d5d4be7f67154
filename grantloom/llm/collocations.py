"""Phrase collocations by sorted count streams.

A phrase is a run of words inside a piece (the text between marks and line ends). Each word that can be in a frequent
phrase opens one window of up to five words. A task adds up its equal windows and sends them in blocks by their hash; the
task that gets a block adds them up again, so that each window of the corpus is one row. These are range-partitioned and
sorted word by word. In this prefix order every phrase of every length is one run of neighbouring windows, so a scan that keeps one open
run per length counts all lengths at once. Only runs that touch the border of a partition are added up afterwards.

The frequent phrases then form three streams in sorted order: by the phrase itself (prefix order), by the words before a
cut, and by the words behind it (suffix order). Merge joins of these streams give the counts left and right of a cut;
the greatest counts of phrases that go on to the right, and to the left, come from the same streams without the last,
and without the first, word.

Words, pairs of neighbours, and runs of three or four words below the threshold cannot be in a phrase that reaches it. They
end a window, and a word that is in no pair which may reach it opens none: no cut of a candidate asks for its count. Which ones
may reach it is told by four bitmaps of fixed size, made from counters at the hashes of all words, of the pairs of words that
may, and of the runs of such pairs: a collision only lets a rare run through, whose phrases the exact counts drop, and a full
bitmap only leaves longer windows.

Defined cases: a null or empty text has no words; a null language is ``und`` and shares that group with rows so named;
repeated rows count each time; ties are broken by count and then by phrase, so ranks are unique; an empty table gives an
empty table; words may hold any character but blank, tab and the marks, also NUL; whole texts are read whatever their
length; only the text and language columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantloom.llm.common import small_batches, stored, table, text_chunks

#: Occurrences of a candidate, words of the longest one, rows per language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Counters of a filter: its bitmap has 32 MB whatever the corpus. They travel in blocks of 65,536.
COUNTERS, BLOCK = 1 << 28, 1 << 16
#: Runs with a filter: words, pairs, runs of three and of four.
FILTERS = 4
#: Bytes of text that a task combines at once, and windows that it scans at once.
CHUNK_BYTES, SCANNED = 12_000_000, 100_000
#: Different windows that a task holds before it sends them, and blocks of a language that they travel in.
HELD, SENT = 400_000, 1024
#: Marks and line ends become one mark, the tab a blank, A-Z lower case.
MARK = b"."
_FROM = b".,;:!?\x0a\x0b\x0c\x0d\x09" + bytes(range(65, 91))
_TO = MARK * 10 + b" " + bytes(range(97, 123))
SIGNS = bytes.maketrans(_FROM, _TO)
#: Words of a phrase are joined by NUL, which sorts before all that words hold: NUL and 1 in words are written as pairs.
JOIN = "\0"


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with a mark after each piece."""
    return text.translate(SIGNS).replace(MARK, b" . ").split()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """For each language of a chunk: ids of its tokens, -1 for a mark, and the distinct words behind the ids.

    A chunk is made of batches until they hold ``CHUNK_BYTES`` of text.
    """
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch, raw in text_chunks(batches, 1, CHUNK_BYTES):
        for lang, text in zip(batch.column(0).to_pylist(), raw, strict=True):
            if text:
                if b"\0" in text or b"\1" in text:
                    text = text.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")
                held.setdefault(lang, []).append(text)
                size += len(text)
        if size >= CHUNK_BYTES:
            while held:
                yield _coded(*held.popitem())
            size = 0
    while held:
        yield _coded(*held.popitem())


def _coded(lang: str, texts: list[bytes]) -> tuple[str, np.ndarray, pa.Array]:
    coded = pa.array(tokens(MARK.join(texts)) + [MARK], pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    ids[ids == coded.dictionary.index(pa.scalar(MARK, pa.binary())).as_py()] = -1
    return lang, ids, coded.dictionary


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + w, 42) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def _bitmaps(known: tuple[Broadcast, ...]) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x.value), dtype=np.uint8) for x in known]


def _set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits at the hashes are set; the bitmap has a power of two of them."""
    places = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return ((bitmap[places >> 3] >> (places & 7)) & 1) > 0


def _known(ids: np.ndarray, hashes: np.ndarray, known: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Ids of the known words, -1 for others, and for two words on, up to one more than the bitmaps tell: the places where a run
    of so many words begins whose shorter runs are known, and their hashes. All but the last are known themselves.
    """
    good = _set(known[0], hashes)
    for bitmap in known[2:3]:
        good &= _set(bitmap, hashes)
    ids = np.where((ids >= 0) & good[ids], ids, -1)
    runs, begins, codes = [], np.flatnonzero(ids >= 0), hashes[ids[ids >= 0]]
    for length, bitmap in enumerate([None, *known[1:]], 2):
        if bitmap is not None:
            kept = _set(bitmap, codes)
            begins, codes = begins[kept], codes[kept]
            runs[-1] = begins, codes
        on = np.append(np.diff(begins) == 1, False)[: len(begins)]
        begins, codes = begins[on], codes[on]
        codes = (codes << np.uint64(1)) ^ hashes[ids[begins + length - 1]]
        runs.append((begins, codes))
    return ids, runs


def reaching(docs: DataFrame, least: int, known: tuple[Broadcast, ...] = (), counters: int = COUNTERS) -> Broadcast:
    """Bits set where a counter reaches ``least``: that of every word, with the bits of words that of every pair of them, with
    those of pairs too that of every run of three words, then of four. The third also has the bits of the words that are in a
    known pair. They are compressed and sent out once, for all later passes.

    A task sends the counters that its chunks raise as 16-bit places within a block; a block's counters are added up by one
    task, which holds its blocks only, and stop at ``least``.
    """
    small, block = np.uint8 if least < 256 else np.uint32, min(BLOCK, counters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = _bitmaps(known)
        for lang, ids, vocabulary in _groups(batches):
            hashes = _hashes(lang, vocabulary)
            if bitmaps:
                ids, runs = _known(ids, hashes, bitmaps)
                found = runs[-1][1]
            else:
                found = hashes[ids[ids >= 0]]
            places, counts = np.unique(found & np.uint64(counters - 1), return_counts=True)
            counts = np.minimum(counts, least)
            if len(bitmaps) == 2:
                begins = runs[0][0]
                paired = hashes[np.union1d(ids[begins], ids[begins + 1])]
                every, at = np.unique(np.append(places, paired & np.uint64(counters - 1)), return_inverse=True)
                sums = np.zeros(len(every), dtype=counts.dtype)
                sums[at[: len(places)]] = counts
                sums[at[len(places) :]] = least
                places, counts = every, sums
            if not len(places):
                continue
            blocks, starts = np.unique(places // np.uint64(block), return_index=True)
            low = (places % np.uint64(block)).astype("<u2")
            counts = counts.astype(small)
            ends = np.append(starts[1:], len(places))
            yield pa.record_batch(
                [pa.array(blocks.astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                 pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                names=["block", "places", "counts"],
            )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, int] = {}
        table = np.zeros((0, block), dtype=small)
        for batch in batches:
            numbers, places, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            own = [lines.setdefault(number, len(lines)) for number in numbers]
            if len(lines) > len(table):
                table = np.concatenate([table, np.zeros((len(lines) - len(table), block), dtype=small)])
            sizes = np.fromiter(map(len, places), dtype=np.int64, count=len(places)) // 2
            at = np.repeat(np.array(own, dtype=np.int64) * block, sizes) + np.frombuffer(b"".join(places), "<u2")
            at, which = np.unique(at, return_inverse=True)
            sums = np.bincount(which, weights=np.frombuffer(b"".join(counts), small)).astype(np.int64)
            flat = table.reshape(-1)
            flat[at] = np.minimum(flat[at].astype(np.int64) + sums, least)
        for number, line in lines.items():
            flags = table[line] >= least
            if flags.any():
                yield pa.record_batch(
                    [pa.array([number], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"]
                )

    raised = _texts(docs).mapInArrow(count, "block int, places binary, counts binary").repartition("block")
    whole = bytearray(max(1, counters // 8))
    size = max(1, block // 8)
    for row in raised.mapInArrow(add_up, "block int, bits binary").collect():  # a set of fixed size: 4,096 rows of 8 KB at most
        whole[row["block"] * size : (row["block"] + 1) * size] = row["bits"]
    return docs.sparkSession.sparkContext.broadcast(zlib.compress(whole, 1))  # of fixed size at most; every executor has a file of it


def _opened(ids: np.ndarray, hashes: np.ndarray, words: pa.Array, known: list[np.ndarray], longest: int) -> tuple[pa.Array, np.ndarray]:
    """The different windows of a chunk, and how often each is met."""
    ids, runs = _known(ids, hashes, known)
    rows = np.flatnonzero(ids >= 0)
    columns, flags = [ids[rows]], []
    for begins, _ in runs[: len(known) - 1]:
        flags.append(np.zeros(len(ids), dtype=bool))
        flags[-1][begins] = True
    last = len(ids) - 1
    # Equal windows get equal codes, one more word at a time; those that end keep theirs.
    code, number = columns[0].copy(), len(words)
    for length in range(1, longest):
        back = min(length + 1, len(flags) + 1)  # the longest run with a filter that the next word ends
        goes_on = (columns[-1] >= 0) & flags[back - 2][np.minimum(rows + length + 1 - back, last)]
        columns.append(np.where(goes_on, ids[np.minimum(rows + length, last)], -1))
        live = np.flatnonzero(goes_on)
        own, inverse = np.unique(code[live] * len(words) + columns[-1][live], return_inverse=True)
        code[live] = number + inverse
        number += len(own)
    counts, first = np.bincount(code, minlength=number), np.zeros(number, dtype=np.int64)
    first[code] = np.arange(len(code))
    first, counts = first[counts > 0], counts[counts > 0]
    parts = [words.take(pa.array(column[first], mask=column[first] < 0)) for column in columns]
    return pc.binary_join_element_wise(*parts, pa.scalar(JOIN.encode(), pa.binary()), null_handling="skip"), counts


def _added(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Equal windows added up."""
    both = pa.table({"phrase": pa.chunked_array([p for p, _ in parts], pa.binary()), "c": np.concatenate([c for _, c in parts])})
    both = both.group_by("phrase").aggregate([("c", "sum")]).combine_chunks()
    return pa.concat_arrays(both["phrase"].chunks), both["c_sum"].to_numpy()


def _sent(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each block: its windows with blanks between, which no word holds, and their counts."""
    blocks = (_hashes(lang, phrases) % np.uint64(SENT)).astype(np.int32)
    order = np.argsort(blocks, kind="stable")
    numbers, starts = np.unique(blocks[order], return_index=True)
    ends = np.append(starts, len(order))
    own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), phrases.take(pa.array(order)))
    counts = counts[order].astype("<i8")
    return pa.record_batch(
        [pa.array([lang] * len(numbers), pa.string()), pa.array(numbers), pc.binary_join(own, pa.scalar(b" ", pa.binary())).cast(pa.string()),
         pa.array([counts[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
        names=["lang", "block", "phrases", "counts"],
    )


def windows(docs: DataFrame, known: tuple[Broadcast, ...], longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, c``: the different runs of known words, pairs and longer runs that words open, up to ``longest`` words,
    and how often each is met.

    An empty phrase counts all words. A task sends at most a row for each block whenever it holds ``HELD`` different windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = _bitmaps(known)
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        size = 0
        for lang, ids, words in _groups(batches):
            total = pa.array([b""], pa.binary()), np.array([(ids >= 0).sum()], dtype=np.int64)
            found = _opened(ids, _hashes(lang, words), words, bitmaps, longest)
            before = held.get(lang, [])
            held[lang] = [_added([*before, total, found])]
            size += len(held[lang][0][1]) - sum(len(c) for _, c in before)
            if size >= HELD:
                while held:
                    lang, (own,) = held.popitem()
                    yield _sent(lang, *own)
                size = 0
        while held:
            lang, (own,) = held.popitem()
            yield _sent(lang, *own)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come in order, so one is held at a time."""
        own, sums = None, Counter()
        for batch in batches:
            for lang, block, phrases, counts in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if own != (lang, block) and sums:
                    yield whole(own[0], sums)
                    sums = Counter()
                own = lang, block
                for phrase, c in zip(phrases.split(" "), np.frombuffer(counts, "<i8").tolist(), strict=True):
                    sums[phrase] += c
        if sums:
            yield whole(own[0], sums)

    def whole(lang: str, sums: Counter) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(sums), pa.string()), pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())]
        return pa.record_batch(columns, names=["lang", "phrase", "c"])

    sent = _texts(docs).mapInArrow(run, "lang string, block int, phrases string, counts binary")
    return sent.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(add_up, "lang string, phrase string, c bigint")


def _rows_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined up to about so many rows."""
    open_, size = [], 0
    for batch in batches:
        open_.append(batch)
        size += len(batch)
        if size >= rows:
            yield pa.Table.from_batches(open_).combine_chunks()
            open_, size = [], 0
    if size:
        yield pa.Table.from_batches(open_).combine_chunks()


class Runs:
    """Counts the runs of common first words in a sorted stream of windows.

    ``open`` has, for every length, the run that the last window belongs to: its phrase, count, and whether it may have
    begun in the partition before.
    """

    def __init__(self, longest: int, least: int):
        self.longest, self.least = longest, least
        self.lang, self.words, self.fresh = None, [], True
        self.open: dict[int, tuple[str, int, bool]] = {}
        self.done: list[tuple[str, str, int, bool]] = []

    def close(self, length: int, border: bool = False) -> None:
        if length in self.open:
            phrase, count, early = self.open.pop(length)
            if border or early or count >= self.least:
                self.done.append((self.lang, phrase, count, border or early))

    def add(self, windows: pa.Table) -> None:
        langs, phrases, counts = windows.column(0).to_pylist(), windows.column(1).combine_chunks(), windows.column(2).to_numpy()
        split = pc.split_pattern(phrases, JOIN)
        lengths = np.diff(split.offsets.to_numpy())
        flat = split.flatten().dictionary_encode().indices.to_numpy()
        cells = np.full((len(lengths), self.longest), -1, dtype=np.int64)
        cells[np.arange(self.longest) < lengths[:, None]] = flat
        lang = windows.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
        # Words that a window has in common with the one before it.
        equal = (cells[1:] == cells[:-1]) & (cells[1:] >= 0) & (lang[1:] == lang[:-1])[:, None]
        same = np.concatenate([[0], np.logical_and.accumulate(equal, axis=1).sum(axis=1)])
        opening = phrases[0].as_py().split(JOIN)
        if langs[0] == self.lang:
            while same[0] < min(len(opening), len(self.words)) and opening[same[0]] == self.words[same[0]]:
                same[0] += 1
        for length in range(1, self.longest + 1):
            if same[0] < length:
                self.close(length)
        self.lang = langs[0]
        for length in range(1, self.longest + 1):
            rows = np.flatnonzero(lengths >= length)
            if not len(rows):
                continue
            starts = same[rows] < length
            starts[0] = True
            at = np.flatnonzero(starts)
            sums = np.add.reduceat(counts[rows], at)
            heads = rows[at]
            early = np.zeros(len(at), dtype=bool)
            if length in self.open:  # the first run goes on
                _, before, flag = self.open.pop(length)
                sums[0], early[0] = sums[0] + before, flag
            elif self.fresh and heads[0] == 0:
                early[0] = True
            open_last = rows[-1] == len(lengths) - 1
            for i in np.flatnonzero((sums >= self.least) | early | (np.arange(len(at)) == len(at) - 1)).tolist():
                phrase = JOIN.join(phrases[heads[i]].as_py().split(JOIN)[:length])
                if open_last and i == len(at) - 1:
                    self.open[length] = (phrase, int(sums[i]), bool(early[i]))
                elif early[i] or sums[i] >= self.least:
                    self.done.append((langs[heads[i]], phrase, int(sums[i]), bool(early[i])))
        self.fresh, self.lang, self.words = False, langs[-1], phrases[len(phrases) - 1].as_py().split(JOIN)

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        return pa.record_batch(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))],
            names=["lang", "phrase", "a", "border"],
        )


def phrase_counts(counted: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, a`` of every phrase that reaches ``least``, their words and the count of all words too, from the windows."""
    ordered = counted.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(longest, least)
        for part in _rows_of(batches, SCANNED):
            runs.add(part)
            if runs.done:
                yield runs.take()
        for length in range(1, longest + 1):
            runs.close(length, border=True)
        yield runs.take()

    found = stored(ordered.mapInArrow(run, "lang string, phrase string, a bigint, border boolean"), "phrase-runs")
    # At most two runs of each length touch the borders of a partition.
    split = found.where("border").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return found.where("not border").select("lang", "phrase", "a").unionByName(split)


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), JOIN)


def scored(counts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of every candidate: the cut with the least score, the smallest of equals."""
    totals = counts.where("phrase = ''").select("lang", F.col("a").alias("n"))
    cut = phrases.withColumn("words", F.split("phrase", JOIN)).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.select(
        "lang", "phrase", "a", "k", _part(F.col("words"), F.lit(1), F.col("k")).alias("left"),
        _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("right"),
    )
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    cut = cut.join(left.hint("merge"), ["lang", "left"]).join(right.hint("merge"), ["lang", "right"])
    cut = cut.join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    top = (wide["a"] * F.lit(1000).cast("decimal(4,0)") * wide["n"]).alias("top")
    cut = cut.select("lang", "phrase", "a", "l", "r", "n", "k", top, (wide["l"] * wide["r"]).alias("bottom"))
    cut = cut.withColumn("score", F.expr("top div bottom"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    return cut.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def unextended(candidates: DataFrame, phrases: DataFrame, share: int = 100) -> DataFrame:
    """Candidates that no longer candidate holding their words reaches in count (``share`` per cent).

    Counts only fall when words are added, so the longer candidates with one word more decide.
    """
    words = F.split("phrase", JOIN)
    longer = phrases.where(F.size(words) > 2)
    onward = longer.groupBy("lang", _part(words, F.lit(1), F.size(words) - 1).alias("phrase")).agg(F.max("a").alias("x"))
    before = longer.groupBy("lang", _part(words, F.lit(2), F.size(words) - 1).alias("phrase")).agg(F.max("a").alias("y"))
    met = candidates.join(onward.hint("merge"), ["lang", "phrase"], "left").join(before.hint("merge"), ["lang", "phrase"], "left")
    most = F.greatest(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))
    return met.where(most * 100 < F.col("a") * share).drop("x", "y")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 100, counters: int = COUNTERS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` candidates by score, count and phrase."""
    known = ()
    for _ in range(FILTERS):
        known += (reaching(docs, least, known, counters),)
    counted = stored(windows(docs, known, longest), "windows")
    counts = stored(phrase_counts(counted, least, longest), "phrase-counts")
    phrases = counts.where(F.instr("phrase", JOIN) > 0)
    kept = unextended(scored(counts, phrases), phrases, share)
    for code, sign in ((JOIN, " "), ("\1\1", "\0"), ("\1\2", "\1")):  # behind the joins, words get back what they held
        kept = kept.withColumn("phrase", F.replace("phrase", F.lit(code), F.lit(sign)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of every language."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (
  SELECT doc, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS place
  FROM (SELECT doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM texts)),
words AS (
  SELECT doc, place, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc, place, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces)),
runs AS (
  SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4,
    lead(word, 4) OVER p AS w5 FROM words WINDOW p AS (PARTITION BY doc, place ORDER BY i)),
grams AS (
  SELECT lang, [w1] AS g FROM runs
  UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5] FROM runs WHERE w5 IS NOT NULL),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) >= 2),
cutscores AS (
  SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, t.n,
    ((1000 * c.a::HUGEINT * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cutscores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
parts AS (
  SELECT DISTINCT lang, g[i:i + m - 1] AS g, a
  FROM (SELECT lang, g, a, unnest(range(2, len(g))) AS m FROM f WHERE len(g) >= 3), LATERAL (SELECT unnest(range(1, len(g) - m + 2)) AS i)),
kept AS (
  SELECT b.* FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = b.lang AND p.g = b.g AND 100 * p.a >= 100 * b.a)),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named) WHERE rank <= 2000
"""
