"""Phrase collocations by suffix sorting: truncated suffixes in reverse order, all prefixes counted with one stack, parts joined afterwards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_broadcast, shipped, small_batches, text_of

#: Each word of a suffix ends with this byte, which no word holds: phrases of the same first words stand together in any byte order.
END = b"\n"
#: Kinds of byte: of a word, between words, between pieces. A-Z become a-z.
WORD, SPACE, BREAK = range(3)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.full(256, WORD, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[ord(c) for c in ".,;:!?"]] = BREAK
KIND[0x0A:0x0E] = BREAK
#: Positions of a batch whose suffixes are made at once.
SLICE = 1 << 20
#: At most so many bits say which words, and which pairs, can be in a frequent phrase: 64 MB on each worker.
MOST_BITS = 29


def _dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ends of a binary column without nulls."""
    column = column.fill_null(b"").cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts in order, the text of each, and the piece: pieces count on from text to text."""
    data, ends = _dense(texts)
    data = data[ends[0] : ends[-1]]
    # A break before each text, so that no piece and no word goes on from one to the next.
    starts = ends[:-1] - ends[0]
    data, kinds = np.insert(data, starts, ord(".")), None
    kinds = KIND[data]
    inside = np.concatenate([[False], kinds == WORD, [False]])
    edge = np.diff(inside.astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    packed = LOWER[data[kinds == WORD]]
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
    piece = np.cumsum(kinds == BREAK, dtype=np.int32)[begin]
    text = np.searchsorted(starts + np.arange(len(starts)), begin, side="right") - 1
    return words, text, piece


def _numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _langs(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    ids, names = _numbered(column.fill_null(b"und"))
    return ids, names.to_pylist()


def _key(lang: bytes, word: bytes) -> int:
    """64 bits of a word in its language. Different words that share them only make a filter let more through."""
    return int.from_bytes(hashlib.blake2b(lang + END + word, digest_size=8).digest(), "little", signed=True)


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64 bits of two words in their order."""
    x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.int64(len(bits) * 8 - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


class Read:
    """A batch of (lang, text) as words in order: `ids` of names, `lang` and `piece` of each, and the keys of words in their languages."""

    def __init__(self, batch: pa.RecordBatch):
        lang, self.langs = _langs(batch.column(0))
        words, text, self.piece = _words(batch.column(1))
        self.ids, self.names = _numbered(words)
        self.lang = lang[text]
        self.pairs, self.where, self.counts = np.unique(self.lang * max(1, len(self.names)) + self.ids, return_inverse=True, return_counts=True)

    def spelled(self) -> tuple[pa.Array, pa.Array]:
        """Language and word of each distinct pair."""
        n = max(1, len(self.names))
        return pa.array(self.langs, pa.binary()).take(pa.array(self.pairs // n)), self.names.cast(pa.binary()).take(pa.array(self.pairs % n))

    def keys(self) -> np.ndarray:
        """The key of each word in order."""
        lang, word = self.spelled()
        own = np.array([_key(x, y) for x, y in zip(lang.to_pylist(), word.to_pylist())], np.int64)
        return own[self.where] if len(own) else np.zeros(0, np.int64)

    def joined(self, often: np.ndarray, keys: np.ndarray, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word and the next stand in one piece and can both be frequent, and with pairs, as a pair, too; and the keys of those that do."""
        both = often[:-1] & often[1:] & (self.piece[:-1] == self.piece[1:])
        at = np.flatnonzero(both)
        own = _pair_keys(keys[at], keys[at + 1])
        if pairs is not None:
            both[at[~_has(pairs, own)]] = False
        return both, own


def _count_words(batches):
    """lang, word, key, n: each batch's words with their numbers."""
    for batch in batches:
        read = Read(batch)
        lang, word = read.spelled()
        keys = [_key(x, y) for x, y in zip(lang.to_pylist(), word.to_pylist())]
        yield pa.RecordBatch.from_arrays([lang, word, pa.array(keys, pa.int64()), pa.array(read.counts, pa.int64())], ["lang", "word", "key", "n"])


def _count_pairs(often: np.ndarray, batches):
    """key, n: each batch's pairs of words that can be frequent."""
    for batch in batches:
        read = Read(batch)
        keys = read.keys()
        _, own = read.joined(_has(often, keys), keys, None)
        own, n = np.unique(own, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])


def _suffixes(often: np.ndarray, pairs: np.ndarray, max_n: int, batches):
    """lang, suffix, n: from each position the next words, up to max_n, as long as word after word makes a pair that can be frequent; two at least."""
    for batch in batches:
        read = Read(batch)
        keys = read.keys()
        on, _ = read.joined(_has(often, keys), keys, pairs)
        on = np.append(on, False) if len(keys) else on
        del keys
        rare = len(read.names)
        ended = pc.binary_join_element_wise(read.names.cast(pa.binary()), pa.scalar(END, pa.binary()), pa.scalar(b"", pa.binary()))
        ended = pa.concat_arrays([ended, pa.array([b""], pa.binary())])
        starts = np.flatnonzero(on)
        for at in range(0, len(starts), SLICE):
            here = starts[at : at + SLICE]
            columns, alive = [read.ids[here]], np.ones(len(here), bool)
            for k in range(1, max_n):
                alive = alive & on[np.minimum(here + k - 1, len(on) - 1)]
                columns.append(np.where(alive, read.ids[np.minimum(here + k, len(on) - 1)], rare))
            # Two words make a number: fewer keys to hash.
            keyed = {"lang": read.lang[here]} | {f"p{k}": columns[k] * (rare + 1) + (columns[k + 1] if k + 1 < max_n else rare) for k in range(0, max_n, 2)}
            table = pa.table(keyed | {"n": np.ones(len(here), np.int64)}).group_by(list(keyed)).aggregate([("n", "sum")])
            for j in range(0, len(table), 1 << 17):
                some = table.slice(j, 1 << 17)
                parts = [table_column // (rare + 1) if k % 2 == 0 else table_column % (rare + 1) for k in range(max_n) for table_column in [some[f"p{k - k % 2}"].to_numpy()]]
                suffix = pc.binary_join_element_wise(*[ended.take(pa.array(p)) for p in parts], pa.scalar(b"", pa.binary()))
                lang = pa.array(read.langs, pa.binary()).take(pa.array(some["lang"].to_numpy()))
                yield pa.RecordBatch.from_arrays([lang, suffix, pa.array(some["n_sum"].to_numpy(), pa.int64())], ["lang", "suffix", "n"])


def _bits(keys: DataFrame, count: int) -> np.ndarray:
    """A bit for each key(key): as many as sixteen for each, at most 2^MOST_BITS. Put together by Spark; what comes to the driver is no larger than the bits."""
    size = max(15, min(MOST_BITS, (16 * count).bit_length()))
    place = F.col("key").bitwiseAND(F.lit((1 << size) - 1)) + 1
    maps = keys.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("map"))
    bits = np.zeros(1 << (size - 3), np.uint8)
    for r in maps.toLocalIterator():
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["map"], np.uint8)
    return bits


def _stack(max_n: int, least: int):
    """lang, phrase, n: all prefixes of a partition's sorted suffixes with their summed numbers.

    The stack holds the prefixes of the last suffix, each with what it has counted. A suffix that doesn't share a prefix pops it, and it
    is counted out. The pushes and pops of a batch are found level by level. Prefixes of a partition's first and last suffix may go on in
    the neighbouring ones and are handed on whatever their number; all others only if it reaches `least`.
    """

    def run(batches):
        stack: list[tuple] = []  # of each level: (language, prefix), number, whether the partition began with it
        started = False
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            data, ends = _dense(batch.column(1))
            n = batch.column(2).to_numpy()
            total = np.concatenate([[0], np.cumsum(n)])
            # Words of all suffixes as numbers, a column for each level; 0 where a suffix has no such word.
            body = data[ends[0] : ends[-1]]
            stops = np.flatnonzero(body == END[0]) + ends[0]
            count = np.searchsorted(stops, ends[1:]) - np.searchsorted(stops, ends[:-1])
            row = np.repeat(np.arange(rows), count)
            level = np.arange(len(stops)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.concatenate([[ends[0]], stops[:-1] + 1])
            packed = body[body != END[0]]
            words = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(stops - begin)]).astype(np.int64)), pa.py_buffer(packed)])
            ids, _ = _numbered(words)
            grid = np.zeros((rows, max_n), np.int64)
            grid[row, level] = ids + 1
            upto = np.zeros((rows, max_n), np.int64)  # where each prefix ends
            upto[row, level] = stops + 1
            lang, langs = _langs(batch.column(0))
            same = np.concatenate([[False], lang[1:] == lang[:-1]])
            new_stack = []
            out_lang, out_phrase, out_n = [], [], []

            def put(key, number):
                out_lang.append(key[0])
                out_phrase.append(key[1])
                out_n.append(number)

            whole = lambda j, k: (langs[lang[j]], data[ends[j] : upto[j, k]].tobytes())  # noqa: E731, B023
            for k in range(max_n):
                has = grid[:, k] > 0
                same = same & np.concatenate([[False], grid[1:, k] == grid[:-1, k]]) & has
                # A run of equal prefixes begins where the one before differs.
                first = np.flatnonzero(has & ~same)
                inside = np.flatnonzero(has)
                if len(first):
                    last = np.append(inside[np.searchsorted(inside, first[1:]) - 1], inside[-1])
                    number = total[last + 1] - total[first]
                else:
                    last = number = np.zeros(0, np.int64)
                begun = [not started and j == 0 for j in first.tolist()]
                opened = stack[k] if k < len(stack) else None
                keep = number >= least
                if len(first):
                    keep[[j for j, b in enumerate(begun) if b]] = True
                    if first[0] == 0 and opened is not None and opened[0] == whole(0, k):
                        # The prefix that was open goes on.
                        number[0] += opened[1]
                        begun[0], keep[0] = opened[2], opened[2] or number[0] >= least
                        opened = None
                if opened is not None and (opened[1] >= least or opened[2]):
                    put(opened[0], opened[1])
                still = len(first) and last[-1] == rows - 1
                done = len(first) - bool(still)
                for j in np.flatnonzero(keep[:done]).tolist():
                    put(whole(first[j], k), int(number[j]))
                new_stack.append((whole(first[-1], k), int(number[-1]), begun[-1]) if still else None)
            stack, started = new_stack, True
            yield pa.RecordBatch.from_arrays([pa.array(out_lang, pa.binary()), pa.array(out_phrase, pa.binary()), pa.array(out_n, pa.int64())], ["lang", "phrase", "n"])
        left = [s for s in stack if s]
        yield pa.RecordBatch.from_arrays([pa.array([s[0][0] for s in left], pa.binary()), pa.array([s[0][1] for s in left], pa.binary()), pa.array([s[1] for s in left], pa.int64())], ["lang", "phrase", "n"])

    return run


def frequent_phrases(docs: DataFrame, *, max_n: int = 5, least: int = 100, text_column: str = "text", lang_column: str = "lang", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, len, n of all phrases of 1 to max_n words that occur `least` times or more in their language; and lang, n: the words of each.

    Words and pairs of neighbours that occur less often can't be in such a phrase, so suffixes end before them: a bit for each hash of a frequent word or pair,
    whose number follows them and has a bound, tells workers which they are; a rare one that shares a bit only makes a suffix longer. Suffixes are
    counted in a batch before they are shuffled by language, first word and the words after it, a frequent first word over many partitions.
    """
    shipped(__name__)
    spark = docs.sparkSession
    small_batches(spark, rows=10_000, size=4 << 20)
    scratch = scratch or Scratch(spark, "phrases")
    own = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).cast("binary").alias("lang"), text_of(text_column).cast("binary").alias("text"))
    words = own.mapInArrow(_count_words, "lang binary, word binary, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    words = scratch.save(words, "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.filter(F.col("n") >= least)
    often_bits = spark.sparkContext.broadcast(_bits(often, often.count()))
    pairs = own.mapInArrow(lambda batches: _count_pairs(often_bits.value, batches), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = scratch.save(pairs.filter(F.col("n") >= least).select("key"), "pairs")
    pair_bits = spark.sparkContext.broadcast(_bits(pairs, pairs.count()))
    # Written once: dealing by range reads the table twice.
    suffixes = scratch.save(own.mapInArrow(lambda batches: _suffixes(often_bits.value, pair_bits.value, max_n, batches), "lang binary, suffix binary, n long"), "suffixes")
    dealt = suffixes.repartitionByRange("lang", "suffix").sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
    counted = dealt.mapInArrow(_stack(max_n, least), "lang binary, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    text = F.expr("substring(replace(cast(phrase as string), '\\n', ' '), 1, length(cast(phrase as string)) - 1)")
    phrases = counted.select(F.col("lang").cast("string").alias("lang"), text.alias("phrase"), (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).alias("len"), "n")
    single = often.select(F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("phrase"), F.lit(1).alias("len"), "n")
    return scratch.save(phrases.filter("len >= 2").unionByName(single), "phrases"), sizes.select(F.col("lang").cast("string").alias("lang"), "n")


def exact_score(a: Column, n: Column, left: Column, right: Column, scale: int = 1000) -> Column:
    """floor(scale * a * n / (left * right)) in decimals of 38 digits; n up to 10^18, the others up to 10^15."""
    number = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", number(a * F.lit(scale), 19) * number(n, 18), number(left, 19) * number(right, 18))


def collocations(docs: DataFrame, *, max_n: int = 5, least: int = 100, top: int = 2000, percent: int = 100, salts: int = 64, **options) -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to max_n words inside pieces of text that occur a >= least times are cut after each of their words; l and r are the
    numbers of both parts, n all words of the language, and the lowest floor(1000 a n / (l r)) is the score, of equal ones that of the
    shortest first part. Those whose words lie inside a longer phrase with at least `percent` hundredths of their occurrences are left out:
    what holds for a longer phrase holds for one between of one word more, so only those are joined.

    Null texts are empty; a null language is "und". Repeated rows count each for itself; other columns are ignored. Equal scores go by a, then by the
    phrase's bytes. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    phrases, sizes = frequent_phrases(docs, max_n=max_n, least=least, scratch=scratch, **options)
    long = phrases.filter("len >= 2")
    counted = phrases.count()
    cut = long.select("lang", "phrase", F.col("n").alias("a"), F.col("len"), F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    first, rest = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring_index(phrase, ' ', k - len)")
    part = lambda name, n: bounded_broadcast(phrases.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(name), F.col("n").alias(n)), counted)
    cut = cut.withColumn("first", first).withColumn("rest", rest)
    cut = cut.join(part("left_part", "l"), (F.col("lang") == F.col("left_part_lang")) & (F.col("first") == F.col("left_part")))
    cut = cut.join(part("right_part", "r"), (F.col("lang") == F.col("right_part_lang")) & (F.col("rest") == F.col("right_part")))
    sizes = scratch.save(sizes, "sizes")
    cut = cut.join(bounded_broadcast(sizes.withColumnRenamed("lang", "of"), sizes.count()), F.col("lang") == F.col("of"))
    cut = cut.withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    wider = phrases.filter("len >= 3")
    ends = F.array(F.expr("substring_index(phrase, ' ', len - 1)"), F.expr("substring_index(phrase, ' ', 1 - len)"))
    covers = wider.select("lang", F.col("n"), F.explode(ends).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("wide"))
    best = best.join(covers, ["lang", "phrase"], "left").filter(F.col("wide").isNull() | (100 * F.col("wide") < percent * F.col("a")))
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each salted share, then of the shares: no task orders all phrases of a language.
    share = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("place", share).filter(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
