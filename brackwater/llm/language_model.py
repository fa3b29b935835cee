"""Language-model scoring by logistic context mixing of hashed-context bit predictors."""

from __future__ import annotations

from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder, shipped, small_batches, text_of

shipped(__name__)

#: What ends a text, as a token; no word holds it. A spelled word's bytes are followed by STOP, which no word holds either.
END, STOP = b"\n", 32
#: Distinct tokens that a worker counts at most at a time, and those that one with a model knows; bytes of text cut into tokens at once; tokens and decisions worked on at once.
KNOWN, NAMED, SLICE, RUN, BLOCK = 300_000, 130_000, 1 << 21, 100_000, 60_000
#: Tokens whose counts every worker has, their bytes at most, and how many of them have a symbol of their own. All others are spelled.
HOT, LONGEST, SYMBOLS = 1 << 18, 64, 1 << 16
#: Frequent tokens, the last of which is a context; tokens that are contexts by themselves for the next one.
FREQUENT, COMMON = 128, 4096
#: Hashes of rare tokens in one chunk, whose counts are looked up together.
CHUNK = 4_000_000
#: Slots that go from a task to the sums in one piece.
PIECE = 1 << 16
#: Numbers of last bytes that are contexts in a spelled word, and bits of their tables and of that of the word's whole beginning.
SPELLED_ORDERS, SPELLED_BITS = (2, 4, 6), (18, 20, 21, 21)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case, split at ASCII white space, and the end."""
    out = text.lower().split()
    out.append(END)
    return out


class Coded(NamedTuple):
    """The tokens of several texts: the distinct ones, each one's number among them, how many each text has, and where each text starts."""

    words: pa.Array
    keys: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray

    @property
    def distinct(self) -> list[bytes]:
        return listed(self.words)


def listed(words: pa.Array) -> list[bytes]:
    """The strings of an array without nulls, in bytes."""
    _, offsets, data = words.buffers()
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    at = np.frombuffer(offsets, kind)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(at, at[1:])]


def coded(column: pa.Array) -> Coded:
    """The tokens_of each text of a column in bytes; Arrow lowers, splits and numbers them."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(column.view(pa.large_string() if pa.types.is_large_binary(column.type) else pa.string())))
    flat, ends = words.flatten(), np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.binary_length(flat).to_numpy() > 0  # before and after white space at an end there is an empty word
    upto = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], ends])]
    each = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
    distinct, sizes = each.dictionary.cast(pa.binary()), np.diff(upto) + 1
    keys = np.full(int(sizes.sum()), len(distinct), np.int64)
    keys[np.arange(len(each)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = each.indices.to_numpy()
    return Coded(pa.concat_arrays([distinct, pa.array([END], pa.binary())]), keys, sizes, np.cumsum(sizes) - sizes)


def slices(batches, column: int):
    """Batches in slices of about SLICE bytes of text, or of one text that is longer: what a worker makes of tokens takes many times their room."""
    for batch in batches:
        for lo, hi in blocks(pc.binary_length(batch.column(column)).to_numpy(), SLICE):
            yield batch.slice(lo, hi - lo)


class Names:
    """Small numbers for tokens, given as they come, and their hashes. Arrow looks up those that have one."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.known, self.hashes = pa.array([], pa.binary()), np.zeros(0, np.uint64)

    @property
    def tokens(self) -> list[bytes]:
        return listed(self.known)

    def add(self, new: list[bytes]) -> None:
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])

    def keys_of(self, texts: Coded) -> np.ndarray:
        """The numbers of all tokens of all texts."""
        own = pc.fill_null(pc.index_in(texts.words, value_set=self.known), -1).to_numpy().astype(np.int64)
        late = own < 0
        own[late] = np.arange(len(self.known), len(self.known) + late.sum())
        new = texts.words.filter(pa.array(late))
        self.known = pa.concat_arrays([self.known, new])
        self.add(listed(new))
        return own[texts.keys]


class Vocabulary(Names):
    """Names with what a model knows of a token: its place among those whose counts all have, the symbol that stands for it, and what it is as a context: its rank, or its last two bytes."""

    def __init__(self, index: dict[bytes, int], symbol: np.ndarray, rank: np.ndarray):
        self.index, self.unknown, self.symbol, self.rank = index, len(index), symbol, rank
        super().__init__()

    def reset(self) -> None:
        super().reset()
        self.places, self.ids, self.contexts = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, new: list[bytes]) -> None:
        super().add(new)
        places = np.fromiter(map(self.index.get, new, repeat(self.unknown)), np.int64, len(new))
        ids, size = self.symbol[places], np.fromiter(map(len, new), np.int64, len(new))
        ends, data = np.cumsum(size) + 1, np.frombuffer(b"\0\0" + b"".join(new), np.uint8).astype(np.int64)
        last = data[ends] + 256 * np.where(size > 1, data[ends - 1], 0)
        contexts = np.where(self.rank[ids] > 0, self.rank[ids], COMMON + 1 + last)
        self.places, self.ids, self.contexts = (np.concatenate(x) for x in ((self.places, places), (self.ids, ids), (self.contexts, contexts)))


def token_counts(docs: DataFrame) -> DataFrame:
    """docs(text), in bytes, to token, h, c: how often each token occurs."""

    def run(batches):
        names = Names()
        total = np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([names.known, pa.array(names.hashes.view(np.int64)), pa.array(total)], names=["token", "h", "n"])

        for batch in slices(batches, 0):
            keys = names.keys_of(coded(batch.column(0)))
            new = np.bincount(keys, minlength=len(names.known))
            new[: len(total)] += total
            total = new
            if len(names.known) >= KNOWN:
                yield out()
                names.reset()
                total = np.zeros(0, np.int64)
        yield out()

    return docs.mapInArrow(run, "token binary, h long, n long").groupBy("token", "h").agg(F.sum("n").alias("c"))


class Code(NamedTuple):
    """A binary code that keeps the order of its symbols: symbol s takes length[s] decisions, at the nodes that start at first[s]. At a node it goes right if it isn't below it."""

    length: np.ndarray
    first: np.ndarray
    node: np.ndarray


def balanced(weights) -> Code:
    """Each range of symbols is cut where both sides weigh most alike; a cut lies before the symbol whose number the node has."""
    upto = np.concatenate([[0.0], np.cumsum(np.asarray(weights, float))])
    n = len(upto) - 1
    low, high, levels = np.zeros(n, np.int64), np.full(n, n, np.int64), []
    live = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    while len(live):
        lo, hi = low[live], high[live]
        middle = (upto[lo] + upto[hi]) / 2
        cut = np.searchsorted(upto, middle)
        cut -= (cut > 0) & (middle - upto[np.maximum(cut - 1, 0)] < upto[np.minimum(cut, n)] - middle)
        cut = np.clip(cut, lo + 1, hi - 1)
        levels.append((live, cut))
        right = live >= cut
        low[live], high[live] = np.where(right, cut, lo), np.where(right, hi, cut)
        live = live[high[live] - low[live] > 1]
    length = np.zeros(n, np.int64)
    for at, _ in levels:
        length[at] += 1
    first = np.cumsum(length) - length
    node = np.zeros(int(length.sum()), np.int32)
    for k, (at, cut) in enumerate(levels):
        node[first[at] + k] = cut
    return Code(length, first, node)


def path(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decisions of symbols one after the other: their nodes, how many each symbol takes, and where they start."""
    size = code.length[symbols]
    start = np.cumsum(size) - size
    return code.node.take(np.repeat(code.first[symbols] - start, size) + np.arange(int(size.sum()))), size, start


def mixed_in(node: np.ndarray) -> np.ndarray:
    return node.astype(np.uint64) * M1


def slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of decisions in a table, from their contexts' hashes and what mixed_in makes of their nodes."""
    x = context + node
    x *= M2
    x >>= np.uint64(64 - bits)
    return x.view(np.int64)


class Shape(NamedTuple):
    """Bits of the tables: after the last frequent token, after the token before, and of what followed two tokens."""

    frequent: int
    before: int
    follows: int


def sized(n: int, most: int) -> Shape:
    """Tables for n tokens: two, four and two slots a token, up to 2 to the power `most`, but for the first, of which a half is enough."""
    bits = lambda x, least, top: min(top, max(least, (max(x, 1) - 1).bit_length()))
    return Shape(bits(2 * n, 16, most - 1), bits(4 * n, 16, most), bits(2 * n, 16, most + 1))


def odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds of a one after so many zeros and ones."""
    out = (ones + np.float32(0.3)) / (zeros + np.float32(0.3))
    return np.log(out, out=out)


#: Workers that score have two counts of a slot in 16 bits: the log-odds of each such pair.
ODDS = odds((np.arange(65_536) & 255).astype(np.float32), (np.arange(65_536) >> 8).astype(np.float32))


def steps_of(n: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """How much has been seen, in four steps."""
    return (n >= limits[0]).view(np.uint8) + (n >= limits[1]).view(np.uint8) + (n >= limits[2]).view(np.uint8)


FEW, OFTEN = (1, 2, 5), (3, 17, 129)


def moved(x: np.ndarray) -> np.ndarray:
    """Each element's predecessor, 0 before the first."""
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    return out


class Stream(NamedTuple):
    """Tokens of several texts in order, with what stands before each."""

    ids: np.ndarray
    frequent: np.ndarray
    before: np.ndarray
    key: np.ndarray
    place: np.ndarray


def stream(ids: np.ndarray, hashes: np.ndarray, contexts: np.ndarray, starts: np.ndarray) -> Stream:
    """Contexts of all tokens: the last frequent token, the token before (contexts of COMMON ranks, or of last bytes), and the key of the two before; nothing is known before a text."""
    n = len(ids)
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    place = np.arange(n) - begin
    last = moved(hashes)
    last[starts] = 0
    two = moved(last)
    two[starts] = 0
    before = moved(contexts)
    before[starts] = 0
    often = np.maximum.accumulate(np.where(contexts <= FREQUENT, np.arange(n), -1))
    often = np.concatenate([[-1], often[:-1]])
    frequent = np.where(often >= begin, contexts[often], 0).astype(np.uint64) * M3
    key = (last * M1 + two) * M2
    key ^= key >> np.uint64(29)
    return Stream(ids, frequent, before.astype(np.uint64) * M3, key * M3, place)


class Tables(NamedTuple):
    """What all workers know of the counts: a code of symbols, ranks of the frequent ones, a code of bytes, shapes, and each slot's two counts; with what followed two tokens."""

    symbols: Code
    rank: np.ndarray
    letters: Code
    shape: Shape
    counts: np.ndarray
    follows: np.ndarray


def packed(t: Tables, m: Mixer) -> list:
    """All arrays as bytes, compressed, with kind and length: what a broadcast can carry to workers without this module, in little room on their disks."""
    flat = [*t.symbols, t.rank, *t.letters, t.counts, t.follows, *m]
    return [tuple(t.shape), *[(str(x.dtype), x.shape, x.nbytes, pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)) for x in flat]]


def unpacked(x: list) -> tuple[Tables, Mixer]:
    """What packed made. Arrays take the place of their bytes in x, one by one: a worker holds no array twice, and its next task finds them unpacked."""
    for k, part in enumerate(x):
        if k and isinstance(part, tuple):
            kind, size, n, b = part
            x[k] = np.frombuffer(pa.decompress(b, n, "zstd", asbytes=True), kind).reshape(size)
    shape, *flat = x
    return Tables(Code(*flat[:3]), flat[3], Code(*flat[4:7]), Shape(*shape), *flat[7:9]), Mixer(*flat[9:])


def regions(n_symbols: int, shape: Shape) -> np.ndarray:
    """Where the slots of each context start: of no context, a node each; of the last frequent token; of the token before; and of what stands before in a spelled word."""
    return np.cumsum([0, n_symbols, 1 << shape.frequent, 1 << shape.before, *(1 << b for b in SPELLED_BITS)])


def blocks(size: np.ndarray, most: int = BLOCK):
    """Ranges of about so many decisions, tokens or bytes."""
    upto = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def token_slots(t: Tables, s: Stream, lo: int, hi: int):
    """The decisions of tokens lo to hi: their nodes, bits and slots, how many each token takes, and where they start."""
    ids, first = s.ids[lo:hi], regions(len(t.symbols.length), t.shape)
    node, size, start = path(t.symbols, ids)
    bit, hashed = np.repeat(ids, size) >= node, mixed_in(node)
    return node, bit, (node, slot(np.repeat(s.frequent[lo:hi], size), hashed, t.shape.frequent) + first[1], slot(np.repeat(s.before[lo:hi], size), hashed, t.shape.before) + first[2]), size, start


def spelled_slots(t: Tables, words: list[bytes]):
    """For blocks of the decisions of spelled words, in order: each one's word, bit and four slots. A word is one byte of STOP longer."""
    first = regions(len(t.symbols.length), t.shape)[3:]
    lo = total = 0
    for k, w in enumerate(words):
        total += len(w) + 1
        if total * 5 < BLOCK and k + 1 < len(words):
            continue
        some = words[lo : k + 1]
        data = np.frombuffer(b" ".join([*some, b""]), np.uint8).astype(np.int64)
        size = np.array([len(x) + 1 for x in some])
        start = np.cumsum(size) - size
        place = np.arange(len(data)) - np.repeat(start, size)
        packed, contexts = np.zeros(len(data), np.uint64), []
        for order in range(1, SPELLED_ORDERS[-1] + 1):  # the last bytes, 0 before the word
            back = np.zeros(len(data), np.uint64)
            back[order:] = data[:-order].astype(np.uint64) + np.uint64(1)
            back[place < order] = 0
            packed = packed * np.uint64(257) + back
            if order in SPELLED_ORDERS:
                contexts.append(packed * M3)
        power = np.cumprod(np.full(int(size.max()), 0x5851F42D4C957F2D, np.uint64))
        before = moved(np.cumsum(data.astype(np.uint64) * power[place], dtype=np.uint64))
        contexts.append((before - np.repeat(before[start], size)) * M3)
        word = np.repeat(np.arange(lo, k + 1), size)
        for a, b in blocks(t.letters.length[data]):
            node, reps, _ = path(t.letters, data[a:b])
            hashed = mixed_in(node)
            yield np.repeat(word[a:b], reps), np.repeat(data[a:b], reps) >= node, [slot(np.repeat(c[a:b], reps), hashed, bits) + f for c, bits, f in zip(contexts, SPELLED_BITS, first)]
        lo, total = k + 1, 0


def spelled_of(batch, t: Tables, times):
    """spelled_slots of a batch of totals(token, c), with how often each word counts; those that count 0 times are left out."""
    rows = [(w, n) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w != END and (n := times(w, c))]
    counts = np.array([n for _, n in rows], np.int64)
    for word, bit, slots in spelled_slots(t, [w for w, _ in rows]):
        yield word, bit, slots, counts


# What followed two tokens: in 32 bits 8 of a check, 18 of the symbol that prevailed, and by how many it did, at most 63.
def prevailing(key: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, check with symbol, and by how many that one prevails there; slots where none does are left out."""
    where = (key >> np.uint64(64 - bits)).view(np.int64)
    both, n = np.unique((where << 26) | ((key & np.uint64(255)).view(np.int64) << 18) | ids, return_counts=True)
    where, value = both >> 26, both & ((1 << 26) - 1)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    if not len(first):
        return where, value, n
    best = np.maximum.reduceat((n << 26) | value, first)
    ahead = 2 * (best >> 26) - np.add.reduceat(n, first)
    keep = ahead > 0
    return where[first][keep], (best & ((1 << 26) - 1))[keep], ahead[keep]


def prevailed(old: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Entries after n more votes for value: votes for the same one add up, others cancel out."""
    held, votes = (old >> np.uint32(6)).astype(np.int64), (old & np.uint32(63)).astype(np.int64)
    same = held == value
    left = np.where(same, votes + n, np.abs(votes - n))
    return ((np.where(same | (votes >= n), held, value) << 6) | np.minimum(left, 63)).astype(np.uint32)


def follower(t: Tables, s: Stream, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The symbol that prevailed after the two tokens before each token, -1 for none, and how often. With own, that one occurrence of such tokens is left out."""
    entry = t.follows.take((s.key >> np.uint64(64 - t.shape.follows)).view(np.int64))
    votes, found = (entry & np.uint32(63)).astype(np.int64), ((entry >> np.uint32(6)) & np.uint32((1 << 18) - 1)).astype(np.int64)
    if own is not None:
        votes = votes - (own & (found == s.ids) & (votes < 63))
    known = (votes > 0) & ((entry >> np.uint32(24)) == (s.key & np.uint64(255)).astype(np.uint32)) & (s.place > 1)
    return np.where(known, found, -1), votes


def runs(found: np.ndarray, s: Stream) -> np.ndarray:
    """How many tokens in a row, up to the one before, followed as they had before: 0 none, 1 fewer than four, 2 more."""
    n = np.arange(len(found))
    miss = np.maximum.accumulate(np.where(found == s.ids, -1, n))
    miss = np.concatenate([[-1], miss[:-1]])
    run = n - 1 - np.maximum(miss, n - s.place - 1)
    return np.searchsorted([1, 4], run, side="right")


VOTES = np.log((np.arange(64) + 0.3) / 0.3).astype(np.float32)
#: Gates of tokens: whether a follower is known and how long it has been right, how much has been seen after the token before, and after the frequent one. Gates of bytes: how much has been seen after the word's beginning, and after the last six bytes.
INPUTS, GATES, STEPS, FINE, EDGE = 4, 80, 32, 1024, 12.0


class Seen(NamedTuple):
    """What is known of decisions in each of their contexts: log-odds, and how much has been seen in the last two."""

    odds: list[np.ndarray]
    n: list[np.ndarray]


def learned(counts: np.ndarray, slots) -> Seen:
    """From the counts that a task adds to."""
    pairs = [counts.take(k, axis=0) for k in slots]
    halves = [(p[:, 0].astype(np.float32), p[:, 1].astype(np.float32)) for p in pairs]
    return Seen([odds(*h) for h in halves], [a + b for a, b in halves[-2:]])


def known(counts: np.ndarray, slots) -> Seen:
    """From the counts of all tasks, in 16 bits."""
    pairs = [counts.take(k) for k in slots]
    return Seen([ODDS.take(p) for p in pairs], [(p >> np.uint16(8)) + (p & np.uint16(255)) for p in pairs[-2:]])


def token_inputs(seen: Seen, node, bit, size, found, votes, run) -> tuple[np.ndarray, np.ndarray]:
    """The predictors' log-odds and the gates of tokens' decisions, from the counts of their slots and from what followed before, as long as the token agrees with that."""
    x = [*seen.odds, np.zeros(len(bit), np.float32)]
    gate = steps_of(seen.n[1], FEW) * np.uint8(4) + steps_of(seen.n[0], OFTEN)
    has = np.flatnonzero(found >= 0)
    if len(has):
        own = size[has]
        head = np.cumsum(own) - own
        j = np.repeat((np.cumsum(size) - size)[has] - head, own) + np.arange(int(own.sum()))
        says = np.repeat(found[has], own) >= node[j]
        wrong = says != bit[j]
        before = np.cumsum(wrong) - wrong
        agrees = before == np.repeat(before[head], own)
        sure = np.repeat(VOTES[votes[has]], own)
        x[3][j] = np.where(agrees, np.where(says, sure, -sure), 0)
        gate[j] += np.where(agrees, np.repeat((run[has] + 1) * 16, own), 0).astype(np.uint8)
    return x, gate


def spelled_inputs(seen: Seen) -> tuple[np.ndarray, np.ndarray]:
    return seen.odds, np.uint8(64) + steps_of(seen.n[1], FEW) * np.uint8(4) + steps_of(seen.n[0], OFTEN)


class Mixer(NamedTuple):
    """Weights by input and gate, and log10 of the refined probability by gate, step of the mixed log-odds, and bit."""

    weights: np.ndarray
    log10s: np.ndarray

    def log10(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        g = gate.astype(np.int64)
        z = self.weights[0][g] * x[0]
        for k in range(1, INPUTS):
            z += self.weights[k][g] * x[k]
        np.clip(z, -EDGE, EDGE, out=z)
        z += np.float32(EDGE)
        z *= np.float32((FINE - 1) / (2 * EDGE))
        g *= FINE
        g += np.rint(z, out=z).astype(np.int64)
        g *= 2
        g += bit
        return self.log10s[g]


def refined(weights: np.ndarray, hits: np.ndarray) -> Mixer:
    """The probability of a one is half what is mixed, and half what came true at such a gate and step, read between two of them."""
    centre = 1 / (1 + np.exp(-np.linspace(-EDGE, EDGE, STEPS)))
    true = (hits[:, :, 1] + 20 * centre) / (hits.sum(2) + 20)
    z = np.linspace(-EDGE, EDGE, FINE)
    between = np.stack([np.interp(z, np.linspace(-EDGE, EDGE, STEPS), row) for row in true])
    p = np.clip(0.5 / (1 + np.exp(-z)) + 0.5 * between, 1e-6, 1 - 1e-6)
    return Mixer(np.ascontiguousarray(weights.T, np.float32), np.log10(np.stack([1 - p, p], 2)).astype(np.float32).ravel())


class Learner:
    """Gated weights that follow decisions online; steps are scaled by the curvature gathered so far."""

    def __init__(self):
        self.weights, self.curve = np.full((GATES, INPUTS), 1 / 3), np.repeat(np.eye(INPUTS)[None] * 2.0, GATES, 0)
        self.hits = np.zeros(GATES * STEPS * 2)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> None:
        """One step; times says how often each decision counts."""
        order = np.argsort(gate, kind="stable")
        gate, bit, x = gate[order], bit[order], [row[order] for row in x]
        start = np.concatenate([[0], np.flatnonzero(gate[1:] != gate[:-1]) + 1])
        size, here = np.diff([*start, len(gate)]), gate[start].astype(np.int64)
        weights = self.weights.astype(np.float32)
        z = sum(np.repeat(weights[here, k], size) * x[k] for k in range(INPUTS))
        np.clip(z, -EDGE, EDGE, out=z)
        p = 1 / (1 + np.exp(-z))
        low = np.rint((z + np.float32(EDGE)) * np.float32((STEPS - 1) / (2 * EDGE))).astype(np.int64)
        off, slope = bit - p, p * (1 - p)
        if times is not None:
            times = times.take(order)
            off, slope = off * times, slope * times
        self.hits += np.bincount((np.repeat(here * STEPS, size) + low) * 2 + bit, times, len(self.hits))
        pull, curve = np.empty((len(here), INPUTS)), np.empty((len(here), INPUTS, INPUTS))
        for i in range(INPUTS):
            pull[:, i] = np.add.reduceat(off * x[i], start)
            part = slope * x[i]
            for k in range(i, INPUTS):
                curve[:, i, k] = curve[:, k, i] = np.add.reduceat(part * x[k], start)
        self.curve[here] += curve
        self.weights[here] += np.linalg.solve(self.curve[here], pull[:, :, None])[:, :, 0]

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.curve, np.einsum("gij,gj->gi", self.curve, self.weights), self.hits


def few(docs: DataFrame) -> DataFrame:
    """docs in fewer tasks, as each hands on whole tables: a quarter of them, but as many as there are cores."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.rdd.getNumPartitions() // 4)))


def streams(batches, names: Vocabulary, size: int = RUN):
    """Texts as streams of about so many tokens, so that each is predicted from those before it."""
    for batch in batches:
        held, sizes = [np.zeros(0, kind) for kind in (np.int64, np.uint64, np.int64)], np.zeros(0, np.int64)
        for part in slices([batch], 0):
            if len(names.known) >= NAMED:
                names.reset()
            texts = coded(part.column(0))
            keys = names.keys_of(texts)
            held = [np.concatenate([x, new[keys]]) for x, new in zip(held, (names.ids, names.hashes, names.contexts))]
            sizes = np.concatenate([sizes, texts.sizes])
            while len(held[0]) >= size:
                ends = np.cumsum(sizes)
                n = int(np.searchsorted(ends, size)) + 1
                yield stream(*(x[: ends[n - 1]] for x in held), ends[:n] - sizes[:n])
                held, sizes = [x[ends[n - 1] :] for x in held], sizes[n:]
        if len(sizes):
            yield stream(*held, np.cumsum(sizes) - sizes)


#: The piece that holds what a task has learned of weights.
WEIGHTS = 1 << 30


def rows_of(counts: np.ndarray, follows: np.ndarray, learner: Learner):
    """What a task hands on: of every PIECE slots zeros and ones, a byte for each and what is more by itself; what followed two tokens, as pieces below 0; and what was learned."""
    none, counts = np.zeros(0, np.int32), counts.ravel()
    for k in range(0, len(counts), 2 * PIECE):
        part = counts[k : k + 2 * PIECE]
        if part.any():
            at = np.flatnonzero(part > 255).astype(np.int32)
            yield k // (2 * PIECE), part.astype(np.uint8), at, part[at] >> 8
    for k in range(0, len(follows), PIECE):
        if follows[k : k + PIECE].any():
            yield -1 - k // PIECE, follows[k : k + PIECE], none, none
    yield WEIGHTS, *learner.told()


def summed(group: pa.Table) -> pa.Table:
    """One piece of all tasks: two bytes for each slot, larger counts scaled down in proportion; what prevails after two tokens; sums of what was learned."""
    piece = group.column("piece")[0].as_py()
    if piece == WEIGHTS:
        out = np.concatenate([sum(np.frombuffer(x.as_py()) for x in group.column(c)) for c in ("low", "at", "high")])
    elif piece < 0:
        out = np.zeros(0, np.uint32)
        for x in group.column("low"):
            new = np.frombuffer(x.as_py(), np.uint32)
            out = prevailed(out, (new >> np.uint32(6)).astype(np.int64), (new & np.uint32(63)).astype(np.int64)) if len(out) else new
    else:
        both = sum(np.frombuffer(x.as_py(), np.uint8).astype(np.int64) for x in group.column("low"))
        for at, high in zip(group.column("at"), group.column("high")):
            both[np.frombuffer(at.as_py(), np.int32)] += np.frombuffer(high.as_py(), np.int32).astype(np.int64) << 8
        both = both.reshape(-1, 2)
        out = np.ceil(both / np.maximum(1, both.max(1, keepdims=True) / 254)).astype(np.uint8)  # at most 255, however it is rounded
    return pa.table({"piece": group.column("piece")[:1], "counts": pa.array([out.tobytes()], pa.binary())})


def counted(docs: DataFrame, totals: DataFrame, known_tokens, empty: Tables) -> DataFrame:
    """What all decisions of docs(text) hold, piece by piece: counts, what followed, and the gated weights.

    Each task goes through its texts online: a block of decisions is predicted from what the task has counted so far, the weights follow what came true, and
    the block is counted. Every decision of every text is counted, and as often as they occur those of spelled words. Symbols are spelled once, to show how words are made.
    """
    size = int(regions(len(empty.symbols.length), empty.shape)[-1])
    made = lambda rows: (pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in r[1:]]], names=["piece", "low", "at", "high"]) for r in rows)

    def texts(batches):
        counts, follows, learner = np.zeros((size, 2), np.int32), np.zeros(1 << empty.shape.follows, np.uint32), Learner()
        flat, t, one = counts.ravel(), empty._replace(follows=follows), np.ones(2 * BLOCK, np.int32)
        for s in streams(batches, Vocabulary(*known_tokens.value, empty.rank)):
            found, votes = follower(t, s)
            run = runs(found, s)
            for lo, hi in blocks(t.symbols.length[s.ids]):
                node, bit, slots, reps, _ = token_slots(t, s, lo, hi)
                learner.learn(*token_inputs(learned(counts, slots), node, bit, reps, found[lo:hi], votes[lo:hi], run[lo:hi]), bit)
                for part in slots:
                    np.add.at(flat, part * 2 + bit, one[: len(bit)])
            late = s.place > 1
            at, value, n = prevailing(s.key[late], s.ids[late], t.shape.follows)
            follows[at] = prevailed(follows[at], value, n)
        yield from made(rows_of(counts, follows, learner))

    def words(batches):
        counts, learner, (index, symbol) = np.zeros((size, 2), np.int32), Learner(), known_tokens.value
        flat, other = counts.ravel(), symbol[-1]
        for batch in batches:
            for word, bit, slots, times in spelled_of(batch, empty, lambda t, c: c if symbol[index.get(t, -1)] == other else 1):
                times = times.take(word)
                learner.learn(*spelled_inputs(learned(counts, slots)), bit, times.astype(np.float32))
                for part in slots:
                    np.add.at(flat, part * 2 + bit, times.astype(np.int32))
        yield from made(rows_of(counts, np.zeros(0, np.uint32), learner))

    kind = "piece int, low binary, at binary, high binary"
    return few(docs).mapInArrow(texts, kind).unionByName(few(totals.select("token", "c")).mapInArrow(words, kind)).groupBy("piece").applyInArrow(summed, "piece int, counts binary")


def gathered(pieces: DataFrame, empty: Tables) -> tuple[Tables, Mixer]:
    """The tables and the weights on the driver. The tasks' weights are joined in proportion to their curvature, and what came true is summed."""
    counts, follows = np.zeros(int(regions(len(empty.symbols.length), empty.shape)[-1]), np.uint16), np.zeros(1 << empty.shape.follows, np.uint32)
    curve, pull, hits = np.zeros((GATES, INPUTS, INPUTS)), np.zeros((GATES, INPUTS)), np.zeros((GATES, STEPS, 2))
    for r in pieces.toLocalIterator():
        k = r["piece"]
        if k == WEIGHTS:
            x = np.frombuffer(r["counts"])
            curve, pull, hits = (v.reshape(z.shape) for v, z in zip(np.split(x, [curve.size, curve.size + pull.size]), (curve, pull, hits)))
            continue
        out, kind, k = (counts, np.uint16, k) if k >= 0 else (follows, np.uint32, -1 - k)
        part = np.frombuffer(r["counts"], kind)
        out[k * PIECE :][: len(part)] = part
    weights = np.linalg.solve(curve, pull[:, :, None])[:, :, 0] if curve.any() else np.full((GATES, INPUTS), 1 / 3)
    return empty._replace(counts=counts, follows=follows), refined(weights, hits)


def log10_of_words(words: list[bytes], t: Tables, m: Mixer) -> np.ndarray:
    """log10 of each spelled word's probability."""
    out = np.zeros(len(words))
    for word, bit, slots in spelled_slots(t, words):
        lo, hi = int(word[0]), int(word[-1]) + 1
        out[lo:hi] += np.bincount(word - lo, m.log10(*spelled_inputs(known(t.counts, slots)), bit), hi - lo)
    return out


def log10_of_tokens(s: Stream, t: Tables, m: Mixer) -> np.ndarray:
    """log10 of each token's probability after all that stands before it; of those that are spelled up to their symbol."""
    out = np.zeros(len(s.ids))
    found, votes = follower(t, s)
    run = runs(found, s)
    for lo, hi in blocks(t.symbols.length[s.ids]):
        node, bit, slots, size, start = token_slots(t, s, lo, hi)
        out[lo:hi] = np.add.reduceat(m.log10(*token_inputs(known(t.counts, slots), node, bit, size, found[lo:hi], votes[lo:hi], run[lo:hi]), bit), start)
    return out


def _scored(docs: DataFrame, known_tokens, counts, model) -> DataFrame:
    """docs(doc_id, held_out, text) to what is known of each without rare tokens' counts, and the rare tokens' hashes."""

    def run(batches):
        (t, m), (base, ready) = unpacked(model.value), counts.value
        logs = np.log10(base + 0.5)
        names, part, chunk, rare_now = Vocabulary(*known_tokens.value, t.rank), TaskContext.get().partitionId(), 0, 0
        spelled = np.zeros(0)
        for batch in slices(batches, 2):
            if len(names.known) >= NAMED:
                names.reset()
                spelled = np.zeros(0)
            texts = coded(batch.column(2))
            every = names.keys_of(texts)
            new = ready[names.places[len(spelled) :]]
            late = np.flatnonzero(names.places[len(spelled) :] == names.unknown)
            new[late] = log10_of_words(listed(names.known.take(pa.array(len(spelled) + late))), t, m)
            spelled = np.concatenate([spelled, new])
            for lo, hi in blocks(texts.sizes, RUN):
                rows, sizes = batch.slice(lo, hi - lo), texts.sizes[lo:hi]
                keys, starts = every[texts.starts[lo] :][: sizes.sum()], texts.starts[lo:hi] - texts.starts[lo]
                places, ids, letters = names.places[keys], names.ids[keys], spelled[keys]
                s = stream(ids, names.hashes[keys], names.contexts[keys], starts)
                elsewhere, _ = follower(t, s, np.repeat(~rows.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes))
                is_hot = base[places] > 0
                whole = log10_of_tokens(s, t, m) + letters
                rare, less = names.hashes.view(np.int64)[keys[~is_hot]], -letters[~is_hot]
                hot_of = np.add.reduceat(is_hot.astype(np.int64), starts)
                ends = np.concatenate([[0], np.cumsum(sizes - hot_of)]).astype(np.int32)
                if rare_now + len(rare) > CHUNK and rare_now:
                    chunk, rare_now = chunk + 1, 0
                rare_now += len(rare)
                summed = lambda x: pa.array(np.add.reduceat(x, starts))
                columns = [
                    pa.array(np.full(len(sizes), (part << 24) + chunk, np.int64)), rows.column(0), rows.column(1), pa.array(sizes.astype(np.int64)), pa.array(hot_of),
                    summed(np.where(is_hot, logs[places], 0.0)), summed(whole), summed((elsewhere == ids).astype(np.int64)),
                    pa.array(pc.binary_length(rows.column(2)).to_numpy().astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(rare)), pa.ListArray.from_arrays(pa.array(ends), pa.array(less.astype(np.float32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "whole", "followed", "n_bytes", "rare", "less"])

    return docs.mapInArrow(run, "chunk long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_sum double, whole double, followed long, n_bytes long, rare array<long>, less array<float>")


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's texts with the counts of its rare tokens, hashes with c."""
    hashes = right.column("h").to_numpy()
    order = np.argsort(hashes)
    hashes, c = hashes[order], right.column("c").to_numpy()[order]
    whole = lambda c: pa.concat_arrays(c.chunks) if isinstance(c := left.column(c), pa.ChunkedArray) and c.num_chunks else c.combine_chunks()
    lists = whole("rare")
    flat, less, sizes = lists.flatten().to_numpy(), whole("less").flatten().to_numpy().astype(float), lists.value_lengths().to_numpy().astype(np.int64)
    found = np.zeros(len(flat), np.int64)
    if len(hashes) and len(flat):
        at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
        found = np.where(hashes[at] == flat, c[at], 0)
    seen = np.concatenate([[0], np.cumsum(found > 0)])
    ends = np.cumsum(sizes)
    # One number more than there are hashes, so that empty lists at the end have a place to point to; their sums are 0.
    summed = lambda x: np.add.reduceat(np.append(x, 0.0), ends - sizes) * (sizes > 0) if len(sizes) else np.zeros(0)
    known = {"rare_sum": pa.array(summed(np.log10(found + 0.5)), pa.float64()), "n_rare": pa.array(seen[ends] - seen[ends - sizes], pa.int64()), "less": pa.array(summed(np.where(found > 0, 0.0, less)), pa.float64())}
    return pa.table({k: left.column(k) for k in ("doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "whole", "followed", "n_bytes")} | known)


def letter_counts(totals: DataFrame) -> np.ndarray:
    """How often each byte, or STOP, occurs in the words of totals(token)."""

    def run(batches):
        out = np.zeros(256)
        for batch in batches:
            tokens = [t for t in batch.column(0).to_pylist() if t != END]
            out += np.bincount(np.frombuffer(b" ".join([*tokens, b""]), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])

    return sum((np.frombuffer(r["counts"]) for r in totals.select("token").mapInArrow(run, "counts binary").collect()), np.zeros(256))


def score(docs: DataFrame, *, train: Column | None = None, most_bits: int = 22) -> DataFrame:
    """How likely each whole text is: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, event_score, bits_per_byte, followed.

    Texts for which `train`, over doc_id, holds are learned from, all of them. The most frequent tokens, at most SYMBOLS of those seen twice or more, are symbols of a binary code
    that keeps their alphabetical order; all other tokens are one more symbol, behind which the word is spelled in a binary code of bytes. Each decision
    is predicted from hashed contexts by counts over the whole training text: by the node alone, after the last frequent token, after the token before (of rarer ones its last bytes), and by
    what followed the two tokens before; in a spelled word after its last two, four and six bytes and its whole beginning. Log-odds are mixed with weights gated
    by how much contexts have seen and by how long followers have been right in this text; each task learns the weights online, predicting every training decision
    before it is counted, and what is mixed is refined by tables of what came true. The tables grow with the tokens counted, to at most 2 to the power
    `most_bits` slots (twice as many for followers), which is what workers and driver can hold; beyond that decisions share slots, but all are counted.

    score is the log10 probability of the whole text, every byte of unknown words spelled, and bits_per_byte the same for each byte. event_score leaves out
    the spelling of unknown words, so that they are one event as in base_score. followed counts the tokens that mostly follow the two before them elsewhere too, a training
    text's own occurrence left out: nearly all where there is another copy of the text. base_score is that of counted tokens with 0.5 added: frequent tokens' counts go to all workers,
    rare ones' are joined for each chunk of a partition.

    Null and empty texts are the end alone. Without training texts all counts are 0. Repeated rows get equal scores and count repeatedly in
    training. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "model")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    own = slim.withColumn("held_out", ~train if train is not None else F.lit(False))
    training = own.filter(~F.col("held_out")).select("text")
    totals = scratch.save(token_counts(training), "totals")
    row = totals.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = row["n"] or 0, row["v"]
    can = (F.octet_length("token") <= LONGEST) & (F.col("c") > 1) & (F.col("token") != F.lit(END))
    hot = {END: 0} | {bytes(r["token"]): r["c"] for r in totals.filter(can).orderBy(F.desc("c"), "token").limit(HOT).toLocalIterator()}
    ends = totals.filter(F.col("token") == F.lit(END)).first()
    hot[END] = ends["c"] if ends else 0
    names, order = sorted(hot), sorted((t for t in hot if t != END), key=lambda t: (-hot[t], t))
    index, own_symbol = {t: k for k, t in enumerate(names)}, sorted([END, *order[:SYMBOLS]])
    base, number = np.array([*(hot[t] for t in names), 0], float), {t: k for k, t in enumerate(own_symbol)}
    symbol, rank = np.array([*(number.get(t, len(number)) for t in names), len(number)]), np.zeros(len(number) + 1, np.int64)
    rank[[number[t] for t in order[:COMMON]]] = np.arange(1, len(order[:COMMON]) + 1)
    weight = np.bincount(symbol, base, len(number) + 1)
    weight[-1] = max(n - weight[:-1].sum(), 1)
    none = np.zeros(0, np.uint16)
    empty = Tables(balanced(weight + 0.5), rank, balanced(letter_counts(totals) + 1), sized(n, most_bits), none, none)
    context = spark.sparkContext
    known_tokens = context.broadcast((index, symbol))
    tables, mixed = gathered(scratch.save(counted(training, totals, known_tokens, empty), "pieces"), empty)
    # Words that are spelled and known to all are spelled once.
    ready, late = np.zeros(len(names) + 1), [k for k, t in enumerate(names) if symbol[k] == len(number)]
    ready[late] = log10_of_words([names[k] for k in late], tables, mixed)
    scored = _scored(own.select("doc_id", "held_out", "text"), known_tokens, context.broadcast((base, ready)), context.broadcast(packed(tables, mixed)))
    del tables
    scored = scratch.save(scored, "scored")
    wanted = scored.select("chunk", F.explode("rare").alias("h")).distinct()
    looked = scratch.save(wanted.join(totals.select("h", "c"), "h").select("chunk", "h", "c"), "looked")
    kinds = "doc_id long, held_out boolean, n_tokens long, n_hot long, hot_sum double, whole double, followed long, n_bytes long, rare_sum double, n_rare long, less double"
    out = scored.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(_summed, kinds)
    base_score = F.col("hot_sum") + F.col("rare_sum") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.col("n_rare")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base_score.alias("base_score"), F.col("whole").alias("score"), (F.col("whole") + F.col("less")).alias("event_score"), (-F.col("whole") * F.lit(float(np.log2(10.0))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"), "followed")


def held_out() -> Column:
    return remainder("doc_id", 5) == 1
