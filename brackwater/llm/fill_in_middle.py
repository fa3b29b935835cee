"""Fill-in-the-middle by a parallel automaton scan: chunks give state-transition functions and counts, whose composition finds the cuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, shipped, small_batches, text_of, unused

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: States after a byte: outside a run of letters, inside one, after "<", after "<" and P, S or M. A scan begins outside.
OUTSIDE, INSIDE, OPENED, NAMED = range(4)
STATES = 4
#: Kinds of byte: any other code point's first, a letter, one of P, S and M, "<", ">", a code point's further bytes, and nothing.
OTHER, LETTER, NAME, OPEN, CLOSE, FURTHER, NOTHING = range(7)
#: Bytes that one step of the scan looks at in a piece; pieces scanned side by side.
PIECE, SIDE = 256, 8192
#: Texts of more bytes are cut into chunks that other tasks scan.
GIANT, CHUNK = 1 << 20, 1 << 18


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each byte, and for 8 x state + kind the next state, +4 if a token starts there, +8 if a mark ends there."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[0x80:0xC0] = FURTHER
    for c in range(26):
        kinds[65 + c] = kinds[97 + c] = LETTER
    for c in b"PSM":
        kinds[c] = NAME
    kinds[ord("<")], kinds[ord(">")] = OPEN, CLOSE
    step = np.zeros(8 * STATES, np.uint8)
    for state in range(STATES):
        run = state in (INSIDE, NAMED)
        for kind in range(7):
            if kind == NOTHING:
                out = state
            elif kind in (LETTER, NAME):
                out = (NAMED if state == OPENED and kind == NAME else INSIDE) + (0 if run else 4)
            elif kind == FURTHER:
                out = OUTSIDE
            else:
                out = (OPENED if kind == OPEN else OUTSIDE) + 4 + (8 if state == NAMED and kind == CLOSE else 0)
            step[8 * state + kind] = out
    return kinds, step


KIND, STEP = _automaton()


class Pieces:
    """Texts of a batch as pieces of PIECE bytes: `of` says whose, `first` which are first; each has, for every state before it, the state after it and what it counts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        many = -(-lengths // PIECE)
        self.of = np.repeat(np.arange(len(lengths)), many)
        self.first = np.cumsum(many) - many
        number = np.arange(len(self.of)) - self.first[self.of]
        self.at = number * PIECE
        self.size = np.minimum(PIECE, lengths[self.of] - self.at)
        self.begin = starts[self.of] + self.at
        self.data = np.concatenate([data, np.zeros(PIECE, np.uint8)])
        n = len(self.of)
        self.exit = np.zeros((n, STATES), np.uint8)
        self.tokens, self.marks = np.zeros((n, STATES), np.int64), np.zeros((n, STATES), np.int64)
        self.points = np.zeros(n, np.int64)
        for k in range(0, n, SIDE):
            self._scan(slice(k, k + SIDE))

    def kinds(self, which) -> np.ndarray:
        """PIECE rows, a column for each of the pieces: the kinds of their bytes."""
        out = KIND[np.lib.stride_tricks.sliding_window_view(self.data, PIECE)[self.begin[which]]]
        short = np.flatnonzero(self.size[which] < PIECE)
        out[short] = np.where(np.arange(PIECE) < self.size[which][short, None], out[short], NOTHING)
        return np.ascontiguousarray(out.T)

    def _scan(self, which: slice) -> None:
        kinds = self.kinds(which)
        self.points[which] = ((kinds != FURTHER) & (kinds != NOTHING)).sum(axis=0)
        for state in range(STATES):
            now = np.full(kinds.shape[1], state, np.uint8)
            tokens, marks = np.zeros(len(now), np.int16), np.zeros(len(now), np.int16)
            for row in kinds:
                now = STEP[(now << 3) | row]
                tokens += (now >> 2) & 1
                marks += now >> 3
                now &= 3
            self.exit[which, state], self.tokens[which, state], self.marks[which, state] = now, tokens, marks

    def compose(self) -> None:
        """Each piece's function and counts become those of its text up to its end: neighbours are joined over distances 1, 2, 4, ..."""
        self.own_exit, self.own_tokens, self.own_points = self.exit.copy(), self.tokens.copy(), self.points.copy()
        number, gap = np.arange(len(self.of)) - self.first[self.of], 1
        while gap <= number.max(initial=0):
            right = np.flatnonzero(number >= gap)
            left = right - gap
            via = self.exit[left]
            tokens = self.tokens[left] + np.take_along_axis(self.tokens[right], via, axis=1)
            marks = self.marks[left] + np.take_along_axis(self.marks[right], via, axis=1)
            points = self.points[left] + self.points[right]
            exit_ = np.take_along_axis(self.exit[right], via, axis=1)
            self.exit[right], self.tokens[right], self.marks[right], self.points[right] = exit_, tokens, marks, points
            gap *= 2

    def totals(self, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text its function, and tokens and marks for each state before it, and its code points. Empty texts keep any state."""
        last = np.append(self.first[1:], len(self.of)) - 1
        some = last >= self.first
        exit_ = np.tile(np.arange(STATES, dtype=np.uint8), (texts, 1))
        tokens, marks, points = np.zeros((texts, STATES), np.int64), np.zeros((texts, STATES), np.int64), np.zeros(texts, np.int64)
        exit_[some], tokens[some], marks[some], points[some] = self.exit[last[some]], self.tokens[last[some]], self.marks[last[some]], self.points[last[some]]
        return exit_, tokens, marks, points

    def places(self, text: np.ndarray, entry: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Code points before the start of that token (from 0) of the text, entered in that state; all of the text's if it has no such token."""
        low, high = self.first[text], np.append(self.first[1:], len(self.of))[text]
        end = high
        while (open_ := low < high).any():  # the first piece up to whose end there are more tokens
            middle = (low + high) // 2
            at = np.minimum(middle, max(0, len(self.of) - 1))
            passed = open_ & (self.tokens[at, entry] > token)
            high = np.where(passed, middle, high)
            low = np.where(open_ & ~passed, middle + 1, low)
        out = np.where(end > self.first[text], self.points[np.maximum(end - 1, 0)] if len(self.of) else 0, 0)
        hit = np.flatnonzero(low < end)
        piece = low[hit]
        inner = piece > self.first[text[hit]]
        state = np.where(inner, self.exit[np.maximum(piece - 1, 0), entry[hit]], entry[hit]).astype(np.uint8)
        left = token[hit] - np.where(inner, self.tokens[np.maximum(piece - 1, 0), entry[hit]], 0)
        points = np.where(inner, self.points[np.maximum(piece - 1, 0)], 0)
        done = np.zeros(len(hit), bool)
        for row in self.kinds(piece) if len(hit) else ():
            state = STEP[(state << 3) | row]
            start = (state >> 2) & 1 > 0
            done |= start & (left == 0)
            left = left - start
            points += ~done & (row != FURTHER) & (row != NOTHING)
            state &= 3
        out[hit] = points
        return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and how long it is; nulls are empty."""
    texts = texts.fill_null(b"")
    texts = texts if pa.types.is_large_binary(texts.type) else texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, ends[:-1], np.diff(ends)


def _cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """struct(n, marks, before, upto) of whole texts: tokens, marks, and the code points before the two cuts at first and second modulo n + 1 tokens."""
    pieces = Pieces(*_bytes(texts))
    pieces.compose()
    _, tokens, marks, points = pieces.totals(len(texts))
    n = tokens[:, OUTSIDE]
    cuts = np.sort(np.stack([h.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for h in (first, second)]), axis=0)
    at, entry = np.arange(len(texts)), np.full(len(texts), OUTSIDE)
    before, upto = (pieces.places(at, entry, c) for c in cuts)
    return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (n, marks[:, OUTSIDE], before, upto)], ["n", "marks", "before", "upto"])


def _functions(chunks: pa.Array) -> pa.Array:
    """struct(exit, tokens, marks, points) of each chunk: arrays with a place for each state before it."""
    pieces = Pieces(*_bytes(chunks))
    pieces.compose()
    exit_, tokens, marks, points = pieces.totals(len(chunks))
    lists = [pa.array(list(v), pa.list_(pa.int64())) for v in (exit_.astype(np.int64), tokens, marks)]
    return pa.StructArray.from_arrays([*lists, pa.array(points)], ["exit", "tokens", "marks", "points"])


def _place(chunks: pa.Array, entry: pa.Array, token: pa.Array) -> pa.Array:
    """Code points of each chunk before that token of it."""
    pieces = Pieces(*_bytes(chunks))
    pieces.compose()
    return pa.array(pieces.places(np.arange(len(chunks)), entry.to_numpy(), token.to_numpy()), pa.int64())


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the id: the first digits of the SHA-256 of seed:id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _giant_cuts(docs: DataFrame, key: Column, text: Column, first: Column, second: Column, chunk: int) -> tuple[DataFrame, int]:
    """key, struct(n, marks, before, upto) of the giant documents, no task looking at more than some chunks; and their number.

    Chunks are dealt by key and place. Their functions, a few numbers each and at most 2^31 / chunk for a document, are composed in
    order; the two chunks in which the cuts fall are then entered in the right state.
    """
    scratch = Scratch(docs.sparkSession, "chunks")

    def cut(batches):
        for batch in batches:
            for k, text, h1, h2 in zip(*(batch.column(i) for i in range(4))):
                whole = text.as_buffer()
                for at in range(0, max(1, whole.size), chunk):
                    part = pa.array([whole.slice(at, min(chunk, whole.size - at)).to_pybytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()]), pa.array([at // chunk], pa.int64()), pa.array([h1.as_py()], pa.int64()), pa.array([h2.as_py()], pa.int64()), part], ["key", "place", "h1", "h2", "part"])

    whole = docs.select(key.alias("key"), text.alias("text"), first.alias("h1"), second.alias("h2"))
    parts = whole.mapInArrow(cut, "key string, place long, h1 long, h2 long, part binary")
    parts = scratch.save(parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "place"), "parts")
    told = F.arrow_udf(_functions, "struct<exit:array<bigint>,tokens:array<bigint>,marks:array<bigint>,points:bigint>")("part")
    # Repeated documents have the same key and chunks: one of each counts.
    told = scratch.save(parts.select("key", "place", "h1", "h2", told.alias("f")).groupBy("key", "place").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("f").alias("f")), "functions")
    ordered = F.array_sort(F.collect_list(F.struct("place", "f")))
    docs_ = told.groupBy("key").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), ordered.alias("parts"))
    zero = lambda: F.lit(0).cast("long")
    via = lambda c, name, state: F.element_at(c["f"][name], state.cast("int") + 1)
    start = F.struct(zero().alias("state"), zero().alias("n"), zero().alias("marks"), zero().alias("points"))
    after = lambda a, c: F.struct(via(c, "exit", a["state"]).alias("state"), (a["n"] + via(c, "tokens", a["state"])).alias("n"), (a["marks"] + via(c, "marks", a["state"])).alias("marks"), (a["points"] + c["f"]["points"]).alias("points"))
    docs_ = docs_.withColumn("all", F.aggregate("parts", start, after))
    low, high = (f(F.col("h1") % (F.col("all.n") + 1), F.col("h2") % (F.col("all.n") + 1)) for f in (F.least, F.greatest))

    def entered(cut: Column) -> Column:
        """The chunk that holds the start of that token, the state before it, the token's number in it, and the code points before it; null if the text ends there."""
        none = F.lit(None).cast("struct<place:bigint,state:bigint,token:bigint,points:bigint>")
        first_ = F.struct(zero().alias("state"), zero().alias("n"), zero().alias("points"), none.alias("hit"))
        here = lambda a, c: (a["n"] <= cut) & (cut < a["n"] + via(c, "tokens", a["state"]))
        hit = lambda a, c: F.when(here(a, c), F.struct(c["place"].alias("place"), a["state"].alias("state"), (cut - a["n"]).alias("token"), a["points"].alias("points"))).otherwise(a["hit"])
        next_ = lambda a, c: F.struct(via(c, "exit", a["state"]).alias("state"), (a["n"] + via(c, "tokens", a["state"])).alias("n"), (a["points"] + c["f"]["points"]).alias("points"), hit(a, c).alias("hit"))
        return F.aggregate("parts", first_, next_, lambda a: a["hit"])

    cuts = scratch.save(docs_.select("key", "all", F.array(entered(low), entered(high)).alias("cuts")), "cuts")
    each = cuts.select(F.col("key").alias("k"), F.posexplode("cuts").alias("which", "cut")).filter("cut is not null").select("k", "which", "cut.*")
    giants = cuts.count()
    found = parts.join(bounded_broadcast(each.withColumnRenamed("place", "p"), 2 * giants), (F.col("key") == F.col("k")) & (F.col("place") == F.col("p")))
    at = F.arrow_udf(_place, "bigint")("part", "state", "token") + F.col("points")
    at = found.select("key", "which", at.alias("at")).groupBy("key").agg(F.max(F.when(F.col("which") == 0, F.col("at"))).alias("before"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("upto"))
    out = cuts.join(at.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    all_ = F.col("all.points")
    return scratch.save(out.select("key", F.struct(F.col("all.n").alias("n"), F.col("all.marks").alias("marks"), F.coalesce("before", all_).alias("before"), F.coalesce("upto", all_).alias("upto")).alias("cut")), "found"), giants


def transform(docs: DataFrame, *, column: str = "fim", seed: int = 1, percent: int = 90, spm_percent: int = 20, giant: int = GIANT, chunk: int = CHUNK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with `column`, struct(n, form, prefix_chars, middle_chars, output): the text as prefix, suffix and middle behind their marks.

    Tokens are runs of A-Z and a-z, and every other code point by itself. Numbers drawn from the id choose two cuts between tokens and the form:
    psm (prefix, suffix, middle), spm (suffix, prefix, middle) for spm_percent of a hundred, plain for 100 - percent. Texts that are empty or
    hold a mark are plain, too; a plain output is the text, and its prefix_chars and middle_chars are null.

    One pass of an automaton over the bytes finds tokens and marks. A batch's texts are cut into pieces, scanned side by side from every
    state; composing the pieces' functions gives each its state, and the cuts are looked for in two pieces of a text only. Texts of more
    than `giant` bytes are cut into chunks of `chunk` bytes for other tasks, and composed likewise.

    Null texts are empty. Repeated rows get the same result. Null ids draw like the empty text. Other columns pass through, whatever their
    names; one named like `column` is replaced. An empty table gives no rows.
    """
    shipped(__name__)
    small_batches(docs.sparkSession, size=16 << 20)
    text = text_of(text_column)
    h = draws(F.col(id_column), seed)
    cut, giant_key = unused(docs, "cut"), unused(docs, "key")
    size = F.octet_length(text)
    kind = "struct<n:bigint,marks:bigint,before:bigint,upto:bigint>"
    small = docs.filter(size <= giant).withColumn(cut, F.arrow_udf(_cut, kind)(text.cast("binary"), h[0], h[1]))
    key = F.sha2(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), text), 256)
    large = docs.filter(size > giant)
    cuts, many = _giant_cuts(large, key, text.cast("binary"), h[0], h[1], chunk)
    cuts = cuts.select(F.struct(F.col("key").alias("k"), "cut").alias(cut))
    large = large.withColumn(giant_key, key).join(bounded_broadcast(cuts, many), F.col(giant_key) == F.col(f"{cut}.k"))
    out = small.unionByName(large.select(*docs.columns, F.col(f"{cut}.cut").alias(cut)))
    n, before, upto = F.col(f"{cut}.n"), F.col(f"{cut}.before").cast("int"), F.col(f"{cut}.upto").cast("int")
    plain = (n == 0) | (F.col(f"{cut}.marks") > 0) | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring(text, F.lit(1), before), F.substring(text, before + 1, upto - before), F.substring(text, upto + 1, F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(form == "plain", text).when(form == "spm", spm).otherwise(psm)
    chars = lambda c: F.when(form != "plain", c)
    fim = F.struct(n.alias("n"), form.alias("form"), chars(F.col(f"{cut}.before")).alias("prefix_chars"), chars(F.col(f"{cut}.upto") - F.col(f"{cut}.before")).alias("middle_chars"), output.alias("output"))
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    return out.select(*kept, fim.alias(column))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: no part holds a mark, so the marks are where the output splits."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
