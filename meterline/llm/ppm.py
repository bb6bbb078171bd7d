"""LM scoring (operator 12): prediction by partial matching over bytes, with escapes and symbol exclusion.

The model is a context trie of byte counts up to order ``ORDER``, learned from all training texts. A text is its lower-cased (A-Z)
bytes and an end sign; four zero bytes stand before it. The longest context seen in training predicts first. A sign counted there
has the probability ``n / (T + q)`` (``T`` counts, ``q`` different signs of the context); any other sign costs the
escape ``q / (T + q)`` and goes to the next shorter context, whose counts leave out the signs that the longer
one has (symbol exclusion). Below the empty context all signs never seen are alike.

The model is fixed while it scores, so exclusion needs no walk per sign: the signs of a context are also signs of every
shorter one, and what is left of a context's counts and signs is a number of the longer context. These numbers are
worked out once per context, and a sign costs one look-up where its longest context knows it.

At scale: every task adds up its own counts, only (context, sign, count) and (word, count) rows are shuffled. The trie goes out in blocks of at
most ``BLOCK`` counts, cut by the last two bytes of the context, which all orders from two on share; each block is one pass over the texts.
A block of one such pair of bytes has 257 * 65,536 counts at most, so memory has a bound that does not depend on the documents. The words that make up
most tokens go out as well, as many as fit in ``WORD_BYTES``; all rarer words of a text are joined with the counts, so the vocabulary may
be of any size and a frequent word is no hot key of the join. Long texts are scored in pieces that keep their context.

A null text is empty (its end sign is scored). Rows without an id are not held out (the query learns from rows with one only). Repeated
rows are learned from and scored each. With nothing to learn from, all signs are alike and the words' score is 0. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import BATCH_ROWS, column, doc_columns, map_texts, save, text_bytes, text_key

ORDER = 4
END = 256
SIGNS = 257
PIECE = 1 << 19  # bytes looked at together
HELD = 2_000_000  # counts that a training task holds before it hands them on
BLOCK = 2_000_000  # counts of a block of the trie
UNIT = 250_000  # counts that one task works on while the trie is built
WORD_BYTES = 16 << 20  # words that go out to all tasks, with 64 bytes each besides
_PAIRS = 1 << 16
_BYTE, _SIGN = 8, 9  # bits of a context byte and of a sign


def _pieces(data: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    """``(context, bytes, last)``: a text cut into pieces, each with the four bytes before it."""
    data = data.lower()
    for at in range(0, max(len(data), 1), PIECE):
        before = data[max(0, at - ORDER):at]
        yield before.rjust(ORDER, b"\0"), data[at:at + PIECE], at + PIECE >= len(data)


def signs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(key, text)`` of every sign of all texts, some at a time: ``key`` is the context of four bytes and the sign."""
    def made(parts):
        arr = np.frombuffer(b"".join(x for _, p in parts for x in (p[0], p[1], b"\0" if p[2] else b"")), dtype=np.uint8)
        sizes = np.array([ORDER + len(p[1]) + p[2] for _, p in parts])
        ends = np.cumsum(sizes)
        sign = arr.astype(np.int64)
        last = np.array([p[2] for _, p in parts])
        sign[ends[last] - 1] = END
        use = np.ones(len(arr), dtype=bool)
        for k in range(ORDER):
            use[ends - sizes + k] = False
        b = arr.astype(np.int64)
        ctx = np.zeros(len(arr), dtype=np.int64)
        for k in range(1, ORDER + 1):
            ctx[k:] |= b[:-k] << (_BYTE * (k - 1))
        return ((ctx << _SIGN) | sign)[use], np.repeat([i for i, _ in parts], sizes - ORDER)

    parts, held = [], 0
    for i, data in enumerate(texts):
        for piece in _pieces(data):
            parts.append((i, piece))
            held += len(piece[1]) + ORDER
            if held >= PIECE:
                yield made(parts)
                parts, held = [], 0
    if parts:
        yield made(parts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all parts and their sums."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def held_out(id_col: str = "doc_id", parts: int = 10) -> Column:
    """Whether nothing is learned from a row; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(gram, word, n)``: how often each sign stands after each four bytes, and each word; the end of a text is the empty word."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, words = [], 0, Counter()

        def out(keys, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.binary()), pa.array(n, pa.int64())],
                                              names=["gram", "word", "n"])

        def out_words() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()),
                                               pa.array(list(words.values()), pa.int64())], names=["gram", "word", "n"])
            words.clear()
            return made

        for batch in batches:
            data = text_bytes(batch)
            for key, _ in signs(data):
                k, n = np.unique(key, return_counts=True)
                grams.append((k, n))
                held += len(k)
                if held > HELD:
                    grams = [_added(grams)]
                    held = len(grams[0][0])
                    if held > HELD // 2:
                        yield out(*grams.pop())
                        held = 0
            for t in data:
                words.update(t.lower().split())
            words[b""] += len(data)
            if len(words) > HELD // 4:
                yield out_words()
        if grams:
            yield out(*_added(grams))
        yield out_words()

    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram long, word binary, n long")
    return made.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def _context_numbers(ctx: np.ndarray, n: np.ndarray, shorter: np.ndarray, t_shorter: np.ndarray, q_shorter: np.ndarray):
    """Of sorted ``ctx`` (one row a sign): the different contexts and, of each, four logarithms.

    Its own total ``T + q`` and escape, then total and escape of the next shorter context without the signs of this
    one. ``shorter`` has the count of each sign there; ``t_shorter`` and ``q_shorter`` its whole sums, a row each.
    """
    first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, dtype=np.int64)
    if not len(first):
        return ctx, np.zeros((0, 4))
    t, q = np.add.reduceat(n, first).astype(float), np.diff(np.r_[first, len(ctx)]).astype(float)
    t_left, q_left = t_shorter[first] - np.add.reduceat(shorter, first), q_shorter[first] - q
    escape = np.where(q_left > 0, _log(q_left) - _log(t_left + q_left), 0.0)  # nothing left: the escape is certain
    return ctx[first], np.stack([_log(t + q), _log(q) - _log(t + q), _log(t_left + q_left), escape], axis=1)


class Short:
    """Orders 1 and 0, as tables: at most 257 * 257 counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.n1 = np.zeros((256, SIGNS))
        self.n1[keys >> _SIGN, keys & 511] = n
        self.n0 = self.n1.sum(axis=0)
        self.t1, self.q1 = self.n1.sum(axis=1), (self.n1 > 0).sum(axis=1)
        t0, q0 = self.n0.sum(), (self.n0 > 0).sum()
        self.seen1 = self.q1 > 0
        self.own1, self.escape1 = _log(self.t1 + self.q1), _log(self.q1) - _log(self.t1 + self.q1)
        t_left = t0 - ((self.n1 > 0) * self.n0).sum(axis=1)
        q_left = q0 - self.q1
        self.total0 = np.where(self.seen1, _log(t_left + q_left), _log(t0 + q0))
        self.escape0 = np.where(self.seen1, np.where(q_left > 0, _log(q_left) - _log(t_left + q_left), 0.0),
                                _log(q0) - _log(t0 + q0) if q0 else 0.0)
        self.rest = -np.log10(max(SIGNS - q0, 1))


def _build(keys: np.ndarray, n: np.ndarray, short: Short) -> pa.RecordBatch:
    """Part of the trie whose contexts end in some pairs of bytes: ``(key, a, b, c, d)``, logarithms of signs and contexts."""
    out_keys, out = [], []
    keys, n = _added([(keys, n)])
    for order in (4, 3, 2):
        low = _added([(keys & ((1 << (_BYTE * (order - 1) + _SIGN)) - 1), n)])
        ctx, sign = keys >> _SIGN, keys & 511
        down = (ctx & ((1 << (_BYTE * (order - 1))) - 1))
        if order > 2:
            shorter = low[1][np.searchsorted(low[0], (down << _SIGN) | sign)]
            heads, first, q = np.unique(low[0] >> _SIGN, return_index=True, return_counts=True)
            t = np.add.reduceat(low[1], first) if len(first) else low[1]
            at = np.searchsorted(heads, down)
            t_shorter, q_shorter = t[at], q[at]
        else:
            shorter, t_shorter, q_shorter = short.n1[down, sign], short.t1[down], short.q1[down]
        heads, numbers = _context_numbers(ctx, n, shorter, t_shorter, q_shorter)
        if order == ORDER:  # the total is known: one number is all that such a sign needs
            value = _log(n) - numbers[:, 0][np.searchsorted(heads, ctx)] if len(ctx) else np.zeros(0)
        else:
            value = _log(n)
        out_keys += [keys | (order << 48), heads | ((order + 8) << 48)]
        out += [np.stack([value, *np.zeros((3, len(value)))], axis=1), numbers]
        keys, n = low
    key, numbers = np.concatenate(out_keys), np.concatenate(out)
    return pa.RecordBatch.from_arrays([pa.array(key)] + [pa.array(numbers[:, i]) for i in range(4)], names=["key", "a", "b", "c", "d"])


class Lookup:
    """Places of distinct keys, by hashing with open addresses."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several keys that want one place, one gets it
            won = self.keys[slot[todo]] == keys[todo]
            self.at[slot[todo[won]]] = todo[won]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is unknown."""
        slot = self._home(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], -1)
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            out[todo] = np.where(held == keys[todo], self.at[slot[todo]], -1)
            todo = todo[(held != keys[todo]) & (held != -1)]
        return out


class Block:
    """One block of the trie: scores the signs whose context ends in its pairs of bytes."""

    def __init__(self, key: np.ndarray, numbers: np.ndarray, short: Short, pairs: np.ndarray):
        context = (key >> 48) > 8
        self.signs, self.value = Lookup(key[~context]), numbers[~context, 0]
        self.contexts, self.numbers = Lookup(key[context]), numbers[context]
        self.short, self.pairs = short, pairs

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each sign's probability; 0 for signs of other blocks."""
        out = np.zeros(len(keys))
        left = np.flatnonzero(self.pairs[(keys >> _SIGN) & (_PAIRS - 1)])
        at = self.signs.get(keys[left] | (ORDER << 48))
        out[left[at >= 0]] = self.value[at[at >= 0]]
        left = left[at < 0]
        paid = np.zeros(len(left))
        given = np.zeros(len(left), dtype=bool)  # whether a longer context was seen, which then states total and escape
        total, escape = np.zeros(len(left)), np.zeros(len(left))

        def stay(keep: np.ndarray) -> None:
            nonlocal left, paid, given, total, escape
            left, paid, given, total, escape = left[keep], paid[keep], given[keep], total[keep], escape[keep]

        for order in (4, 3, 2):
            bits = _BYTE * order
            key = keys[left] & ((1 << (bits + _SIGN)) - 1)
            place = self.contexts.get((key >> _SIGN) | ((order + 8) << 48))
            seen = place >= 0
            own = self.numbers[np.maximum(place, 0)] if len(self.numbers) else np.zeros((len(left), 4))
            total, escape = np.where(given, total, own[:, 0]), np.where(given, escape, own[:, 1])
            if order < ORDER:
                at = self.signs.get(key | (order << 48))
                hit = at >= 0
                out[left[hit]] = paid[hit] + self.value[at[hit]] - total[hit]
            else:
                hit = np.zeros(len(left), dtype=bool)
            paid = np.where(seen, paid + escape, paid)
            given, total, escape = seen, own[:, 2], own[:, 3]
            stay(~hit)
        s = self.short
        key = keys[left]
        byte, sign = (key >> _SIGN) & 255, key & 511
        total, escape = np.where(given, total, s.own1[byte]), np.where(given, escape, s.escape1[byte])
        n = s.n1[byte, sign]
        hit = n > 0
        out[left[hit]] = paid[hit] + _log(n[hit]) - total[hit]
        paid = np.where(s.seen1[byte], paid + escape, paid)
        n = s.n0[sign]
        low = ~hit & (n > 0)
        out[left[low]] = paid[low] + _log(n[low]) - s.total0[byte[low]]
        none = ~hit & (n == 0)
        out[left[none]] = paid[none] + s.escape0[byte[none]] + s.rest
        return out


_LOADED: dict = {}


def _loaded(sent, name: str) -> Block:
    """The block of a broadcast, put in order once per worker."""
    if _LOADED.get("name") != name:
        _LOADED.clear()
        _LOADED.update(name=name, block=Block(*sent.value[:4]))
    return _LOADED["block"]


class Model:
    """What was learned: the trie in blocks, the words in blocks, and their sums."""

    def __init__(self, counted: DataFrame):
        self.spark = counted.sparkSession
        grams = counted.where("gram is not null")
        low = grams.groupBy(F.col("gram").bitwiseAND((1 << (_BYTE + _SIGN)) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        self.short = short = Short(low["key"].to_numpy(), low["n"].to_numpy())  # 65,792 rows at most
        pair = F.shiftright("gram", _SIGN).bitwiseAND(_PAIRS - 1)
        sizes = grams.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # 65,536 rows at most
        size = np.zeros(_PAIRS, dtype=np.int64)
        size[sizes["pair"].to_numpy()] = sizes["n"].to_numpy()
        unit, self.block_of = self._cut(size, UNIT), self._cut(size, BLOCK)
        places = self.spark.createDataFrame(
            [(int(p), int(unit[p]), int(self.block_of[p])) for p in np.flatnonzero(size)], "pair int, unit int, block int")

        def build(table: pa.Table) -> pa.Table:
            made = pa.Table.from_batches([_build(table["gram"].to_numpy(), table["n"].to_numpy(), short)])
            return made.append_column("block", pa.array(np.full(len(made), table["block"][0].as_py(), dtype=np.int32)))

        # a unit is a range of pairs within one block, so that a task holds no more than the bound
        placed = grams.withColumn("pair", pair.cast("int")).join(F.broadcast(places), "pair").select("block", "unit", "gram", "n")
        self.trie = save(placed.groupBy("block", "unit").applyInArrow(
            build, "key long, a double, b double, c double, d double, block int"), "ppm-trie")
        words = counted.where("word is not null").select("word", "n")
        step = F.floor(F.log2("n")).cast("int")
        sizes = words.groupBy(step.alias("step")).agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.length("word") + 64)).collect()  # 63 rows at most
        self.tokens, self.distinct = sum(r[1] for r in sizes), sum(r[2] for r in sizes)
        least, held = 62, 0  # no count reaches 2 ** 62
        for r in sorted(sizes, reverse=True):
            held += r[3]
            if held > WORD_BYTES:
                break
            least = r[0]
        self.frequent, self.rare = words.where(F.col("n") >= 1 << least), words.where(F.col("n") < 1 << least)
        self.scale = self.tokens + 0.1 * (self.distinct + 1)
        self.passes = int(self.block_of.max()) + 1

    def sent(self, i: int):
        """Broadcast of one block of the trie, and with the first one the frequent words with their logarithms."""
        trie = self.trie.where(F.col("block") == i).toArrow()
        numbers = np.stack([trie[c].to_numpy() for c in "abcd"], axis=1)
        value = {}
        if i == 0:
            words = self.frequent.toArrow()
            value = dict(zip(words["word"].to_pylist(), np.log10((words["n"].to_numpy() + 0.1) / self.scale).tolist()))
        return self.spark.sparkContext.broadcast((trie["key"].to_numpy(), numbers, self.short, self.block_of == i, value))

    @staticmethod
    def _cut(size: np.ndarray, most: int) -> np.ndarray:
        """A number for each pair: ranges of pairs that hold ``most`` counts at most, or one pair."""
        out, held, at = np.zeros(len(size), dtype=np.int64), 0, 0
        for p in np.flatnonzero(size):
            if held and held + size[p] > most:
                at, held = at + 1, 0
            held += size[p]
            out[p] = at
        return out


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all texts of ``docs``."""
    return Model(save(counts(docs, text_col), "ppm-counts"))


def _pass(docs: DataFrame, model: Model, i: int, id_col: str, text_col: str) -> DataFrame:
    """Scores in one block of the trie; the first pass looks up the words too and returns those that it does not know."""
    sent, name = model.sent(i), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, block, value = text_bytes(batch), _loaded(sent, name), sent.value[4]
        score = np.zeros(len(data))
        for key, text in signs(data):
            score += np.bincount(text, weights=block.score(key), minlength=len(data))
        tokens, known, base, rare = [], [], [], []
        for t in data if i == 0 else []:
            words = t.lower().split() + [b""]
            values = list(map(value.get, words))
            other = Counter(w for w, v in zip(words, values) if v is None)
            tokens.append(len(words))
            known.append(len(words) - other.total())
            base.append(sum(v for v in values if v is not None))
            rare.append([{"word": w, "m": m} for w, m in other.items()])
        columns = [column(batch, "row"), column(batch, "doc_id"), column(batch, "h"), pa.array(score)]
        names = ["row", "doc_id", "h", "score"]
        if i == 0:
            columns += [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, kind)]
            names += ["n_tokens", "n_known", "known", "rare"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    columns = [F.monotonically_increasing_id().alias("row"), *doc_columns(id_col, text_col), text_key(text_col).alias("h")]
    schema = "row long, doc_id long, h long, score double"
    if i == 0:
        schema += ", n_tokens long, n_known long, known double, rare array<struct<word:binary,m:int>>"
    made = save(map_texts(docs, columns, schema, run), "ppm-pass")
    sent.destroy()
    return made


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    ``score`` is the log10 probability of the text and its end in the trie, ``base_score`` that of its words and
    their end by smoothed counts; both of the whole text.
    """
    rows = _pass(docs, model, 0, id_col, text_col)
    for i in range(1, model.passes):
        # equal rows have equal scores, so one of them stands for all
        more = _pass(docs, model, i, id_col, text_col).groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.max("score").alias("more"))
        rows = (rows.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
                .withColumn("score", F.col("score") + F.col("more")).drop("d", "g", "more"))
    value = F.log10((F.col("n") + 0.1) / F.lit(model.scale))
    found = (rows.select("row", F.explode("rare").alias("s")).select("row", "s.word", "s.m").join(model.rare, "word")
             .groupBy("row").agg(F.sum("m").alias("more_known"), F.sum(F.col("m") * value).alias("more")))
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0))
    unknown = float(np.log10(0.1 / model.scale))
    return rows.join(found, "row", "left").select(
        "doc_id", "n_tokens", known.alias("n_known"), F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0.0)) + (F.col("n_tokens") - known) * F.lit(unknown)).alias("base_score"), "score")
