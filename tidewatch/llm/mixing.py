"""Language-model scoring by online logistic context mixing (operator 3).

A text (A-Z lower-cased) is a sequence of symbols: its bytes, then an end. Each
symbol is a path of binary decisions down the Huffman tree of what follows the
byte before it in training. Every decision is predicted by several hashed contexts:
the last two, three and four bytes, and the word so far. Each has a table of
log odds by (context row, tree node), made from the counts of *all* training texts;
a mixer adds them up with weights and a bias that its gate, the decision's depth,
selects, and the sum's logistic is the probability. The weights are refined online
while a text is read: after every ``STRETCH`` symbols they follow the gradient of its
coding cost. The bits of all decisions are the text's cost; every text starts from
the same weights, so a text's score depends on it and on the counts alone.

On Spark this is three passes over the text. (1) Token counts and the counts of
byte pairs. (2) Context counts: a task counts into arrays of fixed size and puts
out their blocks; blocks are merged in a tree of groups of ``FAN`` rows, so no
task ever gathers the blocks of all others, and become log odds of one byte each:
a model whose size is fixed by ``SLOT_BITS`` and the alphabet, and broadcast. (3) Scores.

The add-one unigram baseline needs every token's count. Tokens with at least a
``1 / HEAD`` share of all (so at most ``HEAD`` of them) are broadcast; the rest are
joined by hash.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_batches, id_crc_mod, table, written

HELD_OUT = (7, 2)          # crc32(id as text) mod 7 == 2 is never learned from
SLOT_BITS = (12, 16, 18, 18)   # of each context's table: its rows are a power of two
CONTEXTS = len(SLOT_BITS)
ROWS = sum(1 << b for b in SLOT_BITS)
BLOCK = 512                # slots in one merged block
FAN = 32                   # blocks that one merge adds up
HEAD = 1 << 20
END, ESCAPE = 0, 1         # symbols; the bytes of the training texts follow
PRIOR = 0.1                # added to either count of a node
ODDS = 15.0                # units of a stored log odd: int8 holds +-8.4
WEIGHTS = (0.1, 0.15, 0.5, 0.35)   # of the four contexts, at the start of a text
RATE = 0.03
STRETCH = 64               # symbols after which the weights are refined
GROUP = 1 << 21            # symbols that are scored together, in texts
WIDTH = 512                # of at most this number, which a core's cache can hold
BLOCK_SYMBOLS = 1 << 16    # symbols whose context rows are worked out together
_PAD = b"\n" * 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_power = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


# ------------------------------------------------------------------ symbols

def _huffman(weights) -> list[list[tuple[int, int]]]:
    """The (node, bit) path of each symbol; the root is node 0."""
    size = len(weights)
    heap = [(w, s) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    children, made = {}, size
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        children[made] = (x, y)
        heapq.heappush(heap, (a + b, made))
        made += 1
    paths = [[] for _ in range(size)]
    todo = [(made - 1, [])]
    while todo:
        node, path = todo.pop()
        if node < size:
            paths[node] = path
        else:
            for bit, child in enumerate(children[node]):
                todo.append((child, [*path, (made - 1 - node, bit)]))
    return paths


class Alphabet:
    """Symbols of a corpus, a Huffman tree of them after each symbol, and the rows
    of the context tables, which are dealt out by the symbol before as well: a row
    belongs to one tree. ``pairs[p, b]`` counts byte ``b`` after byte ``p``, column
    256 the ends of texts."""

    def __init__(self, pairs: np.ndarray):
        histogram = pairs.sum(axis=0)
        seen = [b for b in range(256) if histogram[b]]
        size = self.size = 2 + len(seen)
        self.of_byte = np.full(256, ESCAPE, dtype=np.int64)
        self.of_byte[seen] = np.arange(2, size)
        after = np.zeros((size, size))
        columns = [256, *seen]
        for p in range(256):
            after[self.of_byte[p], [END, *range(2, size)]] += pairs[p, columns]
        total = after.sum(axis=1, keepdims=True)
        # a share of the corpus' own counts where little was seen; and a floor that
        # keeps the rarest paths about ten decisions long
        share = (after.sum(axis=0) + 1) / (after.sum() + size)
        weights = np.maximum(after + (0.01 * total + 1) * share, (total + 1) / 1024)
        self.paths = [_huffman(w.tolist()) for w in weights]
        length = np.array([[len(p) for p in tree] for tree in self.paths])
        depth = int(length.max())
        # paths end to end by (symbol before, symbol): where each begins, its decisions,
        # and of every decision its node, its bit as +-1 and its depth
        self.depth, self.length = depth, length.ravel()
        self.begin = np.cumsum(self.length) - self.length
        steps = [(node, 1 if bit else -1, d) for tree in self.paths for path in tree
                 for d, (node, bit) in enumerate(path)]
        self.node, sign, self.deep = (np.array(c, dtype=np.int64) for c in zip(*steps))
        self.sign = sign.astype(np.float32)
        # rows of each table by the symbol before: as its count to the power 3/4
        deal = (total[:, 0] + 1) ** 0.75
        self.first, self.rows, at = [], [], 0
        for k, bits in enumerate(SLOT_BITS):
            ends = np.floor(np.cumsum(deal) / deal.sum() * ((1 << bits) - size)).astype(np.int64)
            ends += np.arange(1, size + 1)              # one row at least
            self.first.append(at + np.concatenate(([0], ends[:-1])))
            # equally large tables share one array, and what is gathered from it
            self.rows.append(self.rows[-1] if k and bits == SLOT_BITS[k - 1] else
                             np.diff(np.concatenate(([0], ends))).astype(np.uint64))
            at += 1 << bits

    def log_odds(self, counts: np.ndarray, first_row: int) -> np.ndarray:
        """(rows, size) symbol counts -> stored log odds of each node's 1-branch, for
        the table rows from ``first_row``."""
        out = np.zeros((len(counts), self.size), dtype=np.int8)
        owner = np.searchsorted(np.concatenate(self.first),
                                np.arange(first_row, first_row + len(counts)), side="right") - 1
        for q in np.unique(owner % self.size):
            under = np.zeros((2, self.size, self.size))
            for s, path in enumerate(self.paths[q]):
                for node, bit in path:
                    under[bit, s, node] = 1
            mine = owner % self.size == q
            zeros, ones = counts[mine] @ under[0], counts[mine] @ under[1]
            odds = np.log((ones + PRIOR) / (zeros + PRIOR))
            out[mine] = np.clip(np.rint(odds * ODDS), -127, 127)
        return out


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def _laid_out(texts: list[bytes]):
    """The texts end to end, each after four pad bytes and with a place for its
    end: (bytes, start of each text's first symbol, symbols of each text)."""
    data = np.frombuffer(b"".join(x for t in texts for x in (_PAD, t, b"\0")), dtype=np.uint8)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return data, np.cumsum(size + len(_PAD)) - size, size


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd 64-bit number and of its inverse."""
    if n > len(_power[0]):
        for k, base in enumerate((int(_MIX), pow(int(_MIX), -1, 1 << 64))):
            row = np.full(max(n, 2 * GROUP), np.uint64(base))
            row[0] = 1
            _power[k] = np.cumprod(row)
    return _power[0][:n], _power[1][:n]


def _rows(data: np.ndarray, before: np.ndarray, alphabet: Alphabet) -> list[np.ndarray]:
    """Where each context's table row begins, at each place; ``before`` is the symbols
    before (the first four places are pads)."""
    b = data.astype(np.uint32)
    one = np.concatenate((b[:1], b[:-1]))                  # the byte before
    two = one.copy()
    two[2:] |= b[:-2] << np.uint32(8)
    three = two.copy()
    three[3:] |= b[:-3] << np.uint32(16)
    four = three.copy()
    four[4:] |= b[:-4] << np.uint32(24)
    mix = np.uint32(2654435761)
    # the word so far: a polynomial hash of the bytes since the last white space
    powers, back = _powers(len(data))
    n = len(data)
    total = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers)
    so_far = np.concatenate((np.zeros(1, np.uint64), total[:-1]))
    space = (data == 32) | ((data >= 9) & (data <= 13)) | (data == 0)
    first = np.zeros(n, dtype=np.int64)                    # where the word began
    began = np.flatnonzero(space[:-1]) + 1
    first[began] = began
    first = np.maximum.accumulate(first)
    word = (so_far - so_far[first]) * back[first]
    word = (word ^ (word >> np.uint64(29))) * _MIX
    hashes = ((two ^ (two >> np.uint32(7))) * mix, (three ^ (three >> np.uint32(11))) * mix,
              (four ^ (four >> np.uint32(15))) * mix,
              (word >> np.uint64(32)).astype(np.uint32))
    out, last = [], None
    for h, first, rows in zip(hashes, alphabet.first, alphabet.rows):
        if rows is last:
            begin = begin + (first[0] - at)
        else:
            share, last, begin = rows[before], rows, first[before]
        at = first[0]
        row = h.astype(np.uint64)       # all in one type: mixed ones are cast in pieces
        row *= share
        row >>= np.uint64(32)
        row = row.view(np.int64)
        row += begin
        row *= alphabet.size
        out.append(row)
    return out


def _symbols(data, starts, sizes, alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The symbol at each place and the one before it."""
    symbols = alphabet.of_byte[data]
    before = np.concatenate((symbols[:1], symbols[:-1]))
    symbols[starts + sizes - 1] = END
    return symbols, before


def _text_places(starts, n: int) -> np.ndarray:
    """Which of ``n`` places are not pads."""
    real = np.ones(n, dtype=bool)
    for p in range(1, len(_PAD) + 1):
        real[starts - p] = False
    return real


def _groups(texts: list[bytes], order, most: int = GROUP, width: int = 1 << 30):
    """Runs of ``order`` with at most ``width`` texts and ``most`` symbols, or a single text."""
    run, size = [], 0
    for k in order:
        if run and (size + len(texts[k]) >= most or len(run) == width):
            yield run
            run, size = [], 0
        run.append(k)
        size += len(texts[k]) + 1
    if run:
        yield run


# ----------------------------------------------------------------- counting

def _count_contexts(alphabet: Alphabet):
    """A task's context counts as packed blocks (block, counts)."""
    width = alphabet.size

    def run(batches):
        counts = np.zeros(ROWS * width + 1, dtype=np.int32)     # the last is the pads'
        some, one = False, np.int32(1)      # of the table's type: ufunc.at's fast path
        for batch in batches:
            texts = [lowered(t) for t in batch.column(0).to_pylist()]
            for group in _groups(texts, range(len(texts)), BLOCK_SYMBOLS):
                data, starts, sizes = _laid_out([texts[k] for k in group])
                symbols, before = _symbols(data, starts, sizes, alphabet)
                pads = np.flatnonzero(~_text_places(starts, len(data)))
                some = True
                for cell in _rows(data, before, alphabet):
                    cell += symbols
                    cell[pads] = ROWS * width
                    np.add.at(counts, cell, one)
        if some:
            blocks = counts[:-1].reshape(ROWS // BLOCK, BLOCK * width)
            used = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)),
                 pa.array([_packed(blocks[u]) for u in used], pa.binary())],
                names=["block", "counts"])
    return run


def _packed(counts: np.ndarray) -> bytes:
    """Counts as one byte each, larger ones as (place, count) behind them."""
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(b"".join((np.int32(len(counts)).tobytes(), small.tobytes(),
                                   large.astype("<i4").tobytes(),
                                   counts[large].astype("<i8").tobytes())), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    counts = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    m = (len(raw) - 4 - n) // 12
    counts[np.frombuffer(raw, "<i4", m, 4 + n)] = np.frombuffer(raw, "<i8", m, 4 + n + 4 * m)
    return counts


def _merged(blocks: DataFrame, tasks: int, finish) -> DataFrame:
    """(block, odds): the counts of all tasks' blocks added up in a tree,
    then ``finish``ed. ``blocks`` has the task's number in ``part``."""
    def add(last):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(_unpacked(c) for c in pdf["counts"])
            return pdf[["block", "part"]].head(1).assign(
                counts=[finish(total, int(pdf["block"].iloc[0])) if last else _packed(total)])
        return run

    while True:
        tasks = -(-tasks // FAN)
        blocks = blocks.withColumn("part", F.expr(f"CAST(part DIV {FAN} AS INT)")) \
            .groupBy("block", "part").applyInPandas(
                add(tasks <= 1), "block int, part int, counts binary")
        if tasks <= 1:
            return blocks.select("block", F.col("counts").alias("odds"))


def context_odds(texts: DataFrame, alphabet: Alphabet) -> np.ndarray:
    """The log odds (ROWS * width) of a one-column DataFrame of texts."""
    counted = texts.mapInArrow(_count_contexts(alphabet), "block int, counts binary") \
        .withColumn("part", F.spark_partition_id())
    width = alphabet.size

    def finish(counts, block):
        return alphabet.log_odds(counts.reshape(BLOCK, width), block * BLOCK).tobytes()

    out = np.zeros((ROWS // BLOCK, BLOCK * width), dtype=np.int8)
    for r in _merged(counted, texts.rdd.getNumPartitions(), finish).toLocalIterator():
        out[r["block"]] = np.frombuffer(r["odds"], dtype=np.int8)
    return out.reshape(-1)


def _count_tokens(batches):
    """(token, n) of the words; and, with a null token, the counts of byte pairs
    (``byte`` is 257 times the byte before plus the byte, 256 for a text's end)."""
    counts: Counter = Counter()

    def rows():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()),
             pa.nulls(len(counts), pa.int32())], names=["token", "n", "byte"])
        counts.clear()
        return batch

    n = np.zeros(256 * 257, dtype=np.int64)
    for batch in batches:
        texts = [lowered(t) for t in batch.column(0).to_pylist()]
        for group in _groups(texts, range(len(texts)), BLOCK_SYMBOLS):
            data, starts, sizes = _laid_out([texts[k] for k in group])
            byte = data.astype(np.int64)
            byte[starts + sizes - 1] = 256
            pair = byte.copy()
            pair[1:] += 257 * data[:-1].astype(np.int64)
            n += np.bincount(pair[_text_places(starts, len(data))], minlength=256 * 257)
        for text in texts:
            counts.update(text.split())
        if len(counts) > 1 << 19:
            yield rows()
    if counts:
        yield rows()
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.array(n[at]),
                                      pa.array(at.astype(np.int32))], names=["token", "n", "byte"])


# ------------------------------------------------------------------ scoring

def _stretches(longest: int):
    """Where the weights are refined: after every ``STRETCH`` symbols of the whole
    text (by place in the text only, so grouping changes nothing)."""
    for at in range(0, longest, STRETCH):
        yield at, at + STRETCH


def mixed_bits(texts: list[bytes], alphabet: Alphabet, odds: np.ndarray,
               weights=WEIGHTS, rate: float = RATE) -> np.ndarray:
    """Bits that coding each text and its end costs (texts of one group)."""
    n, sizes = len(texts), np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + len(_PAD)) - sizes
    codes, rows = [], []
    for block in _groups(texts, range(n), BLOCK_SYMBOLS):
        data, first, size = _laid_out([texts[k] for k in block])
        symbols, before = _symbols(data, first, size, alphabet)
        rows.append([r.astype(np.int32) for r in _rows(data, before, alphabet)])
        codes.append((before * alphabet.size + symbols).astype(np.int32))
    codes = np.concatenate(codes)
    base = [np.concatenate(r) for r in zip(*rows)]
    depth, unit = alphabet.depth, np.float32(1 / ODDS ** 2)
    # by context (the last is the bias), text and depth
    mixer = np.empty((CONTEXTS + 1, n, depth), dtype=np.float32)
    mixer[:CONTEXTS] = (np.asarray(weights, dtype=np.float32) / ODDS)[:, None, None]
    mixer[CONTEXTS] = 0
    nats = np.zeros(n)
    for low, high in _stretches(int(sizes.max())):
        who = np.flatnonzero(sizes > low)           # texts that have a symbol here
        many = np.minimum(sizes[who], high) - low
        first = np.cumsum(many) - many
        at = np.repeat(starts[who] + low - first, many)
        at += np.arange(len(at))
        # all decisions of the stretch at once: its weights are those of its start
        s = codes[at]
        count = alphabet.length[s]
        symbol = np.repeat(np.arange(len(s)), count)
        step = np.repeat(alphabet.begin[s] - (np.cumsum(count) - count), count)
        step += np.arange(len(step))
        node, way = alphabet.node[step], alphabet.sign[step]
        steps = np.add.reduceat(count, first)       # of each text
        slot = np.repeat(np.arange(0, len(who) * depth, depth), steps)
        slot += alphabet.deep[step]                 # the weights that a decision uses
        whole = len(who) == n
        held = mixer if whole else mixer[:, who]
        total = held[CONTEXTS].ravel()[slot]
        inputs = []
        for b, w in zip(base, held):
            place = b[at].astype(np.int64)[symbol]
            place += node
            x = odds[place].astype(np.float32)
            inputs.append(x)
            total += w.ravel()[slot] * x
        total *= way
        np.maximum(total, np.float32(-20), out=total)
        np.minimum(total, np.float32(20), out=total)
        wrong = np.exp(-total)
        one = wrong + np.float32(1)
        nats[who] += np.add.reduceat(np.log(one), np.cumsum(steps) - steps)
        wrong /= one
        wrong *= way                                # the slope of the cost
        # a step along the gradient's mean, shorter where little was read
        cells = len(who) * depth
        pace = rate / np.sqrt(np.bincount(slot, minlength=cells) + 16)
        for k, x in enumerate([*inputs, None]):
            slope = np.bincount(slot, wrong if x is None else wrong * x, cells)
            slope *= pace if x is None else unit * pace
            held[k] += slope.reshape(len(who), depth)
        if not whole:
            mixer[:, who] = held
    escaped = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(codes % alphabet.size == ESCAPE, out=escaped[1:])
    return nats / np.log(2) + 8.0 * (escaped[starts + sizes] - escaped[starts])


def _score(alphabet, model):
    """The first two columns of each row as they are, then n_bytes, n_tokens, known, logs,
    bits, tail of its text, the third: baseline sums over the broadcast tokens, the
    others in ``tail`` as (hash, n)."""
    def run(batches):
        odds, head = model.value
        get = head.get                      # log10(count + 1), never 0
        for batch in batches:
            texts = [lowered(t) for t in batch.column(2).to_pylist()]
            bits = np.zeros(len(texts))
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            for group in _groups(texts, order, GROUP, WIDTH):
                bits[group] = mixed_bits([texts[k] for k in group], alphabet, odds)
            n_tokens, known, logs, ends, hashes, times = [], [], [], [0], [], []
            for text in texts:
                words = text.split()
                found = np.array([get(w, 0.0) for w in words])
                rest = Counter([words[k] for k in np.flatnonzero(found == 0).tolist()])
                hashes += [xxhash.xxh64_intdigest(w, 42) for w in rest]
                times += rest.values()
                n_tokens.append(len(words) + 1)
                known.append(int(np.count_nonzero(found)))
                logs.append(float(found.sum()))
                ends.append(len(hashes))
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.array(hashes, dtype=np.uint64).astype(np.int64)),
                 pa.array(times, pa.int32())], names=["h", "n"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(logs, pa.float64()), pa.array(bits), tail],
                names=["doc_id", "held_out", "n_bytes", "n_tokens", "known", "logs", "bits", "tail"])
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, bits_per_byte.

    A null text is an empty one (its end alone). A null id is held out. Repeated
    rows are learned from and scored as often as they come. Without training texts
    every byte is an escape and the counts are 0. An empty table gives no rows.
    Other columns are not read."""
    spark = docs.sparkSession
    document_batches(spark)
    mod, held = HELD_OUT
    held_out = F.coalesce(id_crc_mod(id_col, mod) == held, F.lit(True))
    learn = docs.filter(~held_out).select(F.col(text_col).alias("text"))
    tokens = written(learn.mapInArrow(_count_tokens, "token binary, n long, byte int")
                     .groupBy("token", "byte").agg(F.sum("n").alias("n")), "tokens")
    words = tokens.filter("token IS NOT NULL")
    pairs = np.zeros(256 * 257, dtype=np.int64)
    for r in tokens.filter("token IS NULL").collect():          # 256 * 257 at most
        pairs[r["byte"]] = r["n"]
    pairs = pairs.reshape(256, 257)
    texts = int(pairs[:, 256].sum())
    total = words.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    train_tokens, distinct = (total["n"] or 0) + texts, total["v"] + (texts > 0)
    common = words.filter(F.col("n") * HEAD >= train_tokens).toArrow()
    head = dict(zip(common["token"].to_pylist(), np.log10(common["n"].to_numpy() + 1.0).tolist()))
    alphabet = Alphabet(pairs)
    model = spark.sparkContext.broadcast((context_odds(learn, alphabet), head))

    # the id travels with its text; rows are numbered once, as they are written
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"),
                       F.col(text_col).alias("text"))
    scored = rows.mapInArrow(
        _score(alphabet, model),
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_bytes long, "
        "n_tokens long, known long, logs double, bits double, tail array<struct<h: long, n: int>>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = words.filter(F.col("n") * HEAD < train_tokens).select(F.xxhash64("token").alias("h"),
                                                                 F.col("n").alias("c"))
    rest = scored.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.n") \
        .join(rare, "h").groupBy("row").agg(
            F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = scored.drop("tail").join(rest, "row", "left")
    zero, end_log = F.lit(0), float(np.log10(texts + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", zero) + int(texts > 0)).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", zero) + end_log
         - F.col("n_tokens") * float(np.log10(train_tokens + distinct + 1))).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"),
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def query(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op3_context_mixing": query}
