"""Log-bilinear language model, trained in NumPy with noise-contrastive estimation, and its scores for whole texts."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrow import slices, texts, words
from .storage import written

#: The end of a text as a token; no word has a line end in it.
END = "\n"
#: Words with a symbol of their own; others share the symbols of classes of like frequency. Size of the model, not of the data.
TOP, CLASSES, WIDTH = 959, 64, 16
#: Tokens in a block, the unit that is coded, trained on and scored at once.
BLOCK = 1_000_000
BATCH, NOISE, RATE = 8192, 48, 0.06
MODULUS, HELD = 7, 2


def _one(values: pa.Array) -> pa.Array:
    """A list array with one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def held_out(key: object) -> bool:
    """Whether a document is kept from training; a null key counts as the empty text."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % MODULUS == HELD


def _planes(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers as all their low bytes, then all the next ones; high bytes of small numbers compress to nothing."""
    return numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _from_planes(data: pa.Scalar, kind: str) -> np.ndarray:
    planes = np.frombuffer(data.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents in coded blocks, written: keys, lengths, tokens as places in the block's own words (frequent ones first),
    and how often the training documents of the block have each word. Texts are tokenised once; later steps read the
    blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def block() -> pa.RecordBatch:
            keys = [k for h in held for k in h[0]]
            ends = np.concatenate([h[1] for h in held])
            coded = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
            rank = np.argsort(-np.bincount(coded.indices, minlength=len(coded.dictionary)), kind="stable")
            place = np.empty(len(rank), np.uint32)
            place[rank] = np.arange(len(rank))
            place = place[coded.indices.to_numpy()]
            test = np.array([held_out(k) for k in keys])
            counts = np.bincount(place[~np.repeat(test, ends)], minlength=len(coded.dictionary))
            return pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 24) + number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([ends.astype(np.int64)]),
                 pa.array([_planes(place, "<u4")], pa.binary()), _one(coded.dictionary.take(pa.array(rank))), pa.array([counts.astype(np.int64)])],
                names=["block", "keys", "sizes", "tokens", "words", "counts"])

        for batch in batches:
            for part in slices(batch, text):
                flat, count = words(pc.ascii_lower(texts(part, text)))
                upto = np.cumsum(count)
                # one end after the words of each text
                at = np.repeat(np.arange(len(count)), count) + np.arange(len(flat))
                source = np.full(len(flat) + len(count), len(flat))
                source[at] = np.arange(len(flat))
                tokens = pa.concat_arrays([flat, pa.array([END])]).take(pa.array(source))
                held.append((part[key].to_pylist(), count + 1, tokens))
                size += int(upto[-1]) + len(count)
                if size >= BLOCK:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()
        held = []
        pa.default_memory_pool().release_unused()

    schema = "block long, keys array<long>, sizes array<long>, tokens binary, words array<string>, counts array<long>"
    return written(docs.select(key, text).mapInArrow(run, schema), "lm-blocks", "zstd")


class Model:
    """Scores a symbol by its vector's product with a weighted sum of the vectors of the two symbols before it."""

    NAMES = ("context", "target", "weights", "bias")

    def __init__(self, share: np.ndarray, seed: int = 1):
        self.share = np.maximum(share, 1e-9) / np.maximum(share, 1e-9).sum()
        draw = np.random.default_rng(seed)
        k = len(share)
        self.context = draw.normal(0, 0.3, (k, WIDTH)).astype(np.float32)
        self.target = np.zeros((k, WIDTH), np.float32)
        self.weights = np.array([np.full(WIDTH, 1.0), np.full(WIDTH, 0.5)], np.float32)
        self.bias = np.log(self.share).astype(np.float32)
        self.totals = np.full((k, k), np.nan)
        self.squares = {n: np.full(getattr(self, n).shape, 1e-2, np.float32) for n in self.NAMES}

    def _move(self, name: str, gradient: np.ndarray) -> None:
        self.squares[name] += gradient * gradient
        getattr(self, name)[...] -= RATE * gradient / np.sqrt(self.squares[name])

    def learn(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, draw: np.random.Generator) -> None:
        """A pass over (previous, one before it, word) triples. Each batch shares its noise words, so that all products
        are those of matrices."""
        k, noise_log = len(self.bias), np.log(NOISE * self.share).astype(np.float32)
        edges = np.cumsum(self.share)
        self.totals[...] = np.nan
        for at in range(0, len(word), BATCH):
            a, b, w = one[at:at + BATCH], two[at:at + BATCH], word[at:at + BATCH]
            noise = np.minimum(np.searchsorted(edges, draw.random(NOISE)), k - 1)
            ca, cb = self.context[a], self.context[b]
            guess = ca * self.weights[0] + cb * self.weights[1]
            true = np.einsum("ij,ij->i", guess, self.target[w]) + self.bias[w] - noise_log[w]
            false = guess @ self.target[noise].T + (self.bias[noise] - noise_log[noise])
            up = (-1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32) / len(w)
            down = (1 / (1 + np.exp(np.clip(-false, -30, 30)))).astype(np.float32) / len(w)
            by_guess = up[:, None] * self.target[w] + down @ self.target[noise]
            target, context = np.zeros_like(self.target), np.zeros_like(self.context)
            _add(target, w, up[:, None] * guess)
            np.add.at(target, noise, down.T @ guess)
            _add(context, a, by_guess * self.weights[0])
            _add(context, b, by_guess * self.weights[1])
            bias = np.bincount(w, up, k) + np.bincount(noise, down.sum(0), k)
            self._move("weights", np.array([(by_guess * ca).sum(0), (by_guess * cb).sum(0)]))
            self._move("target", target)
            self._move("context", context)
            self._move("bias", bias.astype(np.float32))

    def normalisers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all symbols after each of some contexts."""
        total = np.empty(len(one))
        for at in range(0, len(one), 2048):
            a, b = one[at:at + 2048], two[at:at + 2048]
            scores = (self.context[a] * self.weights[0] + self.context[b] * self.weights[1]) @ self.target.T + self.bias
            top = scores.max(1)
            total[at:at + 2048] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        return total

    def logs(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of each word; ``totals`` keeps the sum over all symbols of each context."""
        missing = np.isnan(self.totals[one, two])
        if missing.any():
            contexts = np.unique(one[missing].astype(np.int64) * len(self.bias) + two[missing])
            a, b = np.divmod(contexts, len(self.bias))
            self.totals[a, b] = self.normalisers(a, b)
        out = np.empty(len(word))
        for at in range(0, len(word), 1 << 16):
            cut = slice(at, at + (1 << 16))
            guess = self.context[one[cut]] * self.weights[0] + self.context[two[cut]] * self.weights[1]
            out[cut] = np.einsum("ij,ij->i", guess, self.target[word[cut]]) + self.bias[word[cut]] - self.totals[one[cut], two[cut]]
        return out

    def values(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float64)

    def take(self, values: np.ndarray) -> "Model":
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, values[at:at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Sum the values of equal rows into a matrix."""
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    into[ranked[starts]] += np.add.reduceat(values[order], starts, axis=0)


def _triples(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each; before the first of a text stand ends (symbol 0)."""
    one, two = np.zeros_like(symbols), np.zeros_like(symbols)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    one[first] = two[first] = 0
    two[(first + 1)[first + 1 < len(symbols)]] = 0
    return one, two


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score.

    Word counts, frequency classes and the model come from all documents that are not held out. The TOP most frequent
    words and the end have symbols of their own, others share a class symbol and have a fixed share of it; a word that
    training never met is the unknown one, which shares the class of words met once. So probabilities sum to one. Each
    task trains on its blocks in turn from the same start; their models are averaged, weighted by tokens, in two steps.
    Null texts are empty (their end is scored); repeated rows count each; without any training document all scores are
    those of the start. Nothing is sampled.
    """
    spark = docs.sparkSession
    coded = blocks(docs, key, text)
    counted = coded.select(F.explode(F.arrays_zip("words", "counts")).alias("z")).select(F.col("z.words").alias("word"), F.col("z.counts").alias("n")).where("n > 0")
    vocabulary = written(counted.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    n, v, once, twice = (x or 0 for x in vocabulary.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first())
    frequent = [r["word"] for r in vocabulary.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(TOP).collect()]
    tops = spark.createDataFrame([(w, i) for i, w in enumerate([END, *frequent])], "word string, top int")  # TOP + 1 rows
    symbol = F.coalesce("top", F.lit(TOP + 1) + F.floor(F.log2("c")).cast("int")).cast("int")
    named = vocabulary.join(F.broadcast(tops), "word", "left").select("word", "c", symbol.alias("symbol"))
    mass = np.zeros(TOP + 1 + CLASSES)
    for r in named.groupBy("symbol").agg(F.sum("c").alias("c")).collect():  # one row a symbol
        mass[r["symbol"]] = r["c"]
    unknown = once / (once + 2 * twice) if once else 1.0  # share of words never met among those met never or once

    # each block's words get their counts and symbols
    own = coded.select("block", F.posexplode("words").alias("at", "word"))
    looked = own.join(named, "word", "left").select("block", "at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("symbol", F.lit(TOP + 1)).alias("symbol"))
    tables = looked.groupBy("block").agg(F.collect_list(F.struct("at", "c", "symbol")).alias("z")) \
        .select("block", F.col("z.at").alias("at"), F.col("z.c").alias("c"), F.col("z.symbol").alias("symbol"))
    sent = spark.sparkContext.broadcast((mass, n, v, once, unknown))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, n, v, once, unknown = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch["at"][i].values.to_numpy()
                counts, symbols = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
                counts[at], symbols[at] = batch["c"][i].values.to_numpy(), batch["symbol"][i].values.to_numpy()
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside = np.log10(counts / mass[symbols])  # a word's share of its symbol
                share = np.where(counts > 0, (1 - unknown) / max(once, 1), unknown)
                inside = np.where(symbols == TOP + 1, np.log10(np.maximum(share, 1e-300)), inside)
                base = np.log10((counts + 1) / (n + 1 * (v + 1)))
                place = _from_planes(batch["tokens"][i], "<u4")
                sizes = batch["sizes"][i].values.to_numpy()
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                sums = [np.add.reduceat(x[place], first) for x in ((counts > 0).astype(np.int64), base, inside)]
                yield pa.RecordBatch.from_arrays([batch["keys"].slice(i, 1), batch["sizes"].slice(i, 1), pa.array([_planes(symbols[place], "<u2")], pa.binary()), *[_one(pa.array(x)) for x in sums]],
                                                 names=["keys", "sizes", "symbols", "known", "base", "inside"])

    joined = coded.select("block", "keys", "sizes", "tokens").join(tables, "block")
    ready = written(joined.mapInArrow(code, "keys array<long>, sizes array<long>, symbols binary, known array<long>, base array<double>, inside array<double>"), "lm-coded", "zstd")

    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(batch.num_rows):
            yield batch["sizes"][i].values.to_numpy(), _from_planes(batch["symbols"][i], "<u2").astype(np.int32)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Model(sent.value[0]), 0
        for batch in batches:
            for i, (sizes, symbols) in enumerate(parts(batch)):
                test = np.array([held_out(k) for k in batch["keys"][i].as_py()])
                one, two = _triples(symbols, sizes)
                use = np.flatnonzero(~np.repeat(test, sizes))
                draw = np.random.default_rng(7)
                draw.shuffle(use)
                model.learn(one[use], two[use], symbols[use], draw)
                seen += len(use)
        if seen:
            yield _summed([(model.values() * seen, seen)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = None, 0
        for batch in batches:
            for values, some in zip(batch["values"].to_pylist(), batch["seen"].to_pylist()):
                got = np.frombuffer(values, np.float64)
                total, seen = got.copy() if total is None else total + got, seen + some
        if seen:
            yield _summed([(total, seen)])

    sums = ready.select("keys", "sizes", "symbols").mapInArrow(train, "values binary, seen long").repartition(16).mapInArrow(add, "values binary, seen long").collect()  # 16 rows at most
    model = Model(mass)
    if sums:
        model.take(sum(np.frombuffer(r["values"], np.float64) for r in sums) / sum(r["seen"] for r in sums))
    learned = spark.sparkContext.broadcast(model.values())

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value[0]).take(learned.value)
        every = np.arange(len(model.bias))
        for batch in batches:
            for one in batch["id"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([model.normalisers(np.full(len(every), one), every).tobytes()], pa.binary())], names=["one", "totals"])

    # the sums of all contexts of two symbols, a table that the model's size bounds
    sums = spark.range(0, len(mass), 1, 12).mapInArrow(sum_up, "one long, totals binary").collect() if n else []
    totals = spark.sparkContext.broadcast(np.array([np.frombuffer(r["totals"]) for r in sorted(sums, key=lambda r: r["one"])]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value[0]).take(learned.value)
        if len(totals.value):
            model.totals = totals.value
        for batch in batches:
            for i, (sizes, symbols) in enumerate(parts(batch)):
                one, two = _triples(symbols, sizes)
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                logs = np.add.reduceat(model.logs(one, two, symbols), first) / np.log(10)
                keys = batch["keys"][i].values
                columns = [keys, pa.array([held_out(k) for k in keys.to_pylist()], pa.bool_()), pa.array(sizes), batch["known"][i].values, pa.array(np.full(len(keys), sent.value[1], np.int64)),
                           batch["base"][i].values, pa.array(logs + batch["inside"][i].values.to_numpy())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = ready.mapInArrow(rate, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


def _summed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["values", "seen"])
