"""Language of a text by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over
all ways to cut it into pieces, by a forward pass over its characters; pieces never reach over word starts, so that of a
text is the product over its words. Probabilities are learned from word counts per language by expectation maximisation:
a forward and a backward pass give the expected number of times that each piece is used.

Texts are lower-cased; words are runs of letters and their marks. Only distinct words are passed through: of a slice of
texts when scoring, of the whole training corpus when learning.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece as spm
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrow import slices, texts, words
from .storage import written

MARK = "▁"
UNDETERMINED = "und"
#: Letters up to which a word's probability is summed as it is: at 1e-10 a letter it stays a normal number.
SHORT = 24
#: Words passed through at once.
BATCH = 40_000
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Added to the expected count of every piece.
SMOOTH = 0.1
#: Languages that a model may have; the table of pieces goes to every task, so its size is vocabulary times languages.
MAX_LANGUAGES = 1000
SLICE_BYTES = 6 << 20


class Model(NamedTuple):
    """Learned languages, their log share of documents, log probability of each piece (rows) and language (columns)."""

    languages: list[str]
    priors: np.ndarray
    table: np.ndarray
    pieces: list[str]


def letter_pieces(model_path: str) -> list[str]:
    """Pieces of a SentencePiece model that hold lower-case letters only, with or without a word start."""
    lib = spm.SentencePieceProcessor(model_file=model_path)
    found = {lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    return sorted({MARK} | {p for p in found if p.removeprefix(MARK).isalpha() and p == p.lower()})


class Lattice:
    """Pieces inside words, found by walking a trie of the vocabulary from all characters at once; a character that is no
    piece counts as the unknown one."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        letters = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.wide = len(letters) + 1
        steps: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for i, piece in enumerate(pieces):
            node = 0
            for c in piece:
                key = node * self.wide + int(self.code[ord(c)])
                node = steps.setdefault(key, len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
            piece_at[node] = i
        self.keys = np.array(sorted(steps) + [np.iinfo(np.int64).max], np.int64)
        self.child = np.array([steps[k] for k in self.keys[:-1].tolist()] + [0], np.int64)
        self.piece = np.array(piece_at, np.int64)

    def edges(self, batch: list[str]) -> tuple[np.ndarray, ...]:
        """Start, end and piece of every piece in the words put in a row, and each word's first and last place."""
        joined = "\n".join([MARK + w for w in batch]) + "\n"
        size = np.array([len(w) + 1 for w in batch], np.int64)
        first = np.cumsum(size + 1) - size - 1
        code = self.code[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        inside = np.ones(len(code), bool)
        inside[first + size] = False
        at = np.flatnonzero(inside)
        state, alone, found = np.zeros(len(at), np.int64), inside.copy(), []
        for k in range(len(code)):
            step = state * self.wide + code[at + k]
            place = np.searchsorted(self.keys, step)
            known = self.keys[place] == step
            at, state = at[known], self.child[place[known]]
            if not len(at):
                break
            piece = self.piece[state]
            full = piece >= 0
            found.append((at[full], at[full] + k + 1, piece[full]))
            if not k:
                alone[at[full]] = False
        rest = np.flatnonzero(alone)
        found.append((rest, rest + 1, np.full(len(rest), self.unknown)))
        return (*[np.concatenate(x) for x in zip(*found)], first, first + size)

    @staticmethod
    def _steps(key: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Edges by their place inside the word, then by place; where a new place begins; runs of equal inner places."""
        order = np.lexsort((key, local))
        sorted_key, sorted_local = key[order], local[order]
        heads = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(order) else np.zeros(0, np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(sorted_local[heads]) != 0)) if len(heads) else np.zeros(0, np.int64), len(heads))
        return order, np.append(heads, len(order)), list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))

    def _pass(self, source, target, weight, base, local, logs: bool) -> None:
        """Fill ``base`` at ``target`` with the sum of what comes from ``source`` over each edge."""
        order, heads, runs = self._steps(target, local)
        source, weight, places = source[order], weight[order], target[order]
        for a, b in runs:
            lo, hi = heads[a], heads[b]
            if logs:
                base[places[heads[a:b]]] = np.logaddexp.reduceat(base[source[lo:hi]] + weight[lo:hi], heads[a:b] - lo, axis=0)
            else:
                base[places[heads[a:b]]] = np.add.reduceat(base[source[lo:hi]] * weight[lo:hi], heads[a:b] - lo, axis=0)

    @staticmethod
    def _by_length(batch: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Places of short words, whose products of probabilities stay above zero, and of others, which are summed as logs."""
        large = np.array([len(w) > SHORT for w in batch], bool)
        yield from ((at, logs) for at, logs in ((np.flatnonzero(~large), False), (np.flatnonzero(large), True)) if len(at))

    def forward(self, batch: list[str], table: np.ndarray) -> np.ndarray:
        """Log probability of every word in every language."""
        out = np.empty((len(batch), table.shape[1]))
        for at, logs in self._by_length(batch):
            start, end, piece, first, last = self.edges([batch[i] for i in at.tolist()])
            origin = np.repeat(first, last - first + 1)
            base = np.full((len(origin), table.shape[1]), -np.inf if logs else 0.0)
            base[first] = 0.0 if logs else 1.0
            self._pass(start, end, (table if logs else np.exp(table))[piece], base, end - origin[end], logs)
            out[at] = base[last] if logs else np.log(base[last])
        return out

    def expected(self, batch: list[str], language: np.ndarray, times: np.ndarray, table: np.ndarray, into: np.ndarray) -> None:
        """Add to ``into`` how often each piece is used, over words of given languages and counts."""
        for at, logs in self._by_length(batch):
            start, end, piece, first, last = self.edges([batch[i] for i in at.tolist()])
            word = np.repeat(np.arange(len(at)), last - first + 1)
            own = word[start]
            weight = (table if logs else np.exp(table))[piece, language[at][own]]
            none, one = (-np.inf, 0.0) if logs else (0.0, 1.0)
            ahead, back = np.full(len(word), none), np.full(len(word), none)
            ahead[first], back[last] = one, one
            self._pass(start, end, weight, ahead, end - first[word[end]], logs)
            self._pass(end, start, weight, back, last[own] - start, logs)
            whole = ahead[last][own]
            share = np.exp(ahead[start] + weight + back[end] - whole) if logs else ahead[start] * weight * back[end] / whole
            cells = piece * table.shape[1] + language[at][own]
            into += np.bincount(cells, weights=share * times[at][own], minlength=into.size).reshape(into.shape)


_LATTICES: dict[tuple, Lattice] = {}


def _lattice(pieces: list[str]) -> Lattice:
    key = (len(pieces), hash(tuple(pieces)))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(pieces)
    return _LATTICES[key]


def letter_words(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters and marks of all texts, and their number per text."""
    return words(pc.replace_substring_regex(pc.utf8_lower(strings), r"[^\p{L}\p{M}]+", " "))


def word_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows with a language; counted in each slice before anything moves."""
    schema = T._parse_datatype_string("lang string, word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                flat, count = letter_words(texts(part, text))
                if not len(flat):
                    continue
                codes, names = flat.dictionary_encode(), part[lang].cast(pa.string()).dictionary_encode()
                of = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), count)
                keys, n = np.unique(of * len(codes.dictionary) + codes.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys // len(codes.dictionary))), codes.dictionary.take(pa.array(keys % len(codes.dictionary))),
                                                  pa.array(n.astype(np.int64))], names=schema.names)

    found = df.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(run, schema)
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, model_path: str, text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> Model:
    """Learn from all rows with a text that has letters and a non-null language.

    The corpus is read once for its word counts; every round then passes over the distinct words of each language. What
    comes to the driver is the table of expected counts, at most one row per piece and language. Without any such row the
    model has no language.
    """
    pieces = letter_pieces(model_path)
    counts = written(word_counts(df, text, lang), "language-words", "lz4")
    learned = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(learned) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r.lang for r in learned]
    documents = {r.lang: r.n for r in df.where(F.col(lang).isin(languages)).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()} if languages else {}
    share = np.array([documents[x] for x in languages], float)
    size = (len(pieces) + 1, len(languages))
    table = np.full(size, -np.log(size[0]))
    place = {x: i for i, x in enumerate(languages)}
    schema = T._parse_datatype_string("piece int, language int, n double")
    for _ in range(rounds if languages else 0):
        shared = df.sparkSession.sparkContext.broadcast((pieces, place, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, where, now = shared.value
            lattice, into = _lattice(names), np.zeros(now.shape)
            for batch in batches:
                for a in range(0, batch.num_rows, BATCH):
                    part = batch.slice(a, BATCH)
                    language = np.array([where[x] for x in part["lang"].to_pylist()], np.int64)
                    lattice.expected(part["word"].to_pylist(), language, part["n"].to_numpy().astype(float), now, into)
            i, j = np.nonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(into[i, j])], names=schema.names)

        used = counts.mapInArrow(run, schema).groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        expected = np.full(size, SMOOTH)
        expected[used["piece"], used["language"]] += used["n"]
        table = np.log(expected / expected.sum(axis=0))
    return Model(languages, np.log(share / share.sum()) if languages else share, table, pieces)


def predict(df: DataFrame, model: Model, text: str = "text", into: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append the likeliest language of each whole text and its share of the probability of all languages.

    Null and texts without a letter are ``und`` with score 0, as are all texts when no language was learned. Of languages
    equally likely the first in alphabetical order is taken. Columns of the given names are replaced, others stay. Nothing
    is shuffled; an empty table gives an empty table.
    """
    base = df.drop(into, score)
    schema = T.StructType([*base.schema.fields, T.StructField(into, T.StringType()), T.StructField(score, T.DoubleType())])
    columns, shared = base.columns, df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        lattice = _lattice(fitted.pieces)
        names = pa.array([*fitted.languages, UNDETERMINED], pa.string())
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                source = texts(part, text)
                flat, count = letter_words(source)
                best, top = np.full(part.num_rows, len(fitted.languages)), np.zeros(part.num_rows)
                if len(flat) and fitted.languages:
                    coded = flat.dictionary_encode()
                    distinct = coded.dictionary.to_pylist()
                    each = np.concatenate([lattice.forward(distinct[a:a + BATCH], fitted.table) for a in range(0, len(distinct), BATCH)])
                    which, upto = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(count)])
                    total = np.stack([np.diff(np.concatenate([[0.0], np.cumsum(each[which, k])])[upto]) for k in range(each.shape[1])], axis=1) + fitted.priors
                    share = np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))
                    letters = pc.match_substring_regex(source, r"\p{L}").to_numpy(zero_copy_only=False) & (count > 0)
                    best = np.where(letters, total.argmax(axis=1), best)
                    top = np.where(letters, np.round(np.minimum(share.max(axis=1), 1.0), 6), 0.0)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in columns], names.take(pa.array(best)), pa.array(top)], names=schema.names)

    return base.mapInArrow(run, schema)


def held_out(key: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row's key, as text, falls into the fold that is kept from learning; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def identify(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, and predict all: key, held_out, lang_pred, score."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"), held_out(key).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), model_path, "_text", "_lang")
    return predict(rows.drop("_lang"), model, "_text").select(F.col("_key").alias(key), "held_out", "lang_pred", "score")
