"""Benchmark decontamination with a generalised suffix automaton over the words of all items."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import slices, texts, words
from .storage import written

#: Bytes of items in one automaton; a larger benchmark is matched in several passes, each with its own block of items.
BLOCK_BYTES = 1 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes after lower-casing: what isn't part of a word becomes a blank.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty string; a state is a set of end positions."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in items if ws]
        for _, sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        #: Items with a window that ends here, and the lengths of the windows in this state's class.
        self.items: dict[int, set[str]] = {}
        self.ends: dict[int, list[int]] = {}
        for item, sequence in coded:
            size = min(window, len(sequence))
            for state in self._windows(sequence, size):
                self.items.setdefault(state, set()).add(item)
                if size not in self.ends.setdefault(state, []):
                    self.ends[state].append(size)
        self.shortest = min((min(window, len(s)) for _, s in coded), default=0)
        self._reach()

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """Class of the strings of ``child`` no longer than parent + 1, made a state of its own where it isn't one."""
        if self.length[child] == self.length[parent] + 1:
            return child
        apart = self._new(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = apart
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = apart
            parent = self.link[parent]
        return apart

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # another item has this string already
            return self._split(last, word, known)
        made, at = self._new(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = made
            at = self.link[at]
        if at >= 0:
            self.link[made] = self._split(at, word, self.next[at][word])
        return made

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest suffix of what was read that occurs in an item."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        follow = self.next[state].get(word)
        return (0, 0) if follow is None else (follow, length + 1)

    def _windows(self, sequence: list[int], size: int) -> Iterator[int]:
        state = length = 0
        for i, word in enumerate(sequence):
            state, length = self.step(state, length, word)
            at = state
            while self.length[self.link[at]] >= size:  # the class that holds the suffix of this size
                at = self.link[at]
            if i + 1 >= size:
                yield at

    def _reach(self) -> None:
        """For each state, the (state, size) of all windows that end wherever it ends, largest first."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.found: list[tuple] = [()] * len(self.link)
        for s in order:
            own = tuple((s, size) for size in sorted(self.ends.get(s, ()), reverse=True))
            self.found[s] = own + self.found[self.link[s]]

    def match(self, run: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges covered by windows, and the items of these."""
        state = length = 0
        ranges, items = [], set()
        for i, word in enumerate(run):
            state, length = self.step(state, length, word)
            widest = 0
            for at, size in self.found[state]:
                if size <= length:
                    widest = max(widest, size)
                    items |= self.items[at]
            if widest:
                if ranges and ranges[-1][1] >= i + 1 - widest:
                    start = min(ranges.pop()[0], i + 1 - widest)
                    while ranges and ranges[-1][1] >= start:
                        start = min(start, ranges.pop()[0])
                    ranges.append((start, i + 1))
                else:
                    ranges.append((i + 1 - widest, i + 1))
        return ranges, items


def normal_words(text: str | None) -> list[str]:
    """Words of a text after lower-casing A-Z."""
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def _blocks(items: DataFrame, window: int) -> Iterator[tuple[Automaton, bool]]:
    """Automata of the blocks of items, each with whether it is the last."""
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    keyed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    for b in range(n):
        rows = keyed.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b).collect()
        yield Automaton([(r["item"], normal_words(r["text"])) for r in rows], window), b == n - 1


FOUND = T.StructType([T.StructField("hit_ranges", T.ArrayType(T.IntegerType(), False)), T.StructField("hit_items", T.ArrayType(T.StringType(), False)),
                      T.StructField("n_words", T.LongType())])


def match(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """Append hit_ranges (starts and ends of covered word ranges, flat), hit_items (sorted) and n_words.

    A window is ``window`` consecutive words of an item; a shorter item is one window. Whole documents stream through the
    automaton; only stretches of item words at least as long as the shortest window can hold one, and only these reach
    the Python loop. Nothing is shuffled. One automaton is sent to the tasks for each block of ``BLOCK_BYTES`` of items.
    Null texts have no words, a null item id counts as the empty one, items without words match nothing. Columns with
    the three names are replaced.
    """
    return _passes(docs, items, text, window)


def _passes(docs: DataFrame, items: DataFrame, text: str, window: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
            finished: T.StructType | None = None) -> DataFrame:
    """:func:`match`; the last pass hands its rows through ``finish`` (with schema ``finished``) in the same task, so that
    texts pass one Python process and not two."""
    base = docs.drop(*FOUND.names)
    columns, spark = base.columns, docs.sparkSession
    schema = T.StructType(list(base.schema.fields) + list(FOUND.fields))
    out = base
    for k, (automaton, last) in enumerate(_blocks(items, window)):
        sent, after = spark.sparkContext.broadcast(automaton), finish if last else None

        def run(batches: Iterator[pa.RecordBatch], sent=sent, later=bool(k), after=after) -> Iterator[pa.RecordBatch]:
            auto: Automaton = sent.value
            for batch in batches:
                for part in slices(batch, text):
                    ranges, items_, n = _match_batch(auto, texts(part, text))
                    if later:
                        ranges = [_merged(a, b) for a, b in zip(part["hit_ranges"].to_pylist(), ranges)]
                        items_ = [sorted({*a, *b}) for a, b in zip(part["hit_items"].to_pylist(), items_)]
                    found = pa.RecordBatch.from_arrays([part[c] for c in columns] + [pa.array(ranges, pa.list_(pa.int32())), pa.array(items_, pa.list_(pa.string())), pa.array(n)],
                                                       names=columns + FOUND.names)
                    yield after(found) if after else found

        out = (written(out, "decontaminate") if k else out).mapInArrow(run, finished if after else schema)
    return out


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _match_batch(auto: Automaton, strings: pa.Array) -> tuple[list, list, np.ndarray]:
    flat, count = words(strings, BYTES)
    ranges: list[list[int]] = [[] for _ in range(len(strings))]
    items: list = [[] for _ in range(len(strings))]
    if not len(flat) or not auto.shortest:
        return ranges, items, count
    coded = flat.dictionary_encode()
    known = np.array([auto.vocabulary.get(w, -1) for w in coded.dictionary.to_pylist()], np.int32)
    code = known[coded.indices.to_numpy()]
    upto = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    edge = np.flatnonzero(np.concatenate([[True], ((code[1:] < 0) != (code[:-1] < 0)) | (doc[1:] != doc[:-1])]))
    size = np.diff(np.append(edge, len(code)))
    for at, n in zip(edge[(code[edge] >= 0) & (size >= auto.shortest)].tolist(), size[(code[edge] >= 0) & (size >= auto.shortest)].tolist()):
        found, which = auto.match(code[at:at + n].tolist())
        if found:
            d = int(doc[at])
            shift = at - int(upto[d])
            for a, b in found:
                ranges[d] += [a + shift, b + shift]
            items[d] = sorted({*items[d], *which})
    return ranges, items, count


def report(matched: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    hits = F.aggregate("hit_ranges", F.lit(0).cast("bigint"), lambda a, x: x - a)  # ends less starts, as the signs alternate
    return matched.select("doc_id", "n_words", hits.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
                          F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"))


def without_spans(text: str, ranges: list[int], lower=re.compile("[A-Z]+")) -> str:
    """The text without the words of the ranges and what stands between them."""
    spans = [m.span() for m in WORD.finditer(lower.sub(lambda m: m[0].lower(), text))]
    out, at = [], 0
    for a, b in zip(ranges[::2], ranges[1::2]):
        out.append(text[at:spans[a][0]])
        at = spans[b - 1][1]
    return "".join(out) + text[at:]


def cleaned(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, max_coverage: float = 0.8) -> DataFrame:
    """Documents without the spans that match; those whose matches cover more than ``max_coverage`` of their words go.

    Clean documents stay as they are. n_chars, where there is one, follows the text.
    """
    schema = docs.schema

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = pc.greater(pc.list_value_length(batch["hit_ranges"]), 0).to_numpy(zero_copy_only=False)
        new, stay = batch[text].to_pylist() if hit.any() else None, np.ones(len(hit), bool)
        for i in np.flatnonzero(hit):
            ranges = batch["hit_ranges"][i].as_py()
            stay[i] = sum(ranges[1::2]) - sum(ranges[::2]) <= max_coverage * batch["n_words"][i].as_py()
            new[i] = without_spans(new[i], ranges)
        arrays = []
        for field in schema:
            column = batch[field.name]
            if new is not None and field.name == text:
                column = pa.array(new, column.type)
            if new is not None and field.name == "n_chars":
                own = column.to_pylist()
                column = pa.array([len(new[i]) if hit[i] else own[i] for i in range(len(own))], column.type)
            arrays.append(column)
        return pa.RecordBatch.from_arrays(arrays, names=schema.names).filter(pa.array(stay))

    return _passes(docs, items, text, window, clean, schema)
