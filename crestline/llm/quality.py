"""Line-first cleaning: rules per line, then a verdict on how much text they cost the document. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .expressions import let, word_list

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Phrases of notices that a line of a few words consists of.
NOTICES = (r"(?i)\b(all rights reserved|licensed under|released under the|copyright|cookie|javascript|privacy policy|terms of (use|service)|"
           r"sign (in|up)|log in|subscribe|read more|click here|lorem ipsum)\b")


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that the list holds twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash of their words' hashes. Sorting (hash, position) finds repeats; the sorted
    positions of these then tell how many words they cover. n log n in the number of words.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        again = let(ranked, lambda r: F.filter(r, lambda x, i: F.coalesce(F.get(r, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(r, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.array_sort(F.transform(again, lambda x: x["at"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                                                 F.lit(0).cast("bigint"), lambda a, x: a + x))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    repeats = let(hashed, lambda h: let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w))))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("bigint")).otherwise(repeats)


def line_fails(line: Column, n_words: Column) -> Column:
    """Whether a line is removed.

    Punctuation: more than ten words without a single sentence end, or a doubled mark on more than a third of its words.
    Symbols: markup-like symbols on more than a third of its words. Navigation: three or more bars or arrows between
    entries, at least one for each four words. Boilerplate: at most 20 words with a phrase of a notice.
    """
    unended = (n_words > 10) & ~line.rlike(r"[.!?…。！？]")
    shouted = F.regexp_count(line, F.lit(r"[!?]{2,}")) * 3 > n_words
    symbols = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D#*$%&<>|][#*$%&<>|]+")) * 3 > n_words
    bars = F.regexp_count(line, F.lit(r"[|»›→•·]"))
    navigation = (bars >= 3) & (bars * 4 >= n_words)
    notice = (n_words <= 20) & line.rlike(NOTICES)
    return unended | shouted | symbols | navigation | notice


def clean(docs: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Append struct ``quality``: base counts, base_failed, kept, the cleaned text and the share of text it lost.

    Lines without a word stay and count for nothing. A document that loses more than ``max_lost`` of the code points in
    its words is rejected. Null and empty texts have no words and fail the base. Rows are judged one by one, so repeated
    rows and other columns do not matter (a column called quality is replaced). Nothing is shuffled.
    """
    bigint = lambda c: c.cast("bigint")

    def lines_of(source: Column) -> Column:
        return F.transform(F.split(source, "\n", -1), lambda x: let(word_list(x), lambda w: F.struct(
            x.alias("line"), F.size(w).alias("n"), bigint(F.char_length(F.array_join(w, ""))).alias("chars"))))

    def judged(rows: Column) -> Column:
        return F.transform(rows, lambda r: F.struct(r["line"].alias("line"), r["n"].alias("n"), r["chars"].alias("chars"), ((r["n"] > 0) & line_fails(r["line"], r["n"])).alias("fails")))

    def summed(rows: Column, field: str) -> Column:
        return F.aggregate(rows, bigint(F.lit(0)), lambda a, r: a + r[field])

    def of(source: Column, words: Column, rows: Column) -> Column:
        full = F.transform(F.filter(rows, lambda r: r["n"] > 0), lambda r: r["line"])
        return F.struct(
            bigint(F.size(words)).alias("n_words"), summed(rows, "chars").alias("word_chars"),
            bigint(F.char_length(source) - F.char_length(F.translate(source, SYMBOLS, ""))).alias("n_symbols"),
            let(full, lambda f: bigint(F.size(f) - F.size(F.array_distinct(f)))).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"), summed(F.filter(rows, lambda r: r["fails"]), "chars").alias("lost_chars"),
            F.array_join(F.transform(F.filter(rows, lambda r: ~r["fails"]), lambda r: r["line"]), "\n").alias("cleaned"))

    measured = let(F.coalesce(F.col(text), F.lit("")), lambda t: let(word_list(t), lambda w: let(judged(lines_of(t)), lambda rows: of(t, w, rows))))

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "cleaned"]
        return F.struct(*[m[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & (m["lost_chars"] <= max_lost * m["word_chars"])).alias("kept"))

    return docs.withColumn("quality", let(measured, verdict))


def kept_documents(docs: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Documents that stay, with the text of their remaining lines; other columns as they are (n_chars follows the text)."""
    columns = []
    for c in docs.columns:
        new = F.col("q.cleaned") if c == text else F.char_length("q.cleaned").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"`{c}`")
        columns.append(new.alias(c))
    once = clean(docs, text, max_lost)
    # a generator keeps the struct from being computed twice, in the filter and in the projection
    held = once.select("*", F.explode(F.filter(F.array("quality"), lambda q: q["kept"])).alias("q"))
    return held.select(columns)
