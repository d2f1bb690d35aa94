"""Secret scan with corpus-wide ownership frequency. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .expressions import let, running_sums
from .storage import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group of the value, least length of that group). Runs of one class are the same with and without the
#: bound inside the pattern; an assignment is matched first and then dropped if its value is short.
KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24),
         ("live", r"[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20))
#: Texts that stand for a secret in examples.
STAND_IN = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234|abcd"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches with their place in code points: what stands between two matches comes from a split at the same pattern."""
    regex = F.lit(pattern)

    def placed(whole: Column) -> Column:
        before = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("bigint"))
        sizes = F.transform(whole, lambda m: F.char_length(m).cast("bigint"))
        steps = let(sizes, lambda s: F.transform(F.slice(before, 1, F.size(s)), lambda b, i: b + F.coalesce(F.get(s, i - 1), F.lit(0))))
        values = F.regexp_extract_all(text, regex, F.lit(group)) if group else whole
        return let(running_sums(steps), lambda starts: let(values, lambda v: F.transform(starts, lambda s, i: F.struct(
            s.alias("start"), F.lit(rank).alias("rank"), (s + F.char_length(F.get(whole, i))).alias("end"), F.lit(kind).alias("kind"), F.get(v, i).alias("value")))))

    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>")
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m).cast(none_type())))
    return F.filter(found, lambda x: F.char_length(x["value"]) >= least)


def none_type() -> str:
    return "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def live_looking(value: Column) -> Column:
    """Letters and digits mixed, eight different characters at least, and no word that marks an example."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= 8) & ~value.rlike(STAND_IN)


def candidates(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document: base spans, and opaque tokens that look live and lie in none of them. Where the owner is null,
    the repository stands for it."""
    source = F.coalesce(F.col(text), F.lit(""))
    each = [_spans(F.col("t"), i, *k) for i, k in enumerate(KINDS)]
    base = F.array_sort(F.concat(*each[:3]))
    loose = let(base, lambda b: F.struct(b.alias("base"), F.filter(each[3], lambda x: live_looking(x["value"]) & ~F.exists(
        b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))).alias("loose")))
    rows = docs.select(F.col(repository).alias("repository"), F.coalesce(F.col(owner).cast("string"), F.concat(F.lit("\u0001"), F.col(repository).cast("string")), F.lit("")).alias("owner"), source.alias("t"))
    return rows.select("repository", "owner", loose.alias("s")).select("repository", "owner", "s.base", "s.loose", F.monotonically_increasing_id().alias("row"))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash over the whole corpus: distinct owners, and distinct repositories summed over them.

    Pre-aggregated in every task at each step, so a secret in a third of all documents is a few rows a task.
    """
    values = found.select("repository", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "loose"), lambda x: F.sha2(x["value"].cast("binary"), 256)))).alias("hash"))
    by_repository = values.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", widely: int = 3) -> DataFrame:
    """Secrets of every document, and which of them belong to one owner.

    Candidates are the base kinds and opaque tokens. A value with ``widely`` or more owners is a copied example; one with
    fewer that looks live is owner-specific. Returns repository, owner (for a null one \\u0001 and the repository), base (spans of the base kinds, all of them), live
    (opaque tokens that are owner-specific, added), n_copied and n_owned (base spans of either sort), in one row per row
    of the input, and repositories, the number of those with the value of each of the base and live spans, in the order of
    the spans: a sample that one owner has everywhere shows there. Null texts are empty; a repeated row counts as one repository.
    """
    found = written(candidates(docs, text, repository, owner), "secrets")
    each = found.select("row", F.explode(F.concat("base", "loose")).alias("x")).withColumn("hash", F.sha2(F.col("x.value").cast("binary"), 256))
    judged = each.join(ownership(found), "hash").select("row", "x", "repositories", (F.col("owners") >= widely).alias("copied"), live_looking(F.col("x.value")).alias("looks"))
    is_base = F.col("x.rank") < 3
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(~is_base & ~F.col("copied"), F.col("x"))).alias("live"),
        F.collect_list(F.when(is_base | ~F.col("copied"), F.struct("x", "repositories"))).alias("spread"),
        F.sum((is_base & F.col("copied")).cast("bigint")).alias("n_copied"),
        F.sum((is_base & ~F.col("copied") & F.col("looks")).cast("bigint")).alias("n_owned"))
    zero = F.lit(0).cast("bigint")
    return found.join(per_row, "row", "left").select(
        "repository", "owner", "base", F.coalesce("live", F.array().cast(none_type())).alias("live"),
        F.coalesce("n_copied", zero).alias("n_copied"), F.coalesce("n_owned", zero).alias("n_owned"),
        F.coalesce(F.transform(F.array_sort("spread"), lambda s: s["repositories"]), F.array().cast("array<bigint>")).alias("repositories"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests per document."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("bigint")

    return scanned.select(F.col("repository").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                          F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                          joined(F.array_sort(F.concat("base", "live"))).alias("spans"), "n_copied", "n_owned", F.array_join("repositories", ",").alias("repositories"))
