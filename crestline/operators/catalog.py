"""Incremental ingest, filters, upserts and lifecycle of catalog tables.

An upsert takes the old and the new table and returns the merged one; the caller writes it to a
new snapshot. Both sides are unique on the key (``latest_by`` makes them so with map-side combine),
hence no merge join has a hot key.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import newest_per, top_per

# Domains.
RIGHTS_STATES = ("allowed", "private_only", "needs_review", "blocked")
RECIPE_KINDS = ("loop", "chop", "stem")
JOB_STATES = (
    "discovered", "rights_checked", "fetched", "ingested", "analyzed",
    "moments_ready", "selected", "recipes_ready", "generated", "reviewed",
    "kept", "rejected", "exported",
)

# Columns a repeated ingest leaves as they are.
DOWNSTREAM = ("fingerprint", "bpm", "bpm_conf", "key_note", "key_conf", "status", "stems_ready", "analyzed_at")


# --- domains -----------------------------------------------------------------------------

def domain_report(df: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows per column and value, with ``valid``: whether the value is in the column's domain. Null never is."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                                         F.coalesce(F.col(c).isin(*d), F.lit(False)).alias("valid")) for c, d in domains.items()]))
    return df.select(pairs.alias("_p")).select("_p.*").groupBy("column", "value", "valid").agg(F.count(F.lit(1)).alias("n"))


def in_domains(df: DataFrame, domains: dict[str, tuple[str, ...]], strict: bool = False) -> DataFrame:
    """Rows whose columns are all inside their domains. ``strict`` ends the job at the first other row instead, naming
    column and value; the check is part of the checked column, so it happens wherever that is read or written."""
    if not strict:
        return df.where(reduce(Column.__and__, [F.coalesce(F.col(c).isin(*d), F.lit(False)) for c, d in domains.items()], F.lit(True)))
    wrong = lambda c: F.raise_error(F.concat(F.lit(f"{c} outside its domain: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    checked = {c: F.when(F.col(c).isin(*d), F.col(c)).otherwise(wrong(c)) for c, d in domains.items()}
    return df.withColumns(checked)


# --- incremental ingest ------------------------------------------------------------------

def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return new.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*new.columns)


def incremental(new: DataFrame, known: DataFrame, key: str, order: list[str], force: bool = False) -> DataFrame:
    """First row, by ``order``, of every digest that is not known; ``force`` ignores the known
    ones. Duplicates go first, in an aggregate with map-side combine, so the anti join sees each
    digest once."""
    rest = [c for c in new.columns if c != key]
    firsts = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    firsts = firsts.select(key, "_row.*").select(*new.columns)
    return firsts if force else unseen(firsts, known, key)


def ingest_report(new: DataFrame, known: DataFrame, key: str, error: str | None = None, force: bool = False) -> DataFrame:
    """What becomes of the rows of a scan, as one row of counts: ``scanned``, ``added`` (what :func:`incremental` returns),
    ``skipped_known``, ``skipped_repeated`` (later rows of an added or known digest) and ``failed``.

    A row with an error, or without a digest, has failed; all are 0 for an empty scan. Rows are counted per digest before
    they meet the known ones, so a digest that most rows share is one row in the join.
    """
    bad = F.col(key).isNull() if error is None else F.col(key).isNull() | F.col(error).isNotNull()
    counts = new.groupBy(F.when(~bad, F.col(key)).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))  # failed rows are the null group
    seen = known.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct().withColumn("_known", F.lit(True))
    good = F.col("_key").isNotNull()
    fresh = good if force else good & F.col("_known").isNull()
    total = lambda value: F.coalesce(F.sum(value.cast("long")), F.lit(0).cast("long"))
    return counts.join(seen, "_key", "left").agg(
        total(F.col("_n")).alias("scanned"), total(fresh).alias("added"), total(good & ~fresh).alias("skipped_known"),
        total(F.when(good, F.col("_n") - 1)).alias("skipped_repeated"), total(F.when(~good, F.col("_n"))).alias("failed"))


def admit(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows and whether there were more."""
    some = df.orderBy(*order).limit(limit + 1)
    from pyspark.sql import Window
    numbered = some.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    more = F.max("_at").over(Window.partitionBy()) > limit
    return numbered.withColumn("truncated", more).where(F.col("_at") <= limit).drop("_at")


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reason``: the name of the first rule that rejects the row, NULL for a good row."""
    reason = reduce(lambda a, item: a.when(item[1], item[0]), rules.items(), F.when(F.lit(False), ""))
    return df.withColumn("reason", reason)


def outcomes(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


# --- filters -----------------------------------------------------------------------------

def where_given(df: DataFrame, equals: dict | None = None, present: dict[str, bool | None] | None = None) -> DataFrame:
    """Conjunction of the given conditions; a condition that is None does not filter."""
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, wanted in (present or {}).items():
        if wanted is not None:
            df = df.where(F.col(name).isNotNull() if wanted else F.col(name).isNull())
    return df


def quality_pool(assets: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    return assets.join(scores.where("passed"), key)


def admitted(assets: DataFrame, rights: DataFrame, key: str, private: bool = False) -> DataFrame:
    """Assets that may be used: allowed ones, and for the private pool all but blocked ones.
    An asset without a decision needs review."""
    states = assets.join(rights.select(key, F.col("state").alias("rights_state")), key, "left").withColumn(
        "rights_state", F.coalesce("rights_state", F.lit("needs_review")))
    allowed = ("allowed", "private_only", "needs_review") if private else ("allowed",)
    return states.where(F.col("rights_state").isin(*allowed))


def missing_ids(requested: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(table.select(key).distinct(), key, "left_anti")


# --- upserts -----------------------------------------------------------------------------

def latest_by(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    return newest_per(df, keys, version)


def _sides(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    o = old.select(F.col(key), F.struct(*[c for c in old.columns if c != key]).alias("o"), F.lit(True).alias("_old"))
    n = new.select(F.col(key), F.struct(*[c for c in new.columns if c != key]).alias("n"), F.lit(True).alias("_new"))
    return o.join(n, key, "full")


def merge_fields(old: DataFrame, new: DataFrame, key: str, protected: list[str] = (),
                 protect_when: Column | None = None, keep_known: list[str] = ()) -> DataFrame:
    """Field-level upsert.

    Columns of ``new`` replace those of ``old`` where a new row exists. ``protected`` columns of an
    existing row stay when ``protect_when`` (over ``o`` and ``n``) holds; ``keep_known`` columns stay
    when the new value is NULL. Columns that only ``new`` has are added.
    """
    both = _sides(old, new, key)
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    protect = F.lit(True) if protect_when is None else F.coalesce(protect_when, F.lit(False))
    out = [F.col(key)]
    for name in old.columns:
        if name == key:
            continue
        before = F.col(f"o.{name}")
        if name not in new.columns:
            out.append(before.alias(name))
            continue
        after = F.col(f"n.{name}")
        value = F.coalesce(after, before) if name in keep_known else after
        if name in protected:
            value = F.when(has_old & protect, before).otherwise(value)
        out.append(F.when(has_new, value).otherwise(before).alias(name))
    return both.select(*out, *[F.col(f"n.{c}").alias(c) for c in new.columns if c not in old.columns])


def merge_rights(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A new 'needs review, unknown license' never replaces an existing decision."""
    weak = (F.col("n.state") == "needs_review") & (F.col("n.basis") == "unknown_license")
    return merge_fields(old, new, key, [c for c in old.columns if c != key], weak)


def merge_jobs(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A repeated ingest keeps the state reached; attempts grow by the new retries; all other columns are carried, the
    new row's replace the old row's."""
    both = _sides(old, new, key)
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    again = has_old & (F.col("n.type") == "asset") & (F.col("n.state") == "ingested")
    state = F.when(~has_new | again, F.col("o.state")).otherwise(F.coalesce("n.state", F.lit("discovered")))
    attempts = F.coalesce(F.col("o.attempts"), F.lit(0)) + F.coalesce(F.col("n.retries"), F.lit(0))
    rest = []
    for name in dict.fromkeys([*old.columns, *new.columns]):
        if name in (key, "type", "state", "attempts", "retries"):
            continue
        before = F.col(f"o.{name}") if name in old.columns else F.lit(None)
        after = F.col(f"n.{name}") if name in new.columns else before
        rest.append(F.when(has_new, after).otherwise(before).alias(name))
    return both.select(key, F.when(has_new, F.col("n.type")).otherwise(F.col("o.type")).alias("type"),
                       state.alias("state"), attempts.alias("attempts"), *rest)


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename alias columns to the names the table uses, unless those are given themselves."""
    for given, name in aliases.items():
        if given in df.columns and name not in df.columns:
            df = df.withColumnRenamed(given, name)
    return df


def candidate_rows(runs: DataFrame, key: str, candidates: str, kinds=RECIPE_KINDS) -> DataFrame:
    """One recipe row per candidate of a run that has a recipe id and a known kind."""
    each = runs.select(key, "hero_moment_id", F.explode(candidates).alias("c"))
    valid = F.col("c.recipe_id").isNotNull() & F.col("c.kind").isin(*kinds)
    return each.where(valid).select(
        F.col("c.recipe_id").alias("recipe_id"), F.col(key).alias("run_id"), F.col("c.kind").alias("kind"),
        "hero_moment_id", F.col("c.seed").alias("seed"))


def candidate_ids(candidates: Column) -> Column:
    """Ids of the candidates: the first of candidate_id, beat_id, id, recipe_id that is set."""
    return F.array_compact(F.transform(candidates, lambda c: F.coalesce(
        c["candidate_id"], c["beat_id"], c["id"], c["recipe_id"])))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows plus one new row for each key that is absent, the least by its JSON text; running it again changes
    nothing. New rows without a key are not inserted, since nothing tells them from those of the run before."""
    row = F.struct(*old.columns)
    single = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return old.unionByName(single.join(old.select(key), key, "left_anti").select(*old.columns))


def merge_recipes(old: DataFrame, candidates: DataFrame, order: list[str], kinds=RECIPE_KINDS) -> DataFrame:
    """Recipes after the candidates of all runs, taken one after another by ``order``.

    ``old`` has recipe_id (unique), run_id, kind, hero_moment_id, manifest (JSON text), seed, pipeline_ver and may have more
    columns, which stay; ``candidates`` the same seven, with what the run itself says already filled in, and ``order``. A
    candidate without an id or with an unknown kind is skipped; without a kind it takes that of its recipe and is skipped where
    there is none yet. The last run owns the recipe; kind, hero, seed and version stay where nothing newer is given; manifests
    are merged by entry and the later value wins, also a null. A manifest that is no JSON object counts as empty.

    Every part is an aggregate with map-side combine over old and new rows together, so a recipe of very many candidates is no
    hot key; only the entries of one manifest come together.
    """
    fields = ["run_id", "kind", "hero_moment_id", "seed", "pipeline_ver"]
    at = F.struct(F.lit(1).alias("_new"), *order)
    given = candidates.withColumn("kind", F.nullif("kind", F.lit(""))).where(F.length(F.col("recipe_id").cast("string")) > 0)
    given = given.where(F.col("kind").isNull() | F.col("kind").isin(*kinds)).select("recipe_id", *fields, "manifest", at.alias("_at"))
    before = F.struct(F.lit(0).alias("_new"), *[F.lit(None).cast(candidates.schema[c].dataType).alias(c) for c in order])
    kept = old.select("recipe_id", *fields, "manifest", before.alias("_at"))
    known = kept.unionByName(given).where(F.col("kind").isNotNull()).groupBy("recipe_id").agg(F.min("_at").alias("_from"))
    usable = given.join(known, "recipe_id").where(F.col("_at") >= F.col("_from")).drop("_from")
    rows = kept.unionByName(usable)

    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
    merged = rows.groupBy("recipe_id").agg(F.max_by("run_id", "_at").alias("run_id"), *[newest(c) for c in fields[1:]])
    entries = rows.select("recipe_id", "_at", F.explode(F.try_variant_get(
        F.try_parse_json("manifest"), "$", "map<string,variant>")).alias("_entry", "_value"))
    entries = entries.select("recipe_id", "_at", "_entry", F.coalesce(F.to_json("_value"), F.lit("null")).alias("_value"))
    entries = entries.groupBy("recipe_id", "_entry").agg(F.max_by("_value", "_at").alias("_value"))
    objects = entries.groupBy("recipe_id").agg(F.map_from_entries(F.collect_list(F.struct("_entry", "_value"))).alias("_map"))
    text = F.to_json(F.to_variant_object(F.transform_values("_map", lambda _, v: F.parse_json(v))))
    out = merged.join(objects.select("recipe_id", text.alias("manifest")), "recipe_id", "left")
    out = out.withColumn("manifest", F.coalesce("manifest", F.lit("{}")))
    more = [c for c in old.columns if c not in ("recipe_id", "manifest", *fields)]
    if more:
        out = out.join(old.select("recipe_id", *more), "recipe_id", "left")
    return out.select("recipe_id", "run_id", "kind", "hero_moment_id", "manifest", "seed", "pipeline_ver", *more)


def migration_counts(targets: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """What ``insert_absent`` does per target table (old rows, new rows, key): new rows inserted, present already, repeated
    within the new rows, and without a key, which are not inserted. A target without new rows has zeros."""
    def counted(name: str, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
        keys = new.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        there = old.select(F.col(key).alias("_key"), F.lit(True).alias("_old")).distinct()
        absent = F.col("_old").isNull() & F.col("_key").isNotNull()
        total = lambda cond, n, name: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long").alias(name)
        return keys.join(there, "_key", "left").agg(
            total(absent, F.lit(1), "inserted"), total(F.col("_old"), F.col("_n"), "present"),
            total(absent, F.col("_n") - 1, "repeated"), total(F.col("_key").isNull(), F.col("_n"), "without_key"),
        ).select(F.lit(name).alias("target"), "inserted", "present", "repeated", "without_key")
    return reduce(DataFrame.unionByName, [counted(name, *target) for name, target in targets.items()])


def set_field(old: DataFrame, changes: DataFrame, key: str, name: str, defaults: dict, longest: int = 40) -> DataFrame:
    """Set one field from valid changes, keep the rest; unknown keys get a row of defaults."""
    value = F.trim(F.col(name))
    valid = changes.where((F.length(value) > 0) & (F.length(value) <= longest)).select(key, value.alias("_value"))
    both = old.withColumn("_old", F.lit(True)).join(valid, key, "full")
    out = []
    for c in old.columns:
        if c == key:
            out.append(F.col(key))
        elif c == name:
            out.append(F.coalesce("_value", F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old").isNull(), F.lit(defaults.get(c))).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def state_ordinal(state: Column) -> Column:
    """Position of a state in the lifecycle, NULL outside of the domain."""
    pairs = [x for i, s in enumerate(JOB_STATES) for x in (F.lit(s), F.lit(i))]
    return F.create_map(*pairs)[state]


def registry(old: DataFrame, crawl: DataFrame, key: str) -> DataFrame:
    """Source registry after a crawl: state and error replaced, the cursor kept when not given."""
    return merge_fields(old, crawl, key, keep_known=["last_cursor"])
