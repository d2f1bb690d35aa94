"""Recipe merges and migration counts against a sequential replay."""
import itertools
import json
import random

from crestline.operators import catalog as C

SCHEMA = "recipe_id string, run_id string, kind string, hero_moment_id string, manifest string, seed long, pipeline_ver string"


def replay(old, candidates):
    """One candidate after another, in the given order."""
    state = {r[0]: list(r[1:]) for r in old}
    for rid, run, kind, hero, manifest, seed, ver in candidates:
        if not rid:
            continue
        had = state.get(rid)
        kind = kind or (had and had[1])
        if kind not in C.RECIPE_KINDS:
            continue
        merged = {**_object(had and had[3]), **_object(manifest)}
        keep = lambda new, i: new if new is not None or not had else had[i]
        state[rid] = [run, kind, keep(hero, 2), json.dumps(merged), keep(seed, 4), keep(ver, 5)]
    return state


def _object(text):
    try:
        value = json.loads(text or "{}")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def shown(recipe):
    return [*recipe[:3], _object(recipe[3]), *recipe[4:]]


def merged(spark, old, candidates):
    rows = [(*c, i // 3, i % 3) for i, c in enumerate(candidates)]
    got = C.merge_recipes(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(rows, SCHEMA + ", run int, place int"), ["run", "place"])
    rows = got.collect()
    assert len(rows) == len({r.recipe_id for r in rows})
    return {r[0]: shown(list(r[1:])) for r in rows}


def test_random_runs(spark):
    draw = random.Random(5)
    texts = [None, "", "no json", "[1]", "{}", '{"a": 1}', '{"a": "1", "b": null}', '{"b": {"c": [1, 2.5]}, "d": "x\\"y"}', '{"a": true, "d": null}']
    row = lambda rid: (rid, draw.choice(["r1", "r2"]), draw.choice([None, "", "loop", "chop", "stem", "other"]), draw.choice([None, "h1", "h2"]),
                       draw.choice(texts), draw.choice([None, 1, 2]), draw.choice([None, "v1", "v2"]))
    old = [(*row(f"i{i}")[:2], draw.choice([None, "loop", "stem"]), *row("")[3:]) for i in range(20)]
    candidates = [row(draw.choice([None, ""] + [f"i{i}" for i in range(60)])) for _ in range(400)]
    assert merged(spark, old, candidates) == {k: shown(v) for k, v in replay(old, candidates).items()}


def test_empty_tables_and_more_columns(spark):
    assert merged(spark, [], []) == {}
    old = spark.createDataFrame([("a", "r", "loop", None, "{}", 1, "v", "extra")], SCHEMA + ", note string")
    none = spark.createDataFrame([], SCHEMA + ", place int")
    assert [tuple(r) for r in C.merge_recipes(old, none, ["place"]).collect()] == [("a", "r", "loop", None, "{}", 1, "v", "extra")]


def test_migration_counts(spark):
    frame = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    got = C.migration_counts({"a": (frame("x", "x", None), frame("x", "y", "y", None, "z"), "k"), "b": (frame(), frame(), "k")})
    assert sorted(map(tuple, got.collect())) == [("a", 2, 1, 1, 1), ("b", 0, 0, 0, 0)]
