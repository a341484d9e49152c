"""Sampling, profiling, anonymisation, reduction, reports, files and the command line."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera as ts
from tessera import cli
from tessera.operators.anonymize import numbered
from tessera.operators.profile import medians
from tessera.functions.kinds import kind_of
from tessera.functions.textbars import number
from tessera.operators import anonymize as an
from tessera.operators.names import NameLibrary
from tessera.operators.profile import ColumnStats, profile


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    rows = [(i, f"Person {i}", rng.choices(["North", "South", "East", "West"], [50, 30, 15, 5])[0], rng.choices(["gold", "silver", None], [2, 3, 5])[0], round(rng.gauss(70, 15), 1), rng.random() < 0.5, "note " * 40) for i in range(1000)]
    return spark.createDataFrame(rows, "id long, name string, region string, tier string, score double, active boolean, notes string")


def test_exact_size_share_and_reproducibility(people):
    a, alloc = ts.stratified_sample(people, 137, ["region", "tier"], seed=3, key=["id"])
    ids = {r.id for r in a.collect()}
    assert len(ids) == 137
    for r in alloc.collect():
        assert abs(r.alloc - r["size"] * 137 / 1000) < 1
    again = ts.stratified_sample(people.repartition(7), 137, ["region", "tier"], seed=3, key=["id"])[0]
    narrow = ts.stratified_sample(people.repartition(3), 137, ["region", "tier"], seed=3, key=["id"], narrow=True)[0]
    assert {r.id for r in again.collect()} == {r.id for r in narrow.collect()} == ids
    assert {r.id for r in ts.stratified_sample(people, 137, ["region", "tier"], seed=1003, key=["id"])[0].collect()} != ids
    assert a.columns == people.columns


def test_null_stratum_is_sampled(people):
    got = ts.stratified_sample(people, 200, ["tier"], seed=1, key=["id"])[0]
    share = people.where("tier is null").count() / 5
    assert abs(got.where("tier is null").count() - share) <= 1


def test_random_sample_without_key_and_bounds(people):
    assert ts.random_sample(people, 10, seed=5).count() == 10
    assert {r.id for r in ts.random_sample(people, 50, seed=5).collect()} == {r.id for r in ts.random_sample(people.repartition(5), 50, seed=5).collect()}
    assert ts.sample(people, 0, seed=1).data.count() == 0
    assert ts.sample(people, 5000).method == "all"
    with pytest.raises(ValueError):
        ts.sample(people, -1)
    with pytest.raises(ValueError):
        ts.sample(people, 5, exclude=("nope",))


def test_auto_strata(people, spark):
    found = ts.find_stratification_columns(people, 100)
    assert [c for c, _ in found] == ["tier", "active", "region"]
    r = ts.sample(people, 100, seed=2, exclude=("active",))
    assert r.method == "stratified" and r.strat_cols == ["tier", "region"] and r.data.count() == 100
    prices = spark.createDataFrame([(9.99 + 10 * (i % 4), float(1 + i % 4)) for i in range(400)], "price double, rating double")
    assert [c for c, _ in ts.find_stratification_columns(prices, 100)] == ["rating"]
    few = ts.sample(people.select("id", "notes"), 10, seed=1)
    assert few.method == "random" and "No column" in few.notes[-1]


def test_hostile_and_reserved_names(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(300)], 'x long, v long').toDF("my `col`.\"; DROP TABLE x;--", "__h")
    r = ts.sample(df, 31, seed=1, key=["__h"])
    assert r.data.count() == 31 and r.data.columns == df.columns
    assert {s.name for s in ts.profile(df)} == set(df.columns)
    assert ts.anonymize(df, {df.columns[0]: "hex"}, 1).columns == df.columns


def test_profile_values(spark):
    rows = [(1.0, "a", None), (2.0, "a", True), (3.0, "b", False), (float("inf"), None, None), (float("nan"), "c", True), (None, "b", True)]
    x, y, z = ts.profile(spark.createDataFrame(rows, "x double, y string, z boolean"))
    assert (x.kind, x.count, x.missing, x.min, x.max, x.mean, x.median) == ("numeric", 5, 1, 1.0, 3.0, 2.0, 2.0)
    assert sum(x.histogram) == 3 and math.isclose(x.std, 1.0)
    assert (y.kind, y.unique, y.mode, y.top_values[:2]) == ("categorical", 3, "a", [("a", 2), ("b", 2)])
    assert (z.kind, z.count, z.unique) == ("boolean", 4, 2)
    assert [s.histogram for s in ts.profile(spark.createDataFrame([(7,)] * 4, "k int"))] == [[0, 0, 0, 0, 0, 4, 0, 0, 0, 0]]
    empty = ts.profile(spark.createDataFrame([], "a double, b string"))
    assert [s.count for s in empty] == [0, 0] and empty[0].min is None
    with pytest.raises(ValueError):
        ts.profile(spark.range(3), ["nope"])


def test_profile_nested_and_text(people, spark):
    df = spark.createDataFrame([([1], "x" * 60), ([], "x" * 60), ([1], "y" * 51)], "l array<int>, t string")
    one, two = ts.profile(df)
    assert (one.kind, one.unique, two.kind, two.stratifiable) == ("other", 2, "text", False)
    t = {s.name: s for s in profile(people, approximate=True, distributions=False)}
    assert t["notes"].kind == "text" and 3 <= t["region"].unique <= 5 and t["region"].approximate and t["score"].fractional


def test_sequential_id(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["C1", "C2", "C1", "C3", "C4", None])], "i int, c string")
    get = lambda **o: [r.c for r in ts.anonymize(df, {"c": ("sequential_id", o)}, 1, ["i"]).orderBy("i").collect()]
    assert get(start=1000, interval=7) == [1000, 1007, 1000, 1014, 1021, None]
    assert get(prefix="A", width=3)[:2] == ["A001", "A002"] and get(start=-5, width=4)[0] == "-005"
    with pytest.raises(ValueError):
        an.SequentialId(interval=0)


def test_jitter(spark, people):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 4, 5, 0, 100]] + [(None,)], "x double")
    got = ts.anonymize(df.withColumn("y", F.col("x")), {"x": "numeric_jitter"}, 4).collect()
    assert all(r.x is None if r.y is None else abs(r.x - r.y) <= 0.2 * r.y + 0.5 and isinstance(r.x, int) for r in got)
    assert len({(r.x, r.y) for r in got if r.y == 2}) == 1
    moved = ts.anonymize(people.withColumn("old", F.col("score")), {"score": ("jitter", {"pct": 0.1, "round_to": 1})}, 4)
    assert moved.where("abs(score - old) > abs(old) * 0.1 + 0.051").count() == 0
    for wrong in ("name", "active"):
        with pytest.raises(TypeError):
            ts.anonymize(people, {wrong: "numeric_jitter"}, 1)
    with pytest.raises(ValueError):
        an.NumericJitter(pct=1.5)


def test_datetime_jitter(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-02-01 10:00:00",), ("2024-01-05",), (None,)], "s string").withColumn("d", F.to_date("s"))
    got = ts.anonymize(df.withColumn("old", F.col("d")), {"s": ("datetime_jitter", {"max_delta": "2D"}), "d": ("dates", {"max_delta": "3D", "unit": "D"})}, 6).collect()
    assert got[0].s == got[2].s and got[3].s is None and abs((got[0].d - got[0].old).days) <= 3
    with pytest.raises(TypeError):
        ts.anonymize(spark.createDataFrame([("soon",)], "s string"), {"s": "datetime_jitter"}, 1)
    assert an.seconds("1D 6h") == 108000 and an.DatetimeJitter("12h", "m").span == 720
    with pytest.raises(ValueError):
        an.DatetimeJitter("1s", "D")


def test_relabelling_is_injective(spark):
    digits = ts.anonymize(spark.createDataFrame([(str(i),) for i in range(15)], "v string"), {"v": ("random_string", {"length": 1, "charset": "digits"})}, 1)
    assert digits.distinct().count() == 15
    many = ts.anonymize(spark.range(30000).select(F.col("id").cast("string").alias("v")), {"v": "names"}, 9)
    assert many.distinct().count() == 30000
    one = ts.anonymize(spark.range(200).select(F.col("id").alias("v")), {"v": ("names", {"style": "first", "gender": "female", "ethnicity": "italian"})}, 9)
    assert one.distinct().count() == 200
    two = ts.anonymize(spark.createDataFrame([("a",), ("b",), ("a",)], "v string").withColumn("w", F.col("v")), {"v": "hex", "w": "hex"}, 9).collect()
    assert two[0].v == two[2].v != two[1].v and two[0].v != two[0].w


def test_linked_names(spark):
    df = spark.createDataFrame([(1, "Ann", None, "Chinese"), (2, "Ann", "F", "Chinese"), (3, "Bo", "m", "Italian"), (4, None, "m", "x")], "i int, name string, sex string, origin string")
    out = ts.anonymize(df, {"name": ("names", {"gender_column": "sex", "ethnicity_column": "origin"}), "sex": "hex"}, 3, ["i"]).orderBy("i").collect()
    lib = ts.library()
    assert out[0].name == out[1].name and out[3].name is None
    assert any(out[0].name.startswith(f) for f in lib.first_names("female", "chinese")) and any(out[2].name.startswith(f) for f in lib.first_names("male", "italian"))
    both = ts.anonymize(df, {"name": ("names", {"gender_column": "sex", "randomize_gender": True})}, 3, ["i"])
    assert both.where("name is not null and sex not in ('male', 'female')").count() == 0
    mapped = ts.anonymize(df, {"name": ("names", {"gender_column": "sex", "gender_map": {"m": "female"}})}, 3, ["i"]).where("i = 3").first()
    assert any(mapped.name.startswith(f) for f in lib.first_names("female"))


def test_custom_anonymizer_and_errors(people):
    class Upper(ts.MappingAnonymizer):
        def replacements(self, values, name, seed):
            return values.select("value", F.upper("value").alias("replacement"))

    assert {r.region for r in ts.anonymize(people, {"region": Upper()}, 1).select("region").distinct().collect()} == {"NORTH", "SOUTH", "EAST", "WEST"}
    with pytest.raises(KeyError):
        ts.anonymize(people, {"nope": "hex"})
    with pytest.raises(ValueError):
        ts.make_anonymizer("what")
    with pytest.raises(TypeError):
        an.coerce(3)


def test_name_library(tmp_path):
    lib = NameLibrary.built_in()
    assert set(lib.first_names("male", "indian")) > set(lib.first_names("male", "indian_tamil")) and lib.first_names("male", "nowhere") == lib.first_names(None)[:0] + lib.first_names(None, "nowhere")
    assert "Ivanova" in lib.last_names("female", "russian") and "Ivanova" not in lib.last_names("male", "russian")
    lib.export(str(tmp_path / "n.json"))
    assert NameLibrary.load(str(tmp_path / "n.json")) == lib
    ts.use_library({"first": {"x_male": ["A"]}, "last": {"x": ["B"]}})
    assert ts.library().first_names() == ["A"]
    ts.use_library(None)
    with pytest.raises(ValueError):
        NameLibrary.load("{}")


@pytest.mark.parametrize(
    ("name", "kind", "unique_pct", "want"),
    [
        ("signup_date", "categorical", 10, "datetime_jitter"), ("when", "datetime", 10, "datetime_jitter"), ("email", "categorical", 100, "hex"), ("full_name", "text", 100, "names"), ("user_code", "categorical", 100, "sequential_id"),
        ("customer_id", "numeric", 100, "sequential_id"), ("salary", "numeric", 50, "numeric_jitter"), ("region", "categorical", 1, "none"), ("active", "boolean", 1, "none"), ("notes", "text", 100, "random_string"),
        ("mandate_ref", "categorical", 5, "none"), ("candidate_name", "categorical", 5, "names"), ("created_at", "categorical", 5, "datetime_jitter"), ("mail", "numeric", 5, "hex"), ("start", "other", 5, "none"),
    ],
)
def test_suggest_type(name, kind, unique_pct, want):
    assert ts.suggest_type(ColumnStats(name, "", kind, unique_pct=unique_pct)) == want


def test_plan(people):
    plan = ts.AnonymizationPlan.suggest(people)
    assert plan.type_of("id") == "sequential_id" and plan.type_of("name") == "names" and plan.type_of("region") == "none"
    plan.assign("id", "seq", start=5).clear("name")
    assert plan.type_of("id") == "sequential_id" and "name" not in plan.active_columns()
    answers = iter(["", "6", "x", "", "", "", "1"])
    said = []
    plan.choose_interactively(people, prompt=lambda _: next(answers), echo=said.append)
    assert plan.assignments["id"] == ("sequential_id", {"start": 5}) and plan.type_of("name") == "random_string" and plan.type_of("notes") == "none"
    assert len(said) == 2 and "'x' means none of" in said[1] and "letters" in plan.summary() and "start=5" in plan.summary()
    assert plan.answered("region", "dig") == ("hex", {}) and plan.answered("id", "seq") == ("sequential_id", {"start": 5}) and plan.answered("region", " ") == ("none", {})
    with pytest.raises(ValueError):
        plan.answered("region", "8")
    out = plan.apply(people, 1, ["id"])
    assert out.agg(F.min("id")).first()[0] == 5 and out.count() == 1000


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400), rng.normal(size=400)
    cols = {"height": 170 + 10 * a, "weight": 70 + 8 * a + rng.normal(size=400), "price": 5 * b, "tax": b + 0.05 * rng.normal(size=400), "noise": rng.normal(size=400)}
    rows = [("x", *[float(c[i]) for c in cols.values()], bool(i % 2)) for i in range(400)]
    return spark.createDataFrame(rows, "label string, height double, weight double, price double, tax double, noise double, flag boolean"), np.stack(list(cols.values()), 1)


def test_pca_against_numpy(wide):
    df, x = wide
    r = ts.reduce_columns(df, n_components=5)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(r.explained_variance_ratio, s**2 / (s**2).sum()) and np.allclose(np.abs(r.components), np.abs(v), atol=1e-6)
    assert all(row[np.argmax(np.abs(row))] > 0 for row in r.components)
    got = r.data.toPandas()
    assert list(got.columns) == ["label", "PC1", "PC2", "PC3", "PC4", "PC5", "flag"] and np.allclose(np.abs(got[[f"PC{i}" for i in range(1, 6)]].to_numpy()), np.abs(z @ v.T), atol=1e-6)
    assert r.column_groups == [["height", "weight"], ["price", "tax"]]
    assert ts.reduce_columns(df, variance_ratio=0.7).n_components == int(np.searchsorted(np.cumsum(s**2 / (s**2).sum()), 0.7)) + 1
    lines = ts.format_reduction_report(r).split("\n")
    assert lines[0] == "# 5 columns, standardised, in 5 components: 100.0% of their variance"
    corr = np.corrcoef(x.T)
    assert [" ".join(line.split()) for line in lines[-4:]] == ["-" * 13 + " " + "-" * 8, f"height, weight {corr[0, 1]:.2f}", f"price, tax {corr[2, 3]:.2f}", "on their own: noise"] or lines[-1] == "on their own: noise"
    assert sum(line.startswith("PC") for line in lines) == 5


def test_pca_edges(spark, wide):
    df = wide[0]
    for bad in ({}, {"n_components": 1, "variance_ratio": 0.5}, {"n_components": 0}, {"variance_ratio": 1.0}, {"n_components": 1, "columns": ["flag"]}, {"n_components": 1, "columns": "nope"}):
        with pytest.raises(ValueError):
            ts.reduce_columns(df, **bad)
    assert ts.reduce_columns(df.select("label"), n_components=1).n_components == 0
    assert "nothing to reduce" in ts.reduce_columns(df.select("height"), n_components=1).notes[-1]
    big = spark.createDataFrame([(9e153 * (-1) ** i, 6e153 * (-1) ** (i // 2)) for i in range(8)], "h double, g double")
    assert np.allclose(ts.reduce_columns(big, n_components=2, standardize=False).explained_variance_ratio, [81 / 117, 36 / 117])
    holes = spark.createDataFrame([(1.0, 2.0, 5.0), (None, 4.0, 5.0), (3.0, float("inf"), 5.0), (5.0, 1.0, 5.0)], "a double, b double, c double")
    r = ts.reduce_columns(holes, n_components=1)
    assert r.dropped_columns == ["c"] and r.data.count() == 4 and r.data.where("PC1 is null or isnan(PC1)").count() == 0
    with pytest.raises(ValueError):
        ts.reduce_columns(df.withColumn("PC1", F.lit("x")), n_components=1)
    ids = spark.range(100).select(F.col("id").alias("customer_id"), (F.col("id") % 7).alias("v"))
    assert "identifier" in " ".join(ts.reduce_columns(ids, n_components=1).notes)


def test_reports(people):
    r = ts.sample(people, 100, seed=1, key=["id"])
    t = {(x.column, x.ord): x for x in ts.histogram_comparison(people, r.data).collect()}
    assert sum(x.source_n for (c, _), x in t.items() if c == "score") == 1000 and not any(c == "name" for c, _ in t)
    text = ts.format_stratification_report(people, r)
    shares = {(x.column, x.value): x for x in ts.stratification_table(people, r.data, r.strat_cols).collect()}
    for (c, v), x in shares.items():
        line = next(y for y in text.split("\n\n") if y.startswith(c))
        want = ["(null)" if v is None else v, f"{x.source_n:,}", f"{x.sample_n:,}", f"{x.source_pct:.1f}%", f"{x.sample_pct:.1f}%", f"{x.sample_pct - x.source_pct:+.1f}"]
        assert want in [y.split() for y in line.split("\n")]
    assert ts.format_stratification_report(people, ts.sample(people, 10, use_random=True, seed=1)).endswith("rows.")
    few = ts.sample(people, 9, seed=1, strat_cols=["region", "tier"], key=["id"])
    assert "Nothing was drawn of these" in ts.format_stratification_report(people, few)
    text = ts.format_distribution(people, "region")
    counts = people.where("region is not null").groupBy("region").count().collect()
    assert f"{len(counts)} values" in text and all([r.region, f"{r['count']:,}"] in [y.split()[:2] for y in text.split("\n")] for r in counts)
    assert ts.sparkline([]) == "" and ts.sparkline([0, 1, 100]) == "▁▂█" and number(1234567.0) == "1,234,567" and number(None) == "—"


def test_files(spark, tmp_path, people):
    small = spark.createDataFrame([(1, "é, \"x\""), (2, None), (3, "z\ny")], "a long, `név` string")
    for kind in ("csv", "tsv", "json", "parquet"):
        path = ts.save_output(small, str(tmp_path / f"in.{kind}"), "sample_3")
        assert path.name == f"in_sample_3.{kind}" and path.is_file()
        back = ts.read_table(spark, str(path))
        assert sorted((int(r.a), r["név"]) for r in back.where("a <> 2").collect()) == [(1, 'é, "x"'), (3, "z\ny")]
    (tmp_path / "c.json").write_text(json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": 1, "1": 3}}))
    with pytest.raises(ValueError, match="by columns"):
        ts.read_table(spark, str(tmp_path / "c.json"))
    with pytest.raises(ValueError):
        ts.read_table(spark, "x.docx")
    assert ts.list_sheets("a.csv") == [] and ts.tag(5, True, 2) == "sample_5_anon_pca2"
    assert ts.save_report("hi", str(tmp_path / "in.csv")).read_text() == "hi"
    people.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    drawn = ts.sample(ts.read_table(spark, str(tmp_path / "many.parquet")), 300, seed=1).data
    assert drawn.count() == drawn.select("id").distinct().count() == 300


def test_stream(spark, tmp_path, people):
    people.select("id", "score").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, score double").parquet(str(tmp_path / "in"))
    out = ts.anonymize_stream(stream, {"score": "jitter", "id": ("hex", {"length": 16})}, 1)
    out.writeStream.format("memory").queryName("jittered").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("jittered").count() == 1000
    with pytest.raises(TypeError):
        ts.anonymize_stream(stream, {"id": "names"}, 1)


def test_command_line(spark, tmp_path, people, capsys):
    source = ts.save_output(people, str(tmp_path / "p.csv"), "all")
    assert cli.main([str(source), "50", "--seed", "1", "--anon", "id=sequential_id:start=10,interval=2", "--anon", "name=names", "--reduce-components", "1", "--reduce-exclude", "id", "--outdir", str(tmp_path / "o")], spark) == 0
    assert "# Strata by " in capsys.readouterr().out
    assert cli.main([str(source), "50", "--skip", "nope"], spark) == 2
    with pytest.raises(SystemExit):
        cli.main([str(source), "5", "--reduce-exclude", "id"], spark)
    assert cli.parse_anon("a=jitter:pct=0.1,round_to=2") == ("a", ("jitter", {"pct": 0.1, "round_to": 2})) and cli.option_value("true") is True


def test_kinds(spark):
    df = spark.sql("select 1 as a, 1.5 as b, true as c, current_date() as d, 'x' as e, array(1) as f, interval 1 day as g")
    assert [kind_of(f.dataType) for f in df.schema.fields] == ["numeric", "numeric", "boolean", "datetime", "categorical", "other", "other"]


def test_entry_works_without_the_corpus_part():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules.pop('corpus_pipeline', None)\ntry:\n    import __spark_entry__\nexcept ModuleNotFoundError as e:\n    assert e.name.startswith('tessera.llm')\nelse:\n    assert not any(k.startswith('op') for k in __spark_entry__.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)


def test_numbering_over_ranges(spark):
    df = spark.range(0, 1000, 1, 7).select(F.struct((F.col("id") * 7919 % 1000).alias("a"), F.lit("x").alias("b")).alias("first"), F.col("id").cast("string").alias("text"))
    got = numbered(df, ["first", "text"], most=60).collect()
    assert sorted((r.first.a, r.text) for r in got) == [(r.first.a, r.text) for r in sorted(got, key=lambda r: r.i)] and sorted(r.i for r in got) == list(range(1000))
    same = numbered(df, ["first", "text"]).collect()
    assert {(r.text, r.i) for r in got} == {(r.text, r.i) for r in same}


def test_medians_of_many_values(spark):
    rng = np.random.default_rng(3)
    cols = {"normal": rng.normal(size=5000), "skewed": np.exp(8 * rng.normal(size=5000)), "few": rng.integers(0, 3, 5000).astype(float), "same": np.ones(5000), "odd": rng.normal(size=5000)}
    rows = [tuple(float(c[i]) if not (k == "odd" and i == 0) else None for k, c in cols.items()) for i in range(5000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    stats = {s.name: s for s in ts.profile(df, distributions=False)}
    ends = {c: (s.min, s.max, s.count) for c, s in stats.items()}
    for held in (10, 300, 10**6):
        got = medians(df, ends, held)
        for c, v in cols.items():
            want = np.median(v[1:] if c == "odd" else v)
            assert np.isclose(got[c], want, rtol=1e-12), (held, c)


def test_long_values_are_told_apart(spark):
    a, b = "x" * 70 + "a", "x" * 70 + "b"
    s = ts.profile(spark.createDataFrame([(a,)] * 3 + [(b,)] * 2 + [("short",)], "v string"))[0]
    assert s.unique == 3 and s.top_values == [(a, 3), (b, 2), ("short", 1)] and s.mode == a


def test_helper_names_and_exact_sizes(spark):
    names = ["__s0", "__alloc", "__bound", "__rn", "__wh", "__wk", "__h", "__k"]
    df = spark.range(3000).select("id", (F.col("id") % 4).cast("string").alias("g"), *[F.lit(n).alias(n) for n in names])
    for narrow in (False, True):
        got = ts.sample(df, 100, strat_cols=["g"], seed=5, key=["id"], narrow=narrow).data
        assert got.columns == df.columns and got.count() == 100 and all(r[n] == n for r in got.collect() for n in names)
    for n in (1, 7, 100, 2999):
        assert ts.sample(df, n, use_random=True, seed=n, key=["id"]).data.count() == n
    assert {r.id for r in ts.random_sample(df, 50, seed=2, key=["id"]).collect()} == {r.id for r in ts.random_sample(df, 50, seed=2, key=["id"], rows=10**7).collect()}


def test_mappings_are_for_categories(spark):
    with pytest.raises(ValueError):
        ts.suggest_gender_mapping(spark.range(20_000).select(F.col("id").cast("string").alias("v")), "v")


def test_downloads_and_single_files(spark, tmp_path, people):
    import threading
    from functools import partial
    from http.server import HTTPServer, SimpleHTTPRequestHandler

    few = people.select("id", "name", "region").limit(5)
    web = tmp_path / "web"
    web.mkdir()
    few.toPandas().to_csv(web / "p.csv", index=False)
    few.toPandas().to_json(web / "p.json", orient="records")
    few.toPandas().to_parquet(web / "p.parquet")
    server = HTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(web)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for kind in ("csv", "json", "parquet"):
            url = f"http://127.0.0.1:{server.server_port}/p.{kind}?v=1"
            got = ts.read_table(spark, url)
            assert got.columns == few.columns and sorted(r.id for r in got.collect()) == sorted(r.id for r in few.collect())
            path = ts.save_output(got, url, "again", str(tmp_path / "out"))
            assert path.name == f"p_again.{kind}" and ts.read_table(spark, str(path)).count() == 5
    finally:
        server.shutdown()
    many = ts.read_table(spark, f"{web}/*.parquet")
    assert many.count() == 5 and [x.name for x in (tmp_path / "out").iterdir() if x.name.startswith(".") and not x.name.endswith(".crc")] == []


def test_excel_through_a_stand_in(spark, tmp_path, monkeypatch, people):
    import pandas

    saved = {}
    stand_in = type("Pandas", (), {
        "read_excel": staticmethod(lambda path, sheet_name=0: pandas.DataFrame({"sheet": [str(sheet_name)], "v": [1]})),
        "ExcelFile": staticmethod(lambda path: type("Book", (), {"sheet_names": ["one", "two"]})()),
    })
    monkeypatch.setattr("tessera.sources.readers._excel", lambda: stand_in)
    monkeypatch.setattr("tessera.sources.writers._excel", lambda: stand_in)
    monkeypatch.setattr(pandas.DataFrame, "to_excel", lambda self, path, index: saved.update({str(path): (len(self), index)}))
    assert ts.read_table(spark, "book.xlsx").first().sheet == "0" and ts.read_table(spark, "book.xlsx", "two").first().sheet == "two"
    assert ts.list_sheets("book.xlsx") == ["one", "two"] and ts.list_sheets("book.csv") == []
    path = ts.save_output(people.limit(3), str(tmp_path / "book.xlsx"), "sample_3")
    assert saved == {str(path): (3, False)}
