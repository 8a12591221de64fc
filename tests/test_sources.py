import pytest

from latencylab.sources import files, schemas


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", "s1", "adjacent", None, 7, 3, 1, 512.5), ("2", "s2", "none", "none", 1, 4, 0, 99.0)]
    df = spark.createDataFrame(rows, schemas.TRIALS)
    files.write_table(df, str(tmp_path / "t"), "csv")
    back = files.read_trials(spark, str(tmp_path / "t"))
    assert back.schema == schemas.TRIALS
    assert sorted(map(tuple, back.collect())) == sorted(rows, key=lambda r: r[0])
    both = files.read_cohorts(spark, {"adults": str(tmp_path / "t"), "children": str(tmp_path / "t")})
    assert both.groupBy("group").count().count() == 2 and both.count() == 4


def test_header_that_disagrees_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("draw,b_Other\n1,2.0\n")
    with pytest.raises(Exception, match="b_Other"):
        files.read_draws(spark, str(tmp_path / "x.csv"), ["b_Intercept"]).collect()


def test_partitioned_parquet_and_judgements(spark, tmp_path):
    df = spark.createDataFrame([("s", "i", "adjacent", "k", "d", 0)], schemas.JUDGEMENTS)
    files.write_table(files.tag_cohort(df, "adults"), str(tmp_path / "j"), partition_by=("group",))
    assert (tmp_path / "j" / "group=adults").is_dir()
    assert files.read_judgements(spark, str(tmp_path / "j" / "group=adults"), "parquet").count() == 1


def test_every_cleaned_line_counts_in_a_draw(spark, sf_dir):
    from latencylab.operators import bootstrap
    from latencylab.sources import warehouse as WH

    d = WH.cell_draws(spark, sf_dir)
    assert d.select("draw").distinct().count() == d.count() == bootstrap.REPLICATES
    assert d.dropna().count() == d.count() and len(d.columns) == 46
    lines = WH.table(spark, sf_dir, "lineitem").where(WH.CLEAN_ON_STORED)
    cells = lines.selectExpr(
        f"concat_ws('_', {WH.COHORT_OF_STATUS}, {WH.DEPENDENCY_OF_FLAG}, l_linenumber) as cell", "ln(l_extendedprice / 10) as value"
    ).groupBy("cell").agg({"value": "avg"}).collect()
    mean = d.agg({c: "avg" for c in WH.all_cells()}).first()
    for r in cells:
        assert mean[f"avg({r['cell']})"] == pytest.approx(r["avg(value)"], abs=0.01)


def test_files_with_further_columns_and_no_key(spark, tmp_path):
    (tmp_path / "d.csv").write_text("prior_b_x,b_B,b_Intercept,sd_y\n9,2.5,1.5,9\n9,0.5,1.0,9\n9,7.0,1.0,9\n")
    got = files.read_draws(spark, str(tmp_path / "d.csv"), ["b_Intercept", "b_B"], keyed=False)
    assert got.columns == ["draw", "b_Intercept", "b_B"]
    assert sorted(map(tuple, got.collect())) == [(0, 1.0, 0.5), (1, 1.0, 7.0), (2, 1.5, 2.5)]
    (tmp_path / "t.csv").write_text("age,rt,acc,block,subj,stim,dependency,dependency2,trial_in_block\n30,512.5,1,7,s,x,none,NA,3\n")
    row = files.read_trials(spark, str(tmp_path / "t.csv")).first()
    assert row.rt == 512.5 and row.block == 7 and row.dependency2 is None
    for name, schema in schemas.DERIVED.items():
        (tmp_path / f"{name}.csv").write_text(",".join(["extra", *schema.names]) + "\n")
        assert files.read_derived(spark, str(tmp_path / f"{name}.csv"), name).schema == schema


def test_keys_of_a_large_keyless_file(spark):
    df = spark.range(5000).selectExpr("cast(id * 7919 % 5000 as double) as a", "1D as b").repartition(7)
    got = files.attach_key(df)
    assert got.where("draw != a").count() == 0 and got.count() == 5000


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from latencylab.operators.sizing import checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)


def test_clean_on_stored_columns_is_the_same_filter(spark, sf_dir):
    from latencylab.operators.trials import clean_trials
    from latencylab.sources import warehouse as WH

    stored = WH.table(spark, sf_dir, "lineitem").where(WH.CLEAN_ON_STORED)
    assert stored.count() == clean_trials(WH.trials(spark, sf_dir)).count()
    pushed = stored._jdf.queryExecution().toString().split("PushedFilters:")[1]
    assert "GreaterThan(l_quantity,2.0)" in pushed


def test_rejected_values_and_mixed_headers(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("subj,item,dependency,expected,given,acc\ns1,1,en,k,k,1\ns1,2,en,k,d,no\nsubj,item,dependency,expected,given,acc\ns2,NA,,k,k,0\n")
    (folder / "b.csv").write_text("acc,note,given,expected,dependency,item,subj\n1,x,k,k,de,7,s3\n1.5,x,k,k,de,8,s3\n0\n")
    (folder / "c.csv").write_text("1,2,3\n4,5,6\n")
    accepted, rejected = files.read_folder(spark, str(folder), schemas.JUDGEMENTS)
    good = sorted((tuple(r) for r in accepted.collect()), key=str)
    assert good == sorted([("s1", "1", "en", "k", "k", 1), ("s2", None, None, "k", "k", 0), ("s3", "7", "de", "k", "k", 1), (None, None, None, None, None, 0)], key=str)
    bad = {(r["file"].rsplit("/", 1)[1], r["column"], r["raw"], r["record"]) for r in rejected.collect()}
    assert bad == {
        ("a.csv", "acc", "no", "s1,2,en,k,d,no"), ("b.csv", "acc", "1.5", "1.5,x,k,k,de,8,s3"),
        ("c.csv", "", None, "1,2,3"), ("c.csv", "", None, "4,5,6"),
    }


def test_records_are_cut_as_the_csv_reader_does(spark, tmp_path):
    import random

    rng = random.Random(5)
    parts = ["a", "", "NA", '""', '"NA"', '"x,y"', '"b', 'c"d', '"e""f"', '"g\\"h"', "k\\", " ", " l ", "\t", "é", "'", '"m" n', "7.5", "\\,", "#", "\x00"]
    lines = [",".join(rng.choices(parts, k=rng.choice([1, 2, 3, 8, 9, 20, 40]))) for _ in range(3000)]
    lines += [*parts, "   ", ",", ",,,", ",".join(["z"] * 64), ",".join(["z"] * 65), ",".join(['"z"'] * 90), ",".join(["z"] * 90), "," * 63, "," * 64]
    (tmp_path / "t.csv").write_bytes("\n".join(lines).encode() + b"\nbroken \xff\xc3,x\n")
    slots = [f"_c{i}" for i in range(files.MOST_COLUMNS)]
    reader = spark.read.schema(", ".join(f"{c} string" for c in slots)).option("nullValue", "NA").csv(str(tmp_path))
    want = sorted(reader.selectExpr(f"to_json(array({', '.join(slots)})) as v").collect())
    _, rejected = files.read_folder(spark, str(tmp_path), schemas.JUDGEMENTS)
    assert rejected.count() == len(want)  # no header: every record is rejected, blank lines are none
    text = spark.read.text(str(tmp_path)).selectExpr("make_valid_utf8(value) as line").where(r"line rlike r'[^\x00-\x20]'")
    padded = f"concat(v, array_repeat(cast(null as string), {files.MOST_COLUMNS} - size(v)))"
    got = sorted(text.selectExpr(f"{files._tokens('line')} as v").selectExpr(f"to_json({padded}) as v").collect())
    assert got == want


def test_short_files_are_not_read_by_a_wide_schema(spark, tmp_path):
    """The CSV reader raises and catches an error for each column that a record lacks."""
    (tmp_path / "a.csv").write_text("subj,item,dependency,expected,given,acc\ns1,1,en,k,k,1\ns2,2,en,k,d,no\n")
    accepted, rejected = files.read_folder(spark, str(tmp_path), schemas.JUDGEMENTS)
    assert [r.subj for r in accepted.collect()] == ["s1"] and [r.raw for r in rejected.collect()] == ["no"]
    for df in (accepted, rejected):
        assert "Format: CSV" not in df._jdf.queryExecution().executedPlan().toString()


def test_refresh_rebuilds_changed_partitions_only(spark, tmp_path):
    from latencylab.sources import results

    path = str(tmp_path / "result")
    rows = [(b, i, float(i)) for b in (1, 2, 3) for i in range(10)]
    table = lambda rs: spark.createDataFrame(rs, "block int, i int, v double").repartition(3)
    built = []

    def build(part):
        built.append(sorted(r["block"] for r in part.select("block").distinct().collect()))
        return part.groupBy("block").agg({"v": "sum"}).toDF("block", "total")

    def now():
        return {r["block"]: (r["total"], r["_version"]) for r in results.read(spark, path, ["block"], versions=True).collect()}

    with pytest.raises(ValueError, match="nothing"):
        results.read(spark, path, ["block"])
    assert results.refresh(path, table(rows), ["block"], build) == 3 and now() == {b: (45.0, 1) for b in (1, 2, 3)}
    assert results.refresh(path, table(rows[::-1]), ["block"], build) == 0 and len(built) == 1  # order does not matter
    changed = [(b, i, v + (b == 2)) for b, i, v in rows if b != 3] + [(4, 0, None)]
    assert results.refresh(path, table(changed), ["block"], build) == 2 and built[-1] == [2, 4]
    assert now() == {1: (45.0, 1), 2: (55.0, 2), 4: (None, 2)}

    def fails(part):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        results.refresh(path, table(rows), ["block"], fails)
    assert now() == {1: (45.0, 1), 2: (55.0, 2), 4: (None, 2)}
    assert results.refresh(path, table([r for r in changed if r[0] == 1]), ["block"], build) == 0 and now() == {1: (45.0, 1)}


def test_draw_tables_follow_their_input(spark, tmp_path, sf_dir):
    import shutil

    from latencylab.sources import warehouse

    shutil.copy(f"{sf_dir}/lineitem.parquet", tmp_path / "lineitem.parquet")
    first = warehouse.cell_draws(spark, str(tmp_path)).agg({"adults_none_1": "avg"}).first()[0]
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    table.where("l_orderkey % 2 = 0").write.mode("overwrite").parquet(str(tmp_path / "half"))
    half = next(p for p in (tmp_path / "half").iterdir() if p.name.startswith("part-"))
    shutil.copy(half, tmp_path / "lineitem.parquet")
    assert warehouse.cell_draws(spark, str(tmp_path)).agg({"adults_none_1": "avg"}).first()[0] != first


def test_stored_tables_can_be_cleared(spark):
    import os

    from latencylab.operators import sizing

    folder = sizing.run_folder(spark).removeprefix("file:")
    held = sizing.cut_lineage(spark.range(5))
    assert held.count() == 5 and any(f.startswith("step-") for f in os.listdir(folder))
    assert spark.sparkContext.applicationId in folder
