import pytest
from pyspark.sql import functions as F

from unitlife.operators import splits
from unitlife.operators.ordered import CHUNK
from unitlife.schema import Keys, SplitLeakageError, UnknownUnitsError

KEYS = Keys("rig", "run")
COHORT = {"r1": "train", "r2": "train", "r3": "val", "r4": "test", "r5": "train"}
LEFT_OUT = ("r8", "r9")
RUNS = {"r1": 7, "r2": 1, "r3": 4, "r4": 2, "r5": 5}


def rigs(spark, **more):
    rows = [(rig, run) for rig, n in {**RUNS, **more}.items() for run in range(1, n + 1)]
    return spark.createDataFrame(rows, "rig string, run int")


def table(spark, rows):
    return spark.createDataFrame(rows, "rig string, split string")


def test_fixed_cohort():
    assert sorted(map(len, (splits.TRAIN_UNITS, splits.VAL_UNITS, splits.TEST_UNITS, splits.EXCLUDED_UNITS))) == [1, 1, 10, 22]
    assert not {*splits.SPLIT_OF} & {*splits.EXCLUDED_UNITS}
    assert (splits.SPLIT_OF["B0007"], splits.SPLIT_OF["B0018"]) == ("val", "test")


@pytest.mark.parametrize("as_table", [False, True])
@pytest.mark.parametrize("chunk_rows", [2, 1 << 20])
def test_every_row_gets_the_split_of_its_rig(spark, as_table, chunk_rows):
    cohort = table(spark, list(COHORT.items())) if as_table else COHORT
    got = splits.assign_splits(rigs(spark, r9=3), cohort, LEFT_OUT, KEYS, chunk_rows=chunk_rows)
    assert CHUNK not in got.columns
    assert sorted(map(tuple, got.select("rig", "run", "split").collect())) == sorted(
        (rig, run, COHORT[rig]) for rig, n in RUNS.items() for run in range(1, n + 1))
    by_split = splits.split_frames(got)
    assert {name: df.count() for name, df in by_split.items()} == {"train": 13, "val": 4, "test": 2}
    sizes = {r.split: (r.n_rows, r.n_units) for r in splits.split_sizes(got, KEYS).collect()}
    assert sizes == {"train": (13, 3), "val": (4, 1), "test": (2, 1)}


def test_unknown_rigs_are_all_named(spark):
    strangers = {f"x{i:02d}": 1 for i in range(30)}
    with pytest.raises(UnknownUnitsError, match="30 unit.*x00 to x29") as caught:
        splits.assign_splits(rigs(spark, **strangers), COHORT, LEFT_OUT, KEYS)
    assert {r.rig for r in caught.value.units.collect()} == set(strangers)
    with pytest.raises(KeyError, match="1 unit.*: x00$"):
        splits.assign_splits(rigs(spark, x00=2), COHORT, LEFT_OUT, KEYS)


def test_leaked_rigs_are_all_named(spark):
    doubled = table(spark, [*COHORT.items(), *((f"y{i:02d}", s) for i in range(25) for s in ("train", "test")), ("r1", "train")])
    df = rigs(spark, **{f"y{i:02d}": 1 for i in range(25)})
    with pytest.raises(SplitLeakageError, match="25 unit.*y00 to y24") as caught:
        splits.assign_splits(df, doubled, LEFT_OUT, KEYS)
    assert caught.value.units.count() == 25
    unchecked = splits.assign_splits(df, doubled, LEFT_OUT, KEYS, check=False)
    with pytest.raises(AssertionError):
        splits.assert_no_unit_overlap(unchecked, KEYS)
    splits.assert_no_unit_overlap(splits.assign_splits(rigs(spark), COHORT, LEFT_OUT, KEYS), KEYS)


def test_fleet_against_cohort(spark):
    df = rigs(spark, r8=1, new=1)
    excluded = splits.unit_list(df, LEFT_OUT, KEYS)
    assert [r.rig for r in splits.excluded_present(df, excluded, KEYS).collect()] == ["r8"]
    sides = {r.rig: r.side for r in splits.cohort_mismatch(df, table(spark, list(COHORT.items())), excluded, KEYS).collect()}
    assert sides == {"new": "undecided", "r9": "not in fleet"}


@pytest.mark.parametrize("change, problems", [
    ({}, set()),
    ({"r8": "val"}, {("r8", "admitted and excluded")}),
    ({"r2": "spare"}, {("r2", "unknown split label")}),
    ({"r4": "val"}, {(None, "no unit in split test")}),
    ({"r4": "spare", "r3": "train"}, {("r4", "unknown split label"), (None, "no unit in split test"), (None, "no unit in split val")}),
])
def test_cohort_problems(spark, change, problems):
    cohort = table(spark, list({**COHORT, **change}.items()))
    found = splits.cohort_problems(cohort, splits.unit_list(cohort, LEFT_OUT, KEYS), KEYS)
    assert {tuple(r) for r in found.select("rig", "problem").collect()} == problems
