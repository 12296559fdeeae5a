"""A stream over typed state: runs over parts equal one run, and answers change nothing."""

from tidemark.operators import cases, memory
from tidemark.streaming import state, versions

DDL = "entity string, path string, op string, value string, month int, seq int, source string"
CELL = ["entity", "path", "seq", "value", "status", "confidence", "valid_from", "valid_until", "source"]


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.select(CELL).collect()))


def test_halves_and_answers(spark, tmp_path):
    ops = ["create", "update", "set_pending", "clear_pending", "needs_verification", "archive", "reactivate", "no_update", "mark_stale"]
    made = [(f"e{k % 3}", f"p{k % 2}", ops[k * 7 % 9], f"v{k}" if k % 4 else None, 1 + k // 6, k, f"s{k % 2}" if k % 5 else None) for k in range(60)]
    changes = spark.createDataFrame(made, DDL)
    at = lambda x: str(tmp_path / x)
    for n, part in enumerate(("month <= 4", "month > 4 and month <= 7", "month > 7")):
        changes.filter(part).write.mode("append").parquet(at("in"))
        versions.take_in(spark, at("in"), changes.schema, at("state"), at("out"))
        assert rows_of(versions.cells_at(spark, at("state"))) == rows_of(memory.fold(changes.filter("month <= " + ("4", "7", "99")[n])))
    print_of = lambda: cases.fingerprints(versions.cells_at(spark, at("state")), ["entity"], ["path", "seq", "value", "status"]).collect()
    before = sorted(map(tuple, print_of()))
    old = rows_of(versions.cells_at(spark, at("state"), 0))  # an answer at an earlier checkpoint
    assert old == rows_of(memory.fold(changes.filter("month <= 4"))) and sorted(map(tuple, print_of())) == before
    versions.take_in(spark, at("in"), changes.schema, at("state"), at("out"))  # nothing new: nothing happens
    assert sorted(map(tuple, print_of())) == before
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != versions.STORE["spark.sql.streaming.stateStore.providerClass"]


def test_state_is_kept_by_entity(spark, tmp_path):
    """One group of the stream for each entity, whatever its paths, and null entities, paths and values keep their own cells."""
    ops = ["create", "update", "set_pending", "clear_pending", "needs_verification", "archive"]
    made = [(f"e{k % 3}" if k % 3 else None, f"p{k % 4}" if k % 4 else None, ops[k * 5 % 6], f"v{k}" if k % 5 else None, 1 + k // 10, k, f"s{k % 2}") for k in range(60)]
    changes = spark.createDataFrame(made, DDL)
    at = lambda x: str(tmp_path / x)
    for part in ("month <= 3", "month > 3"):
        changes.filter(part).write.mode("append").parquet(at("in"))
        versions.take_in(spark, at("in"), changes.schema, at("typed"), at("typed_out"))
        cells = state.fold_available(spark, at("in"), changes.schema, at("out"), at("state"))
        assert spark.read.format("statestore").option("stateVarName", "paths").load(at("typed")).count() == 3
        assert spark.read.format("statestore").load(at("state")).count() == 3
        taken = changes if part == "month > 3" else changes.filter(part)
        assert rows_of(cells) == rows_of(versions.cells_at(spark, at("typed"))) == rows_of(memory.fold(taken))
