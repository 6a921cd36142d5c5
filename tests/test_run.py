from pyspark.sql import functions as F

from engram.operators import consolidate
from engram.operators.run import consolidation_run
from engram.operators.topics import markdown
from engram.sources import views
from tests.test_operators import facts, near_vectors


def test_whole_run(spark):
    v = near_vectors(spark, [3, 2, 2, 2, 1])
    text = {0: "the user likes tea with milk", 1: "meeting at nine", 2: "car is red", 3: "door is open", 4: "lonely"}
    rows = []
    for r in v.select("id").collect():
        g, j = int(r.id[1]), int(r.id[3])
        said = text[g] if g == 0 else f"{text[g]} {'alpha beta gamma delta' if j else 'one two three four'}"
        rows.append({"id": r.id, "content": said, "starts": j, "created": j, "used": views.NOW, "access_count": 2})
    old = {"id": "old", "content": "long ago", "used": 0, "starts": 0}
    m = facts(spark, [*rows, old]).cache()
    decisions = spark.createDataFrame([("g1-0", "merge", "new1", "meeting at nine sharp", None), ("g2-0", "contradiction", None, None, "g2-1"), ("g3-0", "contradiction", None, None, None)], "cluster_id string, decision string, new_id string, merged_text string, winner string")
    verdicts = spark.createDataFrame([("g3-0", "g3-1", True, "state")], "a string, b string, contradiction boolean, shared_attribute string")
    made = consolidation_run(m, v, views.now(), decisions=decisions, verdicts=verdicts)
    state = {r.id: r for r in made.state.collect()}
    # No fact is lost, and one was made.
    assert set(state) == {r["id"] for r in rows} | {"old", "new1"}
    assert [state[f"g0-{j}"].superseded_by for j in range(3)] == ["g0-2", "g0-2", None] and state["g0-2"].access_count == 6
    assert state["g1-0"].superseded_by == state["g1-1"].superseded_by == "new1" and state["new1"].access_count == 4
    assert state["g2-0"].valid_until is not None and state["g2-1"].valid_until is None
    assert [r.ids for r in made.review.collect()] == [["g3-0", "g3-1"]]
    assert state["g3-0"].valid_until is not None and state["g3-1"].valid_until is None
    assert state["old"].archived_at is not None and round(state["old"].confidence, 4) == 0.45
    # Rolling back restores every row; running again over the result changes nothing.
    back = consolidate.rollback(made.state, made.entries)
    assert back.exceptAll(m).count() == 0 and m.exceptAll(back).count() == 0
    again = consolidation_run(made.state, v, views.now())
    assert again.entries.count() == 0
    assert "## en" in markdown(made.counts.collect(), len(rows), 3, "2025-07-20")


def test_empty_store(spark):
    v = near_vectors(spark, [1]).limit(0)
    m = facts(spark, [{"id": "x", "content": "y"}]).limit(0)
    assert consolidation_run(m, v, F.timestamp_seconds(F.lit(0))).state.count() == 0
