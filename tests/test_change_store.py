import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlog.sources import change_store as cs
from wardlog.sources.schemas import INT_COLUMNS, TEXT_COLUMNS

START = datetime(2026, 1, 1)


def events(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "event_id long")
    texts = [F.lit(f"{c}-x").alias(c) for c in TEXT_COLUMNS]
    numbers = [F.lit(1).alias(c) for c in INT_COLUMNS]
    rest = [F.lit("2026-01-01 00:00:00").alias("timestamp"), F.lit(0.5).alias("request_time"), F.lit(True).alias("is_blocked")]
    return rows.select("event_id", *texts, *numbers, *rest, F.lit(None).cast("int").alias("prediction"), F.lit(None).cast("double").alias("probability"))


def changes(spark, rows):
    """Rows of (event, minute, prediction, label, attack)."""
    made = [(e, START + timedelta(minutes=m), p, label, "manual" if label is not None else None, START if label is not None else None, a) for e, m, p, label, a in rows]
    return spark.createDataFrame(made, "event_id long, changed_at timestamp, model_prediction int, human_label int, label_source string, labeled_at timestamp, attack_event_id string")


def seen(df):
    columns = ("event_id", "model_prediction", "human_label", "label_source", "labeled_at", "attack_event_id", "uri", "status")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def plain(ids, batches):
    """Every change in order of time, batch and value, column by column."""
    state = {}
    for batch, rows in batches.items():
        for e, m, p, label, a in rows:
            for name, v in (("p", p), ("l", label), ("a", a)):
                if v is not None and e is not None:
                    state[e, name] = max(state.get((e, name), (-1, -1, v)), (m, batch, v))
    def value(e, name):
        return state[e, name][2] if (e, name) in state else None
    rows = []
    for e in ids:
        label = value(e, "l")
        marked = (label, "manual", START) if label is not None else (None, None, None)
        rows.append((e, value(e, "p"), *marked, value(e, "a"), "uri-x", 1))
    return sorted(rows, key=repr)


def test_random_changes_before_and_after_compaction(spark, tmp_path):
    rng = random.Random(5)
    path, ids, batches = f"{tmp_path}/store", [], {}
    pick = lambda *of: rng.choice((None, *of))
    for batch in range(8):
        if batch % 2 == 0:
            fresh = list(range(batch * 10, batch * 10 + 10)) + [None]
            cs.append_events(events(spark, fresh), path, batch)
            ids += fresh
        made = [(rng.randrange(80), rng.randrange(6), pick(0, 1), pick(0, 1), pick("a", "b")) for _ in range(25)]
        batches[batch] = made
        cs.append_changes(changes(spark, made), path, batch)
        assert seen(cs.read_events(spark, path)) == plain(ids, batches)
        if batch in (2, 3, 6):
            opened = cs.read_events(spark, path)
            cs.compact(spark, path, batch - (batch == 6))
            assert seen(opened) == seen(cs.read_events(spark, path)) == plain(ids, batches)
    cs.vacuum(spark, path, 1)
    assert seen(cs.read_events(spark, path)) == plain(ids, batches)
    assert cs.latest_version(spark, path) == (2, 5)
    kept = {kind: sorted(p.name for p in (tmp_path / "store" / kind).glob("*=*")) for kind in ("base", "rows", "changes")}
    assert kept == {"base": ["version=2"], "rows": ["batch_id=6"], "changes": ["batch_id=6", "batch_id=7"]}


def test_older_change_in_a_later_batch_does_not_win(spark, tmp_path):
    path = f"{tmp_path}/store"
    cs.append_events(events(spark, [1]), path, 0)
    cs.append_changes(changes(spark, [(1, 9, 1, 1, None)]), path, 1)
    cs.compact(spark, path, 1)
    cs.append_changes(changes(spark, [(1, 5, 0, None, "late")]), path, 2)
    assert seen(cs.read_events(spark, path)) == plain([1], {1: [(1, 9, 1, 1, None)], 2: [(1, 5, 0, None, "late")]})


def test_change_waits_for_its_event(spark, tmp_path):
    path = f"{tmp_path}/store"
    cs.append_events(events(spark, [1]), path, 0)
    cs.append_changes(changes(spark, [(2, 1, 1, 0, "z")]), path, 1)
    cs.compact(spark, path, 1)
    cs.append_events(events(spark, [2]), path, 2)
    expected = plain([1, 2], {1: [(2, 1, 1, 0, "z")]})
    assert seen(cs.read_events(spark, path)) == expected
    cs.compact(spark, path, 2)
    assert seen(cs.read_events(spark, path)) == expected


def test_batches_written_again_and_refused(spark, tmp_path):
    path = f"{tmp_path}/store"
    with pytest.raises(ValueError):
        cs.read_events(spark, path)
    for _ in range(2):
        cs.append_events(events(spark, [1, 2]), path, 0)
    assert seen(cs.read_events(spark, path)) == plain([1, 2], {})
    assert cs.compact(spark, path, 0) == 0
    assert seen(cs.read_events(spark, path)) == plain([1, 2], {})
    for again in (lambda: cs.append_events(events(spark, [3]), path, 0), lambda: cs.compact(spark, path, 0), lambda: cs.vacuum(spark, path, 0)):
        with pytest.raises(ValueError):
            again()
    with pytest.raises(ValueError):
        cs.append_changes(spark.createDataFrame([(1, START)], "event_id long, changed_at timestamp"), path, 1)
    wrong = changes(spark, [(1, 1, 1, 1, None)])
    for bad in (wrong.withColumn("label_source", F.lit("guess")), wrong.withColumn("event_id", F.lit(None).cast("long"))):
        with pytest.raises(Exception, match="unknown label source|change without event_id"):
            cs.append_changes(bad, path, 1)


def test_feedback_labels_all_events_of_an_attack(spark, tmp_path):
    path = f"{tmp_path}/store"
    cs.append_events(events(spark, [1, 2, 3]), path, 0)
    links = spark.createDataFrame([(1, "7"), (2, "7"), (3, "8")], "event_id long, attack_event_id string")
    cs.append_changes(cs.link_changes(links, F.lit(START)), path, 1)
    clicks = [("7", 1, START, "attack_yes"), ("7", 2, START + timedelta(hours=1), "attack_no"), ("8", 3, START, "attack_yes")]
    feedback = spark.createDataFrame(clicks, "attack_event_id string, click_id long, clicked_at timestamp, action string")
    cs.append_changes(cs.feedback_changes(cs.read_events(spark, path), feedback), path, 2)
    got = {r.event_id: (r.human_label, r.label_source, r.labeled_at) for r in cs.read_events(spark, path).collect()}
    late = START + timedelta(hours=1)
    assert got == {1: (0, "telegram", late), 2: (0, "telegram", late), 3: (None, None, None)}
