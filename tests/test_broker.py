"""A broker's calls one after the other, over its tables."""

import pytest
from pyspark.sql import functions as F

from queuelens.sources.broker import TableBroker, write_lines

SCHEMA = "id string, name string, queue string, fairness_key string, payload binary, headers map<string,string>, attempt int, max_attempts int, eta_us long, dedup_key string, created_us long"


def message(name, **more):
    row = {"id": name, "name": "n", "queue": "q", "fairness_key": "", "payload": b"p", "headers": {"trace_id": "t"}, "attempt": 0, "max_attempts": 0, "eta_us": None, "dedup_key": "", "created_us": None} | more
    return tuple(row[c.split()[0]] for c in SCHEMA.split(", "))


def claims(spark, rows):
    return spark.createDataFrame(rows, "delivery_id string, caller string")


def test_life_of_messages(spark, tmp_path):
    b = TableBroker(spark, str(tmp_path / "b"))
    sent = b.publish(spark.createDataFrame([message("a", created_us=1), message("b", created_us=2, dedup_key="k"), message("c", created_us=3, dedup_key="k"), message("d", created_us=4, eta_us=500), message("e", queue="", created_us=5)], SCHEMA), 10)
    assert [(r.seq, r.id, r.queue) for r in sent.orderBy("seq").collect()] == [(1, "a", "q"), (2, "b", "q"), (3, "d", "q"), (4, "e", "default")]
    assert b.publish(spark.createDataFrame([message("f", dedup_key="k")], SCHEMA), 20).count() == 0
    first = b.reserve("q", "w1", 100, 30, 5).orderBy("seq").collect()
    assert [(r.delivery_id, r.delivery_count) for r in first] == [("d-1-1", 1), ("d-2-1", 1)]
    assert b.reserve("q", "w2", 100, 31, 5).count() == 0
    verdicts = {r.delivery_id: r.verdict for r in b.check(claims(spark, [("d-1-1", "w1"), ("d-2-1", "w2"), ("d-9-1", "w1")]), 40).collect()}
    assert verdicts == {"d-1-1": "ok", "d-2-1": "stale", "d-9-1": "unknown"}
    assert b.ack(claims(spark, [("d-1-1", "w1"), ("d-2-1", "w2")]), 40).count() == 1
    assert b.ack(claims(spark, [("d-1-1", "w1")]), 41).count() == 0
    b.extend(claims(spark, [("d-2-1", "w1")]), 300, 100)
    assert b.reserve("q", "w2", 100, 350, 5).count() == 0  # extended, not expired
    again = b.reserve("q", "w2", 100, 500, 5).orderBy("seq").collect()  # the lease ran out and the delayed one is due
    assert [(r.delivery_id, r.delivery_count) for r in again] == [("d-2-2", 2), ("d-3-1", 1)]
    assert b.check(claims(spark, [("d-2-1", "w1")]), 501).first().verdict == "unknown"
    b.nack(claims(spark, [("d-2-2", "w2")]), 510)
    back = b.reserve("q", "w3", 100, 520).first()
    assert (back.seq, back.delivery_count) == (5, 1)
    b.dead_letter(claims(spark, [(back.delivery_id, "w3")]), "permanent", "boom", 530)
    dead = b.dead_letters("q").first()
    assert (dead.envelope.original_task.id, dead.envelope.failure_class, dead.headers["dead_letter_trace_id"]) == ("b", "permanent", "t")
    assert b.replay("q", 540).count() == 1 and b.dead_letters("q").count() == 0
    last = b.messages().orderBy(F.desc("seq")).first()
    assert last.id == "b" and last.headers["dead_letter_replayed_from"] == dead.id and last.eta_us is None
    with pytest.raises(ValueError):
        b.publish(spark.createDataFrame([message("")], SCHEMA), 600)


def test_discard_and_lines(spark, tmp_path):
    b = TableBroker(spark, str(tmp_path / "b"))
    b.publish(spark.createDataFrame([message("a")], SCHEMA), 1)
    lease = b.reserve("q", "w", 10, 2).first()
    b.dead_letter(claims(spark, [(lease.delivery_id, "w")]), "timeout", "late", 3)
    assert [r.outcome for r in b.discard("q", 4).collect()] == ["discarded"] and b.dead_letters("q").count() == 0
    for _ in range(2):
        write_lines(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
