"""Remembered records as a table, against the scan of a client's records at hand."""

from __future__ import annotations

import random

import pytest

from ledgerloom.plans import memory, record_log

REQUEST = "request_id long, client_id string, signature string, headers string"


def layouts(rng, n):
    for _ in range(n):
        size = rng.randint(1, 9)
        yield f"{size}:{','.join(rng.choice(record_log.TAGS[:4]) for _ in range(size))}", "|".join(rng.choice(["invoice no", "invoice num", "date", "igst", "cgst", "name", "∅"]) for _ in range(size))


def drifted(rng, signature, headers):
    tags, names = signature.split(":")[1].split(","), headers.split("|")
    at = rng.randrange(len(tags))
    if rng.random() < 0.5:
        tags[at] = rng.choice(record_log.TAGS)
    else:
        tags.insert(at, "TEXT_OTHER")
        names.insert(at, "extra")
    return f"{len(tags)}:{','.join(tags)}", "|".join(names)


def test_lookups_equal_the_scan(spark):
    rng = random.Random(6)
    records, requests = {}, []
    for n, (signature, headers) in enumerate(layouts(rng, 120)):
        client = rng.choice("xy")
        records.setdefault((client, signature), memory.Record(client, signature, headers, f"s{n}", f"label {n}", f"2024-01-01T00:{n // 60:02}:{n % 60:02}"))
    for r in [*records.values()]:
        requests += [(r.client_id, r.signature, r.headers), (rng.choice("xyz"), *drifted(rng, r.signature, r.headers))]
    table = spark.createDataFrame([tuple(vars(r).values()) for r in records.values()], memory.SCHEMA)
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], REQUEST)
    got = {r["request_id"]: (r["via"], r["label"]) for r in record_log.lookup(asked, [table]).collect()}
    store, want = memory.Memory(records.values()), {}
    for i, (client, signature, headers) in enumerate(requests):
        if found := store.exact(client, signature):
            want[i] = ("exact", found.label)
        elif found := store.similar(client, signature, headers):
            want[i] = ("fuzzy", found.label)
    assert got == want and sum(v[0] == "fuzzy" for v in want.values()) > 20


def test_entries_are_appended_changed_and_forgotten(spark, tmp_path):
    log = record_log.RecordLog(spark, str(tmp_path / "log"))
    row = lambda label, signature="1:BLANK", at="1": spark.createDataFrame([("me", signature, "h", "s", label, at)], memory.SCHEMA)
    assert log.current().isEmpty() and log.of_client("me").records == []
    log.remember(row("a"))
    log.remember(row("b", at="2"))
    log.remember(row("c", "1:NUM_LOW"))
    assert {(r["signature"], r["label"], r["created_at"]) for r in log.current().collect()} == {("1:BLANK", "b", "1"), ("1:NUM_LOW", "c", "1")}
    log.forget(row("x"))
    assert [r.label for r in log.of_client("me").records] == ["c"] and log.of_client("you").records == []
    log.remember(row("d", at="3"))
    assert {(r["label"], r["created_at"]) for r in log.current().collect()} == {("c", "1"), ("d", "3")}
    with pytest.raises(ValueError):
        log.remember(row(" "))


def test_tiers_are_written_one_by_one_and_read_by_priority(spark, tmp_path):
    first, second = (record_log.RecordLog(spark, str(tmp_path / name)) for name in ("first", "second"))
    tiers = record_log.Tiers(first, second)
    row = lambda label, signature: spark.createDataFrame([("me", signature, "date|igst", "s", label, "1")], memory.SCHEMA)
    second.remember(row("old", "2:DATE_PERIODIC,NUM_LOW"))
    asked = spark.createDataFrame([(1, "me", "2:DATE_PERIODIC,NUM_LOW", "date|igst")], REQUEST)
    assert tiers.lookup(asked).first()["tier"] == 1
    tiers.remember(row("new", "2:DATE_PERIODIC,NUM_LOW"))
    assert tuple(tiers.lookup(asked).first())[1:3] == ("exact", 0) and second.current().first()["label"] == "new"

    class Away(record_log.RecordLog):
        def current(self):
            raise OSError("no store")

        def _append(self, rows):
            raise OSError("no store")

    away = Away(spark, "nowhere")
    record_log.Tiers(first, away).remember(row("kept", "2:DATE_PERIODIC,NUM_LOW"))
    assert record_log.Tiers(away, first).lookup(asked).first()["label"] == "kept"
    with pytest.raises(OSError):
        record_log.Tiers(away, second).remember(row("both tried", "2:DATE_PERIODIC,NUM_LOW"))
    assert second.current().first()["label"] == "both tried"
    record_log.Tiers(first, second).forget(asked)
    assert tiers.lookup(asked).isEmpty()
