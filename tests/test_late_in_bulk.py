"""Late events that may change very many answers."""

import random

import pytest

from nightledger.operators.keywords import keyword_extract
from nightledger.operators.snapshot import event_snapshot, observe_events
from nightledger.plans import fixtures as fx
from nightledger.schema import EXPOSURE_END, EXPOSURE_START
from nightledger.session import scratch
from nightledger.sources import archive as store
from nightledger.sources import files
from nightledger.streaming import exposure
from tests import helpers as h

SECOND = 10**6


def archived(spark, root, rows):
    store.write_archive(store.archive_rows(h.landed(spark, rows)), f"{root}/archive", mode="overwrite")
    return store.read_archive(spark, f"{root}/archive", fx.EVENT)


@pytest.mark.parametrize("seed", [41])
def test_answers_are_not_merged_row_by_row(spark, monkeypatch, seed):
    """Events over 40 minutes in any order: nearly all are late, and most answers change; answered anew by time, not by a join."""
    rng, names = random.Random(seed), []
    rows = []
    for i in range(160):
        at = rng.randrange(2400) * SECOND
        if i % 4 == 3:
            exposure_id = f"2020A-001-123-{rng.choice(['IRIS', 'WFOS'])}-IMG-SCI0-{i:04d}"
            rows.append(h.observe(f"o{i}", at, exposure_id, rng.choice([EXPOSURE_START, EXPOSURE_END])))
        else:
            rows.append(h.event(f"e{i}", f"event_key_{rng.choice([1, 3, 5])}", at, i, "ESW.filter"))

    def noted(session, name):
        names.append(name)
        return scratch(session, name)

    monkeypatch.setattr(exposure, "scratch", noted)
    monkeypatch.setattr(exposure, "MERGED_ANSWERS", 0, raising=False)
    root = scratch(spark, "bulk")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    seen = []
    for batch_id in range(4):
        part = rows[batch_id * 40 : batch_id * 40 + 40]
        seen += part
        exposure.process_batch(h.landed(spark, part), batch_id, root, fx.mappings, 60)
        if batch_id in (1, 3):
            archive = archived(spark, root, seen)
            assert exposure.reconcile(spark, root, archive, fx.PARAMS, fx.mappings) > 0
            assert exposure.reconcile(spark, root, archive, fx.PARAMS, fx.mappings) == 0
            stored = exposure.stored_snapshots(spark, root, fx.PARAMS)
            assert h.snapshot_dict(stored) == h.brute_force_snapshot(seen)
            assert stored.count() == len(h.brute_force_snapshot(seen))
    assert "reconciled" not in names and "asked" in names
    bus = h.bus(spark, rows)
    observes = observe_events(bus)
    values = keyword_extract(observes, event_snapshot(bus, observes=observes), fx.mappings(spark))
    stored = exposure.stored_keyword_values(spark, root).select(values.columns)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, values.collect()))


def test_a_reconciliation_that_failed_is_repeated_whole(spark, monkeypatch):
    """Its answers to late observe events are stored, but not noted: the next run gives one answer to each."""
    rows = [h.event("c9", "c", 900 * SECOND), h.observe("o950", 950 * SECOND)]
    late = [h.event("c0", "c", 0), h.observe("o50", 50 * SECOND), h.event("d", "d", 10 * SECOND)]
    monkeypatch.setattr(exposure, "MERGED_ANSWERS", 0, raising=False)
    root = scratch(spark, "failed-bulk")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    for batch_id, part in enumerate([rows, late]):
        exposure.process_batch(h.landed(spark, part), batch_id, root, None, 60)
    archive = archived(spark, root, rows + late)

    def failing(*_):
        raise OSError("lost")

    write = files.write_json
    monkeypatch.setattr(files, "write_json", failing)
    with pytest.raises(OSError, match="lost"):
        exposure.reconcile(spark, root, archive, fx.PARAMS)
    monkeypatch.setattr(files, "write_json", write)
    assert exposure.reconcile(spark, root, archive, fx.PARAMS) > 0
    stored = exposure.stored_snapshots(spark, root, fx.PARAMS)
    assert h.snapshot_dict(stored) == h.brute_force_snapshot(rows + late)
    assert stored.count() == len(h.brute_force_snapshot(rows + late))


def test_keyword_values_are_read_without_a_shuffle(spark):
    rows = [h.event("e", "event_key_1", 0, 5, "ESW.filter"), h.observe("o", 10)]
    root = scratch(spark, "read")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    exposure.process_batch(h.landed(spark, rows), 0, root, fx.mappings, 60)
    values = exposure.stored_keyword_values(spark, root)
    assert values.count() > 0 and "Exchange hashpartitioning" not in h.plan(values)
