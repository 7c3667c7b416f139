"""Cells as keyed state against the batch view."""

import datetime
import random
from decimal import Decimal

from ledgerloom import schemas
from ledgerloom.operators import facts
from ledgerloom.streaming import cells


def batch(r, n, first):
    rows = []
    for k in range(n):
        value = r.choice([None, Decimal(r.randrange(40)), Decimal("7.005"), Decimal("7.015")])
        rows.append((r.choice(["a", "b", None]), "income", f"line {r.randrange(5)}", datetime.date(2020 + r.randrange(3), 12, 31), r.choice([12, 12, None]), value, r.choice(["EUR", None]), "units", f"s{first + k}", r.choice([2021, 2022, 2023, None]), False, first + k))
    r.shuffle(rows)
    return rows


def test_state_equals_the_batch_view_after_a_restart(spark, tmp_path):
    r = random.Random(4)
    incoming, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "cp"))
    stored = None
    for n in range(3):  # each call is a restart from the checkpoint
        own = spark.createDataFrame(batch(r, 60, 1000 * n), schemas.FACTS).repartition(1)
        own.write.mode("append").parquet(incoming)
        stored = facts.upsert(stored, own)
        query = cells.cell_stream(spark, incoming, log, checkpoint)
        query.awaitTermination(180)
        assert query.exception() is None
        want = facts.consolidated(stored)
        columns = sorted(want.columns)
        got = cells.current_cells(spark, log)
        assert sorted(got.columns) == columns
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert got.where("is_restated").count() > 3 and got.where("not is_restated").count() > 3
    assert cells.current_cells(spark, str(tmp_path / "nothing")).count() == 0
