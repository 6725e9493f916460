"""What a cycle of reflection costs, and the rows that it numbers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.functions import shared
from assayer.operators import claims, resolve, search
from assayer.plans import library


def outcome(spark, cycles):
    asked = claims.parse(spark.createDataFrame([(1, "Walks improve mood."), (2, "Stone circles improve weather.")], "request_id int, text string")).withColumn("claim_id", F.col("request_id"))
    return resolve.resolve(asked, resolve.Library.of(library.docs(spark), library.trust(spark)), resolve.empty_memory(spark), library.NOW, cycles=cycles)


def test_a_cycle_writes_few_tables(spark, monkeypatch):
    written, new_path = [], shared.new_path
    monkeypatch.setattr(shared, "new_path", lambda session: written.append(new_path(session)) or written[-1])
    outcome(spark, 0)
    without, written[:] = len(written), []
    out = outcome(spark, 3)
    turns = out.cycles.agg(F.max("cycles")).first()[0]
    assert turns >= 1 and len(written) - without <= 9 * turns + 1  # they were 17 a cycle


def test_rows_are_numbered_alike_by_one_task_and_by_ranges(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, outcome(spark, 0).memory.collect()))
    alone = rows()
    assert sorted(r[-1] for r in alone) == list(range(1, len(alone) + 1))
    monkeypatch.setattr(resolve, "ONE_TASK", 0)
    assert rows() == alone


def test_codes_are_packed_and_no_two_stems_share_one(spark, monkeypatch):
    code = search._code
    monkeypatch.setattr(search, "_code", lambda stem, seed: code(F.lit("a"), 0) if seed == 0 else code(stem, seed))
    docs = spark.createDataFrame([(k, f"green tea {k}", None if k == 3 else "x/y") for k in range(10, 20)] + [(3, "black tea", None), (4, None, "x/y")], "doc long, text string, locator string")
    shelf = search.Shelf.of(docs)
    assert shelf.seed == 1
    asked = spark.createDataFrame([(1, "black tea", 1), (2, "green tea 12", 2), (3, "zz", 2)], "query_id long, query string, most int")
    assert sorted((r["query_id"], r["doc"]) for r in shelf.top(asked, "most").collect()) == [(1, 3), (2, 12), (2, 19)]
    search.Shelf.of(docs, locator_col="locator").top(asked, "most").collect()  # a null locator leaves no stems
    lists = [[1, -2, 3], [], None, [2**62], [5, 6]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc", "codes"])
    monkeypatch.setattr(search, "PACKED", 2)
    out = list(search._packed([batch, batch.slice(3)]))
    assert len(out) > 2 and pa.Table.from_batches(out)["doc"].to_pylist() == [0, 1, 2, 3, 4, 3, 4]
    met = []
    for part in [*out, *[b.slice(1) for b in out]]:
        codes, ends = search._unpacked(part.column(1))
        met.append([x.tolist() for x in np.split(codes.to_numpy(), ends)[:-1]])
    assert sum(met[: len(out)], []) == [x or [] for x in [*lists, *lists[3:]]]
    assert [len(m) for m in met] == [b.num_rows for b in out] + [max(0, b.num_rows - 1) for b in out]
