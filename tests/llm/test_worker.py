from __future__ import annotations

import pyarrow as pa

from runlens.llm import worker


def test_one_operators_model_is_held_at_a_time():
    made = []

    def make(name):
        return lambda: made.append(name) or name

    assert [worker.held(n, make(n)) for n in ("a", "a", "b", "a")] == ["a", "a", "b", "a"]
    assert made == ["a", "b", "a"]
    worker.leave("a")
    assert list(worker._held) == ["a"]
    assert list(worker.tidy(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert not worker._held
    assert worker.tidy_group(lambda group: group + 1, "x")(1) == 2


def test_slices_hold_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, 5, 7)]
    found = [b.column(0).to_pylist() for b in worker.sliced(iter(batches), 3)]
    assert found == [[0], [0, 1, 2], [3, 4], [0, 1, 2], [3, 4, 5], [6]]
