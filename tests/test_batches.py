"""Work on rows in slices of bounded size."""

import pyarrow as pa
import pytest

from lakeloom.functions.batches import BYTES, slices
from lakeloom.operators import bibliography, elements, segments
from lakeloom.sources import yaml_text


def test_slices_hold_all_rows_in_order_and_are_bounded():
    texts = ["x" * n for n in (10, 500, 0, 90, 2000, 1, 1)] * 3 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "t"])
    got = list(slices([batch, batch.slice(0, 0), batch], 1, most=700))
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(len(texts))] * 2
    assert [x for b in got for x in b.column(1).to_pylist()] == texts * 2
    assert all(b.num_rows and (b.num_rows == 1 or sum(len(t or "") + 64 for t in b.column(1).to_pylist()[1:]) <= 700) for b in got)


class _Rows:
    """Takes the place of a DataFrame and keeps the function that reads its batches."""

    dtypes = [("id", "bigint")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


@pytest.mark.parametrize("step", ["elements", "tokens", "yaml", "bibtex"])
def test_steps_make_objects_of_a_slice_at_a_time(spark, step):
    """Each made Python objects of all rows of a batch at once, up to ten thousand texts."""
    text, apply = {
        "elements": ("<p class=a>x</p>" * 300, lambda rows: elements.elements(rows, "id", "t")),
        "tokens": ("see 12, 13! " * 300, lambda rows: segments.tokens(rows, "id", "t", (segments.Rule("number", r"\d+"),))),
        "yaml": ("a:\n  - b: 1\n" * 300, lambda rows: yaml_text.yaml_paths(rows, "id", "t")),
        "bibtex": ("@a{k, t = {x}}\n" * 300, lambda rows: bibliography.entries(rows, "id", "t")),
    }[step]
    n = 1200
    rows = _Rows()
    apply(rows)
    got = list(rows.run([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n)], names=["id", "t"])]))
    most = BYTES // len(text) + 1
    ids = [list(dict.fromkeys(b.column(0).to_pylist())) for b in got]
    assert [i for part in ids for i in part] == [*range(n)] and max(map(len, ids)) <= most < n
