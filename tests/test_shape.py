"""Golden values of selections, merges, formats and clock widths."""

import math

import pandas as pd
import pytest

from binforge.functions import binning as B
from binforge.operators import hist, shape
from binforge.sources import formats

EDGES, FREQ = [1.2, 1.4, 1.5, 1.7, 1.8], [4.0, 0.0, 3.0, 7.2]


@pytest.fixture(scope="module")
def example(spark):
    rows = [(k, a, b, f, f) for k, (a, b, f) in enumerate(zip(EDGES, EDGES[1:], FREQ))]
    return spark.createDataFrame(rows, "bin long, left double, right double, frequency double, error2 double").cache()


def column(df, name, by="bin"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_slices_and_masks(example):
    assert column(shape.slice_bins(example, 1, 3), "frequency") == [0.0, 3.0]
    assert shape.dropped(example, 1, 3).first()[:] == (4.0, 7.2)
    got = shape.pick_bins(example, example.frequency > 0)
    assert column(got, "left") == [1.2, 1.5, 1.7] and column(got, "bin") == [0, 1, 2]
    assert column(hist.cumulative(example), "cumulative") == pytest.approx([4, 4, 7, 14.2])


def test_merge_sparse(example):
    got = shape.merge_sparse(example, 3.5)
    assert column(got, "frequency") == pytest.approx([4, 3, 7.2])
    assert column(got, "left") == [1.2, 1.4, 1.7]
    assert shape.merge_sparse(example.where("bin < 0"), 3.5).count() == 0


def test_formats(spark, example, tmp_path):
    formats.save_json(example, str(tmp_path / "h"), name="example")
    back = formats.load_json(spark, str(tmp_path / "h"))
    assert sorted(back.collect()) == sorted(example.collect()) and shape.same_bins(example, back)
    assert not shape.same_bins(example, example.where("bin > 0"))
    with pytest.raises(ValueError):
        formats.from_dict(spark, {"version": formats.VERSION + 1})
    table = formats.to_pandas(example)
    assert formats.binning_from_index(table.index).edges == EDGES
    with pytest.raises(ValueError):
        formats.binning_from_index(pd.interval_range(0, 3, closed="right"))
    b = B.from_edges(EDGES)
    assert formats.binning_from_dict(formats.binning_to_dict(b)) == b


def test_geant4(spark, tmp_path):
    head = "#class h1d\n#title t\n#dimension 1\n#axis fixed 2 0 8\n#bin_number 4\nentries,Sw,Sw2,Sxw0,Sx2w0\n"
    (tmp_path / "h.csv").write_text(head + "0,0,0,0,0\n1,1,1,.1,.1\n2,3,5,9,9\n1,2,4,9,9\n")
    got = formats.load_geant4(spark, str(tmp_path / "h.csv"))
    assert column(got, "frequency") == [0, 1, 3, 2] and column(got, "left") == [None, 0, 4, None]


def test_pretty_widths():
    raw = [1.1, 2.4, 32, 57, 2000, 3621, 85000]
    assert [B.pretty_width(x) for x in raw] == [1, 2.5, 25, 50, 2000, 5000, 1e5]
    assert [B.pretty_time_width(x) for x in raw] == [1, 2, 30, 60, 1800, 3600, 86400]
    assert math.isclose(B.fixed_width(4.6, 7.3, 1.0, align=False).edges[-1], 7.6)
