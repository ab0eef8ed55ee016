"""The dense grid at a size at which it was once left sparse."""

from binforge.operators import hist


def test_large_grid_keeps_empty_bins(spark):
    got = hist.h(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double"), ["x", "y"], 2001)
    assert got.columns == ["bin0", "left0", "right0", "bin1", "left1", "right1", "frequency", "error2"]
    assert got.count() == 2001 * 2001 and got.where("frequency > 0").count() == 2
