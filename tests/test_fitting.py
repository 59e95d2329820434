"""Images that a mode can't hold are told without packing all their sets."""

import pytest
from pyspark.sql import functions as F

from tileframe.operators import palettes

MOST, COUNT = 4, 3


@pytest.fixture(scope="module")
def sets(spark):
    """Image 0: fits. Image 1: thousands of sets of too many colours and small ones. Image 2: each set fits a subpalette, but there are too many. Image 3: exactly as many as fit."""
    rows = [(0, i, [1, 2 + i % 3]) for i in range(9)]
    rows += [(1, i, list(range(i, i + 5 + i % 7))) for i in range(3000)] + [(1, 3000 + i, [i, i + 1]) for i in range(20)]
    rows += [(2, i, list(range(4 * i, 4 * i + 4))) for i in range(500)] + [(3, i, list(range(4 * i, 4 * i + 4))) for i in range(COUNT)]
    return spark.createDataFrame(rows, "image_id long, seq int, colors array<long>")


def _maximal(sets):
    return palettes.maximal_sets(palettes.distinct_sets(sets))


def test_what_fits_is_what_full_packing_gives(sets):
    full = palettes.packed_within(_maximal(sets.where("image_id != 1 or seq < 200 or seq >= 3000")), F.lit(MOST))
    want = {r.image_id: r.palettes for r in full.collect()}
    told = {0: None, 1: "colors do not fit in a palette", 2: "colors do not fit in the available palettes", 3: None}
    got = palettes.fitted(_maximal(palettes.within(sets, MOST)), F.lit(MOST), F.lit(COUNT)).collect()
    assert {r.image_id: r.problem for r in got} == told
    assert max(map(len, want[1])) > MOST and len(want[2]) == 500 > COUNT and len(want[3]) == COUNT
    assert {r.image_id: r.palettes for r in got} == {k: None if told[k] else want[k] for k in want}


def test_sets_that_fit_nowhere_are_one_and_packing_ends(sets):
    left = _maximal(palettes.within(sets, MOST)).where("image_id = 1")
    assert left.where("colors is null").count() == 1 and left.count() <= 21
    found = palettes.packed_within(_maximal(palettes.within(sets, MOST)), F.lit(MOST), count=F.lit(COUNT))
    sizes = {r.image_id: r.n for r in found.select("image_id", F.size("palettes").alias("n")).where("palettes is not null").collect()}
    assert 1 not in sizes and sizes[2] == COUNT + 1
