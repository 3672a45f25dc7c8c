import pytest
from compare import compare

from tapeqc.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries without SQL, and the tests that hold their operators against plain Python.
PLAIN = {
    "T9_settle_periods": "test_rules.py::test_settled_periods",
    "T8_shift_periods": "test_rules.py::test_shifted_periods",
    "T10_sample_targeted": "test_rules.py::test_targeted_samples",
    "W3_detect_bars_guided": "test_refine.py::test_guided_bars",
    "W16_tc_subregions": "test_rules.py::test_subregions",
    "W17_refine_gaps": "test_refine.py::test_refined_gaps",
    "W18_timecode_consensus": "test_rules.py::test_consensus",
}


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    good, said = compare(spark, name, SF)
    assert good, said
    assert ": 0 rows" not in said, said


def test_every_query_is_checked(request):
    assert {n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL} == set(PLAIN)
    here = request.path.parent
    for place in PLAIN.values():
        file, _, test = place.partition("::")
        assert f"def {test}(" in (here / file).read_text(), place


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
