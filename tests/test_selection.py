import pytest

from framelake.operators.selection import check_matches, compile_selection, select, summary

WATER = [(0, 0, "O", 0.0, 0.0, 0.0), (0, 1, "H", 0.96, 0.0, 0.0), (0, 2, "H", -0.24, 0.927, 0.0)]


@pytest.fixture()
def water(spark):
    return spark.createDataFrame(WATER, "frame long, atom_index long, type string, x double, y double, z double")


@pytest.mark.parametrize("text", ["i1", "i1,2,3", "i1-3", "i1, 2,  3", "i1-3,5,7-9", "aC", "aC_1,O2", "j1", "j1-3,2-4", "mM1,M2", "i1,2,2,3,1", "(aO) and (z > 40 and z < 80)", "not (aH)", "mM1 and z > 10", "aO,H", "x >= -1.5e1 OR NOT i3"])
def test_accepted(text):
    assert compile_selection(text).sql


@pytest.mark.parametrize("text", ["x1,2,3", "i3-1", "aC-N", "i-1", "j-1", "aC@#", "a*", "m*", "", "BADSEL", "i5-2", "not not aH", "aH and", "(aH", "aH)", "aH aO", "and aH", "i3abc", "aC,iB", "aC and mM1", "i1,j2"])
def test_rejected(text):
    with pytest.raises(ValueError) as e:
        compile_selection(text)
    assert not text or text in str(e.value)


@pytest.mark.parametrize("text, n", [("i0", 1), ("i0-2", 3), ("aO", 1), ("aO,H", 3), ("aH and x > 0", 1), ("not aO", 2), ("x < 0 or aO", 2), ("not aO and x < 0 or aO", 2), ("aH,i0", 3)])
def test_counts(water, text, n):
    assert select(water, text, strict=True).count() == n


@pytest.mark.parametrize("text", ["i99", "aFe", "aO,Fe"])
def test_no_match(water, text):
    with pytest.raises(ValueError, match="no entities"):
        check_matches(water, compile_selection(text))


def test_summary():
    assert summary("i3,5-9 or aC,H and x > 2") == {"atom_index": ["3", "5-9"], "type": ["C", "H"], "mol_index": [], "mol_type": []}
