import pytest

from lattika.plans import timeplan
from lattika.plans.spec import LEVELS, CubeSpec, TaskPhase, cube_of, cuboid_name, identical_name, level, parent, parents, progress


def names(spec):
    return [cuboid_name(c) for c in spec.lattice()]


TIME = ":".join(LEVELS)


@pytest.mark.parametrize(
    ("dims", "rules", "expected"),
    [
        ("a:string|b:string|c:string", {}, ["a:b:c", "b:c", "a:c", "a:b", "c", "b", "a", ""]),
        ("country:string|province:string|city:string", {"hierarchies": "country:province:city"}, ["city:country:province", "country:province", "country", ""]),
        ("a:string|b:string|c:string", {"joints": "a:b"}, ["a:b:c", "a:b", "c", ""]),
        ("a:string|b:string|c:string", {"mandatory": "c"}, ["a:b:c", "b:c", "a:c", "c"]),
        ("a:string|b:string,c:string", {}, ["a:b:c", "b:c", "a", ""]),
        ("b:string|a:string|OLAP_OPERATION:string", {}, ["OLAP_OPERATION:a:b", "a:b", "OLAP_OPERATION:a", "OLAP_OPERATION:b", "OLAP_OPERATION", "a", "b", ""]),
        ("a:string|z:string", {"index": "z"}, ["z:a", "z", "a", ""]),
        ("t:timestamp|flag:string", {"time": "t"}, [f"{TIME}:flag", "flag", TIME, ""]),
        ("x:string|y:string|b:string|a:string", {"hierarchies": "x:y:b", "joints": "a:b"}, ["a:b:x:y", "a:b:x", "x:y", "a:b", "x", ""]),
    ],
)
def test_lattice(dims, rules, expected):
    assert names(CubeSpec.parse("s.t", dims, "m:double", **rules)) == expected


def test_time_depths_add_coarser_cuboids():
    spec = CubeSpec.parse("s.t", "t:timestamp|flag:string", "m:double", time="t", time_depths=(1,))
    assert f"{LEVELS[0]}:flag" in names(spec)
    assert LEVELS[0] in names(spec)


def test_bad_specs():
    with pytest.raises(ValueError, match="no declared"):
        CubeSpec.parse("s.t", "a:string", "m:double", time="a")
    with pytest.raises(ValueError, match="twice"):
        CubeSpec.parse("s.t", "a:string|a:string", "m:double")
    with pytest.raises(ValueError, match="isn't declared"):
        CubeSpec.parse("s.t", "a:string", "m:double", mandatory="q")


def test_parents_prefer_few_rows_then_few_dimensions():
    lattice = [("a", "b", "c"), ("a", "b"), ("a", "c"), ("a",), ()]
    assert parents(lattice)[("a",)] == ("a", "b")
    assert parent(("a",), {("a", "b", "c"): 5, ("a", "b"): 9, ("a", "c"): 7}) == ("a", "b", "c")
    assert parent(("a", "b", "c"), {("a", "b", "c"): 1}) is None
    assert parent(("a",), {("OLAP_OPERATION", "a"): 1, ("a", "b"): 9}, strict=True) == ("a", "b")


@pytest.mark.parametrize(
    ("literals", "depth"),
    [(["2021"], 1), (["2020"], 0), (["2021-10"], 2), (["2021-10-00"], 2), (["2021-10-10"], 3), (["2021-01-01 00:00:00"], 3), (["2021-01-01 10:00:00", "2021-02-01 00:00:00"], 4), (["2021-01-01 10:30:00.000"], 5), (["2021-01-01 10:30:00.010"], 7), ([], 7)],
)
def test_depth(literals, depth):
    assert timeplan.depth_of(literals) == depth


def test_prefix_and_depth_in():
    text = "2021-10-05 00:00:00"
    assert [timeplan.prefix(text, n) for n in range(4)] == [None, '["2021"', '["2021","10"', '["2021","10","05"']
    assert timeplan.prefix(text, 7).endswith('"000"')
    assert timeplan.needed_depth(["2020"]) == 1
    assert timeplan.depth_in([LEVELS[0], LEVELS[1], LEVELS[3]]) == 2


def test_levels_names_and_progress():
    assert [level(n) for n in (1, 499_999, 500_000, 2_499_999, 2_500_000, 12_500_000, 62_500_000)] == [0, 0, 0, 0, 1, 2, 3]
    assert level(500_000 * 5**25) is None
    assert cube_of(identical_name("a-b.c", 7)) == ("a-b.c", 7)
    assert [progress(TaskPhase.EXECUTING, 5, 10), progress(TaskPhase.READY, 0, 0), progress(TaskPhase.CREATED, 1, 0)] == [0.5, 1.0, 0.0]
