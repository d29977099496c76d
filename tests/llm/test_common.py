import pathlib
import types

import pytest

from tidemark.llm import common


def test_configured_folder(spark):
    at = spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(spark) == at
    t = common.written(spark.range(5), "five")
    path = pathlib.Path(t.written_to.removeprefix("file:"))
    assert t.written_to.startswith(f"{at}/tables/five-") and t.count() == 5 and path.exists()
    common.dropped(t)
    assert not path.exists()
    before = set(path.parent.glob("edges-*"))
    got = {r.node: r.comp for r in common.components(spark.createDataFrame([(1, 2), (3, 2)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1} and len(set(path.parent.glob("edges-*")) - before) == 1


@pytest.mark.parametrize("master,fine", [("local", True), ("local[4]", True), ("local-cluster[3,2,3000]", False), ("spark://host:7077", False), ("yarn", False)])
def test_no_folder_of_one_machine_on_a_cluster(master, fine):
    empty = types.SimpleNamespace(isEmpty=lambda: False)
    sc = types.SimpleNamespace(master=master, applicationId=master, _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: empty)))
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: d), sparkContext=sc)
    if fine:
        assert common.shared_dir(session)
    else:
        with pytest.raises(ValueError):
            common.shared_dir(session)


def test_components_do_not_stop_early(spark):
    with pytest.raises(RuntimeError):
        common.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), most=1)


def test_row_keys(spark):
    d = spark.createDataFrame([(2**60, "b"), (5, "a")], "doc_id long, text string")
    assert common.with_row_key(d, "doc_id", "text").own_ids
    k = common.with_row_key(d.union(d), "doc_id", "text")
    assert not k.own_ids and sorted(r.rid for r in k.collect()) == [0, 1, 2, 3]
