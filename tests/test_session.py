from __future__ import annotations

from types import SimpleNamespace

import pytest

from stallwise import session


@pytest.mark.parametrize("master,local", [("local", True), ("local[*]", True), ("local[8,3]", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)])
def test_a_temporary_folder_is_for_one_machine(master, local, tmp_path):
    set_to = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: set_to[-1] if set_to else None, setCheckpointDir=set_to.append)
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    if local:
        assert session.shared_dir(spark) == set_to[0]
    else:
        with pytest.raises(RuntimeError):
            session.shared_dir(spark)
    named = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: "/shared"))
    assert session.shared_dir(named) == "/shared"
