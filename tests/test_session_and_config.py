import dataclasses
import json
import os

import pytest

from tidemill import session
from tidemill.config import DEFAULTS, Settings


def test_tables_go_with_their_scope(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    with session.scratch(spark):
        kept = session.materialize(df, "x")
        cut = session.bucketed(df, "y", "k", 3)
        places = [f.removeprefix("file://").removeprefix("file:") for f in (kept.inputFiles()[0], cut.inputFiles()[0])]
        assert kept.count() == cut.count() == 10 and all(map(os.path.exists, places))
    assert not any(map(os.path.exists, places))


def test_no_machine_local_tables_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app-x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    Session.conf.get = staticmethod(lambda name, default=None: "hdfs://shared/dir/")
    assert session.shared_dir(Session()) == "hdfs://shared/dir/tidemill-app-x"


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"night": [22, 6], "burst_1h": 5}))
    s = Settings.read(str(path))
    assert s.night == (22, 6) and s.rules()["r4"] == "n_1h > 5" and " or " in s.rules()["r6"] and s.seed == DEFAULTS.seed
    path.write_text(json.dumps({"nigth": 1}))
    with pytest.raises(ValueError, match="nigth"):
        Settings.read(str(path))
    with pytest.raises(dataclasses.FrozenInstanceError):
        DEFAULTS.seed = 1
