import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    from tessera.session import session

    s = session("tests", cores=4, shuffle_partitions=4, conf={"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoint')}", "spark.local.dir": str(tmp_path_factory.mktemp("local")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
    s.stop()
