import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session("tests", 8, **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        # Fixtures hold a few rows: compiling their plans would take longer than running them.
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    })


@pytest.fixture
def rows_of():
    def rows(df, *order):
        return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]

    return rows
