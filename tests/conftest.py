import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dossierlens.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "local[4]",
        4,
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


def record(title="T", body="", extra=""):
    return (
        f"\n  <page>\n    <title>{title}</title>{extra}\n    <revision>"
        f'\n      <text xml:space="preserve">{body}</text>\n    </revision>\n  </page>'
    )
