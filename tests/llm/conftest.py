import os

import pytest


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables")
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(sf_dir):
    import pandas as pd

    return pd.read_parquet(f"{sf_dir}/documents.parquet")
