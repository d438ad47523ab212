import numpy as np
import pandas as pd
import pytest

from barloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk() -> pd.DataFrame:
    """Two tickers of 420 random-walk bars."""
    rng = np.random.default_rng(7)
    parts = []
    for ticker in ("A", "B"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 420)))
        open_ = close * np.exp(rng.normal(0, 0.01, 420))
        high = np.maximum(open_, close) * 1.01
        low = np.minimum(open_, close) * 0.99
        dates = pd.date_range("2020-01-01", periods=420).date
        volume = rng.integers(100, 1000, 420).astype(float)
        parts.append(pd.DataFrame(dict(ticker=ticker, date=dates, open=open_, high=high, low=low, close=close, volume=volume)))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, walk):
    return spark.createDataFrame(walk).cache()


def ordered(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)
