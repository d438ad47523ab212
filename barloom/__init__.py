"""barloom: analytics over panels of price bars (ticker x date) as PySpark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` usable through ``df.transform``. Rows are keyed
by ``(ticker, date)`` (or ``(model, ticker, date)`` once scores are involved) and always joined on those
keys, never by position in a frame.
"""
