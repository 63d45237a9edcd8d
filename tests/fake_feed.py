"""A fetcher for the tests of the feed: days as they are, each stretch repeating its first day."""

import datetime as dt


def fetch(symbol, start, end, interval):
    day, last = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
    if symbol == "NONE":
        return
    k = ord(symbol[0])
    yield day, 1, 2, 1, 1, None  # replaced by what follows: the last of a time counts
    while day < last:
        if day.weekday() < 5:
            yield day, k, k + 2, k - 1, k + (day.day % 2), 10
        day += dt.timedelta(days=1)
    yield last, None, 1, 1, 1, 1  # no open: dropped


def broken(symbol, start, end, interval):
    yield dt.datetime.fromisoformat(start), 10, 9, 8, 10, 1  # high below open
