"""The package's sources go to the executors once, however many threads ask for it at the same time."""

import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from tidegrid.shipping import ship


def test_threads_that_ask_at_once_ship_one_file():
    """A cluster refuses a second file of that name: 'already registered with a different path'."""
    sent = []

    def add(path):
        time.sleep(0.05)
        sent.append(path)

    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="threads", addPyFile=add))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(ship, [session] * 4))
    assert len(sent) == 1
