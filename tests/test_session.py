"""Session set-up from several threads."""

import threading
from concurrent.futures import ThreadPoolExecutor

from anomspark import session


def test_package_is_shipped_once_by_many_threads(spark, monkeypatch):
    sent, start = [], threading.Barrier(6)

    def add(path):
        sent.append(path)
        threading.Event().wait(0.2)  # the time in which another thread could ship it too

    sc = spark.sparkContext
    monkeypatch.setattr(sc, "addPyFile", add)
    monkeypatch.setattr(sc, "_anomspark_shipped", False, raising=False)

    def one(_):
        start.wait()
        session.ship_package(spark)
    with ThreadPoolExecutor(max_workers=6) as pool:
        list(pool.map(one, range(6)))
    assert len(sent) == 1
