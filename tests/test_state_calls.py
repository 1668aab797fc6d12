"""Stateful processors ask the state seldom: each call goes to the JVM and back."""

from types import SimpleNamespace

from pyspark.sql import Row

from repolore.streaming import assemble, jobs


class Handle:
    """State in memory that counts the calls."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, []

    def _called(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, *_):
        return SimpleNamespace(
            get=lambda: self._called(self.value), exists=lambda: self._called(self.value is not None),
            update=lambda v: self._called(setattr(self, "value", v)), clear=lambda: self._called(setattr(self, "value", None)),
        )

    def getMapState(self, *_):
        return SimpleNamespace(
            iterator=lambda: iter(self._called([((k,), v) for k, v in self.map.items()])), keys=lambda: iter(self._called([(k,) for k in self.map])),
            containsKey=lambda k: self._called(k[0] in self.map), getValue=lambda k: self._called(self.map[k[0]]),
            updateValue=lambda k, v: self._called(self.map.__setitem__(k[0], v)), removeKey=lambda k: self._called(self.map.pop(k[0])),
            clear=lambda: self._called(self.map.clear()),
        )

    def listTimers(self):
        return iter(self._called(list(self.timers)))

    def registerTimer(self, at):
        self._called(self.timers.append(at))

    def deleteTimer(self, at):
        self._called(self.timers.remove(at))


def _turn(processor, key, rows, at=0):
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: at, getCurrentProcessingTimeInMs=lambda: at)
    return [tuple(r) for r in processor.handleInputRows(key, iter(rows), clock)]


def _made(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def test_a_page_costs_few_calls():
    lock = jobs.PageLock(1_000)
    handle = _made(lock)
    event = Row("at_ms", "seq", "kind")
    assert _turn(lock, (7, "p"), [event(5, 2, "request"), event(5, 1, "request"), event(6, 3, "finish")]) == [(7, "p", 5, 1)]
    assert handle.calls == 1 and handle.value is None  # a page that nobody holds leaves nothing
    assert _turn(lock, (7, "p"), [event(9, 4, "request")]) == [(7, "p", 9, 4)]
    assert handle.value == (1_009,) and handle.timers == [1_009] and handle.calls == 4
    assert _turn(lock, (7, "p"), [event(10, 5, "request")]) == [] and handle.calls == 5
    assert _turn(lock, (7, "p"), [event(11, 6, "finish")]) == [] and handle.value is None and handle.timers == []


def test_chunks_of_one_batch_are_not_written():
    chunk, line = Row("seq", "data"), 'data: {"choices":[{"text":"%d"}]}\n'
    parser = assemble.LineParser()
    handle = _made(parser)
    rows = [chunk(i, line % i) for i in range(1, 60)]
    assert _turn(parser, (1,), rows[::2]) == [] and len(handle.map) == 30
    calls = handle.calls
    got = _turn(parser, (1,), [chunk(0, line % 0), *rows[1::2], rows[0]])
    assert [r[3] for r in got] == [str(i) for i in range(60)]
    assert handle.calls - calls <= 4 and not handle.map


def test_deltas_that_wait_long_are_looked_up_one_by_one():
    delta = Row("seq", "delta")
    scanner = assemble.StageScanner(keys=("id", "iteration"))
    handle = _made(scanner)
    assert _turn(scanner, (1, 1), [delta(i, f"d{i} ") for i in range(200, 1, -1)]) == []
    scanner.waits.iterator = None  # far more waits than comes
    assert _turn(scanner, (1, 1), [delta(0, "## Research Plan ")]) == [(1, 1, 0, 0, "## Research Plan ", "plan")]
    got = _turn(scanner, (1, 1), [delta(1, "d1 "), delta(0, "again")])
    assert got == [(1, 1, 1, 200, "".join(f"d{i} " for i in range(1, 201)), "plan")] and not handle.map
    calls = handle.calls
    assert _turn(scanner, (1, 1), [delta(5, "repeat")]) == [] and handle.calls == calls + 1
