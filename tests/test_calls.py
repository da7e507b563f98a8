"""Calls to a provider: how many at once, how long, and never twice; summary files."""

import threading
import time

import pandas as pd
import pytest

from inkwell.operators import assets
from inkwell.options import CleanOptions
from inkwell.plans import run


def frame(n):
    return pd.DataFrame({"digest": [f"d{i}" for i in range(n)], "prompt_kind": "figure", "bytes": [b"x" * i for i in range(n)], "mime": "image/png"})


def ask(frames, provider, calls):
    return pd.concat(list(assets.asked(iter(frames), provider, calls, lambda s: None)), ignore_index=True)


class Counting:
    def __init__(self, seconds=0.05):
        self.lock, self.now, self.most, self.made, self.seconds = threading.Lock(), 0, 0, 0, seconds

    def describe(self, data, mime, kind):
        with self.lock:
            self.now, self.made = self.now + 1, self.made + 1
            self.most = max(self.most, self.now)
        time.sleep(self.seconds * (len(data) % 3))
        with self.lock:
            self.now -= 1
        if len(data) % 5 == 4:
            raise ValueError(f"no {len(data)}")
        return f" {len(data)} "


@pytest.mark.parametrize("at_once", [1, 4])
def test_so_many_at_once_and_in_order(at_once):
    provider = Counting()
    got = ask([frame(23), frame(0), frame(6)], provider, assets.Calls(at_once=at_once))
    assert provider.most == at_once and provider.made == 29
    want = [(None, f"no {i}") if i % 5 == 4 else (str(i), None) for i in [*range(23), *range(6)]]
    assert list(zip(got.text, got.error)) == want


def test_a_deadline(spark):
    class Slow:
        def describe(self, data, mime, kind):
            time.sleep(30 if data == b"x" else 0)
            return "quick"

    start = time.monotonic()
    got = ask([frame(6)], Slow(), assets.Calls(at_once=2, seconds=0.5))
    assert time.monotonic() - start < 10
    assert list(got.text) == ["quick", None, "quick", "quick", "quick", "quick"] and got.error[1] == "no answer in 0.5 seconds"


def test_a_repeated_task_asks_nothing_twice(tmp_path):
    calls = assets.Calls(ledger=str(tmp_path / "ledger"))
    first, again = Counting(0), Counting(0)

    class Killed(Exception):
        pass

    def frames():
        yield frame(9)
        raise Killed

    with pytest.raises(Killed):
        ask(frames(), first, calls)
    got = ask([frame(12)], again, calls)
    assert first.made == 9 and again.made == 4  # three new ones, and the one that failed
    assert list(got.text) == [None if i % 5 == 4 else str(i) for i in range(12)]
    assert not list((tmp_path / "ledger").glob("*.attempt"))


def test_summary_files_are_written_once(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "old_summary.txt").write_text("mine")
    rows = [("a/old", "new"), ("a/x", "é"), ("a/x", "ü"), ("b/c/y", "Y"), ("n", None), (None, "t")]
    told = spark.createDataFrame(rows, "stem string, text string").repartition(4)
    for new in (True, False):
        got = {r.stem: (r.path, r.written) for r in assets.write_summaries(told, str(tmp_path)).collect()}
        assert got == {"a/old": ("a/old_summary.txt", False), "a/x": ("a/x_summary.txt", new), "b/c/y": ("b/c/y_summary.txt", new)}
    files = {str(f.relative_to(tmp_path)): f.read_text() for f in tmp_path.rglob("*") if f.is_file()}
    assert files == {"a/old_summary.txt": "mine", "a/x_summary.txt": "é", "b/c/y_summary.txt": "Y"}


def test_a_run_describes_what_has_no_summary(spark, tmp_path):
    from test_office import deck_of_pictures

    class Echo:
        def describe(self, data, mime, kind):
            if data == b"bad":
                raise ValueError("no")
            return f"{kind} {data.decode()} {mime}"

    (tmp_path / "p" / "g").mkdir(parents=True)
    (tmp_path / "p" / "m.tex").write_text("\\includegraphics{g/a} \\includegraphics{g/b.png} \\includegraphics{g/c} \\includegraphics{g/none}")
    for name, data in (("a.jpg", b"A"), ("a.pdf", b"P"), ("b.png", b"B"), ("c.png", b"bad"), ("b_summary.txt", b"known")):
        (tmp_path / "p" / "g" / name).write_bytes(data)
    (tmp_path / "d.pptx").write_bytes(deck_of_pictures())
    (tmp_path / "d_slide1_image1_summary.txt").write_text("first")
    options = CleanOptions(auto_summarize=True)
    got = {r.path: (r.text, sorted(tuple(n) for n in r.notes)) for r in run.clean_folder(spark, str(tmp_path), ["p/m.tex", "d.pptx"], options, provider=Echo()).collect()}
    assert got["p/m.tex"] == ("% [Image: figure P application/pdf] % [Image: known] \\includegraphics{g/c} \\includegraphics{g/none}", [("missing-summary", "g/c"), ("missing-summary", "g/none")])
    assert "[Image: first]" in got["d.pptx"][0] and "[Image: figure two image/png]" in got["d.pptx"][0]
    assert (tmp_path / "p" / "g" / "a_summary.txt").read_text() == "figure P application/pdf" and (tmp_path / "d_slide1_image2_summary.txt").read_text() == "figure two image/png"
    with pytest.raises(ValueError):
        run.clean_folder(spark, str(tmp_path), ["p/m.tex"], options)
