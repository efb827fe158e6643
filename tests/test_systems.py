"""Asking, resuming and reading again, with a stub system."""

import sys

from pyspark import cloudpickle

from pagemint.operators.summary import coverage
from pagemint.sources import systems

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


class Echo(systems.System):
    name = "echo"
    supports = ("html",)

    def send(self, page, request, timeout):
        if page == b"down":
            raise systems.SystemFailed("out of order")
        if page == b"busy":
            raise systems.SystemFailed("try again", transient=True)
        return {"said": page.decode()}

    def parse(self, raw, request):
        if raw["said"] == "empty":
            raise systems.SystemFailed("nothing said")
        return {"html": f"<p>{raw['said']}</p>"}


def test_ask_resume_and_read(spark, tmp_path):
    records = str(tmp_path / "records")
    rows = [("a", b"one", ["html"]), ("b", b"down", ["html"]), ("c", b"busy", ["html", "blocks"]), ("d", b"empty", ["html"])]
    pages = spark.createDataFrame(rows, "page_id string, content binary, outputs array<string>")
    assert systems.ask(pages.where("page_id <> 'a'"), Echo(), records, wait=0.01) == 3
    assert systems.ask(pages, Echo(), records, wait=0.01) == 1 and systems.ask(pages, Echo(), records) == 0
    held = systems.held(spark, records)
    assert {r.page_id: (r.error, r.tries) for r in held.collect()} == {"a": (None, 1), "b": ("out of order", 1), "c": ("try again", 4), "d": (None, 1)}
    got = systems.outputs(held, Echo())
    assert {r.page_id: (r.html, r.error) for r in got.collect()} == {"a": ("<p>one</p>", None), "b": (None, "system"), "c": (None, "system"), "d": (None, "unusable")}
    row = coverage(pages, got).first()
    assert (row.pages, row.scored, row.failed_system, row.failed_unusable) == (4, 1, 2, 1)
    assert systems.latency(held).first().failed == 2


def test_budget_and_loading():
    raw, error, _, made = systems.answer(Echo(), b"busy", ["html"], timeout=0.05, tries=50, wait=0.02)
    assert raw is None and error.startswith("no answer within") and made < 50
    assert systems.answer(Echo(), b"x", ["blocks"], 1, 1, 1)[0] == "[]"
    assert systems.load(f"{Echo.__module__}:Echo").name == "echo"
