"""Saved answers read by format descriptions."""

import json

from pagemint.sources import formats


def test_read_answers(spark):
    size = {"width": 100, "height": 200}
    block = {"type": "title", "top_left_x": 10, "top_left_y": 20, "bottom_right_x": 60, "bottom_right_y": 400, "content": "<b>A</b>  b"}
    rows = [
        (1, json.dumps({"pages": [{"dimensions": size, "blocks": [block]}]})),
        (2, json.dumps({"pages": [{"dimensions": size, "blocks": [block | {"type": "hologram"}]}]})),
        (3, json.dumps({"pages": [{"blocks": [block]}]})),
        (4, "no json"),
        (5, None),
    ]
    got = {r.id: r for r in formats.read_answers(spark.createDataFrame(rows, "id int, raw string"), formats.FORMATS["mistral"]).collect()}
    assert [tuple(b) for b in got[1].blocks] == [("heading", [0.1, 0.1, 0.6, 1.0], "A b")] and got[1].error is None
    assert "hologram" in got[2].error and got[3].error == "the answer states no page size"
    assert got[4].blocks is None and got[4].error and got[5].error


def test_sizes_and_pages():
    form = formats.FORMATS["reducto"]
    chunk = [
        {"type": "Table", "bbox": {"left": 0.1, "top": 0.2, "width": 0.3, "height": 0.4, "page": 1}, "content": "x"},
        {"type": "Text", "bbox": {"left": 0, "top": 0, "width": 1, "height": 1, "page": 2}, "content": "y"},
    ]
    assert [b["label"] for b in formats.blocks({"result": {"chunks": [{"blocks": chunk}]}}, form)] == ["table"]


def test_described_formats():
    box = [10, 20, 60, 100]
    cases = {
        "datalab": ({"html": "<p>x</p>", "chunks": {"page_info": {"0": {"bbox": [0, 0, 100, 200]}}, "blocks": [{"block_type": "Table", "bbox": box, "html": "<b>a</b>"}, {"block_type": "Text", "bbox": box, "page": 1}]}}, "table"),
        "surya": ({"image_bbox": [0, 0, 100, 200], "blocks": [{"label": "BlankPage", "bbox": box}, {"label": "Code", "bbox": box, "html": "<p>x</p>"}]}, "code"),
        "oxr": ({"outputs": {"markdown": "x", "json": {"pages": [{"page_size": {"w": 100, "h": 200}, "blocks": [{"type": "Stamp", "bbox": box, "content": "**a**"}]}]}}}, "figure"),
        "dots": ({"markdown": "x", "image_size": [100, 200], "cells": [{"category": "Title", "bbox": box, "text": "a"}, {"category": "Text"}]}, "heading"),
        "extend": ({"output": {"chunks": [{"content": "x", "blocks": []}, {"blocks": [{"type": "key_value", "content": "a", "boundingBox": dict(zip(("left", "top", "right", "bottom"), box)), "metadata": {"page": {"number": 1, "width": 100, "height": 200}}}]}]}}, "form"),
    }
    for name, (raw, label) in cases.items():
        (got,) = formats.blocks(raw, formats.FORMATS[name])
        assert got["label"] == label and got["bbox"] == [0.1, 0.1, 0.6, 0.5], name
        assert "x" in formats.page_html(raw, formats.FORMATS[name])
    turned = {"markdown": "x", "rotation": 90, "image_size": [100, 200], "blocks": [{"label": "Text", "bbox": [20, 10, 100, 60], "text": "a"}]}
    (got,) = formats.blocks(turned, formats.FORMATS["indra_ocr"])
    assert got["bbox"] == [0.1, 0.5, 0.6, 0.9]
    vocabulary = {label for f in formats.FORMATS.values() for label in f.labels.values()}
    assert vocabulary <= set(__import__("pagemint.vocab").vocab.LABELS)


def test_pages(spark):
    rows = [(1, json.dumps({"text": "a < b"})), (2, json.dumps({})), (3, None)]
    got = {r.id: r for r in formats.read_pages(spark.createDataFrame(rows, "id int, raw string"), formats.FORMATS["tesseract"]).collect()}
    assert got[1].html == "<pre>a &lt; b</pre>" and got[1].error is None and got[2].error == "the answer holds no page" and got[3].error
    chat = {"choices": [{"message": {"content": "# Title"}}]}
    assert formats.page_html(chat, formats.FORMATS["chat"]) == "<h1>Title</h1>\n"
    assert formats.page_html({"markdown": {"pages": [{"header": "h", "markdown": "m"}]}}, formats.FORMATS["llamaparse"]) == "<p>h</p>\n<p>m</p>\n"
