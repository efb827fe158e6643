"""Saved answers of services as blocks and as HTML, by a description of each format rather than code for each.

A format says where its list of blocks is, how a block names its type, box, text and page, and which label each type has;
and where the page itself stands, as HTML, markdown or plain text. A type the table lacks makes the whole answer unusable, so
that a person decides its label.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagemint.functions.markdown import to_html
from pagemint.functions.views import visible
from pagemint.sources.replies import scaled, unturned


@dataclass(frozen=True)
class Format:
    """``corners`` are paths of x0, y0, x1, y1; with ``sized`` the last two are width and height. * in a path stands for every
    element of a list. ``frame`` are paths in the answer, or in the block with ``own_frame``; ``order`` is what blocks are
    sorted by; ``left_out`` are types that are no blocks; ``rendered`` says that a block's text is markdown.

    The page is ``html`` (paths, joined), else ``markdown`` (likewise), else ``plain`` text.
    """

    blocks: str = ""
    type: str = ""
    corners: tuple[str, ...] = ()
    text: str = ""
    labels: dict[str, str] = field(default_factory=dict, hash=False)
    frame: tuple[str, str] | tuple[float, float] = (1.0, 1.0)
    sized: bool = False
    page: tuple[str, object] | None = None
    turned: str | None = None
    own_frame: bool = False
    order: str | None = None
    left_out: tuple[str, ...] = ()
    rendered: bool = False
    html: tuple[str, ...] = ()
    markdown: tuple[str, ...] = ()
    plain: str | None = None


def every(value: object, path: str) -> list:
    """The values under a path in which * stands for every element of a list."""
    first, *steps = path.split("*")
    found = [at(value, first)]
    for step in steps:
        found = [at(x, step) for v in found if isinstance(v, list) for x in v]
    return [v for v in found if v is not None]


def at(value: object, path: str) -> object:
    """The value under a dotted path of keys and positions; None where it leads nowhere."""
    for key in filter(None, path.split(".")):
        if isinstance(value, dict):
            value = value.get(key)
        elif isinstance(value, list) and key.isdigit() and int(key) < len(value):
            value = value[int(key)]
        else:
            return None
    return value


# Block types of public services and the labels they stand for.
FORMATS = {
    "mistral": Format(
        "pages.0.blocks", "type", ("top_left_x", "top_left_y", "bottom_right_x", "bottom_right_y"), "content",
        {"text": "text", "title": "heading", "list": "list", "caption": "caption", "code": "code", "references": "text", "aside_text": "text",
         "header": "page_furniture", "footer": "page_furniture", "equation": "equation", "table": "table", "image": "figure", "signature": "figure"},
        ("pages.0.dimensions.width", "pages.0.dimensions.height"),
        markdown=("pages.0.header", "pages.0.markdown", "pages.0.footer"),
    ),
    "reducto": Format(
        "result.chunks.0.blocks", "type", ("bbox.left", "bbox.top", "bbox.width", "bbox.height"), "content",
        {"Text": "text", "Title": "heading", "Section Header": "heading", "List Item": "list", "Header": "page_furniture", "Footer": "page_furniture",
         "Page Number": "page_furniture", "Comment": "text", "Table": "table", "Figure": "figure", "Key Value": "form", "Signature": "figure"},
        sized=True, page=("bbox.page", 1), markdown=("result.chunks.*.content",),
    ),
    "mineru": Format(
        "blocks", "type", ("bbox.0", "bbox.1", "bbox.2", "bbox.3"), "content",
        {"text": "text", "aside_text": "text", "ref_text": "text", "index": "text", "phonetic": "text", "unknown": "text", "title": "heading",
         "doc_title": "heading", "paragraph_title": "heading", "list": "list", "list_item": "list", "caption": "caption", "table_caption": "caption",
         "image_caption": "caption", "code_caption": "caption", "footnote": "footnote", "table_footnote": "footnote", "image_footnote": "footnote",
         "page_footnote": "footnote", "header": "page_furniture", "footer": "page_furniture", "page_number": "page_furniture", "equation": "equation",
         "equation_block": "equation", "formula_number": "equation", "code": "code", "algorithm": "code", "table": "table", "image": "figure",
         "chart": "figure", "image_block": "figure"},
        markdown=("markdown",),
    ),
    "datalab": Format(
        "chunks.blocks", "block_type", ("bbox.0", "bbox.1", "bbox.2", "bbox.3"), "html",
        {"Text": "text", "SectionHeader": "heading", "ListGroup": "list", "Caption": "caption", "Footnote": "footnote", "PageHeader": "page_furniture",
         "PageFooter": "page_furniture", "Equation": "equation", "Code": "code", "TableOfContents": "text", "Bibliography": "text", "Table": "table",
         "Form": "form", "Picture": "figure", "Figure": "figure", "Diagram": "figure", "ChemicalBlock": "figure", "ComplexRegion": "figure"},
        ("chunks.page_info.0.bbox.2", "chunks.page_info.0.bbox.3"), page=("page", 0), html=("html",),
    ),
    "surya": Format(
        "blocks", "label", ("bbox.0", "bbox.1", "bbox.2", "bbox.3"), "html",
        {"Text": "text", "SectionHeader": "heading", "ListGroup": "list", "Caption": "caption", "Footnote": "footnote", "PageHeader": "page_furniture",
         "PageFooter": "page_furniture", "Equation": "equation", "Code": "code", "TableOfContents": "text", "Bibliography": "text", "Table": "table",
         "Form": "form", "Picture": "figure", "Figure": "figure", "Diagram": "figure", "ChemicalBlock": "figure"},
        ("image_bbox.2", "image_bbox.3"), order="reading_order", left_out=("BlankPage",), html=("blocks.*.html",),
    ),
    "oxr": Format(
        "outputs.json.pages.0.blocks", "type", ("bbox.0", "bbox.1", "bbox.2", "bbox.3"), "content",
        {"Text": "text", "Title": "heading", "Caption": "caption", "Footnote": "footnote", "Formula": "equation", "Chemical Equation": "equation",
         "Code Block": "code", "Table": "table", "Picture": "figure", "Stamp": "figure", "Chemical Structure": "figure",
         "Page-header": "page_furniture", "Page-footer": "page_furniture"},
        ("outputs.json.pages.0.page_size.w", "outputs.json.pages.0.page_size.h"), rendered=True, markdown=("outputs.markdown",),
    ),
    "dots": Format(
        "cells", "category", ("bbox.0", "bbox.1", "bbox.2", "bbox.3"), "text",
        {"Text": "text", "Title": "heading", "Section-header": "heading", "List-item": "list", "Caption": "caption", "Footnote": "footnote",
         "Page-header": "page_furniture", "Page-footer": "page_furniture", "Formula": "equation", "Table": "table", "Picture": "figure"},
        ("image_size.0", "image_size.1"), markdown=("markdown",),
    ),
    "paddleocr_vl": Format(
        "parsing_res_list", "block_label", ("block_bbox.0", "block_bbox.1", "block_bbox.2", "block_bbox.3"), "block_content",
        {"text": "text", "abstract": "text", "content": "text", "reference": "text", "reference_content": "text", "aside_text": "text",
         "vertical_text": "text", "paragraph_title": "heading", "doc_title": "heading", "footnote": "footnote", "vision_footnote": "footnote",
         "figure_title": "caption", "algorithm": "code", "display_formula": "equation", "inline_formula": "equation", "formula_number": "equation",
         "header": "page_furniture", "footer": "page_furniture", "number": "page_furniture", "table": "table", "image": "figure", "chart": "figure",
         "seal": "figure", "header_image": "figure", "footer_image": "figure"},
        ("width", "height"), markdown=("markdown",),
    ),
    "minicpm_ocr": Format(
        "crop_blocks", "label", ("bbox.0", "bbox.1", "bbox.2", "bbox.3"), "content",
        {"abstract": "text", "content": "text", "reference": "text", "reference_content": "text", "text": "text", "vertical_text": "text",
         "aside_text": "text", "algorithm": "code", "doc_title": "heading", "paragraph_title": "heading", "figure_title": "caption",
         "footnote": "footnote", "vision_footnote": "footnote", "display_formula": "equation", "inline_formula": "equation",
         "formula_number": "equation", "header": "page_furniture", "footer": "page_furniture", "number": "page_furniture", "table": "table",
         "chart": "figure", "seal": "figure", "image": "figure", "header_image": "figure", "footer_image": "figure"},
        ("image_width", "image_height"), order="order", rendered=True, markdown=("html_markdown",),
    ),
    "indra_ocr": Format(
        "blocks", "label", ("bbox.0", "bbox.1", "bbox.2", "bbox.3"), "text",
        {"Text": "text", "Table-Of-Contents": "text", "Section-Header": "heading", "Page-Header": "page_furniture", "Page-Footer": "page_furniture",
         "List-Group": "list", "Caption": "caption", "Footnote": "footnote", "Table": "table", "Form": "form"},
        ("image_size.0", "image_size.1"), turned="rotation", markdown=("markdown",), plain="text",
    ),
    "infinity": Format(
        "json", "category", ("bbox.0", "bbox.1", "bbox.2", "bbox.3"), "text",
        {"text": "text", "title": "heading", "header": "page_furniture", "footer": "page_furniture", "figure": "figure", "table": "table",
         "formula": "equation", "figure_caption": "caption", "table_caption": "caption", "formula_caption": "caption", "figure_footnote": "footnote",
         "table_footnote": "footnote", "page_footnote": "footnote", "form": "form", "label": "form", "table_text": "caption", "signature": "figure"},
        (1000.0, 1000.0), markdown=("markdown",),
    ),
    "nemotron_parse": Format(
        "document.blocks", "class", ("bbox.0", "bbox.1", "bbox.2", "bbox.3"), "content",
        {"Text": "text", "TOC": "text", "Bibliography": "text", "Title": "heading", "Section-header": "heading", "Page-header": "page_furniture",
         "Page-footer": "page_furniture", "List-item": "list", "Caption": "caption", "Footnote": "footnote", "Formula": "equation", "Code": "code",
         "Table": "table", "Picture": "figure", "Chart": "figure"},
    ),
    "extend": Format(
        "output.chunks.*.blocks", "type", ("boundingBox.left", "boundingBox.top", "boundingBox.right", "boundingBox.bottom"), "content",
        {"text": "text", "heading": "heading", "section_heading": "heading", "header": "page_furniture", "footer": "page_furniture",
         "page_number": "page_furniture", "formula": "equation", "legend": "caption", "table": "table", "table_head": "table", "table_cell": "table",
         "key_value": "form", "figure": "figure", "barcode": "figure"},
        ("metadata.page.width", "metadata.page.height"), own_frame=True, page=("metadata.page.number", 1),
        turned="output.metadata.pages.0.rotationApplied", markdown=("output.chunks.*.content",),
    ),
    "llamaparse": Format(markdown=("markdown.pages.0.header", "markdown.pages.0.markdown", "markdown.pages.0.footer")),
    "olmocr": Format(markdown=("natural_text",)),
    "ovisocr": Format(markdown=("text",)),
    "ovisocr2": Format(markdown=("text",)),
    "glm_ocr": Format(markdown=("markdown_result",)),
    "tesseract": Format(plain="text"),
    "chat": Format(markdown=("choices.0.message.content",)),
}


class Unusable(ValueError):
    """An answer that a format does not describe."""


def blocks(raw: object, form: Format) -> list[dict]:
    size = lambda of: [at(of, f) if isinstance(f, str) else f for f in form.frame]
    if not form.blocks:
        raise Unusable("the format has no blocks")
    if not form.own_frame and not all(size(raw)):
        raise Unusable("the answer states no page size")
    listed = [b for x in every(raw, form.blocks) for b in (x if isinstance(x, list) else [x])]
    if form.order:
        listed.sort(key=lambda b: at(b, form.order) or 0)
    out = []
    for b in listed:
        box, kind = [at(b, c) for c in form.corners], at(b, form.type) or ""
        if None in box or kind in form.left_out or form.page and at(b, form.page[0]) not in (None, form.page[1]):
            continue
        frame = size(b if form.own_frame else raw)
        if not all(frame):
            raise Unusable("a block states no page size")
        if kind not in form.labels:
            raise Unusable(f"block type {kind!r} has no label")
        if form.sized:
            box[2:] = [box[0] + box[2], box[1] + box[3]]
        turned = int(at(raw, form.turned) or 0) if form.turned else 0
        # a page turned by a quarter is as wide as the page as it was is high
        bbox = scaled(box, *(frame[::-1] if turned % 180 and not form.own_frame else frame))
        if turned % 360:
            bbox = unturned(bbox, turned)
        said = str(at(b, form.text) or "")
        text = visible(to_html(said)) if form.rendered else re.sub(r"<[^>]+>", " ", said)
        out.append({"label": form.labels[kind], "bbox": bbox, "text": " ".join(text.split())})
    return out


def page_html(raw: object, form: Format) -> str:
    """The page of an answer as HTML."""
    parts = lambda paths: [str(x) for p in paths for x in every(raw, p) if str(x).strip()]
    if found := parts(form.html):
        return "\n".join(found)
    if found := parts(form.markdown):
        return to_html("\n\n".join(found))
    if form.plain and (said := at(raw, form.plain)) is not None:
        return f"<pre>{html.escape(str(said))}</pre>"
    raise Unusable("the answer holds no page")


def read_pages(answers: DataFrame, form: Format, raw: str = "raw") -> DataFrame:
    """Add html and error (null where the answer was read) to saved answers; ``raw`` is JSON text."""
    schema = T.StructType([*answers.schema.fields, T.StructField("html", T.StringType()), T.StructField("error", T.StringType())])
    own, names = answers.columns, schema.names

    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            return page_html(json.loads(text or ""), form), None
        except (ValueError, TypeError) as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(t) for t in batch.column(raw).to_pylist()]
            cells = [pa.array([g[k] for g in got], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *cells], names)

    return answers.mapInArrow(run, schema)


def read_answers(answers: DataFrame, form: Format, raw: str = "raw") -> DataFrame:
    """Add blocks and error (null where the answer was read) to saved answers; ``raw`` is JSON text."""
    block = T.StructType([T.StructField("label", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType())])
    schema = T.StructType([*answers.schema.fields, T.StructField("blocks", T.ArrayType(block)), T.StructField("error", T.StringType())])
    own, names = answers.columns, schema.names
    kind = pa.list_(pa.struct([("label", pa.string()), ("bbox", pa.list_(pa.float64())), ("text", pa.string())]))

    def one(text: str | None) -> tuple[list[dict] | None, str | None]:
        try:
            return blocks(json.loads(text or ""), form), None
        except (ValueError, TypeError) as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(t) for t in batch.column(raw).to_pylist()]
            cells = [pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *cells], names)

    return answers.mapInArrow(run, schema)
