"""Closed vocabularies. They must be what datasets and runs use."""

OUTPUT_TYPES = ("html", "blocks", "markdown")

DERIVATIONS = (
    "text_layer",
    "upstream_olmocr",
    "authored",
    "publisher_markup",
    "model_panel",
    "extractor_agreement",
    "human_review",
    "model_review",
    "upstream_frbench",
    "source_transcription",
    "computed",
    "rendered_source",
)

#: Test type: (family, output type it reads), in the order reports list them.
TEST_TYPES = {
    "present": ("text", "html"),
    "order": ("text", "html"),
    "repeat": ("text", "html"),
    "page_near_empty": ("text", "html"),
    "table_cell": ("tables", "html"),
    "layout_kind": ("layout", "blocks"),
    "format": ("format", "html"),
}
FAMILIES = ("text", "tables", "layout", "format")
HEADLINE_FAMILIES = ("text", "tables", "layout")
ARG_KINDS = ("text", "number", "latex")
SLICES = ("families", "per_tag", "per_suite", "per_test_type", "per_arg_kind", "per_derivation")

ROLES = ("heading", "caption", "footnote", "list", "code", "figure", "header_footer")
YES_NO = ("table", "math", "form", "multi_column", "tiny", "rotated", "handwriting", "degraded")
LABELS = ("text", "heading", "page_furniture", "list", "caption", "footnote", "equation", "code", "table", "form", "figure")
MARKS = ("bold", "italic", "underline", "strike", "sup", "sub")

#: Order of keys within a slice; other keys follow by alphabet.
KEY_ORDER = {"families": FAMILIES, "per_test_type": tuple(TEST_TYPES), "per_arg_kind": ARG_KINDS}
