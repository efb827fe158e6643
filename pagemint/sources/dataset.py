"""A dataset folder as DataFrames: its manifest, its tests, systems' predictions and score lines; checks; sinks.

Checks give rows of what is wrong (where, rule), not exceptions from deep inside a job; ``refuse`` turns them into one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemint import vocab
from pagemint.functions import equations, fold, marks, numbers
from pagemint.operators.summary import family

NO_SUITE = "other"
FIXED = ("page_id", "document", "suite", "doc_path", "gt_path", "outputs")


def page_rows(manifest: DataFrame) -> DataFrame:
    """Manifest rows as pages: blank suites named, outputs sorted, other columns kept together as JSON in ``extra``."""
    if "suite" not in manifest.columns:
        manifest = manifest.withColumn("suite", F.lit(None).cast("string"))
    rest = [c for c in manifest.columns if c not in FIXED]
    extra = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    blank = F.coalesce(F.trim("suite"), F.lit("")) == ""
    return manifest.select(
        "page_id", "document", F.when(blank, NO_SUITE).otherwise(F.col("suite")).alias("suite"), "doc_path", "gt_path",
        F.array_sort("outputs").alias("outputs"), extra.alias("extra"),
    )


def read_manifest(spark: SparkSession, folder: str, manifest: str = "manifest.parquet") -> DataFrame:
    return page_rows(spark.read.parquet(f"{folder}/{manifest}"))


def manifest_errors(pages: DataFrame) -> DataFrame:
    """(page_id, rule) of every broken rule of manifest rows."""
    known = F.array(*[F.lit(o) for o in vocab.OUTPUT_TYPES])
    rules = {
        "document is empty": F.coalesce(F.trim("document"), F.lit("")) == "",
        "page file is no .pdf or .png": ~F.coalesce(F.rlike("doc_path", F.lit(r"\.(pdf|png)$")), F.lit(False)),
        "gold is not named after the page": ~F.coalesce(F.endswith("gt_path", F.concat("page_id", F.lit(".json"))), F.lit(False)),
        "outputs are not distinct known types": F.coalesce(F.size("outputs"), F.lit(0)).isin(0, -1)
        | (F.size(F.array_distinct("outputs")) != F.size("outputs"))
        | (F.size(F.array_except("outputs", known)) > 0),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
    each = pages.select("page_id", F.explode(broken).alias("rule"))
    twice = pages.groupBy("page_id").count().where("count > 1").select("page_id", F.lit("page id is used twice").alias("rule"))
    return each.unionByName(twice)


def sample_rows(pages: DataFrame, n: int, by: str = "page_id") -> DataFrame:
    """``n`` rows evenly spaced in the order of ``by``; all rows if there are fewer."""
    total = pages.count()
    if total <= n:
        return pages
    numbered = pages.withColumn("__at", F.expr(f"row_number() over (order by {by}) - 1"))
    first = F.floor(F.col("__at") * n / total)
    before = F.floor((F.col("__at") - 1) * n / total)
    return numbered.where((F.col("__at") == 0) | (first > before)).drop("__at")


# --- tests ----------------------------------------------------------------------------------------------------------

TEST = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("test_id", "page_id", "test_type", "output_type", "derivation")),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("args", T.StringType()),
        T.StructField("settings", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)
FIELDS = {"id", "test_type", "output_type", "derivation", "tags", "args", "settings"}
RELATIONS = ("up", "down", "left", "right", "top_heading", "left_heading", "right_heading")
#: Test type: (required roles, optional roles, settings).
SHAPES = {
    "present": (("content",), (), ()),
    "order": (("before", "after"), (), ()),
    "repeat": (("content",), (), ("expected_count",)),
    "page_near_empty": ((), (), ("max_chars",)),
    "table_cell": (("cell",), (*RELATIONS, "section", "headings", "row_groups"), ()),
    "layout_kind": (("content",), (), ("kind",)),
    "format": (("span",), ("before", "after"), None),
}
LISTS = ("headings", "row_groups")
KINDS = {"text": ({"text", "max_diffs"}, {"place", "exact_case"}), "number": ({"number"}, set()), "latex": ({"latex"}, set())}


def whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def kind_of(arg) -> str | None:
    return next((k for k, (must, may) in KINDS.items() if isinstance(arg, dict) and must <= set(arg) <= must | may), None)


def arg_errors(test_type: str, role: str, arg) -> Iterator[str]:
    kind = kind_of(arg)
    if kind is None:
        yield f"{role} is no arg"
    elif kind == "latex":
        if not (isinstance(arg["latex"], str) and equations.symbols(arg["latex"])):
            yield f"{role}'s latex renders nothing"
    elif kind == "number":
        if not (isinstance(arg["number"], str) and numbers.read(arg["number"])):
            yield f"{role}'s number does not read as one number"
    else:
        n = len(fold.fold(arg["text"])) if isinstance(arg["text"], str) else 0
        if not n:
            yield f"{role}'s text has nothing left after folding"
        elif not (whole(arg["max_diffs"]) and 0 <= arg["max_diffs"] < n):
            yield f"{role}'s max_diffs is no whole number below the length of its text"
        place = arg.get("place", [])
        fits = isinstance(place, list) and all(
            isinstance(b, list) and len(b) == 4 and all(isinstance(x, int | float) and 0 <= x <= 1 for x in b) and b[0] < b[2] and b[1] < b[3]
            for b in place
        )
        if not fits:
            yield f"{role}'s place is no list of boxes"
        exact = arg.get("exact_case", False)
        if not isinstance(exact, bool):
            yield f"{role}'s exact_case is neither true nor false"
        elif exact and (test_type, role) != ("present", "content"):
            yield "exact_case is for the content of present tests"
        elif exact and n and (arg["max_diffs"] or not any(c.lower() != c.upper() for c in fold.fold_cased(arg["text"]))):
            yield "exact_case takes a text with a cased letter and no edits"


def tag_fits(tag) -> bool:
    return isinstance(tag, str) and (tag in vocab.ROLES + vocab.YES_NO or re.fullmatch(r"[a-z]{3}|[A-Z][a-z]{3}", tag) is not None)


def test_errors(t) -> list[str]:
    """Every broken rule of one test as its gold file states it."""
    if not isinstance(t, dict) or set(t) != FIELDS:
        return [f"a test has exactly the fields {sorted(FIELDS)}"]
    out = []
    if not (isinstance(t["id"], str) and t["id"].strip()):
        out.append("id is blank")
    if t["derivation"] not in vocab.DERIVATIONS:
        out.append("derivation is not known")
    if not (isinstance(t["tags"], list) and all(map(tag_fits, t["tags"]))):
        out.append("tags are not all known, or language or script codes")
    kind = t["test_type"]
    if kind not in SHAPES:
        return [*out, "test type is not known"]
    if t["output_type"] != vocab.TEST_TYPES[kind][1]:
        out.append("output type is not what the test type reads")
    args, settings = t["args"], t["settings"]
    if not (isinstance(args, dict) and isinstance(settings, dict)):
        return [*out, "args and settings are no objects"]
    must, may, names = SHAPES[kind]
    if set(must) - set(args) or set(args) - set(must) - set(may):
        return [*out, "roles are not those of the test type"]
    if set(settings) not in ([{"marks"}, {"absent"}] if names is None else [set(names)]):
        return [*out, "settings are not those of the test type"]
    flat = []
    for role, arg in args.items():
        if isinstance(arg, list) != (role in LISTS):
            return [*out, f"{role} takes {'a list' if role in LISTS else 'one arg'}"]
        flat += [(role, a) for a in (arg if isinstance(arg, list) else [arg])]
    for role, arg in flat:
        out += arg_errors(kind, role, arg)
    if out or any(kind_of(a) is None for _, a in flat):
        return out
    kinds = {kind_of(a) for _, a in flat}
    if kind in ("order", "table_cell", "format", "layout_kind") and kinds - {"text"}:
        out.append("the test type compares text only")
    elif kind in ("order", "table_cell", "format") and len({a["max_diffs"] for _, a in flat}) > 1:
        out.append("args do not share max_diffs")
    if kind == "repeat":
        content = args["content"]
        if "latex" in kinds or content.get("max_diffs", 0):
            out.append("repeat counts exact text or a number")
        if not (whole(settings["expected_count"]) and settings["expected_count"] > 0):
            out.append("expected_count is no positive whole number")
    if kind == "page_near_empty" and not (whole(settings["max_chars"]) and settings["max_chars"] >= 0):
        out.append("max_chars is no whole number, 0 or more")
    if kind == "layout_kind" and not (args["content"].get("place") and settings["kind"] in vocab.LABELS):
        out.append("layout_kind takes a place and a known label")
    if kind == "format" and not out:
        (named,) = settings.values()
        text = {r: a["text"] for r, a in args.items()}
        context = text.get("before", "") + text.get("after", "")
        fits = isinstance(named, list) and named and len(set(map(str, named))) == len(named) and set(map(str, named)) <= set(vocab.MARKS)
        if not fits or settings.get("marks") and {"sup", "sub"} <= set(named):
            out.append("marks are not distinct kinds")
        if any(set(a) != {"text", "max_diffs"} or a["max_diffs"] for a in args.values()):
            out.append("format's args are text without edits")
        n = marks.letters(text["span"])
        if not n or n < 3 and not marks.letters(context):
            out.append("format's span and context have too few letters")
    return out


def parse_tests(gold: DataFrame) -> DataFrame:
    """Tests of gold files (page_id, content): one row a test, with ``errors``; an unreadable file is one row of errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, content in zip(*(batch.column(c).to_pylist() for c in ("page_id", "content"))):
                try:
                    doc = json.loads(content)
                except (TypeError, ValueError):
                    doc = None
                if not (isinstance(doc, dict) and set(doc) == {"tests"} and isinstance(doc["tests"], list)):
                    rows.append((None, page_id, None, None, None, None, None, None, ["gold is no object of tests alone"]))
                    continue
                for t in doc["tests"]:
                    get = t.get if isinstance(t, dict) else lambda k: None
                    text = lambda v: v if isinstance(v, str) else None
                    tags = get("tags") if isinstance(get("tags"), list) else []
                    rows.append(
                        (text(get("id")), page_id, text(get("test_type")), text(get("output_type")), text(get("derivation")),
                         [x for x in tags if isinstance(x, str)], json.dumps(get("args")), json.dumps(get("settings")), test_errors(t))
                    )
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    names = TEST.names
    types = [pa.string()] * 5 + [pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())]
    return gold.select("page_id", "content").mapInArrow(run, TEST)


def read_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Tests of every gold file under a folder; the file's name carries its page's id."""
    files = spark.read.option("wholetext", True).text(f"{folder}/gold/*.json")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return parse_tests(files.select(name.alias("page_id"), F.col("value").alias("content")))


def dataset_errors(pages: DataFrame, tests: DataFrame) -> DataFrame:
    """(page_id, rule) of what no single test shows: ids used twice, suites that mix families, outputs out of step."""
    twice = tests.groupBy("test_id").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")).where("n > 1")
    wants = tests.groupBy("page_id").agg(F.array_sort(F.collect_set("output_type")).alias("wants"))
    joined = pages.join(wants, "page_id", "left")
    headline = family(F.col("test_type")).isin(*vocab.HEADLINE_FAMILIES)
    mixed = (
        tests.join(pages.select("page_id", "suite"), "page_id")
        .groupBy("suite")
        .agg(F.count_if(headline).alias("a"), F.count_if(~headline).alias("b"), F.min("page_id").alias("page_id"))
        .where("a > 0 and b > 0")
    )
    ruled = lambda df, rule: df.select("page_id", F.lit(rule).alias("rule"))
    return (
        ruled(twice, "a test id is used twice")
        .unionByName(ruled(joined.where("wants is null"), "the page has no tests"))
        .unionByName(ruled(joined.where("wants is not null and wants <> outputs"), "the manifest's outputs are not what its tests read"))
        .unionByName(ruled(mixed, "a suite mixes format tests and headline tests"))
    )


def refuse(errors: DataFrame, shown: int = 3) -> None:
    """Raise with the first few errors, if there are any."""
    found = errors.orderBy(*errors.columns).limit(shown).collect()
    if found:
        raise ValueError("; ".join(" ".join(map(str, r)) for r in found))


def wanted_outputs(tests: DataFrame) -> DataFrame:
    return tests.groupBy("page_id").agg(F.array_sort(F.collect_set("output_type")).alias("outputs"))


def flat_tests(pages: DataFrame, tests: DataFrame) -> DataFrame:
    """Every test with its page's fields."""
    return tests.drop("errors").join(pages.select("page_id", "document", "suite", "doc_path"), "page_id")


# --- predictions and scores -----------------------------------------------------------------------------------------

BLOCK = "array<struct<label:string,bbox:array<double>,text:string>>"


def predictions(raw: DataFrame) -> DataFrame:
    """(page_id, html, blocks, error) of prediction files (page_id, content): an object whose ``pages`` holds one page."""
    pages = F.from_json(F.get_json_object("content", "$.pages"), f"array<struct<html:string,blocks:{BLOCK}>>")
    one = F.coalesce(F.size(pages), F.lit(-1)) == 1
    page = F.get(pages, F.lit(0))
    return raw.select(
        "page_id",
        F.when(one, page["html"]).alias("html"),
        F.when(one, page["blocks"]).alias("blocks"),
        F.when(~one, F.lit("unusable")).alias("error"),
    )


SCORES = (
    "id string, status string, row struct<document:string,suite:string>, tests long, passed long, ids decimal(20,0), "
    + ", ".join(f"{n} map<string,struct<tests:bigint,passed:bigint,ids:decimal(20,0)>>" for n in ("per_family", "per_tag", "per_test_type", "per_arg_kind", "per_derivation"))
)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score lines as counts: (page_id, document, slice, key, tests, passed, ids)."""
    lines = spark.read.schema(SCORES).json(path)
    named = {"families": "per_family"} | {n: n for n in ("per_tag", "per_test_type", "per_arg_kind", "per_derivation")}
    out = lines.where("row.suite is not null").selectExpr("id as page_id", "row.document as document", "'per_suite' as slice", "row.suite as key", "tests", "passed", "cast(null as decimal(20,0)) as ids")
    for slice_name, column in named.items():
        each = lines.select("id", "row.document", F.explode(column).alias("key", "c"))
        out = out.unionByName(each.selectExpr("id as page_id", "document", f"'{slice_name}' as slice", "key", "c.tests", "c.passed", "c.ids"))
    return out


def write_lines(verdicts: DataFrame, path: str) -> None:
    """Test lines as JSON, a folder for each suite."""
    result = F.when(F.col("passed"), "pass").otherwise("fail")
    lines = verdicts.withColumn("result", result).withColumn("suite_dir", F.col("suite")).drop("passed")
    lines.write.partitionBy("suite_dir").mode("overwrite").json(path)
