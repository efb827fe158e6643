"""Command line: ``python -m pagemint.cli COMMAND``. JSON goes to standard output, messages to standard error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from pagemint import vocab
from pagemint.operators import statistics, summary
from pagemint.operators.grade import grade
from pagemint.session import local_session
from pagemint.sources import dataset, formats
from pagemint.sources import systems as service

PREDICTION_FILES = "predictions/*.json"


def read_predictions(spark, folder: str):
    files = spark.read.option("wholetext", True).text(f"{folder}/{PREDICTION_FILES}")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return dataset.predictions(files.select(name.alias("page_id"), F.col("value").alias("content")))


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def say(value) -> None:
    print(json.dumps(value, ensure_ascii=False, default=str))


def check(spark, args) -> None:
    pages, tests = dataset.read_manifest(spark, args.dataset), dataset.read_gold(spark, args.dataset)
    broken = tests.select("page_id", F.explode("errors").alias("rule"))
    dataset.refuse(dataset.manifest_errors(pages).unionByName(broken))
    dataset.refuse(dataset.dataset_errors(pages, tests))
    say({"ok": True, "pages": pages.count(), "suites": {r["suite"]: r["count"] for r in pages.groupBy("suite").count().collect()}})


def tests(spark, args) -> None:
    pages, found = dataset.read_manifest(spark, args.dataset), dataset.read_gold(spark, args.dataset)
    for r in dataset.flat_tests(pages, found).toLocalIterator():
        say(r.asDict(recursive=True) | {"args": json.loads(r["args"]), "settings": json.loads(r["settings"])})


def graded(spark, args) -> None:
    pages, found = dataset.read_manifest(spark, args.dataset), dataset.read_gold(spark, args.dataset)
    answers = read_predictions(spark, args.run)
    missing = pages.join(answers, "page_id", "left_anti").count()
    if missing and not args.partial:
        sys.exit(f"{missing} pages have no prediction; --partial grades the others")
    if args.partial:
        pages = pages.join(answers.select("page_id"), "page_id", "left_semi")
        found = found.join(pages.select("page_id"), "page_id", "left_semi")
    lines = grade(found.drop("errors"), answers, pages)
    out = f"{args.run}/unit_tests"
    dataset.write_lines(lines, f"{out}/details")
    counts = summary.page_counts(lines)
    counts.write.mode("overwrite").parquet(f"{out}/counts")
    say(summary.as_json(summary.summary(lines)))


def counts_of(spark, run: str):
    return summary.document_counts(spark.read.parquet(f"{run}/unit_tests/counts"))


def intervals(spark, args) -> None:
    say(rows(statistics.intervals(counts_of(spark, args.run), args.resamples, args.seed, args.level)))


def compare(spark, args) -> None:
    a, b = counts_of(spark, args.run), counts_of(spark, args.other)
    say({"pairing": rows(statistics.pairing(a, b))[0], "entries": rows(statistics.paired(a, b, args.resamples, args.seed, args.level))})


def reliability(spark, args) -> None:
    counts = totals = None
    for run in args.runs:
        own = counts_of(spark, run).withColumn("system", F.lit(run))
        whole = own.where("slice = 'families'").groupBy("system", "document").agg(F.sum("tests").alias("tests"), F.sum("passed").alias("passed"))
        counts, totals = (own, whole) if counts is None else (counts.unionByName(own), totals.unionByName(whole))
    found = statistics.reliability(counts, totals, args.splits, args.seed, args.threshold, args.min_documents, not args.unbalanced)
    say(rows(found.where("flag") if args.flagged else found))


def score(spark, args) -> None:
    """Verdicts of one page: a file of html (or blocks as JSON) against a gold file."""
    with open(args.gold) as f:
        gold = spark.createDataFrame([("page", f.read())], "page_id string, content string")
    with open(args.output) as f:
        said = f.read()
    found = dataset.parse_tests(gold)
    dataset.refuse(found.select("page_id", F.explode("errors").alias("rule")))
    blocks = F.from_json(F.lit(said), dataset.BLOCK) if args.blocks else F.lit(None).cast(dataset.BLOCK)
    html = F.lit(None if args.blocks else said).cast("string")
    answer = spark.range(1).select(F.lit("page").alias("page_id"), html.alias("html"), blocks.alias("blocks"))
    page = spark.createDataFrame([("page", "document", "other")], "page_id string, document string, suite string")
    for r in grade(found.drop("errors"), answer, page).orderBy("test_id").collect():
        say({"test_id": r["test_id"], "result": "pass" if r["passed"] else "fail", "why": r["why"]})


def reread(spark, args) -> None:
    """Blocks of saved answers (a JSON file a page) by a format, as prediction files' content."""
    files = spark.read.option("wholetext", True).text(f"{args.answers}/*.json")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    raw = files.select(name.alias("page_id"), F.col("value").alias("raw"))
    for r in formats.read_answers(raw, formats.FORMATS[args.format]).drop("raw").toLocalIterator():
        say(r.asDict(recursive=True))


CONFIG = "config.json"
DEFAULTS = {"timeout": 900.0, "tries": 4, "workers": 8}


def init(spark, args) -> None:
    """A configuration of a run with every setting, to be saved and given to ``run``."""
    say({"system": args.system, "dataset": args.dataset} | DEFAULTS)


def launched(spark, config: dict, folder: str, retry_failed: bool = False) -> None:
    """Ask the system about pages without a record, read all records and grade them; pages without an output fail."""
    unknown = set(config) - {"system", "dataset", *DEFAULTS}
    if unknown or not {"system", "dataset"} <= set(config):
        raise ValueError(f"a configuration has system, dataset and {', '.join(DEFAULTS)}; not {', '.join(sorted(unknown)) or 'those'}")
    config = DEFAULTS | config
    system = service.load(config["system"])
    pages, found = dataset.read_manifest(spark, config["dataset"]), dataset.read_gold(spark, config["dataset"])
    files = spark.read.format("binaryFile").load(f"{config['dataset']}/pages").select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    content = files.select(name.alias("file"), "content").join(
        pages.select("page_id", "outputs", F.element_at(F.split("doc_path", "/"), -1).alias("file")), "file"
    )
    records = f"{folder}/records"
    asked = service.ask(content, system, records, config["timeout"], config["tries"], 1.0, config["workers"], retry_failed=retry_failed)
    print(f"{asked} pages asked", file=sys.stderr)
    answers = service.outputs(service.settled(service.held(spark, records)), system)
    lines = grade(found.drop("errors"), answers.drop("error"), pages)
    dataset.write_lines(lines, f"{folder}/unit_tests/details")
    summary.page_counts(lines).write.mode("overwrite").parquet(f"{folder}/unit_tests/counts")
    covered = rows(summary.coverage(pages, answers))[0]
    say(summary.as_json(summary.summary(lines)) | {"coverage": covered})


def run(spark, args) -> None:
    """A new run of a configuration in a folder that does not exist yet."""
    with open(args.config) as f:
        config = json.load(f)
    if os.path.exists(args.out):
        raise ValueError(f"{args.out} exists already; resume goes on with a run")
    os.makedirs(args.out)
    with open(f"{args.out}/{CONFIG}", "w") as f:
        json.dump(config, f)
    launched(spark, config, args.out)


def resume(spark, args) -> None:
    """Go on with the run in a folder, by its own configuration."""
    try:
        with open(f"{args.out}/{CONFIG}") as f:
            config = json.load(f)
    except FileNotFoundError:
        raise ValueError(f"{args.out} holds no run") from None
    launched(spark, config, args.out, args.retry_failed)


def predict(spark, args) -> None:
    """What a system makes of one page file."""
    system = service.load(args.system)
    with open(args.page, "rb") as f:
        raw, error, seconds, tries = service.answer(system, f.read(), args.outputs.split(","), args.timeout, DEFAULTS["tries"], 1.0)
    record = spark.createDataFrame([("page", raw, error, seconds, tries)], service.RECORDS)
    say(rows(service.outputs(record, system).drop("page_id"))[0] | {"why": error, "seconds": seconds, "tries": tries})


def systems(spark, args) -> None:
    say({name: {"labels": form.labels, "blocks": form.blocks} for name, form in formats.FORMATS.items()})


def vocabulary(spark, args) -> None:
    say({"test_types": vocab.TEST_TYPES, "derivations": vocab.DERIVATIONS, "labels": vocab.LABELS, "marks": vocab.MARKS})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagemint")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *positional: str):
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x, nargs="+" if x == "runs" else None)
        p.set_defaults(run_command=run)
        return p

    add("check", check, "dataset")
    add("tests", tests, "dataset")
    add("grade", graded, "dataset", "run").add_argument("--partial", action="store_true")
    for p in (add("intervals", intervals, "run"), add("compare", compare, "run", "other")):
        p.add_argument("--resamples", type=int, default=1000)
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--level", type=float, default=0.95)
    p = add("reliability", reliability, "runs")
    p.add_argument("--splits", type=int, default=100)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--threshold", type=float, default=0.7)
    p.add_argument("--min-documents", type=int, default=10)
    p.add_argument("--unbalanced", action="store_true")
    p.add_argument("--flagged", action="store_true")
    add("score", score, "gold", "output").add_argument("--blocks", action="store_true")
    add("reread", reread, "answers").add_argument("--format", choices=sorted(formats.FORMATS), required=True)
    add("init", init, "system", "dataset")
    add("run", run, "config", "out")
    add("resume", resume, "out").add_argument("--retry-failed", action="store_true")
    p = add("predict", predict, "system", "page")
    p.add_argument("--outputs", default="html")
    p.add_argument("--timeout", type=float, default=DEFAULTS["timeout"])
    add("systems", systems)
    add("vocabulary", vocabulary)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run_command(local_session("*"), args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
