"""The command line: generate, eval, report, validate, prompt, experiments, and questions to make a question set.

Exit codes: 0 done; 1 a run with failed artifacts, or a fault of this program; 2 a problem with the input; 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from . import __version__
from .errors import ConfigError, TallyloomError, UnknownExperiment


def session(quiet: bool = False):
    """The active Spark session, or a local one, which tells its progress on a terminal unless quiet; the commands' files are on this machine."""
    from pyspark.sql import SparkSession

    found = SparkSession.getActiveSession()
    if found is None:
        found = SparkSession.builder.appName("tallyloom").config("spark.ui.showConsoleProgress", "true" if sys.stderr.isatty() and not quiet else "false").getOrCreate()
        found.sparkContext.setLogLevel("ERROR")
    return found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyloom", description="Make and score datasets for model evaluation.")
    top.add_argument("--version", action="version", version=f"tallyloom {__version__}")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, f, text: str) -> argparse.ArgumentParser:
        out = commands.add_parser(name, help=text, description=text)
        out.set_defaults(run=f)
        return out

    def config(p: argparse.ArgumentParser) -> None:
        p.add_argument("-c", "--config", required=True, help="a YAML configuration")
        p.add_argument("--set", dest="overrides", action="append", default=[], metavar="KEY=VALUE", help="put another value in, such as run.workers=4; may come again")

    p = command("generate", generate, "make media and their manifest")
    config(p)
    p.add_argument("--dry-run", action="store_true", help="check the configuration and its inputs and tell the plan, write nothing")
    p.add_argument("-q", "--quiet", action="store_true", help="no progress")
    p = command("eval", evaluate, "score a manifest whose model_output is filled in")
    p.add_argument("-i", "--input", required=True, help="a manifest, .jsonl or .csv")
    p.add_argument("-o", "--output-dir", help="where the results go (beside the input)")
    p.add_argument("--run-dir", help="what ground_truth_path is relative to (the input's folder)")
    p.add_argument("--group-by", help="columns to sum up by, with commas between")
    p.add_argument("--report", metavar="HTML", help="also write a report")
    p = command("report", report, "make a report of scored rows")
    p.add_argument("-i", "--input", required=True, help="scored rows, .jsonl or .csv")
    p.add_argument("-o", "--output", help="the page (the input with .html)")
    p.add_argument("--run-dir", help="the folder that holds media/ (the input's folder)")
    p.add_argument("--title")
    p.add_argument("--max-samples", type=int, help="list no more samples than these")
    config(command("validate", validate, "check a configuration"))
    p = command("prompt", prompt, "print a prompt")
    p.add_argument("experiment", nargs="?")
    p.add_argument("-k", "--kind", help="the kind of prompt (task)")
    p.add_argument("--condition", help="the message that goes with a manifest's condition")
    p.add_argument("--list", action="store_true", dest="all", help="list all prompts with their fields")
    command("experiments", experiments, "list the experiments")
    p = command("questions", make_questions, "make a question set of a folder of CSV files")
    p.add_argument("--from-csv", required=True, metavar="DIR")
    p.add_argument("--out", required=True)
    p.add_argument("--limit", type=int, default=0, help="questions to take, spread over the subjects (all)")
    p.add_argument("--max-words", type=int, default=0, help="leave longer ones out")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--subjects", nargs="*")
    return top


def _built(args: argparse.Namespace):
    from .plans import config, experiments

    return experiments.build(config.Settings.load(args.config, args.overrides))


def generate(args: argparse.Namespace) -> int:
    from .plans import progress

    spark = session(quiet=True)  # its own lines are shown instead
    made = _built(args)
    if not args.dry_run:
        with progress.shown(spark, made.name, quiet=args.quiet):
            result = made.run(spark)
        print(result.text())
        return 0 if result.ok else 1
    video = made.settings.video
    for name, value in (("experiment", made.name), ("run id", made.folder.run_id), ("run dir", made.folder.path), ("manifest", made.folder.manifest), ("config hash", made.settings.hash()), ("encoder", f"{video.codec} crf={video.crf} preset={video.preset} fps={video.fps}")):
        print(f"{name:<11}: {value}")
    if found := made.problems():
        sys.stdout.flush()
        print("\nthe inputs are NOT ready, this run would fail:", *[f"  - {x}" for x in found], sep="\n", file=sys.stderr)
        return 2
    print(*made.inputs(spark), "the configuration is valid and its inputs are there; nothing was written (--dry-run)", sep="\n")
    return 0


def evaluate(args: argparse.Namespace) -> int:
    import os

    from .operators import evaluate as scoring
    from .plans import report as pages

    by = [c.strip() for c in (args.group_by or "").split(",") if c.strip()]
    got = scoring.evaluate(session(), args.input, args.output_dir, run_dir=args.run_dir, by=by or None)
    print(scoring.text_summary(got["rows"], got["summary"], got["groups"], got["metrics"]), "", *[f"wrote {p}" for p in got["paths"]], sep="\n")
    if args.report:
        print("wrote", pages.write(got["rows"], args.report, run_dir=args.run_dir or os.path.dirname(args.input) or ".", metrics=got["metrics"], groups=got["groups"], title="Evaluation"))
    return 0


def report(args: argparse.Namespace) -> int:
    from pathlib import Path

    from .plans import report as pages

    print("wrote", pages.write_from_file(session(), args.input, args.output or str(Path(args.input).with_suffix(".html")), run_dir=args.run_dir, title=args.title, max_samples=args.max_samples))
    return 0


def validate(args: argparse.Namespace) -> int:
    made = _built(args)
    print(f"{args.config}: OK ({made.name}, config hash {made.settings.hash()})")
    return 0


def prompt(args: argparse.Namespace) -> int:
    from .plans import prompts

    if args.all:
        for experiment, kind in prompts.available():
            fields = ", ".join(prompts.placeholders(experiment, kind))
            print(f"{experiment:<8} {kind}" + (f"  (fields: {fields})" if fields else ""))
        return 0
    if not args.experiment or (args.kind and args.condition):
        print("error: name an experiment, or --list; and --kind or --condition, not both", file=sys.stderr)
        return 2
    print(prompts.for_condition(args.experiment, args.condition) if args.condition else prompts.get(args.experiment, args.kind or prompts.DEFAULT))
    return 0


def experiments(args: argparse.Namespace) -> int:
    from .plans.experiments import EXPERIMENTS

    print(*sorted(EXPERIMENTS), sep="\n")
    return 0


def make_questions(args: argparse.Namespace) -> int:
    from .sources import questions
    from .storage import stored

    spark = session()
    raw = questions.from_folder(spark, args.from_csv, args.subjects)
    good = stored(questions.usable(raw), "usable")
    out = questions.chosen(good, limit=args.limit, max_words=args.max_words, seed=args.seed)
    out = stored(out, "chosen")
    n, bad = questions.write_set(out, args.out), raw.count() - good.count()
    if not n:
        raise TallyloomError("no question is left; try a larger --max-words")
    told = questions.lengths(out).first()
    print(f"wrote {n} questions to {args.out}", f"  subjects      : {told.subjects}", f"  words/question: min {told.least}, median {told.median}, max {told.most}", sep="\n")
    for k, what in ((bad, "malformed"), (good.count() - good.where(questions.script_words() <= args.max_words).count() if args.max_words else 0, f"> {args.max_words} words")):
        if k:
            print(f"  skipped ({what}): {k}")
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (ConfigError, UnknownExperiment) as e:
        print(f"config error: {e}", file=sys.stderr)
    except (TallyloomError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
    except KeyboardInterrupt:
        print("interrupted", file=sys.stderr)
        return 130
    except Exception as e:
        print(f"internal error: {type(e).__name__}: {e}\nThis is a fault of tallyloom, not of your input.", file=sys.stderr)
        return 1
    return 2
