"""Multiple-choice questions of several layouts."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, QuestionError
from ..functions import items
from ..operators import evaluate, sampling
from ..storage import stored
from . import csv_records, manifest


def _first(rows: DataFrame, *names: str):
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def shaped(rows: DataFrame, order: str = "_row") -> DataFrame:
    """id, stem, options, answer, domain, difficulty, source of rows in any of the layouts; a bad question raises.

    Rows without an id are numbered q_0000 on, past the ids that are taken.
    """
    names = rows.dtypes
    kind = dict(names)
    options = []
    for c in ("options", "choices"):
        if c in kind:
            if kind[c].startswith("array"):
                options.append(items.options_of(F.col(c)))
            elif kind[c].startswith("struct"):
                options.append(F.create_map(*[x for k in items.LETTERS for x in (F.lit(k), F.col(f"{c}.{k}"))]))
            else:
                options.append(F.col(c))
    if all(k in kind for k in items.LETTERS):
        options.append(F.create_map(*[x for k in items.LETTERS for x in (F.lit(k), F.col(k))]))
    raw = "answer" if "answer" in kind else "correct"
    letter = items.answer_letter(F.col(raw), integers=kind[raw] in ("int", "bigint", "smallint", "tinyint"))
    out = rows.select(
        F.col(order).alias("_row"), _first(rows, "id", "qid").alias("id"), _first(rows, "stem", "question").alias("stem"), F.coalesce(*options).alias("options"), letter.alias("answer"),
        _first(rows, "domain").alias("domain"), _first(rows, "difficulty").alias("difficulty"), _first(rows, "source", "subject").alias("source"),
    )
    blank = F.exists(F.map_values("options"), lambda v: F.coalesce(F.trim(v) == "", F.lit(True)))
    bad = F.when(F.col("stem").isNull(), "no stem").when(F.col("options").isNull() | blank, "options must be four").when(F.col("answer").isNull(), "bad answer")
    return numbered(out.withColumn("stem", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("stem"))))


def numbered(rows: DataFrame) -> DataFrame:
    """Fill missing ids: the k-th row without one gets the k-th number, from q_0000 on, that no id has."""
    missing = sampling.ranked(rows.where("id is null"), [], ["_row"], "_k")
    n = missing.count()
    if not n:
        return rows
    taken = rows.where("id is not null").select("id").distinct()
    upto = n + taken.where(F.col("id").rlike("^q_[0-9]{4,}$")).count()
    free = rows.sparkSession.range(upto).select(F.col("id").alias("_n"), F.format_string("q_%04d", "id").alias("id")).join(taken, "id", "left_anti")
    free = sampling.ranked(free, [], ["_n"], "_k").select("_k", F.col("id").alias("_id"))
    filled = missing.join(free, "_k").drop("_k", "id").withColumnRenamed("_id", "id")
    return rows.where("id is not null").unionByName(filled)


_CELLS = ("question", *items.LETTERS, "answer")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of headerless question,A,B,C,D,answer files: those cells, the file's path and _row. A row with fewer cells has no answer.

    Blank rows go, and a first row whose last cell is the name of a column.
    """
    found = csv_records.records(spark, path)
    rows = found.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(_CELLS)], "_file", "_row", "_first")
    rows = rows.where(F.concat_ws("", *[F.trim(F.coalesce(c, F.lit(""))) for c in _CELLS]) != "")
    return rows.where(~(F.col("_first") & F.lower(F.trim(F.coalesce("answer", F.lit("")))).isin("answer", "label", "target"))).drop("_first")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).withColumn("_row", F.monotonically_increasing_id())


def _from_lines(lines: DataFrame, path: str) -> DataFrame:
    """Questions of JSON lines, each in a layout of its own, in the columns of shaped(); _row is their order."""
    v = F.col("v")
    at = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    given = lambda *ks: F.coalesce(*[F.nullif(F.trim(at(k)), F.lit("")) for k in ks])
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    named = lambda top: F.create_map(*[x for k in items.LETTERS for x in (F.lit(k), F.trim(F.coalesce(at(top + k), F.lit(""))))])
    listed = lambda k: items.options_of(F.transform(F.try_variant_get(v, f"$.{k}", "array<string>"), lambda x: F.trim(x)))
    flat = F.when(F.array_size(F.array_compact(F.array(*map(at, items.LETTERS)))) == 4, named(""))
    options = F.when(kind("options").startswith("OBJECT"), named("options.")).when(kind("options").startswith("ARRAY"), listed("options")).when(kind("choices").startswith("ARRAY"), listed("choices")).otherwise(flat)
    which = F.when(kind("answer").isNull(), kind("correct")).otherwise(kind("answer"))
    raw = F.coalesce(at("answer"), at("correct"))
    letter = F.when(which == "STRING", items.answer_letter(raw)).when(which.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), items.answer_letter(raw.try_cast("int"), integers=True))
    rows = lines.select("_row", F.try_parse_json("value").alias("v"))
    return rows.select(
        "_row", F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "no JSON object").alias("_bad"), given("id", "qid").alias("id"), given("stem", "question").alias("stem"), options.alias("options"), letter.alias("answer"),
        given("domain").alias("domain"), given("difficulty").alias("difficulty"), given("source", "subject").alias("source"),
    )


def _wrong() -> F.Column:
    blank = F.exists(F.map_values("options"), lambda x: F.coalesce(F.trim(x) == "", F.lit(True)))
    return F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.col("stem").isNull(), "no stem").when(F.col("options").isNull() | blank, "options must be four").when(F.col("answer").isNull(), "bad answer")


def load(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    """The questions of a JSONL file or of headerless CSV, with _row as their order; what is wrong with a row names the file and the row.

    kind: jsonl, mmlu_csv, or auto by the file's name. No questions, and ids that repeat, raise too.
    """
    if kind == "auto":
        kind = "mmlu_csv" if path.lower().endswith(".csv") else "jsonl"
    if kind not in ("jsonl", "mmlu_csv"):
        raise QuestionError(f"unknown format {kind!r}, there are auto, jsonl and mmlu_csv")
    try:
        if kind == "jsonl":
            lines = spark.read.text(path).withColumn("_row", F.monotonically_increasing_id())
            shown = _from_lines(lines.where(F.trim("value") != ""), path)
        else:
            lines = read_csv(spark, path)
            short = F.when(F.col("answer").isNull(), "fewer than 6 cells")
            trimmed = [F.trim(F.coalesce(c, F.lit(""))) for c in items.LETTERS]
            shown = lines.select(
                "_row", short.alias("_bad"), F.lit(None).cast("string").alias("id"), F.nullif(F.trim("question"), F.lit("")).alias("stem"), F.create_map(*[x for k, c in zip(items.LETTERS, trimmed) for x in (F.lit(k), c)]).alias("options"),
                items.answer_letter(F.col("answer")).alias("answer"), F.lit("").alias("domain"), F.lit("").alias("difficulty"), F.replace(F.regexp_replace(items.file_name(F.col("_file")), r"_test|_val|\.[^.]*$", ""), F.lit("_"), F.lit(" ")).alias("source"),
            )
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise QuestionError(f"questions file not found: {path}") from e
        raise
    shown = stored(shown, "questions")
    first = shown.withColumn("wrong", _wrong()).where("wrong is not null").agg(F.min(F.struct("_row", "wrong")).alias("x")).first().x
    if first:
        n = lines.where(F.col("_row") <= first._row).count()
        raise QuestionError(f"{path}:{n}: {first.wrong}")
    out = numbered(shown.drop("_bad"))
    if out.isEmpty():
        raise QuestionError(f"{path}: no questions")
    twice = out.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()
    if twice:
        raise QuestionError(f"{path}: ids repeat: {[r.id for r in twice]}")
    return out


def as_dict() -> F.Column:
    """A question with its words, as a struct that JSON can hold."""
    seq = items.word_sequence(F.col("stem"), F.col("options"))
    return F.struct("id", "stem", "options", "answer", "domain", "difficulty", "source", seq.alias("word_sequence"), F.size(seq).alias("word_count"))


# Sets of questions made of raw files


def from_folder(spark: SparkSession, folder: str, subjects: list[str] | None = None) -> DataFrame:
    """Raw rows of a folder's CSV files: question, choices, answer, subject, the file's stem without its split; rows with fewer cells or no question go."""
    rows = read_csv(spark, f"{folder}/*.csv").where("answer is not null and trim(question) <> ''")
    rows = rows.where(~F.lower(F.trim("answer")).isin("answer", "label", "target"))
    subject = F.regexp_replace(F.regexp_replace(items.file_name(F.col("_file")), r"\.[^.]*$", ""), "_test|_val|_dev", "")
    out = rows.select("_row", F.trim("question").alias("question"), F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in items.LETTERS]).alias("choices"), F.trim("answer").alias("answer"), subject.alias("subject"))
    return out.where(F.col("subject").isin(*subjects)) if subjects else out


def usable(raw: DataFrame) -> DataFrame:
    """Raw rows (_row, question, choices, answer, subject) that make a question, as one; an index counts from 0. The others go."""
    letters = F.array(*map(F.lit, items.LETTERS))
    text = F.upper(F.trim(F.col("answer").cast("string")))
    letter = F.when(text.isin(*items.LETTERS), text).when(text.rlike("^[0-3]$"), F.get(letters, text.try_cast("int")))
    subject = F.trim(F.coalesce("subject", F.lit("")))
    out = raw.select("_row", F.trim("question").alias("stem"), items.options_of(F.transform("choices", lambda x: F.trim(x))).alias("options"), letter.alias("answer"), items.infer_domain(subject).alias("domain"), F.lit("").alias("difficulty"), F.coalesce(F.nullif(subject, F.lit("")), F.lit("MMLU")).alias("source"))
    return out.where("stem <> '' and options is not null and answer is not null")


def script_words() -> F.Column:
    """Words of a question as the set builder counts them: the stem's, each option's, and one for each letter."""
    return F.size(items._split(F.col("stem"))) + sum((F.size(items._split(F.element_at("options", F.lit(k)))) + 1 for k in items.LETTERS), F.lit(0))


def chosen(questions: DataFrame, *, limit: int = 0, max_words: int = 0, seed: int = 42) -> DataFrame:
    """Questions of at most max_words, limit of them spread over the subjects, and numbered q_00000 on in the order in which they were taken; 0 sets no bound."""
    kept = questions.where(script_words() <= max_words) if max_words > 0 else questions
    if limit > 0:
        kept = sampling.stratified(kept, "source", "_row", limit, seed)
    placed = stored(kept.withColumn("_turn", F.monotonically_increasing_id()), "chosen")
    return sampling.ranked(placed, [], ["_turn"], "_n").withColumn("id", F.format_string("q_%05d", F.col("_n") - 1)).drop("_n", "_turn")


def lengths(questions: DataFrame) -> DataFrame:
    """How many questions and subjects there are, and the least, upper median and most words."""
    counted = questions.select(script_words().alias("words"), "source")
    return counted.agg(F.count("*").alias("n"), F.countDistinct("source").alias("subjects")).join(evaluate.upper_median(counted, [], "words"), how="cross")  # both are one row


def write_set(questions: DataFrame, path: str) -> int:
    """Numbered questions as one JSONL file, by id."""
    return manifest.write_file(questions.select("id", "domain", "difficulty", "source", "stem", "options", "answer"), path, by="id")


def sniff(head: str, candidates: str = ",\t;|") -> str:
    """The delimiter of a table, from its first characters; where none stands out, a tab if there are more tabs than commas."""
    try:
        return csv.Sniffer().sniff(head, delimiters=candidates).delimiter
    except csv.Error:
        return "\t" if head.count("\t") > head.count(",") else ","


def read_table(spark: SparkSession, path: str, required: list[str], sep: str | None = None) -> DataFrame:
    """A table with a header; its delimiter is found from its first 8 KiB if none is given. Columns that lack, and no rows, raise."""
    if sep is None:
        sep = sniff("\n".join(r.value for r in spark.read.text(path).limit(100).collect())[:8192])
    rows = csv_records.table(spark, path, sep, empty=None)
    missing = [c for c in required if c not in rows.columns]
    if missing or rows.isEmpty():
        raise ConfigError(f"{path}: " + (f"no column {missing}, there are {rows.columns}" if missing else "no rows"))
    return rows
