"""Questions, clips, names, rates and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = ("A", "B", "C", "D")
#: Hints in a subject's name, in the order in which they are looked for.
DOMAIN_HINTS = {
    "medical": ("medicine", "medical", "anatomy", "clinical", "virology", "nutrition"),
    "stem": ("math", "physics", "chemistry", "biology", "computer", "engineering", "statistics", "astronomy", "econometrics", "electrical"),
    "humanities": ("history", "philosophy", "law", "religions", "moral", "logic", "prehistory"),
}
#: What a prober calls the output of an encoder.
CODEC_NAMES = {"libx264": "h264", "libx265": "hevc", "libvpx": "vp8", "libvpx-vp9": "vp9", "libaom-av1": "av1", "libsvtav1": "av1", "librav1e": "av1", "mjpeg": "mjpeg"}


def answer_letter(value: Column, integers: bool = False) -> Column:
    """A letter, or an index from 0; text "4" counts from 1. Null where none of these. integers: the column holds numbers."""
    letters = F.array(*map(F.lit, LETTERS))
    if integers:
        return F.when(value.between(0, 3), F.get(letters, value.cast("int")))
    s = F.upper(F.trim(value))
    k = s.try_cast("int")
    return F.when(s.isin(*LETTERS), s).when(k.between(0, 3), F.get(letters, k)).when(k == 4, F.lit("D"))


def options_of(choices: Column) -> Column:
    """An array of four choices as a map of letters; null for any other number or where one is blank."""
    good = (F.size(choices) == 4) & ~F.exists(choices, lambda c: F.coalesce(F.trim(c) == "", F.lit(True)))
    return F.when(good, F.map_from_arrays(F.array(*map(F.lit, LETTERS)), choices))


def _split(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def word_sequence(stem: Column, options: Column) -> Column:
    """The words in which a question is shown: the stem's, then each letter in brackets and its option's."""
    parts = [_split(stem)]
    for letter in LETTERS:
        parts += [F.array(F.lit(f"({letter})")), _split(F.element_at(options, F.lit(letter)))]
    return F.concat(*parts)


def question_text(stem: Column, options: Column) -> Column:
    return F.concat_ws("\n", stem, *[F.concat(F.lit(f"({k}) "), F.element_at(options, F.lit(k))) for k in LETTERS])


def infer_domain(subject: Column) -> Column:
    out = F
    for name, hints in DOMAIN_HINTS.items():
        out = out.when(F.lower(subject).rlike("|".join(hints)), name)
    return out.otherwise("commonsense")


def frames_per_word(fps: Column, words_per_second: Column, least: int = 1) -> Column:
    return F.greatest(F.lit(least), F.bround(fps / words_per_second, 0).cast("int"))


def clip_plan(seconds: Column, *, fps: int, per_move: int, intro: int, outro: int, intro_share: float = 0.2, outro_share: float = 0.2) -> dict[str, Column]:
    """How many moves a clip of so many seconds shows, and its frames."""
    budget = F.greatest(F.lit(1), F.bround(seconds * fps, 0).cast("int"))
    begin, end = (F.least(F.lit(n), F.floor(budget * share).cast("int")) for n, share in ((intro, intro_share), (outro, outro_share)))
    moves = F.greatest(F.lit(1), F.floor((budget - begin - end) / per_move).cast("int"))
    total = begin + moves * per_move + end
    return {"budget": budget, "intro_frames": begin, "outro_frames": end, "n_moves": moves, "total_frames": total, "actual_seconds": total / F.lit(float(fps))}


def gcd_of(holds: Column) -> Column:
    """The greatest common divisor of an array of counts; zeros don't matter, none gives 1. Forty-eight steps reach any int."""
    both = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(a.alias("x"), b.alias("y")), lambda p, _: F.when(p.y == 0, p).otherwise(F.struct(p.y.alias("x"), (p.x % F.when(p.y == 0, 1).otherwise(p.y)).alias("y")))).x
    out = F.aggregate(holds.cast("array<bigint>"), F.lit(0).cast("bigint"), lambda g, h: both(g, h))
    return F.when(out == 0, F.lit(1).cast("bigint")).otherwise(out)


def safe_id(name: Column) -> Column:
    out = F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.when(out == "", "clip").otherwise(out)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def subject_of(path: Column) -> Column:
    """A file's stem without the split at its end."""
    return F.regexp_replace(F.regexp_replace(file_name(path), r"\.[^.]*$", ""), "_(test|val|dev)$", "")


def rate(text: Column) -> Column:
    """30/1, 29.97 or N/A as a number; null where it is none."""
    part = lambda k: F.get(F.split(F.trim(text), "/"), F.lit(k)).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), F.try_divide(part(0), part(1))).otherwise(F.trim(text).try_cast("double"))


def codec_name(encoder: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in CODEC_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, encoder), encoder)


#: Fixed pattern of a template's field.
PLACEHOLDER = r"(?<!\{)\{([a-zA-Z_][a-zA-Z_0-9]*)\}(?!\})"


def placeholders(template: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))))


def render(template: Column, fields: dict[str, Column]) -> Column:
    """Fill a template; fields that it lacks, or that are missing, raise when it is evaluated. Doubled braces are literal.

    The template is cut at its fields once: what a field holds is not looked into.
    """
    between = F.split(template, PLACEHOLDER, -1)
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    values = F.create_map(*[x for k, v in sorted(fields.items()) for x in (F.lit(k), v.cast("string"))]) if fields else F.create_map().cast("map<string,string>")
    text = lambda t: F.replace(F.replace(t, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    parts = F.transform(between, lambda t, i: F.concat(F.when(i == 0, F.lit("")).otherwise(F.try_element_at(values, F.get(names, i - 1))), text(t)))
    wanted = F.array(*[F.lit(k) for k in sorted(fields)]) if fields else F.array().cast("array<string>")
    out = F.aggregate(parts, F.lit(""), lambda a, x: F.concat(a, x))
    return F.when(placeholders(template) == wanted, out).otherwise(F.raise_error(F.lit("the prompt's fields are others")))


def prompt_kind(experiment: Column, condition: Column) -> Column:
    """Which user message belongs to a condition."""
    moving = condition.startswith("vanishing") | condition.startswith("cumulative")
    return F.when(experiment != "wbw_mcq", "task").when(condition == "text", "user_text").when(condition == "static_image", "user_static_image").when(moving, "user_video")


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    for c in "<>&\u2028\u2029":
        json = F.replace(json, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return json


def inline_truth(text: Column, limit: int = 2000, marker: str = "\n…[truncated, see ground_truth_path]") -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit(marker)))
