"""A self-contained HTML report of scored rows."""

from __future__ import annotations

import html
import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import items
from ..operators import evaluate, sampling
from ..sources import one_file
from ..storage import scratch_path, stored
from .runs import put_text

#: Columns that a sample's card doesn't list.
HIDDEN = ("media_path", "media_filename", "ground_truth_path", "pov_version", "generated_at", "config_hash", "ground_truth", "model_output")
#: What a browser shows as a video and as an image.
VIDEOS, IMAGES = ("mp4", "webm", "mov", "m4v"), ("jpg", "jpeg", "png", "gif", "webp")


def short(column: str) -> str:
    return column.removeprefix("score_")


def details(rows: DataFrame) -> DataFrame:
    """sample_id and, as JSON, what a sample's card lists: its other columns that aren't blank."""
    shown = sorted(c for c in rows.columns if c not in (*HIDDEN, "sample_id", "experiment", "condition") and not c.startswith(("cfg_", "score_")))
    return rows.select("sample_id", F.to_json(_listed(shown)).alias("details"))


def _listed(shown: list[str]) -> Column:
    if not shown:
        return F.create_map().cast("map<string,string>")
    pairs = F.map_from_arrays(F.array(*map(F.lit, shown)), F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in shown]))
    return F.map_filter(pairs, lambda _, v: F.trim(v) != "")


def media_kind(path: Column) -> Column:
    """video, image, or nothing, by a path's extension."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(end.isin(*VIDEOS), "video").when(end.isin(*IMAGES), "image").otherwise("")


def media_link(path: Column, run_dir: str, page_dir: str) -> Column:
    """A run's media path as a page in page_dir links to it; blank where there is none."""
    way = os.path.relpath(run_dir, page_dir).replace(os.sep, "/")
    return F.when(F.trim(F.coalesce(path, F.lit(""))) == "", "").otherwise(F.concat(F.lit("" if way == "." else f"{way}/"), F.trim(path)))


def search(rows: DataFrame, text: str, condition: str | None, metric: str) -> DataFrame:
    """Rows whose id, truth or output hold text, of a condition, worst first, unscored before all."""
    where = F.contains(F.lower(F.concat_ws(" ", "sample_id", "ground_truth", "model_output")), F.lit(text.lower()))
    out = rows.where(where) if condition is None else rows.where(where & (F.col("condition") == condition))
    return out.orderBy(F.col(metric).asc_nulls_first(), "sample_id")


def samples(rows: DataFrame, metrics: list[str], run_dir: str = ".", page_dir: str = ".", keep: list[str] | None = None) -> DataFrame:
    """What the page holds of each row, after the columns of keep: names, link and kind of its media, truth, output, scores and details."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    path = text("media_path")
    other = [c for c in rows.columns if c not in HIDDEN and c not in (keep or []) and not c.startswith(("cfg_", "score_"))]
    scores = F.map_from_arrays(F.array(*[F.lit(short(m)) for m in metrics]), F.array(*[evaluate.number(F.col(m)) for m in metrics])) if metrics else F.create_map().cast("map<string,double>")
    return rows.select(
        *(keep or []), text("sample_id").alias("id"), text("experiment").alias("experiment"), text("condition").alias("condition"), text("model").alias("model"), media_link(path, run_dir, page_dir).alias("mediaSrc"), media_kind(path).alias("mediaKind"),
        text("ground_truth").alias("groundTruth"), text("model_output").alias("modelOutput"), F.map_filter(scores, lambda _, v: v.isNotNull()).alias("scores"), _listed(other).alias("details"),
    )


_STYLE = """body{font:15px/1.5 sans-serif;margin:2rem auto;max-width:70rem;padding:0 1rem}.cards span{display:inline-block;border:1px solid #ccc;border-radius:.5rem;padding:.4rem .8rem;margin:0 .5rem .5rem 0}
table{border-collapse:collapse}th,td{padding:.3rem .7rem;border-bottom:1px solid #ddd;text-align:left}td.n{text-align:right}details{border:1px solid #ccc;border-radius:.5rem;margin:.5rem 0;padding:.4rem .8rem}video,img{max-width:100%;max-height:24rem}pre{white-space:pre-wrap;background:#f4f4f4;padding:.5rem}"""
# The page's list: by condition, by words in id, truth and output, and by a metric with the worst and the unscored first.
_SCRIPT = """
const all = JSON.parse(document.getElementById('data').textContent), list = document.getElementById('list');
const pick = id => document.getElementById(id);
for (const c of [...new Set(all.map(s => s.condition))].sort()) pick('condition').add(new Option(c));
for (const m of [...new Set(all.flatMap(s => Object.keys(s.scores)))]) pick('metric').add(new Option(m));
const box = (parent, tag, text) => { const e = parent.appendChild(document.createElement(tag)); if (text !== undefined) e.textContent = text; return e; };
function show() {
  const text = pick('text').value.toLowerCase(), c = pick('condition').value, m = pick('metric').value, score = s => m in s.scores ? s.scores[m] : -Infinity;
  const found = all.filter(s => (!c || s.condition === c) && [s.id, s.groundTruth, s.modelOutput].join(' ').toLowerCase().includes(text));
  if (m) found.sort((a, b) => score(a) - score(b));
  list.replaceChildren();
  pick('count').textContent = `${found.length} of ${all.length}`;
  for (const s of found) {
    const card = box(list, 'details');
    box(card, 'summary', [s.id, s.condition, ...Object.entries(s.scores).map(([k, v]) => `${k} ${v.toFixed(3)}`)].join(' · '));
    card.addEventListener('toggle', () => {
      if (!card.open || card.dataset.made) return;
      card.dataset.made = 1;
      if (s.mediaKind) { const e = box(card, s.mediaKind === 'video' ? 'video' : 'img'); e.src = s.mediaSrc; e.controls = true; }
      for (const [name, value] of [['ground truth', s.groundTruth], ['model output', s.modelOutput], ...Object.entries(s.details)]) { box(card, 'b', name); box(card, 'pre', value); }
    });
  }
}
for (const id of ['text', 'condition', 'metric']) pick(id).addEventListener('input', show);
show();
"""


# The same list where rows lie in pages: they are asked for one after the other, in the chosen order, until enough are found.
_PAGED = """
const index = JSON.parse(document.getElementById('index').textContent), list = document.getElementById('list'), held = new Map(), waiting = new Map();
const pick = id => document.getElementById(id);
const report = { page: (k, rows) => waiting.get('page' + k)(rows), order: (m, k, places) => waiting.get('order' + m + '.' + k)(places) };
for (const c of index.conditions) pick('condition').add(new Option(c));
for (const m of index.metrics) pick('metric').add(new Option(m));
const box = (parent, tag, text) => { const e = parent.appendChild(document.createElement(tag)); if (text !== undefined) e.textContent = text; return e; };
function load(key, file) {
  if (!held.has(key)) {
    if (held.size >= 40) held.delete(held.keys().next().value);
    held.set(key, new Promise(done => {
      waiting.set(key, got => { waiting.delete(key); done(got); });
      const s = document.head.appendChild(document.createElement('script'));
      s.src = `${index.data}/${file}.js`; s.onload = () => s.remove();
    }));
  }
  return held.get(key);
}
const number = k => String(k).padStart(5, '0'), page = k => load('page' + k, 'page-' + number(k));
async function* rows(metric) {
  for (let k = 0; k < index.pages; k++) {
    if (metric < 0) { yield* await page(k); continue; }
    for (const n of await load(`order${metric}.${k}`, `order${metric}-` + number(k))) yield (await page(Math.floor(n / index.pageRows)))[n % index.pageRows];
  }
}
let turn = 0, more = () => {};
function card(s) {
  const c = box(list, 'details');
  box(c, 'summary', [s.id, s.condition, ...Object.entries(s.scores).map(([k, v]) => `${k} ${v.toFixed(3)}`)].join(' · '));
  c.addEventListener('toggle', () => {
    if (!c.open || c.dataset.made) return;
    c.dataset.made = 1;
    if (s.mediaKind) { const e = box(c, s.mediaKind === 'video' ? 'video' : 'img'); e.src = s.mediaSrc; e.controls = true; }
    for (const [name, value] of [['ground truth', s.groundTruth], ['model output', s.modelOutput], ...Object.entries(s.details)]) { box(c, 'b', name); box(c, 'pre', value); }
  });
}
async function show() {
  const mine = ++turn, text = pick('text').value.toLowerCase(), c = pick('condition').value, all = rows(index.metrics.indexOf(pick('metric').value));
  let found = 0, seen = 0;
  list.replaceChildren();
  more = async () => {
    for (let n = 0; n < 200; ) {
      const { value: s, done } = await all.next();
      if (mine !== turn) return;
      if (done) break;
      seen++;
      if ((!c || s.condition === c) && [s.id, s.groundTruth, s.modelOutput].join(' ').toLowerCase().includes(text)) { card(s); found++; n++; }
    }
    pick('count').textContent = `${found} found in the first ${seen} of ${index.rows}`;
  };
  await more();
}
for (const id of ['text', 'condition', 'metric']) pick(id).addEventListener('input', show);
pick('more').addEventListener('click', () => more());
show();
"""


def build(rows: DataFrame, *, title: str = "Report", max_samples: int | None = None, metrics: list[str] | None = None, groups: list[str] | None = None, run_dir: str = ".", page_dir: str = ".") -> str:
    """The page as one text: counts over all rows, the summary with bars, and the rows as data, or the first max_samples of them by id.

    For as many rows as a page can hold, of which write_paged() takes more; the counts and the summary are made by Spark.
    """
    metrics = evaluate.metrics_of(rows) if metrics is None else metrics
    ordered = rows.orderBy("sample_id")
    held = samples(ordered.limit(max_samples) if max_samples is not None else ordered, metrics, run_dir, page_dir)
    data = [r.j for r in held.select(_as_json().alias("j")).toLocalIterator()]
    tail = f"<script id=data type=application/json>[{','.join(data)}]</script><script>{_SCRIPT}</script>"
    return _page(rows, title, metrics, groups, sum('"mediaSrc":""' not in j for j in data), tail)


def _as_json() -> Column:
    return items.script_safe(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))


def _page(rows: DataFrame, title: str, metrics: list[str], groups: list[str] | None, linked: int, tail: str) -> str:
    """The page around its list of rows, which tail holds or loads."""
    groups = evaluate.default_groups(rows, run=False) if groups is None else groups
    summary = evaluate.bars(evaluate.summarise(rows, groups, metrics), metrics).orderBy(*groups).collect()  # a row per group
    cell = lambda v: html.escape("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))
    told = evaluate.experiments_of(rows).first() if {"experiment", "condition"} <= set(rows.columns) else None
    cards = [("samples", rows.count()), *([("experiments", ", ".join(told.experiments) or "—"), ("conditions", told.conditions)] if told else []), ("media linked", linked)]
    head = "".join(f"<th>{cell(short(c))}</th>" for c in [*groups, "n", *metrics])
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in [*groups, "n"]) + "".join(f'<td class=n><meter max=100 value="{r[m + "_bar"]}"></meter> {cell(r[m]) or "—"}</td>' for m in metrics) + "</tr>" for r in summary)
    table = f"<table><tr>{head}</tr>{body}</table>" if summary else "<p>No summary rows.</p>"
    shown = "".join(f"<span><b>{cell(v)}</b> {k}</span>" for k, v in cards)
    tools = "<p><input id=text placeholder=search> <select id=condition><option value=''>all conditions</option></select> <select id=metric><option value=''>by id</option></select> <span id=count></span></p>"
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{cell(title)}</title><style>{_STYLE}</style></head><body><h1>{cell(title)}</h1><p class=cards>{shown}</p>{table}{tools}<div id=list></div>{tail}</body></html>"


#: Rows of a page of data, and how many a report holds in itself.
PAGE_ROWS, HELD_ROWS = 2000, 20_000


def write_paged(rows: DataFrame, path: str, *, run_dir: str | None = None, title: str = "Report", metrics: list[str] | None = None, groups: list[str] | None = None, page_rows: int = PAGE_ROWS) -> str:
    """A report whose rows lie in pages beside it, in <name>_data, that the browser loads as they are needed.

    Rows in order of their ids, page_rows a page, and for each metric the rows' places from the worst on, are written by executors;
    the driver copies pages' bytes, one after the other, and holds none. Pages are scripts, as a page opened from a folder may load those.
    """
    target, spark = Path(path), rows.sparkSession
    metrics = evaluate.metrics_of(rows) if metrics is None else metrics
    data = target.with_name(f"{target.stem}_data")
    where = str(target.parent)
    placed = stored(sampling.ranked(rows, [], ["sample_id"], "_n"), "report")
    held = samples(placed, metrics, run_dir or where, where, keep=["_n"]).withColumn("page", F.expr(f"(_n - 1) div {page_rows}"))
    linked = held.agg(F.count_if(F.col("mediaSrc") != "").alias("n")).first().n
    line = held.select("page", "_n", items.script_safe(F.to_json(F.struct(*[c for c in held.columns if c not in ("page", "_n")]), {"ignoreNullFields": "false"})).alias("j"))
    # A page has page_rows rows.
    text = line.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "j"))), lambda x: x["j"]), ",").alias("t"))
    count = _put(text.select("page", F.concat(F.lit("report.page("), F.col("page").cast("string"), F.lit(",["), "t", F.lit("])")).alias("value")), data, "page")
    for k, m in enumerate(metrics):
        order = sampling.ranked(placed.select("sample_id", "_n", evaluate.number(F.col(m)).alias("_score")), [], ["_score", "sample_id"], "_at").withColumn("page", F.expr(f"(_at - 1) div {page_rows}"))
        places = order.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_n"))), lambda x: (x["_n"] - 1).cast("string")), ",").alias("t"))
        _put(places.select("page", F.concat(F.lit(f"report.order({k},"), F.col("page").cast("string"), F.lit(",["), "t", F.lit("])")).alias("value")), data, f"order{k}")
    conditions = [r[0] for r in rows.select(F.col("condition").cast("string")).distinct().orderBy("condition").collect() if r[0]] if "condition" in rows.columns else []  # a row per condition
    index = json.dumps({"data": data.name, "rows": rows.count(), "pageRows": page_rows, "pages": count, "conditions": conditions, "metrics": [short(m) for m in metrics]})
    for c, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        index = index.replace(c, safe)
    tail = f"<button id=more>more</button><script id=index type=application/json>{index}</script><script>{_PAGED}</script>"
    put_text(target, _page(rows, title, metrics, groups, linked, tail))
    return str(target)


def _put(texts: DataFrame, folder: Path, name: str) -> int:
    """A file <name>-<page>.js of each row (page, value); returns how many they are."""
    spark, parts = texts.sparkSession, scratch_path(texts.sparkSession, "pages")
    at = spark._jvm.org.apache.hadoop.fs.Path(parts)  # noqa: SLF001
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    n = 0
    try:
        texts.write.partitionBy("page").text(parts)
        for page in store.listStatus(at):
            if (m := re.fullmatch(r"page=(\d+)", page.getPath().getName())) is None:
                continue
            files = [p.getPath().toString() for p in store.listStatus(page.getPath())]
            one_file.join(spark, files, str(folder / f"{name}-{int(m[1]):05d}.js"), b"")
            n += 1
    finally:
        store.delete(at, True)
    return n


def write(rows: DataFrame, path: str, *, run_dir: str | None = None, max_samples: int | None = None, **how) -> str:
    """The report as a file, which links media from there; more rows than HELD_ROWS lie in pages beside it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    if max_samples is None and rows.limit(HELD_ROWS + 1).count() > HELD_ROWS:
        return write_paged(rows, path, run_dir=run_dir, **how)
    put_text(target, build(rows, run_dir=run_dir or str(target.parent), page_dir=str(target.parent), max_samples=max_samples, **how))
    return str(target)


def write_from_file(spark: SparkSession, scored: str, path: str, *, run_dir: str | None = None, title: str | None = None, max_samples: int | None = None) -> str:
    """The report of a file of scored rows: its metrics are the score_ columns that hold numbers alone."""
    from ..sources import manifest

    rows = manifest.read(spark, scored)
    base = run_dir or os.path.dirname(scored) or "."
    return write(rows, path, run_dir=base, title=title or f"Evaluation: {Path(scored).resolve().parent.name}", max_samples=max_samples, metrics=evaluate.metrics_of(rows, all_numbers=True), groups=evaluate.default_groups(rows, run=False))


def text_table(summary: DataFrame) -> str:
    """A table in aligned columns, under its names without their prefix; numbers with four places."""
    rows = [[f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in summary.collect()]
    names = [short(c) for c in summary.columns]
    wide = [max(map(len, col)) for col in zip(names, *rows)]
    return "\n".join("  " + "  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in [names, ["-" * w for w in wide], *rows])
