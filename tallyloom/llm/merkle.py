"""A Merkle manifest of a table: one tree of digests for each language, and one over their roots.

Bottom up, every run of consecutive nodes is joined to its parent, level by level, and each level is a stored table of
runs. Top down, proofs are pushed: a run hands each of its nodes the proof that it has itself inherited, with the node's
siblings put before it. So a row's proof is made by joins of runs, an eighth of the rows at most, and is as long as the
tree is high.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import places, scratch

FAN = 8
_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field_of(value: Column) -> Column:
    """- for null, else the bytes of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


@dataclass
class Tree:
    """Trees of a table: levels of runs from the leaves up (tree, run, total, digest, kids) and each tree's root with its level."""

    levels: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


def grown(leaves: DataFrame, carry: list[str], fan: int = FAN) -> Tree:
    """Trees over leaves (tree, place, total, digest and the columns of carry, which stay with the leaves).

    While a tree has more than one node, every fan consecutive ones become one, the last run with fewer, down to one.
    The number of levels grows with the logarithm of the largest tree.
    """
    out = Tree()
    most = leaves.agg(F.max("total")).first()[0] or 0
    nodes, high, found = leaves, 0, []
    while True:
        found.append(nodes.where("total = 1").select("tree", F.lit(high).alias("high"), "digest"))
        if most <= 1:
            break
        kid = F.struct((F.col("place") % fan).alias("k"), "digest", *(carry if high == 0 else []))
        runs = nodes.where("total > 1").groupBy("tree", F.expr(f"place div {fan}").alias("run")).agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.first("total").alias("total"))
        runs = runs.withColumns({"total": F.expr(f"(total + {fan - 1}) div {fan}"), "digest": digest(F.array_join("kids.digest", ""))})
        most, high = -(-most // fan), high + 1
        out.levels.append(scratch.stored(runs, f"level{high}"))
        nodes = out.levels[-1].select("tree", F.col("run").alias("place"), "total", "digest")
    out.roots = found[0]
    for more in found[1:]:
        out.roots = out.roots.unionByName(more)
    return out


def pushed(tree: Tree, roots: DataFrame, carry: list[str], lone: DataFrame, fan: int = FAN) -> DataFrame:
    """Every leaf with its proof: tree, digest, carry, proof, and the other columns of roots (tree, high, proof, ...).

    roots: what each tree's root inherits, with the level it is on. lone: the leaves of trees that have no other.
    """
    own = [c for c in roots.columns if c not in ("tree", "high", "proof")]
    down = None
    for high in range(len(tree.levels), 0, -1):
        here = roots.where(F.col("high") == high).select("tree", F.lit(0).cast("bigint").alias("run"), "proof", *own)
        here = here if down is None else here.unionByName(down)
        met = tree.levels[high - 1].select("tree", "run", "kids").join(here, ["tree", "run"])
        side = lambda keep: F.array_join(F.transform(F.filter("kids", keep), lambda x: x["digest"]), "")
        k = F.col("kid.k")
        met = met.select("tree", "run", "kids", "proof", *own, F.explode("kids").alias("kid"))
        step = F.struct(side(lambda x: x["k"] < k).alias("left"), side(lambda x: x["k"] > k).alias("right"))
        met = met.withColumn("proof", F.concat(F.array(step), "proof"))
        if high > 1:
            down = met.select("tree", (F.col("run") * fan + k).alias("run"), "proof", *own)
        else:
            down = met.select("tree", "kid.digest", *[F.col("kid")[c].alias(c) for c in carry], "proof", *own)
    alone = lone.select("tree", "digest", *carry).join(roots.where("high = 0").drop("high"), "tree").select("tree", "digest", *carry, "proof", *own)
    return alone if down is None else down.unionByName(alone)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def proofs(leaves: DataFrame, *, group: str, order: list[str], leaf: str, fan: int = FAN) -> DataFrame:
    """Every row of leaves, a stored table, with subroot (its group's root), root and proof (siblings left and right of it, from its run up to the root).

    A group's leaves ascend by order, rows that tie by their digest, which leaves the same tree whichever comes first;
    nulls come first. Groups ascend by their bytes, a null group is one of its own and comes first. A group of one leaf has
    that as its subroot, with no step. Columns named tree, place, total, digest, kids, run, high, subroot, root or proof are not
    to be in leaves. An empty table gives an empty one.
    """
    carry = list(leaves.columns)
    # Nulls and values as text that ascends in the same way.
    named = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))).withColumn("digest", F.col(leaf))
    low = scratch.stored(places.placed(named, ["tree"], [*order, leaf], "place", "total"), "leaves")
    lower = grown(low, carry, fan)
    subroots = scratch.stored(lower.roots, "subroots")
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "high", "digest").withColumnRenamed("high", "of_high")
    top = scratch.stored(places.placed(scratch.stored(tops, "tops"), ["tree"], ["of"], "place", "total"), "tops")
    upper = grown(top, ["of", "of_high"], fan)
    start = upper.roots.select("tree", "high", F.array().cast(_STEP).alias("proof"), F.col("digest").alias("root"))
    inherited = pushed(upper, start, ["of", "of_high"], top.where("total = 1"), fan)
    inherited = scratch.stored(inherited.select(F.col("of").alias("tree"), F.col("of_high").alias("high"), "proof", "root", F.col("digest").alias("subroot")), "inherited")
    return pushed(lower, inherited, carry, low.where("total = 1"), fan).select(*carry, "subroot", "root", "proof")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Nulls: any column counts as -; a null doc_id comes first and is never tampered with, a null lang is a tree of its own, the first.

    Texts are hashed whole. Rows with one doc_id are ordered by their leaves, equal rows each have a leaf and a place.
    Other columns of documents play no part. An empty table gives none.
    """
    docs = scratch.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda text: digest(*[field_of(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field_of(text))
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(changed, leaf(lowered(F.col("text")))).alias("tampered"))
    got = proofs(scratch.stored(leaves, "leaves"), group="lang", order=["doc_id"], leaf="leaf")
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    got = got.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return got.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12_SQL = f"""
with recursive d as (select *, coalesce('=' || lang, '-') as g, {_leaf_sql('text')} as leaf, case when doc_id is not null and {_CRC} % 3 = 0 then {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as tampered from documents),
r as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by g) as total, row_number() over () as id from d),
low as (select g, 0 as high, place, total, leaf as dg from r union all
  select g, high + 1, place // 8, (total + 7) // 8, sha256(string_agg(dg, '' order by place)) from low where total > 1 group by g, high, place // 8, total),
sub as (select g, high as top_high, dg as subroot, row_number() over (order by g) - 1 as place, count(*) over () as total from low where total = 1),
up as (select 0 as high, place, total, subroot as dg from sub union all
  select high + 1, place // 8, (total + 7) // 8, sha256(string_agg(dg, '' order by place)) from up where total > 1 group by high, place // 8, total),
rt as (select dg as root from up where total = 1),
steps as (
  select id, high, coalesce(string_agg(n.dg, '' order by n.place) filter (where n.place < r.place // (8 ** n.high)::bigint), '') as lft, coalesce(string_agg(n.dg, '' order by n.place) filter (where n.place > r.place // (8 ** n.high)::bigint), '') as rgt
  from r join low n on n.g = r.g and n.total > 1 and n.place // 8 = r.place // (8 ** (n.high + 1))::bigint group by id, high
  union all
  select id, top_high + u.high, coalesce(string_agg(u.dg, '' order by u.place) filter (where u.place < s.place // (8 ** u.high)::bigint), ''), coalesce(string_agg(u.dg, '' order by u.place) filter (where u.place > s.place // (8 ** u.high)::bigint), '')
  from r join sub s on s.g = r.g join up u on u.total > 1 and u.place // 8 = s.place // (8 ** (u.high + 1))::bigint group by id, top_high, u.high),
f as (select id, 0 as high, coalesce(tampered, leaf) as dg from r union all select f.id, f.high + 1, sha256(lft || dg || rgt) from f join steps s on s.id = f.id and s.high = f.high),
e as (select id, arg_max(dg, high) as folded_root from f group by id),
p as (select r.id, sha256(coalesce(string_agg(lft || rgt, '' order by high), '')) as proof_sha256 from r left join steps using (id) group by r.id)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from r join sub using (g) join e using (id) join p using (id), rt
"""
