"""Best representative of each duplicate group (problem 1).

Rows of one article are linked by the same DOI, whole title or own file name, form aside; groups are the connected
components of these links. The surviving record is put together from bundles of dependent fields: each bundle is
taken whole from one row. A branch-and-bound search chooses one candidate per bundle so that the trust given up is
least, under functional dependencies: where DOI -> bundle is declared, the bundle must come from a row with the chosen
DOI whenever such a row has it intact. Bundles are weighed in their order, so a dependency can move a later bundle but
never a better-placed earlier one.

Groups of any size: candidates are reduced, before they meet in one row, to the latest intact one per group, bundle,
corpus rank and agreement with the DOI - a fixed small number - by aggregation with map-side combine.

Defined results: a field that is intact nowhere is null; an unknown or null corpus is trusted least, a null
timestamp is the oldest; a title that is how a longer one of its group begins counts as cut; equal trust and time go to the smaller row_id; placeholders, cut values and shared file names
link nothing; rows without any key form no group; repeated rows count as rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import broadcast_if_small, stage

#: fixed values: words that stand for a missing title, DOI or name
PLACEHOLDERS = ("", "n/a", "na", "none", "null", "-", "?", "unknown", "not available", "not reported", "doi pending", "pending", "untitled", "untitled document", "[no title]", "no title", "title", "document", "nan", "tbd")
_CUT = r"(…|\.\.\.|\[\.\.\.\]|\[…\])\s*$"
_TOOL = r"(?i)^\s*(microsoft (word|powerpoint)|slide \d|layout \d|untitled)\b.*"
_COPY = r"(?i)(^copy of\s+|\s*\(\d+\)(?=\.[a-z0-9]+$)|[\s_-]+copy(\s*\(\d+\))?(?=\.[a-z0-9]+$))"
DOI_FORM = r"^10\.[0-9]{4,9}/[^\s\p{Z}]*[A-Za-z0-9]$"


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))


def doi_key(c: Column) -> Column:
    """The DOI in a field without what stands around or in it, in lower case; null if there is no whole one."""
    found = F.regexp_extract(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", ""), r"(10\.[0-9]{4,9}/.*[a-z0-9])", 1)
    return F.when(found != "", found)


def title_key(c: Column) -> Column:
    """Letters and digits of a whole title in one case; null for placeholders and cut titles."""
    folded = F.translate(F.regexp_replace(F.lower(c), "ß", "ss"), "ı̇", "i")
    key = F.regexp_replace(folded, r"[^\p{L}\p{N}]", "")
    return F.when(~_plain(c).isin(*PLACEHOLDERS) & ~c.rlike(_CUT) & ~c.rlike(_TOOL) & (key != ""), key)


def file_key(c: Column) -> Column:
    key = F.regexp_replace(_plain(c), _COPY, "")
    return F.when(~_plain(c).isin(*PLACEHOLDERS) & (key != ""), key)


def title_intact(c: Column) -> Column:
    return title_key(c).isNotNull() & (F.upper(c) != c) & ~c.rlike(r"^[\s\p{Z}]|[\s\p{Z}]$|[\s\p{Z}]{2}|[\r\n\t\x{A0}\x{2009}]")


def linked(rows: DataFrame) -> DataFrame:
    """rows (row_id, file_name, doi, title, ...) with component, file_shared, title_cut; rows of groups of two or more.

    A file name is one of its own unless rows with different DOIs carry it; a title is cut if it is how a longer title of
    its group begins. Only keys are staged and linked; the fields are read when the groups are known.
    """
    key_of = {"doi_key": doi_key(F.col("doi")), "title_key": title_key(F.col("title")), "file_key": file_key(F.col("file_name"))}
    keyed = stage(rows.where("row_id is not null").select("row_id", *[c.alias(k) for k, c in key_of.items()]), "keys")
    shared = stage(keyed.where("file_key is not null").groupBy("file_key").agg(F.min("doi_key").alias("a"), F.max("doi_key").alias("b")).where("a < b").select("file_key", F.lit(True).alias("file_shared")), "shared-names")
    shared = broadcast_if_small(shared)
    named = keyed.join(shared, "file_key", "left")
    edges = None
    for kind, key in (("d", F.col("doi_key")), ("t", F.col("title_key")), ("f", F.when(F.col("file_shared").isNull(), F.col("file_key")))):
        part = named.select("row_id", F.concat(F.lit(kind), key).alias("key")).where("key is not null")
        edges = part if edges is None else edges.unionByName(part)
    heads = edges.groupBy("key").agg(F.min("row_id").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    groups = components(edges.join(heads, "key").select(F.col("row_id").alias("u"), "v")).withColumnRenamed("node", "row_id")
    found = rows.join(groups, "row_id").withColumns(key_of).join(shared, "file_key", "left").withColumn("file_shared", F.coalesce("file_shared", F.lit(False)))
    # of sorted titles the one after a cut one goes on with its letters; only the different titles of a group are sorted
    titles = keyed.where("title_key is not null").join(groups, "row_id").select("component", "title_key").distinct()
    after = F.lead("title_key").over(Window.partitionBy("component").orderBy("title_key"))
    cut = stage(titles.withColumn("after", after).where(F.startswith("after", "title_key")).select("component", "title_key", F.lit(True).alias("title_cut")), "cut-titles")
    return found.join(broadcast_if_small(cut), ["component", "title_key"], "left").withColumn("title_cut", F.coalesce("title_cut", F.lit(False)))


# Branch and bound


def choose(bundles: dict[str, list[tuple]], depends: dict[str, str], order: list[str]) -> dict[str, tuple | None]:
    """One candidate per bundle at least cost.

    bundles: name -> candidates (trust key..., value, determinant) sorted with the most trusted first; depends maps a
    bundle to the one whose chosen value must equal its determinant where any candidate has it. The cost of a choice is
    its place among the candidates, weighed so that earlier bundles of the order always count more.
    """
    widest = max([len(v) for v in bundles.values()] + [1]) + 1
    weight = {b: widest ** (len(order) - k) for k, b in enumerate(order)}
    best: tuple[float, dict[str, tuple | None]] = (float("inf"), {})

    def admissible(b: str, chosen: dict) -> list[tuple[int, tuple]]:
        cands = list(enumerate(bundles.get(b, [])))
        lead = chosen.get(depends.get(b, ""))
        if lead is not None:
            agreeing = [c for c in cands if c[1][-1] == lead[-2]]
            cands = agreeing or cands
        return cands

    def walk(k: int, cost: float, chosen: dict) -> None:
        nonlocal best
        if cost >= best[0]:  # each remaining bundle costs nothing at best
            return
        if k == len(order):
            best = (cost, dict(chosen))
            return
        b = order[k]
        cands = admissible(b, chosen)
        if not cands:
            walk(k + 1, cost, chosen | {b: None})
        for place, c in cands:
            if cost + weight[b] * place >= best[0]:
                break
            walk(k + 1, cost + weight[b] * place, chosen | {b: c})

    walk(0, 0.0, {})
    return best[1]


def _typed(values: list[str]) -> Column:
    return F.struct(*[F.col(v).cast("string").alias(v) for v in values])


def survivors(rows: DataFrame, trust: DataFrame, bundles: dict[str, list[str]], intact: dict[str, Column], depends: dict[str, str]) -> DataFrame:
    """(first_row_id, n_rows, one string column per bundled field) of every group of two or more rows.

    bundles: name -> fields taken together, in order of weight; intact: name -> whether a row's bundle is usable;
    depends: bundle -> the bundle whose value determines it (only "doi" can, its key is compared).
    """
    grouped = linked(rows.select(*dict.fromkeys(["row_id", "corpus", "extraction_timestamp", "file_name", "doi", "title", *[f for names in bundles.values() for f in names]])))
    ranked = grouped.join(broadcast_if_small(trust.groupBy("corpus").agg(F.min("trust_rank").alias("trust_rank"))), "corpus", "left").withColumn("trust_rank", F.coalesce("trust_rank", F.lit(2**31 - 1)))
    fields = [f for names in bundles.values() for f in names]
    later = F.struct(F.coalesce(F.col("extraction_timestamp").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), (-F.col("row_id")).alias("no"))
    if depends:  # which rows carry the DOI that will be chosen: the most trusted intact one
        first = F.struct((-F.col("trust_rank")).alias("t"), later.alias("l"))
        lead = ranked.groupBy("component").agg(F.max_by(F.when(intact["doi"], F.col("doi_key")), F.when(intact["doi"], first)).alias("lead"))
        ranked = ranked.join(lead, "component")
        agrees = F.coalesce(F.col("doi_key") == F.col("lead"), F.lit(False))
    else:
        agrees = F.lit(False)
    cells = F.explode(F.array_compact(F.array(F.struct(F.lit("").alias("bundle"), F.lit(False).alias("agrees"), F.lit(None).cast("array<string>").alias("v")), *[
        F.when(intact[b], F.struct(F.lit(b).alias("bundle"), (agrees if b in depends else F.lit(False)).alias("agrees"), F.array(*[F.col(f).cast("string") for f in names]).alias("v"))) for b, names in bundles.items()
    ]))).alias("c")
    cand = ranked.select("component", "trust_rank", later.alias("later"), "row_id", cells).select("component", "trust_rank", "later", "row_id", "c.*")
    kept = cand.groupBy("component", "bundle", "trust_rank", "agrees").agg(F.max_by("v", "later").alias("v"), F.max("later").alias("later"), F.count("*").alias("n"), F.min("row_id").alias("first"))
    cell = F.struct("bundle", "trust_rank", "agrees", F.col("later.at").cast("string").alias("at"), F.col("later.no").alias("no"), "v")
    groups = kept.groupBy("component").agg(F.sum(F.when(F.col("bundle") == "", F.col("n"))).alias("n_rows"), F.min("first").alias("first_row_id"), F.collect_list(F.when(F.col("bundle") != "", cell)).alias("cells"))
    order = list(bundles)
    schema = "first_row_id bigint, n_rows bigint, " + ", ".join(f"`{f}` string" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for first, n, cells_ in zip(batch["first_row_id"], batch["n_rows"], batch["cells"], strict=True):
                pools: dict[str, list[tuple]] = {}
                for c in sorted(cells_, key=lambda c: (c["trust_rank"], [-ord(x) for x in c["at"]], -c["no"])):
                    value = tuple(c["v"])
                    pools.setdefault(c["bundle"], []).append((value, True if c["bundle"] == "doi" else None, c["agrees"] or None))
                picked = choose(pools, depends, order)
                record = {f: v for b in order if picked.get(b) for f, v in zip(bundles[b], picked[b][0], strict=True)}
                out.append((first, n, *[record.get(f) for f in fields]))
            yield pd.DataFrame(out, columns=["first_row_id", "n_rows", *fields])

    return groups.select("first_row_id", "n_rows", "cells").mapInPandas(run, schema)
