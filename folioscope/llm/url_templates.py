"""URL verdicts from per-host path-template trees, in DataFrame operations only.

A rule list decides where it fits. The urls that it decides are the labels of the method for the others: the paths of a
host form a tree of segments; digits and long hexadecimal runs are generalised at once, and a node with very many
different children gets one wildcard child. Children whose labels and depth look like those of all their siblings
together are merged into one branch. A template's share of blocked urls is smoothed by that of its parent node, level by
level down from the whole table's share; templates above ``REJECT`` are blocked.

The tree is built from path shapes, counted once; urls meet their template in one join on host and shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

#: Segments of a path that get a level of their own; what follows them is one more.
LEVELS = 3
#: A node's children become a wildcard from so many kinds on, if each has fewer urls than that on average.
KINDS, URLS_PER_KIND = 10, 3
#: Labels' worth of the parent's share in a node's share.
SMOOTHING = 4.0
#: Standard errors within which a branch's share counts as that of its siblings.
ERRORS = 1.96
REJECT = 0.8
#: What a path's variable parts are replaced by, and which parts these are.
VARIABLE = "[0-9a-f]{12,}|[0-9]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), CAPITALS, SMALL)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule], verdict: bool = False) -> Column:
    """The longest rule (host, path, verdict) that fits, as its text or its verdict; null if none fits."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in longest]
    return F.coalesce(F.lit(None).cast("string"), *(F.when(f, F.lit(r[2] if verdict else r[0] + r[1])) for f, r in zip(fits, longest)))


def path_templates(shapes: DataFrame) -> DataFrame:
    """host, shape, template, share: the tree over shapes (host, shape, n, blocked, labelled)."""
    total = shapes.agg(F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled"))
    share = (F.coalesce("all_blocked", F.lit(0)) + SMOOTHING / 2) / (F.coalesce("all_labelled", F.lit(0)) + SMOOTHING)
    hosts = shapes.groupBy("host").agg(F.sum("blocked").alias("host_blocked"), F.sum("labelled").alias("host_labelled"))
    rows = (shapes.join(hosts, "host").crossJoin(F.broadcast(total.select(share.alias("all_share"))))  # one row
            .withColumn("share", (F.col("host_blocked") + SMOOTHING * F.col("all_share")) / (F.col("host_labelled") + SMOOTHING))
            .withColumn("parts", F.split(F.regexp_replace("shape", r"\A/", ""), "/", LEVELS + 1))
            .select("host", "shape", "n", "blocked", "labelled", "parts", F.lit("").alias("node"), "share"))
    for level in range(LEVELS + 1):
        rows = cut_lineage(_one_level_down(rows, level))
    return rows.select("host", "shape", F.col("node").alias("template"), "share")


def _one_level_down(rows: DataFrame, level: int) -> DataFrame:
    rows = rows.withColumn("part", F.get("parts", F.lit(level)))
    weighted = F.col("n") * (F.size("parts") - level - 1)
    kinds = rows.where("part is not null").groupBy("host", "node", "part").agg(
        F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.sum(weighted).alias("below"))
    nodes = kinds.groupBy("host", "node").agg(
        F.sum("n").alias("all_n"), F.count("*").alias("kinds"), F.sum("blocked").alias("all_blocked"),
        F.sum("labelled").alias("all_labelled"), F.sum("below").alias("all_below"))
    usual = F.col("all_blocked") / F.greatest("all_labelled", F.lit(1))
    off = F.abs(F.col("blocked") / F.greatest("labelled", F.lit(1)) - usual) * F.sqrt(F.col("labelled").cast("double"))
    alike = ((off <= ERRORS * F.sqrt(usual * (1 - usual)))
             & (F.floor(F.col("below") / F.col("n") + 0.5) == F.floor(F.col("all_below") / F.col("all_n") + 0.5)))
    element = (F.when((F.col("kinds") >= KINDS) & (F.col("all_n") < URLS_PER_KIND * F.col("kinds")), "*")
               .when((F.col("kinds") > 1) & alike, "~").otherwise(F.col("part")))
    named = kinds.join(nodes, ["host", "node"]).select("host", "node", "part", "blocked", "labelled", element.alias("element"))
    merged = named.groupBy("host", "node", "element").agg(F.sum("blocked").alias("node_blocked"), F.sum("labelled").alias("node_labelled"))
    steps = named.select("host", "node", "part", "element").join(merged, ["host", "node", "element"])
    share = (F.col("node_blocked") + SMOOTHING * F.col("share")) / (F.col("node_labelled") + SMOOTHING)
    return rows.join(steps, ["host", "node", "part"], "left").select(
        "host", "shape", "n", "blocked", "labelled", "parts",
        F.when(F.col("element").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "element")).alias("node"),
        F.when(F.col("element").isNull(), F.col("share")).otherwise(share).alias("share"))


def url_verdicts(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, share (of blocked urls, smoothed).

    The longest fitting rule decides; without one the page's template does. A null url, or one without ``://``, has an
    empty host and path. Very long urls are taken whole. Of rules that fit equally long, which are equal strings, the first
    counts; a share of exactly ``REJECT`` is allowed. Repeated rows are judged alike; null ids stay null; an empty table gives an
    empty one; other columns are not looked at.
    """
    host, path = host_and_path("url")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"),
                       rule_of(F.col("host"), F.col("path"), rules, verdict=True).alias("ruled"),
                       F.regexp_replace("path", VARIABLE, "#").alias("shape"))
    shapes = cut_lineage(urls.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.sum((F.col("ruled") == "block").cast("int")).alias("blocked"), F.count("ruled").alias("labelled"))
        .withColumn("blocked", F.coalesce("blocked", F.lit(0).cast("bigint"))))
    verdict = F.coalesce("ruled", F.when(F.col("share") >= REJECT, "block").otherwise("allow"))
    return urls.join(path_templates(shapes), ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "share")


def verdict_sql(rules: list[Rule]) -> str:
    """The same for DuckDB, over a table pages(page_id, url)."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in longest]
    case = lambda values: "case " + " ".join(f"{f} then '{v}'" for f, v in zip(fits, values)) + " end"
    sql = f"""
with split as (
  select page_id, case when contains(url, '://') then url[instr(url, '://') + 3:] else '' end as rest from pages),
urls as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{CAPITALS}', '{SMALL}') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from split),
ruled as (
  select *, {case([h + p for h, p, _ in longest])} as rule, {case([v for _, _, v in longest])} as ruled,
         regexp_replace(path, '{VARIABLE}', '#', 'g') as shape from urls),
shapes as (
  select host, shape, count(*) as n, count(*) filter (ruled = 'block') as blocked, count(ruled) as labelled from ruled group by 1, 2),
level0 as (
  select host, shape, n, blocked, labelled,
         case when len(s) <= {LEVELS + 1} then s else list_append(s[1:{LEVELS}], array_to_string(s[{LEVELS + 1}:], '/')) end as parts,
         '' as node, (sum(blocked) over (partition by host)
           + {SMOOTHING} * ((sum(blocked) over () + {SMOOTHING} / 2) / (sum(labelled) over () + {SMOOTHING})))
           / (sum(labelled) over (partition by host) + {SMOOTHING}) as share
  from (select *, string_split(regexp_replace(shape, '^/', ''), '/') as s from shapes))"""
    for k in range(LEVELS + 1):
        sql += f""",
kinds{k} as (
  select host, node, parts[{k + 1}] as part, sum(n) as n, sum(blocked) as blocked, sum(labelled) as labelled,
         sum(n * (len(parts) - {k + 1})) as below from level{k} where parts[{k + 1}] is not null group by 1, 2, 3),
pooled{k} as (
  select *, sum(n) over w as all_n, count(*) over w as kinds, sum(below) over w as all_below,
         cast(sum(blocked) over w as double) / greatest(sum(labelled) over w, 1) as usual
  from kinds{k} window w as (partition by host, node)),
named{k} as (
  select *, case when kinds >= {KINDS} and all_n < {URLS_PER_KIND} * kinds then '*'
    when kinds > 1 and abs(cast(blocked as double) / greatest(labelled, 1) - usual) * sqrt(cast(labelled as double))
           <= {ERRORS} * sqrt(usual * (1 - usual))
         and floor(cast(below as double) / n + 0.5) = floor(cast(all_below as double) / all_n + 0.5) then '~'
    else part end as element from pooled{k}),
steps{k} as (
  select host, node, part, element, sum(blocked) over e as node_blocked, sum(labelled) over e as node_labelled
  from named{k} window e as (partition by host, node, element)),
level{k + 1} as (
  select l.host, shape, n, blocked, labelled, parts, case when element is null then l.node else l.node || '/' || element end as node,
         case when element is null then share
              else (cast(node_blocked as double) + {SMOOTHING} * share) / (cast(node_labelled as double) + {SMOOTHING}) end as share
  from level{k} l left join steps{k} s on s.host = l.host and s.node = l.node and s.part = l.parts[{k + 1}])"""
    return sql + f"""
select page_id, r.host, path, rule, coalesce(ruled, case when share >= {REJECT} then 'block' else 'allow' end) as verdict, node as template
from ruled r join level{LEVELS + 1} using (host, shape)"""
