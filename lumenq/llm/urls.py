"""URL filters with redirect equivalence.

Rules name a host and a path; the longest that fits decides. Redirects and canonical links say that two URLs are the
same page: connected components over these edges carry a block to every alias that has no rule of its own. An allow
rule on any member of a component takes precedence there, and a URL's own rule over all.

Edges come from the pages' HTML (canonical links and refresh redirects) and from a table of redirects, if given.
URLs are compared without fragment, with scheme and host lower-cased, an empty path as /.

Defined results: a null URL, or one without ://, has an empty host and path, fits no rule and is allowed; null HTML
has no links; pages with equal URLs get equal verdicts; of two equal rules the block counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lumenq.llm.columns import Scratch, written
from lumenq.llm.graph import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to which they are part of the plan; more are a table.
INLINE = 256


@dataclass(frozen=True)
class Rule:
    """text: host and path, such as example.org/es/."""

    allow: bool
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


RULE = "struct<size: int, host: string, path: string, allow: boolean>"


def _ruled(frame: DataFrame, rules: list[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """frame with rule and said: text and verdict of the longest rule that fits a row's host and path, or null; of equally long ones that with the longer host, of equal ones the block."""
    best: dict[str, Rule] = {}
    for r in rules:
        if r.text not in best or best[r.text].allow:
            best[r.text] = r
    rules = list(best.values())
    found = _few(frame, rules, host, path) if len(rules) <= INLINE else _many(frame, rules, host, path)
    return found.withColumn("rule", F.concat("__rule.host", "__rule.path")).withColumn("said", F.col("__rule.allow")).drop("__rule")


def _entries(rules: list[Rule]) -> str:
    return json.dumps([{"size": len(r.text), "host": r.host, "path": r.path, "allow": r.allow} for r in rules])


def _few(frame: DataFrame, rules: list[Rule], host: str, path: str) -> DataFrame:
    """All rules as one array, in the plan itself."""
    entries = F.from_json(F.lit(_entries(rules)), f"array<{RULE}>")
    fits = F.filter(entries, lambda r: ((F.col(host) == r["host"]) | F.endswith(F.col(host), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col(path), r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), F.length(r["host"]).alias("n"), r["host"].alias("host"), r["path"].alias("path"), r["allow"].alias("allow"))))
    return frame.withColumn("__rule", longest)


def _many(frame: DataFrame, rules: list[Rule], host: str, path: str) -> DataFrame:
    """Rules as a table: a URL's host and every domain above it are looked up, then those beginnings of its path that are as long as some rule's there. Each is a join on equal keys, over distinct hosts and paths."""
    spark = frame.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.allow) for r in rules], "host string, path string, allow boolean")
    lengths = table.groupBy(F.col("host").alias("h")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    keys = frame.select(F.col(host).alias("__host"), F.col(path).alias("__path")).filter("__host IS NOT NULL AND __path IS NOT NULL").distinct()
    labels = F.split("__host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    asked = keys.withColumn("h", F.explode(above)).join(lengths, "h")
    asked = asked.withColumn("k", F.explode(F.filter("lengths", lambda k: k <= F.length("__path")))).withColumn("p", F.expr("substring(__path, 1, k)"))
    hits = asked.join(table, (F.col("h") == F.col("host")) & (F.col("p") == F.col("path")))
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("n"), "host", "path", "allow")
    best = hits.groupBy("__host", "__path").agg(F.max(rule).alias("__rule"))
    return frame.join(best, (F.col(host) == F.col("__host")) & (F.col(path) == F.col("__path")), "left").drop("__host", "__path")


def node_of(url: Column) -> Column:
    """The form under which URLs are compared; null where there is none."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    path = path_of(url)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query))


@pandas_udf(T.ArrayType(T.StringType()))
def _links(url: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([list(page_links(u, h)) for u, h in zip(url, html, strict=True)])


def page_links(url: str | None, html: str | None) -> Iterator[str]:
    """Targets of a page's canonical links and refresh redirects, as absolute URLs."""
    import re
    from html import unescape
    from urllib.parse import urljoin

    if not url or not html:
        return
    for tag in re.findall(r"<(?:link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", html, re.I):
        values = {k.lower(): unescape(a or b or c) for k, a, b, c in re.findall(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", tag)}
        target = None
        if tag[1:5].lower() == "link" and "canonical" in values.get("rel", "").lower().split():
            target = values.get("href")
        elif values.get("http-equiv", "").lower() == "refresh":
            m = re.search(r"url\s*=\s*['\"]?([^'\"]+)", values.get("content", ""), re.I)
            target = m[1] if m else None
        if target and target.strip():
            try:
                yield urljoin(url, target.strip())
            except ValueError:  # no URL after all
                continue


def edges_of(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """u and v: URLs that a page's own links make equal. Only pages with such a tag leave the JVM: names in it may be written with entities and follow a quoted >."""
    named = F.col(html_col).rlike(r"(?iu)<(?:link|meta)")
    found = pages.filter(named & F.col(url_col).isNotNull()).select(F.col(url_col).alias("a"), F.explode(_links(F.col(url_col), F.col(html_col))).alias("b"))
    return found.select(node_of(F.col("a")).alias("u"), node_of(F.col("b")).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict and component (null where no link touches the URL). redirects: columns src and dst."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = _ruled(rows, rules).withColumnRenamed("said", "own")
    edges = edges_of(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.select(node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
        edges = more if edges is None else edges.unionByName(more)
    if edges is None:
        same = None
    else:
        scratch = Scratch(pages.sparkSession, "links")
        same = written(components(edges, "u", "v", scratch), "aliases")
        scratch.clear()
    if same is None:
        rows = rows.withColumn("component", F.lit(None).cast("string")).withColumn("blocked", F.lit(None).cast("boolean"))
    else:
        # every URL of a component counts, whether or not it is a page here
        same = _ruled(same.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))), rules).drop("host", "path", "rule")
        verdicts = same.groupBy("component").agg((F.coalesce(F.bool_or(~F.col("said")), F.lit(False)) & ~F.coalesce(F.bool_or("said"), F.lit(False))).alias("blocked"))
        same = same.drop("said").join(written(verdicts, "alias-verdicts"), "component")
        rows = rows.join(written(same, "alias-members"), "node", "left")
    verdict = F.when(F.coalesce(F.col("own"), ~F.coalesce(F.col("blocked"), F.lit(False))), "allow").otherwise("block")
    return rows.select("id", "host", "path", "rule", verdict.alias("verdict"), "component")
