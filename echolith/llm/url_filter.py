"""URL filters by a sort-merge range join with a stack of active rules.

Canonical key: the host's labels in reverse order, as an array. A rule's host and all its subdomains
are then one interval of that order, and the intervals of rules nest. Pages and rules are dealt into ranges
of (key, path, id) together and sorted; a sweep over the sorted range pushes a rule's host when its interval opens,
pops it when the next key lies outside, and judges each page by the hosts on the stack: of their rules whose
path begins the page's path the longest wins, host and path together, and of equally long ones that of the longer host. Rules that opened before
a range are found by equality of the prefixes of the range's first key, at most one for each label, so
neither side is broadcast or gathered. One host may hold any share of the pages: a range ends within it
by path and id.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: from there up to
``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path, which only a
rule with an empty host fits. Rules with a null host or path fit nothing. Two rules of one host and path:
``block`` wins. Repeated pages are judged each. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm.common import durable, packed, rows, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def labels(host: Column) -> Column:
    return F.reverse(F.split(host, "[.]", -1))


class Sweep:
    """The stack of active hosts, and the verdict on each page that comes in order."""

    def __init__(self) -> None:
        self.stack: list[tuple[list[str], dict[str, tuple[str, str]], list[int]]] = []

    def settle(self, key: list[str]) -> None:
        while self.stack and key[: len(self.stack[-1][0])] != self.stack[-1][0]:
            self.stack.pop()

    def opened(self, key: list[str], path: str, rule: str, verdict: str) -> None:
        self.settle(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, sizes = self.stack[-1]
        if path not in paths or verdict == "block":
            paths[path] = (rule, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def judge(self, key: list[str], path: str) -> tuple[str | None, str | None]:
        self.settle(key)
        best, found = -1, (None, None)
        for own, paths, sizes in reversed(self.stack):
            host = sum(map(len, own)) + len(own) - 1
            for n in sizes:
                if host + n <= best:
                    break
                if n <= len(path) and path[:n] in paths:
                    best, found = host + n, paths[path[:n]]
                    break
        return found


def apply_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every page.

    ``rules`` has ``verdict`` (allow or block), ``host`` and ``path``, of any number.
    """
    host, path = host_and_path(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path")).withColumn("_key", labels(F.col("_host")))
    id_type = keyed.schema["_id"].dataType
    rule = rules.where("host is not null and path is not null").select(labels(F.translate("host", UPPER, LOWER)).alias("_key"), F.col("path").alias("_path"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"))
    none = F.lit(None)
    opens = rule.select("_key", F.lit(0).alias("_kind"), "_path", none.cast(id_type).alias("_id"), none.cast("string").alias("_host"), "_rule", "_verdict")
    asked = keyed.select("_key", F.lit(1).alias("_kind"), "_path", "_id", "_host", none.cast("string").alias("_rule"), none.cast("string").alias("_verdict"))
    ranged = durable(opens.union(asked).repartitionByRange("_key", "_kind", "_path", "_id").withColumn("_range", F.spark_partition_id()))
    firsts = ranged.where("_kind = 1").groupBy("_range").agg(F.min("_key").alias("_first"))
    prefixes = firsts.select("_range", F.explode(F.transform(F.sequence(F.lit(1), F.size("_first")), lambda n: F.slice("_first", F.lit(1), n))).alias("_key"))
    events = ranged.unionByName(opens.join(prefixes, "_key"))
    ordered = events.repartition("_range").sortWithinPartitions("_range", "_key", "_kind", "_path", "_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def judged() -> Iterator[tuple]:
            sweep, at = Sweep(), None
            for range_, key, kind, path, i, host, rule, verdict in rows(batches, "_range", "_key", "_kind", "_path", "_id", "_host", "_rule", "_verdict"):
                if range_ != at:
                    sweep, at = Sweep(), range_
                if kind == 0:
                    sweep.opened(key, path, rule, verdict)
                else:
                    rule, verdict = sweep.judge(key, path)
                    yield i, host, path, rule, verdict or default

        text = [(n, pa.string()) for n in ("host", "path", "rule", "verdict")]
        yield from packed(judged(), pa.schema([("_id", to_arrow_type(id_type)), *text]))

    out = ordered.mapInArrow(work, f"_id {id_type.simpleString()}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("_id", id_col)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return apply_rules(table(spark, sf_dir, "pages"), rules)


ORACLE = """
with p as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p
), r(verdict, h, p) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), hit as (
  select page_id, max_by(h || p, length(h || p)*1000000 + length(h)*2) as rule, max_by(verdict, length(h || p)*1000000 + length(h)*2 + (verdict = 'block')::int) as verdict
  from q join r on (q.host = r.h or ends_with(q.host, '.' || r.h)) and starts_with(q.path, r.p)
  group by page_id
)
select q.page_id, q.host, q.path, hit.rule, coalesce(hit.verdict, 'allow') as verdict
from q left join hit using (page_id)
"""
