"""URL filters by a sort-merge range join (operator 10).

A host is written backwards, label by label ("com.example.www."), and followed by the path, so that a host rule with
all its subdomains is one interval of keys. Pages and rules are dealt to key ranges; each range is swept in key order
with a stack of the rules whose interval is open, which nest, and the longest one whose path fits decides.
"""

import string
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES_PER_RANGE = 32


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for a url without "://"."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def cut_points(keyed: DataFrame, id_col: str, ranges: int) -> list:
    """Keys that cut the rows into about equal ranges, from a sample of fixed size per range; equal cuts are kept."""
    sample = keyed.orderBy(F.xxhash64(id_col, "key"), id_col).limit(SAMPLES_PER_RANGE * ranges).select("key")
    keys = sorted(r["key"] for r in sample.collect())
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def sweep(pages: pd.DataFrame, rules: pd.DataFrame, default: str) -> tuple[list, list]:
    """Rule and verdict of each page; both tables ascend by key."""
    waiting = []  # hosts with their rules, in the order in which their intervals open
    for lo, host, path, verdict in zip(rules["lo"], rules["host"], rules["path"], rules["verdict"]):
        if not waiting or waiting[-1][0] != lo:
            waiting.append((lo, lo[:-1] + "/", host, {}))
        held = waiting[-1][3]
        if held.get(path) != "block":  # of equal rules the blocking one holds
            held[path] = verdict
    waiting = [(lo, hi, host, held, sorted({len(p) for p in held}, reverse=True)) for lo, hi, host, held in waiting]
    found, verdicts, stack, at = [], [], [], 0
    for key, path in zip(pages["key"], pages["path"]):
        while at < len(waiting) and waiting[at][0] <= key:
            while stack and stack[-1][1] <= waiting[at][0]:
                stack.pop()
            stack.append(waiting[at])
            at += 1
        while stack and stack[-1][1] <= key:
            stack.pop()
        best = None
        for _, _, host, held, sizes in stack:  # from the shortest host to the longest
            for size in sizes:
                if size <= len(path) and path[:size] in held:
                    if best is None or len(host) + size >= best[0]:
                        best = (len(host) + size, host + path[:size], held[path[:size]])
                    break
        found.append(best[1] if best else None)
        verdicts.append(best[2] if best else default)
    return found, verdicts


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) per page.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains where the page's path starts with the
    rule's; the longest (host and path together, then the longer host) wins, and of equal rules the blocking one.
    Without a fitting rule ``rule`` is null and the verdict the default. Null urls and those without "://" have an
    empty host and path. Rows whose key is as frequent as several ranges are spread over these ranges.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    keyed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("key", F.concat(host_key(F.col("host")), "path"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(cut_points(keyed, id_col, ranges))

    @F.pandas_udf("int")
    def range_of(key: pd.Series, mix: pd.Series) -> pd.Series:
        c = cuts.value
        lows = [bisect_left(c, k) for k in key]
        highs = [bisect_right(c, k, lo) for k, lo in zip(key, lows)]
        return pd.Series([lo + m % (hi - lo + 1) for lo, hi, m in zip(lows, highs, mix)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_over(lo: pd.Series) -> pd.Series:
        c = cuts.value
        return pd.Series([list(range(bisect_left(c, x), bisect_right(c, x[:-1] + "/") + 1)) for x in lo])

    dealt = keyed.withColumn("range", range_of("key", F.xxhash64(id_col)))
    opened = rules.select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), "path", "verdict").distinct()
    opened = opened.withColumn("lo", host_key(F.col("host"))).withColumn("range", F.explode(ranges_over("lo")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("key", kind="stable"), right.sort_values("lo", kind="stable")
        found, verdicts = sweep(left, right, default)
        return pd.DataFrame({id_col: left[id_col], "host": left["host"], "path": left["path"], "rule": pd.Series(found, left.index, dtype=object),
                             "verdict": pd.Series(verdicts, left.index, dtype=object)})

    kind = pages.schema[id_col].dataType.simpleString()
    swept = dealt.groupBy("range").cogroup(opened.groupBy("range"))
    return swept.applyInPandas(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
