"""URL rules in a sorted array of 64-bit digests that tasks map into memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import ascii_lower, scratch, table

#: The rules of the registered query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: What a URL that no rule fits gets: the rules list exceptions from what is allowed.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def compile_rules(rules: list[tuple[str, str, str]]) -> bytes:
    """The file: counts and the length of the longest host, the lengths (in characters) that paths have, the sorted digests, the rules' order, verdicts and spans, then their strings.

    A rule's key is host, a line feed, path. A later rule with the same host and path replaces an earlier one."""
    kept = {f"{host}\n{path}": (verdict, host, path) for verdict, host, path in rules}
    keys = list(kept)
    digests = np.array([xxhash.xxh64_intdigest(k.encode()) for k in keys], np.uint64)
    order = np.argsort(digests, kind="stable")
    spelt = [keys[i].encode() for i in order]
    ends = np.cumsum([0, *map(len, spelt)]).astype(np.int64)
    lengths = np.array(sorted({len(p) for _, _, p in kept.values()}), np.int64)
    blocks = np.array([kept[keys[i]][0] == "block" for i in order], np.uint8)
    head = np.array([len(keys), len(lengths), max((len(h) for _, h, _ in kept.values()), default=0)], np.int64)
    return b"".join(x.tobytes() for x in (head, lengths, digests[order], ends)) + blocks.tobytes() + b"".join(spelt)


class Rules:
    """A view of the mapped file."""

    def __init__(self, data: np.ndarray):
        n, m, self.longest = map(int, data[:24].view(np.int64))
        cut = np.cumsum([24, 8 * m, 8 * n, 8 * (n + 1), n])
        part = lambda i, kind: data[cut[i] : cut[i + 1]].view(kind)
        self.lengths, self.digests, self.ends, self.blocks, self.spelt = part(0, np.int64), part(1, np.uint64), part(2, np.int64), part(3, np.uint8), data[cut[4] :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Each key's place in the array, -1 where it isn't a rule: a binary search of all at once, then the stored strings decide."""
        probes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        out = np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.digests, probes)
        maybe = np.flatnonzero(at < len(self.digests))
        for i in maybe[self.digests[at[maybe]] == probes[maybe]]:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == probes[i]:  # strings of one digest stand side by side
                if self.spelt[self.ends[j] : self.ends[j + 1]].tobytes() == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list, list]:
        keys, owner, length = [], [], []
        lengths = self.lengths.tolist()
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            fit = [path[:n] for n in lengths if n <= len(path)]
            if len(host) > self.longest:  # longer ends are no rule's: only what may be one is spelt out, however long a url is
                host = host[len(host) - self.longest - 1 :].partition(".")[2]
            while host:
                for p in fit:
                    keys.append(f"{host}\n{p}".encode())
                    owner.append(i)
                    length.append((len(host) + len(p), len(host)))
                host = host.partition(".")[2]
        found = self.find(keys)
        best: dict[int, tuple] = {}
        for k in np.flatnonzero(found >= 0):
            i, now = owner[k], (length[k], int(found[k]), keys[k])
            if i not in best or now[0] > best[i][0]:
                best[i] = now
        rules = [best[i][2].decode().replace("\n", "", 1) if i in best else None for i in range(len(hosts))]
        verdicts = [("block" if self.blocks[best[i][1]] else "allow") if i in best else DEFAULT for i in range(len(hosts))]
        return rules, verdicts


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """df with host, path, rule and verdict (allow or block).

    A rule fits its host and all subdomains if the URL's path starts with the rule's. The longest fitting rule (host and path together,
    then host) wins; without one, rule is null and verdict is DEFAULT. A URL that is null or has no :// has an empty host and path, which
    no rule fits. Columns of df with these names, and _judged, are replaced; an empty df gives no rows. Nothing is shuffled: each row is judged where it
    is read, and the digest file, in the shared folder, is mapped by each worker."""
    files.publish(name := f"{scratch(df.sparkSession, 'url-rules')}/digests", compile_rules(rules))
    host, path = host_of(F.col(url)), path_of(F.col(url))

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = Rules(files.mapped(name))
        for hosts, paths in batches:
            rule, verdict = known.judge(hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": verdict})

    own = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict", "_judged")]
    out = df.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"), judged(host, path).alias("_judged"))
    return out.select("*", F.col("_judged.rule").alias("rule"), F.col("_judged.verdict").alias("verdict")).drop("_judged")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; awkward urls as judge_urls has them, an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES {", ".join(str(x) for x in RULES)}),
m AS (SELECT u.page_id, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
  row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM m WHERE k = 1
"""
