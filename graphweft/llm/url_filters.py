"""URL filters by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. Hosts are reversed by
label and joined to the path behind a separator, so a rule is the interval of all keys it is a prefix of. A url has one
key for its host and each parent domain (no deeper than the deepest rule). Each batch of keys is sorted and swept once
beside the sorted rules, with a stack of the rules whose intervals are open: intervals nest, so the top of the stack is
the longest rule on that key. The longest rule over a url's keys wins; ties go to the longer host, then to ``block``.

Rules are a stated set held by every task, in blocks of at most RULE_BLOCK; further blocks are further passes over the
same batches, without a shuffle. No url list is ever gathered.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule; urls that fit none get the
default verdict; rows are independent, so repeated rows and null ids pass through; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

#: The rules of the production list (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT_VERDICT = "allow"
RULE_BLOCK = 100_000
SEPARATOR = "\x01"
_TO_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): behind the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[:min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_TO_LOWER), path


def host_keys(host: str, depth: int) -> list[str]:
    """The host and its parent domains, reversed by label, at most ``depth`` labels deep."""
    labels = host.rsplit(".", depth)[::-1] if host else []
    if len(labels) > depth:
        labels.pop()
    return [".".join(labels[:k]) for k in range(1, len(labels) + 1)]


def sweep(keys: list[tuple[str, int]], rules: list[tuple[str, tuple]]) -> list[tuple[int, tuple]]:
    """For sorted (key, row) and sorted (rule key, rule): (row, longest rule whose key is a prefix), by one merge."""
    out, stack, k = [], [], 0
    for key, row in keys:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        while k < len(rules) and rules[k][0] <= key:
            if key.startswith(rules[k][0]):
                while stack and not rules[k][0].startswith(stack[-1][0]):
                    stack.pop()
                stack.append(rules[k])
            k += 1
        if stack:
            out.append((row, stack[-1][1]))
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    prepared = []
    for host, path, verdict in dict.fromkeys(rules):
        host = host.translate(_TO_LOWER)
        rank = (len(host) + len(path), len(host), verdict == "block")
        prepared.append((".".join(host.split(".")[::-1]) + SEPARATOR + path, (rank, host + path, verdict)))
    prepared.sort()
    blocks = [prepared[i:i + RULE_BLOCK] for i in range(0, len(prepared), RULE_BLOCK)] or [[]]
    depth = max([r[0].split(SEPARATOR)[0].count(".") + 1 for r in prepared], default=1)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            keys = sorted((k + SEPARATOR + path, i) for i, (host, path) in enumerate(parts) for k in host_keys(host, depth))
            best: list[tuple | None] = [None] * len(parts)
            for block in blocks:
                for i, rule in sweep(keys, block):
                    if best[i] is None or rule > best[i]:
                        best[i] = rule
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                pa.array([b and b[1] for b in best], pa.string()), pa.array([b[2] if b else default for b in best], pa.string())], schema=schema)

    slim = pages.select(col(id_col).cast("bigint").alias("page_id"), col(url_col).alias("url"))
    return slim.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), list(RULES))


ORACLE_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM r),
l(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, l.rh || l.rp AS rule, l.v, row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(l.rh || l.rp) DESC NULLS LAST, length(l.rh) DESC) AS k
    FROM p LEFT JOIN l ON (p.host = l.rh OR ends_with(p.host, '.' || l.rh)) AND starts_with(p.path, l.rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
