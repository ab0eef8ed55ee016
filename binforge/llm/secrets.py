"""Secret scans with corpus-wide ownership frequency.

Candidates are found in each whole text; their SHA-256 (never the secret itself)
is aggregated over the corpus into distinct repositories (documents) and owners. A candidate
that at most MAX_OWNERS owners hold in at most MAX_REPOS repositories is live-looking, a widely
copied one is an example. The base kinds are always reported; spans of the method's own kinds are
added where they are live-looking.

A candidate of more than HOT repositories gets its verdict by a broadcast, of up to BROADCAST_HASHES such, else by salted copies: there is at most one such for each HOT
candidates found, so what is sent stays small against the candidates and no task gets more than HOT rows of one hash.

Defined results: null text is empty; a text without secrets has counts 0, the hash
of the empty string and empty spans; a null owner is an owner of its own; repeated
rows give a row each and count as one repository; null ids count as one repository of their owner; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Base kinds, and how they match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
#: The method's own kinds.
EXTRA = {
    "github": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "sk": r"\bsk[-_][A-Za-z0-9_-]{16,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
MAX_OWNERS, MAX_REPOS = 2, 50
HOT = 10_000
#: Common candidates that may be broadcast (some 100 bytes each); of more, copies of each in a join by hash and salt.
BROADCAST_HASHES, SALTS = 200_000, 64
CANDIDATES = "owner string, row long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, extra array<struct<start:int,kind:int,end:int,hash:string>>, hashes array<string>"


def find(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """(start, kind, end, secret) of base kinds and of the others, by start."""
    base, extra = [], []
    for m in re.finditer(ASSIGN, text, re.ASCII):
        if len(m[2]) >= 12:
            base.append((m.start(), 0, m.end(), m[2]))
    for k, pattern in ((1, ACCESS), (2, HEX)):
        base += [(m.start(), k, m.end(), m[0]) for m in re.finditer(pattern, text)]
    for k, pattern in enumerate(EXTRA.values(), len(KINDS)):
        extra += [(m.start(), k, m.end(), m[0]) for m in re.finditer(pattern, text, re.ASCII)]
    return sorted(base), sorted(extra)


def _joined(spans: list) -> str:
    names = [*KINDS, *EXTRA]
    return ",".join(f"{names[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())])
    kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "base": pa.string(), "extra": pa.list_(span), "hashes": pa.list_(pa.string())}
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            base, extra = find(text or "")
            n, joined = [x[1] for x in base], _joined(base)
            rows.append((n.count(0), n.count(1), n.count(2), digest(joined), joined, [(s, k, e, digest(x)) for s, k, e, x in extra], sorted({digest(x[3]) for x in base + extra})))
        more = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "owner", "row")), *more], ["doc_id", "owner", "row", *kinds])


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    d = docs.select("doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"), F.monotonically_increasing_id().alias("row"), "text")
    return d.mapInArrow(_candidates, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {CANDIDATES}")


def ownership(found: DataFrame) -> DataFrame:
    """hash, repos, owners: distinct documents and owners with each candidate."""
    each = found.where(F.size("hashes") > 0).select("doc_id", "owner", F.explode("hashes").alias("hash"))
    repos = each.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    return repos.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.sum("n").alias("repos"), F.count("*").alias("owners"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, owner: str = "source", hot: int = HOT) -> DataFrame:
    """doc_id, counts, base_sha256, spans, n_live and n_example (distinct secrets of each sort)."""
    found = materialize(candidates(docs, owner), "secrets")
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    own = materialize(ownership(found).select("hash", "repos", live.alias("live")), "owners")
    each = found.where(F.size("hashes") > 0).select("row", F.explode("hashes").alias("hash"))
    common = own.where(F.col("repos") > hot).select("hash", "live")
    rare = own.where(F.col("repos") <= hot).select("hash", "live")
    if common.count() <= BROADCAST_HASHES:
        common = F.broadcast(common)
        live = each.join(common, "hash").unionByName(each.join(common, "hash", "left_anti").join(rare, "hash"))
    else:  # each common candidate in SALTS copies, of which a row meets one
        salts = F.explode(F.sequence(F.lit(0), F.when(F.col("repos") > hot, F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("salt")
        copies = own.select("hash", "live", "repos", salts).select("hash", "live", F.when(F.col("repos") > hot, F.col("salt")).alias("salt"))
        # a row doesn't know whether its candidate is common, so it asks with its salt and without
        asked = each.select("row", "hash", F.explode(F.array(F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"), F.lit(None).cast("int"))).alias("salt"))
        live = asked.join(copies, (asked["hash"] == copies["hash"]) & asked["salt"].eqNullSafe(copies["salt"])).select("row", copies["hash"], "live")
    verdict = live.groupBy("row").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.collect_set(F.when(F.col("live"), F.col("hash"))).alias("is_live"))
    d = found.drop("hashes").join(verdict, "row", "left")
    names = F.array(*(F.lit(x) for x in [*KINDS, *EXTRA]))
    add = F.filter("extra", lambda x: F.array_contains("is_live", x["hash"]))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), (F.array_position(names, F.split(x, ":")[0]) - 1).cast("int").alias("kind"), F.split(x, ":")[2].cast("int").alias("end")))
    more = F.transform(add, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    every = F.array_sort(F.concat(base, F.coalesce(more, F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    zero = F.lit(0).cast("long")
    return d.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _spans(name: str, pattern: str, secret: str, least: str) -> str:
    """CTEs with all matches of a pattern: doc_id, kind, start, end, secret. A match is the first place of its text after the match before."""
    return rf"""
m_{name} AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m FROM d),
r_{name}(doc_id, t, m, k, upto, start) AS (
  SELECT doc_id, t, m, 0, 0, 0 FROM m_{name} WHERE len(m) > 0
  UNION ALL
  SELECT doc_id, t, m, k + 1, upto + strpos(substr(t, upto + 1), m[k + 1]) - 1 + length(m[k + 1]), upto + strpos(substr(t, upto + 1), m[k + 1]) - 1
  FROM r_{name} WHERE k < len(m)),
s_{name} AS (SELECT * FROM (SELECT doc_id, '{name}' AS kind, start, upto AS stop, {secret} AS secret FROM (SELECT *, m[k] AS x FROM r_{name} WHERE k > 0)) WHERE {least})"""


def _oracle() -> str:
    q = lambda x: x.replace("'", "''")
    kinds = [("assign", q(ASSIGN), rf"regexp_extract(x, '{q(ASSIGN)}', 2)", "length(secret) >= 12"), ("access", ACCESS, "x", "true"), ("hex", HEX, "x", "true")]
    kinds += [(k, q(p), "x", "true") for k, p in EXTRA.items()]
    names = [*KINDS, *EXTRA]
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(names)) + " END"
    every = " UNION ALL ".join(f"SELECT * FROM s_{k[0]}" for k in kinds)
    joined = f"string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {order})"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS t FROM documents),{",".join(_spans(*k) for k in kinds)},
every AS (SELECT e.*, owner, sha256(secret) AS hash, {order} AS place FROM ({every}) e JOIN d USING (doc_id)),
own AS (SELECT hash, count(DISTINCT owner) <= {MAX_OWNERS} AND count(DISTINCT doc_id) <= {MAX_REPOS} AS live FROM every GROUP BY hash),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        sha256(coalesce({joined} FILTER (place < {len(KINDS)}), '')) AS base_sha256, {joined} FILTER (place < {len(KINDS)} OR live) AS spans,
        count(DISTINCT hash) FILTER (live) AS n_live, count(DISTINCT hash) FILTER (NOT live) AS n_example
      FROM every JOIN own USING (hash) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()
