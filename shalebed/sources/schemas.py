"""Schema documents by apiVersion and kind: local folders, versioned collections and catalogs, with mirrors, caches and what is known to be missing.

All of them are DataFrames of (source, rank, version, file, schema). Fetching from the network is a plug-in that the
driver runs ahead for a bounded list of files; nothing else here leaves the cluster.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT_VERSION = 1
RANKS = {"override": 0, "chart_local": 1, "collection": 2, "catalog": 3}
FOUND, ABSENT, UNCERTAIN = "found", "absent", "uncertain"
SCHEMA = "source string, rank int, version string, file string, schema string"
# API groups that a cluster has built in; groups without a dot or below the built-in domain belong too.
BUILT_IN_GROUPS = ("", "admissionregistration.k8s.io", "apiextensions.k8s.io", "apiregistration.k8s.io", "apps", "authentication.k8s.io", "authorization.k8s.io", "autoscaling", "batch", "certificates.k8s.io", "coordination.k8s.io", "discovery.k8s.io", "events.k8s.io", "extensions", "flowcontrol.apiserver.k8s.io", "internal.apiserver.k8s.io", "networking.k8s.io", "node.k8s.io", "policy", "rbac.authorization.k8s.io", "resource.k8s.io", "scheduling.k8s.io", "storage.k8s.io")


class Fetcher(Protocol):
    """Gets a document: its text, None if it surely does not exist (404); raises OSError where nothing can be told."""

    def get(self, url: str) -> str | None: ...


class HttpFetcher:
    """By urllib; at most `limit` bytes."""

    def __init__(self, timeout: float = 10.0, limit: int = 16 << 20):
        self.timeout, self.limit = timeout, limit

    def get(self, url: str) -> str | None:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(url, timeout=self.timeout) as r:
                body = r.read(self.limit + 1)
        except HTTPError as e:
            if e.code == 404:
                return None
            raise
        if len(body) > self.limit:
            raise OSError(f"{url}: more than {self.limit} bytes")
        return body.decode()


class NoFetcher:
    """Where there is no network."""

    def get(self, url: str) -> str | None:
        raise OSError("fetching is switched off")


def source_id(url: str) -> str:
    """A short stable name of a mirror."""
    return hashlib.sha256(url.rstrip("/").encode()).hexdigest()[:16]


def source_id_column(url: Column) -> Column:
    return F.left(F.sha2(F.regexp_replace(url, "/+$", ""), 256), F.lit(16))


def cache_path(root: str, source: str, version: str, file: str) -> str:
    """root/source/version/file; parts that would leave the folder are refused."""
    if any(".." in p.split("/") or p.startswith("/") for p in (source, version, file)):
        raise ValueError("a cache path must stay below its root")
    return f"{root.rstrip('/')}/{source}/{version}/{file}"


def mirrors(default: str, more: Iterable[str] = ()) -> list[tuple[int, str, str]]:
    """(rank, source id, base url): the default first, then the mirrors in their order, each once."""
    return [(i, source_id(u), u.rstrip("/")) for i, u in enumerate(dict.fromkeys([default.rstrip("/"), *[m.rstrip("/") for m in more]]))]


def layout_verdict(marker: int | None, populated: bool) -> str:
    """use, prepare, wipe or refuse: a cache of this version is used, an empty folder prepared, an older one wiped, a newer one left alone."""
    if marker == LAYOUT_VERSION:
        return "use"
    if marker is None:
        return "wipe" if populated else "prepare"
    return "wipe" if marker < LAYOUT_VERSION else "refuse"


def is_builtin_group(group: Column) -> Column:
    return group.isin(*BUILT_IN_GROUPS)


def file_names(api_version: Column, kind: Column) -> Column:
    """Ordered candidate names of (apiVersion, kind) in a versioned collection."""
    group, version = F.regexp_extract(api_version, "^(?:([^/]*)/)?", 1), F.lower(F.regexp_extract(api_version, "([^/]*)$", 1))
    low, short = F.lower(kind), F.regexp_extract(F.lower(group), r"^([^.]*)", 1)
    names = F.when(group == "", F.array(F.concat_ws("-", low, version))).otherwise(F.array(F.concat_ws("-", low, short, version), F.concat_ws("-", low, F.regexp_replace(F.lower(group), r"\.", "-"), version), F.concat_ws("-", low, version)))
    return F.array_distinct(F.transform(names, lambda n: F.concat(n, F.lit(".json"))))


def catalog_name(api_version: Column, kind: Column) -> Column:
    """group/kind_version.json; NULL for APIs without a group."""
    return F.when(api_version.contains("/"), F.concat(F.split_part(api_version, F.lit("/"), F.lit(1)), F.lit("/"), F.lower(kind), F.lit("_"), F.split_part(api_version, F.lit("/"), F.lit(2)), F.lit(".json")))


def read_cache(spark: SparkSession, root: str, rank: int, sources: list[str] | None = None) -> DataFrame:
    """A cache folder root/source/version/file as rows; only the configured sources, if given."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root).select(F.input_file_name().alias("path"), F.col("value").alias("schema"))
    below = F.regexp_extract("path", re.escape(root.removeprefix("file:").rstrip("/")) + r"/+([^/]+)/([^/]+)/(.+)$", 0)
    parts = [F.regexp_extract("path", re.escape(root.removeprefix("file:").rstrip("/")) + r"/+([^/]+)/([^/]+)/(.+)$", i) for i in (1, 2, 3)]
    out = df.where(below != "").select(parts[0].alias("source"), F.lit(rank).alias("rank"), parts[1].alias("version"), parts[2].alias("file"), "schema")
    return out if sources is None else out.where(F.col("source").isin(*sources))


def read_folder(spark: SparkSession, root: str, source: str, rank: int) -> DataFrame:
    """A plain folder of schema files: a local override, say."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root)
    name = F.regexp_extract(F.input_file_name(), re.escape(root.removeprefix("file:").rstrip("/")) + r"/+(.+)$", 1)
    return df.select(F.lit(source).alias("source"), F.lit(rank).alias("rank"), F.lit("").alias("version"), name.alias("file"), F.col("value").alias("schema"))


def chart_local(crds: DataFrame) -> DataFrame:
    """Custom resources that a chart ships, as a source of its own."""
    file = F.concat(F.col("group"), F.lit("/"), F.lower("kind"), F.lit("_"), F.col("version"), F.lit(".json"))
    return crds.select(F.lit("chart").alias("source"), F.lit(RANKS["chart_local"]).alias("rank"), F.lit("").alias("version"), file.alias("file"), "schema")


def version_chain(primary: str, older: int = 3) -> list[str]:
    """The version asked for and some minors before it, nearest first."""
    m = re.fullmatch(r"v?(\d+)\.(\d+)(?:\.\d+)?", primary)
    if not m:
        return [primary]
    v = "v" if primary.startswith("v") else ""
    return [primary, *[f"{v}{m[1]}.{n}.0" for n in range(int(m[2]) - 1, max(-1, int(m[2]) - 1 - older), -1)]]


def probe(asked: DataFrame, held: DataFrame, missing: DataFrame, key: list[str]) -> DataFrame:
    """asked with `state`: found in the cache, known to be absent, or uncertain, which a fetch would have to tell."""
    h = held.select(*key).distinct().withColumn("_held", F.lit(True))
    m = missing.select(*key).distinct().withColumn("_missing", F.lit(True))
    j = asked.join(h, key, "left").join(m, key, "left")
    return j.withColumn("state", F.when(F.col("_held"), FOUND).when(F.col("_missing"), ABSENT).otherwise(UNCERTAIN)).drop("_held", "_missing")


@dataclass
class Fetched:
    """What a prefetch brought: documents, names known to be absent, and names about which nothing is known."""

    documents: list[tuple[str, str, str, str]] = field(default_factory=list)
    absent: list[tuple[str, str, str]] = field(default_factory=list)
    uncertain: list[tuple[str, str, str]] = field(default_factory=list)


def prefetch(asked: list[tuple[str, str]], chain: list[tuple[int, str, str]], fetcher: Fetcher, known_absent: set[tuple[str, str, str]] = frozenset(), most: int = 10_000) -> Fetched:
    """Gets (version, file) from the first mirror that has it. At most `most` files are asked for: more need another way than a driver.

    A mirror's failure is no absence: then the next one is tried, and without an answer the file is uncertain.
    """
    if len(asked) > most:
        raise ValueError(f"{len(asked)} documents to fetch; at most {most} go through the driver")
    out = Fetched()
    for version, file in dict.fromkeys(asked):
        sure = True
        for _, source, base in chain:
            if (source, version, file) in known_absent:
                continue
            try:
                text = fetcher.get(f"{base}/{version}/{file}" if version else f"{base}/{file}")
            except OSError:
                sure = False
                out.uncertain.append((source, version, file))
                continue
            if text is None:
                out.absent.append((source, version, file))
            else:
                out.documents.append((source, version, file, text))
                sure = True
                break
    return out


def store(spark: SparkSession, fetched: Fetched, root: str, rank: int, fetched_at: str) -> None:
    """Adds documents (with where and when they came from) and absences to the cache's tables, by Spark's commit protocol."""
    if fetched.documents:
        rows = [(s, rank, v, f, t, f"{s}/{v}/{f}", fetched_at) for s, v, f, t in fetched.documents]
        spark.createDataFrame(rows, SCHEMA + ", source_file string, fetched_at string").write.mode("append").partitionBy("source", "version").parquet(f"{root}/documents")
    if fetched.absent:
        spark.createDataFrame(fetched.absent, "source string, version string, file string").write.mode("append").parquet(f"{root}/absent")


def kind_scan(held: DataFrame, kind: str, sources: list[str] | None = None, versions: list[str] | None = None) -> DataFrame:
    """(api_version, source, origin) of a kind in a versioned collection's documents: what they say of themselves."""
    v = F.try_parse_json("schema")
    named = held if sources is None else held.where(F.col("source").isin(*sources))
    named = named if versions is None else named.where(F.col("version").isin(*versions))
    each = named.where(F.lower(F.regexp_extract("file", r"^([^-_./]+)", 1)) == kind.lower()).select("source", F.explode(F.try_variant_get(v, "$['x-kubernetes-group-version-kind']", "array<variant>")).alias("g"))
    get = lambda n: F.try_variant_get("g", f"$.{n}", "string")
    return each.where(get("kind") == kind).select(F.concat_ws("/", F.nullif(get("group"), F.lit("")), get("version")).alias("api_version"), "source", F.lit("collection").alias("origin")).distinct()


def catalog_scan(held: DataFrame, kind: str, sources: list[str] | None = None) -> DataFrame:
    """The same of a catalog: the file's name tells group and version."""
    named = held if sources is None else held.where(F.col("source").isin(*sources))
    parts = [F.regexp_extract("file", r"^([^/]+)/([^/_]+)_([^/]+)\.json$", i) for i in (1, 2, 3)]
    return named.where(parts[1] == kind.lower()).select(F.concat(parts[0], F.lit("/"), parts[2]).alias("api_version"), "source", F.lit("catalog").alias("origin")).distinct()


def other_versions(held: DataFrame) -> DataFrame:
    """(file, other): for each catalog document, versions of the same group and kind; in order of the name."""
    name = held.select("file", F.regexp_extract("file", r"^(.*)_[^_/]+\.json$", 1).alias("what"), F.regexp_extract("file", r"_([^_/]+)\.json$", 1).alias("other")).distinct()
    return name.select("file", "what").join(name.select("what", "other", F.col("file").alias("_f")), "what").where("file <> _f").select("file", "other")


def online_probe(shortlist: list[str], kind: str, base: str, fetcher: Fetcher) -> list[str]:
    """Which of a few apiVersions a catalog on the network has for a kind; failures say nothing."""
    found = []
    for api in shortlist:
        group, _, version = api.partition("/")
        try:
            if version and fetcher.get(f"{base.rstrip('/')}/{group}/{kind.lower()}_{version}.json") is not None:
                found.append(api)
        except OSError:
            continue
    return found
