"""File tables: discovery, classes, sensitive paths, manifests and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by class, folders of noise, and names of secrets.
CODE = "rs py pyi js jsx mjs cjs ts tsx go java kt kts swift scala c h cc cpp cxx hpp cs rb php lua sh bash ps1 ex exs jl zig sql tf dart groovy r m mm v sv f90 pas vb".split()
DOCUMENT = "md markdown rst txt adoc org html htm docx odt rtf csv tsv xlsx".split()
PAPER = ["pdf", "tex", "bib"]
IMAGE = "png jpg jpeg gif svg webp bmp tiff".split()
VIDEO = "mp4 mov mkv webm avi mp3 wav m4a".split()
NOISE = ".git .hg .svn node_modules target dist build .venv venv __pycache__ .idea .vscode .cache coverage .next .tox".split()
SENSITIVE = r"(?i)(^|/)(\.env(\..+)?|id_(rsa|dsa|ecdsa|ed25519)|.*\.(pem|key|p12|pfx|jks|keystore)|\.(netrc|npmrc|pypirc|pgpass)|credentials(\.json)?|.*(secret|credential|password)s?\.(json|ya?ml|toml|txt|ini))$|(^|/)\.(ssh|aws|gnupg)/"
ACADEMIC = (r"(?i)\babstract\b", r"(?i)\breferences\b|\bbibliography\b", r"(?i)\bet al\.", r"\[\d+\]", r"(?i)\bdoi:|arxiv")


def extension(path: str | Column = "path") -> Column:
    base = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1)))


def classify(path: str = "path", content: str | None = None) -> Column:
    """code, document, paper, image, video or null; a document with three signs of a paper at its start is one."""
    e = extension(path)
    document = F.lit("document")
    if content is not None:
        start = F.substring(F.col(content), 1, 3000)
        signs = sum((F.when(start.rlike(p), 1).otherwise(0) for p in ACADEMIC), F.lit(0))
        document = F.when(signs >= 3, "paper").otherwise("document")
    return F.when(e.isin(*CODE), "code").when(e.isin(*PAPER), "paper").when(e.isin(*IMAGE), "image").when(e.isin(*VIDEO), "video").when(e.isin(*DOCUMENT), document)


def sensitive(path: str = "path") -> Column:
    return F.col(path).rlike(SENSITIVE)


def noise(path: str = "path") -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*NOISE))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, content) of files worth reading under a folder; contents are read only if a plan uses them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    files = raw.select(rel.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    return files.where(~noise() & ~sensitive() & classify().isNotNull())


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("modified"), F.sha2("content", 256).alias("hash"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed (another hash), removed, unchanged."""
    j = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return j.select("path", change.alias("change")).orderBy("path")


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose path and content hash the cache of parsed files lacks."""
    return files.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")
