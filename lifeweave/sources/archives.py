"""Containers of personal-data exports: zips, extracted folders, location files, loose media; their members and bytes.

Folders are listed by Spark's binaryFile source (names, sizes and times only; no content is read); zips are opened where
the rows are, once a task and container. Paths must be readable from every executor.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeweave.functions import scalar

# Names that tell exports, products and location files apart.
KEPT_PRODUCTS = r"(?iu)^(google\s*(photos|fotos|фото|foto)|photos|location history.*|standortverlauf.*|historique des positions.*|история местоположений.*|fit)$"
LOCATION_FILE = r"(?i)^(timeline|location[-_ ]history|records)[^/]*\.json$|\.(gpx|tcx)$"
EXPORT_MARK = r"^(.*?/(?:Takeout)(?=/)|.*?(?=/(?:your_facebook_activity|your_instagram_activity)/)|.*?(?=/data/manifest\.js$))"


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, mtime of every file below the paths, each real file once; hidden files and folders are left out."""
    out = None
    for p in paths:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(p.rstrip("/")).alias("input"))
        out = df if out is None else out.unionByName(df)
    name = F.col("path")
    # overlapping inputs: the longest (innermost) one claims a file
    return out.where(~name.rlike(r"/\.[^/]+/")).groupBy("path").agg(F.max_by(F.struct("size", "mtime", "input"), F.length("input")).alias("f")).select("path", "f.*")


def containers(files: DataFrame) -> DataFrame:
    """path, container, kind, name, size, mtime: kind is 'zip', 'export' (an extracted export folder), 'location' or 'loose'.

    The files of other products in an extracted export are pruned by folder name; what belongs nowhere is left out."""
    path = F.col("path")
    base = scalar.basename("path")
    root = F.regexp_extract(path, EXPORT_MARK, 1)
    marked = files.withColumn("__root", F.when(root != "", root))
    # a folder is an export if any file below it bears a mark
    tops = marked.where("__root IS NOT NULL").select("__root").distinct().select(F.col("__root").alias("root"))
    # every folder above a file, so that files without a mark of their own find their export by equality
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(2))), lambda k: F.array_join(F.slice(F.split(path, "/"), 1, k), "/"))
    inside = files.select("path", F.explode(above).alias("root")).join(tops, "root").groupBy("path").agg(F.min_by("root", F.length("root")).alias("root"))
    f = files.join(inside, "path", "left")
    kind = (
        F.when(F.lower(base).endswith(".zip"), "zip").when(F.col("root").isNotNull(), "export").when(base.rlike(LOCATION_FILE), "location").when(scalar.media_kind(base).isNotNull() & ~base.startswith("._"), "loose")
    )
    container = F.when(kind == "export", F.col("root")).when(kind == "loose", F.col("input")).otherwise(path)
    name = F.when(kind == "export", F.substring(path, F.length("root") + 2, 1_000_000)).when(kind == "loose", F.substring(path, F.length("input") + 2, 1_000_000)).otherwise(base)
    out = f.select("path", container.alias("container"), kind.alias("kind"), name.alias("name"), "size", "mtime").where("kind IS NOT NULL")
    product = F.split(F.col("name"), "/")[0]
    takeout = F.col("container").endswith("/Takeout")
    return out.where(~((F.col("kind") == "export") & takeout & ~product.rlike(KEPT_PRODUCTS)))


def members(found: DataFrame) -> DataFrame:
    """container, kind, name, size, error of every member. An incomplete zip gives one row with an error and no name."""
    plain = found.where("kind <> 'zip'").select("container", "kind", "name", "size", F.lit(None).cast("string").alias("error"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                if not zipfile.is_zipfile(path):
                    out.append((path, "zip", None, None, "not a complete zip"))
                    continue
                with zipfile.ZipFile(path) as z:
                    out += [(path, "zip", i.filename, i.file_size, None) for i in z.infolist() if not i.is_dir()]
            if out:
                yield pd.DataFrame(out, columns=["container", "kind", "name", "size", "error"])

    zips = found.where("kind = 'zip'").select("path").repartition("path").mapInPandas(look, "container string, kind string, name string, size bigint, error string")
    return plain.unionByName(zips)


def contents(wanted: DataFrame, head: int | None = None) -> DataFrame:
    """container, name, content (binary) of members, whole or their first bytes; rows in (container, name) order, so that a
    task opens each container once. A member that can't be read gives a NULL content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, archive = None, None
        for pdf in batches:
            out = []
            for container, kind, name in zip(pdf["container"], pdf["kind"], pdf["name"]):
                try:
                    if kind == "zip":
                        if at != container:
                            at, archive = container, zipfile.ZipFile(container)
                        with archive.open(name) as f:
                            out.append(f.read() if head is None else f.read(head))
                    else:
                        with open(container if kind == "location" else f"{container}/{name}", "rb") as f:
                            out.append(f.read() if head is None else f.read(head))
                except (OSError, KeyError, zipfile.BadZipFile):
                    out.append(None)
            yield pd.DataFrame({"container": pdf["container"], "name": pdf["name"], "content": out})

    rows = wanted.where("name IS NOT NULL").select("container", "kind", "name").repartition("container").sortWithinPartitions("container", "name")
    return rows.mapInPandas(read, "container string, name string, content binary")


def fingerprints(found: DataFrame) -> DataFrame:
    """container, fingerprint: changes when a member is added, removed, renamed or (for zips and single files) rewritten."""
    each = F.concat_ws("\0", "name", F.when(F.col("kind").isin("zip", "location"), F.concat_ws("\0", "size", "mtime")))
    return found.groupBy("container").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(each)), "\n").cast("binary")).alias("fingerprint"))


def not_yet_scanned(prints: DataFrame, manifest: DataFrame) -> DataFrame:
    """Containers whose fingerprint a manifest (container, fingerprint) doesn't have yet."""
    return prints.join(manifest, ["container", "fingerprint"], "left_anti")


def export_kinds(all_members: DataFrame) -> DataFrame:
    """container, source: 'google', 'instagram', 'facebook', 'x' or 'other', told by the members' names."""
    name, base = F.col("name"), F.lower(scalar.basename("container"))
    has = lambda pattern: F.bool_or(name.rlike(pattern))
    per = all_members.where("name IS NOT NULL").groupBy("container").agg(
        has("^Takeout/").alias("g"), has("your_instagram_activity/").alias("i"), has("your_facebook_activity/").alias("f"), has(r"(^|/)messages/inbox/").alias("inbox"), has(r"(^|/)content/posts_\d+\.json").alias("posts"),
        has(r"(^|/)data/manifest\.js$|(^|/)data/tweets?(-part\d+)?\.js$").alias("x"), has("data_logs/").alias("logs"), has("_activity/").alias("activity"),
    )
    kind = (
        F.when(F.col("g") | F.col("container").endswith("/Takeout"), "google").when(F.col("logs") & ~F.col("activity"), "other").when(F.col("i") | base.contains("instagram"), "instagram")
        .when(F.col("f") | base.contains("facebook"), "facebook").when(F.col("inbox"), F.when(F.col("posts"), "instagram").otherwise("facebook")).when(F.col("x"), "x").otherwise("other")
    )
    return per.select("container", kind.alias("source"))


def resolve_uris(uris: DataFrame, all_members: DataFrame) -> DataFrame:
    """uris (container, uri) with member: the one whose last path parts, up to six, agree longest; of equals the first by name."""
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.least(F.size(F.split(c, "/")), F.lit(6))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(F.split(c, "/"), -k, k), "/").alias("tail")))
    clean = F.regexp_replace("uri", "^/+|/+$", "")
    asked = uris.where((F.col("uri") != "") & ~F.col("uri").startswith("http")).select("container", "uri", F.explode(tails(clean)).alias("t")).select("container", "uri", "t.*").distinct()
    have = all_members.where("name IS NOT NULL").select("container", "name", F.explode(tails(F.col("name"))).alias("t")).groupBy("container", F.col("t.tail").alias("tail")).agg(F.min("name").alias("member"))
    best = asked.join(have, ["container", "tail"]).groupBy("container", "uri").agg(F.max_by("member", "k").alias("member"))
    return uris.join(best, ["container", "uri"], "left")


def text_of(content: str = "content") -> Column:
    return F.col(content).cast("string")


def zip_bytes(files: dict[str, bytes]) -> bytes:
    """A zip in memory, for tests and small exports."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return buf.getvalue()
