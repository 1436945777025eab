"""Files of a store: JSON with a declared schema and version, written as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_store(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """Rows of JSON files that fit the schema and have this schema_version; anything else is an error, nothing is guessed."""
    rows = spark.read.schema(f"schema_version int, {schema}").option("mode", "FAILFAST").option("multiLine", "true").json(path)
    fits = F.assert_true(F.col("schema_version").eqNullSafe(F.lit(version)), F.concat(F.lit(f"expected version {version}, found "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none"))))
    return rows.where(fits.isNull()).drop("schema_version")


def parsed(column: str, schema: str) -> Column:
    """A column of JSON as the declared struct; text that does not fit it is an error, nothing is guessed."""
    return F.from_json(column, schema, {"mode": "FAILFAST"})


def write_store(rows: DataFrame, path: str, version: int) -> None:
    """The job writes beside the store, and only once it has ended the folders are renamed: a failed job leaves the old files as
    they are. Between the two renames there is no store for a moment; the old one then stands beside it."""
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    rows.select(F.lit(version).alias("schema_version"), "*").write.json(f"{path}.new-{mark}")
    fs, place = _fs(spark, path)
    new, old = _fs(spark, f"{path}.new-{mark}")[1], _fs(spark, f"{path}.old-{mark}")[1]
    if fs.exists(place):
        fs.rename(place, old)
    if not fs.rename(new, place):
        raise OSError(f"{path}: the new files could not take their place and stay in {new.toString()}")
    fs.delete(old, True)


def exported(profile: DataFrame) -> DataFrame:
    """What a prompt may hold (kind, text): private vocabulary stays out, an example that was not reviewed is an error."""
    ok = F.assert_true((F.col("kind") != "example") | F.coalesce(F.col("reviewed"), F.lit(False)), "an example was not reviewed")
    return profile.where(ok.isNull()).where(~F.coalesce("private", F.lit(False))).select("kind", "text")


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def discover(spark: SparkSession, root: str, marker: str, depth: int = 3) -> list[str]:
    """Folders at or under root, level by level to the given depth, that hold the marker file; hidden ones are left out,
    and nothing is looked for within a store."""
    fs, place = _fs(spark, root)
    level, out = [place], []
    for _ in range(depth + 1):
        nxt = []
        for folder in level:
            entries = sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName())
            if any(e.isFile() and e.getPath().getName() == marker for e in entries):
                out.append(folder.toString())
            else:
                nxt += [e.getPath() for e in entries if e.isDirectory() and not e.getPath().getName().startswith((".", "node_modules"))]
        level = nxt
    return out


def snapshot(spark: SparkSession, path: str, to: str) -> str:
    """A copy of a table's folder under a name that is not taken: `to`, else `to`-2, `to`-3 and so on."""
    fs, place = _fs(spark, path)
    name, n = to, 1
    while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(name)):
        n += 1
        name = f"{to}-{n}"
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, place, fs, spark._jvm.org.apache.hadoop.fs.Path(name), False, spark._jsc.hadoopConfiguration())
    return name


def commit(spark: SparkSession, journal: str, steps: dict) -> list[str]:
    """Runs named steps in order and marks each one done in the journal; after a break it goes on behind the last mark.

    Returns the steps that were run this time. A step may be run twice, if a break falls between it and its mark, so
    each must write its result as a whole.
    """
    ran = []
    for name, step in steps.items():
        fs, mark = _fs(spark, f"{journal}/{name}.done")
        if not fs.exists(mark):
            step()
            fs.create(mark).close()
            ran.append(name)
    return ran


def guide(rulings: DataFrame) -> DataFrame:
    """profile, markdown: the rulings of each profile as a page, by kind and id; a profile's rulings are few."""
    line = F.concat(F.lit("- **"), "id", F.lit("** "), "text", F.coalesce(F.concat(F.lit(" ("), "slot", F.lit(")")), F.lit("")))
    parts = rulings.groupBy("profile", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    pages = parts.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("kind", "lines"))).alias("p"))
    return pages.select("profile", F.array_join(F.transform("p", lambda x: F.concat(F.lit("## "), x["kind"], F.lit("\n\n"), x["lines"])), "\n\n").alias("markdown"))


def guide_rulings(pages: DataFrame) -> DataFrame:
    """profile, kind, id, text, slot: what `guide` has written, read back."""
    parts = pages.select("profile", F.explode(F.split("markdown", r"(?m)^## ")).alias("part")).where("part <> ''")
    lines = parts.select("profile", F.split("part", "\n")[0].alias("kind"), F.explode(F.split("part", "\n")).alias("line")).where(F.col("line").startswith("- **"))
    m = lambda i: F.regexp_extract("line", r"^- \*\*(.+?)\*\* (.*?)(?: \(([^()]*)\))?$", i)
    return lines.select("profile", "kind", m(1).alias("id"), m(2).alias("text"), F.nullif(m(3), F.lit("")).alias("slot"))
