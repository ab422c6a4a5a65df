"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A run holds (h1, h2, n_docs, last_doc) of line hashes that no earlier run holds, bucketed and sorted by hash. Every batch
of documents is anti-joined with the runs by merging, bucket by bucket; what is left is new and becomes a run of level 0,
what is found again leaves only its counts. When a level has FANOUT runs they are merged into one run of the next level,
so a hash is rewritten once per level. Batches come by falling doc_id, so a hash's first batch holds its largest document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import text_of
from palisade.session import materialize, new_path

FANOUT = 3
BATCHES = 8
#: The white space that keys lose at both ends, and the letters that they lower.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWEST = -(2**63)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lowered(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """doc, text_hash and marks: (pos, h1, h2) of each line whose key has at least so many code points."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"),
        F.xxhash64(text_of()).alias("text_hash"),
        F.split(text_of(), "\n").alias("lines"),
    )
    keys = F.transform("lines", lambda line, pos: F.struct(pos.alias("pos"), line_key(line).alias("key")))
    long_enough = F.filter(keys, lambda x: F.char_length(x["key"]) >= least)
    marks = F.transform(
        long_enough,
        lambda x: F.struct(
            x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(11), x["key"]).alias("h2")
        ),
    )
    return rows.select("doc", "text_hash", marks.alias("marks")).where(F.size("marks") > 0)


def as_run(marked: DataFrame) -> DataFrame:
    """One row per hash: the documents that hold it and the largest of them. A document counts once."""
    own = F.array_distinct(F.transform("marks", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    rows = marked.select("doc", F.explode(own).alias("x")).select("doc", "x.*")
    return rows.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))


def merged(runs: list[DataFrame]) -> DataFrame:
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


class LineRuns:
    """The runs of all batches so far, by level, and the counts of hashes that came again.

    All are external tables in the shared folder, one bucket per shuffle partition, so joins with them move no row and a
    lost executor costs nothing. `forget` takes their names out of the catalog.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._again: list[DataFrame] = []
        self._names: list[str] = []

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        sorted_run = run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        sorted_run.option("path", new_path(self.spark, "line-run")).saveAsTable(name)
        self._names.append(name)
        return self.spark.table(name)

    def unseen(self, own: DataFrame) -> DataFrame:
        """The rows of a batch's run whose hash no earlier batch holds; call it before add."""
        for run in self.runs():
            own = own.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return own

    def add(self, marked: DataFrame) -> DataFrame:
        """Add a batch: its unseen hashes as a run, which is returned, then compact every level that is full."""
        own = self._write(as_run(marked))
        fresh = own
        if self.runs():
            fresh = self._write(self.unseen(own))
            self._again.append(own.join(fresh.select("h1", "h2"), ["h1", "h2"], "left_anti"))
        self.levels[0].append(fresh)
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._compacted(runs)))
            self.levels[level] = []
        return fresh

    def _compacted(self, runs: list[DataFrame]) -> DataFrame:
        """Runs share no hash, so merging them only brings each bucket together."""
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.repartition(self.buckets, "h1", "h2")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def counted(self) -> DataFrame | None:
        """Every hash with its documents over all batches and the largest document of its first batch."""
        again = [x.withColumn("last_doc", F.lit(None).cast("long")) for x in self._again]
        return merged(self.runs() + again) if self.runs() else None

    def forget(self) -> None:
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names = []


def by_falling_doc(docs: DataFrame, marked: DataFrame, batches: int) -> list[DataFrame]:
    """marked in at most so many batches, written once; every document of a batch is above all of the next one's."""
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 1000).alias("cuts")).first()["cuts"]
    batch = sum(((F.col("doc") < cut).cast("int") for cut in sorted(set(cuts or []))), F.lit(0))
    path = new_path(spark, "line-marks")
    marked.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(f"{marked._jdf.schema().toDDL()}, batch int").parquet(path)
    there = sorted(r["batch"] for r in stored.select("batch").distinct().collect())
    return [stored.where(F.col("batch") == i).drop("batch") for i in there]


def without_repeated_lines(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped of every row.

    Lines whose key is long enough and found in least_docs documents stay only in the largest doc_id that holds them.
    A null or empty text is one empty line; rows with the same doc_id are documents of their own, and all stay if theirs
    is the largest; a null doc_id is below all others; an empty table gives an empty result; other columns are not read.
    """
    runs = LineRuns(docs.sparkSession, fanout)
    parts = by_falling_doc(docs, line_hashes(docs, least_chars), batches)
    for part in parts:
        runs.add(part)
    rows = positioned(docs)
    if not parts:
        return rest_of(rows.withColumn("gone", F.lit(None).cast("array<int>")))
    common = materialize(runs.counted().where(F.col("n_docs") >= least_docs), "common-lines")
    runs.forget()
    marked = parts[0]
    for part in parts[1:]:
        marked = marked.unionByName(part)
    lines = marked.select("doc", "text_hash", F.explode("marks").alias("x")).select("doc", "text_hash", "x.*")
    gone = lines.join(common, ["h1", "h2"]).where("doc <> last_doc")
    gone = gone.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("gone"))
    return rest_of(rows.join(gone, ["doc", "text_hash"], "left"))


def positioned(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"),
        F.xxhash64(text_of()).alias("text_hash"),
        F.split(text_of(), "\n").alias("lines"),
    )


def rest_of(rows: DataFrame) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped of rows whose lines at the places in `gone` go."""
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.transform(left, lambda i: F.get("lines", i))
    return rows.select(
        "doc_id",
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
