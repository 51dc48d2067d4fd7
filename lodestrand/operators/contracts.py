"""Rules that hold between stages: no gold before a ranking is frozen, one computation for equal inputs, resumable sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import stored

#: Columns that come from gold answers and never reach candidate generation, ranking or selection.
FORBIDDEN = frozenset(
    "answer supporting_facts evidences raw_evidences gold_explanations gold_units gold_support_units raw_supporting_facts label "
    "rank_target best_set_f1_to_gold best_jaccard_to_gold exact_match_any_gold contains_any_gold_explanation".split()
)


def assert_gold_free(df: DataFrame) -> None:
    if found := sorted(FORBIDDEN & set(df.columns)):
        raise ValueError(f"gold columns before the ranking is frozen: {found}")


def gold_free(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """The allowed columns that ``df`` has."""
    return df.select(*(c for c in allowed if c in df.columns and c not in FORBIDDEN))


def compute_once(rows: DataFrame, inputs: list[str], compute) -> DataFrame:
    """``rows`` with what ``compute`` (distinct inputs -> inputs plus results) says of their inputs; equal inputs are computed once."""
    return rows.join(compute(rows.select(*inputs).distinct()), inputs)


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): a checksum of all rows that doesn't depend on their order."""
    each = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.pmod(each, F.lit(1 << 31))), F.lit(0)).alias("digest"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has and the other hasn't, repeats included; none if the tables are equal."""
    return a.exceptAll(b).union(b.exceptAll(a))


@dataclass(frozen=True)
class Frozen:
    """A selection's digest, taken before gold is opened: only the same rows may be scored."""

    rows: int
    digest: int

    @classmethod
    def of(cls, selection: DataFrame) -> Frozen:
        return cls(*digest(selection).first())

    def open(self, selection: DataFrame) -> DataFrame:
        """``selection`` again, if its rows are those that were frozen; else an error."""
        if Frozen.of(selection) != self:
            raise ValueError("the selection isn't the one that was frozen")
        return selection


def split_overlaps(rows: DataFrame, split: str, key: str) -> DataFrame:
    """(a, b, shared): pairs of splits with ids in common; none if splits are disjoint. Null ids are an error.

    Ids meet by their splits, a set for each id, so pairs grow with the number of splits and not of rows.
    """
    if not rows.where(F.col(key).isNull()).isEmpty():
        raise ValueError("an id is empty")
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
    pairs = F.flatten(F.transform("splits", lambda x: F.transform(F.filter("splits", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def group_starts(rows: DataFrame, part: str, order: str, key: str) -> DataFrame:
    """(part, key, starts): how often a run of rows with the same key begins, in the order of a part; once if it is contiguous."""
    before = F.lag(key).over(Window.partitionBy(part).orderBy(order))
    return rows.withColumn("starts", (~F.col(key).eqNullSafe(before)).cast("int")).groupBy(part, key).agg(F.sum("starts").alias("starts"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, missing): keys of either side that the other hasn't."""
    count = lambda a, b, side: a.join(b, key, "left_anti").agg(F.lit(side).alias("side"), F.count("*").alias("missing"))
    return count(left, right, "left").union(count(right, left, "right"))


def clean_triples(triples: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """(s, p, o) of ``triples`` (s, p, o, at): spaces collapsed, relations lower-cased and mapped, loops gone, the first of equal ones.

    Triples are equal if they differ in case alone; the first is that of the smallest ``at``, then by its text.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    relation = F.lower(flat("p"))
    for name, meant in synonyms.items():
        relation = F.when(F.lower(flat("p")) == name, meant).otherwise(relation)
    clean = triples.select(flat("s").alias("s"), relation.alias("p"), flat("o").alias("o"), "at").where("s <> '' and p <> '' and o <> '' and lower(s) <> lower(o)")
    first = clean.groupBy(F.lower("s").alias("ls"), "p", F.lower("o").alias("lo")).agg(F.min(F.struct("at", "s", "o")).alias("t"))
    return first.select("t.s", "p", "t.o")


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, size, sha256) of files, or of tables of several files, a row for each path; names are the last parts of paths.

    A folder's size is that of all files in it, its hash that of its files' places and hashes in order. Each file is hashed
    where it is read; only hashes meet.
    """
    out = None
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        own = F.element_at(F.split("path", "/"), -1) == name
        hashed = files.select(own.alias("own"), "length", F.concat(F.substring_index("path", f"/{name}/", -1), F.lit(" "), F.sha2("content", 256)).alias("line"), F.sha2("content", 256).alias("sha256"))
        whole = F.when((F.count("*") == 1) & F.max("own"), F.max("sha256")).otherwise(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256))
        row = hashed.agg(F.lit(name).alias("name"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"), whole.alias("sha256"))
        out = row if out is None else out.union(row)
    return out


def manifest_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names that are missing on a side or whose size or hash differ."""
    other = after.select("name", F.col("size").alias("size_after"), F.col("sha256").alias("sha256_after"))
    return before.join(other, "name", "full").where(~(F.col("size").eqNullSafe(F.col("size_after")) & F.col("sha256").eqNullSafe(F.col("sha256_after")))).select("name")


#: What marks a backend that has seen gold.
CONTAMINATED = ("provided", "provided_plus_llm", "llm_with_provided")


def refuse_backends(rows: DataFrame, column: str) -> DataFrame:
    """``rows``, of which none may come from a contaminated backend: one that does raises where it is read. Null is clean."""
    name = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    bad = F.lit(False)
    for mark in CONTAMINATED:
        bad = bad | name.contains(mark)
    said = F.raise_error(F.concat(F.lit("contaminated backend: "), name))
    return rows.withColumn(column, F.when(bad, said.cast(rows.schema[column].dataType)).otherwise(F.col(column)))


def in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with (_part, _at): their order by ``columns``, in ranges, a range a partition. A file's own order is (path, row)."""
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))


def runs(rows: DataFrame, key: str, position: str) -> DataFrame:
    """(key, first, rows): maximal runs of neighbouring rows with one key; null is a key like any other.

    Runs are found in each part on its own. A part's first run goes on from the part before if that one's last row, or the
    last row of the nearest part that has any, has the same key: these boundary rows, two for each part, are all that is
    compared across parts. ``rows``: as from :func:`in_order`.
    """
    own = Window.partitionBy("_part").orderBy("_at")
    before = F.lag(F.struct(F.col(key).alias("k"))).over(own)
    flagged = rows.select("_part", "_at", F.col(key).alias("k"), F.col(position).alias("p"), (before.isNull() | ~before["k"].eqNullSafe(F.col(key))).cast("int").alias("new"))
    each = flagged.withColumn("run", F.sum("new").over(own)).groupBy("_part", "run", "k").agg(F.min_by("p", "_at").alias("first"), F.count("*").alias("rows"))
    each = stored(each)
    ends = each.groupBy("_part").agg(F.max_by(F.struct("k"), "run").alias("last"), F.min_by(F.struct("k"), "run").alias("head"), F.max("run").alias("n"))
    across = Window.orderBy("_part")
    goes_on = F.coalesce(F.lag("last").over(across)["k"].eqNullSafe(F.col("head")["k"]) & F.lag("last").over(across).isNotNull(), F.lit(False))
    ends = ends.withColumn("goes_on", goes_on)
    # parts that are one run and go on belong to the run that began before them
    begun = F.max(F.when(~F.col("goes_on") | (F.col("n") > 1), F.col("_part"))).over(across.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("into", F.when(F.col("goes_on"), begun)).select("_part", "goes_on", "into")
    last = each.groupBy("_part").agg(F.max("run").alias("last_run")).withColumnRenamed("_part", "into")
    joined = each.join(ends, "_part").withColumn("into", F.when((F.col("run") == 1) & F.col("goes_on"), F.col("into"))).join(last, "into", "left")
    owner = F.struct(F.coalesce("into", "_part").alias("part"), F.coalesce("last_run", "run").alias("run"))
    return joined.groupBy(owner.alias("o"), "k").agg(F.min_by("first", F.struct("_part", "run")).alias("first"), F.sum("rows").alias("rows")).select(F.col("k").alias(key), "first", "rows")


def contiguous(rows: DataFrame, key: str, position: str) -> DataFrame:
    """(key, first, rows) of groups that must each be one run: a group that comes again, or a null key, raises."""
    each = runs(rows, key, position).groupBy(key).agg(F.min("first").alias("first"), F.sum("rows").alias("rows"), F.count("*").alias("runs"))
    said = F.concat(F.lit("group isn't one run of rows: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    count = F.when(F.col(key).isNull() | (F.col("runs") > 1), F.raise_error(said).cast("long")).otherwise(F.col("rows"))
    return each.select(key, "first", count.alias("rows"))
