"""Seeded sampling, train and test splits, and the metadata of both.

Every draw orders rows by a hash of their key and a seed, so it is the same on any cluster. No task orders a whole
group: rows are counted by the first digits of their hash, the bin in which the last drawn row lies is read off the counts, and only that
bin's rows are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthospark.functions.columns import label, label_name, one_class_label
from orthospark.schema import CASES
from orthospark.sources.scratch import written

#: Hex digits of a hash by which rows are counted.
BIN_DIGITS = 3


def draw(key: Column, seed: str | Column) -> Column:
    """The hash by which keys are drawn."""
    return F.md5(F.concat(key.cast("string"), F.lit("|"), seed if isinstance(seed, Column) else F.lit(seed)))


def _bins(df: DataFrame, key: str, seed: str | Column) -> DataFrame:
    """Adds __hash and __bin, its first ``BIN_DIGITS`` digits as a number."""
    at = df.withColumn("__hash", draw(F.col(key), seed))
    return at.withColumn("__bin", F.conv(F.substring("__hash", 1, BIN_DIGITS), 16, 10).cast("int"))


def _cuts(counts: DataFrame, by: list[str]) -> DataFrame:
    """``counts(by, __bin, __n, __k)``: the bin (__cut.at) of the k-th row in each group, and how many of its rows are drawn (__cut.need).
    Groups of which nothing is drawn have no row."""
    w = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** BIN_DIGITS rows a group
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).where(F.col("__before") < F.col("__k"))
    return before.groupBy(*by).agg(F.max(F.struct(F.col("__bin").alias("at"), (F.col("__k") - F.col("__before")).alias("need"))).alias("__cut"))


def _drawn(binned: DataFrame, cuts: DataFrame, by: list[str], key: str) -> DataFrame:
    """Rows of :func:`_bins` with __drawn. Bins before the cut are drawn and those behind it aren't; only rows of the cut's bin are ordered.
    The cuts, a row a group, are written: they are worked out once, and their size is known when rows meet them."""
    other = written(cuts, "cuts").withColumnsRenamed({c: f"__of_{c}" for c in by})
    met = binned.join(other, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], "left").drop(*[f"__of_{c}" for c in by])
    edge = F.coalesce(F.col("__bin") == F.col("__cut.at"), F.lit(False))
    w = Window.partitionBy(*by, "__bin").orderBy("__hash", key)
    sure = met.where(~edge).withColumn("__drawn", F.coalesce(F.col("__bin") < F.col("__cut.at"), F.lit(False)))
    rest = met.where(edge).withColumn("__drawn", F.row_number().over(w) <= F.col("__cut.need"))
    return sure.unionByName(rest).drop("__hash", "__bin", "__cut")


def sample_k(df: DataFrame, by: list[str], key: str, k: int | Column, seed: str) -> DataFrame:
    """Up to k rows of each group, without replacement; a column k is the same in all rows of a group."""
    binned = _bins(df, key, seed)
    most = k if isinstance(k, Column) else F.lit(k)
    counts = binned.groupBy(*by, "__bin").agg(F.count("*").alias("__n"), F.max(most).alias("__most"))
    counts = counts.withColumn("__k", F.max("__most").over(Window.partitionBy(*by)))  # of bins, not rows
    return _drawn(binned, _cuts(counts, by), by, key).where("__drawn").drop("__drawn")


def shuffle(df: DataFrame, key: str, seed: str) -> DataFrame:
    return df.orderBy(draw(F.col(key), seed), key)


def case_counts(tiles: DataFrame) -> DataFrame:
    return tiles.where(F.col("case").isin(*CASES)).groupBy("orchard", "case").agg(F.count("*").alias("n"))


def move_counts(tiles: DataFrame) -> DataFrame:
    """How many normal tiles of each site go to the test set: the largest case, but at most a quarter of the normals."""
    facts = tiles.groupBy("orchard").agg(F.count_if(F.col("case") == "normal").alias("normals"))
    largest = case_counts(tiles).groupBy("orchard").agg(F.max("n").alias("largest"))
    return facts.join(largest, "orchard", "left").select("orchard", _move().alias("move"))


def _move() -> Column:
    return F.least(F.coalesce("largest", F.lit(0)), F.floor(F.coalesce("normals", F.lit(0)) / 4))


def train_test_split(tiles: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds split: cases are test, normals train but for as many as :func:`move_counts` says; counted, cut and read: three readings of the tiles."""
    binned = _bins(tiles.where(F.col("orchard").isNotNull()), key, seed)
    counts = binned.groupBy("orchard", "case", "__bin").agg(F.count("*").alias("__n"))
    # Windows over bins, not rows.
    sized = counts.withColumn("__size", F.sum("__n").over(Window.partitionBy("orchard", "case")))
    most = lambda when: F.max(F.when(when, F.col("__size"))).over(Window.partitionBy("orchard"))
    sized = sized.withColumn("largest", most(F.col("case").isin(*CASES))).withColumn("normals", most(F.col("case") == "normal"))
    cuts = _cuts(sized.where("case = 'normal'").withColumn("__k", _move()), ["orchard", "case"])
    test = (F.col("case") != "normal") | F.col("__drawn")
    return _drawn(binned, cuts, ["orchard", "case"], key).withColumn("split", F.when(test, "test").otherwise("train")).drop("__drawn")


def complete_sites(tiles: DataFrame) -> DataFrame:
    """Tiles of sites that have normal tiles and tiles of every case; the others are left out."""
    sets = tiles.where(F.col("case").isin("normal", *CASES)).groupBy("orchard").agg(F.count_distinct("case").alias("__n")).where(F.col("__n") == 1 + len(CASES))
    return tiles.join(sets, "orchard", "left_semi")


def one_class_rows(rows: DataFrame, cls: str, normals: list[int], split: str) -> DataFrame:
    """Rows of a set of ten classes (10 stands for 0) with label 0 for the normal ones; the training side holds these alone."""
    out = rows.withColumn(cls, F.when(F.col(cls) == 10, 0).otherwise(F.col(cls))).withColumn("label", one_class_label(F.col(cls), normals))
    return out.where("label = 0") if split == "train" else out


def attach_stats(rows: DataFrame, stats: DataFrame, site: str = "orchard") -> DataFrame:
    """Mean and deviation vectors of the row's site; null where it has none."""
    vectors = stats.groupBy(site).agg(F.array_sort(F.collect_list(F.struct("b", "mean", "std"))).alias("__s"))
    return rows.join(vectors, site, "left").withColumn("mean", F.transform("__s", lambda s: s["mean"])).withColumn("std", F.transform("__s", lambda s: s["std"])).drop("__s")


def labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", label(F.col("case"))).withColumn("label_name", label_name(F.col("case")))


def build_train_metadata(split: DataFrame) -> DataFrame:
    return labelled(split.where((F.col("split") == "train") & (F.col("case") == "normal"))).withColumn("clsname", F.col("orchard"))


def _with_normals(split: DataFrame) -> DataFrame:
    return split.where((F.col("split") == "test") & (F.col("case") == "normal")).select("orchard").distinct()


def cases_with_normals(split: DataFrame) -> DataFrame:
    """Test rows of anomaly cases at sites that have normal test rows."""
    return split.where((F.col("split") == "test") & F.col("case").isin(*CASES)).join(_with_normals(split), "orchard", "left_semi")


def cases_without_normals(split: DataFrame) -> DataFrame:
    return split.where((F.col("split") == "test") & F.col("case").isin(*CASES)).join(_with_normals(split), "orchard", "left_anti")


def build_test_metadata(split: DataFrame, key: str, seed: str, totals: bool = False) -> DataFrame:
    """Per case the case's rows and as many normal ones of the same site, under clsname all_<case>; unless
    ``totals``, the same again per site, under <site>_<case>, with a draw of its own."""
    test = split.where((F.col("split") == "test") & F.col("case").isin("normal", *CASES))
    blocks = ["all"] if totals else ["all", "site"]
    # A case's row stands once in each block, before every bin; a normal one once in each block and case that it may be drawn for.
    own = F.array(*[F.struct(F.lit(b).alias("block"), F.col("case").alias("case"), F.lit(None).cast("string").alias("seed")) for b in blocks])
    every = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(c).alias("case"), F.lit(f"{seed}|{b}|{c}").alias("seed")) for b in blocks for c in CASES])
    spread = test.withColumn("__in", F.explode(F.when(F.col("case") == "normal", every).otherwise(own)))
    spread = spread.withColumn("__block", F.col("__in.block")).withColumn("__case", F.col("__in.case"))
    binned = _bins(spread, key, F.col("__in.seed")).withColumn("__bin", F.coalesce("__bin", F.lit(-1))).drop("__in")
    group = ["orchard", "__block", "__case"]
    counts = binned.groupBy(*group, "__bin").agg(F.count("*").alias("__n"))
    of = Window.partitionBy(*group)  # of bins, not rows
    counts = counts.withColumn("__k", F.max(F.when(F.col("__bin") < 0, F.col("__n"))).over(of)).where("__bin >= 0")
    # Without normal rows, or without rows of the case, there is no cut, and nothing is kept.
    rows = _drawn(binned, _cuts(counts, group), group, key).where("__drawn")
    clsname = F.when(F.col("__block") == "all", F.concat(F.lit("all_"), "__case")).otherwise(F.concat("orchard", F.lit("_"), "__case"))
    return labelled(rows).withColumn("clsname", clsname).drop("__block", "__case", "__drawn")


def case_statistics(metadata: DataFrame) -> DataFrame:
    """Normal and defective counts per class of :func:`build_test_metadata`."""
    return metadata.groupBy("clsname").agg(F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("defective"))


def order_test_rows(metadata: DataFrame, key: str) -> DataFrame:
    """all_ rows first, then by class, site and key."""
    return metadata.orderBy((~F.col("clsname").startswith("all_")).cast("int"), "clsname", "orchard", key)
