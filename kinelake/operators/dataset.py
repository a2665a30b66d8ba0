"""Clip metadata, joins, splits, class encoding and dataset checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from kinelake.functions import labels as rules
from kinelake.operators import contracts
from kinelake.operators.holding import holders
from kinelake.session import settle

#: Rows of a label or plan table that is broadcast.
FEW = 100_000
#: Columns that describe a clip and are no features.
METADATA_COLUMNS = ("video_id", "file_name", "relative_path", "shot_label", "quality", "person_id", "use_for_v1", "encoded_label")
#: Characters of the runs by which file names are indexed.
GRAM = 8


def metadata(files: DataFrame) -> DataFrame:
    """Metadata of (path): label from the folder, quality and player from the name, ids by path order.

    Ids are ranks in the order of lower-cased paths: paths are range-partitioned and
    sorted, then a partition's first rank is the sum of the counts before it.
    """
    ordered = files.select("path").repartitionByRange(F.lower("path"), F.col("path")).sortWithinPartitions(F.lower("path"), "path")
    # Partition number and place in it, fixed by the written table.
    placed = settle(ordered.withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(firsts), "_part")
    number = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    label = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise("unknown")
    return ranked.select(
        F.format_string("%03d", number).alias("video_id"), name.alias("file_name"), F.col("path").alias("relative_path"), label.alias("shot_label"),
        rules.quality_of(stem, label).alias("quality"), rules.player_of(stem, label).alias("person_id"), F.when(label == "idle", "no").otherwise("yes").alias("use_for_v1"),
    )


def _stem(name: Column) -> Column:
    """A file name without its last ending."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def files_that_hold(stems: DataFrame, files: DataFrame, most: int = GRAM) -> DataFrame:
    """(stem, hits, seq_file) of distinct stems: how many files hold the stem in their own, and the least of them.

    ``holders`` finds them by runs of most characters.
    """
    wanted = stems.where("stem <> ''").distinct()
    found = holders(wanted, files.select("seq_file", _stem(F.col("seq_file")).alias("own")), most, 2 * most)
    return found.groupBy("stem").agg(F.count(F.lit(1)).alias("hits"), F.min("seq_file").alias("fallback"))


def match_sequences(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Status and sequence file of each metadata row (video_id, file_name): matched, ambiguous or missing.

    Files (seq_file, their names) are joined on the normalised id that their name
    begins with. Of several, the only one that holds the row's stem counts, else the
    one that is named id, stem and ending exactly. Rows without any fall back to the
    only file whose stem holds theirs (``files_that_hold``); rows without a stem don't.
    """
    rows = meta.withColumn("_id", F.coalesce(rules.video_id(F.col("video_id").cast("string")), F.lit(""))).withColumn("_stem", _stem(F.trim(F.coalesce("file_name", F.lit("")))))
    token = F.substring_index("seq_file", "_", 1)
    listed = files.select("seq_file", F.when(token.rlike(r"^\d+$"), rules.video_id(token)).otherwise(token).alias("_id"))
    holds = (F.col("_stem") != "") & F.contains("seq_file", "_stem")
    exact = F.col("seq_file") == F.concat("_id", F.lit("_"), "_stem", F.lit("_sequence.json"))
    found = (
        # The id follows from video_id; grouped by it as well, the join's exchange serves the groups.
        rows.join(listed, "_id", "left").groupBy("_id", "video_id", "file_name", "_stem")
        .agg(F.count("seq_file").alias("n"), F.count_if(F.coalesce(holds, F.lit(False))).alias("held"), F.min("seq_file").alias("any"), F.min(F.when(holds, F.col("seq_file"))).alias("one"), F.max(F.when(exact, F.col("seq_file"))).alias("named"))
    )
    found = settle(found.drop("_id"))
    alone = found.where("n = 0")
    by_stem = files_that_hold(alone.select(F.col("_stem").alias("stem")), files)
    looked = alone.join(by_stem, F.col("_stem") == F.col("stem"), "left").drop("stem")
    both = looked.unionByName(found.where("n > 0"), allowMissingColumns=True)
    file = F.when(F.col("n") == 1, F.col("any")).when(F.col("held") == 1, F.col("one")).when(F.col("n") > 1, F.col("named")).when(F.col("hits") == 1, F.col("fallback"))
    status = F.when(file.isNotNull(), "matched").when((F.col("n") > 1) | (F.col("hits") > 1), "ambiguous").otherwise("missing")
    return both.select("video_id", "file_name", status.alias("status"), file.alias("seq_file"))


def join_violations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once on either side of a join that should be one to one."""
    counted = lambda df, side: df.groupBy(*keys).count().where("count > 1").select(*keys, F.lit(side).alias("side"), F.col("count").alias("n"))
    return counted(left, "left").unionByName(counted(right, "right"))


def joined_split(split: DataFrame, meta: DataFrame) -> DataFrame:
    """The rows of a split (video_id, file_name, shot_label) with their person, and what is wrong with them (violation).

    Each row should meet one metadata row of its video_id and file_name. violation is
    duplicate_split, duplicate_meta, missing_person (no such row, or a blank person) or
    label_mismatch, NULL if all is well; a row that repeats on either side comes once for each pair.
    """
    keys = ["video_id", "file_name"]
    repeats = lambda df, name: df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    known = repeats(meta.select(*keys, "person_id", F.col("shot_label").alias("_label")), "_meta")
    joined = repeats(split, "_split").join(known, keys, "left")
    violation = (
        F.when(F.col("_split") > 1, "duplicate_split").when(F.col("_meta") > 1, "duplicate_meta")
        .when(F.coalesce(F.trim("person_id"), F.lit("")) == "", "missing_person").when(~F.col("shot_label").eqNullSafe(F.col("_label")), "label_mismatch")
    )
    return joined.select(*split.columns, "person_id", violation.alias("violation"))


def strict_split(split: DataFrame, meta: DataFrame) -> DataFrame:
    """``joined_split``, written once; ContractError with the number of rows of each violation."""
    rules_of = {name: F.col("violation") == name for name in ("duplicate_split", "duplicate_meta", "missing_person", "label_mismatch")}
    return contracts.checked(joined_split(split, meta), rules_of).drop("violation")


def with_person(predictions: DataFrame, meta: DataFrame) -> DataFrame:
    """Person and quality by file name; with any duplicate name the lookup counts as empty."""
    clash = meta.groupBy("file_name").count().agg(F.coalesce(F.max("count") > 1, F.lit(False)).alias("_clash"))
    looked = meta.select("file_name", "person_id", F.col("quality").alias("_quality")).dropDuplicates(["file_name"]).crossJoin(F.broadcast(clash)).where("not _clash").drop("_clash")
    return predictions.join(looked, "file_name", "left").withColumn("person_id", F.coalesce("person_id", F.lit("unknown"))).withColumn("quality", F.coalesce("_quality", rules.quality_of(F.col("file_name")))).drop("_quality")


def encode_labels(rows: DataFrame, label: str = "shot_label", classes: list[str] | None = None) -> DataFrame:
    """Rows with encoded_label, the place of the label in code-point order.

    classes is a mapping made before. Blank labels, fewer than two classes and labels
    that classes doesn't hold are errors, raised before any row is encoded; so are
    more than FEW classes. One job finds the classes.
    """
    found = rows.groupBy(F.coalesce(F.trim(label), F.lit("")).alias("_label")).agg(F.count(F.lit(1)).alias("n")).limit(FEW + 2).collect()
    counts = {r["_label"]: r["n"] for r in found}
    if "" in counts:
        raise ValueError(f"{counts['']} labels are blank")
    if len(counts) > FEW:
        raise ValueError(f"over {FEW} classes")
    known = sorted(set(classes) if classes is not None else counts)
    unseen = sorted(counts.keys() - set(known))
    if unseen:
        raise ValueError(f"labels that weren't seen before: {unseen[:5]}")
    if len(known) < 2 and classes is None:
        raise ValueError("fewer than two classes")
    numbered = rows.sparkSession.createDataFrame(list(enumerate(known)), "encoded_label int, _label string")
    return rows.join(F.broadcast(numbered), F.trim(rows[label]) == F.col("_label")).drop("_label")


def distribution_check(rows: DataFrame, expected: int, label: str = "shot_label") -> DataFrame:
    """Labels whose number of rows isn't the expected one, with both numbers."""
    counted = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") != expected).withColumn("expected", F.lit(expected))


def distribution(rows: DataFrame, split: str = "split", label: str = "shot_label") -> DataFrame:
    """Counts by split and label, by split, and in all (NULLs)."""
    return rows.rollup(split, label).agg(F.count(F.lit(1)).alias("n"))


def stratified_split(rows: DataFrame, key: str, label: str = "shot_label", train: float = 0.7, validation: float = 0.15, seed: str = "42") -> DataFrame:
    """Exact shares of each class in a hashed order, without sorting a class in one task.

    The order is md5 of key and seed; its first three digits are buckets whose counts
    give each bucket's first rank.
    """
    hashed = rows.withColumn("_order", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).withColumn("_bucket", F.substring("_order", 1, 3))
    counts = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label)
    starts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(w)).drop("_n")
    rank = F.col("_first") + F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_order", key)) - 1
    last_train, last_validation = F.round(F.col("_total") * train), F.round(F.col("_total") * train) + F.round(F.col("_total") * validation)
    placed = hashed.join(starts, [label, "_bucket"]).withColumn("_rank", rank)
    return placed.withColumn("split", F.when(F.col("_rank") < last_train, "train").when(F.col("_rank") < last_validation, "validation").otherwise("test")).drop("_order", "_bucket", "_first", "_total", "_rank")


def _turns(lacks: list[int], n: int, m: int) -> list[tuple[int, int, list[int]]]:
    """How m groups of n rows each go to the split that lacks most (the first one on ties), one by one.

    (first turn, turns, splits in turn) of each phase: the splits that lack less come
    in one after the other, and all that are in take turns, as each turn costs n.
    """
    phases: list[tuple[int, int, list[int]]] = []
    lacks, done = list(lacks), 0
    while done < m:
        best = max(range(len(lacks)), key=lambda i: (lacks[i], -i))
        # Those within one turn of the best one are in; a whole round of them changes no order among them.
        inside = sorted((i for i in range(len(lacks)) if (lacks[i], -i) > (lacks[best] - n, -best)), key=lambda i: (-lacks[i], i))
        rounds = m
        for i in set(range(len(lacks))) - set(inside):
            # Rounds that keep every one inside ahead of those outside, to the last turn.
            rounds = min(rounds, max(0, (lacks[inside[-1]] - lacks[i] - 1) // n))
        turns = min(m - done, max(1, rounds) * len(inside)) if rounds else 1
        phases.append((done, turns, inside if rounds else inside[:1]))
        for k, i in enumerate(phases[-1][2]):
            lacks[i] -= n * (turns // len(phases[-1][2]) + (k < turns % len(phases[-1][2])))
        done += turns
    return phases


def player_disjoint_split(rows: DataFrame, group: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: str = "42") -> DataFrame:
    """Whole groups, largest first (ties in hashed order), each to the split that lacks most; ties go train, validation, test.

    Groups of one size are a class. The driver plans turns by class - there are fewer
    classes than the square root of twice the rows -, and each group finds its turn by
    its rank in the class, ranked in hashed buckets. Blank groups are errors. Ratios
    count to six decimals.
    """
    if min(ratios) < 0 or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must not be negative and sum to 1")
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")))
    sizes = settle(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_order", hashed).withColumn("_bucket", F.substring("_order", 1, 3)))
    if not sizes.where(F.col(group).isNull() | (F.trim(F.col(group).cast("string")) == "")).isEmpty():
        raise ValueError("a group is blank")
    counts = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()
    names, scale = ("train", "validation", "test"), 1_000_000
    shares = [round(r * scale) for r in ratios]
    lacks, plan = [s * sum(r["n"] * r["m"] for r in counts) for s in shares], []
    for r in counts:
        for first, turns, order in _turns(lacks, r["n"] * scale, r["m"]):
            plan.append((r["n"], first, first + turns, [names[i] for i in order]))
            for k, i in enumerate(order):
                lacks[i] -= r["n"] * scale * (turns // len(order) + (k < turns % len(order)))
    turns = rows.sparkSession.createDataFrame(plan, "n long, _from long, _to long, _names array<string>")
    by_class = Window.partitionBy("n")
    firsts = sizes.groupBy("n", "_bucket").agg(F.count(F.lit(1)).alias("_k")).withColumn("_first", F.coalesce(F.sum("_k").over(by_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    ranked = sizes.join(firsts, ["n", "_bucket"]).withColumn("_rank", F.col("_first") + F.row_number().over(Window.partitionBy("n", "_bucket").orderBy("_order", group)) - 1)
    slim = F.broadcast(turns) if len(plan) <= FEW else turns
    in_turn = ranked.join(slim, (ranked["n"] == turns["n"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    place = F.pmod(F.col("_rank") - F.col("_from"), F.size("_names")).cast("int")
    assigned = in_turn.select(group, F.get("_names", place).alias("split"))
    return rows.join(assigned, group)


def split_summary(rows: DataFrame, group: str) -> DataFrame:
    """Samples and groups of each split, and how many of its groups other splits have, too.

    Rows are counted by group and split once; the rest works on these counts.
    """
    counts = rows.where(F.col(group).isNotNull()).groupBy(group, "split").agg(F.count(F.lit(1)).alias("_n"))
    spread = counts.withColumn("_splits", F.count(F.lit(1)).over(Window.partitionBy(group)))  # a row a split
    return spread.groupBy("split").agg(F.sum("_n").alias("samples"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_splits") > 1).alias("shared_groups"))


def split_labels(rows: DataFrame, label: str = "shot_label") -> DataFrame:
    """Rows of each split and label; blank labels aren't counted."""
    return rows.where(F.trim(label) != "").groupBy("split", F.trim(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def split_overlap(rows: DataFrame, group: str) -> DataFrame:
    """Groups that two splits share, for each pair of splits, zeros kept; disjoint says that there are none."""
    names = ("train", "validation", "test")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    held = rows.groupBy(group).agg(F.collect_set("split").alias("s"))
    both = [F.count_if(F.array_contains("s", a) & F.array_contains("s", b)) for a, b in pairs]
    made = held.agg(F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), n.alias("shared")) for (a, b), n in zip(pairs, both, strict=True)]).alias("p"))
    return made.select(F.inline("p")).withColumn("disjoint", F.col("shared") == 0)


def split_audit(rows: DataFrame, key: str, group: str) -> DataFrame:
    """One row: samples in several splits, groups in several splits, and the verdict of both."""
    several = lambda c, name: rows.groupBy(c).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias(name))
    both = several(key, "leaked_samples").crossJoin(F.broadcast(several(group, "shared_groups")))  # one row each
    verdict = F.when(F.col("leaked_samples") > 0, "leakage").when(F.col("shared_groups") > 0, "valid_not_disjoint").otherwise("valid_disjoint")
    return both.withColumn("verdict", verdict)


def person_counts(rows: DataFrame, label: str = "shot_label") -> DataFrame:
    """Samples of each person in each split, by label and in all (label NULL)."""
    return rows.groupingSets([["split", "person_id"], ["split", "person_id", label]], "split", "person_id", label).agg(F.count(F.lit(1)).alias("n"))


def players(meta: DataFrame) -> DataFrame:
    """Samples of each person among usable clips."""
    return meta.where(use_clip(F.col("use_for_v1"))).groupBy("person_id").agg(F.count(F.lit(1)).alias("samples"))


def set_report(full: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Keys that are missing from the parts, extra in them, or in several splits."""
    missing = full.select(key).distinct().join(parts.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = parts.select(key).distinct().join(full.select(key), key, "left_anti").withColumn("problem", F.lit("extra"))
    leaked = parts.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(key, F.lit("leaked").alias("problem"))
    return missing.unionByName(extra).unionByName(leaked)


def label_report(full: DataFrame, parts: DataFrame, known: tuple[str, ...], label: str = "shot_label") -> DataFrame:
    """Labels of the parts that aren't known, and known labels that the whole set never has."""
    unknown = parts.where(~F.col(label).isin(*known)).select(F.col(label).alias("label")).distinct().withColumn("problem", F.lit("unknown"))
    names = full.sparkSession.createDataFrame([(k,) for k in known], "label string")
    unseen = names.join(full.select(F.col(label).alias("label")).distinct(), "label", "left_anti").withColumn("problem", F.lit("unseen"))
    return unknown.unionByName(unseen)


def numeric_schema(df: DataFrame, ignored: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric columns that are features, and the columns left out."""
    features = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in ignored]
    return features, [c for c in df.columns if c not in features]


def feature_schema(df: DataFrame, target: str, metadata: tuple[str, ...] = METADATA_COLUMNS, text: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Features and ignored columns of a table, by one pass; ContractError with the counts of missing and unreadable values.

    Numeric columns other than target and metadata are features, booleans aren't; columns in
    text count as numeric if they can be read as numbers, which must then hold for all rows.
    """
    features, _ = numeric_schema(df, (target, *metadata))
    features += [c for c in text if c in df.columns and c not in features]
    if not features:
        raise contracts.ContractError({"numeric features missing": 1})
    value = {c: F.col(c).try_cast("double") if c in text else F.col(c).cast("double") for c in features}
    missing = [F.count_if(F.col(c).isNull() | F.coalesce(F.isnan(v), F.lit(False))).alias(f"{c}: missing") for c, v in value.items()]
    odd = [F.count_if(F.col(c).isNotNull() & v.isNull()).alias(f"{c}: not a number") for c, v in value.items() if c in text]
    counts = {name: n for name, n in df.agg(*missing, *odd).first().asDict().items() if n}
    if counts:
        raise contracts.ContractError(counts)
    ordered = [c for c in df.columns if c in features]
    return {"features": ordered, "ignored": [c for c in df.columns if c not in ordered]}


def column_report(found: list[str], expected: list[str]) -> dict[str, list[str]]:
    """Missing, unexpected and misplaced columns."""
    return {"missing": [c for c in expected if c not in found], "unexpected": [c for c in found if c not in expected], "misplaced": [c for c, d in zip(found, expected, strict=False) if c != d and c in expected]}


def first_filled(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate column with any value that isn't blank."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        return None
    row = df.agg(*[F.max(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))).alias(c) for c in there]).first()
    return next((c for c in there if row[c]), None)


def clip_checks(table: DataFrame, names: list[str], length: int = 60) -> DataFrame:
    """P20: contract of each clip: number of frames, places 0 to length - 1, finite values."""
    odd = sum((F.when(F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 1).otherwise(0) for n in names), F.lit(0))
    own = table.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.min("t").alias("first"), F.max("t").alias("last"), F.sum(odd).alias("not_finite"))
    return own.withColumn("ok", (F.col("frames") == length) & (F.col("first") == 0) & (F.col("last") == length - 1) & (F.col("not_finite") == 0))


def manifest(rows: DataFrame, features: int, length: int = 60, health: DataFrame | None = None) -> DataFrame:
    """One row about the dataset: counts, classes, shapes of the whole and of its splits, and the health of its features.

    health has health_status and features, a row a status.
    """
    splits = ("train", "validation", "test")
    sizes = [F.count_if(F.col("split") == s).alias(f"{s}_samples") for s in splits]
    made = rows.agg(F.count(F.lit(1)).alias("samples"), F.lit(features).alias("features"), F.count_distinct("shot_label").alias("classes"), F.array_join(F.sort_array(F.collect_set("shot_label")), ",").alias("class_names"), *sizes)
    shape = lambda n: F.concat_ws("x", F.col(n).cast("string"), F.lit(str(length)), F.lit(str(features)))
    made = made.withColumns({"shape": shape("samples")} | {f"{s}_shape": shape(f"{s}_samples") for s in splits})
    if health is None:
        return made
    told = health.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "health_status", F.col("features").cast("string")))), ",").alias("health"))
    return made.crossJoin(F.broadcast(told))  # one row each


def counted_split(rows: DataFrame, key: str, label: str = "shot_label", train: int = 14, validation: int = 3, each: int | None = 20, seed: str = "42") -> DataFrame:
    """W11 by counts: of each class the first train and next validation rows of the hashed order, the rest is test.

    A class that hasn't exactly ``each`` rows fails the job, unless each is None.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    if each is not None:
        wrong = F.raise_error(F.concat(F.lit("class "), F.coalesce(label, F.lit("NULL")), F.lit(": "), F.col("_n").cast("string"), F.lit(f" rows, {each} are needed")))
        sizes = sizes.withColumn("_n", F.when(F.col("_n") != each, wrong.cast("bigint")).otherwise(F.col("_n")))
    # Only the first rows of a class are ranked: their limit is taken in every task.
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy(order, key))).where(F.col("_rank") <= train + validation)
    first = ranked.select(key, label, "_rank")
    joined = rows.join(F.broadcast(sizes), label).join(first, [key, label], "left")
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank").isNotNull(), "validation").otherwise("test")
    return joined.where("_n > 0").withColumn("split", split).select(*rows.columns, "split")


def use_clip(value: Column, lenient: bool = False) -> Column:
    """P2."""
    return rules.yes(value, lenient)
